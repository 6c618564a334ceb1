"""Mixing sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm.common import SPACE, checked_broadcast, packed, saved

# Epoch r of a token costs REPEAT_COST[r]: fresh text first, each repetition dearer than the one before.
REPEAT_COST = (0, 1, 3)
MAX_PATTERNS = 20_000
RUNS = 4


def quotas(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, most: int) -> dict[str | None, float]:
    """Targets by weight that add up to `total`; a target stops at `most` times its source's size, the excess is shared again."""
    target = {s: 0.0 for s in sizes}
    open_, left = set(sizes), float(total)
    while open_ and left > 0:
        weight = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / weight > most * sizes[s]}
        if not over:
            target |= {s: left * weights[s] / weight for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@dataclass
class Flow:
    """Cheapest flow in a small directed graph; capacities are words, costs are small integers."""

    heads: list[list[int]] = field(default_factory=list)
    to: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)

    def node(self) -> int:
        self.heads.append([])
        return len(self.heads) - 1

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.heads[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def push(self, start: int, end: int) -> None:
        """Fills the cheapest paths one after another until none is left."""
        height = [0] * len(self.heads)
        while True:
            far, via, queue = {start: 0}, {}, [(0, start)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > far[a]:
                    continue
                for e in self.heads[a]:
                    b = self.to[e]
                    step = d + self.cost[e] + height[a] - height[b]
                    if self.room[e] > 0 and step < far.get(b, 1 << 60):
                        far[b], via[b] = step, e
                        heapq.heappush(queue, (step, b))
            if end not in far:
                return
            limit = far[end]
            height = [h + min(far.get(n, limit), limit) for n, h in enumerate(height)]
            path, at = [], end
            while at != start:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def route(patterns: dict[tuple, int], target: dict[str | None, float], costs: tuple[int, ...] = REPEAT_COST) -> dict[tuple, dict]:
    """Words each pattern gives to each of its sources: all quotas as full as they can be, with the least repetition."""
    net = Flow()
    start, end = net.node(), net.node()
    sink = {s: net.node() for s in target}
    for s, amount in target.items():
        net.arc(sink[s], end, round(amount))
    arcs: dict[tuple, dict] = {}
    for members, size in sorted(patterns.items(), key=repr):
        own = net.node()
        for cost in costs:
            net.arc(start, own, size, cost)
        arcs[members] = {s: net.arc(own, sink[s], len(costs) * size) for s in members}
    net.push(start, end)
    return {members: {s: net.room[e ^ 1] for s, e in out.items()} for members, out in arcs.items()}


def close_run(state: dict, upto: int, filled: int) -> None:
    """Notes a run of a pattern and what is missing after it."""
    state["runs"].append((state["after"], upto, state["rest"]))
    state |= {"after": upto, "rest": state["rest"] - filled}


def word_count(text: Column) -> Column:
    """Number of words; one more than the gaps between them."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def mix(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: dict[str | None, float] | None = None,
    share: float = 1.0,
    seed: int = 17,
    buckets: int = 1 << 16,
) -> DataFrame:
    """Columns row (the input), size, source_size, target, taken; one row per input row.

    `source` holds a text or an array of texts (the sources a document belongs to). Sources in code point order, null
    last, weigh 1, 2, 3, repeating, unless `weights` names them; their targets share `share` of all words. A document
    of several sources has the first one's size and target in its row.

    Words are summed by membership pattern, the flow gives each pattern its words, and with them whole epochs and a
    remainder. The remainder goes to documents in the order of a seeded hash of the row, up to the last that fits, RUNS
    times among those no larger than what is missing, and at last to the one nearest to it. No document is taken more
    than three times.
    Null or empty texts have size 0 and are never taken; repeated rows share their hash and are taken or left together.
    An empty table gives an empty table.

    Only sums per pattern and per hash bucket reach a single task, and only sums per pattern the driver; more than
    MAX_PATTERNS patterns raise an error. A hot source is ordered by buckets, of which one alone is put in full order.
    """
    base = packed(docs, doc=doc, text=text, source=source)
    several = base.schema["source"].dataType.typeName() == "array"
    members = F.array_sort(F.array_distinct("source")) if several else F.array("source")
    draw = F.xxhash64(F.lit(seed), "doc", "text")
    base = base.select("row", members.alias("members"), word_count(F.col("text")).alias("size"), draw.alias("draw"))
    units = saved(base.groupBy("members", "draw").agg(F.sum("size").alias("size"), F.max("size").alias("one")))

    sums = units.groupBy("members").agg(F.sum("size").alias("size"))
    found = sums.limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["members"] if r["members"] is not None else [None]): int(r["size"]) for r in found}
    names = sorted({s for p in patterns for s in p if s is not None}) + [None] * any(None in p for p in patterns)
    sizes = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    weigh = {s: (weights or {}).get(s, 1 + i % 3) for i, s in enumerate(names)}
    target = quotas(sizes, weigh, share * sum(patterns.values()), len(REPEAT_COST))
    given = {p: min(sum(out.values()), len(REPEAT_COST) * patterns[p]) for p, out in route(patterns, target).items()}
    # What is known of each pattern grows to the words it still misses, runs of the hash order that are taken, one
    # document to fill up with and one to leave out.
    known = {
        p: {
            "source_size": sizes[p[0]] if p else 0, "target": target[p[0]] if p else 0.0, "epochs": given[p] // max(n, 1),
            "rest": given[p] % max(n, 1), "after": -(1 << 63), "runs": [], "filler": None, "times": None, "left_out": None,
        }
        for p, n in patterns.items()
    }
    spark = docs.sparkSession
    fields = {
        "source_size": "long", "target": "double", "epochs": "long", "rest": "long", "after": "long",
        "runs": "array<struct<after:long,upto:long,most:long>>", "filler": "long", "times": "long", "left_out": "long",
    }

    def with_plan(df: DataFrame, *names: str) -> DataFrame:
        plan = spark.createDataFrame(
            [(list(p), *[state[k] for k in names]) for p, state in known.items()],
            ", ".join(["of array<string>", *[f"{k} {fields[k]}" for k in names]]),
        ).coalesce(1)
        own = F.coalesce("members", F.array(F.lit(None).cast("string")))
        return df.join(checked_broadcast(plan, len(known), MAX_PATTERNS), own == F.col("of"))

    # A run goes along the order of the hash to the last document that still fits, among those no larger than what is
    # missing: first to the bucket of the hash in which the words run out, then inside it. The next run goes on from there.
    shift = 64 - (buckets - 1).bit_length()
    for _ in range(RUNS):
        dealt = with_plan(units, "rest", "after").filter("size > 0 and one <= rest and draw > after").withColumn("bucket", F.shiftright("draw", shift))
        upto = F.sum("size").over(Window.partitionBy("of").orderBy("bucket"))
        edge = dealt.groupBy("of", "rest", "bucket").agg(F.sum("size").alias("size")).withColumn("until", upto)
        last = F.min(F.when(F.col("until") > F.col("rest"), F.struct("bucket", (F.col("until") - F.col("size")).alias("before"))))
        edge = saved(edge.groupBy("of").agg(last.alias("edge"), F.max("until").alias("all")))
        for r in edge.filter("edge is null").collect():
            close_run(known[tuple(r["of"])], (1 << 63) - 1, r["all"])
        edge = edge.filter("edge is not null").select(F.col("of").alias("edge_of"), F.col("edge.bucket").alias("edge_bucket"), "edge.before")
        inside = dealt.join(checked_broadcast(edge, len(known), MAX_PATTERNS), (F.col("of") == F.col("edge_of")) & (F.col("bucket") == F.col("edge_bucket")))
        inside = inside.withColumn("until", F.col("before") + F.sum("size").over(Window.partitionBy("of").orderBy("draw")))
        fits = F.when(F.col("until") <= F.col("rest"), F.struct("until", "draw"))
        for r in inside.groupBy("of").agg(F.max(fits).alias("fit"), F.first("before").alias("before"), F.first("edge_bucket").alias("edge")).collect():
            close_run(known[tuple(r["of"])], r["fit"]["draw"] if r["fit"] else (r["edge"] << shift) - 1, r["fit"]["until"] if r["fit"] else r["before"])

    # Then the document comes that, taken so often as it still may be, is nearest to what is missing, and if that is too
    # much, one like the excess goes.
    in_runs = F.coalesce(F.exists("runs", lambda r: (F.col("draw") > r["after"]) & (F.col("draw") <= r["upto"]) & (F.col("one") <= r["most"])), F.lit(False))
    free = len(REPEAT_COST) - F.col("epochs") - in_runs.cast("long")
    tries = [F.when(free >= m, F.struct(F.abs(F.col("rest") - m * F.col("size")).alias("off"), F.lit(m).cast("long").alias("times"), "draw", "size")) for m in range(1, len(REPEAT_COST) + 1)]
    open_ = with_plan(units, "epochs", "rest", "runs").filter("size > 0 and rest > 0").groupBy("of").agg(F.min(F.array_min(F.array(*tries))).alias("best"))
    for r in open_.filter("best is not null").collect():
        state, best = known[tuple(r["of"])], r["best"]
        if best["off"] < state["rest"]:
            state |= {"filler": best["draw"], "times": best["times"], "rest": state["rest"] - best["times"] * best["size"]}
    again = in_runs.cast("long") + F.when(F.col("draw") == F.col("filler"), F.col("times")).otherwise(F.lit(0))
    shut = with_plan(units, "rest", "runs", "filler", "times").filter(F.expr("size > 0 and rest < 0") & (again > 0))
    for r in shut.groupBy("of").agg(F.min(F.struct(F.abs(F.col("rest") + F.col("size")).alias("off"), "draw")).alias("best")).collect():
        state = known[tuple(r["of"])]
        if r["best"]["off"] < -state["rest"]:
            state["left_out"] = r["best"]["draw"]
    again = again - F.when(F.col("draw") == F.col("left_out"), F.lit(1)).otherwise(F.lit(0))
    chosen = with_plan(base.withColumn("one", F.col("size")), "source_size", "target", "epochs", "runs", "filler", "times", "left_out")
    return chosen.select("row", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + again)).alias("taken"))
