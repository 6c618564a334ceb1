"""Knowledge graph of a view: nodes, edges, derived semantic edges, communities, insights."""

from __future__ import annotations

from itertools import chain, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import excerpt, section_title
from folioscope.operators.access import all_sources_allowed
from folioscope.operators.paging import global_rank
from folioscope.session import cut_lineage

DEFAULT_NODES = 3000
SECTIONS_PER_NODE = 8
NEIGHBORS = 6
BLOCK = 128
# How well two kinds of pages go together, both ways averaged; 0.5 for anything else.
TYPE_AFFINITY = {
    "entity": {"concept": 1.2, "entity": 0.8, "source_summary": 1.0, "comparison": 1.0},
    "concept": {"entity": 1.2, "concept": 0.8, "source_summary": 1.0, "comparison": 1.2},
    "source_summary": {"entity": 1.0, "concept": 1.0, "source_summary": 0.5, "comparison": 1.0},
    "comparison": {"entity": 1.0, "concept": 1.2, "source_summary": 1.0, "comparison": 0.8},
}


def graph_nodes(pages: DataFrame, page_sources: DataFrame, readable: DataFrame, limit: int | None = DEFAULT_NODES) -> DataFrame:
    """Newest live pages whose sources are all readable, as many as the view has room for; without limit, the whole graph."""
    allowed = all_sources_allowed(page_sources, readable.select("source_id", F.lit(True).alias("allowed")), "page_id")
    live = pages.filter(F.col("stale_at").isNull()).join(allowed, "page_id", "left_semi")
    return live if limit is None else live.orderBy(F.desc("updated_at"), F.asc("page_id")).limit(limit)


def graph_edges(links: DataFrame, nodes: DataFrame, allowed_links: DataFrame) -> DataFrame:
    """Links between nodes of the view: no catalog entries, not dangling, all sources readable."""
    ids = nodes.select("page_id")
    real = links.filter((F.col("link_type") != "catalog_entry") & F.col("to_id").isNotNull() & ~F.col("is_dangling"))
    return (
        real.join(allowed_links, "link_id", "left_semi")
        .join(ids.withColumnRenamed("page_id", "from_id"), "from_id", "left_semi")
        .join(ids.withColumnRenamed("page_id", "to_id"), "to_id", "left_semi")
    )


def graph_sections(sections: DataFrame, nodes: DataFrame, limit: int | None = DEFAULT_NODES) -> DataFrame:
    """Sections of the nodes, up to eight times the size of the view if it has one, with a title and an excerpt."""
    rows = sections.join(nodes.select("page_id", F.col("title").alias("page_title")), "page_id")
    cut = rows if limit is None else rows.orderBy("page_id", "section_no").limit(limit * SECTIONS_PER_NODE)
    heading = F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit(""))
    return cut.select(
        "page_id", "section_no",
        section_title(heading, F.col("text"), F.col("page_title")).alias("title"),
        excerpt(F.col("text")).alias("excerpt"),
    )


def neighbor_rows(edges: DataFrame) -> DataFrame:
    """(node, other) both ways, each pair once."""
    both = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("other")).union(
        edges.select("to_id", "from_id")
    )
    return both.filter(F.col("node") != F.col("other")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, relation_degree) from edges with a type; sections hang on `contains` edges."""
    ends = edges.select(F.col("from_id").alias("node"), "type").union(edges.select("to_id", "type"))
    return ends.groupBy("node").agg(
        F.count("*").alias("degree"), F.count_if(F.col("type") != "contains").alias("relation_degree")
    )


def adamic_adar(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, score) for the given pairs: sum of 1 / ln(max(degree, 2)) over common neighbours.

    Each pair is expanded from its end of smaller degree and tested against the other end, so a hub
    never multiplies the neighbours around it.
    """
    around = neighbor_rows(edges)
    size = around.groupBy("node").agg(F.count("*").alias("degree"))
    da, db = size.select(F.col("node").alias("a"), F.col("degree").alias("da")), size.select(F.col("node").alias("b"), F.col("degree").alias("db"))
    sided = pairs.select("a", "b").distinct().join(da, "a").join(db, "b")
    small = F.col("da") <= F.col("db")
    sided = sided.select(
        "a", "b", F.when(small, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(small, F.col("b")).otherwise(F.col("a")).alias("far")
    )
    common = sided.join(around, "node").join(
        around.select(F.col("node").alias("far"), "other"), ["far", "other"], "left_semi"
    )
    weight = size.select(F.col("node").alias("other"), (F.lit(1.0) / F.log(F.greatest("degree", F.lit(2)))).alias("w"))
    return common.join(weight, "other").groupBy("a", "b").agg(F.sum("w").alias("score"))


def type_affinity(a: Column, b: Column) -> Column:
    table = F.create_map(
        *chain.from_iterable(
            (F.lit(f"{x}|{y}"), F.lit((value + TYPE_AFFINITY[y][x]) / 2))
            for x, row in TYPE_AFFINITY.items()
            for y, value in row.items()
        )
    )
    return F.coalesce(table[F.concat_ws("|", a, b)], F.lit(0.5))


def _pairs_within(members: DataFrame, group: str, node: str) -> DataFrame:
    """(group, a, b): pairs of nodes that share a group, made block against block.

    Members are spread over blocks of about BLOCK rows and each pair of blocks is its own join key, so
    one group that holds many nodes becomes many small tasks. The rows that come out are as many as
    the pairs: keep views to a size whose pairs are wanted.
    """
    size = members.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(size, group).withColumn("block", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    left = placed.select(
        group, F.col(node).alias("a"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    )
    right = placed.select(
        group, F.col(node).alias("b"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")
    )
    return left.join(right, [group, "i", "j"]).filter(F.col("a") < F.col("b")).select(group, "a", "b")


def semantic_candidates(nodes: DataFrame, page_sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, score, label) for nodes of a view with a common source or a common neighbour."""
    ids = nodes.select("page_id", "page_type")
    owned = page_sources.select("page_id", "source_id").distinct().join(ids.select("page_id"), "page_id", "left_semi")
    shared = _pairs_within(owned, "source_id", "page_id").groupBy("a", "b").agg(F.count("*").alias("shared"))
    around = neighbor_rows(edges)
    size = around.groupBy("node").agg((F.lit(1.0) / F.log(F.greatest(F.count("*"), F.lit(2)))).alias("w"))
    hubs = around.select(F.col("node").alias("hub"), F.col("other").alias("page_id"))
    linked = _pairs_within(hubs, "hub", "page_id").join(size.withColumnRenamed("node", "hub"), "hub").groupBy("a", "b").agg(
        F.sum("w").alias("aa")
    )
    kinds = lambda name: ids.select(F.col("page_id").alias(name), F.col("page_type").alias(f"{name}_type"))
    rows = shared.join(linked, ["a", "b"], "full_outer").na.fill(0).join(kinds("a"), "a").join(kinds("b"), "b")
    label = (
        F.when((F.col("shared") > 0) & (F.col("aa") > 0), "共享来源 · 共同邻居").when(F.col("shared") > 0, "共享来源").otherwise("共同邻居")
    )
    score = F.col("shared") * 4 + F.col("aa") * 1.5 + type_affinity(F.col("a_type"), F.col("b_type"))
    return rows.select("a", "b", F.round(F.round(score, 9), 3).alias("score"), label.alias("label"))


def greedy_edges(candidates: DataFrame, cap: int = NEIGHBORS) -> DataFrame:
    """The pairs a pass over (score desc, a, b) keeps when every node takes at most `cap`.

    An open pair that is among the best `free` pairs of both its ends is kept by that pass for certain,
    so each round keeps all such pairs, lowers the free places, and drops pairs with a full end. The
    best open pair always qualifies; rounds repeat until no pair is open.
    """
    open_pairs = cut_lineage(candidates)
    kept = open_pairs.limit(0)
    while True:
        used = kept.select(F.col("a").alias("node")).union(kept.select("b")).groupBy("node").agg(F.count("*").alias("used"))
        left = open_pairs
        for end in ("a", "b"):
            left = left.join(used.select(F.col("node").alias(end), F.col("used").alias(f"{end}_used")), end, "left")
        free = lambda end: F.lit(cap) - F.coalesce(f"{end}_used", F.lit(0))
        left = left.filter((free("a") > 0) & (free("b") > 0))
        # a pair counts in the list of each of its ends, whichever side of the pair it is on
        ends = left.select(F.col("a").alias("node"), "a", "b", "score").union(left.select("b", "a", "b", "score"))
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "a", "b"))
        places = ends.withColumn("place", place).join(used, "node", "left").withColumn(
            "fits", F.col("place") <= F.lit(cap) - F.coalesce("used", F.lit(0))
        )
        sure = places.groupBy("a", "b").agg(F.bool_and("fits").alias("sure"))
        marked = cut_lineage(left.select(*candidates.columns).join(sure, ["a", "b"]))
        fresh = marked.filter("sure").drop("sure")
        if fresh.isEmpty():
            return kept
        kept = cut_lineage(kept.unionByName(fresh.select(*kept.columns)))
        open_pairs = marked.filter(~F.col("sure")).drop("sure")


def semantic_edges(nodes: DataFrame, page_sources: DataFrame, edges: DataFrame) -> DataFrame:
    """Derived edges of a view: best candidate pairs, at most six per node."""
    return greedy_edges(semantic_candidates(nodes, page_sources, edges))


def modularity(membership: DataFrame, edges: DataFrame) -> float:
    """Newman modularity of membership(node, community) on edges(a, b, weight)."""
    both = edges.select("a", "b", "weight").union(edges.select("b", "a", "weight"))
    row = (
        both.join(membership.select(F.col("node").alias("a"), F.col("community").alias("ca")).hint("shuffle_hash"), "a")
        .join(membership.select(F.col("node").alias("b"), F.col("community").alias("cb")).hint("shuffle_hash"), "b")
        .groupBy("ca")
        .agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"))
        .agg(F.sum("k").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("k2"))
        .first()
    )
    return 0.0 if not row["m2"] else row["inside"] / row["m2"] - row["k2"] / row["m2"] ** 2


def _offers(links: DataFrame, state: DataFrame, total: float) -> DataFrame:
    """(node, k, community, target, gain) of every community that a node has a link to, its own among them.

    The gain is what the node adds to modularity there (times the total weight), compared with standing alone.
    """
    where = state.select(F.col("node").alias("dst"), F.col("community").alias("target"))
    pull = links.filter(F.col("src") != F.col("dst")).join(where, "dst").groupBy(F.col("src").alias("node"), "target").agg(F.sum("weight").alias("w"))
    own = state.select("node", F.col("community").alias("target"), F.lit(0.0).alias("w"))
    pull = pull.unionByName(own).groupBy("node", "target").agg(F.sum("w").alias("w"))
    sums = state.groupBy(F.col("community").alias("target")).agg(F.sum("k").alias("mass"))
    offers = pull.join(state, "node").join(sums, "target")
    mass = F.col("mass") - F.when(F.col("target") == F.col("community"), F.col("k")).otherwise(0)
    return offers.select("node", "k", "community", "target", F.round(F.col("w") - F.col("k") * mass / (2 * total), 9).alias("gain"))


def _best_moves(links: DataFrame, state: DataFrame, total: float, mark: object = "") -> DataFrame:
    """(node, community, to, rise): the best move of each node that has one which raises modularity; standing alone is a move too.

    A node that is to stand alone gets a new community, named by `mark`, which no round before had.
    """
    offers = _offers(links, state, total)
    there = F.col("target") != F.col("community")
    best = offers.groupBy("node", "community").agg(
        F.max(F.when(~there, F.col("gain"))).alias("own"), F.max(F.when(there, F.struct("gain", "target"))).alias("best")
    )
    alone = F.coalesce(F.col("best.gain"), F.lit(0.0)) <= 0
    gain = F.when(alone, F.lit(0.0)).otherwise(F.col("best.gain"))
    target = F.when(alone, F.concat(F.lit(f"alone {mark}:"), "node")).otherwise(F.col("best.target"))
    return best.select("node", "community", target.alias("to"), F.round(gain - F.col("own"), 9).alias("rise")).filter("rise > 0")


def _moved(state: DataFrame, moves: DataFrame) -> DataFrame:
    return state.join(moves.select("node", "to"), "node", "left").select("node", "k", F.coalesce("to", "community").alias("community"))


def _settled(links: DataFrame, state: DataFrame, total: float) -> DataFrame:
    """Moves until none raises modularity. Of the moves out of or into a community only the best is made in a round, so moves of a
    round do not touch each other, each round raises modularity, and the rounds end."""
    for turn in count():
        moves = cut_lineage(_best_moves(links, state, total, f"again {turn}"))
        sides = moves.select(F.col("community").alias("c"), "node", "rise").union(moves.select("to", "node", "rise"))
        first = sides.groupBy("c").agg(F.max_by("node", F.struct("rise", "node")).alias("node"))
        chosen = moves.join(first.select(F.col("c").alias("community"), F.col("node").alias("out")), "community").join(
            first.select(F.col("c").alias("to"), F.col("node").alias("into")), "to"
        ).filter((F.col("out") == F.col("node")) & (F.col("into") == F.col("node")))
        if moves.isEmpty():
            return state
        state = cut_lineage(_moved(state, chosen))
    raise AssertionError  # the rounds end above


def _connected_parts(links: DataFrame, state: DataFrame) -> DataFrame:
    """(node, community, part): the smallest node of each part of a community that its own links hold together."""
    of = lambda key, name: state.select(F.col("node").alias(key), F.col("community").alias(name))
    inner = cut_lineage(links.filter("src <> dst").join(of("src", "x"), "src").join(of("dst", "y"), "dst").filter("x = y").select("src", "dst"))
    label = cut_lineage(state.select("node", "community", F.col("node").alias("part")))
    while True:
        near = inner.join(label.select(F.col("node").alias("dst"), "part"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("part").alias("near"))
        step = label.join(near, "node", "left").select("node", "community", F.least("part", F.coalesce("near", "part")).alias("part"), (F.col("near") < F.col("part")).alias("fell"))
        jump = step.select(F.col("node").alias("part"), F.col("part").alias("further"))
        step = cut_lineage(step.join(jump, "part").select("node", "community", F.col("further").alias("part"), "fell"))
        label = step.drop("fell")
        if step.filter("fell").isEmpty():
            return label


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 12, levels: int = 3) -> DataFrame:
    """(node, community, size): communities by local moves that raise modularity, then by merging them.

    edges(a, b, weight) without self-loops; parallel edges are summed. A round lets one half of the
    nodes (by hash) move to the neighbouring community with the largest gain, so two neighbours do not
    swap for ever; afterwards communities become the nodes of the next level. Isolated nodes stay alone.
    """
    flat = edges.filter(F.col("a") != F.col("b")).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.sum("weight").cast("double").alias("weight")
    )
    flat = cut_lineage(flat)
    total = flat.agg(F.sum("weight")).first()[0]
    placed = nodes.select(F.col("page_id").alias("node"), F.col("page_id").alias("community"))
    if not total:
        return _numbered(placed)
    # directed rows; a merged community keeps its inner weight as a loop
    links = flat.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(flat.select("b", "a", "weight"))
    for level in range(levels):
        state = cut_lineage(links.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")).withColumn("community", F.col("node")))
        moved_any = False
        for turn in range(rounds):
            # ids pack so well in files that the planner takes a table of all nodes for small and sends it through the driver, so joins are named
            where = state.select(F.col("node").alias("dst"), F.col("community").alias("target")).hint("shuffle_hash")
            pull = links.filter(F.col("src") != F.col("dst")).join(where, "dst").groupBy(F.col("src").alias("node"), "target").agg(
                F.sum("weight").alias("w")
            )
            sums = state.groupBy(F.col("community").alias("target")).agg(F.sum("k").alias("mass"))
            offers = pull.join(state.hint("shuffle_hash"), "node").join(sums.hint("shuffle_hash"), "target")
            mass = F.col("mass") - F.when(F.col("target") == F.col("community"), F.col("k")).otherwise(0)
            gain = F.col("w") - F.col("k") * mass / (2 * total)
            own = F.max(F.when(F.col("target") == F.col("community"), F.col("gain")))
            best = (
                offers.withColumn("gain", F.round(gain, 9))
                .groupBy("node")
                .agg(F.max_by("target", F.struct("gain", "target")).alias("to"), F.max("gain").alias("gain"), own.alias("own_gain"))
                .filter((F.col("gain") > F.coalesce("own_gain", F.lit(0.0))) & (F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2))
            )
            state_next = cut_lineage(
                state.join(best.select("node", "to").hint("shuffle_hash"), "node", "left").select(
                    "node", "k", F.coalesce("to", "community").alias("community"), F.col("to").isNotNull().alias("moved")
                )
            )
            moves = state_next.filter("moved").count()
            state = state_next.drop("moved")
            moved_any = moved_any or moves > 0
            if moves == 0 and turn % 2 == 1:
                break
        if not moved_any:
            break
        step = state.select(F.col("node").alias("community"), F.col("community").alias("_up")).hint("shuffle_hash")
        placed = cut_lineage(
            placed.join(step, "community", "left").select("node", F.coalesce("_up", "community").alias("community"))
        )
        up = state.select("node", "community").hint("shuffle_hash")
        links = cut_lineage(
            links.join(up.select(F.col("node").alias("src"), F.col("community").alias("s")), "src")
            .join(up.select(F.col("node").alias("dst"), F.col("community").alias("d")), "dst")
            .groupBy(F.col("s").alias("src"), F.col("d").alias("dst"))
            .agg(F.sum("weight").alias("weight"))
        )
    return _numbered(placed)


def settle(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """membership(node, community) moved on to where no single move raises modularity and every community hangs together.

    Parts of a community that its own links do not join are split, then moves are made; both raise modularity, so they end. As many rounds as
    moves follow from each other: for views whose division is to be final. The result is numbered as that of `communities`.
    """
    text = lambda c: F.col(c).cast("string")
    flat = edges.filter("a <> b").select(text("a").alias("src"), text("b").alias("dst"), F.col("weight").cast("double").alias("weight"))
    ground = cut_lineage(flat.unionByName(flat.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    strength = ground.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    total = (ground.agg(F.sum("weight")).first()[0] or 0.0) / 2
    if not total:
        return _numbered(membership.select("node", "community"))
    state = cut_lineage(membership.select(text("node").alias("node"), text("community").alias("community")).join(strength, "node"))
    while True:
        parts = _connected_parts(ground, state)
        apart = parts.groupBy("community").agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0]
        state = cut_lineage(state.drop("community").join(parts.select("node", F.col("part").alias("community")), "node"))
        after = _settled(ground, state, total)
        if after is state and apart == 1:
            break
        state = after
    linked = state.select(F.col("node").alias("_node"), F.concat(F.lit("linked:"), "community").alias("_c"))
    named = membership.select("node", text("community").alias("community")).join(linked, text("node") == F.col("_node"), "left")
    return _numbered(named.select("node", F.coalesce("_c", "community").alias("community")))


def open_moves(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community, to, rise): single moves that would still raise the modularity of membership(node, community)."""
    flat = edges.filter("a <> b").select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), F.col("weight").cast("double").alias("weight"))
    links = flat.unionByName(flat.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    strength = links.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    state = membership.select(F.col("node").cast("string").alias("node"), F.col("community").cast("string").alias("community")).join(strength, "node")
    total = flat.agg(F.sum("weight")).first()[0]
    return _best_moves(links, state.select("node", "k", "community"), total or 1.0)


def insight_counts(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: nodes, communities with more than one node, isolated nodes and bridges of a view."""
    flags = graph_insights(nodes, edges, membership)
    groups = membership.groupBy("community").count().filter("count > 1").agg(F.count("*").alias("n"))
    return flags.agg(
        F.count("*").alias("nodes"), F.coalesce(groups.scalar(), F.lit(0)).alias("communities"), F.count_if("isolated").alias("isolated"), F.count_if("bridge").alias("bridges")
    )


def _numbered(placed: DataFrame) -> DataFrame:
    """Communities counted from 1 by size, largest first, then by smallest member."""
    sizes = placed.groupBy("community").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    named = global_rank(sizes, [F.desc("size"), F.asc("first")]).withColumn("name", F.concat(F.lit("community-"), "place"))
    return placed.join(named, "community").select("node", F.col("name").alias("community"), "size")


def graph_insights(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Per node: isolated, and bridge when an edge leads into another community."""
    ends = neighbor_rows(edges)
    of = lambda key, name: membership.select(F.col("node").alias(key), F.col("community").alias(name))
    flags = (
        ends.join(of("node", "mine"), "node")
        .join(of("other", "theirs"), "other")
        .groupBy("node")
        .agg(F.bool_or(F.col("mine") != F.col("theirs")).alias("bridge"))
    )
    return nodes.select(F.col("page_id").alias("node")).join(flags, "node", "left").join(
        ends.select("node").distinct().withColumn("_linked", F.lit(True)), "node", "left"
    ).select("node", F.col("_linked").isNull().alias("isolated"), F.coalesce("bridge", F.lit(False)).alias("bridge"))
