"""Where a pattern matches in a text, with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 64
SPAN = "array<struct<kind:string,start:int,stop:int,hit:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sum(values: Column) -> Column:
    """Sums of an array up to each place; sums of STEP values are added up first, so long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def body(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(STEP)), lambda k: total(F.slice(v, k, F.lit(STEP))))
        return let(blocks, lambda b: let(
            F.transform(b, lambda x, k: total(F.slice(b, F.lit(1), k))),
            lambda before: F.transform(v, lambda x, i: F.get(before, F.floor(i / STEP).cast("int")) + total(F.slice(v, i - i % STEP + 1, i % STEP + 1))),
        ))

    return let(values, body)


def find_spans(text: Column, kind: str, pattern: str, around: int = 0) -> Column:
    """Leftmost matches that do not overlap, as (kind, start, stop, hit) in code points, the end exclusive.

    The pieces between matches give the places, as long as no match is empty. With `around`, fields before and behind hold
    so many characters of the pieces on both sides.
    """
    rule = F.lit(pattern)

    def placed(hits: Column, gaps: Column) -> Column:
        steps = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(F.lit(0)))
        hit = lambda i: F.coalesce(F.when((i >= 0) & (i < F.size(hits)), F.get(hits, i)), F.lit(""))
        before = lambda i: F.right(F.concat(hit(i - 1), F.get(gaps, i)), F.lit(around))
        behind = lambda i: F.left(F.concat(F.get(gaps, i + 1), hit(i + 1)), F.lit(around))
        beside = lambda i: [before(i).alias("before"), behind(i).alias("behind")]
        return let(running_sum(steps), lambda s: F.transform(hits, lambda h, i: F.struct(
            F.lit(kind).alias("kind"), F.get(s, i).alias("start"), (F.get(s, i) + F.length(h)).alias("stop"), h.alias("hit"), *(beside(i) if around else []),
        )))

    none = F.array().cast(SPAN.replace("hit:string", "hit:string,before:string,behind:string") if around else SPAN)
    return let(
        F.regexp_extract_all(text, rule, F.lit(0)),
        lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(hits, gaps))).otherwise(none),
    )


def in_order(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by kind as listed."""
    rank = F.array(*map(F.lit, kinds))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["hit"].alias("hit")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["hit"].alias("hit")))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
