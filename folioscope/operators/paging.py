"""Keyset and offset pages, totals, latest rows and bounded picks per key."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.session import cut_lineage


def encode_cursor(values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, default=str).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> list:
    return json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))


def _after(fields: list[tuple[str, str]], values: list) -> Column:
    """Rows that come strictly after `values` in a lexicographic order with mixed directions."""
    later = F.lit(False)
    for (name, direction), value in reversed(list(zip(fields, values))):
        here = F.col(name)
        beyond = here < F.lit(value) if direction == "desc" else here > F.lit(value)
        later = beyond | ((here == F.lit(value)) & later)
    return later


def _ordered(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*[F.desc(n) if d == "desc" else F.asc(n) for n, d in fields])


def keyset_page(
    df: DataFrame, fields: list[tuple[str, str]], per_page: int, after: str | None = None, before: str | None = None
) -> DataFrame:
    """One page plus one row, so the caller sees whether more follow.

    The cursor becomes a plain range filter that reaches the scan, and the limit a distributed top-k.
    With `before` the order is turned round for the read and restored afterwards.
    """
    if before is not None:
        flipped = [(n, "asc" if d == "desc" else "desc") for n, d in fields]
        page = _ordered(df.filter(_after(flipped, decode_cursor(before))), flipped).limit(per_page + 1)
        return _ordered(page, fields)
    rows = df.filter(_after(fields, decode_cursor(after))) if after else df
    return _ordered(rows, fields).limit(per_page + 1)


def page_cursor(row, fields: list[tuple[str, str]]) -> str:
    return encode_cursor([row[name] for name, _ in fields])


def offset_page(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """One page of `limit` rows, pages counted from 1."""
    if page < 1 or limit < 1:
        raise ValueError(f"no page {page} of {limit} rows")
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def with_total(page: DataFrame, rows: DataFrame) -> DataFrame:
    """The total of `rows` on each row of a page: a separate count, not a window over everything."""
    return page.withColumn("total", rows.agg(F.count("*")).scalar())


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Newest row per key as an aggregate, so a hot key is reduced before the shuffle."""
    newest = F.max_by(F.struct(*keep), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    oldest = F.min_by(F.struct(*keep), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(oldest).select(*keys, "_row.*")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """At most k rows per key; Spark limits each group before the shuffle as well as after it."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def beyond_per_key(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The rows a trim to the k newest per key would delete."""
    window = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") > k).drop("_n")


def occurrence(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def global_rank(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Row numbers over the whole frame without one task that sees all rows.

    The range-partitioned sort numbers the rows of each partition; the partitions are then counted, and a
    prefix sum over these counts (one row per partition) shifts the numbers. The sorted rows are written
    once, so both readings see the same partitions.
    """
    numbered = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    rows = numbered.withColumns({"_part": part, "_in": inside})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    return rows.join(shift, "_part").withColumn(name, F.col("_shift") + F.col("_in") + 1).drop("_part", "_in", "_shift", "_id")


def previous_row(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each row with the columns of the row just before it under the same key."""
    window = Window.partitionBy(key).orderBy(*order)
    return df.select("*", *[F.lag(c).over(window).alias(f"previous_{c}") for c in columns])


def priority_first(value: Column, preferred) -> Column:
    return F.when(value == F.lit(preferred), 0).otherwise(1)


def manual_order(key: Column, listed: list) -> list[Column]:
    """Listed keys in the given order, then the rest."""
    spot = F.array_position(F.array(*[F.lit(v) for v in listed]), key) if listed else F.lit(0)
    return [F.when(spot > 0, spot).asc_nulls_last()]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
