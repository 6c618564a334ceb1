"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import saved


def _mark(edges: DataFrame) -> tuple:
    """What tells one set of edges from another."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node of its component.

    Large stars and small stars in turn (Kiveris et al. 2014): every node's larger neighbours move to its smallest one,
    then its smaller ones do. The number of rounds grows with the logarithm of the number of nodes. A round is written as a
    table. A node with very many neighbours is a hot key of a join against one row a key, which Spark splits.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = saved(edges)
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").select(F.inline(F.array(F.struct("a", F.col("root").alias("b")), F.struct(F.col("b").alias("a"), F.col("root").alias("b")))))
        edges = saved(small.filter("a <> b").distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    nodes = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))))
    return nodes.distinct()
