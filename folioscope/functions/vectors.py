"""Vector functions: cosine on arrays, and exact nearest chunks, block of queries by span of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Queries and chunks that meet in one task, and cells of a matrix product in it.
QUERY_BLOCK, CHUNK_SPAN, CELLS = 2048, 1 << 16, 1 << 22


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null when sizes differ, 0 when either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def clamped_similarity(a: Column, b: Column) -> Column:
    similarity = cosine_similarity(a, b)
    return F.when(similarity.isNotNull(), F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0)))


def _nearest(queries: np.ndarray, chunks: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, chunk, distance) of the k nearest chunks of each query, the first ones of those equally near.

    One matrix product for as many queries as fill CELLS cells, so that the product does not grow with the block.
    """
    lengths, width = np.linalg.norm(chunks, axis=1), min(k, len(chunks))
    step = max(1, CELLS // len(chunks))
    for start in range(0, len(queries), step):
        some = queries[start : start + step]
        scale = np.outer(np.linalg.norm(some, axis=1), lengths)
        similarity = np.divide(some @ chunks.T, scale, out=np.zeros_like(scale), where=scale > 0)
        edge = np.partition(similarity, len(chunks) - width, axis=1)[:, len(chunks) - width]
        near = similarity >= edge[:, None]
        for row in np.flatnonzero(near.sum(axis=1) > width):
            tied = np.flatnonzero(similarity[row] == edge[row])
            near[row, tied[width - np.count_nonzero(similarity[row] > edge[row]) :]] = False
        q, c = np.nonzero(near)
        yield q + start, c, 1.0 - similarity[q, c]


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int, block: int = QUERY_BLOCK, span: int = CHUNK_SPAN) -> DataFrame:
    """Exact k nearest chunks per query by cosine distance.

    queries(query_id, query_vec) are hashed into blocks and chunks(chunk_id, chunk_vec) into spans; each block meets each
    span in one task, by matrix products of a bounded size, and only the k best of a task go on. So the plan is the same for ten queries and for
    ten million, a task holds a block and a span, and nothing passes through the driver but the two counts. Rows without a vector,
    and chunks of another length than the query's, have no distance.
    """
    asked, held = queries.filter(F.col("query_vec").isNotNull()), chunks.filter(F.col("chunk_vec").isNotNull())
    blocks, spans = (max(1, -(-df.count() // size)) for df, size in ((asked, block), (held, span)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("query_id", "query_vec", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("span", every(spans))
    right = held.select("chunk_id", "chunk_vec", F.pmod(F.xxhash64("chunk_id"), F.lit(spans)).cast("int").alias("span")).withColumn("block", every(blocks))

    def best(these: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": these["query_id"][:0], "chunk_id": those["chunk_id"][:0], "distance": np.empty(0)})]
        those = those.sort_values("chunk_id")  # of equally near chunks the smallest id is taken
        lengths = those["chunk_vec"].map(len)
        for size, part in these.groupby(these["query_vec"].map(len)):
            same = those[lengths == size]
            if size and len(same):
                vectors = (np.stack(v.to_numpy()).astype(np.float64) for v in (part["query_vec"], same["chunk_vec"]))
                q, c, distance = (np.concatenate(x) for x in zip(*_nearest(*vectors, k)))
                hits = pd.DataFrame({"query_id": part["query_id"].to_numpy()[q], "chunk_id": same["chunk_id"].to_numpy()[c], "distance": distance})
                found.append(hits.sort_values(["query_id", "distance", "chunk_id"]).groupby("query_id").head(k))
        return pd.concat(found[1:] or found)

    types = (asked.schema["query_id"].dataType.simpleString(), held.schema["chunk_id"].dataType.simpleString())
    found = left.groupBy("block", "span").cogroup(right.groupBy("block", "span")).applyInPandas(best, "query_id {}, chunk_id {}, distance double".format(*types))
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
