"""Vectors of chunks made anew in batches that a broken-off run does not repeat."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.provenance import rebuild_plan
from folioscope.session import cut_lineage
from folioscope.sources.snapshots import Snapshots

BATCH = 100_000
# A swap costs several jobs and rewrites the leaves it touches, so a run makes no more of them than this.
SWAPS = 16


def finished(store: Snapshots, profile: str, failed_too: bool) -> DataFrame | None:
    """(chunk_id) of the ledger under this profile; null before the first batch."""
    if "ledger" not in store.manifest()["tables"]:
        return None
    done = store.read("ledger").filter(F.col("profile") == profile)
    return (done if failed_too else done.filter("rebuilt")).select("chunk_id")


def rebuild_vectors(
    chunks: DataFrame, profile: str, embed: Callable[[Column], Column], store: Snapshots, batch: int = BATCH, retry_failed: bool = False,
) -> int:
    """Makes the vectors that chunks of the scope lack under `profile`; returns how many chunks were asked for.

    chunks(chunk_id, embedding, embedding_text, profile, stale_at); `store` is keyed by chunk_id and gets two tables. `vectors` (chunk_id, embedding, profile)
    holds what succeeded, `ledger` (chunk_id, profile, rebuilt, seconds) every chunk that was tried, with its share of the batch's time; a null vector is a
    failure. Both change in one swap after each batch, so a run that breaks off has either all of a batch or nothing, and the next run goes
    on behind it. Batches are parts of the hash space, as the leaves of the store are, so that a batch writes its own leaves. A batch is about
    `batch` chunks, or a SWAPS-th of the run if that is more, so the swaps of a run do not grow with it.
    """
    todo = rebuild_plan(chunks, profile).select("chunk_id", "embedding_text")
    done = finished(store, profile, not retry_failed)
    if done is not None:
        todo = todo.join(done, "chunk_id", "left_anti")
    todo = cut_lineage(todo)
    total = todo.count()
    parts = 1
    while parts * batch < total and parts < SWAPS:
        parts *= 2
    for part in range(parts):
        start = time.monotonic()
        mine = todo.filter(F.xxhash64("chunk_id").bitwiseAND(F.lit(parts - 1)) == part)
        made = cut_lineage(mine.select("chunk_id", embed(F.col("embedding_text")).alias("embedding"), F.lit(profile).alias("profile")))
        n = made.count()
        if n == 0:
            continue
        seconds = (time.monotonic() - start) / n
        tried = made.select("chunk_id", "profile", F.col("embedding").isNotNull().alias("rebuilt"), F.lit(seconds).alias("seconds"))
        store.replace({"vectors": made.filter("embedding is not null"), "ledger": tried})
    return total


def rebuild_counts(store: Snapshots, profile: str) -> DataFrame:
    """One row: chunks tried, rebuilt and failed under a profile, and the time they took."""
    rows = store.read("ledger").filter(F.col("profile") == profile)
    return rows.agg(F.count("*").alias("tried"), F.count_if("rebuilt").alias("rebuilt"), F.count_if(~F.col("rebuilt")).alias("failed"), F.sum("seconds").alias("seconds"))
