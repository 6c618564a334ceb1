"""Rebuilding vectors: a run that breaks off goes on without asking again."""

import pytest
from pyspark.sql import functions as F

from folioscope.sources import vectors
from folioscope.sources.snapshots import Snapshots
from folioscope.sources.vectors import rebuild_counts, rebuild_vectors


def test_a_broken_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    chunks = spark.range(40).select(
        F.col("id").alias("chunk_id"), F.lit(None).cast("array<double>").alias("embedding"), F.concat(F.lit("t"), "id").alias("embedding_text"),
        F.lit("old").alias("profile"), F.when(F.col("id") >= 36, "1999").alias("stale_at"),
    )
    store = Snapshots(spark, str(tmp_path / "v"), "chunk_id", leaf_rows=8)
    asked = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(text):
        asked.add(1)
        return None if text == "t5" else [float(len(text))]

    real, swaps = Snapshots._swap, []

    def third_fails(self, manifest):
        swaps.append(1)
        if len(swaps) == 3:
            raise OSError("lost")
        real(self, manifest)

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_swap", third_fails)
        with pytest.raises(OSError):
            rebuild_vectors(chunks, "new", embed, store, 10)
    done = store.read("ledger").count()
    assert 0 < done < 36
    before = asked.value
    assert rebuild_vectors(chunks, "new", embed, store, 10) == 36 - done
    assert asked.value - before == 36 - done  # finished chunks are not asked again
    counts = rebuild_counts(store, "new").first()
    assert (counts["tried"], counts["rebuilt"], counts["failed"]) == (36, 35, 1) and counts["seconds"] > 0
    assert store.read("vectors").count() == 35
    assert rebuild_vectors(chunks, "new", embed, store, 10) == 0
    assert rebuild_vectors(chunks, "new", embed, store, 10, retry_failed=True) == 1


def test_the_swaps_of_a_run_do_not_grow_with_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "SWAPS", 2, raising=False)
    chunks = spark.range(60).select(
        F.col("id").alias("chunk_id"), F.lit(None).cast("array<double>").alias("embedding"), F.col("id").alias("embedding_text"),
        F.lit("old").alias("profile"), F.lit(None).cast("string").alias("stale_at"),
    )
    store = Snapshots(spark, str(tmp_path / "v"), "chunk_id", leaf_rows=100)
    assert rebuild_vectors(chunks, "new", lambda c: F.array(c.cast("double")), store, 10) == 60
    assert len(store.versions()) == 2
    assert {(r["chunk_id"], r["embedding"][0]) for r in store.read("vectors").collect()} == {(i, float(i)) for i in range(60)}
