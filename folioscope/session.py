"""Session defaults and the lineage-cutting helper shared by the iterative operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

# With Spark 4.1 a union that keeps the partitioning of its inputs can be combined with a reused exchange
# into a join that loses and repeats rows, so the union must not claim a partitioning.
# Times without a zone are UTC, so the session has to read them as UTC.
# Narrow rows compress well, so the usual 64 MB of shuffled data are gigabytes in the maps and sorts of one task.
# A batch of texts and what Python makes of it lie in a worker at once, several times its size, so batches are small in bytes.
GUARDS = {
    "spark.sql.unionOutputPartitioning": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2MB",
}


def apply_guards(spark: SparkSession) -> None:
    for key, value in GUARDS.items():
        spark.conf.set(key, value)
    # parts enough to stay at that size; small ones are put together when their sizes are known
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))


def build_session(master: str | None = None, app: str = "folioscope", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **GUARDS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    """Deletes the tables of this process's sessions; those of a session that has ended already stay."""
    for spark, path in _written:
        with contextlib.suppress(Exception):
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


atexit.register(_remove_written)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A local session that names none gets a temporary one; on a cluster,
    where machines do not see each other's folders, that is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of `df` read back from a table written to the shared folder.

    Iterative operators call this once per round. A lost executor re-reads a file instead of replaying
    the rounds before, and the planner sees real sizes: a checkpointed frame would keep the estimates
    of its plan, which multiply from join to join and from round to round. The tables are deleted when the process ends.
    """
    path = scratch_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
