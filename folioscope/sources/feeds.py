"""Log lines and events as they arrive, and tables kept up to date by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.provenance import replace_by_key
from folioscope.sources.snapshots import Snapshots

# Shape of a structured log line, and the routes a page view may carry.
LOG_SCHEMA = (
    "struct<time:string,level:int,service:string,env:string,context:string,requestId:string,workspaceId:string,userId:string,"
    "msg:string,req:struct<method:string,url:string>,res:struct<statusCode:int>,responseTime:double,"
    "err:struct<type:string,message:string,stack:string,statusCode:int>,pid:int,hostname:string>"
)


def flatten_logs(lines: DataFrame) -> DataFrame:
    """One flat row per JSON line (column value); missing texts are blank, missing numbers null."""
    o = lambda path: F.col(f"o.{path}")
    text = lambda path, name: F.coalesce(o(path), F.lit("")).alias(name)
    rows = lines.select("value", F.from_json("value", LOG_SCHEMA).alias("o"))
    return rows.select(
        o("time").alias("time"), o("level").alias("level"), o("service").alias("service"), o("env").alias("env"),
        text("context", "context"), text("requestId", "request_id"), text("workspaceId", "workspace_id"), text("userId", "user_id"), text("msg", "msg"),
        text("req.method", "req_method"), text("req.url", "req_url"), o("res.statusCode").alias("res_status"), o("responseTime").alias("res_time_ms"),
        text("err.type", "err_type"), text("err.message", "err_message"), text("err.stack", "err_stack"), o("err.statusCode").alias("err_status"),
        o("pid").alias("pid"), o("hostname").alias("hostname"), F.col("value").alias("raw"),
    )


def split_logs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat rows of the JSON lines that carry a time, and the lines (value) that do not or that no JSON is; works on streams too."""
    flat = flatten_logs(lines)
    good = F.col("time").try_cast("timestamp").isNotNull()
    return flat.filter(good), flat.filter(~good).select(F.col("raw").alias("value"))


def read_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return flatten_logs(reader.format("text").load(path))


def prepare_events(events: DataFrame, routes: list[str]) -> DataFrame:
    """Events as stored: unknown routes of page views become `other`, operations are cut to 64 characters."""
    known = F.when(F.col("route").isin(routes), F.col("route")).otherwise("other")
    route = F.when(F.col("event") == "page_view", known).when(F.col("event") == "agent_op", F.substring("route", 1, 64))
    return events.withColumn("route", route).withColumn("day", F.to_date("ts"))


def append_events(events: DataFrame, routes: list[str], path: str, checkpoint: str | None = None):
    """Appends to a table partitioned by day; a streaming frame starts a query and returns it."""
    rows = prepare_events(events, routes)
    if rows.isStreaming:
        writer = rows.writeStream.partitionBy("day").format("parquet").option("path", path)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return rows.write.mode("append").partitionBy("day").parquet(path)


def export_sources(pages: DataFrame, space_id, after_id=None, limit: int = 200) -> DataFrame:
    """Live pages of a space by ascending id, from after_id on."""
    rows = pages.filter(F.col("deleted_at").isNull() & (F.col("space_id") == F.lit(space_id)))
    if after_id is not None:
        rows = rows.filter(F.col("page_id") > F.lit(after_id))
    return rows.orderBy("page_id").limit(limit)


def replace_in_table(new: DataFrame, touched: DataFrame, key: str, path: str) -> int:
    """Replaces all rows of the touched keys in the table under `path`; see snapshots.py. Read it with `read_table`."""
    return Snapshots(new.sparkSession, path, key).replace({"rows": new}, touched)


def read_table(spark: SparkSession, path: str, key: str, name: str = "rows") -> DataFrame:
    return Snapshots(spark, path, key).read(name)


def publish_chunks(artifacts: DataFrame, tables: dict[str, DataFrame], path: str) -> int:
    """Publishes artifacts with their child tables (sources, sections, chunks, links, ..), all in one swap.

    Every table carries artifact_id. All rows of the published artifacts are replaced, in the child
    tables too when they have no new row; publishing twice gives the same tables.
    """
    return Snapshots(artifacts.sparkSession, path, "artifact_id").replace({"pages": artifacts, **tables}, artifacts.select("artifact_id"))


__all__ = ["append_events", "export_sources", "flatten_logs", "prepare_events", "publish_chunks", "read_logs", "read_table", "replace_by_key", "replace_in_table", "split_logs"]
