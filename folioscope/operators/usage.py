"""Attribution of agent operations to users, keys and agents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.clock import ZONE, in_range, local_time
from folioscope.operators.activity import bucket

NONE_GROUP = "__none__"
GROUPS = {
    "user": ("attributed_user_id", "attributed_user_name", "attributed_user_email"),
    "key": ("key_id", "key_name", None),
    "agent": ("actor_id", "actor_name", "actor_email"),
}
SEARCHED = [
    "actor_id", "actor_name", "actor_email", "attributed_user_id", "attributed_user_name",
    "attributed_user_email", "key_id", "key_name", "creator_name", "creator_email",
]


def attribute_ops(events: DataFrame, users: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per operation with the person and the key behind it.

    events(event_id, ts, user_id, op, metadata), users(id, name, email, user_type), keys(id, name,
    key_type, creator_id, deleted_at, expires_at). Ids inside the metadata are joined as text, so a
    missing or malformed id gives nulls and never an error.
    """
    field = lambda name: F.get_json_object("metadata", f"$.{name}")
    base = events.select(
        "event_id", "ts", "op",
        F.col("user_id").cast("string").alias("actor_id"),
        field("apiKeyId").alias("key_id"),
        field("delegatedUserId").alias("delegated_id"),
        field("keyType").alias("named_key_type"),
        field("channel").alias("channel"),
        F.coalesce(field("outcome"), F.lit("called")).alias("outcome"),
    )
    person = lambda key, prefix: users.select(
        F.col("id").cast("string").alias(key), F.col("name").alias(f"{prefix}_name"), F.col("email").alias(f"{prefix}_email")
    )
    # the creator belongs to the key, so resolve it on the small side, before the events are touched
    key_rows = keys.select(
        F.col("id").cast("string").alias("key_id"),
        F.col("name").alias("key_name"),
        F.col("key_type").alias("stored_key_type"),
        F.col("creator_id").cast("string").alias("creator_id"),
        F.col("deleted_at").alias("key_deleted_at"),
        F.col("expires_at").alias("key_expires_at"),
    ).join(person("creator_id", "creator"), "creator_id", "left").drop("creator_id")
    actors = person("actor_id", "actor").join(
        users.select(F.col("id").cast("string").alias("actor_id"), F.col("user_type").alias("actor_type")), "actor_id"
    )
    joined = (
        base.join(actors, "actor_id", "left")
        .join(key_rows, "key_id", "left")
        .join(person("delegated_id", "delegated"), "delegated_id", "left")
    )
    human = F.col("actor_type") != "agent"
    key_type = F.coalesce(
        "named_key_type", "stored_key_type", F.when(F.col("actor_type") == "agent", "agent").otherwise("unknown")
    )
    return joined.select(
        "event_id", "ts", "op", "actor_id", "actor_name", "actor_email",
        F.coalesce("delegated_id", F.when(human, F.col("actor_id"))).alias("attributed_user_id"),
        F.coalesce("delegated_name", F.when(human, F.col("actor_name"))).alias("attributed_user_name"),
        F.coalesce("delegated_email", F.when(human, F.col("actor_email"))).alias("attributed_user_email"),
        "key_id", "key_name", "key_deleted_at", "key_expires_at", "creator_name", "creator_email",
        key_type.alias("key_type"), "channel", "outcome",
        ((F.col("actor_type") == "agent") | (key_type == "agent")).alias("is_agent"),
    )


def usage_base(ops: DataFrame, group_by: str = "user", search: str | None = None, **equal: str) -> DataFrame:
    """Grouped and filtered operations; `equal` may name key_type, channel, outcome, op, group_id."""
    key, name, email = GROUPS[group_by]
    out = ops.filter("is_agent") if group_by == "agent" else ops
    out = out.withColumns(
        {
            "group_id": F.coalesce(F.col(key), F.lit(NONE_GROUP)),
            "group_name": F.col(name),
            "group_email": F.col(email) if email else F.lit(None).cast("string"),
        }
    )
    if search and search.strip():
        text = F.lower(F.concat_ws(" ", *SEARCHED))
        out = out.filter(F.contains(text, F.lit(search.strip().lower())))
    for column, value in equal.items():
        out = out.filter(F.col(column) == value)
    return out


def usage_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("ops"),
        F.count_if(F.col("channel") == "api").alias("api"),
        F.count_if(F.col("channel") == "mcp").alias("mcp"),
        F.count_if(F.col("outcome") == "error").alias("failed_ops"),
        F.count_if(F.col("outcome") == "called").alias("unknown_ops"),
        F.countDistinct(F.when(F.col("is_agent"), F.col("actor_id"))).alias("active_agents"),
        F.countDistinct("attributed_user_id").alias("active_users"),
        F.countDistinct("key_id").alias("active_keys"),
        F.countDistinct("group_id").alias("total"),
    )


def usage_groups(rows: DataFrame, now: datetime) -> DataFrame:
    """One row per group. A group may own a third of the rows, so rows are first reduced to the distinct values of
    each kind in a group, by plain sums; lists are made of these alone."""
    group = ["group_id", "group_name", "group_email"]
    kinds = {
        "key_type": F.col("key_type"), "actor": F.coalesce("actor_name", "actor_email", "actor_id"),
        "creator": F.coalesce("creator_name", "creator_email"), "key": F.col("key_id"),
    }
    named = [F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in kinds.items()]
    told = rows.select(
        *group, "channel", "outcome", "ts", F.col("key_deleted_at").isNotNull().alias("revoked"),
        (F.col("key_expires_at") <= F.lit(now).cast("timestamp_ntz")).alias("expired"), F.inline(F.array(*named)),
    )
    once = F.col("kind") == "key_type"  # each row has one
    counted = {
        "ops": once, "api": once & (F.col("channel") == "api"), "mcp": once & (F.col("channel") == "mcp"),
        "failed_ops": once & (F.col("outcome") == "error"), "unknown_ops": once & (F.col("outcome") == "called"),
    }
    values = told.groupBy(*group, "kind", "value").agg(
        *[F.count_if(cond).alias(name) for name, cond in counted.items()],
        F.max("ts").alias("last_op_at"), F.bool_or("revoked").alias("revoked"), F.bool_or("expired").alias("expired"),
    )
    words = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("value")))), ", ")
    return values.groupBy(*group).agg(
        words("key_type").alias("key_types"),
        words("actor").alias("actors"),
        words("creator").alias("creators"),
        F.when(F.bool_or("revoked"), "revoked").when(F.bool_or("expired"), "expired").otherwise("active").alias("status"),
        *[F.sum(name).alias(name) for name in counted],
        F.count(F.when(F.col("kind") == "key", F.col("value"))).alias("key_count"),
        F.max("last_op_at").alias("last_op_at"),
    )


def usage_buckets(rows: DataFrame, start: datetime, end: datetime, zone: str = ZONE) -> DataFrame:
    """Hourly counts for a range of a day at most, else daily; zero-filled in local time."""
    hourly = (end - start).total_seconds() <= 86400
    unit, step, shown = ("hour", "1 hour", "yyyy-MM-dd HH:00") if hourly else ("day", "1 day", "yyyy-MM-dd")
    moment = lambda at: local_time(F.lit(at).cast("timestamp_ntz"), zone)
    spine = rows.sparkSession.range(1).select(
        F.explode(F.sequence(moment(start), moment(end) - F.expr("interval 1 second"), F.expr(f"interval {step}"))).alias("bucket")
    )
    counts = rows.filter(in_range(F.col("ts"), start, end)).groupBy(bucket(F.col("ts"), unit, zone).alias("bucket")).agg(
        F.count_if(F.col("channel") == "api").alias("api"), F.count_if(F.col("channel") == "mcp").alias("mcp")
    )
    return (
        spine.join(counts, "bucket", "left")
        .na.fill(0)
        .select(F.date_format("bucket", shown).alias("date"), "api", "mcp")
    )


def usage_events(rows: DataFrame, page: int, limit: int) -> DataFrame:
    """Newest operations first."""
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).offset((page - 1) * limit).limit(limit)
