"""Event analytics: series per local day, rolling distinct users, stocks, rankings."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.clock import ZONE, in_range, local_day, local_time
from folioscope.functions.frames import literal_rows

# Routes a page view may carry, and the categories of agent operations.
OP_CATEGORIES = ["query", "search", "read", "write", "delete", "other"]
API_OPS = {
    "knowledge.query": "query",
    "space.read": "read",
    "page.read": "read",
    "page.tree.read": "read",
    "page.create": "write",
    "page.content.update": "write",
}
TOOL_OPS = {"query_knowledge": "query", "get_citation_page": "query"}
TOOL_VERBS = [
    ("search_", "search"),
    ("get_", "read"),
    ("list_", "read"),
    ("download_", "read"),
    ("delete_", "delete"),
    ("create_", "write"),
    ("update_", "write"),
    ("move_", "write"),
    ("copy_", "write"),
    ("duplicate_", "write"),
    ("restore_", "write"),
    ("upload_", "write"),
]


def live(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(column).isNull())


def active(df: DataFrame) -> DataFrame:
    return live(df, "stale_at")


def local_bounds(start: datetime, end: datetime, zone: str = ZONE) -> tuple[date, date]:
    """First and last local day of a UTC range that is aligned to local days."""
    from zoneinfo import ZoneInfo

    def shift(moment: datetime) -> date:
        return moment.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).date()

    return shift(start), shift(end) - timedelta(days=1)


def day_spine(spark: SparkSession, first: date, last: date) -> DataFrame:
    days = F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("day"))


def running_total(deltas: DataFrame, spine: DataFrame, columns: list[str]) -> DataFrame:
    """Prefix sums of per-day deltas, read off on the spine days.

    The input holds one row per day at most, so the single ordered partition is as small as the
    calendar, whatever the size of the tables behind it.
    """
    order = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blank = spine.select("day", *[F.lit(0).cast("long").alias(c) for c in columns], F.lit(True).alias("shown"))
    return (
        deltas.select("day", *columns, F.lit(False).alias("shown"))
        .unionByName(blank)
        .groupBy("day")
        .agg(*[F.sum(c).alias(c) for c in columns], F.bool_or("shown").alias("shown"))
        .select("day", "shown", *[F.sum(c).over(order).alias(c) for c in columns])
        .filter("shown")
        .drop("shown")
    )


def _per_user_day(events: DataFrame, zone: str) -> DataFrame:
    return events.groupBy("user_id", local_day(F.col("ts"), zone).alias("day")).agg(F.count("*").alias("hits"))


def daily_pv_uv(events: DataFrame, zone: str = ZONE) -> DataFrame:
    """Views and distinct users per local day, from counts per user and day."""
    return (
        _per_user_day(events, zone)
        .groupBy("day")
        .agg(F.sum("hits").alias("pv"), F.count("user_id").alias("uv"))
    )


def rolling_active(
    events: DataFrame, start: datetime, end: datetime, windows: dict[str, int], zone: str = ZONE
) -> DataFrame:
    """Distinct users of the trailing n local days, for every day of [start, end).

    A user who was seen on day d stays counted until the earlier of the next day seen and d + n. Those
    stretches never overlap, so the distinct count is a running sum of +1/-1 per day: no copy of an
    event for each of the n days, and no distinct over the trailing window. Rows per user are bounded
    by the days read.
    """
    first, last = local_bounds(start, end, zone)
    widest = max(windows.values())
    read = events.filter(in_range(F.col("ts"), start - timedelta(days=widest - 1), end))
    days = (
        _per_user_day(read, zone)
        .filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list("day")).alias("days"))
    )
    step = days.select(F.posexplode("days").alias("pos", "day"), F.col("days"))
    step = step.select("day", F.try_element_at("days", F.col("pos") + 2).alias("next_day"))
    changes: list[Column] = []
    for name, size in windows.items():
        stop = F.least(F.date_add("day", size), F.coalesce("next_day", F.date_add("day", size)))
        for at, sign in ((F.col("day"), 1), (stop, -1)):
            changes.append(
                F.struct(
                    at.alias("day"),
                    *[F.lit(sign if other == name else 0).cast("long").alias(other) for other in windows],
                )
            )
    deltas = (
        step.select(F.inline(F.array(*changes)))
        .filter(F.col("day") <= F.lit(last))
        .groupBy("day")
        .agg(*[F.sum(name).alias(name) for name in windows])
    )
    return running_total(deltas, day_spine(events.sparkSession, first, last), list(windows))


def per_day(rows: DataFrame, name: str, ts: str = "ts", zone: str = ZONE) -> DataFrame:
    return rows.groupBy(local_day(F.col(ts), zone).alias("day")).agg(F.count("*").alias(name))


def daily_series(
    views: DataFrame, new_pages: DataFrame, edits: DataFrame, start: datetime, end: datetime, zone: str = ZONE
) -> DataFrame:
    """Zero-filled pv, uv, wau, mau, new_pages and edits of every local day in [start, end)."""
    first, last = local_bounds(start, end, zone)
    spine = day_spine(views.sparkSession, first, last)
    within = in_range(F.col("ts"), start, end)
    counts = reduce(
        lambda left, right: left.join(right, "day", "left"),
        [
            per_day(views.filter(within), "pv", zone=zone),
            rolling_active(views, start, end, {"uv": 1, "wau": 7, "mau": 30}, zone),
            per_day(new_pages.filter(within), "new_pages", zone=zone),
            per_day(edits.filter(within), "edits", zone=zone),
        ],
        spine,
    )
    return counts.na.fill(0)


def daily_stock(
    users: DataFrame, spaces: DataFrame, deleted_spaces: DataFrame, first: date, last: date, zone: str = ZONE
) -> DataFrame:
    """Users and spaces in being at the end of each local day.

    users(created_at, deleted_at, deactivated_at), spaces(created_at), deleted_spaces(created_at,
    metadata): a deleted space is known only by its event, whose metadata hold the creation time.
    A row counts on the days from its creation up to the day before it ends.
    """
    day = lambda c: local_day(F.col(c), zone)
    born_text = F.get_json_object("metadata", "$.spaceCreatedAt")
    stretches = (
        users.select(
            F.lit("user_count").alias("kind"),
            day("created_at").alias("born"),
            F.least(day("deleted_at"), day("deactivated_at")).alias("gone"),
        )
        .unionByName(
            spaces.select(
                F.lit("space_count").alias("kind"), day("created_at").alias("born"), F.lit(None).cast("date").alias("gone")
            )
        )
        .unionByName(
            deleted_spaces.select(
                F.lit("space_count").alias("kind"),
                local_day(F.expr("try_cast(get_json_object(metadata, '$.spaceCreatedAt') as timestamp_ntz)"), zone).alias("born"),
                day("created_at").alias("gone"),
            ).filter(F.col("born").isNotNull())
        )
        .filter(F.col("gone").isNull() | (F.col("gone") > F.col("born")))
    )
    moves = F.array(
        F.struct(F.greatest("born", F.lit(first)).alias("day"), F.lit(1).alias("change")),
        F.struct(F.greatest("gone", F.lit(first)).alias("day"), F.when(F.col("gone").isNotNull(), -1).otherwise(0).alias("change")),
    )
    names = ["user_count", "space_count"]
    deltas = (
        stretches.select("kind", F.inline(moves))
        .filter((F.col("day") <= F.lit(last)) & (F.col("change") != 0))
        .groupBy("day")
        .agg(*[F.sum(F.when(F.col("kind") == n, F.col("change")).otherwise(0)).cast("long").alias(n) for n in names])
    )
    return running_total(deltas, day_spine(users.sparkSession, first, last), names)


def summarize_activity(daily: DataFrame) -> DataFrame:
    """Headline numbers: mean DAU, WAU and MAU of the last day, mean DAU/MAU over days with MAU."""
    ratio = F.when(F.col("mau") > 0, F.col("uv") / F.col("mau"))
    return daily.agg(
        F.coalesce(F.round(F.avg("uv")), F.lit(0.0)).cast("long").alias("avg_dau"),
        F.coalesce(F.max_by("wau", "day"), F.lit(0)).alias("wau"),
        F.coalesce(F.max_by("mau", "day"), F.lit(0)).alias("mau"),
        F.coalesce(F.round(F.avg(ratio), 3), F.lit(0.0)).alias("stickiness"),
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """Puts one-row frames side by side without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def summarize(
    views: DataFrame,
    pages: DataFrame,
    edits: DataFrame,
    comments: DataFrame,
    start: datetime,
    end: datetime,
    users: DataFrame | None = None,
    spaces: DataFrame | None = None,
    questions: DataFrame | None = None,
) -> DataFrame:
    """Totals of a range. users, spaces and questions exist for a whole workspace only."""
    within = in_range(F.col("ts"), start, end)
    parts = [
        views.filter(within).agg(F.count("*").alias("pv"), F.countDistinct("user_id").alias("uv")),
        pages.agg(F.count("*").alias("total_pages"), F.count_if(within).alias("new_pages")),
        edits.filter(within).agg(F.count("*").alias("edits")),
        comments.filter(within).agg(F.count("*").alias("comments")),
    ]
    if users is not None:
        parts.append(users.agg(F.count("*").alias("users")))
    if spaces is not None:
        parts.append(spaces.agg(F.count("*").alias("spaces")))
    if questions is not None:
        parts.append(
            questions.filter(within).agg(F.count("*").alias("questions"), F.countDistinct("user_id").alias("askers"))
        )
    return one_row(*parts)


def top_by_views(events: DataFrame, key: str, k: int) -> DataFrame:
    """Most viewed keys with distinct users; counts per (key, user) first, so a hot key is spread."""
    return (
        events.groupBy(key, "user_id")
        .agg(F.count("*").alias("hits"))
        .groupBy(key)
        .agg(F.sum("hits").alias("pv"), F.count("user_id").alias("uv"))
        .orderBy(F.desc("pv"), key)
        .limit(k)
    )


def top_pages(events: DataFrame, pages: DataFrame, spaces: DataFrame, k: int) -> DataFrame:
    """Top live pages with their space; ranks ids first and fetches names for the survivors only."""
    known = live(pages).join(live(spaces).select("space_id", "space_name"), "space_id")
    ranked = top_by_views(events.join(known.select("page_id"), "page_id", "left_semi"), "page_id", k)
    return ranked.join(known.select("page_id", "title", "space_name"), "page_id")


def top_users(views: DataFrame, edits: DataFrame, k: int) -> DataFrame:
    pv = views.groupBy("user_id").agg(F.count("*").alias("pv"))
    edited = edits.groupBy("user_id").agg(F.count("*").alias("edits"))
    return pv.join(edited, "user_id", "full_outer").na.fill(0, ["pv", "edits"]).orderBy(
        F.desc("pv"), F.desc("edits"), "user_id"
    ).limit(k)


def route_breakdown(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("route", F.lit("other")).alias("route")).agg(F.count("*").alias("count"))


def op_category(op: Column) -> Column:
    """API operations by name, tools by name and then by their leading verb."""
    tool = F.substring(op, 5, 2**31 - 1)
    api = F.create_map(*[F.lit(v) for pair in API_OPS.items() for v in pair])
    exact = F.create_map(*[F.lit(v) for pair in TOOL_OPS.items() for v in pair])
    verb = F.lit("other")
    for prefix, category in reversed(TOOL_VERBS):
        verb = F.when(F.startswith(tool, F.lit(prefix)), F.lit(category)).otherwise(verb)
    return F.when(F.startswith(op, F.lit("mcp:")), F.coalesce(exact[tool], verb)).otherwise(
        F.coalesce(api[op], F.lit("other"))
    )


def by_category(events: DataFrame) -> DataFrame:
    """Operations per category; every category is present."""
    totals = events.groupBy("op").agg(F.count("*").alias("count"))
    blank = literal_rows(events.sparkSession, "category string, count long", [(c, 0) for c in OP_CATEGORIES])
    return (
        totals.select(op_category(F.col("op")).alias("category"), "count")
        .unionByName(blank)
        .groupBy("category")
        .agg(F.sum("count").alias("count"))
    )


def agent_summary(ops: DataFrame, agents: DataFrame) -> DataFrame:
    """Totals over agent operations; ops(actor_id, channel, outcome, ts), agents(actor_id)."""
    known = ops.join(agents, "actor_id", "left_semi")
    return one_row(
        known.agg(
            F.count("*").alias("ops"),
            F.count_if(F.col("channel") == "api").alias("api"),
            F.count_if(F.col("channel") == "mcp").alias("mcp"),
            F.count_if(F.col("outcome") == "error").alias("failed"),
            F.countDistinct("actor_id").alias("active_agents"),
            F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("tracking_since"),
        ),
        agents.agg(F.count("*").alias("agents")),
    )


def agent_daily(ops: DataFrame, start: datetime, end: datetime, zone: str = ZONE) -> DataFrame:
    first, last = local_bounds(start, end, zone)
    counts = ops.filter(in_range(F.col("ts"), start, end)).groupBy(local_day(F.col("ts"), zone).alias("day")).agg(
        F.count_if(F.col("channel") == "api").alias("api"), F.count_if(F.col("channel") == "mcp").alias("mcp")
    )
    return day_spine(ops.sparkSession, first, last).join(counts, "day", "left").na.fill(0)


def top_agents(ops: DataFrame, agents: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """Agents by operations, idle ones included; keys(actor_id, used_at) gives the last key use."""
    counts = ops.groupBy("actor_id").agg(
        F.count("*").alias("ops"), F.count_if(F.col("outcome") == "error").alias("failed"), F.max("ts").alias("last_op")
    )
    used = keys.groupBy("actor_id").agg(F.max("used_at").alias("key_used"))
    return (
        agents.join(counts, "actor_id", "left")
        .join(used, "actor_id", "left")
        .na.fill(0, ["ops", "failed"])
        .orderBy(F.desc("ops"), "actor_id")
        .limit(k)
    )


def bucket(ts: Column, unit: str, zone: str = ZONE) -> Column:
    return F.date_trunc(unit, local_time(ts, zone))
