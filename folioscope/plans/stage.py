"""How the given tables stand in for workspace tables: DataFrames, and the same rules as SQL."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.plans.registry import table

# A range wide enough for the whole events table, in local days.
WIDE = (datetime(2023, 12, 24, 16), datetime(2024, 2, 9, 16))
STOCK = (date(1995, 1, 1), date(2002, 3, 31))
NOW = datetime(2024, 1, 20)

ROUTES = {
    "view": "page.read",
    "click": "mcp:search_pages",
    "purchase": "mcp:update_page",
    "error": "page.create",
    "signup": "mcp:query_knowledge",
}


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def views(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf)


def typed(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return events(spark, sf).filter(F.col("event_type") == kind)


def page_events(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).withColumn("page_id", F.get_json_object("props", "$.k").cast("long"))


def part_pages(spark: SparkSession, sf: str) -> DataFrame:
    """part as pages: the brand is the space, promotional parts count as deleted."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("page_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("space_id"),
        F.when(F.col("p_type") == "PROMO", F.lit("1996-01-01")).alias("deleted_at"),
    )


def brand_spaces(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "part")
        .select(F.col("p_brand").alias("space_id"))
        .distinct()
        .select("space_id", F.upper("space_id").alias("space_name"), F.lit(None).cast("string").alias("deleted_at"))
    )


def people(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"),
        F.concat(F.lit("u"), F.col("c_custkey"), F.lit("@x.org")).alias("email"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "agent").otherwise("human").alias("user_type"),
    )


def api_keys(spark: SparkSession, sf: str) -> DataFrame:
    bal = F.col("s_acctbal")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.when(bal < 3000, "agent").when(bal < 6000, "personal").alias("key_type"),
        F.col("s_nationkey").cast("long").alias("creator_id"),
        F.when(bal < 0, F.lit("2024-01-02").cast("timestamp_ntz")).alias("deleted_at"),
        F.when(bal > 9000, F.lit("2024-01-15").cast("timestamp_ntz")).alias("expires_at"),
    )


def agent_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as an agent operation; ids, channel and outcome sit in JSON metadata."""
    kind = F.col("event_type")
    routes = F.create_map(*[F.lit(v) for pair in ROUTES.items() for v in pair])
    return events(spark, sf).select(
        "event_id", "ts", "user_id",
        routes[kind].alias("op"),
        F.to_json(
            F.struct(
                F.get_json_object("props", "$.k").alias("apiKeyId"),
                F.when(kind == "signup", "sso").alias("keyType"),
                F.when(kind.isin("view", "error"), "api").otherwise("mcp").alias("channel"),
                F.when(kind == "error", "error").when(kind == "purchase", "success").alias("outcome"),
                F.when(F.col("value") > 50, (F.col("user_id") + 1).cast("string")).alias("delegatedUserId"),
            )
        ).alias("metadata"),
    )


PEOPLE_SQL = """people as (
  select c_custkey as id, case when c_acctbal >= 0 then c_name end as name, 'u' || c_custkey || '@x.org' as email,
         case when c_mktsegment = 'MACHINERY' then 'agent' else 'human' end as user_type from customer)"""
KEYS_SQL = """api_keys as (
  select s_suppkey as id, s_name as name,
         case when s_acctbal < 3000 then 'agent' when s_acctbal < 6000 then 'personal' end as key_type,
         s_nationkey::bigint as creator_id,
         case when s_acctbal < 0 then timestamp '2024-01-02' end as deleted_at,
         case when s_acctbal > 9000 then timestamp '2024-01-15' end as expires_at from supplier)"""
OPS_SQL = """agent_events as (
  select event_id, ts, user_id,
         case event_type when 'view' then 'page.read' when 'click' then 'mcp:search_pages'
              when 'purchase' then 'mcp:update_page' when 'error' then 'page.create' else 'mcp:query_knowledge' end as op,
         props->>'$.k' as key_id, case when event_type = 'signup' then 'sso' end as key_type,
         case when event_type in ('view', 'error') then 'api' else 'mcp' end as channel,
         case when event_type = 'error' then 'error' when event_type = 'purchase' then 'success' end as outcome,
         case when value > 50 then (user_id + 1)::varchar end as delegated_id
  from events)"""
ATTRIBUTED_SQL = f"""{PEOPLE_SQL}, {KEYS_SQL}, {OPS_SQL}, attributed as (
  select e.event_id, e.ts, e.op, e.user_id::varchar as actor_id, u.name as actor_name, u.email as actor_email,
         coalesce(e.delegated_id, case when u.user_type <> 'agent' then e.user_id::varchar end) as attributed_user_id,
         coalesce(d.name, case when u.user_type <> 'agent' then u.name end) as attributed_user_name,
         coalesce(d.email, case when u.user_type <> 'agent' then u.email end) as attributed_user_email,
         e.key_id, k.name as key_name, k.deleted_at as key_deleted_at, k.expires_at as key_expires_at,
         c.name as creator_name, c.email as creator_email,
         coalesce(e.key_type, k.key_type, case when u.user_type = 'agent' then 'agent' else 'unknown' end) as key_type,
         e.channel, coalesce(e.outcome, 'called') as outcome,
         (u.user_type = 'agent' or coalesce(e.key_type, k.key_type, case when u.user_type = 'agent' then 'agent' else 'unknown' end) = 'agent') as is_agent
  from agent_events e left join people u on u.id = e.user_id
  left join api_keys k on k.id::varchar = e.key_id
  left join people d on d.id::varchar = e.delegated_id
  left join people c on c.id = k.creator_id)"""


# --- page tree: region, nation, customer and order are the levels -------------------------------------


def tree_pages(spark: SparkSession, sf: str) -> DataFrame:
    no_text = F.lit(None).cast("string")

    def level(name, key, parent, title, deleted=no_text):
        return table(spark, sf, name).select(
            key.alias("page_id"), parent.alias("parent_id"), title.alias("title"), deleted.alias("deleted_at")
        )

    tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return (
        level("region", tag("r", "r_regionkey"), no_text, F.col("r_name"))
        .unionByName(level("nation", tag("n", "n_nationkey"), tag("r", "n_regionkey"), F.col("n_name")))
        .unionByName(
            level(
                "customer", tag("c", "c_custkey"), tag("n", "c_nationkey"), F.col("c_name"),
                F.when(F.col("c_acctbal") < 0, F.lit("1999-01-01")),
            )
        )
        .unionByName(
            level(
                "orders", tag("o", "o_orderkey"), tag("c", "o_custkey"), F.col("o_orderpriority"),
                F.when(F.col("o_orderstatus") == "P", F.lit("2000-01-01")),
            )
        )
    )


def tree_access(spark: SparkSession, sf: str) -> DataFrame:
    """Restricted pages at three levels of the tree."""
    tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string")).alias("page_id")
    return (
        table(spark, sf, "nation").filter(F.col("n_name").endswith("7")).select(tag("n", "n_nationkey"))
        .union(table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(tag("c", "c_custkey")))
        .union(table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(tag("o", "o_orderkey")))
    )


def tree_permissions(spark: SparkSession, sf: str) -> DataFrame:
    """Users are suppliers, groups are nations: orders grant their shippers, the levels above a group."""
    tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string")).alias("page_id")
    none = F.lit(None).cast("long")
    lines = table(spark, sf, "lineitem").select(
        tag("o", "l_orderkey"), F.col("l_suppkey").alias("user_id"), none.alias("group_id"),
        F.when(F.col("l_returnflag") == "A", "writer").otherwise("reader").alias("role"),
    )
    customers = table(spark, sf, "customer").select(
        tag("c", "c_custkey"), none.alias("user_id"), F.col("c_nationkey").cast("long").alias("group_id"),
        F.when(F.col("c_acctbal") > 5000, "writer").otherwise("reader").alias("role"),
    )
    nations = table(spark, sf, "nation").select(
        tag("n", "n_nationkey"), none.alias("user_id"), F.col("n_nationkey").cast("long").alias("group_id"),
        F.lit("reader").alias("role"),
    )
    every = lines.unionByName(customers).unionByName(nations)
    return every.join(tree_access(spark, sf), "page_id", "left_semi")


def tree_memberships(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("long").alias("group_id"), F.col("s_suppkey").alias("user_id")
    )


TREE_SQL = """tree as (
  select 'r' || r_regionkey as page_id, null::varchar as parent_id, r_name as title, null::varchar as deleted_at from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name, null from nation
  union all select 'c' || c_custkey, 'n' || c_nationkey, c_name, case when c_acctbal < 0 then '1999-01-01' end from customer
  union all select 'o' || o_orderkey, 'c' || o_custkey, o_orderpriority, case when o_orderstatus = 'P' then '2000-01-01' end from orders)"""
UP_SQL = """up as (
  select page_id, page_id as anc, parent_id as nxt, 0 as depth from tree
  union all select u.page_id, t.page_id, t.parent_id, u.depth + 1 from up u join tree t on t.page_id = u.nxt)"""
ACCESS_SQL = """restricted as (
  select 'n' || n_nationkey as page_id from nation where n_name like '%7'
  union all select 'c' || c_custkey from customer where c_mktsegment = 'BUILDING'
  union all select 'o' || o_orderkey from orders where o_orderpriority = '1-URGENT'),
permission as (select * from (
  select 'o' || l_orderkey as page_id, l_suppkey as user_id, null::bigint as group_id, case when l_returnflag = 'A' then 'writer' else 'reader' end as role from lineitem
  union all select 'c' || c_custkey, null, c_nationkey, case when c_acctbal > 5000 then 'writer' else 'reader' end from customer
  union all select 'n' || n_nationkey, null, n_nationkey, 'reader' from nation) where page_id in (select page_id from restricted)),
grants as (select page_id, user_id, bool_or(role = 'writer') as can_write from (
  select page_id, user_id, role from permission where user_id is not null
  union all select page_id, s_suppkey, role from permission join supplier on s_nationkey = group_id) group by 1, 2)"""
WITH_TREE = f"with recursive {TREE_SQL}, {UP_SQL}"
WITH_ACCESS = f"{WITH_TREE}, {ACCESS_SQL}, needed as (select u.page_id, u.anc, u.depth from up u join restricted r on r.page_id = u.anc)"


def said_by_role(turns):
    """(conv_id, user, assistant): all turns of each side in order, null where a side says nothing."""
    said = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))
    joined = lambda name: F.when(F.size(name) > 0, F.array_join(F.transform(name, lambda t: t["text"]), " ")).alias(name)
    both = turns.groupBy("conv_id").agg(said("user").alias("user"), said("assistant").alias("assistant"))
    return both.select("conv_id", joined("user"), joined("assistant"))
