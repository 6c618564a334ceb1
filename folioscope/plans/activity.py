"""Registered queries: event analytics and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import clock
from folioscope.operators import activity as A
from folioscope.operators import usage as U
from folioscope.plans import stage as S
from folioscope.plans.registry import plan, table

DAY = "(ts + interval 8 hour)::date"
SPINE = "days as (select unnest(generate_series(date '2023-12-25', date '2024-02-09', interval 1 day))::date as day)"
ROLLING = f"""{SPINE}, seen as (select distinct user_id, {DAY} as day from events),
rolling as (select d.day, count(distinct s.user_id) filter (where s.day > d.day - 7) as wau, count(distinct s.user_id) as mau
  from days d left join seen s on s.day > d.day - 30 and s.day <= d.day group by d.day)"""
SERIES = f"""{ROLLING},
pv as (select {DAY} as day, count(*) as pv, count(distinct user_id) as uv from events group by 1),
np as (select {DAY} as day, count(*) as n from events where event_type = 'signup' group by 1),
ed as (select {DAY} as day, count(*) as n from events where event_type = 'purchase' group by 1),
series as (select r.day, coalesce(pv.pv, 0) as pv, coalesce(pv.uv, 0) as uv, wau, mau,
  coalesce(np.n, 0) as new_pages, coalesce(ed.n, 0) as edits
  from rolling r left join pv using (day) left join np using (day) left join ed using (day))"""


def _series(spark, sf):
    return A.daily_series(
        S.views(spark, sf), S.typed(spark, sf, "signup"), S.typed(spark, sf, "purchase"), *S.WIDE
    )


def _named_day(df):
    return df.withColumn("day", clock.day_text(F.col("day")))


@plan(f"with {SERIES} select * replace (strftime(day, '%Y-%m-%d') as day) from series")
def daily_series(spark, sf):
    return _named_day(_series(spark, sf))


@plan(f"select strftime({DAY}, '%Y-%m-%d') as day, count(*) as pv, count(distinct user_id) as uv from events group by 1")
def daily_pv_uv(spark, sf):
    return _named_day(A.daily_pv_uv(S.events(spark, sf)))


@plan(f"with {ROLLING} select strftime(day, '%Y-%m-%d') as day, wau, mau from rolling")
def rolling_wau_mau(spark, sf):
    return _named_day(A.rolling_active(S.events(spark, sf), *S.WIDE, {"wau": 7, "mau": 30}))


@plan(f"""with {SERIES} select round(avg(uv))::bigint as avg_dau, max_by(wau, day) as wau, max_by(mau, day) as mau,
round(avg(case when mau > 0 then uv / mau end), 3) as stickiness from series""")
def activity_summary(spark, sf):
    return A.summarize_activity(_series(spark, sf))


@plan("""select (select count(*) from events) as pv, (select count(distinct user_id) from events) as uv,
(select count(*) from events where event_type = 'signup') as total_pages,
(select count(*) from events where event_type = 'signup') as new_pages,
(select count(*) from events where event_type = 'purchase') as edits,
(select count(*) from events where event_type = 'click') as comments,
(select count(*) from customer where c_mktsegment <> 'MACHINERY') as users,
(select count(distinct p_brand) from part) as spaces,
(select count(*) from events where event_type = 'error') as questions,
(select count(distinct user_id) from events where event_type = 'error') as askers""")
def workspace_totals(spark, sf):
    return A.summarize(
        S.events(spark, sf),
        S.typed(spark, sf, "signup"),
        S.typed(spark, sf, "purchase"),
        S.typed(spark, sf, "click"),
        *S.WIDE,
        users=S.people(spark, sf).filter(F.col("user_type") != "agent"),
        spaces=S.brand_spaces(spark, sf),
        questions=S.typed(spark, sf, "error"),
    )


def _stock_tables(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    ends = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(F.bool_and(F.col("l_linestatus") == "F"), F.max("l_shipdate")).alias("deleted_at")
    )
    users = orders.join(ends, "o_orderkey", "left").select(
        F.col("o_orderdate").alias("created_at"),
        "deleted_at",
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate") + F.expr("interval 90 days")).alias("deactivated_at"),
    )
    spaces = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"))
    gone = orders.filter(F.col("o_orderpriority") == "5-LOW").select(
        (F.col("o_orderdate") + F.expr("interval 30 days")).alias("created_at"),
        F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("spaceCreatedAt"))).alias("metadata"),
    )
    return users, spaces, gone


@plan("""with days as (select unnest(generate_series(date '1995-01-01', date '2002-03-31', interval 1 day))::date as day),
ends as (select l_orderkey, case when bool_and(l_linestatus = 'F') then max(l_shipdate) end as deleted_at from lineitem group by 1),
users as (select o_orderdate as created_at, deleted_at, case when o_orderstatus = 'P' then o_orderdate + interval 90 day end as deactivated_at
  from orders left join ends on l_orderkey = o_orderkey),
spaces as (select min(o_orderdate) as created_at from orders group by o_custkey),
gone as (select o_orderdate as born, o_orderdate + interval 30 day as created_at from orders where o_orderpriority = '5-LOW'),
bounds as (select day, (day + 1)::timestamp - interval 8 hour as day_end from days),
u as (select day, count(*) as n from bounds join users on created_at < day_end
  and (deleted_at is null or deleted_at >= day_end) and (deactivated_at is null or deactivated_at >= day_end) group by day),
s as (select day, count(*) as n from bounds join spaces on created_at < day_end group by day),
g as (select day, count(*) as n from bounds join gone on born < day_end and created_at >= day_end group by day)
select strftime(day, '%Y-%m-%d') as day, coalesce(u.n, 0) as user_count, coalesce(s.n, 0) + coalesce(g.n, 0) as space_count
from days left join u using (day) left join s using (day) left join g using (day)""")
def daily_stock(spark, sf):
    return _named_day(A.daily_stock(*_stock_tables(spark, sf), *S.STOCK))


@plan("""with pages as (select p_partkey as page_id, p_name as title, p_brand as space_id from part where p_type <> 'PROMO'),
ranked as (select page_id, count(*) as pv, count(distinct user_id) as uv from (select *, (props->>'$.k')::bigint as page_id from events)
  where page_id in (select page_id from pages) group by 1 order by pv desc, page_id limit 10)
select page_id, pv, uv, title, upper(space_id) as space_name from ranked join pages using (page_id)""")
def top_pages(spark, sf):
    return A.top_pages(S.page_events(spark, sf), S.part_pages(spark, sf), S.brand_spaces(spark, sf), 10)


@plan("""select p_brand as space_id, count(*) as pv, count(distinct user_id) as uv
from (select *, (props->>'$.k')::bigint as page_id from events) e join part on p_partkey = page_id and p_type <> 'PROMO'
group by 1 order by pv desc, space_id limit 10""")
def top_spaces(spark, sf):
    pages = A.live(S.part_pages(spark, sf)).select("page_id", "space_id")
    return A.top_by_views(S.page_events(spark, sf).join(pages, "page_id"), "space_id", 10)


@plan("""with v as (select user_id, count(*) as pv from events where event_type = 'view' group by 1),
e as (select user_id, count(*) as edits from events where event_type = 'purchase' group by 1)
select user_id, coalesce(pv, 0) as pv, coalesce(edits, 0) as edits from v full join e using (user_id)
order by pv desc, edits desc, user_id limit 20""")
def top_users(spark, sf):
    return A.top_users(S.typed(spark, sf, "view"), S.typed(spark, sf, "purchase"), 20)


@plan("select case when event_type <> 'error' then event_type else 'other' end as route, count(*) as count from events group by 1")
def route_breakdown(spark, sf):
    routed = S.events(spark, sf).withColumn("route", F.when(F.col("event_type") != "error", F.col("event_type")))
    return A.route_breakdown(routed)


@plan(f"""with {S.OPS_SQL}, named as (select case op when 'page.read' then 'read' when 'page.create' then 'write'
  when 'mcp:query_knowledge' then 'query' when 'mcp:search_pages' then 'search' when 'mcp:update_page' then 'write' end as category
  from agent_events), cats as (select unnest(['query', 'search', 'read', 'write', 'delete', 'other']) as category)
select category, count(n.category) as count from cats left join named n using (category) group by 1""")
def op_categories(spark, sf):
    return A.by_category(S.agent_events(spark, sf))


def _agent_ops(spark, sf):
    return S.agent_events(spark, sf).select(
        F.col("user_id").alias("actor_id"), "ts", "op",
        F.get_json_object("metadata", "$.channel").alias("channel"),
        F.get_json_object("metadata", "$.outcome").alias("outcome"),
    )


def _agents(spark, sf):
    return S.people(spark, sf).filter(F.col("user_type") == "agent").select(F.col("id").alias("actor_id"))


AGENTS = "agents as (select id as actor_id from people where user_type = 'agent')"


@plan(f"""with {S.PEOPLE_SQL}, {S.OPS_SQL}, {AGENTS}, known as (select * from agent_events where user_id in (select actor_id from agents))
select count(*) as ops, count(*) filter (where channel = 'api') as api, count(*) filter (where channel = 'mcp') as mcp,
count(*) filter (where outcome = 'error') as failed, count(distinct user_id) as active_agents,
strftime(min(ts), '%Y-%m-%d %H:%M:%S') as tracking_since, (select count(*) from agents) as agents from known""")
def agent_summary(spark, sf):
    return A.agent_summary(_agent_ops(spark, sf), _agents(spark, sf))


@plan(f"""with {SPINE}, {S.OPS_SQL}, c as (select {DAY} as day, count(*) filter (where channel = 'api') as api,
count(*) filter (where channel = 'mcp') as mcp from agent_events group by 1)
select strftime(day, '%Y-%m-%d') as day, coalesce(api, 0) as api, coalesce(mcp, 0) as mcp from days left join c using (day)""")
def agent_daily(spark, sf):
    return _named_day(A.agent_daily(_agent_ops(spark, sf), *S.WIDE))


@plan(f"""with {S.PEOPLE_SQL}, {S.OPS_SQL}, {AGENTS},
c as (select user_id, count(*) as ops, count(*) filter (where outcome = 'error') as failed, max(ts) as last_op from agent_events group by 1),
k as (select s_nationkey as actor_id, max(s_acctbal) as used from supplier group by 1)
select actor_id, coalesce(ops, 0) as ops, coalesce(failed, 0) as failed, strftime(last_op, '%Y-%m-%d %H:%M:%S') as last_op, used as key_used
from agents left join c on user_id = actor_id left join k using (actor_id) order by ops desc, actor_id limit 50""")
def top_agents(spark, sf):
    keys = table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("long").alias("actor_id"), F.col("s_acctbal").alias("used_at")
    )
    top = A.top_agents(_agent_ops(spark, sf), _agents(spark, sf), keys, 50)
    return top.withColumn("last_op", F.date_format("last_op", "yyyy-MM-dd HH:mm:ss"))


def _attributed(spark, sf):
    return U.attribute_ops(S.agent_events(spark, sf), S.people(spark, sf), S.api_keys(spark, sf))


@plan(f"""with {S.ATTRIBUTED_SQL} select event_id, op, actor_id, actor_name, attributed_user_id, attributed_user_name,
attributed_user_email, key_id, key_name, creator_name, key_type, channel, outcome, is_agent from attributed""")
def usage_attribution(spark, sf):
    return _attributed(spark, sf).select(
        "event_id", "op", "actor_id", "actor_name", "attributed_user_id", "attributed_user_name", "attributed_user_email",
        "key_id", "key_name", "creator_name", "key_type", "channel", "outcome", "is_agent",
    )


SUMMARY = """count(*) as ops, count(*) filter (where channel = 'api') as api, count(*) filter (where channel = 'mcp') as mcp,
count(*) filter (where outcome = 'error') as failed_ops, count(*) filter (where outcome = 'called') as unknown_ops"""


@plan(f"""with {S.ATTRIBUTED_SQL} select {SUMMARY}, count(distinct actor_id) filter (where is_agent) as active_agents,
count(distinct attributed_user_id) as active_users, count(distinct key_id) as active_keys,
count(distinct coalesce(attributed_user_id, '__none__')) as total from attributed""")
def usage_overview(spark, sf):
    return U.usage_summary(U.usage_base(_attributed(spark, sf), "user"))


@plan(f"""with {S.ATTRIBUTED_SQL} select {SUMMARY}, count(distinct actor_id) filter (where is_agent) as active_agents,
count(distinct attributed_user_id) as active_users, count(distinct key_id) as active_keys, count(distinct actor_id) as total
from attributed where is_agent and concat_ws(' ', actor_id, actor_name, actor_email, attributed_user_id, attributed_user_name,
attributed_user_email, key_id, key_name, creator_name, creator_email) ilike '%#000000001%' and channel = 'mcp'""")
def usage_searched(spark, sf):
    return U.usage_summary(U.usage_base(_attributed(spark, sf), "agent", search="#000000001", channel="mcp"))


def _groups_sql(key, name, email, where):
    joined = "array_to_string(list_sort(list_distinct(list({0}) filter (where {0} is not null))), ', ')"
    return f"""with {S.ATTRIBUTED_SQL} select coalesce({key}, '__none__') as group_id, {name} as group_name, {email} as group_email,
coalesce({joined.format('key_type')}, '') as key_types,
coalesce({joined.format('coalesce(actor_name, actor_email, actor_id)')}, '') as actors,
coalesce({joined.format('coalesce(creator_name, creator_email)')}, '') as creators,
case when bool_or(key_deleted_at is not null) then 'revoked'
     when bool_or(key_expires_at <= timestamp '2024-01-20') then 'expired' else 'active' end as status,
{SUMMARY}, count(distinct key_id) as key_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_op_at
from attributed {where} group by 1, 2, 3"""


def _group_report(spark, sf, group_by):
    out = U.usage_groups(U.usage_base(_attributed(spark, sf), group_by), S.NOW)
    return out.withColumn("last_op_at", F.date_format("last_op_at", "yyyy-MM-dd HH:mm:ss"))


@plan(_groups_sql("attributed_user_id", "attributed_user_name", "attributed_user_email", ""))
def usage_groups_by_user(spark, sf):
    return _group_report(spark, sf, "user")


@plan(_groups_sql("key_id", "key_name", "null::varchar", ""))
def usage_groups_by_key(spark, sf):
    return _group_report(spark, sf, "key")


@plan(_groups_sql("actor_id", "actor_name", "actor_email", "where is_agent"))
def usage_groups_by_agent(spark, sf):
    return _group_report(spark, sf, "agent")


@plan(f"""with {S.ATTRIBUTED_SQL}, {SPINE}, c as (select {DAY} as day, count(*) filter (where channel = 'api') as api,
count(*) filter (where channel = 'mcp') as mcp from attributed group by 1)
select strftime(day, '%Y-%m-%d') as date, coalesce(api, 0) as api, coalesce(mcp, 0) as mcp from days left join c using (day)""")
def usage_buckets_daily(spark, sf):
    return U.usage_buckets(U.usage_base(_attributed(spark, sf)), *S.WIDE)


@plan(f"""with {S.ATTRIBUTED_SQL} , hours as (select unnest(generate_series(timestamp '2024-01-10 00:00:00', timestamp '2024-01-10 23:00:00', interval 1 hour)) as h),
c as (select date_trunc('hour', ts + interval 8 hour) as h, count(*) filter (where channel = 'api') as api,
count(*) filter (where channel = 'mcp') as mcp from attributed group by 1)
select strftime(h, '%Y-%m-%d %H:00') as date, coalesce(api, 0) as api, coalesce(mcp, 0) as mcp from hours left join c using (h)""")
def usage_buckets_hourly(spark, sf):
    day = clock.resolve_range("custom", S.NOW, ("2024-01-10", "2024-01-10"))
    return U.usage_buckets(U.usage_base(_attributed(spark, sf)), *day)


@plan(f"""with {S.ATTRIBUTED_SQL} select event_id, actor_id, op, channel, (select count(*) from attributed) as total
from attributed order by ts desc, event_id desc limit 50 offset 50""")
def usage_events_page(spark, sf):
    from folioscope.operators.paging import with_total

    rows = U.usage_base(_attributed(spark, sf))
    page = U.usage_events(rows, 2, 50).select("event_id", "actor_id", "op", "channel")
    return with_total(page, rows)
