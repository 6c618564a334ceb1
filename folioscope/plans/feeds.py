"""Registered queries: datasets, logs, streams and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import clock
from folioscope.operators import activity
from folioscope.operators import paging as P
from folioscope.plans import stage as S
from folioscope.plans.registry import plan, table
from folioscope.session import scratch_folder
from folioscope.sources import datasets as D
from folioscope.sources import feeds as FE
from folioscope.streaming import streams as ST


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and reads its result back from the shared checkpoint folder.

    Rows of an append stream add up; the last batch of a complete one holds the whole result and replaces it.
    """
    spark = stream.sparkSession
    folder = scratch_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/data").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/data")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


@plan("select strftime((ts + interval 8 hour)::date, '%Y-%m-%d') as day, count(*) as pv from events group by 1")
def stream_daily(spark, sf):
    out = _run(ST.stream_tumbling(_stream(spark, sf)), "complete")
    return out.select(F.date_format(F.col("start").cast("timestamp_ntz") + F.expr("interval 8 hours"), "yyyy-MM-dd").alias("day"), "pv")


@plan("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, count(*) as pv from events group by 1")
def stream_hourly(spark, sf):
    out = _run(ST.stream_tumbling(_stream(spark, sf), "1 hour"), "complete")
    return out.select(F.date_format(F.col("start").cast("timestamp_ntz"), "yyyy-MM-dd HH").alias("hour"), "pv")


@plan("""with d as (select distinct user_id, (ts + interval 8 hour)::date as day from events),
w as (select day + i::int as day, count(distinct user_id) as active from d, range(7) t(i) group by 1)
select strftime(day, '%Y-%m-%d') as day, active from w where day::timestamp + interval 16 hour <= (select max(ts) from events) - interval 1 day""")
def stream_weekly_active(spark, sf):
    """The stream's own count of distinct users of trailing 7 days, for days that no late event can change."""
    out = _run(ST.stream_exact_active(_stream(spark, sf), 7), "append")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "active")


SESSIONS = """k as (select (props->>'$.k')::bigint as page_id, ts from events), g as (select *, case when ts - lag(ts) over w <= interval 2 hour then 0 else 1 end as fresh from k window w as (partition by page_id order by ts)),
n as (select *, sum(fresh) over (partition by page_id order by ts rows unbounded preceding) as session from g),
sessions as (select page_id, count(*) as change_count, min(ts) as first_changed, max(ts) as last_changed, max(ts) + interval 2 hour as eligible_at from n group by page_id, session)"""
SESSION_COLUMNS = "page_id, change_count, strftime(first_changed, '%Y-%m-%d %H:%M:%S') as first_changed, strftime(last_changed, '%Y-%m-%d %H:%M:%S') as last_changed, strftime(eligible_at, '%Y-%m-%d %H:%M:%S') as eligible_at"


def _shown(df, *names):
    return df.withColumns({n: F.date_format(F.col(n).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss") for n in names})


@plan(f"with {SESSIONS} select {SESSION_COLUMNS} from sessions")
def debounce_sessions(spark, sf):
    return _shown(ST.debounce(S.page_events(spark, sf), "2 hours"), "first_changed", "last_changed", "eligible_at")


@plan(f"with {SESSIONS} select {SESSION_COLUMNS} from sessions where eligible_at <= (select max(ts) from events) - interval 1 hour")
def stream_debounce(spark, sf):
    """Sessions that the watermark has closed; the state keeps only those still open."""
    changes = _stream(spark, sf).withColumn("page_id", F.get_json_object("props", "$.k").cast("long"))
    return _shown(_run(ST.debounce(changes, "2 hours"), "append"), "first_changed", "last_changed", "eligible_at")


@plan("select strftime((ts + interval 8 hour)::date, '%Y-%m-%d') as day, count(*) as pv, count(distinct user_id) as uv from events group by 1")
def recomputed_days(spark, sf):
    """Daily counts without the events that come late, then the days of those written again."""
    events = table(spark, sf, "events")
    late = F.col("event_id") % 5 == 0
    path = scratch_folder(spark, "days")
    activity.daily_pv_uv(events.filter(~late)).write.partitionBy("day").parquet(path)
    days = events.filter(late).select(F.to_date(clock.local_time(F.col("ts"), clock.ZONE)).alias("day"))
    ST.recompute_days(events, days, path, clock.ZONE)
    return spark.read.schema("pv long, uv long, day date").parquet(path).select(clock.day_text(F.col("day")).alias("day"), "pv", "uv")


@plan("select o_orderkey, strftime(o_orderdate::date + (o_orderkey % 40)::int, '%Y-%m-%d') as due, date_diff('day', date '1995-01-01', o_orderdate::date + (o_orderkey % 40)::int) as days_on from orders")
def due_days(spark, sf):
    """Days added to a date and counted between two."""
    due = clock.add_days(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int"))
    counted = clock.diff_days(F.lit("1995-01-01").cast("date"), due).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", clock.day_text(due).alias("due"), counted.alias("days_on"))


@plan("select user_id, event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_visited_at from events group by 1, 2")
def stream_last_seen(spark, sf):
    return _shown(_run(ST.last_seen(_stream(spark, sf), ["user_id", "event_type"]), "complete"), "last_visited_at")


COOLDOWN = """with recursive o as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events),
c as (select user_id, event_id, n, ts + interval 12 hour as open_at, true as sent from o where n = 1
 union all select o.user_id, o.event_id, o.n, case when o.ts >= c.open_at then o.ts + interval 12 hour else c.open_at end, o.ts >= c.open_at from c join o on o.user_id = c.user_id and o.n = c.n + 1)
select user_id, event_id as notice_id from c where sent"""


def _notices(df):
    return df.withColumnRenamed("event_id", "notice_id")


@plan(COOLDOWN)
def cooldown(spark, sf):
    return ST.cooldown(_notices(S.events(spark, sf)), ["user_id"], 12).select("user_id", "notice_id")


@plan(COOLDOWN)
def stream_cooldown(spark, sf):
    return _run(ST.stream_cooldown(_notices(_stream(spark, sf)), "user_id", 12), "append").select("user_id", "notice_id")


def _schedules(spark, sf):
    sessions = ST.debounce(S.page_events(spark, sf), "2 hours")
    return sessions.select(
        F.expr("page_id div 20").alias("workspace_id"), F.expr("page_id div 5").alias("space_id"), "page_id",
        F.col("first_changed").cast("timestamp_ntz").alias("first_changed"), F.col("eligible_at").cast("timestamp_ntz").alias("eligible_at"),
    )


def _windows(spark, sf):
    return table(spark, sf, "region").select(
        F.col("r_regionkey").cast("long").alias("workspace_id"), (F.col("r_regionkey") > 1).alias("enabled"), F.lit("22:00").alias("start"),
        F.when(F.col("r_regionkey") == 2, "23:00").otherwise("09:30").alias("stop"),
    )


NOW = "timestamp '2024-01-20 01:00:00'"


def _now():
    return F.lit("2024-01-20 01:00:00").cast("timestamp_ntz")


@plan(f"""with {SESSIONS}, due as (select page_id // 5 as space_id, page_id, eligible_at from sessions where eligible_at <= {NOW} and page_id // 20 <> 2 order by eligible_at, page_id limit 2000)
select space_id, count(*) as pages, strftime(min(eligible_at), '%Y-%m-%d %H:%M:%S') as oldest from due group by 1""")
def promote_due(spark, sf):
    return _shown(ST.promote_due(_schedules(spark, sf), _windows(spark, sf), _now(), 2000), "oldest")


@plan(f"""with {SESSIONS}, w as (select page_id // 20 as workspace_id, count(*) filter (where eligible_at > {NOW}) as waiting, count(*) filter (where eligible_at <= {NOW}) as due, min(first_changed) as oldest_change, min(eligible_at) as next_eligible from sessions group by 1)
select workspace_id, waiting, due, strftime(oldest_change, '%Y-%m-%d %H:%M:%S') as oldest_change, strftime(next_eligible, '%Y-%m-%d %H:%M:%S') as next_eligible,
case when workspace_id = 2 then '2024-01-20 14:00:00' else '2024-01-20 01:00:00' end as effective_start from w""")
def delayed_summary(spark, sf):
    return _shown(ST.delayed_summary(_schedules(spark, sf), _windows(spark, sf), _now()), "oldest_change", "next_eligible", "effective_start")


@plan("""with i as (select l_orderkey as run_id, o_orderdate as created, l_partkey * 10 + l_linenumber as item_id from lineitem join orders on o_orderkey = l_orderkey), b as (select o_orderkey as run_id, count(*) as busy from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' group by 1),
r as (select *, row_number() over (partition by run_id order by item_id) as n from i) select run_id, item_id from r left join b using (run_id) where n <= 5 - coalesce(busy, 0) order by created, run_id, item_id limit 500""")
def fair_take(spark, sf):
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    items = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("run_id"), F.col("o_orderdate").alias("run_created"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("item_id")
    )
    busy = line.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("run_id"))
    return ST.fair_take(items, busy, 500).select("run_id", "item_id")


# --- logs and events -----------------------------------------------------------------------------------


def _log_lines(spark, sf):
    """Events as structured log lines; errors carry a nested error object."""
    failed = F.col("event_type") == "error"
    body = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.when(failed, 50).otherwise(30).alias("level"), F.lit("api").alias("service"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("u"), "user_id")).alias("userId"), F.struct(F.lit("GET").alias("method"), F.concat(F.lit("/"), "event_type").alias("url")).alias("req"),
        F.struct(F.when(failed, 500).otherwise(200).alias("statusCode")).alias("res"), F.col("value").alias("responseTime"),
        F.when(failed, F.struct(F.lit("Error").alias("type"), F.lit("a\nb").alias("stack"))).alias("err"),
    )
    return table(spark, sf, "events").select(F.to_json(body).alias("value"))


@plan("""select strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as time, case when event_type = 'error' then 50 else 30 end as level, case when event_type <> 'view' then 'u' || user_id else '' end as user_id, '/' || event_type as req_url, case when event_type = 'error' then 500 else 200 end as res_status,
value as res_time_ms, case when event_type = 'error' then 'Error' else '' end as err_type, case when event_type = 'error' then 'a' || chr(10) || 'b' else '' end as err_stack, '' as msg from events""")
def flat_logs(spark, sf):
    return FE.flatten_logs(_log_lines(spark, sf)).select("time", "level", "user_id", "req_url", "res_status", "res_time_ms", "err_type", "err_stack", "msg")


@plan("""select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as lines, count(*) filter (where event_type = 'error') as server_errors, round(avg(value), 6) as latency_mean, max(value) as latency_max from events group by 1""")
def log_windows(spark, sf):
    out = ST.log_windows(FE.flatten_logs(_log_lines(spark, sf)), "1 hour")
    return _shown(out, "start").withColumn("latency_mean", F.round("latency_mean", 6))


@plan("""select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as lines, count(*) filter (where event_type = 'error') as server_errors, round(avg(value), 6) as latency_mean, max(value) as latency_max,
 (select count(*) from events where event_type = 'click') as malformed from events where event_type <> 'click' group by 1""")
def stream_log_windows(spark, sf):
    """The same over a stream of text files; lines of clicks are cut off in the middle and kept apart."""
    folder = scratch_folder(spark, "lines")
    lines = _log_lines(spark, sf)
    click = F.get_json_object("value", "$.req.url") == "/click"
    lines.select(F.when(click, F.substring("value", 1, 25)).otherwise(F.col("value")).alias("value")).write.text(folder)
    good, bad = FE.split_logs(spark.readStream.schema("value string").text(folder))
    out, apart = _run(ST.log_windows(good, "1 hour"), "complete"), _run(bad, "append")
    shown = _shown(out, "start").withColumn("latency_mean", F.round("latency_mean", 6))
    return shown.withColumn("malformed", apart.agg(F.count("*")).scalar())


@plan("select event_id, case when event_type in ('view', 'click') then 'page_view' when event_type = 'error' then 'agent_op' else 'space_deleted' end as event, case event_type when 'view' then 'view' when 'click' then 'other' when 'error' then substr(repeat('op.', 40), 1, 64) end as route, strftime(ts, '%Y-%m-%d') as day from events")
def event_rows(spark, sf):
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        "event_id", "ts", F.when(kind.isin("view", "click"), "page_view").when(kind == "error", "agent_op").otherwise("space_deleted").alias("event"),
        F.when(kind == "error", F.repeat(F.lit("op."), 40)).otherwise(kind).alias("route"),
    )
    return FE.prepare_events(rows, ["view", "home"]).select("event_id", "event", "route", F.date_format("day", "yyyy-MM-dd").alias("day"))


@plan("select p_partkey as page_id from part where p_type <> 'PROMO' and p_brand = 'Brand#7' and p_partkey > 10 order by p_partkey limit 200")
def export_sources(spark, sf):
    return FE.export_sources(S.part_pages(spark, sf), "Brand#7", 10).select("page_id")


# --- datasets ------------------------------------------------------------------------------------------


@plan("""select doc_id, case when lang = 'de' then trim('# ' || source || chr(10) || text, e' \\t\\r\\n') || chr(10) else '# ' || source || chr(10) || chr(10) || text || chr(10) end as markdown from documents""")
def export_markdown(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("title"), F.when(F.col("lang") == "de", F.concat(F.lit("# "), "source", F.lit("\n"), "text")).otherwise(F.col("text")).alias("text")
    )
    return D.export_markdown(docs)


@plan("""with q as (select count(*) as n, lang from documents group by 2), e as (select lang, 200 * n / sum(n) over () as exact from q), b as (select *, floor(exact) as base from e),
k as (select lang, base + case when row_number() over (order by round(exact - base, 9) desc, lang) <= round(sum(exact) over ()) - sum(base) over () then 1 else 0 end as quota from b),
r as (select doc_id, lang, row_number() over (partition by lang order by sha256('7:' || doc_id), doc_id) as n from documents) select doc_id, lang from r join k using (lang) where n <= quota""")
def stratified_subset(spark, sf):
    return D.sample_stratified(table(spark, sf, "documents"), "doc_id", "lang", 200, 7).select("doc_id", "lang")


@plan("""with g as (select doc_id from labels where quality = 1 and toxic = 1), n as (select doc_id from documents where doc_id not in (select doc_id from g) order by sha256('3:' || doc_id), doc_id limit (select round_even(count(*) * 1.5, 0)::bigint from g))
select doc_id, true as is_gold from g union all select doc_id, false from n""")
def subset_documents(spark, sf):
    gold = table(spark, sf, "labels").filter((F.col("quality") == 1) & (F.col("toxic") == 1)).select("doc_id")
    return D.subset_documents(gold, table(spark, sf, "documents"), 1.5, 3)


@plan("""with p as (select c_mktsegment || '-' || c_nationkey || '_' || c_custkey as doc_id, c_mktsegment || '-' || c_nationkey as document from customer), s as (select document, count(*) as n from p group by 1 order by n, document limit 20) select doc_id from p where document in (select document from s)""")
def whole_documents(spark, sf):
    corpus = table(spark, sf, "customer").select(F.concat("c_mktsegment", F.lit("-"), "c_nationkey", F.lit("_"), "c_custkey").alias("doc_id"))
    return D.whole_documents(corpus, 20).select("doc_id")


@plan("""select 'dangling_gold' as problem, count(distinct l_orderkey) as n from lineitem where l_partkey not in (select p_partkey from part where p_type <> 'PROMO')
union all select 'blank_question', count(*) from orders where o_orderstatus = 'P'""")
def dataset_validation(spark, sf):
    corpus = table(spark, sf, "part").filter(F.col("p_type") != "PROMO").select(F.col("p_partkey").alias("doc_id"))
    samples = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderstatus") == "P", " ").otherwise("q").alias("question"))
    gold = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("doc_id"))
    return D.validate_dataset(samples, gold, corpus)


@plan(r"""with d as (select doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents),
q as (select doc_id, t, list_transform(range(0, length(t), 60), lambda i: trim(substr(t, i + 1, 60)) || case when lang = 'de' and i + 60 >= length(t) then '¤' else '' end) as quotes from d)
select doc_id from q where len(quotes) > 0 and len(list_filter(quotes, lambda x: not contains(t, x))) = 0""")
def verified_evidence(spark, sf):
    """The whole of every document is quoted in passages of 60 characters; the last one is altered in one language."""
    docs = table(spark, sf, "documents")
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    passages = F.regexp_extract_all(F.when(F.col("lang") == "de", F.concat(flat, F.lit("¤"))).otherwise(flat), F.lit("(?s).{1,60}"), F.lit(0))
    quotes = F.concat(F.when(flat != "", passages).otherwise(F.array().cast("array<string>")), F.array(F.lit(" ")))
    items = docs.select("doc_id", F.lit("q").alias("question"), F.lit("a").alias("answer"), quotes.alias("quotes"))
    return D.verified_evidence(items, docs).select("doc_id")


@plan("""with t as (select p_brand || p_size as title, min(p_partkey) as doc_id from part group by 1 having count(*) = 1), f as (select distinct l_orderkey as id, doc_id from lineitem join part on p_partkey = l_partkey join t on t.title = p_brand || p_size)
select 'shop:' || id as sample_id, string_agg(doc_id::varchar, ',' order by doc_id) as gold from f group by 1""")
def qa_gold_titles(spark, sf):
    part, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    corpus = part.select(F.col("p_partkey").alias("doc_id"), F.concat("p_brand", "p_size").alias("title"))
    unique = corpus.groupBy("title").count().filter("count = 1").select("title")
    facts = line.join(corpus, F.col("l_partkey") == F.col("doc_id")).join(unique, "title", "left_semi")
    rows = facts.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_list(F.array("title", F.lit("0"))).alias("supporting_facts"), F.lit("q").alias("question"), F.lit("a").alias("answer")
    )
    out = D.normalize_qa(rows, corpus, "shop")
    return out.select("sample_id", F.array_join(F.array_sort("gold_doc_ids"), ",").alias("gold"))


@plan("""select url as path, p_partkey::varchar as external_id, 'page-' || p_partkey as page_id from (select distinct 'export/' || p_type || '_' || p_partkey || '.html' as url, p_partkey from part where p_size > 3 and p_partkey > 0)""")
def external_ids(spark, sf):
    part = table(spark, sf, "part")
    paths = part.select(
        F.when(F.col("p_size") > 3, F.concat(F.lit("export/"), "p_type", F.lit("_"), "p_partkey", F.lit(".html"))).otherwise(F.concat(F.lit("../"), "p_partkey", F.lit(".html"))).alias("path")
    )
    mappings = part.filter("p_partkey > 0").select(F.col("p_partkey").cast("string").alias("external_id"), F.concat(F.lit("page-"), "p_partkey").alias("page_id"))
    return D.external_id_map(paths, mappings)


# --- paging --------------------------------------------------------------------------------------------

KEYS = [("o_totalprice", "desc"), ("o_custkey", "asc"), ("o_orderkey", "desc")]


@plan("select o_orderkey, o_totalprice from orders where o_totalprice < 250000.5 or (o_totalprice = 250000.5 and (o_custkey > 700 or (o_custkey = 700 and o_orderkey < 9))) order by o_totalprice desc, o_custkey, o_orderkey desc limit 51")
def keyset_page(spark, sf):
    orders = table(spark, sf, "orders")
    return P.keyset_page(orders, KEYS, 50, after=P.encode_cursor([250000.5, 700, 9])).select("o_orderkey", "o_totalprice")


@plan("select * from (select o_orderkey, o_totalprice from orders where o_totalprice > 250000.5 or (o_totalprice = 250000.5 and (o_custkey < 700 or (o_custkey = 700 and o_orderkey > 9))) order by o_totalprice, o_custkey desc, o_orderkey limit 51) order by o_totalprice desc")
def keyset_page_before(spark, sf):
    orders = table(spark, sf, "orders")
    return P.keyset_page(orders, KEYS, 50, before=P.encode_cursor([250000.5, 700, 9])).select("o_orderkey", "o_totalprice")


@plan("select o_orderkey, (select count(*) from orders where o_orderstatus = 'O') as total from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey desc limit 500 offset 500")
def offset_page(spark, sf):
    rows = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "O")
    page = P.offset_page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 2, 500)
    return P.with_total(page.select("o_orderkey"), rows)


@plan("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n > 20")
def session_trim(spark, sf):
    return P.beyond_per_key(S.events(spark, sf), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id")


@plan("select event_id, lag(value) over w as previous_value from events window w as (partition by user_id order by ts, event_id)")
def previous_version(spark, sf):
    return P.previous_row(S.events(spark, sf), "user_id", ["ts", "event_id"], ["value"]).select("event_id", "previous_value")


@plan("select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) as occurrence from events")
def occurrences(spark, sf):
    return P.occurrence(S.events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "occurrence")


@plan("""with e as (select *, (props->>'$.k')::bigint as page_id from events), v as (select user_id, page_id, max(ts) as seen from e group by 1, 2)
select user_id, page_id, p_name as title from (select * from v join part on p_partkey = page_id and p_type <> 'PROMO' where user_id = 7 order by seen desc, page_id desc limit 20)""")
def recent_visits(spark, sf):
    visits = S.page_events(spark, sf).groupBy("user_id", "page_id").agg(F.max("ts").alias("at"))
    live = S.part_pages(spark, sf).filter(F.col("deleted_at").isNull()).select("page_id", "title")
    page = visits.filter(F.col("user_id") == 7).join(live, "page_id")
    return P.keyset_page(page, [("at", "desc"), ("page_id", "desc")], 19).select("user_id", "page_id", "title")


@plan("""with c as (select l_partkey, max_by(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) filter (where l_returnflag = 'A') as ready, max_by(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) filter (where l_suppkey = l_partkey % 100) as exact from lineitem group by 1)
select p_partkey, coalesce(exact, ready) as caption from part join c on l_partkey = p_partkey""")
def caption_fallback(spark, sf):
    line = table(spark, sf, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]
    newest = lambda rows, name: P.latest_per_key(rows, ["l_partkey"], order, ["l_suppkey"]).withColumnRenamed("l_suppkey", name)
    exact = newest(line.filter(F.col("l_suppkey") == F.col("l_partkey") % 100), "exact")
    ready = newest(line.filter(F.col("l_returnflag") == "A"), "ready")
    keys = line.select("l_partkey").distinct()
    return keys.join(exact, "l_partkey", "left").join(ready, "l_partkey", "left").select(
        F.col("l_partkey").alias("p_partkey"), F.coalesce("exact", "ready").alias("caption")
    )
