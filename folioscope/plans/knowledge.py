"""Registered queries: chunking, links, provenance and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import chunks as C
from folioscope.operators import provenance as V
from folioscope.operators.paging import latest_per_key
from folioscope.plans.registry import plan, table
from folioscope.plans.stage import said_by_role


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), "text")


BLOCKS = r"""lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents),
offs as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as off,
 regexp_matches(line, '^\s*```') as mark, sum(regexp_matches(line, '^\s*```')::int) over (partition by doc_id order by n) as marks from lines),
kinds as (select *, case when mark or marks % 2 = 1 then 'fence' || ((marks + 1) // 2) when trim(line, e' \t\r') = '' then 'blank' when regexp_matches(line, '^#{1,3}\s+\S') then 'heading' || n
 when regexp_matches(line, '^\s*\|') then 'table' when regexp_matches(line, '^\s*>') then 'quote' when regexp_matches(line, '^\s*([-*+] |\d+[.)] )') then 'list' else 'text' end as kind from offs),
opens as (select *, kind is distinct from lag(kind) over (partition by doc_id order by n) as first from kinds),
runs as (select *, sum(first::int) over (partition by doc_id order by n) as run from opens),
blocks as (select doc_id, run, regexp_extract(min(kind), '[a-z]+') as kind, min(off)::bigint as start, max(off + length(line))::bigint as stop from runs where kind <> 'blank' group by doc_id, run)"""


@plan(f"with {BLOCKS} select doc_id, kind, start, stop, row_number() over (partition by doc_id order by run) - 1 as block_no from blocks")
def markdown_blocks(spark, sf):
    return C.markdown_blocks(_docs(spark, sf)).select("doc_id", "kind", "start", "stop", "block_no")


@plan(f"""with {BLOCKS}, s as (select doc_id, count(*) as blocks from blocks group by 1)
select doc_id, 1::bigint as sections, sha256('parent|(intro)|1') as first_key, length(trim(text, e' \\t\\r\\n')) as chars
from documents join s using (doc_id)""")
def section_outline(spark, sf):
    return C.sections(_docs(spark, sf)).groupBy("doc_id").agg(
        F.count("*").alias("sections"),
        F.min_by("section_key", "section_no").alias("first_key"),
        F.sum(F.length("section_text")).alias("chars"),
    )


@plan(r"""select doc_id, length(regexp_replace(text, '\s', '', 'g'))::bigint as letters, true as offsets_hold, true as within_limit from documents""")
def chunk_coverage(spark, sf):
    docs = _docs(spark, sf)
    chunks = C.chunk_sections(docs)
    bare = F.regexp_replace("text", r"\s", "")
    per = chunks.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id").groupBy("doc_id").agg(
        F.sum(F.length(bare)).alias("letters"),
        F.bool_and(F.expr("substring(whole, start + 1, stop - start)") == F.col("text")).alias("offsets_hold"),
        F.bool_and(F.length("text") <= C.MAX_CHILD).alias("within_limit"),
    )
    return docs.select("doc_id").join(per, "doc_id", "left").na.fill(0, ["letters"]).na.fill(True)


@plan()
def chunks(spark, sf):
    return C.chunk_sections(_docs(spark, sf)).drop("heading_path")


@plan("""with t as (select * from lineitem), keyed as (select l_orderkey as artifact_id, l_partkey as lineage, l_linenumber || ' of ' || l_quantity::bigint as text,
 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as position, l_returnflag from t),
 named as (select *, case when l_returnflag = 'A' then 'key-' || position else 'legacy:' || substr(sha256(lineage || '|' || text), 1, 40) || ':' ||
 row_number() over (partition by artifact_id, l_returnflag = 'A', lineage, text order by position) end as stable_key from keyed),
 h as (select artifact_id, position, stable_key, sha256(artifact_id || ':chunk:' || stable_key || ':sha256:' || sha256(text)) as h from named)
select artifact_id, position, stable_key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' ||
 printf('%02x', (('0x' || substr(h, 17, 2))::int & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) as chunk_id from h""")
def chunk_identity(spark, sf):
    from pyspark.sql.window import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf, "lineitem").withColumn("position", F.row_number().over(order)).select(
        F.col("l_orderkey").alias("artifact_id"),
        F.col("l_partkey").cast("string").alias("lineage"),
        F.concat_ws(" of ", "l_linenumber", F.col("l_quantity").cast("long")).alias("text"),
        F.lit(None).cast("string").alias("embedding_text"),
        "position",
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("key-"), "position")).alias("stable_key"),
    )
    return C.chunk_identity(rows).select("artifact_id", "position", "stable_key", "chunk_id")


@plan("select l_orderkey as doc_id, count(*) as produced from lineitem group by 1 having count(*) > 9")
def budget_check(spark, sf):
    return C.budget_check(table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "doc_id"), 9)


@plan("""with r as (select l_orderkey, l_quantity, l_extendedprice, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n, o_orderpriority
 from lineitem join orders on o_orderkey = l_orderkey)
select l_orderkey as page_id, 0 as table_no, n - 1 as row_no, 'Priority=' || o_orderpriority || '; Units\\==' || l_quantity::bigint || '; Column 3=a\\;' || n as row_text from r""")
def table_rows(spark, sf):
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    cell = lambda text, header=False, down=1: F.struct(
        text.cast("string").alias("text"), F.lit(header).alias("header"), F.lit(down).cast("int").alias("rowspan") if isinstance(down, int) else down.cast("int").alias("rowspan"), F.lit(1).alias("colspan")
    )
    # an order has few lines, so its table fits in one row
    rows = line.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))).alias("lines")
    ).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    head = F.array(cell(F.lit("Priority"), True), cell(F.lit("Units="), True), cell(F.lit(""), True))
    body = F.transform(
        "lines",
        lambda r, i: F.concat(
            F.when(i == 0, F.array(cell(F.col("o_orderpriority"), down=F.size("lines")))).otherwise(F.array().cast("array<struct<text:string,header:boolean,rowspan:int,colspan:int>>")),
            F.array(cell(r["l_quantity"].cast("long")), cell(F.concat(F.lit("a;"), i + 1))),
        ),
    )
    tables = rows.select(F.col("l_orderkey").alias("page_id"), F.lit(0).alias("table_no"), F.concat(F.array(head), body).alias("cells"))
    return C.table_rows(tables)


LINKS = """hrefs as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) as n from pages)"""


@plan(f"with {LINKS}, firsts as (select page_id, href, min(n) as n from hrefs group by 1, 2) select page_id, href, row_number() over (partition by page_id order by n) - 1 as position from firsts")
def link_extract(spark, sf):
    return C.extract_links(table(spark, sf, "pages"))


@plan(f"with {LINKS} select distinct page_id, regexp_extract(href, '^/([^?#]*)', 1) as slug from hrefs where href like '/%'")
def internal_links(spark, sf):
    return C.internal_links(table(spark, sf, "pages"))


def _contents(spark, sf):
    """Page content as nested JSON: every link is a mention of a page, or of a user when it is long."""
    pages = table(spark, sf, "pages")
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))
    mention = lambda h: F.struct(
        F.lit("mention").alias("type"),
        F.struct(F.when(F.length(h) > 12, "user").otherwise("page").alias("entityType"), h.alias("entityId")).alias("attrs"),
    )
    return pages.select("page_id", F.to_json(F.struct(F.lit("doc").alias("type"), F.transform(links, mention).alias("content"))).alias("content"))


@plan(f"with {LINKS} select distinct page_id, href as entity_id from hrefs where length(href) > 12")
def user_mentions(spark, sf):
    return C.extract_mentions(_contents(spark, sf), "user").select("page_id", "entity_id")


@plan(r"select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) as title from pages")
def page_titles(spark, sf):
    return C.page_titles(table(spark, sf, "pages"))


# --- provenance: orders are sources, parts are artifacts, lines the contributions between them ----------


def _contributions(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("artifact_id"), F.col("l_orderkey").alias("source_id"),
        F.concat(F.lit("T"), "l_suppkey").alias("title"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long")).alias("text"),
    )


CONTRIB = "contrib as (select l_partkey as artifact_id, l_orderkey as source_id, 'T' || l_suppkey as title, l_returnflag || ' ' || l_linestatus || ' ' || l_quantity::bigint as text from lineitem)"


@plan(f"""with {CONTRIB} select artifact_id, min_by(title, (source_id, title)) as title, count(distinct source_id) as sources, count(distinct text) as pieces,
count(distinct text) > 30 as over_budget, sha256(string_agg(distinct text, chr(10) || chr(10) order by text)) as text_hash from contrib group by 1""")
def merge_contributions(spark, sf):
    merged = V.merge_contributions(_contributions(spark, sf), budget=30)
    return merged.withColumn("text_hash", X.sha256_hex(F.col("text"))).drop("text")


@plan(f"with {CONTRIB} select artifact_id, text as child_key, min_by(title, (source_id, title)) as title from contrib group by 1, 2")
def merged_children(spark, sf):
    return V.merged_children(_contributions(spark, sf), F.col("text"), ["title"])


@plan("""with l as (select l_orderkey || '.' || l_linenumber || '.' || l_partkey as link_id, l_orderkey as from_id, case when l_returnflag <> 'R' then l_partkey end as to_id, l_linestatus as space_id, 'Brand#' || (l_suppkey % 25) as target_kind, l_quantity::int as target_key from lineitem),
t as (select case when p_type = 'ECONOMY' then 'F' else 'O' end as space_id, p_brand as target_kind, p_size as target_key, min(p_partkey) as found from part where p_type <> 'PROMO' group by 1, 2, 3)
select link_id, from_id, coalesce(to_id, found) as to_id, to_id is null and found is null as is_dangling from l left join t using (space_id, target_kind, target_key)""")
def link_resolution(spark, sf):
    links = table(spark, sf, "lineitem").select(
        F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey").alias("link_id"), F.col("l_orderkey").alias("from_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("to_id"), F.col("l_linestatus").alias("space_id"),
        F.concat(F.lit("Brand#"), F.col("l_suppkey") % 25).alias("target_kind"), F.col("l_quantity").cast("int").alias("target_key"),
    )
    pages = table(spark, sf, "part").select(
        F.when(F.col("p_type") == "ECONOMY", "F").otherwise("O").alias("space_id"), F.col("p_brand").alias("kind"),
        F.col("p_size").alias("canonical_key"), F.col("p_partkey").alias("page_id"),
        F.when(F.col("p_type") == "PROMO", F.lit("1999")).alias("stale_at"),
    )
    return V.resolve_links(links, pages)


def _parts(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("artifact_id"), F.when(F.col("p_type") == "PROMO", F.lit("1999-06-01")).alias("stale_at")
    )


def _bridge(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("artifact_id"), F.col("l_orderkey").alias("source_id"))


def _urgent(spark, sf):
    return table(spark, sf, "orders").filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 450000)).select(
        F.col("o_orderkey").alias("source_id")
    )


URGENT = "urgent as (select o_orderkey from orders where o_orderpriority = '1-URGENT' and o_totalprice > 450000)"


@plan(f"""with {URGENT} select p_partkey as artifact_id, case when p_type = 'PROMO' then '1999-06-01' when p_partkey in (select l_partkey from lineitem where l_orderkey in (select o_orderkey from urgent)) then '2002-01-01' end as stale_at from part""")
def stale_marking(spark, sf):
    return V.mark_stale(_parts(spark, sf), _bridge(spark, sf), _urgent(spark, sf), "artifact_id", "2002-01-01")


@plan(f"with {URGENT} select distinct l_partkey as artifact_id from lineitem where l_orderkey in (select o_orderkey from urgent)")
def source_dependants(spark, sf):
    return V.dependants(_bridge(spark, sf), _urgent(spark, sf), "artifact_id")


@plan("""with p as (select p_partkey as page_id, case when p_type = 'PROMO' then date '2000-01-01' + p_size end as stale_at from part), gone as (select page_id from p where date '2000-02-20' - stale_at > 30)
select l_orderkey || '.' || l_linenumber || '.' || l_partkey as link_id, l_suppkey as from_id, case when l_partkey not in (select page_id from gone) then l_partkey end as to_id, l_partkey in (select page_id from gone) as is_dangling
from lineitem where l_suppkey not in (select page_id from gone)""")
def stale_purge(spark, sf):
    pages = table(spark, sf, "part").select(
        F.col("p_partkey").alias("page_id"), F.when(F.col("p_type") == "PROMO", F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size"))).alias("stale_at")
    )
    links = table(spark, sf, "lineitem").select(
        F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey").alias("link_id"), F.col("l_suppkey").alias("from_id"),
        F.col("l_partkey").alias("to_id"), F.lit(False).alias("is_dangling"),
    )
    return V.purge_stale(pages, links, "2000-02-20")[1]


@plan("select event_id from events where ts >= timestamp '2024-01-25' - interval 10 day or event_type = 'signup'")
def event_retention(spark, sf):
    kept = V.retention(table(spark, sf, "events"), "ts", "2024-01-25", 10, F.col("event_type") == "signup")
    return kept.select("event_id")


@plan("""with stored as (select l_orderkey as page_id, max_by(l_returnflag, (l_shipdate, l_linenumber, l_partkey)) as h from lineitem group by 1)
select o_orderkey as page_id, case when h is null then 'new' else 'changed' end as change from orders left join stored on page_id = o_orderkey where h is distinct from (case when o_orderstatus = 'F' then 'R' else 'A' end)""")
def changed_sources(spark, sf):
    pages = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("A").alias("content_hash")
    )
    stored = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.struct("l_shipdate", "l_linenumber", "l_partkey").alias("source_version"),
        F.col("l_returnflag").alias("content_hash"),
    )
    return V.changed_sources(pages, stored)


@plan("""with old as (select vec_id, embedding from embeddings where label < 7) select e.vec_id as chunk_id, o.embedding is not null as reused, round(o.embedding[1]::double, 6) as first_value
from embeddings e left join old o using (vec_id)""")
def embedding_reuse(spark, sf):
    emb = table(spark, sf, "embeddings")
    old = emb.select(F.col("vec_id").alias("chunk_id"), "embedding", F.when(F.col("label") < 7, "v1").otherwise("v0").alias("profile"))
    out = V.reuse_embeddings(emb.select(F.col("vec_id").alias("chunk_id")), old, "v1")
    return out.select("chunk_id", F.col("embedding").isNotNull().alias("reused"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


@plan("select vec_id as chunk_id from embeddings where label not in (8, 9) and (label = 7 or label < 3)")
def rebuild_plan(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.when(F.col("label") != 7, F.col("embedding")).alias("embedding"),
        F.when(F.col("label") < 3, "old").otherwise("new").alias("profile"), F.when(F.col("label") > 7, F.lit("1999")).alias("stale_at"),
    )
    return V.rebuild_plan(rows, "new").select("chunk_id")


@plan("""select * from (with e as (select o_orderkey as id, o_orderpriority as content from orders where o_orderstatus <> 'F'), d as (select o_orderkey as id, case when o_totalprice > 300000 then '1-URGENT' else o_orderpriority end as content from orders where o_orderstatus <> 'P')
select coalesce(e.id, d.id) as id, case when e.id is null then 'insert' when d.id is null then 'delete' when e.content <> d.content then 'update' end as change from e full join d on e.id = d.id) where change is not null""")
def desired_diff(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    now = orders.filter(F.col("o_orderstatus") != "F").select("id", F.col("o_orderpriority").alias("content"))
    want = orders.filter(F.col("o_orderstatus") != "P").select(
        "id", F.when(F.col("o_totalprice") > 300000, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("content")
    )
    return V.diff_rows(now, want, "id", "content")


@plan("""with old as (select l_orderkey, l_partkey, l_quantity from lineitem where l_returnflag <> 'R'), new as (select l_orderkey, l_partkey, l_quantity from lineitem where l_returnflag = 'R')
select * from old where l_orderkey not in (select l_orderkey from new) union all select * from new""")
def replace_by_source(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    old, new = line.filter(F.col("l_returnflag") != "R"), line.filter(F.col("l_returnflag") == "R")
    return V.replace_by_key(old.drop("l_returnflag"), new.drop("l_returnflag"), ["l_orderkey"])


@plan("select user_id, (props->>'$.k')::bigint as page_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_visited_at from events group by 1, 2")
def last_visits(spark, sf):
    visits = table(spark, sf, "events").withColumn("page_id", F.get_json_object("props", "$.k").cast("long"))
    old, new = visits.filter(F.col("event_type") == "view"), visits.filter(F.col("event_type") != "view")
    out = V.upsert_greatest(old, new, ["user_id", "page_id"], "ts")
    return out.select("user_id", "page_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_visited_at"))


@plan("select distinct l_orderkey as source_id from lineitem where l_partkey in (select p_partkey from part where p_type <> 'PROMO') and l_partkey in (select l_suppkey from lineitem)")
def compiled_sources(spark, sf):
    chunks = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("artifact_id"))
    return V.compiled_sources(_bridge(spark, sf), _parts(spark, sf), chunks)


@plan("select l_orderkey as source_id from lineitem union select l_suppkey from lineitem except select o_orderkey from orders where o_orderstatus <> 'P'")
def removed_sources(spark, sf):
    pages = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderstatus") == "P", F.lit("1999")).alias("deleted_at")
    )
    return V.removed_sources(
        [_bridge(spark, sf), table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source_id"))], pages
    )


@plan(f"""with {CONTRIB}, {URGENT}, touched as (select distinct artifact_id from contrib where source_id in (select o_orderkey from urgent))
select artifact_id, count(distinct source_id) filter (where source_id not in (select o_orderkey from urgent)) as sources_left from contrib where artifact_id in (select artifact_id from touched) group by 1""")
def source_retirement(spark, sf):
    again, orphans = V.retire_sources(_contributions(spark, sf), _urgent(spark, sf))
    return again.select("artifact_id", F.col("sources").alias("sources_left")).unionByName(
        orphans.select("artifact_id", F.lit(0).cast("long").alias("sources_left"))
    )


@plan("""with a as (select l_suppkey as page_id, max_by(l_quantity::int, (l_orderkey, l_linenumber, l_partkey)) as v, max_by(l_returnflag, (l_orderkey, l_linenumber, l_partkey)) as h from lineitem group by 1)
select page_id from a where exists (select 1 from orders o join customer on c_custkey = o_custkey where o_custkey = a.page_id and c_acctbal::int % 51 = a.v % 51)""")
def reuse_candidates(spark, sf):
    line, orders, customer = (table(spark, sf, n) for n in ("lineitem", "orders", "customer"))
    attempts = line.select(
        F.col("l_suppkey").alias("page_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("attempt_id"),
        (F.rint("l_quantity").cast("int") % 51).alias("source_version"), F.lit("h").alias("content_hash"),
    )
    sources = customer.select(
        F.col("c_custkey").alias("page_id"), (F.rint("c_acctbal").cast("int") % 51).alias("source_version"), F.lit("h").alias("content_hash"),
        F.lit(None).cast("string").alias("stale_at"),
    )
    contrib = orders.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("artifact_id"))
    artifacts = orders.select(F.col("o_orderkey").alias("artifact_id"), F.lit(None).cast("string").alias("stale_at"))
    return V.reuse_candidates(attempts, sources, contrib, artifacts, artifacts).select("page_id")


@plan("""with a as (select p_partkey as artifact_id, p_brand as space_id, case when p_size > 49 then 'Brand#0' else p_brand end as expected, case when p_retailprice > 902 then 'run' end as run_id, case p_type when 'ECONOMY' then 'concept' when 'STANDARD' then 'entity' when 'PROMO' then 'note' else 'comparison' end as kind from part),
refs as (select l_partkey as artifact_id, l_orderkey as source_id, l_linenumber as a, l_linenumber + 3 as b, case when l_returnflag = 'A' then 'x' else sha256(substr(o_orderpriority, l_linenumber + 1, 3)) end as q, o_orderpriority as text, o_orderstatus <> 'P' as known from lineitem join orders on o_orderkey = l_orderkey),
f as (select artifact_id, bool_or(not known) as outside, bool_or(known and b > length(text)) as bad_range, bool_or(known and b <= length(text) and q <> sha256(substr(text, a + 1, b - a))) as bad_quote from refs group by 1)
select a.artifact_id, concat_ws(',', case when space_id <> expected then 'scope_mismatch' end, case when run_id is null or f.artifact_id is null then 'lineage_incomplete' end, case when kind = 'note' then 'kind_unsupported' end,
case when outside then 'source_outside_input' end, case when bad_range then 'range_invalid' end, case when bad_quote then 'quote_mismatch' end, case when a.artifact_id in (select l_suppkey from lineitem where l_linestatus = 'F') then 'cross_space_not_opaque' end) as reasons
from a left join f using (artifact_id)""")
def artifact_validation(spark, sf):
    part, line, orders = (table(spark, sf, n) for n in ("part", "lineitem", "orders"))
    kinds = F.create_map(*[F.lit(v) for v in ("ECONOMY", "concept", "STANDARD", "entity", "PROMO", "note")])
    artifacts = part.select(
        F.col("p_partkey").alias("artifact_id"), F.col("p_brand").alias("space_id"),
        F.when(F.col("p_size") > 49, "Brand#0").otherwise(F.col("p_brand")).alias("expected_space_id"),
        F.when(F.col("p_retailprice") > 902, "run").alias("run_id"), F.coalesce(kinds[F.col("p_type")], F.lit("comparison")).alias("kind"),
    )
    prio = orders.select("o_orderkey", "o_orderpriority")
    refs = line.join(prio, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("artifact_id"), F.col("l_orderkey").alias("source_id"), F.lit(1).alias("source_version"), F.lit("h").alias("content_hash"),
        F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 3).alias("stop"),
        F.when(F.col("l_returnflag") == "A", F.lit("x")).otherwise(X.quote_hash(F.expr("substring(o_orderpriority, l_linenumber + 1, 3)"))).alias("quote_hash"),
    )
    sources = orders.filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("source_id"), F.lit(1).alias("source_version"), F.lit("h").alias("content_hash"), F.col("o_orderpriority").alias("text")
    )
    links = line.select(
        F.col("l_suppkey").alias("artifact_id"), F.when(F.col("l_linestatus") == "F", "cross_space_reference").otherwise("mention").alias("link_type"),
        F.lit("elsewhere").alias("target_space_id"), F.lit(False).alias("is_opaque"),
    )
    return V.validate_artifacts(artifacts, refs, sources, links).select("artifact_id", F.array_join("reasons", ",").alias("reasons"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.CONTENT_STOP_WORDS) + "]"


def words_sql(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9''\\-]*'), lambda w: lower(w)), lambda w: not list_contains({STOP_SQL}, w))"


@plan(f"""with c as (select conv_id, string_agg(text, ' ' order by turn) filter (where role = 'user') as a, string_agg(text, ' ' order by turn) filter (where role = 'assistant') as b from conversations group by 1),
w as (select conv_id, a, b, {words_sql('a')} as wa, {words_sql('b')} as wb from c where a is not null and b is not null),
d as (select *, list_sort(list_distinct(wa)) as da, list_sort(list_distinct(wb)) as db from w)
select conv_id, length(a)::bigint as source_chars, length(b)::bigint as compiled_chars, round(length(b) / length(a), 6) as expansion_ratio, len(wa)::bigint as source_words, len(wb)::bigint as compiled_words,
array_to_string(list_filter(da, lambda x: not list_contains(db, x)), ' ') as dropped, array_to_string(list_filter(db, lambda x: not list_contains(da, x)), ' ') as added,
len(list_intersect(da, db))::bigint as kept, round(case when len(da) > 0 then len(list_intersect(da, db)) / len(da) end, 6) as retention from d""")
def vocabulary_loss(spark, sf):
    sides = said_by_role(table(spark, sf, "conversations"))
    pairs = sides.select("conv_id", F.col("user").alias("source_text"), F.col("assistant").alias("compiled_text")).filter("source_text is not null and compiled_text is not null")
    out = V.vocabulary_change(pairs)
    return out.withColumns(
        {
            "expansion_ratio": F.round("expansion_ratio", 6), "retention": F.round("retention", 6),
            "dropped": F.array_join("dropped", " "), "added": F.array_join("added", " "),
        }
    )


@plan("select source as page_id, max_by(doc_id, (n_chars, doc_id)) as doc_id from documents where lang <> 'es' group by 1")
def current_sources(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("page_id"), "doc_id", F.col("n_chars").alias("updated_at"), F.when(F.col("lang") == "es", F.lit("1999")).alias("stale_at")
    )
    return V.current_source(docs, "doc_id")


@plan("select l_orderkey as page_id, max_by(l_partkey, (l_shipdate, l_linenumber, l_partkey)) as l_partkey from lineitem group by 1")
def latest_version(spark, sf):
    line = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "page_id")
    return latest_per_key(line, ["page_id"], ["l_shipdate", "l_linenumber", "l_partkey"], ["l_partkey"])
