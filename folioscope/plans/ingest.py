"""Registered queries: corpora and question sets as they come in, and what is derived from them first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from folioscope.functions import clock
from folioscope.operators import provenance as V
from folioscope.plans.registry import plan, table
from folioscope.session import scratch_folder
from folioscope.sources import datasets as D


@plan("select doc_id::varchar as doc_id, 'Document ' || doc_id as title, sha256(text) as text_hash from documents")
def corpus_files(spark, sf):
    """Documents written as JSON arrays, a file for each source, and loaded again."""
    folder = scratch_folder(spark, "corpus")
    docs = table(spark, sf, "documents").withColumn("title", F.concat(F.lit("Document "), "doc_id"))
    item = F.struct(F.col("doc_id").cast("string").alias("id"), "title", "text")
    files = docs.groupBy("source").agg(F.to_json(F.collect_list(item)).alias("value"))
    files.repartition("source").write.partitionBy("source").text(folder)
    return D.load_corpus(spark, folder, "id").select("doc_id", "title", F.sha2("text", 256).alias("text_hash"))


@plan("""with c as (select l_orderkey as id, p_partkey as doc, l_linenumber as no, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as place from lineitem join part on p_partkey = l_partkey where l_returnflag = 'R'),
g as (select id, doc, min(place) as place from c group by 1, 2)
select 'musique:' || id || '__o' as sample_id, 'What of ' || id || '?' as question, o_orderpriority || case when o_orderstatus <> o_orderpriority then '|' || o_orderstatus else '' end as answers, string_agg(doc::varchar, ',' order by place) as gold, id::varchar as hop_prefix from g join orders on o_orderkey = id group by all""")
def musique_samples(spark, sf):
    """Orders ask, their lines are paragraphs, returned ones the supporting ones; parts are the corpus."""
    part, line, orders = (table(spark, sf, n) for n in ("part", "lineitem", "orders"))
    title = F.concat_ws(" ", "p_name", "p_partkey")
    corpus = part.select(F.col("p_partkey").cast("string").alias("doc_id"), title.alias("title"), F.col("p_brand").alias("text"))
    cell = F.struct("l_linenumber", "l_partkey", "l_suppkey", title.alias("title"), F.col("p_brand").alias("text"), (F.col("l_returnflag") == "R").alias("is_supporting"))
    held = line.join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.bool_or(F.col("l_returnflag") == "R").alias("any")).filter("any")
    paragraphs = F.transform("cells", lambda c, i: F.struct(i.alias("idx"), c["title"].alias("title"), c["text"].alias("paragraph_text"), c["is_supporting"].alias("is_supporting")))
    steps = F.lit(None).cast("array<struct<id:string,question:string,answer:string,paragraph_support_idx:int>>")
    rows = held.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit("__o")).alias("id"), F.concat(F.lit("What of "), "o_orderkey", F.lit("?")).alias("question"), F.col("o_orderpriority").alias("answer"),
        F.array("o_orderstatus", F.lit("")).alias("answer_aliases"), paragraphs.alias("paragraphs"), steps.alias("question_decomposition"),
    )
    out = D.normalize_musique(rows, corpus)
    return out.select("sample_id", "question", F.array_join("answers", "|").alias("answers"), F.array_join("gold_doc_ids", ",").alias("gold"), "hop_prefix")


@plan("""select 'narrativeqa:' || (conv_id * 1000 + turn) as sample_id, role as question, case when role = text then role else role || '|' || text end as answers, 0 as gold, conv_id as document_id from conversations""")
def narrative_samples(spark, sf):
    """Turns as questions with two references and no gold documents."""
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"), F.col("role").alias("question"), F.array("role", "text", "role").alias("answers"), F.col("conv_id").alias("document_id")
    )
    out = D.normalize_narrativeqa(rows)
    return out.select("sample_id", "question", F.array_join("answers", "|").alias("answers"), F.size("gold_doc_ids").alias("gold"), "document_id")


@plan("""select p_partkey as page_id, 'sha256:' || sha256('{"title":"' || p_name || '","text":"' || p_brand || '","content":"' || p_type || '","images":["' || least(p_size::varchar, p_partkey::varchar) || '","' || greatest(p_size::varchar, p_partkey::varchar) || '"],"attachments":[]}') as content_hash from part""")
def page_hashes(spark, sf):
    """Content hashes do not depend on the order of image fingerprints."""
    images = F.array(F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))
    own = V.page_content_hash(F.col("p_name"), F.col("p_brand"), F.col("p_type"), images, F.array().cast("array<string>"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), own.alias("content_hash"))


@plan("""with w as (select event_type, case when ts >= timestamp '2024-01-14 16:00:00' and ts < timestamp '2024-01-21 16:00:00' then 'this_week' when ts >= timestamp '2024-01-07 16:00:00' and ts < timestamp '2024-01-14 16:00:00' then 'last_week' end as week from events)
select week, event_type, count(*) as n from w where week is not null group by 1, 2""")
def week_events(spark, sf):
    """Events of the week that holds 17 January 2024 and of the one before, weeks from Monday in local time."""
    events = table(spark, sf, "events")
    parts = []
    for name in ("this_week", "last_week"):
        begin, end = clock.week_period(name, datetime(2024, 1, 17, 3))
        parts.append(events.filter(clock.in_range(F.col("ts"), begin, end)).select(F.lit(name).alias("week"), "event_type"))
    return parts[0].unionByName(parts[1]).groupBy("week", "event_type").agg(F.count("*").alias("n"))
