"""Registered queries: recall, fusion, graph expansion, evidence, citations, search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as X
from folioscope.functions import vectors as VEC
from folioscope.functions.fragments import with_highlight
from folioscope.operators import context as CX
from folioscope.operators import retrieve as R
from folioscope.operators import search as SE
from folioscope.operators.paging import top_per_key
from folioscope.plans.registry import plan, table
from folioscope.session import cut_lineage

TERMS = r"list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_./:\-]{{2,}}')), lambda t: regexp_matches(t, '[a-z0-9]'))"
TOKENS = r"regexp_extract_all(lower({0}), '[a-z0-9_./:\-]{{2,}}')"


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", "lang")


def _items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _centroids(spark, sf):
    """Mean vector per label; as many rows as there are labels."""
    flat = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = flat.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return means.groupBy("label").agg(F.transform(ordered, lambda p: p["v"]).alias("query_vec"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("chunk_vec"))


CENTROIDS = """flat as (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings),
means as (select label, i, round(avg(v), 6) as v from flat group by 1, 2), cent as (select label, list(v order by i) as qv from means group by 1)"""
DENSE = f"""{CENTROIDS}, dist as (select cent.label as query_id, vec_id as chunk_id, list_cosine_distance(qv, embedding::double[]) as distance from cent, embeddings),
dense as (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from dist qualify rank <= 20)"""


@plan(f"with {DENSE} select query_id, chunk_id, round(distance, 6) as distance, rank from dense")
def dense_topk(spark, sf):
    queries = _centroids(spark, sf).withColumnRenamed("label", "query_id")
    return VEC.dense_topk(queries, _vectors(spark, sf), 20).withColumn("distance", F.round("distance", 6))


@plan("""select distinct v.vec_id as a_id, w.vec_id as b_id, round(1 - list_cosine_distance(v.embedding::double[], w.embedding::double[]), 6) as similarity
from lineitem join embeddings v on v.vec_id = l_partkey join embeddings w on w.vec_id = l_suppkey""")
def cosine_pairs(spark, sf):
    """Similarity of the vectors that a line of lineitem puts together."""
    emb = table(spark, sf, "embeddings")
    pairs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a_id"), F.col("l_suppkey").alias("b_id")).distinct()
    left = emb.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    right = emb.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return pairs.join(left, "a_id").join(right, "b_id").select(
        "a_id", "b_id", F.round(VEC.cosine_similarity(F.col("a"), F.col("b")), 6).alias("similarity")
    )


TERM_DF = f"""qt as (select item_id as query_id, unnest({TERMS.format('text')}) as term from benchmark),
dt as (select doc_id as chunk_id, unnest({TERMS.format('text')}) as term from documents),
df as (select term, count(*) as df from dt group by 1), total as (select greatest(20, ceil(count(*) * 0.05)) as bound from documents),
classes as (select query_id, term, coalesce(df, 0) as df, coalesce(df, 0) > (select bound from total) as common from qt left join df using (term))"""
LEXICAL = f"""{TERM_DF}, rare as (select * from classes where not common),
need as (select query_id, case when count(*) <= 2 then count(*) else floor(count(*) * 0.75) end as needed from rare group by 1),
cov as (select query_id, chunk_id, count(*) as coverage from rare join dt using (term) group by 1, 2),
good as (select cov.* from cov join need using (query_id) where coverage >= needed),
rs as (select g.query_id, g.chunk_id, coverage, len(list_filter({TOKENS.format('d.text')}, lambda t: list_contains({TERMS.format('b.text')}, t))) / greatest(len({TOKENS.format('d.text')}), 1) as r
 from good g join documents d on d.doc_id = g.chunk_id join benchmark b on b.item_id = g.query_id),
lexical as (select query_id, chunk_id, coverage, coverage + r / (r + 1) as score, row_number() over (partition by query_id order by coverage + r / (r + 1) desc, chunk_id) as rank from rs qualify rank <= 20)"""


@plan(f"with {TERM_DF} select query_id, term, df, common from classes")
def term_df(spark, sf):
    asked = R.with_terms(_items(spark, sf)).select("query_id", F.explode("terms").alias("term"))
    held = R.with_terms(_docs(spark, sf)).select("chunk_id", F.explode("terms").alias("term"))
    return R.term_classes(asked, held, _docs(spark, sf).agg(F.count("*").alias("total")))


@plan(f"with {LEXICAL} select query_id, chunk_id, coverage, round(score, 6) as score, rank from lexical")
def lexical_topk(spark, sf):
    return R.lexical_topk(_items(spark, sf), _docs(spark, sf), 20).withColumn("score", F.round("score", 6))


FIRST_WORD = r"regexp_extract(text, '^\s*(\S+)', 1)"
TITLE = f"""qs as (select item_id as query_id, lower(trim({FIRST_WORD})) as q from benchmark), ts as (select doc_id as chunk_id, regexp_replace(lower(trim(regexp_extract(text, '^[^\\n]*'))), '\\s+', ' ', 'g') as t from documents),
titles as (select query_id, chunk_id, case when t = q then 1.0::double else 0.5::double end as score, row_number() over (partition by query_id order by t = q desc, chunk_id) as rank from qs join ts on q <> '' and starts_with(t, q) qualify rank <= 20)"""


def _title_list(spark, sf):
    queries = _items(spark, sf).select("query_id", F.regexp_extract("text", r"^\s*(\S+)", 1).alias("text"))
    titles = _docs(spark, sf).select("chunk_id", F.regexp_extract("text", r"^[^\n]*", 0).alias("title"))
    return R.title_topk(queries, titles, 20)


@plan(f"with {TITLE} select * from titles")
def title_topk(spark, sf):
    return _title_list(spark, sf)


@plan(r"""with qs as (select distinct regexp_extract(href, '^/([^?#]*)', 1) as query_id from (select unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href from pages) where href like '/%'),
q as (select query_id, regexp_replace(lower(trim(query_id)), '\s+', ' ', 'g') as q from qs), t as (select page_id as chunk_id, regexp_replace(lower(trim(trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')))), '\s+', ' ', 'g') as t from pages)
select query_id, chunk_id, case when t = q then 1.0::double else 0.5::double end as score, row_number() over (partition by query_id order by t = q desc, chunk_id) as rank from q join t on q <> '' and starts_with(t, q) qualify rank <= 8""")
def page_title_topk(spark, sf):
    from folioscope.operators.chunks import internal_links, page_titles

    pages = table(spark, sf, "pages")
    queries = internal_links(pages).select(F.col("slug").alias("query_id")).distinct().withColumn("text", F.col("query_id"))
    titles = page_titles(pages).select(F.col("page_id").alias("chunk_id"), "title")
    return R.title_topk(queries, titles, 8)


def _lists(spark, sf):
    vec = _items(spark, sf).select("query_id", (F.col("query_id") % 10).cast("int").alias("label")).join(
        _centroids(spark, sf), "label"
    )
    dense = VEC.dense_topk(vec.select("query_id", "query_vec"), _vectors(spark, sf), 20)
    lexical = R.lexical_topk(_items(spark, sf), _docs(spark, sf), 20)
    return R.recall_lists(
        R.as_list(dense, "semantic", "distance"),
        R.as_list(lexical, "lexical", "score"),
        R.as_list(_title_list(spark, sf), "exact-title", "score"),
    )


LISTS = f"""{DENSE}, {LEXICAL}, {TITLE},
lists as (select item_id as query_id, chunk_id, 'semantic' as signal, distance as score, rank - 1 as position, 1.0 as weight from benchmark join dense on dense.query_id = item_id % 10
 union all select query_id, chunk_id, 'lexical', score, rank - 1, 0.8 from lexical union all select query_id, chunk_id, 'exact-title', score, rank - 1, 1.2 from titles)"""
FUSED = f"""{LISTS}, fused0 as (select query_id, chunk_id, round(sum(weight / (60 + position + 1)), 12) as fused, bool_or(signal = 'exact-title') as by_title, bool_or(signal = 'semantic') as by_semantic,
 bool_or(signal = 'lexical') as by_lexical, max(score) filter (where signal = 'semantic') as distance, max(score) filter (where signal = 'lexical') as lexical_score from lists group by 1, 2),
fused as (select *, row_number() over (partition by query_id order by fused desc, case when by_title then 3 when by_semantic then 2 else 1 end desc, chunk_id) as rank from fused0 qualify rank <= 40)"""
RELEVANT = "(by_title or (by_lexical and coalesce(lexical_score, 0) > 0) or (by_semantic and coalesce(distance <= {0}, true)))"
ALLOWED = "allowed as (select d.doc_id as chunk_id from documents d left join labels l using (doc_id) where coalesce(toxic, 0) = 0)"


def _fused(spark, sf):
    return R.rrf_fuse(_lists(spark, sf), 40)


def _allowed(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").filter(
        F.coalesce("toxic", F.lit(0)) == 0
    ).select(F.col("doc_id").alias("chunk_id"))


@plan(f"with {FUSED} select query_id, chunk_id, round(fused, 8) as fused, by_title, by_semantic, by_lexical, rank from fused")
def rrf_fused(spark, sf):
    return _fused(spark, sf).select(
        "query_id", "chunk_id", F.round("fused", 8).alias("fused"), "by_title", "by_semantic", "by_lexical", "rank"
    )


TITLE_OF_PAGE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g'))"


def _channel_sql(c: str) -> str:
    """Lists of one channel over docs_<c> for the questions of `asked`."""
    return f"""dt_{c} as (select chunk_id, unnest({TERMS.format('text')}) as term from docs_{c}), df_{c} as (select term, count(*) as df from dt_{c} group by 1),
rare_{c} as (select query_id, term from qt left join df_{c} using (term) where coalesce(df, 0) <= (select greatest(20, ceil(count(*) * 0.05)) from docs_{c})),
need_{c} as (select query_id, case when count(*) <= 2 then count(*) else floor(count(*) * 0.75) end as needed from rare_{c} group by 1),
good_{c} as (select query_id, chunk_id, count(*) as coverage from rare_{c} join dt_{c} using (term) group by 1, 2),
rs_{c} as (select query_id, chunk_id, coverage, len(list_filter({TOKENS.format('d.text')}, lambda t: list_contains({TERMS.format('a.text')}, t))) / greatest(len({TOKENS.format('d.text')}), 1) as r
 from good_{c} join need_{c} using (query_id) join docs_{c} d using (chunk_id) join asked a using (query_id) where coverage >= needed),
titles_{c} as (select chunk_id, regexp_replace(lower(trim(regexp_extract(text, '^[^\\n]*'))), '\\s+', ' ', 'g') as t from docs_{c}),
lists_{c} as (select '{c}' as channel, * from (select query_id, chunk_id, 'lexical' as signal, coverage + r / (r + 1) as score, 0.8 as weight, row_number() over (partition by query_id order by coverage + r / (r + 1) desc, chunk_id) - 1 as position from rs_{c}
 union all select query_id, chunk_id, 'exact-title', case when t = q then 1.0 else 0.5 end, 1.2, row_number() over (partition by query_id order by t = q desc, chunk_id) - 1 from (select query_id, lower(text) as q from asked) join titles_{c} on q <> '' and starts_with(t, q)
 union all select q.vec_id, v.vec_id, 'semantic', list_cosine_distance(q.embedding::double[], v.embedding::double[]), 1.0, row_number() over (partition by q.vec_id order by list_cosine_distance(q.embedding::double[], v.embedding::double[]), v.vec_id) - 1
  from embeddings q join asked on query_id = q.vec_id, embeddings v where v.vec_id in (select chunk_id from docs_{c})) where position < 20)"""


@plan(f"""with asked as (select page_id as query_id, {TITLE_OF_PAGE} as text from pages), qt as (select query_id, unnest({TERMS.format('text')}) as term from asked),
docs_evidence as (select doc_id as chunk_id, text from documents where lang = 'en'), docs_memory as (select doc_id as chunk_id, text from documents where doc_id in (select doc_id from labels)),
{_channel_sql('evidence')}, {_channel_sql('memory')},
hits as (select query_id, chunk_id, round(sum(weight / (61 + position)), 12) as fused, string_agg(distinct channel, ',' order by channel) as channels, string_agg(distinct signal, ',' order by signal) as signals,
 round(sum(weight / (61 + position)) filter (where channel = 'evidence'), 12) as e, round(sum(weight / (61 + position)) filter (where channel = 'memory'), 12) as m, case when bool_or(signal = 'exact-title') then 3 when bool_or(signal = 'semantic') then 2 else 1 end as kind
 from (select * from lists_evidence union all select * from lists_memory) group by 1, 2),
placed as (select *, e is not null and row_number() over (partition by query_id order by e desc nulls last, kind desc, chunk_id) <= 4 or m is not null and row_number() over (partition by query_id order by m desc nulls last, kind desc, chunk_id) <= 2 as sure from hits),
kept as (select * from placed qualify row_number() over (partition by query_id order by sure desc, fused desc, kind desc, chunk_id) <= 12)
select query_id, chunk_id, round(fused, 8) as fused, channels, signals, row_number() over (partition by query_id order by fused desc, kind desc, chunk_id) as rank from kept""")
def recall_channels(spark, sf):
    """Titles of pages ask two channels: English documents are evidence, labelled ones memory."""
    from folioscope.operators.chunks import page_titles

    docs, vectors = _docs(spark, sf), _vectors(spark, sf)
    asked = page_titles(table(spark, sf, "pages")).select(F.col("page_id").alias("query_id"), F.col("title").alias("text"))
    asked_vectors = vectors.select(F.col("chunk_id").alias("query_id"), F.col("chunk_vec").alias("query_vec")).join(asked.select("query_id"), "query_id")
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"))
    tables = {"evidence": docs.filter(F.col("lang") == "en"), "memory": docs.join(labelled, "chunk_id", "left_semi")}
    channels = {
        name: (own, own.select("chunk_id", F.regexp_extract("text", r"^[^\n]*", 0).alias("title")), vectors.join(own.select("chunk_id"), "chunk_id", "left_semi"))
        for name, own in tables.items()
    }
    out = R.recall_channels(asked, asked_vectors, channels, 20, 12, {"evidence": 4, "memory": 2})
    return out.select("query_id", "chunk_id", F.round("fused", 8).alias("fused"), F.array_join("channels", ",").alias("channels"), F.array_join("signals", ",").alias("signals"), F.col("rank").cast("long").alias("rank"))


@plan(f"with {FUSED}, {ALLOWED} select query_id, chunk_id, rank from fused where {RELEVANT.format(0.45)} and chunk_id in (select chunk_id from allowed)")
def gated_authorized(spark, sf):
    return R.authorized(_fused(spark, sf).filter(R.relevant()), _allowed(spark, sf)).select("query_id", "chunk_id", "rank")


@plan(f"""with {FUSED}, strict as (select query_id, chunk_id from fused where by_lexical and coalesce(lexical_score, 0) > 2)
select query_id, chunk_id, 'policy' as mode from strict union all select query_id, chunk_id, 'fallback' from fused where query_id not in (select query_id from strict)""")
def policy_fallback(spark, sf):
    fused = cut_lineage(_fused(spark, sf).select("query_id", "chunk_id", "by_lexical", "lexical_score"))
    scoped = fused.filter(F.col("by_lexical") & (F.coalesce("lexical_score", F.lit(0)) > 2))
    return R.policy_then_fallback(scoped.select("query_id", "chunk_id"), fused.select("query_id", "chunk_id"))


@plan(f"""with {FUSED}, p as (select query_id, source as page_id, max(fused) as weight, bool_or(by_title or coalesce(distance <= 0.4, false)) as strong from fused join documents on doc_id = chunk_id group by 1, 2),
t as (select *, max(weight) over (partition by query_id) as top from p), g as (select *, row_number() over (partition by query_id order by weight desc, page_id) as rank from t where strong and weight >= top * 0.5 qualify rank <= 3)
select query_id, page_id, round(weight, 8) as weight, rank from g""")
def seed_pages(spark, sf):
    owned = _docs(spark, sf).select("chunk_id", F.col("source").alias("page_id"))
    seeds = R.seed_pages(_fused(spark, sf).drop("rank").join(owned, "chunk_id"))
    return seeds.select("query_id", "page_id", F.round("weight", 8).alias("weight"), "rank")


@plan(f"""with {FUSED}, {ALLOWED}, sel as (select query_id, chunk_id from fused where {RELEVANT.format(0.45)} and chunk_id in (select chunk_id from allowed) and rank <= 8)
select distinct l.query_id, l.chunk_id, case when signal = 'semantic' and score > 0.45 then 'below_threshold' when f.query_id is null or not {RELEVANT.format(0.45)} then 'filtered'
 when l.chunk_id not in (select chunk_id from allowed) then 'unauthorized' else 'rank_limit' end as reason
from lists l left join fused f on f.query_id = l.query_id and f.chunk_id = l.chunk_id where (l.query_id, l.chunk_id) not in (select query_id, chunk_id from sel)""")
def drop_reasons(spark, sf):
    lists = cut_lineage(_lists(spark, sf))
    fused = R.rrf_fuse(lists, 40)
    good = fused.filter(R.relevant())
    ok = R.authorized(good, _allowed(spark, sf))
    candidates = lists.select(
        "query_id", "chunk_id", F.when(F.col("signal") == "semantic", "semantic_distance").otherwise(F.col("signal")).alias("score_type"), "score"
    )
    return R.drop_reasons(candidates, ok.filter(F.col("rank") <= 8), good, ok)


# --- graph expansion: parts are pages, their types the spaces, orders the sources ------------------------


def _graph(spark, sf):
    part, line, orders = (table(spark, sf, n) for n in ("part", "lineitem", "orders"))
    pages = part.select(
        F.col("p_partkey").alias("page_id"), F.col("p_type").alias("space_id"), F.when(F.col("p_size") > 45, F.lit("1999")).alias("stale_at")
    )
    ranked = top_per_key(
        part.select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("page_id"), F.col("p_retailprice").alias("weight")),
        ["query_id"], [F.desc("weight"), F.asc("page_id")], 3,
    )
    seeds = ranked.withColumn("top_weight", F.max("weight").over(Window.partitionBy("query_id")))
    key = F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("link_id")
    links = line.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").select(
        key, F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.col("p_type").alias("space_id"),
        F.when(F.col("l_returnflag") == "N", "catalog_entry").otherwise("mention").alias("link_type"),
        F.lit(False).alias("is_dangling"), F.when(F.col("l_linestatus") == "F", F.lit("1999")).alias("stale_at"),
    ).dropDuplicates(["link_id"])
    link_sources = line.select(key, F.col("l_orderkey").alias("source_id"))
    page_sources = line.select(F.col("l_partkey").alias("page_id"), F.col("l_orderkey").alias("source_id"))
    readable = orders.filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("source_id"))
    return seeds, links, link_sources, pages, page_sources, readable


GRAPH = """seeds as (select p_brand as query_id, p_partkey as page_id, p_retailprice as weight, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank, max(p_retailprice) over (partition by p_brand) as top_weight from part qualify rank <= 3),
live as (select p_partkey as page_id, p_type as space_id from part where p_size <= 45),
readable as (select o_orderkey as source_id from orders where o_orderstatus <> 'P'),
links as (select distinct l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey as link_id, l_partkey as from_id, l_suppkey as to_id, l_orderkey as source_id from lineitem where l_returnflag <> 'N' and l_linestatus <> 'F'),
link_edge as (select s.query_id, link_id as edge_id, from_id, to_id, 'link' as type, max(s.weight) as seed_weight, 1::bigint as sources from links l join seeds s on s.page_id in (l.from_id, l.to_id)
 join live a on a.page_id = from_id join live b on b.page_id = to_id and a.space_id = b.space_id where source_id in (select source_id from readable) group by all),
ps as (select distinct l_partkey as page_id, l_orderkey as source_id from lineitem),
pairs as (select s.query_id, least(a.page_id, b.page_id) as from_id, greatest(a.page_id, b.page_id) as to_id, max(s.weight) as seed_weight, bool_and(a.source_id in (select source_id from readable)) as ok, count(distinct a.source_id) as sources
 from seeds s join ps a on a.page_id = s.page_id join live la on la.page_id = a.page_id join ps b on b.source_id = a.source_id and b.page_id <> a.page_id join live lb on lb.page_id = b.page_id and lb.space_id = la.space_id group by 1, 2, 3),
cand as (select *, 0.7 as type_weight from link_edge union all select query_id, 'shared:' || from_id || ':' || to_id, from_id, to_id, 'shared-source', seed_weight, sources, 0.2 from pairs where ok),
ranked as (select *, row_number() over (partition by query_id, type order by seed_weight desc, edge_id) as type_rank from cand),
edges as (select *, row_number() over (partition by query_id order by type = 'link' and type_rank <= 5 desc, seed_weight desc, type_weight desc, edge_id) as rank from ranked where type <> 'shared-source' or type_rank <= 5 qualify rank <= 20)"""


@plan(f"with {GRAPH} select query_id, edge_id, from_id, to_id, type, sources, rank from edges")
def graph_edges(spark, sf):
    return R.expand_edges(*_graph(spark, sf), 20).select("query_id", "edge_id", "from_id", "to_id", "type", "sources", "rank")


NEIGHBOR = """both_ways as (select query_id, from_id as seed_id, to_id as page_id, type_weight from edges union all select query_id, to_id, from_id, type_weight from edges),
hops as (select b.query_id, b.page_id, max(b.type_weight) as type_weight, max(s.weight / s.top_weight * b.type_weight) as anchor from both_ways b join seeds s on s.query_id = b.query_id and s.page_id = b.seed_id
 where (b.query_id, b.page_id) not in (select query_id, page_id from seeds) group by 1, 2),
neighbors as (select *, row_number() over (partition by query_id order by type_weight desc, page_id) as rank from hops qualify rank <= 32)"""


@plan(f"with {GRAPH}, {NEIGHBOR} select query_id, page_id, round(anchor, 6) as anchor, rank from neighbors")
def graph_neighbors(spark, sf):
    parts = _graph(spark, sf)
    hops = R.neighbor_scores(R.expand_edges(*parts, 20), parts[0], 8)
    return hops.select("query_id", "page_id", F.round("anchor", 6).alias("anchor"), "rank")


@plan(f"""with {GRAPH} select query_id, source_id from seeds join ps using (page_id) union
select s.query_id, l.l_orderkey from (select distinct l_orderkey, l_partkey, l_suppkey from lineitem) l join seeds s on s.page_id in (l.l_partkey, l.l_suppkey)""")
def frontier_sources(spark, sf):
    seeds, links, link_sources, _, page_sources, _ = _graph(spark, sf)
    return R.frontier_sources(seeds, links, link_sources, page_sources)


def _candidates(spark, sf):
    """Direct and graph candidates per brand: price order among the parts of the brand and of its size."""
    part = table(spark, sf, "part")
    rank = lambda name, *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias(name)
    base = part.select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("chunk_id"), "p_retailprice", "p_size", "p_type")
    direct = base.filter(F.col("p_size") > 25).select(
        "query_id", "chunk_id", rank("rank", F.desc("p_retailprice"), "chunk_id"), (F.col("p_type") == "PROMO").alias("by_title")
    )
    graph = base.filter(F.col("p_size") > 10).select("query_id", "chunk_id", rank("rank", "p_retailprice", "chunk_id"))
    return direct, graph


CANDS = """direct as (select p_brand as query_id, p_partkey as chunk_id, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank, p_type = 'PROMO' as by_title from part where p_size > 25),
graph as (select p_brand as query_id, p_partkey as chunk_id, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as rank from part where p_size > 10)"""
RESERVED = f"""{CANDS}, head as (select d.query_id, d.chunk_id, d.rank as position, 'direct' as origin from direct d where d.rank <= 8 - least((select count(*) from graph g where g.query_id = d.query_id), 2)),
tail as (select g.query_id, g.chunk_id, (select count(*) from head h where h.query_id = g.query_id) + row_number() over (partition by g.query_id order by g.rank) as position, 'graph' as origin from graph g where (g.query_id, g.chunk_id) not in (select query_id, chunk_id from head)),
reserved as (select * from head union all select * from tail where position <= 8)"""
WINDOWED = f"""{CANDS}, offers as (select query_id, chunk_id, 0 as turn, 0 as rank, 'direct' as origin from (select query_id, min_by(chunk_id, rank) as chunk_id from direct where by_title group by 1)
 union all select query_id, chunk_id, 1, rank, 'graph' from graph union all select query_id, chunk_id, 2, rank, 'direct' from direct),
once as (select *, row_number() over (partition by query_id, origin order by turn, rank) as nth from (select * from offers qualify row_number() over (partition by query_id, chunk_id, origin order by turn, rank) = 1)),
kept as (select * from once where origin <> 'graph' or nth <= 2 or query_id not in (select query_id from direct) qualify row_number() over (partition by query_id, chunk_id order by turn, rank) = 1),
windowed as (select query_id, chunk_id, origin, row_number() over (partition by query_id order by turn, rank) as position from kept qualify position <= 8)"""


@plan(f"with {RESERVED} select * from reserved")
def merge_reserved(spark, sf):
    direct, graph = _candidates(spark, sf)
    return R.merge_reserved(direct, graph, 8)


@plan(f"with {WINDOWED} select * from windowed")
def window_recall(spark, sf):
    direct, graph = _candidates(spark, sf)
    return R.window_recall_select(graph.withColumn("origin", F.lit("graph")), direct, 8)


@plan(f"""with {RESERVED}, w as (with {WINDOWED} select * from windowed)
select query_id, chunk_id, 'added' as change from w where (query_id, chunk_id) not in (select query_id, chunk_id from reserved)
union all select query_id, chunk_id, 'displaced' from reserved where (query_id, chunk_id) not in (select query_id, chunk_id from w)""")
def compare_modes(spark, sf):
    return R.compare_modes(merge_reserved(spark, sf), window_recall(spark, sf))


@plan(f"""with {FUSED}, pages as (select doc_id as chunk_id, source as page_id, row_number() over (partition by source order by doc_id) * 0.01 as anchor from documents),
near as (select distinct query_id, page_id, anchor from (select query_id, source as page_id, min(doc_id)::double as anchor from fused join documents on doc_id = chunk_id group by 1, 2)),
best as (select f.*, source as page_id, row_number() over (partition by f.query_id, source order by fused desc, case when by_title then 3 when by_semantic then 2 else 1 end desc, f.chunk_id) as n
 from fused f join documents on doc_id = f.chunk_id where {RELEVANT.format(0.55)} and rank > 10)
select b.query_id, b.chunk_id, b.page_id, row_number() over (partition by b.query_id order by anchor desc, fused desc, b.chunk_id) as rank from best b join near using (query_id, page_id) where n = 1""")
def edge_anchored(spark, sf):
    fused = cut_lineage(_fused(spark, sf))
    owned = _docs(spark, sf).select("chunk_id", F.col("source").alias("page_id"))
    rows = fused.join(owned, "chunk_id")
    near = rows.groupBy("query_id", "page_id").agg(F.min("chunk_id").cast("double").alias("anchor"))
    out = R.edge_anchored_select(rows, near, fused.filter(F.col("rank") <= 10))
    return out.select("query_id", "chunk_id", "page_id", "rank")


@plan(f"""with {LISTS}, {GRAPH}, a as (select query_id, count(distinct chunk_id) filter (where signal = 'semantic') as semantic_candidates, count(distinct chunk_id) filter (where signal = 'lexical') as lexical_candidates,
 count(distinct chunk_id) filter (where signal = 'exact-title') as title_candidates, count(distinct chunk_id) as candidates from lists group by 1),
 b as (select regexp_extract(query_id, '[0-9]+')::bigint as query_id, count(*) filter (where type = 'link') as link_edges, count(*) filter (where type = 'shared-source') as shared_edges from edges group by 1)
select query_id, coalesce(semantic_candidates, 0) as semantic_candidates, coalesce(lexical_candidates, 0) as lexical_candidates, coalesce(title_candidates, 0) as title_candidates, coalesce(candidates, 0) as candidates,
 coalesce(link_edges, 0) as link_edges, coalesce(shared_edges, 0) as shared_edges from a full join b using (query_id)""")
def retrieval_diagnostics(spark, sf):
    edges = R.expand_edges(*_graph(spark, sf), 20).withColumn("query_id", F.regexp_extract("query_id", "[0-9]+", 0).cast("long"))
    return R.retrieval_diagnostics(_lists(spark, sf), edges)


TRI = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SIGNALS = "sig as (select distinct p_type as source_id, p_name || 's' as value, p_brand as bkey from part), signals as (select source_id, value, min(bkey) as key, source_id || '/' || value as signal_id from sig group by 1, 2)"
SIMILAR = f"""names as (select distinct p_name as title, {TRI.format('p_name')} as g from part), sg as (select *, {TRI.format('value')} as g from signals),
sims as (select signal_id, title, len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g)) as similarity from sg a, names b where len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g)) >= 0.3),
alike as (select signal_id, p_partkey as page_id, similarity, row_number() over (partition by signal_id order by similarity desc, p_partkey) as rank from sims join part on p_name = title qualify rank <= 8)"""


def _signals(spark, sf):
    return (
        table(spark, sf, "part")
        .groupBy(F.col("p_type").alias("source_id"), F.concat("p_name", F.lit("s")).alias("value"))
        .agg(F.min("p_brand").alias("key"))
        .withColumn("signal_id", F.concat_ws("/", "source_id", "value"))
    )


@plan(f"with {SIGNALS}, {SIMILAR} select signal_id, page_id, round(similarity, 6) as similarity, rank from alike")
def trigram_topk(spark, sf):
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"))
    out = R.trigram_topk(_signals(spark, sf), pages)
    return out.select("signal_id", "page_id", F.round("similarity", 6).alias("similarity"), "rank")


@plan(f"""with {SIGNALS}, {SIMILAR}, body as (select p_partkey as page_id, lower(p_name || 's ' || p_type) as text from part),
fts as (select signal_id, page_id, row_number() over (partition by signal_id order by page_id) as rank from signals join body on len(list_filter(string_split(lower(value), ' '), lambda w: not list_contains(string_split(text, ' '), w))) = 0 qualify rank <= 8),
gen as (select p_type as source_id, p_partkey as page_id, true as e, false as c, false as t, false as f, 0.0::double as s from part where p_retailprice > 1090
 union all select source_id, p_partkey, false, true, false, false, 0 from signals join part on p_brand = key
 union all select source_id, p_partkey, false, false, true, false, 0 from signals join part on lower(p_name) = lower(value)
 union all select source_id, page_id, false, false, false, false, similarity from alike join signals using (signal_id)
 union all select source_id, page_id, false, false, false, true, 0 from fts join signals using (signal_id)),
m as (select source_id, page_id, bool_or(e) as explicit_match, bool_or(c) as canonical_match, bool_or(t) as title_match, bool_or(f) as fts_match, max(s) as similarity from gen group by 1, 2)
select source_id, page_id, explicit_match, canonical_match, title_match, fts_match, round(similarity, 6) as similarity,
row_number() over (partition by source_id order by explicit_match desc, canonical_match desc, title_match desc, similarity desc, fts_match desc, p_type, p_brand, page_id) as rank
from m join part on p_partkey = page_id qualify rank <= 50""")
def catalog_candidates(spark, sf):
    part = table(spark, sf, "part")
    pages = part.select(F.col("p_partkey").alias("page_id"), F.col("p_type").alias("kind"), F.col("p_brand").alias("canonical_key"), F.col("p_name").alias("title"))
    texts = part.select(F.col("p_partkey").alias("page_id"), F.concat("p_name", F.lit("s "), "p_type").alias("text"))
    explicit = part.filter(F.col("p_retailprice") > 1090).select(F.col("p_type").alias("source_id"), F.col("p_partkey").alias("page_id"))
    out = R.catalog_candidates(_signals(spark, sf), pages, texts, explicit, 50)
    return out.select(
        "source_id", "page_id", "explicit_match", "canonical_match", "title_match", "fts_match", F.round("similarity", 6).alias("similarity"), "rank"
    )


# --- evidence, context, citations ----------------------------------------------------------------------


@plan("""with c as (select l_orderkey as child_id, l_suppkey as parent_id, l_linestatus as page_id, l_partkey as source_id, l_returnflag as hash from lineitem),
p as (select distinct l_suppkey as parent_id, l_linestatus as page_id, l_partkey as source_id, l_returnflag as hash from lineitem where l_quantity > 49),
pair as (select distinct child_id, parent_id, page_id from c), want as (select * from pair join p using (parent_id, page_id)),
bad as (select w.child_id, w.parent_id from want w where (child_id, source_id, hash) not in (select child_id, source_id, hash from c))
select distinct child_id, parent_id from want where (child_id, parent_id) not in (select child_id, parent_id from bad)""")
def expandable_parents(spark, sf):
    line = table(spark, sf, "lineitem")
    entry = [F.col("l_linestatus").alias("page_id"), F.col("l_partkey").alias("source_id"), F.lit(1).alias("version"), F.col("l_returnflag").alias("hash")]
    children = line.select(F.col("l_orderkey").alias("child_id"), F.col("l_suppkey").alias("parent_id"), *entry)
    parents = line.filter(F.col("l_quantity") > 49).select(F.col("l_suppkey").alias("parent_id"), *entry).distinct()
    return CX.expandable_parents(children, parents)


def _refs(spark, sf):
    """The whole of every document is cited in ranges of 300 characters that overlap, the first range twice; the last ones leave the text."""
    docs = table(spark, sf, "documents")
    starts = F.concat(F.sequence(F.lit(0), F.length("text"), F.lit(200)), F.array(F.lit(0)))
    spans = F.transform(starts, lambda s: F.struct(s.alias("start"), (s + 300).alias("stop")))
    rows = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("source_id"), "text", "lang", F.inline(spans))
    quoted = X.quote_hash(F.expr("substring(text, start + 1, stop - start)"))
    return rows.select("query_id", "source_id", "start", "stop", F.when(F.col("lang") != "de", quoted).otherwise("sha256:0").alias("quote_hash"))


WINDOWS = "win as (select source as query_id, doc_id as source_id, start, stop, substr(text, start + 1, stop - start) as text from (select *, start + 300 as stop from (select *, unnest(range(0, length(text) + 1, 200)) as start from documents)) where stop <= length(text) and lang <> 'de')"


@plan(f"with {WINDOWS} select query_id, source_id, start, stop, text from win")
def source_windows(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return CX.source_windows(_refs(spark, sf), texts).select("query_id", "source_id", "start", "stop", "text")


EVIDENCE = f"list_filter(list_distinct({TOKENS.format('q')}), lambda t: t not in ('and','are','for','how','the','what','when','where','which','who','why','is'))"
SCORE = r"coalesce(list_sum(list_transform(list_filter({0}, lambda t: contains({1}, t)), lambda t: case when regexp_matches(t, '[/_.:\-]|[a-z]+\d*') then 4 else 1 end)), 0)::bigint"


def _asked(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("query_id")).agg(
        F.min_by("text", "doc_id").alias("text")
    )


ASKED = "asked as (select source as query_id, min_by(text, doc_id) as q from documents group by 1)"


@plan(f"""with {WINDOWS}, {ASKED}, s as (select w.query_id, source_id, start, stop, {SCORE.format(EVIDENCE, 'lower(text)')} as score from win w join asked using (query_id))
select *, row_number() over (partition by query_id, source_id order by score desc, start, stop) as rank from s where score >= 2 qualify rank <= 2""")
def raw_windows(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "text")
    windows = CX.source_windows(_refs(spark, sf), texts)
    return CX.rank_raw_windows(_asked(spark, sf), windows).select("query_id", "source_id", "start", "stop", F.col("score").cast("long").alias("score"), "rank")


@plan(f"""with {ASKED}, rw as (select source as query_id, doc_id as source_id, start, stop, substr(text, start + 1, stop - start) as text from (select *, start + 60 as stop from (select *, unnest(range(0, length(text) + 1, 60)) as start from documents)) where stop <= length(text)),
sc as (select *, {SCORE.format(EVIDENCE, 'lower(text)')} as score from rw join asked using (query_id)), best as (select query_id, source_id, start, stop from sc qualify score = max(score) over (partition by query_id, source_id)),
w as (select source as query_id, doc_id as source_id, start, start + 300 as stop from (select *, unnest(range(0, length(text) + 1, 200)) as start from documents) union select source, doc_id, 0, 60 from documents),
plain as (select * from w except select query_id, source_id, start, stop from rw), m as (select p.*, b.start as rs, b.stop as rp from plain p left join best b on b.query_id = p.query_id and b.source_id = p.source_id and p.start <= b.start and p.stop >= b.stop)
select query_id, source_id, start, stop from w where (query_id, source_id, start, stop) in (select query_id, source_id, start, stop from best)
union select query_id, source_id, coalesce(rs, start), coalesce(rp, stop) from m""")
def table_row_windows(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("source_id"), "text")
    spans = lambda step, size: F.transform(F.sequence(F.lit(0), F.length("text"), F.lit(step)), lambda s: F.struct(s.alias("start"), (s + size).alias("stop")))
    first = F.array(F.struct(F.lit(0).alias("start"), F.lit(60).alias("stop")))
    windows = docs.select("query_id", "source_id", F.inline(F.concat(spans(200, 300), first)))
    rows = docs.select("query_id", "source_id", "text", F.inline(spans(60, 60))).filter(F.col("stop") <= F.length("text"))
    rows = rows.withColumn("text", F.expr("substring(text, start + 1, stop - start)"))
    return CX.narrow_to_table_rows(_asked(spark, sf), windows, rows)


def _context_items(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.col("role").alias("title"), "text"
    )


@plan("""with recursive n as (select conv_id as query_id, row_number() over (partition by conv_id order by turn) as pos, (conv_id * 1000 + turn)::varchar as item_id, length(role) + 2 as ts, length(text) as sz from conversations),
f as (select query_id, 0::bigint as pos, ''::varchar as item_id, 700::bigint as remaining, false as full_up, 0::bigint as used, ''::varchar as disposition, 0::bigint as included from (select distinct query_id from n)
union all select n.query_id, n.pos, n.item_id,
 case when full_up or remaining <= ts + case when used = 0 then 0 else 2 end then remaining else remaining - (ts + 1 + least(sz, greatest(least(300, remaining - ts - case when used = 0 then 0 else 2 end - 1), 0)) + case when used = 0 then 0 else 2 end) end,
 full_up or remaining <= ts + case when used = 0 then 0 else 2 end, used + case when full_up or remaining <= ts + case when used = 0 then 0 else 2 end then 0 else 1 end,
 case when full_up or remaining <= ts + case when used = 0 then 0 else 2 end then 'omitted' when least(300, remaining - ts - case when used = 0 then 0 else 2 end - 1) < sz then 'clipped' else 'included' end,
 case when full_up or remaining <= ts + case when used = 0 then 0 else 2 end then 0 else least(sz, greatest(least(300, remaining - ts - case when used = 0 then 0 else 2 end - 1), 0)) end
from f join n on n.query_id = f.query_id and n.pos = f.pos + 1)
select query_id, pos as position, item_id, disposition, included from f where pos > 0""")
def context_packing(spark, sf):
    return CX.pack_context(_context_items(spark, sf), budget=700, per_item=300)


@plan()
def context_text(spark, sf):
    items = _context_items(spark, sf)
    return CX.context_text(items, CX.pack_context(items, budget=700, per_item=300))


@plan("""with k as (select conv_id as query_id, turn as chunk_id, role as page_id, ceil(length(text) / 4)::bigint as tokens, 'included' as state from conversations where role <> 'user'),
d as (select conv_id as query_id, turn as chunk_id, role as page_id, 0::bigint as tokens, min(case when length(text) > 200 then 'rank_limit' else 'filtered' end) as state from conversations where turn < 6 group by 1, 2, 3)
select * from k union all select * from d where (query_id, chunk_id, page_id) not in (select query_id, chunk_id, page_id from k)""")
def context_observation(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_id"), F.col("role").alias("page_id"), "text"
    )
    drops = rows.filter(F.col("chunk_id") < 6).withColumn("reason", F.when(F.length("text") > 200, "rank_limit").otherwise("filtered"))
    return CX.context_observation(rows.filter(F.col("page_id") != "user"), drops)


def _answers(spark, sf):
    """Each order is an answer that cites the parts of its lines."""
    mark = F.concat(F.lit("say "), F.col("l_linenumber").cast("string"), F.lit("  [[cite:p"), F.col("l_partkey").cast("string"), F.lit("]] \n"))
    # the lines of one order are few
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "N", mark).otherwise("none"))), "").alias("answer")
    )


@plan("""with a as (select distinct l_orderkey as query_id, 'p' || l_partkey as source_id from lineitem where l_returnflag <> 'N'), c as (select distinct l_orderkey as query_id, 'p' || l_partkey as source_id from lineitem),
w as (select l_orderkey as query_id, 'p' || l_partkey as source_id, least(count(distinct (l_linenumber, l_suppkey)), 2) as excerpts from lineitem where l_quantity > 10 group by 1, 2)
select c.query_id, c.source_id, excerpts from c join a using (query_id, source_id) join w using (query_id, source_id)""")
def used_citations(spark, sf):
    line = table(spark, sf, "lineitem")
    source = F.concat(F.lit("p"), "l_partkey").alias("source_id")
    windows = line.filter(F.col("l_quantity") > 10).select(
        F.col("l_orderkey").alias("query_id"), source, F.col("l_linenumber").alias("start"), F.col("l_suppkey").alias("stop"),
        F.lit("q").alias("quote_hash"), F.col("l_linenumber").alias("rank"),
    )
    return CX.used_citations(_answers(spark, sf), line.select(F.col("l_orderkey").alias("query_id"), source), windows)


@plan(r"""with a as (select l_orderkey as query_id, array_to_string(list_sort(list(case when l_returnflag <> 'N' then 'say ' || l_linenumber || '  [[cite:p' || l_partkey || e']] \n' else 'none' end)), '') as answer from lineitem group by 1)
select query_id, trim(regexp_replace(regexp_replace(regexp_replace(answer, '\[\[cite:([^\]\s]+)\]\]', '', 'g'), '[ \t]{2,}', ' ', 'g'), '[ \t]+\n', e'\n', 'g')) as answer from a""")
def stripped_answers(spark, sf):
    return _answers(spark, sf).select("query_id", CX.strip_citations(F.col("answer")).alias("answer"))


@plan(r"""with raw as (select conv_id, turn, role, text from conversations)
select conv_id, turn, case role when 'user' then 'knowledge' when 'assistant' then 'general' else 'no_match' end as mode,
 case role when 'assistant' then ltrim(text, e' \t\r\n') when 'system' then ltrim(text, e' \t\r\n') when 'user' then text end as content, case role when 'assistant' then 'no hits for ' || turn end as reason from raw""")
def answer_modes(spark, sf):
    turns = table(spark, sf, "conversations")
    raw = (
        F.when(F.col("role") == "assistant", F.concat(F.lit("  [[answer:general]] <general_reason>no  hits\nfor "), F.col("turn"), F.lit("</general_reason>\n"), "text"))
        .when(F.col("role") == "system", F.concat(F.lit("[[knowledge:no_match]]\n"), "text"))
        .otherwise(F.col("text"))
    )
    mode, content, reason = CX.parse_answer(F.col("raw"))
    return turns.withColumn("raw", raw).select("conv_id", "turn", mode.alias("mode"), content.alias("content"), reason.alias("reason"))


def _images(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("page_id"), X.stable_uuid(F.col("p_partkey").cast("string")).alias("attachment_id"),
        F.when(F.col("p_size") > 5, F.col("p_name")).alias("alt"), F.concat(F.lower("p_type"), F.lit(" "), "p_name").alias("caption"), F.col("p_size").alias("ordinal"),
    )


UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-4' || substr({0}, 14, 3) || '-' || printf('%02x', (('0x' || substr({0}, 17, 2))::int & 63) | 128) || substr({0}, 19, 2) || '-' || substr({0}, 21, 12)"
CITED = f"""img as (select p_partkey as page_id, {UUID.format('sha256(p_partkey::varchar)')} as attachment_id, case when p_size > 5 then p_name end as alt, lower(p_type) || ' ' || p_name as caption, p_size as ordinal, p_name from part),
cit as (select l_orderkey as query_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as position, l_partkey as page_id, l_returnflag, p_name, attachment_id,
 lower('about ' || l_linestatus || chr(10) || case when l_returnflag = 'A' then '附件 ID: ' || upper(attachment_id) when l_returnflag = 'N' then 'see the ' || p_name else 'nothing' end) as mt from lineitem join img on page_id = l_partkey)"""


@plan(rf"""with {CITED}, strong as (select query_id, position, attachment_id, 0 as kind, null::int as score, ordinal from cit join img using (page_id, attachment_id) where l_returnflag = 'A'),
w as (select query_id, position, i.attachment_id, list_filter(list_distinct(regexp_extract_all(mt, '[a-z0-9_./:\-]{{2,}}')), lambda t: t not in ('and','are','for','how','the','what','when','where','which','who','why')) as terms,
 lower(coalesce(alt, '')) as alt, lower(caption) as caption, regexp_replace(mt, '\s+', ' ', 'g') as flat, ordinal from cit c join img i using (page_id) where l_returnflag <> 'A'),
s as (select *, (len(list_filter(terms, lambda t: contains(alt, t))) * 2 + len(list_filter(terms, lambda t: contains(caption, t))) + case when alt <> '' and contains(flat, alt) then 3 else 0 end
 + case when len(list_filter(terms, lambda t: contains(alt, t) and (regexp_matches(t, '[_/.:\-]') or (regexp_matches(t, '[a-z]') and regexp_matches(t, '[0-9]'))))) > 0 then 1 else 0 end)::int as score from w),
weak as (select query_id, position, attachment_id, 1 as kind, score, ordinal from s where score >= 3 qualify row_number() over (partition by query_id, position order by score desc, ordinal, attachment_id) = 1),
allm as (select * from strong union all select * from weak), once as (select * from allm qualify row_number() over (partition by query_id, attachment_id order by kind, position, score desc nulls first, ordinal) = 1)
select query_id, position, attachment_id, kind, score, row_number() over (partition by query_id order by kind, position, score desc nulls first, ordinal, attachment_id) as rank from once qualify rank <= 6""")
def citation_images(spark, sf):
    images = _images(spark, sf)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    line = table(spark, sf, "lineitem").withColumn("position", F.row_number().over(order))
    named = line.join(images.select(F.col("page_id").alias("l_partkey"), "attachment_id", F.substring(F.col("caption"), 1, 200).alias("_c")).hint("shuffle_hash"), "l_partkey").join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name").hint("shuffle_hash"), "l_partkey"
    )
    evidence = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("附件 ID: "), F.upper("attachment_id")))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("see the "), "p_name"))
        .otherwise("nothing")
    )
    citations = named.select(
        F.col("l_orderkey").alias("query_id"), "position", F.col("l_partkey").alias("page_id"),
        F.concat(F.lit("about "), "l_linestatus").alias("answer"), evidence.alias("evidence"),
    )
    return CX.citation_images(citations, images).select("query_id", "position", "attachment_id", "kind", "score", "rank")


# --- search --------------------------------------------------------------------------------------------

FOLD = "replace(lower(strip_accents({0})), 'ß', 'ss')"
SEARCH_TOKENS = r"regexp_extract_all({0}, '[a-z0-9_./:\-]{{2,}}')"


def _searchable(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("title"), "text", F.col("lang").alias("space_id"),
        F.when(F.col("lang") == "es", F.lit("1999")).alias("deleted_at"), (F.col("doc_id") % 2).alias("creator_id"), F.col("n_chars").alias("updated_at"),
    )


SEARCH_HITS = """h as (select *, (len(list_filter(['uber'], lambda q: list_contains(tt, q))) + (len(list_filter(tt, lambda t: starts_with(t, 'die'))) > 0)::int) as ht, (len(list_filter(['uber'], lambda q: list_contains(xt, q))) + (len(list_filter(xt, lambda t: starts_with(t, 'die'))) > 0)::int) as hx from d),
r as (select page_id, round((ht * 1.0 + hx * 0.4) / 2, 6)::double as score from h where greatest(ht, hx) = 2 or contains(fx, 'uber die'))"""
SEARCH_DOCS = rf"select doc_id as page_id, source as title, text, {SEARCH_TOKENS.format(FOLD.format('source'))} as tt, {SEARCH_TOKENS.format(FOLD.format('text'))} as xt, {FOLD.format('text')} as fx from documents where lang <> 'es'"


@plan(rf"""with d as ({SEARCH_DOCS}), {SEARCH_HITS},
{ALLOWED}, a as (select * from r where page_id in (select chunk_id from allowed)), v as (select * from a order by score desc, page_id limit 50)
select page_id, score, source as title, (select count(*) from a) as total from v join documents on doc_id = page_id""")
def search_pages(spark, sf):
    """Two words apart, with an accent, in the texts one reader may see."""
    visible = _allowed(spark, sf).withColumnRenamed("chunk_id", "page_id")
    return SE.search_pages(_searchable(spark, sf), "über die", visible).select("page_id", "score", "title", "total")


@plan(rf"""with d as ({SEARCH_DOCS} and lang = 'de' and doc_id % 2 = 0 and n_chars >= 200 and n_chars < 40000 and doc_id in (select doc_id from labels where quality = 1)), {SEARCH_HITS.replace("'uber die')", "'uber, die')")},
{ALLOWED}, a as (select * from r where page_id in (select chunk_id from allowed)), v as (select * from a order by score desc, page_id limit 50)
select page_id, score, (select count(*) from a) as total from v""")
def search_filters(spark, sf):
    """The same within a space, of one creator, changed in a span of time, among the pages of a label."""
    visible = _allowed(spark, sf).withColumnRenamed("chunk_id", "page_id")
    labelled = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("page_id"))
    found = SE.search_pages(
        _searchable(spark, sf), "Über, die", visible, space_id="de", creator_id=0, modified_from=200, modified_to=40000, page_ids=labelled
    )
    return found.select("page_id", "score", "total")


HIGHLIGHT_TERMS, HIGHLIGHT_WORDS = ["haben", "the", "of", "entr"], 10


def _fragment_rounds(rounds: int) -> str:
    """One round of SQL for each fragment: windows that hits open, the best of them, and the words it shows."""
    out = "chosen0 as (select doc_id, 0::bigint as first, 0::bigint as last from documents where false)"
    for n in range(rounds):
        out += f""",
open{n} as (select h.*, (select count(*) from chosen{n} c where c.doc_id = h.doc_id and c.first <= h.place) as gap from hits h where not exists (select 1 from chosen{n} c where c.doc_id = h.doc_id and h.place between c.first and c.last)),
firsts{n} as (select a.doc_id, a.place, b.term, min(b.place) as at_ from open{n} a join open{n} b on a.doc_id = b.doc_id and a.gap = b.gap and b.place between a.place and a.place + {HIGHLIGHT_WORDS - 1} group by all),
best{n} as (select doc_id, place, max(at_) - place as needed from firsts{n} group by 1, 2 qualify row_number() over (partition by doc_id order by count(*) desc, max(at_) - place, place) = 1),
edge{n} as (select b.*, coalesce((select max(last) from chosen{n} c where c.doc_id = b.doc_id and c.last < b.place), -1) as l, coalesce((select min(first) from chosen{n} c where c.doc_id = b.doc_id and c.first > b.place), s.n) as r from best{n} b join sizes s using (doc_id)),
start{n} as (select doc_id, r, greatest(least(place - ({HIGHLIGHT_WORDS - 1} - needed) // 2, r - {HIGHLIGHT_WORDS}), l + 1) as first from edge{n}),
chosen{n + 1} as (select * from chosen{n} union all select doc_id, first, least(first + {HIGHLIGHT_WORDS - 1}, r - 1) from start{n})"""
    return out


@plan(rf"""with w0 as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as w from documents), sizes as (select doc_id, len(w) as n from w0),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as place from w0),
marked as (select *, list_min(list_transform(range(1, {len(HIGHLIGHT_TERMS) + 1}), lambda i: case when list_contains(own, {HIGHLIGHT_TERMS}[i]) or (i = {len(HIGHLIGHT_TERMS)} and len(list_filter(own, lambda x: starts_with(x, '{HIGHLIGHT_TERMS[-1]}'))) > 0) then i end)) as term
 from (select *, regexp_extract_all(lower(strip_accents(replace(word, 'ß', 'ss'))), '[a-z0-9_./:\-]{{2,}}') as own from words)),
hits as (select doc_id, place, term from marked where term is not null), {_fragment_rounds(3)},
shown as (select c.doc_id, c.first, string_agg(case when term is null then word else '<b>' || word || '</b>' end, ' ' order by place) as fragment from chosen3 c join marked m on m.doc_id = c.doc_id and m.place between c.first and c.last group by 1, 2)
select doc_id as page_id, coalesce((select string_agg(fragment, ' ... ' order by first) from shown s where s.doc_id = w0.doc_id), array_to_string(w[1:{HIGHLIGHT_WORDS}], ' ')) as highlight from w0""")
def highlights(spark, sf):
    """Three fragments of every document for a query of four words."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return with_highlight(docs, "text", " ".join(HIGHLIGHT_TERMS)).select("page_id", "highlight")


@plan(f"""with {ALLOWED} select p_partkey as attachment_id, p_name as file_name from part where contains(lower(p_name), 'ring') and p_type <> 'PROMO' and p_partkey in (select chunk_id from allowed) order by p_name, p_partkey limit 25""")
def search_attachments(spark, sf):
    files = table(spark, sf, "part").select(
        F.col("p_partkey").alias("attachment_id"), F.col("p_partkey").alias("page_id"), F.col("p_name").alias("file_name"),
        F.col("p_type").alias("text"), F.when(F.col("p_type") == "PROMO", F.lit("1999")).alias("deleted_at"),
    )
    visible = _allowed(spark, sf).withColumnRenamed("chunk_id", "page_id")
    return SE.search_attachments(files, "RING", visible).select("attachment_id", "file_name")


@plan("""select * from (select 'user' as kind, s_suppkey::varchar as id, s_name as name from supplier where contains(lower(s_name), '001') order by s_name, s_suppkey limit 5)
union all select * from (select 'group', n_nationkey::varchar, n_name from nation where contains(lower(n_name), '1') order by n_name limit 5)
union all select * from (select 'page', p_partkey::varchar, p_name from part where contains(lower(p_name), 'ring') order by case when p_brand = 'Brand#7' then 0 else 1 end, p_name, p_partkey limit 10)""")
def suggestions(spark, sf):
    users = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    groups = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("space_id"))
    return (
        SE.suggest("user", users, "001", 5)
        .unionByName(SE.suggest("group", groups, "1", 5))
        .unionByName(SE.suggest("page", pages, "ring", 10, "Brand#7"))
    )
