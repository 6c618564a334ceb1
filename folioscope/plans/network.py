"""Registered queries: knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.operators import graph as G
from folioscope.plans.registry import plan, table
from folioscope.session import cut_lineage

KINDS = {"ECONOMY": "entity", "STANDARD": "concept", "PROMO": "source_summary"}


def _pages(spark, sf):
    """Parts with their last shipment as update time."""
    part, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    newest = line.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("updated_at"))
    kinds = F.create_map(*[F.lit(v) for pair in KINDS.items() for v in pair])
    return part.join(newest, "p_partkey").select(
        F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), "updated_at",
        F.coalesce(kinds[F.col("p_type")], F.lit("comparison")).alias("page_type"), F.lit(None).cast("string").alias("stale_at"),
    )


def _owned(spark, sf):
    return table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "A").select(
        F.col("l_partkey").alias("page_id"), F.col("l_orderkey").alias("source_id")
    )


def _readable(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_totalprice") > 12000).select(F.col("o_orderkey").alias("source_id"))


def _links(spark, sf):
    line = table(spark, sf, "lineitem").filter(F.col("l_quantity") > 46)
    return line.select(
        F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey").alias("link_id"), F.col("l_partkey").alias("from_id"),
        (F.col("l_suppkey") * 7 + F.col("l_linenumber")).alias("to_id"), F.lit(False).alias("is_dangling"),
        F.when(F.col("l_returnflag") == "N", "catalog_entry").otherwise("mention").alias("link_type"),
    )


NODES = """newest as (select l_partkey, max(l_shipdate) as updated_at from lineitem group by 1),
owned as (select distinct l_partkey as page_id, l_orderkey as source_id from lineitem where l_returnflag = 'A'),
good as (select page_id from owned group by 1 having bool_and(source_id in (select o_orderkey from orders where o_totalprice > 12000))),
nodes as (select p_partkey as page_id, case p_type when 'ECONOMY' then 'entity' when 'STANDARD' then 'concept' when 'PROMO' then 'source_summary' else 'comparison' end as page_type
 from part join newest on l_partkey = p_partkey where p_partkey in (select page_id from good)),
edges as (select l_orderkey || '.' || l_linenumber || '.' || l_partkey as link_id, l_partkey as from_id, l_suppkey * 7 + l_linenumber as to_id from lineitem where l_quantity > 46 and l_returnflag <> 'N'
 and l_partkey in (select page_id from nodes) and l_suppkey * 7 + l_linenumber in (select page_id from nodes)),
around as (select from_id as node, to_id as other from edges where from_id <> to_id union select to_id, from_id from edges where from_id <> to_id),
deg as (select node, count(*) as degree from around group by 1)"""


def _view(spark, sf):
    nodes = G.graph_nodes(_pages(spark, sf), _owned(spark, sf), _readable(spark, sf), None)
    links = _links(spark, sf)
    return nodes, G.graph_edges(links, nodes, links.select("link_id"))


@plan(f"with {NODES} select page_id, page_type from nodes")
def graph_nodes(spark, sf):
    return _view(spark, sf)[0].select("page_id", "page_type")


@plan(f"with {NODES} select * from edges")
def graph_links(spark, sf):
    return _view(spark, sf)[1].select("link_id", "from_id", "to_id")


@plan(f"""with {NODES}, typed as (select from_id, to_id, case when from_id % 3 = 0 then 'contains' else 'link' end as type from edges),
ends as (select from_id as node, type from typed union all select to_id, type from typed) select node, count(*) as degree, count(*) filter (where type <> 'contains') as relation_degree from ends group by 1""")
def graph_degrees(spark, sf):
    edges = _view(spark, sf)[1].withColumn("type", F.when(F.col("from_id") % 3 == 0, "contains").otherwise("link"))
    return G.degrees(edges)


@plan(f"""with {NODES}, pairs as (select distinct l_partkey as a, l_suppkey as b from lineitem),
c as (select a, b, sum(1 / ln(greatest(degree, 2))) as score from pairs join around x on x.node = a join around y on y.node = b and y.other = x.other join deg on deg.node = x.other group by 1, 2)
select a, b, round(score, 6) as score from c""")
def adamic_adar(spark, sf):
    pairs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return G.adamic_adar(pairs, _view(spark, sf)[1]).withColumn("score", F.round("score", 6))


CANDIDATES = f"""{NODES}, ps as (select * from owned where page_id in (select page_id from nodes)),
sh as (select x.page_id as a, y.page_id as b, count(*) as shared from ps x join ps y on x.source_id = y.source_id and x.page_id < y.page_id group by 1, 2),
ln_ as (select x.other as a, y.other as b, sum(1 / ln(greatest(degree, 2))) as aa from around x join around y on x.node = y.node and x.other < y.other join deg on deg.node = x.node group by 1, 2),
aff(x, y, v) as (values ('entity','entity',0.8),('entity','concept',1.2),('entity','source_summary',1.0),('entity','comparison',1.0),('concept','concept',0.8),('concept','source_summary',1.0),
 ('concept','comparison',1.2),('source_summary','source_summary',0.5),('source_summary','comparison',1.0),('comparison','comparison',0.8)),
cands as (select a, b, coalesce(shared, 0) as shared, coalesce(aa, 0) as aa, round(round(coalesce(shared, 0) * 4 + coalesce(aa, 0) * 1.5 + v, 9), 3)::double as score
 from sh full join ln_ using (a, b) join nodes na on na.page_id = a join nodes nb on nb.page_id = b join aff on (x = na.page_type and y = nb.page_type) or (x <> y and x = nb.page_type and y = na.page_type))"""


@plan(f"with {CANDIDATES} select a, b, score, case when shared > 0 and aa > 0 then '共享来源 · 共同邻居' when shared > 0 then '共享来源' else '共同邻居' end as label from cands")
def semantic_candidates(spark, sf):
    nodes, edges = _view(spark, sf)
    return G.semantic_candidates(nodes, _owned(spark, sf), edges)


@plan()
def semantic_edges(spark, sf):
    nodes, edges = _view(spark, sf)
    return G.semantic_edges(nodes, _owned(spark, sf), edges)


@plan()
def communities(spark, sf):
    nodes, edges = _view(spark, sf)
    weighted = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit(1.0).alias("weight"))
    return G.communities(nodes, weighted)


@plan(f"""with {NODES} select count(*) as nodes, true as once, true as sizes, true as numbered, true as better, count(*) filter (where page_id not in (select node from around)) as isolated, true as bridges from nodes""")
def communities_hold(spark, sf):
    """What every division into communities must keep: all nodes once, true sizes, numbers by size and smallest member, a modularity above that of
    single nodes. Isolated nodes and bridges are those of the communities found."""
    nodes, edges = _view(spark, sf)
    weighted = cut_lineage(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit(1.0).alias("weight")).filter("a <> b"))
    found = cut_lineage(G.communities(nodes, weighted))
    alone = nodes.select(F.col("page_id").alias("node"), F.col("page_id").alias("community"))
    better = G.modularity(found, weighted) >= G.modularity(alone, weighted)
    sizes = found.groupBy("community").agg(F.max("size").alias("told"), F.min("size").alias("least"), F.count("*").alias("n"), F.min("node").alias("first"))
    right = sizes.agg(F.coalesce(F.bool_and((F.col("told") == F.col("n")) & (F.col("least") == F.col("n"))), F.lit(True)).alias("ok"))
    order = Window.orderBy(F.desc("n"), F.asc("first"))
    numbered = sizes.withColumn("place", F.row_number().over(order)).agg(F.coalesce(F.bool_and(F.col("community") == F.concat(F.lit("community-"), "place")), F.lit(True)).alias("ok"))
    own = found.select(F.col("node").alias("x"), F.col("community").alias("cx"))
    crossing = weighted.join(own.withColumnRenamed("x", "a"), "a").join(own.select(F.col("x").alias("b"), F.col("cx").alias("cy")), "b").filter("cx <> cy")
    ends = crossing.select("a").union(crossing.select("b")).distinct().agg(F.count("*").alias("n"))
    counts = G.insight_counts(nodes, edges, found)
    return found.agg(
        F.count("*").alias("nodes"), (F.count("*") == F.count_distinct("node")).alias("once"), right.scalar().alias("sizes"), numbered.scalar().alias("numbered"),
        F.lit(better).alias("better"), counts.select("isolated").scalar().alias("isolated"), (counts.select("bridges").scalar() == ends.scalar()).alias("bridges"),
    )


@plan(f"""with {NODES}, f as (select node, bool_or(p.p_brand <> q.p_brand) as bridge from around join part p on p.p_partkey = node join part q on q.p_partkey = other group by 1)
select page_id as node, f.node is null as isolated, coalesce(bridge, false) as bridge from nodes left join f on f.node = page_id""")
def graph_insights(spark, sf):
    nodes, edges = _view(spark, sf)
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    return G.graph_insights(nodes, edges, brands)


@plan(r"""with n as (select doc_id as page_id, source as title, text from documents where lang <> 'es'),
s as (select *, trim(regexp_replace(regexp_replace(regexp_replace(text, '^\s*#{1,6}\s+', ''), '[`*_>\[\]]', '', 'g'), '\s+', ' ', 'g')) as flat, trim(regexp_replace(text, '\s+', ' ', 'g')) as squashed from n),
t as (select *, trim(regexp_extract(flat, '^([^。！？.!?]*)', 1)) as sentence from s)
select page_id, case when sentence <> '' then case when length(sentence) > 32 then substr(sentence, 1, 31) || '…' else sentence end else title || ' · 内容' end as title,
 case when length(squashed) > 180 then substr(squashed, 1, 177) || '…' else squashed end as excerpt from t""")
def graph_sections(spark, sf):
    docs = table(spark, sf, "documents").filter(F.col("lang") != "es")
    nodes = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"))
    sections = docs.select(
        F.col("doc_id").alias("page_id"), F.lit(0).alias("section_no"), F.array().cast("array<string>").alias("heading_path"), "text"
    )
    return G.graph_sections(sections, nodes, None).select("page_id", "title", "excerpt")
