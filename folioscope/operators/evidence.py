"""What each metric of a sample was computed from: the operands of its formula beside the rows they were counted on.

Evidence of one sample is one row for each metric. It is as long as what the sample retrieved, cited or answered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import answer_tokens, normalize_answer, strip_notice
from folioscope.operators.evaluate import KS

DOCUMENT = "struct<rank:int,page_id:string,doc_id:string,is_gold:boolean,gain:double>"
SNIPPET = "struct<position:bigint,chunk_id:string,is_graph:boolean,doc_ids:array<string>,gold_doc_ids:array<string>>"


def _marks(gold: DataFrame) -> DataFrame:
    return gold.select("sample_id", "doc_id").distinct().withColumn("is_gold", F.lit(True))


def _golds(gold: DataFrame) -> DataFrame:
    return gold.groupBy("sample_id").agg(F.array_sort(F.collect_set("doc_id")).alias("gold_doc_ids"))


def _or_empty(name: str, kind: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(f"array<{kind}>"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _count(items: Column, test=None) -> Column:
    return F.size(items if test is None else F.filter(items, test)).cast("long")


def document_rows(entries: DataFrame, page_to_doc: DataFrame, gold: DataFrame) -> DataFrame:
    """entries(sample_id, position, page_id) → (sample_id, documents): one array of what was listed, by rank.

    A document stands at its first page; a page without a document keeps its rank and has no doc_id. Entries without a page
    do not count. `gain` is what a gold document adds to the discounted gain.
    """
    keyed = entries.filter(F.col("page_id").isNotNull()).join(page_to_doc, "page_id", "left")
    first = keyed.groupBy("sample_id", "doc_id", F.when(F.col("doc_id").isNull(), F.col("page_id")).alias("alone")).agg(
        F.min(F.struct("position", "page_id")).alias("first")
    )
    marked = first.join(_marks(gold), ["sample_id", "doc_id"], "left")
    cells = F.struct(
        F.col("first.position").alias("position"), F.col("doc_id"), F.col("first.page_id").cast("string").alias("page_id"), F.coalesce("is_gold", F.lit(False)).alias("is_gold")
    )
    ordered = marked.groupBy("sample_id").agg(F.array_sort(F.collect_list(cells)).alias("cells"))
    return ordered.select(
        "sample_id",
        F.transform(
            "cells",
            lambda c, i: F.struct(
                (i + 1).alias("rank"), c["page_id"].alias("page_id"), c["doc_id"].alias("doc_id"), c["is_gold"].alias("is_gold"),
                F.when(c["is_gold"], 1.0 / F.log2(i + 2)).otherwise(0.0).alias("gain"),
            ),
        ).alias("documents"),
    )


def _total(gains: Column) -> Column:
    return F.aggregate(gains, F.lit(0.0), lambda a, g: a + g)


def _cell(metric: str, value: Column, k: int | None = None, **parts: Column) -> Column:
    names = ("numerator", "denominator")
    return F.struct(
        F.lit(metric).alias("metric"), F.lit(k).cast("int").alias("k"), value.cast("double").alias("value"),
        *[parts.get(n, F.lit(None)).cast("double").alias(n) for n in names], *[v.alias(n) for n, v in parts.items() if n not in names],
    )


def retrieval_evidence(
    retrieved: DataFrame, page_to_doc: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS, shown: Callable[[Column], Column] = lambda documents: documents,
) -> DataFrame:
    """(sample_id, metric, k, value, numerator, denominator, gold_doc_ids, documents) for samples with gold documents.

    `documents` are those the metric looked at: the first k, or all; `shown` says how they are given. Numerator and denominator are the operands: gold
    documents found over documents looked at (precision) or wanted (recall), gain over ideal gain (ndcg), one over the first gold rank (mrr), documents
    found over the mean of looked at and wanted (retrieval_f1). What several metrics look at is one row first, so it is counted and shown once.
    """
    rows = _golds(gold).join(document_rows(retrieved, page_to_doc, gold), "sample_id", "left").withColumn("documents", _or_empty("documents", DOCUMENT))
    documents, k, golds = F.col("documents"), F.col("k"), _count(F.col("gold_doc_ids"))
    looks = [F.struct(F.lit(n).cast("int").alias("k"), (documents if n is None else F.slice(documents, 1, n)).alias("documents")) for n in (None, *ks)]
    gold_of = F.filter(documents, lambda d: d["is_gold"])
    ideal = _total(F.transform(F.sequence(F.lit(1), F.least(golds, k).cast("int")), lambda r: 1.0 / F.log2(r + 1)))
    looked = rows.select("sample_id", "gold_doc_ids", F.inline(F.array(*looks))).select(
        "sample_id", "gold_doc_ids", "k", shown(documents).alias("documents"), golds.alias("golds"), _count(documents).alias("shown"), _count(gold_of).alias("found"),
        F.get(gold_of, F.lit(0))["rank"].alias("first"), _total(F.transform(documents, lambda d: d["gain"])).alias("dcg"), F.when(k.isNotNull(), ideal).alias("ideal"),
    )
    golds, count, found, first, dcg, ideal = (F.col(c) for c in ("golds", "shown", "found", "first", "dcg", "ideal"))
    of_all = [
        _cell("mrr", F.coalesce(1.0 / first, F.lit(0.0)), numerator=(found > 0).cast("int"), denominator=first),
        _cell("retrieval_f1", _ratio(2 * found, count + golds), numerator=found, denominator=(count + golds) / 2),
    ]
    of_first = [
        _cell("precision", _ratio(found, count), numerator=found, denominator=count),
        _cell("recall", found / golds, numerator=found, denominator=golds),
        _cell("hit", (found > 0).cast("int"), numerator=found, denominator=F.lit(1)),
        _cell("full_coverage", (found == golds).cast("int"), numerator=found, denominator=golds),
        _cell("ndcg", dcg / ideal, numerator=dcg, denominator=ideal),
    ]
    cells = F.when(k.isNull(), F.array(*[c.dropFields("k") for c in of_all])).otherwise(F.array(*[c.dropFields("k") for c in of_first]))
    return looked.select("sample_id", "gold_doc_ids", "documents", "k", F.inline(cells)).select(
        "sample_id", "gold_doc_ids", "metric", "k", "value", "numerator", "denominator", "documents"
    )


def answer_evidence(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """(sample_id, reference, exact_match, answer_tokens, reference_tokens, shared, shared_tokens, precision, recall, f1): each comparison.

    `shared_tokens` aligns the two token lists: the first occurrence of a token with the first, the second with the second, as far as both go,
    with the places in both (from 0). Without tokens on either side the lists are equal or share nothing.
    """
    pred = predictions.select("sample_id", strip_notice(F.coalesce("prediction", F.lit(""))).alias("p"))
    pairs = pred.join(references.select("sample_id", "reference").distinct(), "sample_id").select(
        "sample_id", "reference", answer_tokens(F.col("p")).alias("a"), answer_tokens(F.col("reference")).alias("b"),
        (normalize_answer(F.col("p")) == normalize_answer(F.col("reference"))).alias("exact_match"), F.xxhash64("reference").alias("ref"),
    )
    places = lambda side: pairs.select("sample_id", "ref", F.lit(side).alias("side"), F.posexplode(side).alias("at", "token"))
    at = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("at"))))
    tokens = places("a").unionByName(places("b")).groupBy("sample_id", "ref", "token").agg(at("a").alias("x"), at("b").alias("y"))
    both = tokens.withColumn("n", F.least(F.size("x"), F.size("y"))).filter("n > 0")
    aligned = F.transform(
        F.arrays_zip(F.slice("x", 1, F.col("n")).alias("x"), F.slice("y", 1, F.col("n")).alias("y")),
        lambda z: F.struct(z["x"].alias("answer_at"), z["y"].alias("reference_at"), F.col("token")),
    )
    shared = both.select("sample_id", "ref", aligned.alias("s")).groupBy("sample_id", "ref").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("shared_tokens"))
    joined = pairs.join(shared, ["sample_id", "ref"], "left").withColumn(
        "shared_tokens", _or_empty("shared_tokens", "struct<answer_at:int,reference_at:int,token:string>")
    )
    n, a, b = (_count(F.col(c)) for c in ("shared_tokens", "a", "b"))
    return joined.select(
        "sample_id", "reference", "exact_match", a.alias("answer_tokens"), b.alias("reference_tokens"), n.alias("shared"), "shared_tokens",
        _ratio(n, a).alias("precision"), _ratio(n, b).alias("recall"),
        F.when((a == 0) | (b == 0), (a == b).cast("double")).otherwise(_ratio(2 * n, a + b)).alias("f1"),
    )


def citation_evidence(
    citations: DataFrame, retrieved: DataFrame, gold: DataFrame, page_to_doc: DataFrame, excerpts: DataFrame | None = None,
) -> DataFrame:
    """(sample_id, metric, k, value, numerator, denominator, documents, retrieved, difference, excerpts).

    Both lists hold ranked documents; pages without a document are shown but count nowhere. `difference`: what was retrieved and not cited
    (for uncited_gold_count its gold ones), null for the other metrics. excerpts(sample_id, page_id, excerpt): cited passages, by page.
    """
    listed = document_rows(citations, page_to_doc, gold).withColumnRenamed("documents", "cited")
    rows = listed.join(document_rows(retrieved, page_to_doc, gold).withColumnRenamed("documents", "retrieved"), "sample_id", "full").join(_golds(gold), "sample_id", "full")
    texts = "struct<page_id:string,text:string>"
    if excerpts is None:
        rows = rows.withColumn("excerpts", F.lit(None))
    else:
        kept = excerpts.filter(F.col("page_id").isNotNull() & (F.coalesce("excerpt", F.lit("")) != ""))
        rows = rows.join(kept.groupBy("sample_id").agg(F.array_sort(F.collect_set(F.struct(F.col("page_id").cast("string").alias("page_id"), F.col("excerpt").alias("text")))).alias("excerpts")), "sample_id", "left")
    rows = rows.select(
        "sample_id", _or_empty("cited", DOCUMENT).alias("documents"), _or_empty("retrieved", DOCUMENT).alias("retrieved"),
        F.size(_or_empty("gold_doc_ids", "string")).alias("golds"), F.coalesce("excerpts", F.array().cast(f"array<{texts}>")).alias("excerpts"),
    )
    mapped = lambda docs: F.filter(docs, lambda d: d["doc_id"].isNotNull())
    gold_of = lambda docs: F.filter(docs, lambda d: d["is_gold"])
    cited = mapped(F.col("documents"))
    left = F.filter(mapped(F.col("retrieved")), lambda d: ~F.array_contains(F.transform(cited, lambda c: c["doc_id"]), d["doc_id"]))
    rows = rows.withColumns({"uncited": left, "hits": _count(gold_of(cited)), "shown": _count(cited)})
    none, uncited = F.lit(None).cast(f"array<{DOCUMENT}>"), F.col("uncited").cast(f"array<{DOCUMENT}>")
    cells = [
        _cell("citation_precision", _ratio(F.col("hits"), F.col("shown")), numerator=F.col("hits"), denominator=F.col("shown"), difference=none),
        _cell("citation_recall", _ratio(F.col("hits"), F.col("golds")), numerator=F.col("hits"), denominator=F.col("golds"), difference=none),
        _cell("uncited_count", _count(uncited), numerator=_count(uncited), difference=uncited),
        _cell("uncited_gold_count", _count(gold_of(uncited)), numerator=_count(gold_of(uncited)), difference=gold_of(uncited)),
    ]
    return rows.select("sample_id", "documents", "retrieved", "excerpts", F.inline(F.array(*cells)))


def graph_evidence(snippets: DataFrame, gold: DataFrame, page_to_doc: DataFrame) -> DataFrame:
    """(sample_id, metric, k, value, numerator, denominator, exclusive_gold_doc_ids, snippets) for samples with gold documents.

    snippets(sample_id, position, chunk_id, origin, page_id), one row per source window. A snippet shows the documents of its windows. A gold document is
    exclusive if some chunk shows it through the graph and never otherwise.
    """
    rows = snippets.join(page_to_doc, "page_id", "left").join(_marks(gold), ["sample_id", "doc_id"], "left")
    rows = rows.withColumn("graph", F.coalesce(F.col("origin") == "graph", F.lit(False)))
    shown = rows.groupBy("sample_id", "position").agg(
        F.min("chunk_id").cast("string").alias("chunk_id"), F.bool_or("graph").alias("is_graph"),
        F.array_sort(F.collect_set("doc_id")).alias("doc_ids"), F.array_sort(F.collect_set(F.when(F.col("is_gold"), F.col("doc_id")))).alias("gold_doc_ids"),
    )
    cells = F.struct(F.col("position").cast("long").alias("position"), "chunk_id", "is_graph", "doc_ids", "gold_doc_ids")
    listed = shown.groupBy("sample_id").agg(F.array_sort(F.collect_list(cells)).alias("snippets"))
    ways = rows.filter("is_gold").groupBy("sample_id", "chunk_id", "doc_id").agg(F.bool_and("graph").alias("only"))
    alone = ways.filter("only").groupBy("sample_id").agg(F.array_sort(F.collect_set("doc_id")).alias("exclusive_gold_doc_ids"))
    joined = _golds(gold).join(listed, "sample_id", "left").join(alone, "sample_id", "left").select(
        "sample_id", F.size("gold_doc_ids").alias("golds"), _or_empty("snippets", SNIPPET).alias("snippets"), _or_empty("exclusive_gold_doc_ids", "string").alias("exclusive_gold_doc_ids")
    )
    graph = F.filter("snippets", lambda s: s["is_graph"])
    docs = lambda name: _count(F.array_distinct(F.flatten(F.transform(graph, lambda s: s[name]))))
    gold_shown = _count(F.filter(graph, lambda s: F.size(s["gold_doc_ids"]) > 0))
    alone = _count(F.col("exclusive_gold_doc_ids"))
    found = [
        _cell("graph_neighbor_gold_snippets", gold_shown, numerator=gold_shown),
        _cell("graph_neighbor_precision", _ratio(docs("gold_doc_ids"), docs("doc_ids")), numerator=docs("gold_doc_ids"), denominator=docs("doc_ids")),
        _cell("graph_exclusive_gold_share", alone / F.col("golds"), numerator=alone, denominator=F.col("golds")),
    ]
    return joined.select("sample_id", "snippets", "exclusive_gold_doc_ids", F.inline(F.array(*found)))


def judge_evidence(verdicts: DataFrame) -> DataFrame:
    """verdicts(.., kind, verdict) with numerator, denominator, grade and value: what the score of a recorded verdict was made of.

    Supported of all claims, useful of all passages, the grade in words, or the similarity before it is held to 0 .. 1. Unreadable verdicts have
    neither operands nor a value.
    """
    schema = "struct<claims:array<struct<verdict:string>>,passages:array<struct<useful:boolean>>,verdict:string,similarity:double>"
    v, kind = F.from_json("verdict", schema), F.col("kind")
    claims, passages = v["claims"], v["passages"]
    of = lambda name, value: F.when(kind == name, value)
    numerator = F.coalesce(
        of("faithfulness", _count(claims, lambda c: c["verdict"] == "supported")), of("context_relevancy", _count(passages, lambda p: p["useful"])),
        of("answer_correctness", F.when(v["verdict"] == "correct", 1.0).when(v["verdict"] == "partial", 0.5).when(v["verdict"] == "incorrect", 0.0)),
        of("answer_relevancy", v["similarity"]),
    ).cast("double")
    denominator = F.when(kind == "faithfulness", F.size(claims)).when(kind == "context_relevancy", F.size(passages)).otherwise(1).cast("double")
    listed = denominator.isNotNull() & (denominator >= 0)  # the size of a list that is not there is null or -1
    parts = verdicts.withColumns({"numerator": F.when(listed, numerator), "denominator": F.when(listed, denominator), "grade": of("answer_correctness", v["verdict"])})
    value = F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator"))
    return parts.withColumn("value", F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))))
