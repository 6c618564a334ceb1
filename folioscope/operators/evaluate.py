"""Metrics of retrieval, answers, citations and graph evidence, all as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import answer_tokens, normalize_answer, strip_notice
from folioscope.operators.paging import first_per_key, latest_per_key

KS = (2, 5, 10, 20)
# What each metric family needs, and the answers that mean no answer was produced.
METRIC_NEEDS = {
    "em": "references", "f1": "references",
    "mrr": "gold", "retrieval_f1": "gold", "precision": "gold", "recall": "gold", "ndcg": "gold", "hit": "gold",
    "full_coverage": "gold",
    "citation_precision": "gold", "citation_recall": "gold", "uncited_count": "gold", "uncited_gold_count": "gold",
    "graph_neighbor_precision": "gold", "graph_neighbor_gold_snippets": "gold", "graph_exclusive_gold_share": "gold",
}


def ranked_docs(retrieved: DataFrame, page_to_doc: DataFrame) -> DataFrame:
    """retrieved(sample_id, position, page_id) → (sample_id, doc_id, rank).

    Pages without a document keep their rank under a marker; a document counts at its first position.
    """
    from pyspark.sql.window import Window

    keyed = retrieved.filter(F.col("page_id").isNotNull()).join(page_to_doc, "page_id", "left").select(
        "sample_id", "position",
        F.coalesce("doc_id", F.concat(F.lit("__unmapped__:"), F.col("page_id").cast("string"))).alias("doc_id"),
    )
    first = keyed.groupBy("sample_id", "doc_id").agg(F.min("position").alias("position"))
    order = Window.partitionBy("sample_id").orderBy("position", "doc_id")
    return first.select("sample_id", "doc_id", F.row_number().over(order).alias("rank"))


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def metric_evidence(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Each ranked document with its gold flag and its share in the discounted gain."""
    marks = gold.select("sample_id", "doc_id").distinct().withColumn("_gold", F.lit(True)).hint("shuffle_hash")
    return ranked.join(marks, ["sample_id", "doc_id"], "left").select(
        "sample_id", "rank", "doc_id", F.coalesce("_gold", F.lit(False)).alias("is_gold"),
        F.when(F.col("_gold"), _gain(F.col("rank"))).otherwise(0.0).alias("gain"),
    )


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(sample_id, metric, value) for samples that have gold documents."""
    rows = metric_evidence(ranked, gold)
    parts = [F.count("*").alias("n"), F.count_if("is_gold").alias("hits"), F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("first")]
    for k in ks:
        inside = F.col("is_gold") & (F.col("rank") <= k)
        parts += [F.count_if(inside).alias(f"h{k}"), F.sum(F.when(inside, F.col("gain"))).alias(f"g{k}")]
    per = rows.groupBy("sample_id").agg(*parts)
    wanted = gold.select("sample_id", "doc_id").distinct().groupBy("sample_id").agg(F.count("*").alias("golds"))
    all_rows = wanted.join(per.hint("shuffle_hash"), "sample_id", "left").na.fill(0, ["n", "hits"] + [f"h{k}" for k in ks] + [f"g{k}" for k in ks])
    precision, recall = F.col("hits") / F.col("n"), F.col("hits") / F.col("golds")
    found = {
        "mrr": F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)),
        "retrieval_f1": F.when(F.col("hits") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0),
    }
    for k in ks:
        hits, top = F.col(f"h{k}"), F.least(F.col("n"), F.lit(k))
        ideal = F.aggregate(
            F.sequence(F.lit(1), F.least(F.col("golds"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, r: acc + _gain(r)
        )
        found |= {
            f"precision@{k}": F.when(top > 0, hits / top).otherwise(0.0),
            f"recall@{k}": hits / F.col("golds"),
            f"ndcg@{k}": F.col(f"g{k}") / ideal,
            f"hit@{k}": (hits > 0).cast("double"),
            f"full_coverage@{k}": (hits == F.col("golds")).cast("double"),
        }
    return long_metrics(all_rows, found)


def long_metrics(rows: DataFrame, found: dict[str, Column]) -> DataFrame:
    cells = [F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in found.items()]
    return rows.select("sample_id", F.inline(F.array(*cells)))


def answer_metrics(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Best exact match and token F1 over the references of a sample.

    Token overlap counts repeats. Both sides are counted per token in one aggregation, so long answers
    cost no nested loops.
    """
    pred = predictions.select("sample_id", strip_notice(F.coalesce("prediction", F.lit(""))).alias("p"))
    pairs = pred.join(references, "sample_id").select(
        "sample_id", F.xxhash64("reference").alias("ref"), answer_tokens(F.col("p")).alias("a"), answer_tokens(F.col("reference")).alias("b"),
        (normalize_answer(F.col("p")) == normalize_answer(F.col("reference"))).alias("same"),
    )
    key = ["sample_id", "ref"]
    tokens = pairs.select(*key, F.explode("a").alias("t"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(
        pairs.select(*key, F.explode("b").alias("t"), F.lit(0).alias("x"), F.lit(1).alias("y"))
    )
    shared = (
        tokens.groupBy(*key, "t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        .filter((F.col("x") > 0) & (F.col("y") > 0))
        .groupBy(*key).agg(F.sum(F.least("x", "y")).alias("shared"))
    )
    sizes = pairs.select(*key, F.size("a").alias("na"), F.size("b").alias("nb"), "same").distinct()
    precision, recall = F.col("shared") / F.col("na"), F.col("shared") / F.col("nb")
    f1 = (
        F.when((F.col("na") == 0) | (F.col("nb") == 0), (F.col("na") == F.col("nb")).cast("double"))
        .when(F.coalesce("shared", F.lit(0)) == 0, 0.0)
        .otherwise(2 * precision * recall / (precision + recall))
    )
    best = sizes.join(shared, key, "left").withColumn("f1", f1).groupBy("sample_id").agg(
        F.max(F.col("same").cast("double")).alias("em"), F.max("f1").alias("f1")
    )
    return long_metrics(best, {"em": F.col("em"), "f1": F.col("f1")})


def _docs(rows: DataFrame, page_to_doc: DataFrame) -> DataFrame:
    return rows.join(page_to_doc, "page_id").select("sample_id", "doc_id")


def citation_metrics(citations: DataFrame, retrieved: DataFrame, gold: DataFrame, page_to_doc: DataFrame) -> DataFrame:
    """Precision and recall of citations, and retrieved documents left uncited; mapped pages only."""
    flag = lambda df, name: df.select(
        "sample_id", "doc_id", *[F.lit(n == name).alias(n) for n in ("cited", "found", "gold")]
    )
    rows = flag(_docs(citations, page_to_doc), "cited").unionByName(flag(_docs(retrieved, page_to_doc), "found")).unionByName(
        flag(gold, "gold")
    )
    sets = rows.groupBy("sample_id", "doc_id").agg(*[F.bool_or(c).alias(c) for c in ("cited", "found", "gold")])
    both, left = F.col("cited") & F.col("gold"), F.col("found") & ~F.col("cited")
    per = sets.groupBy("sample_id").agg(
        F.count_if("cited").alias("cited"), F.count_if("gold").alias("gold"), F.count_if(both).alias("both"),
        F.count_if(left).alias("left"), F.count_if(left & F.col("gold")).alias("left_gold"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return long_metrics(
        per,
        {
            "citation_precision": ratio("both", "cited"), "citation_recall": ratio("both", "gold"),
            "uncited_count": F.col("left"), "uncited_gold_count": F.col("left_gold"),
        },
    )


def graph_metrics(snippets: DataFrame, gold: DataFrame, page_to_doc: DataFrame) -> DataFrame:
    """snippets(sample_id, position, chunk_id, origin, page_id), one row per source window.

    Gold documents count as graph-exclusive when some chunk shows them only through the graph.
    """
    marks = gold.select("sample_id", "doc_id").distinct().withColumn("_gold", F.lit(True)).hint("shuffle_hash")
    rows = snippets.join(page_to_doc, "page_id").join(marks, ["sample_id", "doc_id"], "left").select(
        "sample_id", "position", "chunk_id", "doc_id",
        (F.col("origin") == "graph").alias("graph"), F.coalesce("_gold", F.lit(False)).alias("gold"),
    )
    pairs = rows.groupBy("sample_id", "doc_id", "chunk_id").agg(
        F.bool_or("graph").alias("graph"), F.bool_or(~F.col("graph")).alias("other"), F.bool_or("gold").alias("gold")
    )
    docs = pairs.groupBy("sample_id", "doc_id").agg(
        F.bool_or("graph").alias("graph"), F.bool_or("gold").alias("gold"),
        F.bool_or(F.col("gold") & F.col("graph") & ~F.col("other")).alias("exclusive"),
    )
    per = docs.groupBy("sample_id").agg(
        F.count_if("graph").alias("graph_docs"), F.count_if(F.col("graph") & F.col("gold")).alias("graph_gold"),
        F.count_if("exclusive").alias("exclusive"),
    )
    shown = rows.filter(F.col("graph") & F.col("gold")).select("sample_id", "position").distinct().groupBy("sample_id").agg(
        F.count("*").alias("shown")
    )
    wanted = gold.select("sample_id", "doc_id").distinct().groupBy("sample_id").agg(F.count("*").alias("golds"))
    all_rows = wanted.join(per.hint("shuffle_hash"), "sample_id", "left").join(shown.hint("shuffle_hash"), "sample_id", "left").na.fill(0)
    return long_metrics(
        all_rows,
        {
            "graph_neighbor_gold_snippets": F.col("shown"),
            "graph_neighbor_precision": F.when(F.col("graph_docs") > 0, F.col("graph_gold") / F.col("graph_docs")).otherwise(0.0),
            "graph_exclusive_gold_share": F.col("exclusive") / F.col("golds"),
        },
    )


def origin_counts(snippets: DataFrame, page_to_doc: DataFrame) -> DataFrame:
    named = snippets.withColumn("origin", F.coalesce("origin", F.lit("unknown"))).join(page_to_doc, "page_id", "left")
    return named.groupBy("sample_id", "origin").agg(
        F.countDistinct("position").alias("snippets"), F.countDistinct("doc_id").alias("docs")
    )


def available_metrics(metrics: DataFrame, samples: DataFrame) -> DataFrame:
    """Metrics a sample can have: gold metrics need gold documents, answer metrics references."""
    family = F.regexp_extract("metric", r"^([^@]+)", 1)
    needs = F.create_map(*[F.lit(v) for pair in METRIC_NEEDS.items() for v in pair])
    has = F.when(needs[family] == "gold", F.col("gold_count") > 0).otherwise(F.col("reference_count") > 0)
    asked = samples.select("sample_id", "gold_count", "reference_count").hint("shuffle_hash")  # so the many metrics of a sample are not sorted
    return metrics.join(asked, "sample_id").filter(has).select(
        "sample_id", "metric", "value"
    )


def evaluate(
    samples: DataFrame, responses: DataFrame, references: DataFrame, gold: DataFrame, retrieved: DataFrame,
    citations: DataFrame, page_to_doc: DataFrame, ks: tuple[int, ...] = KS,
) -> DataFrame:
    """The long metric table of a run.

    A response to another question than the sample's is an error. A response without a 2xx status
    counts with an empty body: no answer, nothing retrieved.
    """
    joined = samples.join(responses.withColumnRenamed("question", "asked"), "sample_id")
    checked = joined.withColumn(
        "sample_id",
        F.when(F.col("question") == F.col("asked"), F.col("sample_id")).otherwise(
            F.raise_error(F.concat(F.lit("question differs for sample "), F.col("sample_id").cast("string")))
        ),
    )
    fine = F.col("http_status").between(200, 299)
    served = checked.filter(fine).select("sample_id")
    body = lambda df: df.join(served, "sample_id", "left_semi")
    predictions = checked.select("sample_id", F.when(fine, F.col("answer")).otherwise("").alias("prediction"))
    parts = [
        answer_metrics(predictions, references),
        retrieval_metrics(ranked_docs(body(retrieved), page_to_doc), gold, ks),
        citation_metrics(body(citations), body(retrieved), gold, page_to_doc),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def metric_summary(metrics: DataFrame, samples: DataFrame) -> DataFrame:
    """Means per scope; a metric a sample lacks counts as 0. samples(sample_id, answer_mode)"""
    scoped = samples.select(
        "sample_id", F.explode(F.when(F.col("answer_mode") == "knowledge", F.array(F.lit("overall"), F.lit("knowledge_only"))).otherwise(F.array(F.lit("overall")))).alias("scope")
    )
    size = scoped.groupBy("scope").agg(F.count("*").alias("samples"))
    sums = metrics.join(scoped.hint("shuffle_hash"), "sample_id").groupBy("scope", "metric").agg(F.sum("value").alias("total"))
    return sums.join(size, "scope").select("scope", "metric", (F.col("total") / F.col("samples")).alias("mean"), "samples")


def answer_mode_distribution(samples: DataFrame) -> DataFrame:
    counts = samples.groupBy(F.coalesce("answer_mode", F.lit("missing")).alias("mode")).agg(F.count("*").alias("n"))
    return counts.select("mode", (F.col("n") / samples.agg(F.count("*")).scalar()).alias("share"))


def judge_score(kind: Column, verdict: Column) -> Column:
    """Score of a recorded verdict (JSON text), null when there is nothing to score."""
    schema = "struct<claims:array<struct<verdict:string>>,passages:array<struct<useful:boolean>>,verdict:string,similarity:double>"
    v = F.from_json(verdict, schema)
    claims, passages = v["claims"], v["passages"]
    share = lambda items, test: F.when(F.size(items) > 0, F.size(F.filter(items, test)) / F.size(items))
    grade = F.when(v["verdict"] == "correct", 1.0).when(v["verdict"] == "partial", 0.5).when(v["verdict"] == "incorrect", 0.0)
    return (
        F.when(kind == "faithfulness", share(claims, lambda c: c["verdict"] == "supported"))
        .when(kind == "context_relevancy", share(passages, lambda p: p["useful"]))
        .when(kind == "answer_correctness", grade)
        .when((kind == "answer_relevancy") & v["similarity"].isNotNull(), F.least(F.greatest(v["similarity"], F.lit(0.0)), F.lit(1.0)))
    )


def judge_summary(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """verdicts(.., kind, score, error, latency_ms): means skip verdicts without a score."""
    return verdicts.groupBy(*keys).agg(
        F.avg("score").alias("mean"), F.count("score").alias("scored"), F.count("*").alias("verdicts"),
        (F.count("error") / F.count("*")).alias("failure_rate"), F.avg("latency_ms").alias("latency"),
    )


def judge_failures(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("error").isNotNull()).groupBy("kind", "error").agg(F.count("*").alias("n"))


def is_retryable(status: Column, answer: Column, unavailable: list[str]) -> Column:
    """No 2xx status, or an answer that is missing, blank or a known failure notice."""
    text = F.trim(answer)
    dead = answer.isNull() | (text == "") | (text.isin(unavailable) if unavailable else F.lit(False))
    return ~F.coalesce(status.between(200, 299), F.lit(False)) | dead


def pending_samples(samples: DataFrame, responses: DataFrame, unavailable: list[str]) -> DataFrame:
    """Samples that have no usable response yet."""
    done = responses.filter(~is_retryable(F.col("http_status"), F.col("answer"), unavailable))
    return samples.join(done.select("sample_id"), "sample_id", "left_anti")


def query_stats(responses: DataFrame, unavailable: list[str], keys: list[str]) -> DataFrame:
    """responses(.., http_status, answer, latency_ms, timing): counts, failures, latency and phase means."""
    phase = lambda name: F.avg(F.get_json_object("timing", f"$.{name}").cast("double")).alias(f"{name}_ms")
    return responses.groupBy(*keys).agg(
        F.count("*").alias("responses"),
        F.count_if(is_retryable(F.col("http_status"), F.col("answer"), unavailable)).alias("failures"),
        F.avg("latency_ms").alias("latency_mean"), F.max("latency_ms").alias("latency_max"),
        phase("retrieval"), phase("generation"),
    )


def samples_ranked_by(metrics: DataFrame, samples: DataFrame, metric: str, worst: bool, k: int) -> DataFrame:
    rows = metrics.filter(F.col("metric") == metric)
    order = F.asc("value") if worst else F.desc("value")
    return rows.orderBy(order, F.asc("sample_id")).limit(k).join(samples, "sample_id")


def compare_runs(summary: DataFrame, counts: list[str]) -> DataFrame:
    """summary(run, dataset, metric, mean): difference to the first run, in points or raw for counts.

    The first run is the smallest, be runs numbers or texts.
    """
    base = first_per_key(summary, ["dataset", "metric"], ["run"], ["mean"]).withColumnRenamed("mean", "base")
    scale = F.when(F.col("metric").isin(counts), 1.0).otherwise(100.0)
    return summary.join(base, ["dataset", "metric"], "left").select(
        "run", "dataset", "metric", "mean", ((F.col("mean") - F.col("base")) * scale).alias("delta")
    )


def latest_query_audit(questions: DataFrame, audits: DataFrame) -> DataFrame:
    """Newest audit of each question, found by the hash of the question."""
    from folioscope.functions.text import sha256_hex

    newest = latest_per_key(audits, ["query_hash"], ["created_at", "audit_id"], ["audit_id", "metadata"])
    return questions.withColumn("query_hash", sha256_hex(F.col("question"))).join(newest, "query_hash")


def status_band(value: Column, lower_is_better: bool = False) -> Column:
    """Reading of a score: good, warning or bad."""
    if lower_is_better:
        return F.when(value == 0, "good").otherwise("bad")
    return F.when(value >= 0.8, "good").when(value >= 0.5, "warning").otherwise("bad")
