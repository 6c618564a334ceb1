"""Evidence chains, compiled answers, grounding and the root cause of a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import attribution_tokens, contains_tokens, nfkc, token_recall

SUPPORTED, PARTIAL, ANSWER_RECALL, REFERENCE_RECALL = 0.8, 0.35, 0.5, 0.5
# One-word references that say nothing.
WEAK_REFERENCES = ["a", "an", "and", "in", "of", "on", "the", "to"]


def tokens_of(text: Column) -> Column:
    return attribution_tokens(nfkc(F.coalesce(text, F.lit(""))))


def evidence_tokens(evidence: DataFrame) -> DataFrame:
    """evidence(sample_id, position, title, text): the tokens of a sample's evidence in order.

    A response carries a bounded number of snippets, so its evidence fits in one row.
    """
    part = F.concat_ws("\n", F.when(F.col("title") != "", F.col("title")), F.when(F.col("text") != "", F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("position", part.alias("part"))))
    joined = F.array_join(F.transform(ordered, lambda p: p["part"]), "\n")
    return evidence.groupBy("sample_id").agg(joined.alias("_text")).select("sample_id", tokens_of(F.col("_text")).alias("context"))


def evidence_steps(steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """steps(sample_id, position, answer, support_title, support_text) judged against the evidence."""
    empty = F.array().cast("array<string>")
    rows = steps.join(evidence_tokens(evidence), "sample_id", "left").withColumn("context", F.coalesce("context", empty))
    # the pandas UDF runs once per column here and its results are reused below
    rows = rows.select(
        "sample_id", "position", "context", tokens_of(F.col("answer")).alias("a"), tokens_of(F.col("support_title")).alias("t"),
        tokens_of(F.col("support_text")).alias("s"),
    )
    judged = rows.select(
        "sample_id", "position",
        contains_tokens(F.col("context"), F.col("a")).alias("answer_present"),
        contains_tokens(F.col("context"), F.col("t")).alias("title_present"),
        token_recall(F.col("s"), F.col("context")).alias("overlap"),
    )
    any_hit = F.col("answer_present") | F.col("title_present") | (F.col("overlap") >= PARTIAL)
    status = F.when(F.col("answer_present") & (F.col("overlap") >= SUPPORTED), "supported").when(any_hit, "partial").otherwise("missing")
    return judged.withColumn("status", status)


def claim_retrieved(steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """(sample_id, position): steps for which a single piece of evidence covers the support or holds the answer."""
    pieces = evidence.select("sample_id", tokens_of(F.concat_ws(" ", "title", "text")).alias("piece")).filter(F.size("piece") > 0)
    asked = steps.select("sample_id", "position", tokens_of(F.col("answer")).alias("a"), tokens_of(F.col("support_text")).alias("s"))
    hit = (token_recall(F.col("s"), F.col("piece")) >= PARTIAL) | contains_tokens(F.col("piece"), F.col("a"))
    return asked.join(pieces, "sample_id").filter(hit).select("sample_id", "position").distinct()


def evidence_chain(steps: DataFrame, samples: DataFrame) -> DataFrame:
    """Status of the whole chain; a general answer over a complete chain may be a false negative."""
    count = lambda s: F.count_if(F.col("status") == s)
    per = steps.groupBy("sample_id").agg(
        F.count("*").alias("steps"), count("supported").alias("supported"), count("partial").alias("partial"), count("missing").alias("missing")
    )
    status = F.when(F.col("missing") > 0, "incomplete").when(F.col("partial") > 0, "partial").otherwise("complete")
    return per.withColumn("status", status).join(samples.select("sample_id", "answer_mode"), "sample_id", "left").select(
        "sample_id", "status", "steps", "supported", "partial", "missing",
        F.coalesce((F.col("answer_mode") == "general") & (F.col("status") == "complete"), F.lit(False)).alias("false_negative_candidate"),
    )


def compiled_answers(steps: DataFrame, lineage: DataFrame) -> DataFrame:
    """steps(sample_id, position, answer, doc_id), lineage(doc_id, source_text, compiled_text): was the answer kept?"""
    texts = lineage.select("doc_id", tokens_of(F.col("source_text")).alias("s"), tokens_of(F.col("compiled_text")).alias("c"))
    asked = steps.select("sample_id", "position", "doc_id", tokens_of(F.col("answer")).alias("a"))
    empty = F.array().cast("array<string>")
    rows = asked.join(texts, "doc_id", "left").select(
        "sample_id", "position", "doc_id",
        token_recall(F.col("a"), F.coalesce("s", empty)).alias("source_recall"),
        token_recall(F.col("a"), F.coalesce("c", empty)).alias("compiled_recall"),
    )
    source, compiled = F.col("source_recall") >= ANSWER_RECALL, F.col("compiled_recall") >= ANSWER_RECALL
    status = (
        F.when(source & compiled, "preserved").when(source, "compiled_missing").when(compiled, "compiled_only").otherwise("source_missing")
    )
    return rows.withColumn("status", status)


def usable_references(references: DataFrame, weak: list[str] = WEAK_REFERENCES) -> DataFrame:
    """References that have tokens, but for those of one token among `weak`."""
    rows = references.select("sample_id", tokens_of(F.col("reference")).alias("tokens")).filter(F.size("tokens") > 0)
    return rows.filter((F.size("tokens") > 1) | ~F.col("tokens")[0].isin(weak)) if weak else rows


def covered(context: Column, tokens: Column) -> Column:
    """Half of the reference tokens, repeats counted, occur in the context."""
    return F.size(F.filter(tokens, lambda t: F.array_contains(context, t))) / F.size(tokens) >= REFERENCE_RECALL


def reference_grounding(references: DataFrame, evidence: DataFrame, weak: list[str] = WEAK_REFERENCES) -> DataFrame:
    """(sample_id, references, matched, status) for samples that have usable references and evidence."""
    rows = usable_references(references, weak).join(evidence_tokens(evidence), "sample_id")
    return (
        rows.groupBy("sample_id")
        .agg(F.count("*").alias("references"), F.count_if(covered(F.col("context"), F.col("tokens"))).alias("matched"))
        .withColumn("status", F.when(F.col("matched") > 0, "grounded").otherwise("missing"))
    )


def contains_reference(answers: DataFrame, references: DataFrame) -> DataFrame:
    """(sample_id, contained): the answer covers a usable reference."""
    said = answers.select("sample_id", tokens_of(F.col("answer")).alias("context"))
    hits = usable_references(references).join(said, "sample_id").groupBy("sample_id").agg(
        F.bool_or(covered(F.col("context"), F.col("tokens"))).alias("contained")
    )
    return answers.select("sample_id").join(hits, "sample_id", "left").na.fill(False, ["contained"])


def root_cause(rows: DataFrame) -> DataFrame:
    """First matching cause per sample.

    rows(sample_id, answer_mode, answer_correct, generation_empty, compiled_missing, hit, recall,
    coverage, chain_status, grounded, terms_lost, graph_exclusive, gold_count, uncited_gold).
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    correct, general = yes(F.col("answer_correct")), yes(F.col("answer_mode") == "general")
    broken = yes(F.col("chain_status").isin("incomplete", "partial"))
    found, missed = yes(F.col("hit") > 0), yes(F.col("hit") == 0)
    uncited = (F.col("gold_count") > 0) & (F.coalesce("uncited_gold", F.lit(0.0)) >= F.col("gold_count"))
    thin = broken | yes(F.col("recall") < 1.0) | yes(~F.col("grounded"))
    cause = (
        F.when(yes(F.col("generation_empty")) & ~correct, "generation_empty")
        .when(correct & general, "generation_fallback")
        .when(correct, "answer_correct")
        .when(F.coalesce("compiled_missing", F.lit(0)) > 0, "compiled_answer_missing")
        .when(general & ~found, "generation_fallback")
        .when(general & thin, "retrieval_evidence_incomplete")
        .when(general & F.col("recall").isNotNull(), "generation_ignored_retrieval")
        .when(general, "unknown")
        .when(broken, "retrieval_evidence_incomplete")
        .when(uncited, "citation_dropped")
        .when(missed & yes(F.col("terms_lost")), "compiled_away")
        .when(missed, "retrieval_miss")
        .when(yes(F.col("coverage") < 1.0) & ~yes(F.col("graph_exclusive") > 0), "graph_edge_missing")
        .when(yes(F.col("answer_mode") == "knowledge"), "answer_incorrect")
        .otherwise("unknown")
    )
    return rows.select("sample_id", cause.alias("root_cause"))


def cause_counts(causes: DataFrame) -> DataFrame:
    return causes.groupBy("root_cause").agg(F.count("*").alias("n"))
