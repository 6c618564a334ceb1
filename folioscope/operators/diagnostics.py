"""Health of the knowledge layer: quality, runs, errors, latencies, embedding generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_error(code: Column) -> Column:
    """Category of an error code; the first rule that fits decides."""
    c = F.lower(code)
    has = lambda *parts: c.rlike("|".join(parts))
    return (
        F.when(code.isNull() | (code == ""), F.lit(None).cast("string"))
        .when(c == "page_timeout", "budget_timeout")
        .when(has("provider", "llm") | c.isin("rate_limited", "invalid_output"), "provider")
        .when(has("publication", "import", "merge"), "publication")
        .when(has("storage", "database", "embedding", "job"), "infrastructure")
        .otherwise("other")
    )


def page_health(pages: DataFrame, sources: DataFrame, chunks: DataFrame, policies: DataFrame) -> DataFrame:
    """Flags and score of each live page.

    pages(page_id, space_id, space_name, has_text, deleted_at), sources(page_id, stale_at, deleted_at),
    chunks(page_id, stale_at, has_embedding), policies(page_id, stale_at). Each side is one row per
    page before it is joined. A page is stale when it has text, stale sources and no fresh one.
    """
    source = sources.filter(F.col("deleted_at").isNull()).groupBy("page_id").agg(
        F.count("*").alias("sources"), F.bool_and(F.col("stale_at").isNotNull()).alias("all_stale"), F.min("stale_at").alias("oldest")
    )
    chunk = chunks.filter(F.col("stale_at").isNull()).groupBy("page_id").agg(
        F.count("*").alias("chunks"), F.count_if(~F.col("has_embedding")).alias("bare")
    )
    policy = policies.groupBy("page_id").agg(F.count("stale_at").alias("stale_policies"))
    rows = (
        pages.filter(F.col("deleted_at").isNull())
        .join(source, "page_id", "left").join(chunk, "page_id", "left").join(policy, "page_id", "left")
        .na.fill(0, ["sources", "chunks", "bare", "stale_policies"]).na.fill(False, ["all_stale"])
    )
    flags = {
        "stale_source": F.col("has_text") & F.col("all_stale"),
        "stale_policy": F.col("stale_policies") > 0,
        "missing_source": F.col("has_text") & (F.col("sources") == 0),
        "missing_chunk": F.col("has_text") & (F.col("chunks") == 0),
        "missing_embedding": F.col("bare") > 0,
    }
    lost = (
        F.when(flags["stale_source"] | flags["stale_policy"], 30).otherwise(0)
        + F.when(flags["missing_source"], 35).otherwise(0)
        + F.when(flags["missing_chunk"], 35).otherwise(0)
        + F.when(flags["missing_embedding"], 40).otherwise(0)
    )
    return rows.select(
        "page_id", "space_id", "space_name", (F.col("chunks") > 0).alias("compiled"),
        *[value.alias(name) for name, value in flags.items()],
        F.when(flags["stale_source"], F.col("oldest")).alias("oldest_stale"),
        F.greatest(F.lit(100) - lost, F.lit(0)).alias("score"),
    )


def quality_by_space(health: DataFrame) -> DataFrame:
    stale = F.col("stale_source") | F.col("stale_policy")
    return health.groupBy("space_id").agg(
        F.max("space_name").alias("space_name"), F.count("*").alias("pages"), F.count_if("compiled").alias("compiled"),
        F.count_if(stale).alias("stale"), F.count_if("missing_source").alias("missing_sources"),
        F.count_if("missing_chunk").alias("missing_chunks"), F.count_if("missing_embedding").alias("missing_embeddings"),
        F.count_if("stale_source").alias("stale_sources"), F.count_if("stale_policy").alias("stale_policies"),
        F.min("oldest_stale").alias("oldest_stale"), F.round(F.avg("score")).cast("long").alias("health"),
    )


# Issues in reporting order with their severity.
ISSUES = [
    ("missing_chunks", "high"), ("missing_sources", "high"), ("missing_embeddings", "medium"), ("stale_sources", "medium"),
    ("stale_access_policy", "medium"),
]


def quality_issues(by_space: DataFrame) -> DataFrame:
    """Issues that affect at least one page."""
    column = {"stale_access_policy": "stale_policies"}
    totals = by_space.agg(*[F.sum(column.get(code, code)).alias(code) for code, _ in ISSUES])
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(code).alias("code"), F.lit(level).alias("severity"), F.col(code).alias("pages"))
        for i, (code, level) in enumerate(ISSUES, 1)
    ]
    return totals.select(F.inline(F.array(*cells))).filter(F.col("pages") > 0)


def run_summary(runs: DataFrame) -> DataFrame:
    """runs(run_id, status, phase, created_at): counts and oldest start by status and phase."""
    return runs.groupBy("status", "phase").agg(F.count("*").alias("runs"), F.min("created_at").alias("oldest"))


def failure_categories(run_pages: DataFrame) -> DataFrame:
    return run_pages.groupBy(classify_error(F.col("error_code")).alias("category")).agg(F.count("*").alias("pages")).filter(
        F.col("category").isNotNull()
    )


def run_list(runs: DataFrame, run_pages: DataFrame) -> DataFrame:
    """Runs with the progress of their pages; counted per run before the join."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    progress = run_pages.groupBy("run_id").agg(
        F.count("*").alias("expected"), count("succeeded"), count("failed"), count("skipped"),
        F.count_if(F.col("merge_state") == "pending").alias("merge_pending"), F.count_if(F.col("merge_state") == "done").alias("merge_done"),
    )
    return runs.join(progress, "run_id", "left").na.fill(0)


def image_failures(images: DataFrame) -> DataFrame:
    """images(page_id, status, error_code): failed images per page and class."""
    kind = F.coalesce(classify_error(F.col("error_code")), F.lit("other"))
    return images.filter(F.col("status") == "failed").groupBy("page_id", kind.alias("failure")).agg(F.count("*").alias("images"))


def p95(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Nearest-rank 95th percentile per key.

    Counts per distinct value come first. A sketch deals the values of a key to a hundred ranges, whose sums show the one
    that holds the place; only its values are put in order, so no task orders all values of a key.
    """
    from pyspark.sql.window import Window

    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    edges = counts.groupBy(key).agg(
        F.percentile_approx(value, [k / 100 for k in range(1, 100)], 1000).alias("edges"), F.ceil(F.sum("n") * 0.95).alias("place")
    )
    dealt = counts.join(edges.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")))
    dealt = dealt.withColumn("part", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges", "_key")
    upto = lambda *order: Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = dealt.groupBy(key, "place", "part").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto("part")))
    holds = parts.filter(F.col("upto") >= F.col("place")).groupBy(key).agg(F.min_by(F.struct("part", (F.col("upto") - F.col("n")).alias("before")), "part").alias("held"))
    inside = dealt.join(holds.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("held.part")))
    reached = inside.withColumn("upto", F.col("held.before") + F.sum("n").over(upto(value))).filter(F.col("upto") >= F.col("place"))
    return reached.groupBy(key).agg(F.min(value).alias("p95"))


def retrieval_audit_summary(audits: DataFrame, last: int) -> DataFrame:
    """audits(audit_id, created_at, hits, metadata): rates over the `last` most recent queries."""
    newest = audits.orderBy(F.desc("created_at"), F.desc("audit_id")).limit(last)
    flag = lambda name: F.coalesce(F.get_json_object("metadata", f"$.{name}").cast("boolean"), F.lit(False)).cast("int")
    return newest.agg(
        F.count("*").alias("queries"), F.avg((F.col("hits") == 0).cast("int")).alias("zero_hit_rate"),
        F.avg(flag("embeddingFallback")).alias("embedding_fallback_rate"), F.avg(flag("policyFallback")).alias("policy_fallback_rate"),
        F.avg("hits").alias("mean_hits"), F.avg(F.get_json_object("metadata", "$.candidates").cast("double")).alias("mean_candidates"),
    )


def embedding_generations(chunks: DataFrame) -> DataFrame:
    """chunks(model, dimensions, stale_at, embedded, tokens, duration_ms, embedded_at)"""
    return chunks.groupBy("model", "dimensions", F.col("stale_at").isNull().alias("active")).agg(
        F.count("*").alias("chunks"), F.count_if("embedded").alias("embedded"), F.sum("tokens").alias("tokens"),
        F.sum("duration_ms").alias("duration_sum"), F.avg("duration_ms").alias("duration_mean"),
        F.min("embedded_at").alias("first_at"), F.max("embedded_at").alias("last_at"),
    )


def active_coverage(generations: DataFrame, model: str) -> DataFrame:
    """Whether all active chunks are embedded with the model."""
    active = generations.filter("active")
    mine = F.when(F.col("model") == model, F.col("embedded")).otherwise(0)
    out = active.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(mine), F.lit(0)).alias("on_model"))
    return out.withColumn("ready", (F.col("chunks") > 0) & (F.col("chunks") == F.col("on_model")))


def rebuild_usage(batches: DataFrame, since: str) -> DataFrame:
    recent = batches.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return recent.groupBy("model").agg(
        F.sum("rebuilt").alias("rebuilt"), F.sum("failed").alias("failed"), F.sum("tokens").alias("tokens"), F.sum("duration_ms").alias("duration")
    )


def rebuild_summary(batches: DataFrame, since: str) -> DataFrame:
    """Workspace totals; zeros when there is no batch."""
    recent = batches.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return recent.agg(
        F.count("*").alias("batches"), zero("rebuilt"), zero("failed"), zero("tokens"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    )


def compile_stats(docs: DataFrame) -> DataFrame:
    """docs(dataset, doc_id, page_id, is_gold)"""
    return docs.groupBy("dataset").agg(
        F.count("*").alias("docs"), F.count("page_id").alias("imported"), F.count_if("is_gold").alias("gold")
    )


def compile_readiness(runs: DataFrame) -> DataFrame:
    """runs(run_id, status, space_id, missing, passed, succeeded, failed, skipped): ready flag with codes."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    partial = (F.col("status") == "failed") & (zero("succeeded") > 0) & (zero("failed") + zero("skipped") > 0)
    when = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), F.lit(code))
    reasons = F.array_compact(
        F.array(
            when((F.col("status") != "succeeded") & ~partial, "not_succeeded"),
            when(F.col("space_id").isNull(), "no_space"),
            when(zero("missing") > 0, "documents_missing"),
            when(~F.coalesce("passed", F.lit(False)) & ~partial, "quality_gate"),
        )
    )
    warnings = F.array_compact(F.array(when(partial, "partly_succeeded")))
    return runs.select("run_id", (F.size(reasons) == 0).alias("ready"), reasons.alias("reasons"), warnings.alias("warnings"))
