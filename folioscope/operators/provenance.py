"""Incremental maintenance of artifacts, chunks and links with their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import content_words, quote_hash, tagged_hash
from folioscope.operators.chunks import MAX_SHARED_CHUNKS
from folioscope.operators.paging import latest_per_key

STALE_DAYS = 30
EVENT_DAYS = 400


def page_content_hash(title: Column, text: Column, content: Column, images: Column, attachments: Column) -> Column:
    """Hash of everything a page contributes; fingerprints are sorted, so their order is irrelevant."""
    return tagged_hash(
        F.to_json(
            F.struct(
                title.alias("title"), text.alias("text"), content.alias("content"),
                F.array_sort(images).alias("images"), F.array_sort(attachments).alias("attachments"),
            )
        )
    )


def effective_hash(source_hash: Column, compiler: str, prompt: str, mode: str, images: Column, scheme: str) -> Column:
    """Hash of a source together with the versions that shape its compilation."""
    return tagged_hash(
        F.to_json(
            F.struct(
                F.lit(scheme).alias("scheme"), source_hash.alias("source"), F.lit(compiler).alias("compiler"),
                F.lit(prompt).alias("prompt"), F.lit(mode).alias("mode"), F.array_sort(images).alias("images"),
            )
        )
    )


def changed_sources(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Live pages whose newest stored hash is missing or differs: what a recompilation has to read."""
    stored = latest_per_key(sources, ["page_id"], ["source_version"], ["content_hash"])
    return (
        pages.join(stored.withColumnRenamed("content_hash", "stored_hash"), "page_id", "left")
        .filter(~F.col("content_hash").eqNullSafe(F.col("stored_hash")))
        .select("page_id", F.when(F.col("stored_hash").isNull(), "new").otherwise("changed").alias("change"))
    )


def reuse_embeddings(new: DataFrame, old: DataFrame, profile: str) -> DataFrame:
    """Vectors copied to chunks that keep their id, when made with the same profile."""
    kept = old.filter((F.col("profile") == profile) & F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    return new.join(kept, "chunk_id", "left")


def rebuild_plan(chunks: DataFrame, profile: str) -> DataFrame:
    """Active chunks of the scope whose vector is missing or of another profile."""
    return chunks.filter(
        F.col("stale_at").isNull() & (F.col("embedding").isNull() | ~F.col("profile").eqNullSafe(F.lit(profile)))
    )


def rebuild_embeddings(chunks: DataFrame, profile: str, embed) -> DataFrame:
    """Applies the caller's embedding pandas UDF to the plan; a null vector counts as failed."""
    done = rebuild_plan(chunks, profile).withColumn("embedding", embed(F.col("embedding_text")))
    return done.withColumns({"profile": F.lit(profile), "rebuilt": F.col("embedding").isNotNull()})


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys found in `new` are replaced by its rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def upsert_greatest(old: DataFrame, new: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One row per key with the latest time of both sides."""
    both = old.select(*keys, ts).unionByName(new.select(*keys, ts))
    return both.groupBy(*keys).agg(F.max(ts).alias(ts))


def diff_rows(existing: DataFrame, desired: DataFrame, key: str, content: str) -> DataFrame:
    """Rows to insert, update or delete so that `existing` becomes `desired`."""
    old = existing.select(key, F.col(content).alias("_old"), F.lit(True).alias("_has_old"))
    new = desired.select(key, F.col(content).alias("_new"), F.lit(True).alias("_has_new"))
    change = (
        F.when(F.col("_has_old").isNull(), "insert")
        .when(F.col("_has_new").isNull(), "delete")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    )
    return old.join(new, key, "full_outer").select(key, change.alias("change")).filter(F.col("change").isNotNull())


def merged_pieces(contributions: DataFrame) -> DataFrame:
    """(artifact_id, text): the distinct texts of an artifact, however many there are."""
    return contributions.select("artifact_id", "text").distinct()


def merge_contributions(contributions: DataFrame, budget: int = MAX_SHARED_CHUNKS) -> DataFrame:
    """One row per artifact from the contributions of its sources.

    contributions(artifact_id, source_id, title, text). The title is that of the smallest source, the
    text the sorted distinct texts. Texts are made distinct before they are put together; an artifact of
    more pieces than the budget is flagged, its text is whole all the same.
    """
    pieces = merged_pieces(contributions)
    head = contributions.groupBy("artifact_id").agg(
        F.min_by("title", F.struct("source_id", "title")).alias("title"), F.countDistinct("source_id").alias("sources")
    )
    joined = pieces.groupBy("artifact_id").agg(
        F.count("*").alias("pieces"), F.array_join(F.array_sort(F.collect_list("text")), "\n\n").alias("text")
    )
    # every artifact has a piece; as a left join it is left out by the planner where no text is asked for
    return head.join(joined, "artifact_id", "left").withColumn("over_budget", F.col("pieces") > budget)


def merged_children(rows: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """Chunks or links of merged artifacts: one row per (artifact, key), the first source wins."""
    first = F.min_by(F.struct(*columns), F.struct("source_id", *columns)).alias("_row")
    return rows.groupBy("artifact_id", key.alias("child_key")).agg(first).select("artifact_id", "child_key", "_row.*")


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Dangling links get the live page with the same space, kind and canonical key."""
    target = pages.filter(F.col("stale_at").isNull()).groupBy("space_id", "kind", "canonical_key").agg(
        F.min("page_id").alias("found_id")
    )
    open_link = F.col("to_id").isNull()
    out = links.join(
        target.select(
            "space_id", F.col("kind").alias("target_kind"), F.col("canonical_key").alias("target_key"), "found_id"
        ),
        ["space_id", "target_kind", "target_key"],
        "left",
    )
    return out.select(
        "link_id", "from_id",
        F.when(open_link, F.col("found_id")).otherwise(F.col("to_id")).alias("to_id"),
        (open_link & F.col("found_id").isNull()).alias("is_dangling"),
    )


def mark_stale(rows: DataFrame, bridge: DataFrame, sources: DataFrame, owner: str, when: str) -> DataFrame:
    """Sets stale_at on rows that touch one of the sources."""
    touched = bridge.join(sources.select("source_id").distinct(), "source_id", "left_semi").select(owner).distinct()
    return (
        rows.join(touched.withColumn("_hit", F.lit(True)), owner, "left")
        .withColumn("stale_at", F.coalesce("stale_at", F.when(F.col("_hit"), F.lit(when))))
        .drop("_hit")
    )


def dependants(bridge: DataFrame, sources: DataFrame, owner: str) -> DataFrame:
    return bridge.join(sources.select("source_id").distinct(), "source_id", "left_semi").select(owner).distinct()


def purge_stale(pages: DataFrame, links: DataFrame, now: str, days: int = STALE_DAYS) -> tuple[DataFrame, DataFrame]:
    """Drops pages stale for longer than `days`; live links to them become dangling."""
    old = F.coalesce(F.datediff(F.lit(now), "stale_at") > days, F.lit(False))
    gone = pages.filter(old).select("page_id")
    kept_links = links.join(gone.withColumnRenamed("page_id", "from_id"), "from_id", "left_anti")
    lost = gone.select(F.col("page_id").alias("to_id"), F.lit(True).alias("_lost"))
    return pages.filter(~old), kept_links.join(lost, "to_id", "left").select(
        "link_id", "from_id",
        F.when(F.col("_lost").isNull(), F.col("to_id")).alias("to_id"),
        (F.coalesce("_lost", F.lit(False)) | F.col("is_dangling")).alias("is_dangling"),
    )


def retention(rows: DataFrame, ts: str, now: str, days: int, keep_always: Column | None = None) -> DataFrame:
    """Rows that survive a retention run; `keep_always` marks those that never expire."""
    fresh = F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    return rows.filter(fresh | keep_always if keep_always is not None else fresh)


def validate_artifacts(artifacts: DataFrame, refs: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """(artifact_id, reasons): reason codes per artifact, an empty list when it is valid.

    artifacts(artifact_id, space_id, expected_space_id, run_id, kind), refs(artifact_id, source_id,
    source_version, content_hash, start, stop, quote_hash), sources(source_id, source_version,
    content_hash, text), links(artifact_id, link_type, target_space_id, is_opaque).
    """
    keyed = sources.withColumn("_known", F.lit(True))
    joined = refs.join(keyed, ["source_id", "source_version", "content_hash"], "left")
    has_range, has_quote = F.col("start").isNotNull() & F.col("stop").isNotNull(), F.col("quote_hash").isNotNull()
    inside = (F.col("start") >= 0) & (F.col("stop") > F.col("start")) & (F.col("stop") <= F.length("text"))
    known = F.col("_known").isNotNull()
    cited = F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start"))
    flags = joined.groupBy("artifact_id").agg(
        F.count("*").alias("ref_count"),
        F.bool_or(~known).alias("outside"),
        F.bool_or(known & ((has_range != has_quote) | (has_range & has_quote & ~inside))).alias("bad_range"),
        F.bool_or(known & has_range & has_quote & inside & (quote_hash(cited) != F.col("quote_hash"))).alias("bad_quote"),
    )
    crossing = links.join(artifacts.select("artifact_id", "expected_space_id"), "artifact_id").groupBy("artifact_id").agg(
        F.bool_or(
            (F.col("link_type") == "cross_space_reference")
            & (F.col("target_space_id") != F.col("expected_space_id"))
            & ~F.col("is_opaque")
        ).alias("open_crossing")
    )
    when = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), F.lit(code))
    return (
        artifacts.join(flags, "artifact_id", "left")
        .join(crossing, "artifact_id", "left")
        .select(
            "artifact_id",
            F.array_compact(
                F.array(
                    when(F.col("space_id") != F.col("expected_space_id"), "scope_mismatch"),
                    when(F.col("run_id").isNull() | F.col("ref_count").isNull(), "lineage_incomplete"),
                    when(~F.col("kind").isin(ARTIFACT_KINDS), "kind_unsupported"),
                    when(F.col("outside"), "source_outside_input"),
                    when(F.col("bad_range"), "range_invalid"),
                    when(F.col("bad_quote"), "quote_mismatch"),
                    when(F.col("open_crossing"), "cross_space_not_opaque"),
                )
            ).alias("reasons"),
        )
    )


# Kinds of artifacts.
ARTIFACT_KINDS = ["source_summary", "concept", "entity", "comparison"]


def quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.size("reasons") > 0
    return validated.filter(~bad), validated.filter(bad)


def compiled_sources(bridge: DataFrame, artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources that have a live artifact with at least one chunk."""
    live = artifacts.filter(F.col("stale_at").isNull()).join(chunks.select("artifact_id"), "artifact_id", "left_semi")
    return bridge.join(live.select("artifact_id"), "artifact_id", "left_semi").select("source_id").distinct()


def removed_sources(known: list[DataFrame], pages: DataFrame) -> DataFrame:
    """Source ids seen anywhere that no longer have a live page."""
    ids = known[0].select("source_id")
    for other in known[1:]:
        ids = ids.union(other.select("source_id"))
    live = pages.filter(F.col("deleted_at").isNull()).select(F.col("page_id").alias("source_id"))
    return ids.distinct().join(live, "source_id", "left_anti")


def retire_sources(contributions: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Surviving contributions re-merged, and the artifacts that lost their last one."""
    left = contributions.join(removed, "source_id", "left_anti")
    touched = contributions.join(removed, "source_id", "left_semi").select("artifact_id").distinct()
    again = merge_contributions(left.join(touched, "artifact_id", "left_semi"))
    return again, touched.join(left.select("artifact_id"), "artifact_id", "left_anti")


def reuse_candidates(
    attempts: DataFrame, sources: DataFrame, contributions: DataFrame, artifacts: DataFrame, chunks: DataFrame
) -> DataFrame:
    """Newest attempt per page whose version and hash still match a live source with chunks."""
    newest = latest_per_key(attempts, ["page_id"], ["attempt_id"], ["attempt_id", "source_version", "content_hash"])
    live = sources.filter(F.col("stale_at").isNull()).select("page_id", "source_version", "content_hash")
    backed = (
        contributions.join(artifacts.filter(F.col("stale_at").isNull()).select("artifact_id"), "artifact_id", "left_semi")
        .join(chunks.select("artifact_id"), "artifact_id", "left_semi")
        .select(F.col("source_id").alias("page_id"))
    )
    return newest.join(live, ["page_id", "source_version", "content_hash"], "left_semi").join(
        backed, "page_id", "left_semi"
    )


def current_source(sources: DataFrame, text: str = "text") -> DataFrame:
    """Newest active text per page."""
    return latest_per_key(sources.filter(F.col("stale_at").isNull()), ["page_id"], ["updated_at", text], [text])


def vocabulary_change(pairs: DataFrame) -> DataFrame:
    """pairs(source_text, compiled_text) with the words a compilation dropped, added and kept."""
    source, compiled = content_words(F.col("source_text")), content_words(F.col("compiled_text"))
    left, right = F.array_distinct(source), F.array_distinct(compiled)
    rows = pairs.withColumns({"_s": source, "_c": compiled, "_ls": left, "_rc": right})
    kept = F.size(F.array_intersect("_ls", "_rc"))
    return rows.select(
        *[c for c in pairs.columns if c not in ("source_text", "compiled_text")],
        F.length("source_text").alias("source_chars"),
        F.length("compiled_text").alias("compiled_chars"),
        F.when(F.length("source_text") > 0, F.length("compiled_text") / F.length("source_text")).alias("expansion_ratio"),
        F.size("_s").alias("source_words"),
        F.size("_c").alias("compiled_words"),
        F.array_sort(F.array_except("_ls", "_rc")).alias("dropped"),
        F.array_sort(F.array_except("_rc", "_ls")).alias("added"),
        kept.alias("kept"),
        F.when(F.size("_ls") > 0, kept / F.size("_ls")).alias("retention"),
    )


def question_terms_lost(question: Column, dropped: Column) -> Column:
    return F.array_sort(F.array_intersect(F.array_distinct(content_words(question)), dropped))
