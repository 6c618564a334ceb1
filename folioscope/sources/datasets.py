"""Corpora and question sets: reading, normal form, checks, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import sha256_hex, squash

# Characters that a document id may not hold, as it becomes a file name.
UNSAFE = r'[/\\:*?"<>|]'


def require_none(bad: DataFrame, message: str) -> None:
    """Raises with one example when `bad` has a row."""
    rows = bad.limit(1).collect()
    if rows:
        raise ValueError(f"{message}, e.g. {rows[0].asDict()}")


def check_corpus(docs: DataFrame) -> DataFrame:
    """Fails on missing fields, repeated ids and repeated (title, text) pairs."""
    require_none(docs.filter(F.col("title").isNull() | F.col("text").isNull()).select("doc_id"), "document without title or text")
    require_none(docs.groupBy("doc_id").count().filter("count > 1"), "duplicate document id")
    pairs = docs.groupBy("title", sha256_hex(F.col("text")).alias("text_hash")).count()
    require_none(pairs.filter("count > 1"), "duplicate title and text")
    return docs


def load_corpus(spark: SparkSession, path: str, id_rule: str = "row") -> DataFrame:
    """(doc_id, title, text) from JSON files that each hold an array of objects.

    The id comes from `idx`, `id`, or the place in the array (single file). Arrays are exploded in the
    JVM, so a place is known without counting rows on the driver.
    """
    if id_rule not in ("idx", "id", "row"):
        raise ValueError(f"unknown id rule {id_rule}")
    schema = "array<struct<idx:string,id:string,title:string,text:string>>"
    items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)).alias("at", "d"))
    key = {"idx": F.col("d.idx"), "id": F.col("d.id"), "row": F.col("at").cast("string")}[id_rule]
    return check_corpus(items.select(key.alias("doc_id"), "d.title", "d.text"))


def read_space_export(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text) from the Markdown files of an unpacked export; blank files are skipped."""
    root = path.rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    where = F.url_decode(F.col("_metadata.file_path"))
    rows = files.select("value", where.alias("file"))
    inner = F.regexp_extract("file", "^.*?" + root.replace("\\", "\\\\").replace(".", "\\.") + r"/(.*)\.[mM][dD]$", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"^\s+|\s+$", ""))
    name = F.regexp_extract(inner, r"([^/]+)$", 1)
    heading = F.regexp_extract(text, r"^#+[ \t]+([^\n]+?)[ \t]*(?:\n|$)", 1)
    out = rows.filter(~F.contains("file", F.lit("__MACOSX"))).select(
        F.regexp_replace(F.regexp_replace(inner, UNSAFE, "_"), r"^[ .]+|[ .]+$", "").alias("doc_id"),
        F.when(heading != "", heading).otherwise(name).alias("title"), text.alias("text"),
    )
    return check_corpus(out.filter("text != ''"))


def export_markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, markdown): title heading and text, without repeating a heading that is there already."""
    head = F.concat(F.lit("# "), "title")
    first = F.regexp_extract(F.regexp_replace("text", r"^\s+", ""), r"^([^\n]*)", 1)
    bare = F.regexp_replace("text", r"^\s+|\s+$", "")
    full = F.concat(head, F.lit("\n\n"), "text", F.lit("\n"))
    return docs.select("doc_id", F.when(first == head, F.concat(bare, F.lit("\n"))).otherwise(full).alias("markdown"))


def sample_id(dataset: str, native: Column) -> Column:
    return F.concat(F.lit(f"{dataset}:"), native.cast("string"))


def _ordered_distinct(rows: DataFrame, key: str, item: str, position: str, name: str) -> DataFrame:
    """Distinct items per key in the order first met; a sample has few."""
    first = rows.groupBy(key, item).agg(F.min(position).alias("_at"))
    packed = F.array_sort(F.collect_list(F.struct("_at", item)))
    return first.groupBy(key).agg(F.transform(packed, lambda p: p[item]).alias(name))


def normalize_qa(rows: DataFrame, corpus: DataFrame, dataset: str) -> DataFrame:
    """rows(id, question, answer, supporting_facts array<array<string>>) with gold documents by title.

    Every supporting title has to name exactly one document.
    """
    facts = rows.select("id", F.posexplode("supporting_facts").alias("at", "fact")).select("id", "at", F.col("fact")[0].alias("title"))
    named = corpus.groupBy("title").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("docs"))
    found = facts.join(named, "title", "left")
    require_none(found.filter(F.coalesce("docs", F.lit(0)) != 1).select("id", "title", "docs"), "title without exactly one document")
    gold = _ordered_distinct(found, "id", "doc_id", "at", "gold_doc_ids")
    return rows.join(gold, "id").select(
        sample_id(dataset, F.col("id")).alias("sample_id"), "question", F.array("answer").alias("answers"), "gold_doc_ids"
    )


def normalize_musique(rows: DataFrame, corpus: DataFrame, dataset: str = "musique") -> DataFrame:
    """Gold documents are the supporting paragraphs, matched on title and text.

    rows(id, question, answer, answer_aliases, paragraphs array<struct<idx,title,paragraph_text,
    is_supporting>>, question_decomposition array<struct<id,question,answer,paragraph_support_idx>>).
    """
    paragraphs = rows.select("id", F.posexplode("paragraphs").alias("at", "p")).filter("p.is_supporting").select(
        "id", "at", F.col("p.idx").alias("idx"), F.col("p.title").alias("title"), F.col("p.paragraph_text").alias("text")
    )
    found = paragraphs.join(corpus.select("doc_id", "title", "text"), ["title", "text"], "left")
    require_none(found.filter(F.col("doc_id").isNull()).select("id", "title"), "supporting paragraph without document")
    gold = _ordered_distinct(found, "id", "doc_id", "at", "gold_doc_ids")
    lookup = found.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("idx", "doc_id"))).alias("_docs"))
    answers = F.array_distinct(F.concat(F.array("answer"), F.filter(F.coalesce("answer_aliases", F.array().cast("array<string>")), lambda a: a != "")))
    steps = F.transform(
        F.coalesce("question_decomposition", F.array().cast(rows.schema["question_decomposition"].dataType)),
        lambda s: F.struct(
            s["question"].alias("question"), s["answer"].alias("answer"), F.col("_docs")[s["paragraph_support_idx"]].alias("support_doc_id"),
            F.try_element_at("paragraphs", s["paragraph_support_idx"] + 1)["title"].alias("support_title"),
        ),
    )
    out = rows.join(gold, "id").join(lookup, "id")
    require_none(rows.select("id").join(gold, "id", "left_anti"), "sample without supporting paragraph")
    return out.select(
        sample_id(dataset, F.col("id")).alias("sample_id"), "question", answers.alias("answers"), "gold_doc_ids",
        F.substring_index("id", "__", 1).alias("hop_prefix"), steps.alias("steps"),
    )


def normalize_narrativeqa(rows: DataFrame, dataset: str = "narrativeqa") -> DataFrame:
    """rows(row_index, question, answers, document_id): several references, no gold documents."""
    bad = (F.size("answers") <= 0) | F.exists("answers", lambda a: F.trim(a) == "") | F.col("document_id").isNull()
    require_none(rows.filter(F.coalesce(bad, F.lit(True))).select("row_index"), "row without references or document")
    return rows.select(
        sample_id(dataset, F.col("row_index")).alias("sample_id"), "question", F.array_distinct("answers").alias("answers"),
        F.array().cast("array<string>").alias("gold_doc_ids"), "document_id",
    )


def normalize_local(rows: DataFrame, corpus: DataFrame, dataset: str = "local") -> DataFrame:
    """rows(id, question, answer, evidence array<struct<doc_id,quote>>): gold are the cited documents."""
    blank = (F.trim("question") == "") | (F.trim("answer") == "") | (F.size("evidence") <= 0)
    require_none(rows.filter(F.coalesce(blank, F.lit(True))).select("id"), "blank question, answer or evidence")
    cited = rows.select("id", F.posexplode("evidence").alias("at", "e")).select("id", "at", F.col("e.doc_id").alias("doc_id"))
    require_none(cited.join(corpus.select("doc_id"), "doc_id", "left_anti"), "evidence outside the corpus")
    gold = _ordered_distinct(cited, "id", "doc_id", "at", "gold_doc_ids")
    return rows.join(gold, "id").select(
        sample_id(dataset, F.col("id")).alias("sample_id"), "question", F.array("answer").alias("answers"), "gold_doc_ids"
    )


def validate_dataset(samples: DataFrame, gold: DataFrame, corpus: DataFrame) -> DataFrame:
    """(problem, n): dangling gold, blank questions, duplicate samples and documents; no row when clean."""
    named = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    dangling = gold.join(corpus.select("doc_id"), "doc_id", "left_anti").select("sample_id").distinct()
    found = (
        named(dangling, "dangling_gold")
        .unionByName(named(samples.filter(F.trim("question") == ""), "blank_question"))
        .unionByName(named(samples.groupBy("sample_id").count().filter("count > 1"), "duplicate_sample"))
        .unionByName(named(corpus.groupBy("doc_id").count().filter("count > 1"), "duplicate_document"))
    )
    return found.filter("n > 0")


def verified_evidence(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Items with question, answer and quotes that all occur word for word in their document."""
    quotes = F.filter(F.transform("quotes", lambda q: squash(q)), lambda q: q != "")
    rows = items.withColumn("quotes", quotes).join(docs.select("doc_id", squash(F.col("text")).alias("_text")), "doc_id")
    ok = (F.trim("question") != "") & (F.trim("answer") != "") & (F.size("quotes") > 0)
    return rows.filter(ok & F.forall("quotes", lambda q: F.contains("_text", q))).drop("_text")


# --- subsets -------------------------------------------------------------------------------------------


def draw(seed: int, key: Column) -> Column:
    """Order in which rows are drawn: fixed by the seed and the id, so a rerun draws the same rows."""
    return sha256_hex(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def sample_uniform(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    return rows.withColumn("_draw", draw(seed, F.col(key))).orderBy("_draw", key).limit(size).drop("_draw")


def sample_stratified(rows: DataFrame, key: str, stratum: str, size: int, seed: int) -> DataFrame:
    """Sample with largest-remainder quotas per stratum.

    Quotas never exceed a stratum while size is at most the row count, so nothing has to be topped up.
    The constant bound in the rank filter lets Spark cut every stratum before the shuffle.
    """
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    exact = F.least(F.lit(size), F.sum("n").over(every)) * F.col("n") / F.sum("n").over(every)
    quotas = counts.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    left = F.round(F.sum("exact").over(every)) - F.sum("base").over(every)
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), stratum))
    quotas = quotas.select(stratum, (F.col("base") + F.when(place <= left, 1).otherwise(0)).alias("quota"))
    order = Window.partitionBy(stratum).orderBy("_draw", key)
    ranked = rows.withColumn("_draw", draw(seed, F.col(key))).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= size)
    return ranked.join(quotas, stratum).filter(F.col("_n") <= F.col("quota")).drop("_draw", "_n", "quota")


def subset_documents(gold: DataFrame, corpus: DataFrame, ratio: float, seed: int) -> DataFrame:
    """(doc_id, is_gold): gold documents of the picked samples and ratio times as many drawn others.

    Gold outside the usable corpus is an error.
    """
    usable = corpus.filter(F.trim("text") != "").select("doc_id")
    wanted = gold.select("doc_id").distinct()
    require_none(wanted.join(usable, "doc_id", "left_anti"), "gold outside the subset")
    negatives = sample_uniform(usable.join(wanted, "doc_id", "left_anti"), "doc_id", round(wanted.count() * ratio), seed)
    return wanted.withColumn("is_gold", F.lit(True)).unionByName(negatives.withColumn("is_gold", F.lit(False)))


def whole_documents(corpus: DataFrame, documents: int) -> DataFrame:
    """Parts `name_n` of the shortest documents, complete."""
    rows = corpus.withColumn("document", F.regexp_extract("doc_id", r"^(.*)_[^_]*$", 1))
    short = rows.groupBy("document").agg(F.count("*").alias("parts")).orderBy("parts", "document").limit(documents)
    return rows.join(short.select("document"), "document", "left_semi")


def external_id_map(paths: DataFrame, mappings: DataFrame) -> DataFrame:
    """paths(path), mappings(external_id, page_id): (path, external_id, page_id) for files `.._123.html`.

    External ids have to be numbers; ids and targets have to be unique.
    """
    require_none(mappings.filter(~F.col("external_id").rlike(r"^[1-9]\d*$") | (F.trim("page_id") == "")), "invalid mapping")
    require_none(mappings.groupBy("external_id").count().filter("count > 1"), "duplicate external id")
    require_none(mappings.groupBy("page_id").count().filter("count > 1"), "duplicate target")
    clean = ~F.contains("path", F.lit("\\")) & ~F.col("path").rlike(r"(^|/)(\.{0,2})(/|$)")
    found = paths.filter(clean).withColumn("external_id", F.regexp_extract("path", r"(?:^|[_/])([1-9]\d*)\.html$", 1))
    return found.filter("external_id != ''").join(mappings, "external_id").select("path", "external_id", "page_id")
