"""Prepares the documents of a corpus: quality, line and near duplicates, benchmark passages, then the mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontam, lines, mixing, quality, similar
from folioscope.llm.common import saved, table, unpacked


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; a document of which nothing is left goes."""
    kept = lines.dedup_lines(docs)
    empty = (F.col("n_dropped") > 0) & ~F.col("kept_text").rlike("[^\\x20\\x09-\\x0D]")
    n_chars = {"n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return unpacked(kept.filter(~empty), docs, text=F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text")), **n_chars)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash links and a prefix filter over five-word shingles, decided by a Jaccard similarity of 0.8."""
    return similar.drop_similar(docs)


def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with their size and the words taken."""
    mixed = mixing.mix(docs).filter("taken > 0")
    names = {c: (f"mix_{c}" if c in docs.columns else c) for c in ("size", "source_size", "target", "taken")}
    return mixed.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in names.items()])


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_common_lines),
    ("near duplicates", without_near_copies),
    ("decontamination", without_benchmark_passages),
    ("mix", mixed_sources),
]
# Near copies cannot be said in SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after all stages, each written as a table before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
