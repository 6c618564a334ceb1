"""Pieces the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import cut_lineage, scratch_folder  # noqa: F401

# The white space that separates words, for regular expressions and for trimming.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

saved = cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def packed(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows as one struct `row`, with the named columns beside it under names of our own.

    Whatever else the table calls its columns cannot clash with what an operator adds.
    """
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[docs[f"`{c}`"].alias(k) for k, c in columns.items()])


def unpacked(df: DataFrame, like: DataFrame, **replace: Column) -> DataFrame:
    """The columns of `like` from the struct `row`, some of them replaced."""
    return df.select(*[replace.get(c, F.col("row")[c]).alias(c) for c in like.columns])


def text_of(name: str = "text") -> Column:
    """Text with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def row_tag(*columns: str) -> Column:
    """A 64-bit mark of a row's own content, the same in every scan of the table."""
    return F.xxhash64(*columns)


def sha_of_list(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def each_text(batches: Iterator[pa.RecordBatch], column: str = "text", inside: str | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Record batches with their texts as UTF-8; null is empty. `inside` names the field of a struct column."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if inside is not None:
            texts = pc.struct_field(texts, [texts.type.get_field_index(inside)])
        yield batch, [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, lengths: list[int], limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose lengths add up to about `limit`, one row at least."""
    start = held = 0
    for at, length in enumerate(lengths):
        if held and held + length > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += length
    if start < len(lengths):
        yield batch.slice(start)


def checked_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """`df` with a broadcast hint if its counted rows are within the limit; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df
