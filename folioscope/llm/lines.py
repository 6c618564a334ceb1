"""Line deduplication: lines that many documents share go, the other lines stay in place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SPACE_CHARS, checked_broadcast, each_text, packed, row_tag, saved, text_of

MAX_SENT = 200_000
SPACE_BYTES = SPACE_CHARS.encode()


def line_keys(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """Positions and keys of the lines whose key has `min_chars` code points.

    A key is the line without white space at both ends and with A-Z lower-cased.
    """
    found = []
    for at, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(SPACE_BYTES).lower()
            if len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
                found.append((at, key))
    return found


def explode_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, tag, place, hi, lo) of every line with a long enough key; hi and lo are a 128-bit hash of the key."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches):
            rows, places, marks = [], [], []
            for row, text in enumerate(texts):
                for place, key in line_keys(text, min_chars):
                    rows.append(row)
                    places.append(place)
                    marks.append(xxhash.xxh3_128_digest(key))
            halves = np.frombuffer(b"".join(marks), dtype=">i8").astype(np.int64).reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(places, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=["doc", "tag", "place", "hi", "lo"],
            )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "tag", "text").mapInArrow(explode, f"doc {kind}, tag long, place long, hi long, lo long")


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Columns row (the input), kept_text, n_lines, n_dropped; one row per input row.

    A line whose key has `min_chars` code points and is found in `min_docs` documents is dropped everywhere but in the
    largest document id that holds it. Null text is one empty line. Rows without an id count as one document, which
    never keeps such a line. Repeated rows are counted once and treated alike; an empty table gives an empty table.

    One pass over the texts writes line hashes; a document counts once per hash before hashes are counted, so a line
    found everywhere is summed map-side. Hashes over the threshold are broadcast up to MAX_SENT rows, beyond that joined by
    shuffle, where Spark splits a hot hash. Only places of dropped lines are joined back.
    """
    base = packed(docs, doc=doc, text=text).withColumn("tag", row_tag("doc", "text"))
    lines = saved(explode_lines(base, min_chars))
    common = saved(
        lines.groupBy("hi", "lo", "doc").agg(F.lit(1).alias("one"))
        .groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
        .filter(F.col("n") >= min_docs)
    )
    dropped = (
        lines.join(checked_broadcast(common, common.count(), MAX_SENT), ["hi", "lo"]).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc", "tag").agg(F.collect_set("place").alias("places"))
        .select(F.col("doc").alias("of_doc"), F.col("tag").alias("of_tag"), "places")
    )
    joined = base.join(dropped, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("tag") == F.col("of_tag")), "left")
    pieces = F.split(text_of(), "\n")
    every = F.sequence(F.lit(0).cast("long"), F.size(pieces).cast("long") - 1)
    rest = F.array_join(F.transform(F.array_except(every, F.col("places")), lambda i: F.get(F.col("pieces"), i.cast("int"))), "\n")
    return joined.withColumn("pieces", pieces).select(
        "row",
        F.when(F.col("places").isNull(), text_of()).otherwise(rest).alias("kept_text"),
        F.size("pieces").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )
