"""Token counts with a cache of content digests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import each_text, packed, scratch_folder, text_of

# Pieces a worker remembers the counts of before it starts anew; bytes of text between two calls of the tokenizer.
PIECES, ENCODE_BYTES = 400_000, 1 << 20
# Only these ASCII blanks cut a text into pieces; other white space stays inside a piece.
BLANK = re.compile("[ \n\t\r]+")


def tokenizer_file(name: str) -> str:
    """The path of a tokenizer file: a path as given, or the name of a public one."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(name: str) -> str:
    """Names the version of a tokenizer by its content."""
    with open(tokenizer_file(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(name: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of texts as the file's own library gives them, without begin, end or other added tokens."""
    path = tokenizer_file(name)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def piece_counts(texts: list[str], count: Callable[[list[str]], list[int]], known: dict[str, int]) -> list[int]:
    """Counts of texts as sums over their pieces between blanks; only pieces not known yet are encoded."""
    pieces = [BLANK.split(t) for t in texts]
    fresh = list({p for own in pieces for p in own} - known.keys())
    if len(known) + len(fresh) > PIECES:
        known.clear()
        fresh = list({p for own in pieces for p in own})
    for at in range(0, len(fresh), 4096):
        part = fresh[at : at + 4096]
        known.update(zip(part, count(part)))
    return [sum(map(known.__getitem__, own)) for own in pieces]


def encode(tokenizer: str, blanks_split: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known, unpack = counter(tokenizer), {}, zstandard.ZstdDecompressor()
        for batch in batches:
            counts, held, size = [], [], 0
            blobs = batch.column(1).to_pylist()
            for k, blob in enumerate(blobs):
                held.append(unpack.decompress(blob).decode("utf-8", "replace"))
                size += len(held[-1])
                if size >= ENCODE_BYTES or k + 1 == len(blobs):
                    counts += piece_counts(held, count, known) if blanks_split else count(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and compressed text, once for each text of a batch."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for _, texts in each_text(batches):
        own = {hashlib.sha256(t).digest(): t for t in texts}
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.keys(), pa.binary()), pa.array([squeeze.compress(t) for t in own.values()], pa.binary())], names=["digest", "blob"]
        )


def read_cache(spark, path: str, tokenizer: str) -> DataFrame | None:
    """(digest, n_tokens) of one tokenizer version; None where nothing is stored yet."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/tokenizer={tokenizer}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    stored = spark.read.schema("digest binary, n_tokens long").parquet(folder.toString())
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, cache: str, text: str = "text", tokenizer: str = "word_bpe_49k.json", blanks_split: bool = False, limit: int = 2048,
) -> DataFrame:
    """Columns row (the input), n_bytes, n_tokens, over_limit; one row per input row.

    Counts are looked up by the SHA-256 of the text and of the tokenizer's file in the cache, a Parquet folder in a file
    system that driver and executors share. Digests it lacks are encoded once each and appended; an append that is
    repeated after a failure adds equal rows, of which one is read. Null counts as empty; repeated rows share a digest;
    an empty table leaves the cache as it is.

    `blanks_split` says that no token of this tokenizer spans a blank, so a text's count is the sum over its pieces and
    each worker encodes a piece once. Texts move once, compressed, after copies within a task are dropped.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    base = packed(docs, text=text)
    texts = base.select(text_of().alias("text")).mapInArrow(pack, "digest binary, blob binary").dropDuplicates(["digest"])
    known = read_cache(spark, cache, version)
    if known is not None:
        texts = texts.join(known, "digest", "left_anti")
    new = texts.mapInArrow(encode(tokenizer, blanks_split), "digest binary, n_tokens long")
    new.write.mode("append").parquet(f"{cache}/tokenizer={version}")
    counts = read_cache(spark, cache, version).withColumnRenamed("digest", "of")
    own = base.select("row", F.octet_length(text_of()).cast("long").alias("n_bytes"), F.unhex(F.sha2(text_of(), 256)).alias("digest"))
    return own.join(counts, F.col("digest") == F.col("of")).select("row", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def new_cache(spark) -> str:
    """A cache folder of its own in the shared folder, for this process."""
    return scratch_folder(spark, "tokens")
