"""Spelling variants: words one error apart, found in bidirectional FM-indexes of blocks of the vocabulary."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import saved
from folioscope.llm.fmindex import Words, one_error

# Fixed value: a run of letters is a word.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Different words a task counts before it gives its counts away.
HELD = 1 << 18
# Words in an index, and questions to one index; blocks that are asked more are built several times.
BLOCK, ASKED = 1 << 14, 1 << 16
FOUND = "word string, n_near bigint, form string, form_n bigint"


def word_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", drop_every: int = 0) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case, with their occurrences. Null texts have no words.

    With `drop_every`, a word loses one letter in those documents where the checksum of "<doc>:<word>" is a multiple of it, as if
    mistyped there; a null document id reads as empty. Words that lose their only letter go.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not body:
                    continue
                mark = crc32(f"{'' if name is None else name}:".encode())
                for run, n in Counter(RUN.findall(body)).items():
                    word = run.encode().translate(LOWER)
                    if drop_every and (h := crc32(word, mark)) % drop_every == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    totals[word] += n
            if len(totals) > HELD:
                yield counted(totals)
                totals.clear()
        yield counted(totals)

    def counted(totals: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.binary()).cast(pa.string()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"])

    parts = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text")).mapInArrow(count, "word string, n bigint")
    return parts.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def block_starts(words: DataFrame, blocks: int) -> list[str]:
    """First words of about equal ranges of the sorted column `word`: one short string for each block."""
    ranges = words.repartitionByRange(blocks, "word").groupBy(F.spark_partition_id().alias("p")).agg(F.min("word").alias("w"))
    return sorted(r["w"] for r in ranges.collect())


class Router:
    """To which blocks a word belongs and which it has to ask.

    Blocks are ranges of the sorted words; those of the mirrored words follow them. A word one error away shares the left half
    and then lies in a range of words that begin with it, or shares the right half and lies in such a range of the mirrored words.
    """

    def __init__(self, plain: list[str], mirrored: list[str]) -> None:
        self.sides = [(plain, 0), (mirrored, len(plain))]
        self.copies: dict[int, int] = {}

    def blocks(self, word: str) -> Iterator[tuple[int, bool]]:
        """(block, whether the word is in it); the word asks all of them."""
        half = len(word) // 2
        for (starts, base), whole, shared in zip(self.sides, (word, word[::-1]), (word[:half], word[half:][::-1])):
            own = max(bisect_right(starts, whole) - 1, 0)
            first = max(bisect_right(starts, shared) - 1, 0)
            last = max(bisect_right(starts, shared, key=lambda s: s[: len(shared)]) - 1, 0)
            for block in range(first, last + 1):
                yield base + block, block == own

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for block, own in self.blocks(word):
                    copies = self.copies.get(block, 1)
                    asks = crc32(word.encode()) % copies
                    out += [(block, copy, own, copy == asks, word, n) for copy in (range(copies) if own else (asks,))]
            fields = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(fields, ROUTED.values())], names=list(ROUTED))


ROUTED = {"block": pa.int32(), "copy": pa.int32(), "own": pa.bool_(), "asks": pa.bool_(), "word": pa.string(), "n": pa.int64()}
ROUTED_DDL = "block int, copy int, own boolean, asks boolean, word string, n bigint"


def search_block(first_mirrored: int):
    """Function of one block's rows: for each word that asks, how many words of the block are near, and the most frequent of them."""

    def search(rows: pa.Table) -> pa.Table:
        mirrored = rows.column("block")[0].as_py() >= first_mirrored
        words, own, asks, n = (rows.column(c).to_pylist() for c in ("word", "own", "asks", "n"))
        listed = sorted(i for i, o in enumerate(own) if o)
        asking = [i for i, a in enumerate(asks) if a]
        best: dict[int, int] = {}
        near: Counter = Counter()
        if listed and asking:
            known = Words([words[i] for i in listed])
            queries = known.encode([words[i] for i in asking])
            halves = [len(q) // 2 for q in queries]
            index = known.index()
            if mirrored:
                found = one_error(index.mirrored(), [q[::-1] for q in queries], [len(q) - h for q, h in zip(queries, halves)])
            else:
                found = one_error(index, queries, halves)
            for q, v in zip(*(side.tolist() for side in found)):
                i, j = asking[q], listed[v]
                if mirrored and words[j].startswith(words[i][: halves[q]]):
                    continue  # found by the left half
                near[i] += 1
                if i not in best or (-n[j], words[j]) < (-n[best[i]], words[best[i]]):
                    best[i] = j
        hit = list(near)
        return pa.table({
            "word": pa.array([words[i] for i in hit], pa.string()), "n_near": pa.array([near[i] for i in hit], pa.int64()),
            "form": pa.array([words[best[i]] for i in hit], pa.string()), "form_n": pa.array([n[best[i]] for i in hit], pa.int64()),
        })

    return search


def nearest(vocabulary: DataFrame, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """(word, n_near, form, form_n) for each word of (word, n) that has near ones: their number and the one of largest n.

    Near is one inserted, deleted or replaced code point. Ties go to the smallest word in code-point order. `vocabulary` holds each word once.
    The starts of the blocks are the only thing the driver sees. A block that more than `asked` words ask is built in
    several tasks that share the questions, so no task holds more than a block and its share.
    """
    blocks = max(1, -(-vocabulary.count() // block))
    router = Router(block_starts(vocabulary, blocks), block_starts(vocabulary.select(F.reverse("word").alias("word")), blocks))
    if not router.sides[0][0]:
        return vocabulary.sparkSession.createDataFrame([], FOUND)
    pairs = vocabulary.select("word", "n")
    load = pairs.mapInArrow(router.rows, ROUTED_DDL).groupBy("block").count().collect()
    router.copies = {r["block"]: -(-r["count"] // asked) for r in load}
    tasks = sum(router.copies.values())
    dealt = pairs.mapInArrow(router.rows, ROUTED_DDL).repartition(tasks, "block", "copy")
    hits = dealt.groupBy("block", "copy").applyInArrow(search_block(len(router.sides[0][0])), FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("key"), F.col("form"), F.col("form_n"))).alias("best")
    return hits.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", "best.form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the links (word, form), followed to the end. Pointers are doubled in each round; links have no circles."""
    at = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = saved(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return at


def group_variants(counts: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of (word, n) that is long and frequent enough.

    `form` is the near word of largest n if that is at least `ratio` (more than 1) times the word's own, else null. Forms grow along a chain,
    so it ends; its last word is the root, the word itself where it has no form. No words give no rows.
    """
    vocabulary = saved(counts.filter((F.length("word") >= min_length) & (F.col("n") >= min_count)))
    near = nearest(vocabulary)
    right = F.col("form_n") >= ratio * F.col("n")
    known = saved(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(right, F.col("form")).alias("form"), F.when(right, F.col("form_n")).alias("form_n")
        )
    )
    last = roots(known.filter("form is not null"))
    return known.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
