"""Benchmark decontamination: test suffixes are searched in suffix arrays of the training text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import each_text, packed, text_of

# Words are runs of letters, digits and bytes above ASCII; A-Z are lower-cased and all else becomes a blank.
WORD_BYTES = bytes((b | 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Words of documents in one suffix array, and bytes of tests that one pass ships to every task.
SHARD_WORDS, TEST_BYTES = 1 << 20, 32 << 20


def words_of_bytes(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class Tests:
    """Windows of a block of test items, as word numbers in packed order keys."""

    number: dict[bytes, int]  # of each word, from 1
    window: int
    shortest: int
    lengths: np.ndarray  # words in each distinct window
    low: list[np.ndarray]  # order keys of the smallest and the largest suffix that starts with the window
    high: list[np.ndarray]
    items: list[list[tuple]]  # (item, place) of each window

    @property
    def bits(self) -> int:
        return max(1, len(self.number).bit_length())


def pack(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Word numbers side by side in as few integers as hold them, in the same order."""
    each = 63 // bits
    keys = []
    for at in range(0, len(columns), each):
        key = np.zeros(len(columns[0]), np.int64)
        for column in columns[at : at + each]:
            key = key << bits | column
        keys.append(key)
    return keys


def read_tests(items: list[tuple], window: int) -> Tests | None:
    """Windows of (item, text) rows; an item shorter than the window is one window, one without words is none."""
    number: dict[bytes, int] = {}
    places: dict[tuple, list[tuple]] = {}
    for item, text in items:
        own = [number.setdefault(w, len(number) + 1) for w in words_of_bytes((text or "").encode("utf-8", "surrogatepass"))]
        for at in range(max(1, len(own) - window + 1) if own else 0):
            places.setdefault(tuple(own[at : at + window]), []).append((item, at))
    if not places:
        return None
    distinct = list(places)
    lengths = np.array([len(w) for w in distinct])
    tests = Tests(number, window, int(lengths.min()), lengths, [], [], list(places.values()))
    last = (1 << tests.bits) - 1
    column = lambda k, fill: np.array([w[k] if k < len(w) else fill for w in distinct], np.int64)
    tests.low = pack([column(k, 0) for k in range(window)], tests.bits)
    tests.high = pack([column(k, last) for k in range(window)], tests.bits)
    return tests


def suffix_array(numbers: np.ndarray, tests: Tests) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in order of the words that follow, `window` deep, and their order keys.

    Numbers are 0 for words that no test has and between documents. A suffix enters only if as many test words follow as
    the shortest window has; no other can start with a window.
    """
    tail = np.concatenate([numbers, np.zeros(tests.window, numbers.dtype)])
    inside = np.concatenate([[0], np.cumsum(tail > 0)])
    starts = np.flatnonzero(inside[tests.shortest : tests.shortest + len(numbers)] - inside[: len(numbers)] == tests.shortest)
    keys = pack([tail[starts + k] for k in range(tests.window)], tests.bits)
    order = np.lexsort(keys[::-1])
    return starts[order], [k[order] for k in keys]


def bounds(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of every wanted key in the suffix array, all at once."""
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) >> 1
        before, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for key, want in zip(keys, wanted):
            a, b = key[middle], want[open_]
            before |= equal & (a < b)
            equal &= a == b
        if right:
            before |= equal
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]
    return low


def search(numbers: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every occurrence of every window."""
    suffixes, keys = suffix_array(numbers, tests)
    if not len(suffixes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = bounds(keys, tests.low, False), bounds(keys, tests.high, True)
    count = last - first
    found = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return suffixes[at], found


def longest_matches(places: np.ndarray, found: np.ndarray, tests: Tests) -> list[tuple]:
    """(item, place in the item, place in the document, words) of verbatim matches that cannot be made longer."""
    runs: dict[tuple, list[tuple]] = {}
    for place, window in zip(places.tolist(), found.tolist()):
        for item, at in tests.items[window]:
            runs.setdefault((item, place - at), []).append((place, at, int(tests.lengths[window])))
    out = []
    for (item, _), hits in runs.items():
        hits.sort()
        begin, item_begin, until = hits[0][0], hits[0][1], hits[0][0] + hits[0][2]
        for place, at, length in hits[1:]:
            if place > until - length + 1:  # the windows between are no matches
                out.append((item, item_begin, begin, until - begin))
                begin, item_begin = place, at
            until = place + length
        out.append((item, item_begin, begin, until - begin))
    return sorted(out, key=lambda m: (m[2], m[3], m[0], m[1]))


def scan_documents(texts: list[bytes], tests: Tests) -> list[tuple[int, list[tuple]]]:
    """(words, longest matches) of each text; texts fill suffix arrays of SHARD_WORDS words."""
    out: list[tuple[int, list[tuple]]] = []
    get, shard, lengths = tests.number.get, [], []

    def flush() -> None:
        starts = np.cumsum([0, *[n + 1 for n in lengths]])
        places, found = search(np.array(shard, np.int64), tests)
        owner = np.searchsorted(starts, places, "right") - 1
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(lengths) + 1))
        for k, n in enumerate(lengths):
            own = order[cuts[k] : cuts[k + 1]]
            out.append((n, longest_matches(places[own] - starts[k], found[own], tests) if len(own) else []))
        shard.clear()
        lengths.clear()

    for text in texts:
        own = words_of_bytes(text)
        shard.extend([get(w, 0) for w in own])
        shard.append(0)
        lengths.append(len(own))
        if len(shard) >= SHARD_WORDS:
            flush()
    if lengths:
        flush()
    return out


def test_blocks(tests: DataFrame, window: int, limit: int) -> Iterator[Tests]:
    """The tests in blocks of at most `limit` bytes, or of one item; one pass over the documents takes one block."""
    sizes = tests.select("item", F.octet_length(text_of()).alias("bytes"), F.xxhash64("item", "text").alias("draw"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-2 * total // limit)) if total > limit else 1
    for part in range(parts):
        rows = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()
        block = read_tests([(r["item"], r["text"]) for r in rows], window)
        if block:
            yield block


def find_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = 10, test_bytes: int = TEST_BYTES,
) -> DataFrame:
    """Columns row (the input), n_words, n_hit, items, matches; one row per input row.

    matches: array<struct<item, item_place, doc_place, words>>, the longest verbatim matches of `window` words or more (or of
    a whole item that is shorter), counted in words. A document word inside a match is hit. items: the item ids with a
    match, sorted as text. Null and empty texts have no words; items without words match nothing; items without id are
    named "null"; repeated rows give repeated results; an empty table on either side gives no matches.

    Documents stay where they are: every task sorts the suffixes of its texts, a million words at a time, and searches
    the windows of the tests in them. Tests are shipped in blocks of `test_bytes`, one pass for each block.
    """
    base = packed(docs)
    tests = benchmark.select(F.coalesce(benchmark[f"`{item}`"].cast("string"), F.lit("null")).alias("item"), benchmark[f"`{item_text}`"].alias("text"))
    kind = "array<struct<item:string,item_place:long,doc_place:long,words:long>>"
    row_kind = base.schema["row"].dataType.simpleString()
    schema = f"row {row_kind}, n_words long, matches {kind}"
    found = base.select("row", F.lit(0).cast("long").alias("n_words"), F.array().cast(kind).alias("matches"))
    sent = [docs.sparkSession.sparkContext.broadcast(block) for block in test_blocks(tests, window, test_bytes)]
    if not sent:
        found = found.withColumn("n_words", F.size(F.filter(F.split(F.regexp_replace(F.coalesce(F.col("row")[text], F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " "), " "), lambda w: w != "")).cast("long"))

    for block in sent:

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch, texts in each_text(batches, "row", text):
                results = scan_documents(texts, block.value)
                before = batch.column(2).to_pylist()
                matches = [[*(tuple(m.values()) for m in old), *new] for old, (_, new) in zip(before, results)]
                names = ("item", "item_place", "doc_place", "words")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([n for n, _ in results], pa.int64()), pa.array([[dict(zip(names, m)) for m in own] for own in matches], batch.column(2).type)],
                    names=batch.schema.names,
                )

        found = found.mapInArrow(scan, schema)

    # Matches by place: a word counts as hit where a match reaches past all matches before it.
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_place"].alias("begin"), (m["doc_place"] + m["words"]).alias("stop"))))
    start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("until"))
    step = lambda a, m: F.struct(
        (a["hit"] + F.greatest(F.lit(0).cast("long"), m["stop"] - F.greatest(a["until"], m["begin"]))).alias("hit"), F.greatest(a["until"], m["stop"]).alias("until")
    )
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    return found.select("row", "n_words", F.aggregate(ordered, start, step)["hit"].alias("n_hit"), items.alias("items"), "matches")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents without any match."""
    kept = find_matches(docs, benchmark, **names).filter("n_hit = 0")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
