"""SimHash near-duplicates with bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import each_text, packed, row_tag, saved, unpacked
from folioscope.llm.components import components

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)
# Comparisons held at once, in words of 64 lanes, and planes between two looks for blocks to abandon.
CHUNK, STRIDE = 1 << 16, 8


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """64-bit hashes of the word shingles of a text, in order."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles of a text; bits set in over half of the hashes."""
    return print_of(shingle_hashes(text, shingle, seed))


def print_of(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # sums of up to 255 bits fit a byte
        counts += np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """Plane b holds bit b of every fingerprint, 64 of them to a word."""
    words = -(-len(prints) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def over_radius(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for level in range(len(counters) - 1, -1, -1):
        if radius >> level & 1:
            equal &= counters[level]
        else:
            above |= equal & counters[level]
            equal &= ~counters[level]
    return above


def near_pairs(prints: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j < ends[i], of fingerprints within the radius, a chunk at a time.

    A row is compared with 64 others at once: the difference in each plane is added to carry-save counters that hold one
    bit of all 64 counts in a word. Every few planes, words in which all counts are above the radius are abandoned.
    """
    planes = bit_planes(prints)
    rows = np.flatnonzero(ends > np.arange(len(prints)) + 1)
    first, last = (rows + 1) >> 6, (ends[rows] - 1) >> 6
    until = np.cumsum(last - first + 1)
    begin = 0
    while begin < len(rows):
        done = until[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(until, done + CHUNK, "right")))
        own = np.arange(begin, stop)
        size = (last - first + 1)[own]
        query = np.repeat(rows[own], size)
        word = np.repeat(first[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        low = np.where(word == (query + 1) >> 6, (query + 1) & 63, 0).astype(np.uint64)
        high = np.where(word == (ends[query] - 1) >> 6, (ends[query] - 1) & 63, 63).astype(np.uint64)
        over = ~((ALL << low) & (ALL >> (np.uint64(63) - high)))
        counters = [np.zeros(len(query), np.uint64) for _ in range(max(1, radius.bit_length()))]
        for bit in range(64):
            carry = planes[bit][word] ^ (np.uint64(0) - (prints[query] >> np.uint64(bit) & ONE))
            for level, counter in enumerate(counters):
                carry, counters[level] = counter & carry, counter ^ carry
            over |= carry
            if bit % STRIDE == STRIDE - 1:
                over |= over_radius(counters, radius)
                live = over != ALL
                if not live.all():
                    query, word, over = query[live], word[live], over[live]
                    counters = [c[live] for c in counters]
        if len(query):
            hit, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield query[hit], word[hit] * 64 + lane
        begin = stop


def spanning_links(prints: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint that is linked to an earlier one of its group, itself and the first it is connected to."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    ends = np.repeat(np.append(starts[1:], len(groups)), np.diff(np.append(starts, len(groups))))
    label = np.arange(len(prints))
    for i, j in near_pairs(prints, ends, radius):
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def fingerprints(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(doc, tag, print) of a table (doc, tag, text)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches):
            own = pa.array([fingerprint(t, shingle, seed) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own], names=["doc", "tag", "print"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "tag", "text").mapInArrow(score, f"doc {kind}, tag long, print long")


def part_keys(radius: int) -> Column:
    """Bucket keys: of radius + 2 parts, two near fingerprints share two at least."""
    parts = radius + 2
    bounds = [round(64 * k / parts) for k in range(parts + 1)]
    piece = [
        F.shiftrightunsigned("print", bounds[k]).bitwiseAND(F.lit((1 << bounds[k + 1] - bounds[k]) - 1)) for k in range(parts)
    ]
    return F.array(*[F.struct(F.lit(n).alias("part"), piece[x].alias("x"), piece[y].alias("y")) for n, (x, y) in enumerate(combinations(range(parts), 2))])


def links(prints: DataFrame, radius: int, block: int = 4096) -> DataFrame:
    """Links (a, b) of distinct fingerprints that connect all pairs within the radius.

    Fingerprints that share two parts meet in a bucket. Buckets above `block` are dealt to blocks by hash and every block
    meets every other one, so a task never holds more than two blocks of a bucket. A task gives one link for each
    fingerprint it connects, not all pairs.
    """
    spread = prints.select("print", F.explode(part_keys(radius)).alias("key"))
    large = spread.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    dealt = spread.join(large, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    # Distinct groups of equal hash would only be compared in one go, which finds no false link.
    met = dealt.select("print", meet.alias("met")).repartition("met").sortWithinPartitions("met", "print")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_print, held_met = np.empty(0, np.uint64), np.empty(0, np.int64)

        def found(prints_: np.ndarray, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(prints_) > 1:
                a, b = spanning_links(prints_, groups, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            own = np.concatenate([held_print, batch.column(0).to_numpy().view(np.uint64)])
            groups = np.concatenate([held_met, batch.column(1).to_numpy()])
            whole = int(np.searchsorted(groups, groups[-1])) if len(groups) else 0  # the last group may go on
            yield from found(own[:whole], groups[:whole])
            held_print, held_met = own[whole:], groups[whole:]
        yield from found(held_print, held_met)

    return met.mapInArrow(compare, "a long, b long").distinct()


def cluster(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc, tag, print, component_id, keeper_tag): the component of documents linked by fingerprints within the radius.

    Words are lower-cased in A-Z; a text of fewer than `shingle` words is one shingle; null, empty and blank texts have
    fingerprint zero, linked like any other. component_id is the smallest document id reachable, null only where all ids
    are; keeper_tag marks that document's row. Repeated rows share a component. An empty table gives an empty table.

    Copies meet as one fingerprint before anything is compared. Fingerprints, links and components stay in tables.
    """
    base = packed(docs, doc=doc, text=text).withColumn("tag", row_tag("doc", "text"))
    prints = saved(fingerprints(base, shingle, seed))
    first = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "tag")).alias("first")
    nodes = prints.groupBy("print").agg(first)
    roots = components(links(nodes.select("print"), radius))
    grouped = nodes.join(roots, F.col("print") == F.col("node"), "left").withColumn("root", F.coalesce("root", "print"))
    heads = grouped.groupBy("root").agg(F.min("first").alias("head"))
    named = grouped.join(heads, "root").select(F.col("print").alias("of"), F.col("head.doc").alias("component_id"), F.col("head.tag").alias("keeper_tag"))
    return prints.join(named, F.col("print") == F.col("of")).select("doc", "tag", "print", "component_id", "keeper_tag")


def keep_heads(docs: DataFrame, clustered: DataFrame, doc: str, text: str) -> DataFrame:
    """The rows of `docs` that name their component; of repeated rows one stays."""
    heads = clustered.filter(F.col("doc").eqNullSafe(F.col("component_id")) & (F.col("tag") == F.col("keeper_tag")))
    keep = saved(heads.groupBy(F.col("doc").alias("of_doc"), F.col("tag").alias("of_tag")).agg(F.count("*").alias("rows")))
    base = packed(docs, doc=doc, text=text).withColumn("tag", row_tag("doc", "text"))
    kept = base.join(keep, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("tag") == F.col("of_tag")), "left_semi")
    if keep.filter("rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc", "tag"])
    return unpacked(kept, docs)


def drop_near_copies(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs` without all but the smallest document id of each component; of repeated rows one stays."""
    return keep_heads(docs, cluster(docs, doc, text, **how), doc, text)
