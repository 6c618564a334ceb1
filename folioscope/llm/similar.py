"""Near copies by the exact Jaccard similarity of their word shingles: SimHash finds the nearest, a prefix filter the rest."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import checked_broadcast, each_text, packed, row_tag, saved
from folioscope.llm.components import components
from folioscope.llm.simhash import keep_heads, links as near_prints, print_of, shingle_hashes

# One document in SAMPLE tells which shingles are common: those of COMMON sampled documents, LISTED at most. That only
# orders shingles, and every order finds the same pairs.
SAMPLE, COMMON, LISTED = 16, 3, 1 << 18
# Pairs given out at once by a task, and keys that are broadcast.
CHUNK, SMALL = 1 << 16, 100_000


def shingle_set(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted."""
    return np.unique(shingle_hashes(text, shingle, seed))


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def prefix_of(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones first, such that two sets of the similarity share one of them at least.

    Of n shingles such sets have s * n in common, rounded up, so one of any n - s * n + 1 is among those.
    """
    share = Fraction(str(similarity))
    size = len(hashes) - -(-share.numerator * len(hashes) // share.denominator) + 1 if len(hashes) else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = common[at] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[:size]


def common_shingles(base: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """Hashes of common shingles, sorted, by a sample of the documents."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in each_text(batches):
            for text in texts:
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, shingle, seed).view(np.int64))], names=["token"])

    sample = base.filter(F.pmod(F.xxhash64("tag"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(spread, "token long")
    often = sample.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(LISTED)
    return np.sort(np.array([r["token"] for r in often.collect()], np.int64).view(np.uint64))


def sketches(base: DataFrame, common: np.ndarray, similarity: float, shingle: int, seed: int) -> DataFrame:
    """(doc, tag, key, size, prefix, print): key marks the set of shingles, print is the SimHash of the text's shingles."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches):
            hashes = [shingle_hashes(t, shingle, seed) for t in texts]
            prints = pa.array([print_of(h) for h in hashes], pa.int64())
            sets = [np.unique(h) for h in hashes]
            keys = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
            prefixes = pa.array([prefix_of(s, common, similarity).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys), pa.array(list(map(len, sets)), pa.int32()), prefixes, prints],
                names=["doc", "tag", "key", "size", "prefix", "print"],
            )

    kind = base.schema["doc"].dataType.simpleString()
    return base.select("doc", "tag", "text").mapInArrow(sketch, f"doc {kind}, tag long, key long, size int, prefix array<long>, print long")


def shared_tokens(nodes: DataFrame) -> DataFrame:
    """(token, key, size): prefix shingles that two sets have at least. The last group of a batch may go on in the next."""
    met = nodes.select(F.explode("prefix").alias("token"), "key", "size").repartition("token").sortWithinPartitions("token")

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            token = batch.column(0).to_numpy()
            if not len(token):
                continue
            same = token[1:] == token[:-1]
            twice = np.concatenate([[token[0] == last], same]) | np.concatenate([same, [False]])
            if held is not None and token[0] == last:
                yield held
            yield batch.filter(pa.array(twice))
            last, held = token[-1], None if twice[-1] else batch.slice(len(token) - 1)

    return met.mapInArrow(repeated, "token long, key long, size int")


def ordered(pairs: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, whose sizes allow the similarity."""
    fit = F.least("size", "other_size") / F.greatest("size", "other_size") >= similarity
    return pairs.filter((F.col("key") != F.col("other")) & fit).select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def print_pairs(only: DataFrame, similarity: float, radius: int, block: int) -> DataFrame:
    """Pairs of sets (a, b) by SimHash: those of a fingerprint with its first set, and first sets of fingerprints linked within the radius. only: (key, size, print)."""
    first = saved(only.groupBy("print").agg(F.min(F.struct("key", "size")).alias("f")).select("print", F.col("f.key").alias("other"), F.col("f.size").alias("other_size")))
    near = near_prints(first.select("print"), radius, block)
    head = lambda name: first.select(F.col("print").alias(name), F.col("other").alias(f"key_{name}"), F.col("other_size").alias(f"size_{name}"))
    linked = near.join(head("a"), "a").join(head("b"), "b").select(
        F.col("key_a").alias("key"), F.col("size_a").alias("size"), F.col("key_b").alias("other"), F.col("size_b").alias("other_size")
    )
    same = only.select("print", "key", "size").join(first, "print").select("key", "size", "other", "other_size")
    return ordered(same.unionByName(linked), similarity)


def star_pairs(shared: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Each set of a token with one of its sets, another one each turn."""
    middle = F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("rank"), F.col("key").alias("other"), F.col("size").alias("other_size"))).alias("m")
    return ordered(shared.join(shared.groupBy("token").agg(middle).select("token", "m.other", "m.other_size"), "token"), similarity)


def cross_pairs(labelled: DataFrame, similarity: float, block: int) -> DataFrame:
    """All pairs of sets that share a token and are not connected yet. labelled: (token, key, size, root).

    Tokens of more than `block` sets are dealt to blocks by hash and every block meets every other one.
    """
    mixed = labelled.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token", "n")
    dealt = labelled.join(mixed, "token").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    met = dealt.select(meet.alias("met"), "key", "size", "root").repartition("met").sortWithinPartitions("met", "size")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(group: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            _, key, size, root = group
            # Sizes rise, so the sets near enough to one in size follow it closely.
            ends = np.searchsorted(size, np.floor(size / similarity + 1e-6), "right")
            left, right, n = [], [], 0
            for i in range(len(key) - 1):
                j = np.arange(i + 1, ends[i])
                j = j[root[j] != root[i]]
                left.append(np.full(len(j), key[i]))
                right.append(key[j])
                n += len(j)
                if n >= CHUNK or i == len(key) - 2:
                    a, b = np.concatenate(left), np.concatenate(right)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                    left, right, n = [], [], 0

        held = None
        for batch in batches:
            own = [c.to_numpy() for c in batch.columns]
            own = own if held is None else [np.concatenate(x) for x in zip(held, own)]
            if not len(own[0]):
                continue
            cuts = [0, *(np.flatnonzero(own[0][1:] != own[0][:-1]) + 1).tolist()]
            for x, y in zip(cuts, cuts[1:]):  # the last group may go on
                yield from found([c[x:y] for c in own])
            held = [c[cuts[-1] :] for c in own]
        if held is not None:
            yield from found(held)

    return met.mapInArrow(compare, "a long, b long").filter("a <> b").distinct()


def possible_pairs(pairs: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that may have the similarity by their prefixes. sketched: (key, size, prefix).

    Of two prefixes one ends first in the order of shingles. What its set shares lies in both prefixes, or behind its own.
    """
    side = lambda k: sketched.select(F.col("key").alias(k), F.col("size").alias(f"size_{k}"), F.col("prefix").alias(f"prefix_{k}"))
    behind = F.greatest(*[F.col(f"size_{k}") - F.size(f"prefix_{k}") for k in "ab"])
    most = F.least("size_a", "size_b", F.size(F.array_intersect("prefix_a", "prefix_b")) + behind)
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(most / (F.col("size_a") + F.col("size_b") - most) >= similarity).select("a", "b")


def similar_pairs(pairs: DataFrame, base: DataFrame, heads: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """The pairs (a, b) whose sets have the Jaccard similarity; sets are made again from the texts asked for."""
    asked = saved(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(heads.select("key", "doc", "tag"), "key").select(F.col("doc").alias("of_doc"), F.col("tag").alias("of_tag")))
    of = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("tag") == F.col("of_tag"))
    texts = base.select("doc", "tag", "text").join(checked_broadcast(asked, asked.count(), SMALL), of, "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in each_text(batches):
            sets = [shingle_set(t, shingle, seed) for t in texts]
            keys = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "hashes"])

    # Repeated rows have the same set.
    sets = saved(texts.select("text").mapInArrow(sets_of, "key long, hashes array<long>").dropDuplicates(["key"]))
    left, right = sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return both.filter(F.col("both") / (F.size("x") + F.size("y") - F.col("both")) >= similarity).select("a", "b")


def cluster(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, seed: int = 42, turns: int = 2, block: int = 4096, radius: int = 3,
) -> DataFrame:
    """(doc, tag, key, component_id, keeper_tag): the component of documents linked by shingle sets of the similarity.

    Words, short texts, nulls and blanks are as for fingerprints; null, empty and blank texts have the empty set, equal to
    itself alone. component_id is the smallest document id reachable, null only where all ids are; keeper_tag marks that
    document's row. Repeated rows share a component. An empty table gives an empty table.

    Equal sets meet as one. SimHash fingerprints of the shingles, compared by bit planes, link those within the radius; a wider radius
    would meet nearly all pairs and still not reach every one of the similarity. Sets that can reach it share a prefix shingle; each is
    compared with one set of every such shingle, then pairs not connected by that are compared one and all, so a large group of near
    copies is not compared pair by pair. No pair is left to chance: every candidate's similarity is computed from its whole set.
    """
    base = packed(docs, doc=doc, text=text).withColumn("tag", row_tag("doc", "text"))
    prints = saved(sketches(base, common_shingles(base, shingle, seed), similarity, shingle, seed))
    first = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "tag")).alias("first")
    nodes = prints.groupBy("key").agg(first)
    heads = saved(nodes.select("key", "first", "first.doc", "first.tag"))
    of = [F.col(f"p.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("key", "doc", "tag")]
    only = prints.alias("p").join(heads.alias("h"), of, "left_semi")
    shared = saved(shared_tokens(only).distinct())
    sketched = saved(only.join(shared.select("key").distinct(), "key", "left_semi").select("key", "size", "prefix").dropDuplicates(["key"]))
    links, tested = None, None
    for turn in range(-1, turns + 1):
        if turn < 0:
            pairs = print_pairs(only.select("key", "size", "print"), similarity, radius, block)
        elif turn < turns:
            pairs = star_pairs(shared, similarity, turn)
        else:
            labelled = shared.join(components(links), F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
            pairs = cross_pairs(labelled, similarity, block)
        pairs = saved(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        possible = saved(possible_pairs(pairs, sketched, similarity))
        found = saved(similar_pairs(possible, base, heads, similarity, shingle, seed))
        links = found if links is None else links.unionByName(found)
    grouped = heads.join(components(links), F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    first_of = grouped.groupBy("root").agg(F.min("first").alias("head"))
    named = grouped.join(first_of, "root").select(F.col("key").alias("of"), F.col("head.doc").alias("component_id"), F.col("head.tag").alias("keeper_tag"))
    return prints.select("doc", "tag", "key").join(named, F.col("key") == F.col("of")).drop("of")


def drop_similar(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs` without all but the smallest document id of each component; of repeated rows one stays."""
    return keep_heads(docs, cluster(docs, doc, text, **how), doc, text)
