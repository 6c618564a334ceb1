import re
from itertools import combinations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import plans, simhash
from folioscope.llm.components import components

SMALL = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: {doc: fingerprint}"""
    head = {d: d for d in prints}

    def find(d):
        while head[d] != d:
            d = head[d]
        return d

    for a, b in combinations(sorted(prints), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            head[y] = x
    return {d: find(d) for d in prints}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbBÄé \n\t\x0b\x1c ", max_size=60))
def test_fingerprint_is_the_majority_of_shingle_bits(text):
    assert simhash.fingerprint(text.encode(), 3, 42) % (1 << 64) == slow_fingerprint(text)


def test_bit_sliced_pairs_equal_all_pairs():
    rng = np.random.default_rng(5)
    for radius in (0, 1, 2, 3, 5):
        base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        rows = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(4)])
        groups = np.sort(rng.integers(0, 4, len(rows)))
        ends = np.searchsorted(groups, groups, "right")
        got = {(int(i), int(j)) for a, b in simhash.near_pairs(rows, ends, radius) for i, j in zip(a, b)}
        want = {
            (i, j) for i, j in combinations(range(len(rows)), 2)
            if groups[i] == groups[j] and bin(int(rows[i] ^ rows[j])).count("1") <= radius
        }
        assert got == want


def test_query_matches_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {d: slow_fingerprint(t) for d, t in docs.items()}
    heads = slow_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in plans.op2_simhash(spark, SMALL).collect()}
    assert got == {d: (f"{prints[d]:016x}", heads[d]) for d in docs}


def test_large_buckets_are_split_without_losing_links(spark):
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 1 << 62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (150, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    got = {r["node"]: r["root"] for r in components(simhash.links(frame, 2, block=16)).collect()}
    want = slow_components(dict(enumerate(prints)))
    sizes = {h: sum(x == h for x in want.values()) for h in set(want.values())}
    assert got == {prints[d]: prints[h] for d, h in want.items() if sizes[h] > 1}


def test_long_chains_become_one_component(spark):
    frame = spark.range(60).selectExpr("id * 7919 % 61 as k").selectExpr("k as a", "k + 1 as b")
    got = components(frame).groupBy("root").count().collect()
    edges = [(r["a"], r["b"]) for r in frame.collect()]
    head = {}
    for a, b in sorted(edges):
        head[a] = head.get(a, a)
        head[b] = head[a]
    assert sorted(r["count"] for r in got) == sorted(list(head.values()).count(h) for h in set(head.values()))


def test_nulls_blanks_repeats_and_clashing_columns(spark):
    data = [(1, None, "a"), (2, " \n", "b"), (3, "one two three four", "c"), (4, "one two three four", "d"), (4, "one two three four", "d"), (None, "ONE two  three four", "e")]
    docs = spark.createDataFrame(data, "doc_id long, text string, tag string")
    got = {(r["doc"], r["component_id"]) for r in simhash.cluster(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (None, 3)}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    twice = docs.union(docs)
    assert simhash.drop_near_copies(twice).count() == 2
    assert simhash.cluster(docs.limit(0)).count() == 0
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0
