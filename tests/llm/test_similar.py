import re
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from folioscope.llm import similar


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_heads(texts):
    """texts: {doc: text}"""
    sets, head = {d: slow_set(t) for d, t in texts.items()}, {d: d for d in texts}
    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            low, high = sorted((head[a], head[b]))
            head = {d: low if h == high else h for d, h in head.items()}
    return head


def planted(rng):
    """Texts with copies in which words are changed, so that similarities lie on both sides of 0.8, and a passage many share."""
    word = lambda: f"w{rng.integers(0, 5000)}"
    passage = [word() for _ in range(30)]
    texts = {}
    for base in range(25):
        own = [word() for _ in range(int(rng.integers(5, 200)))] + (passage if base % 2 else [])
        for changes in (0, 1, 1, 2, 4, 8):
            copy = list(own)
            for at in rng.integers(0, len(copy), changes if base else 0):
                copy[at] = word()
            texts[len(texts)] = " ".join(copy)
    return texts


def test_stage_drops_planted_near_copies(spark):
    texts = planted(np.random.default_rng(3))
    heads = slow_heads(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(heads.values()))
    assert 25 < len(set(heads.values())) < len(texts) - 30


@pytest.mark.parametrize("turns,block", [(1, 4), (2, 4096)])
def test_components_equal_all_pairs(spark, monkeypatch, turns, block):
    monkeypatch.setattr(similar, "SAMPLE", 1)
    texts = planted(np.random.default_rng(8))
    # A chain in one token's group, of which only neighbours are similar.
    run = [f"c{i}" for i in range(200)]
    texts |= {1000 + k: " ".join(["start of the same passage", *run[k * 6 : k * 6 + 80]]) for k in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc"]: r["component_id"] for r in similar.cluster(docs, turns=turns, block=block).collect()}
    assert got == slow_heads(texts)


def test_similarity_of_exactly_four_fifths_counts(spark):
    nine = [f"n{i}" for i in range(13)]  # 9 shingles
    data = {1: " ".join(nine[:12]), 2: " ".join(nine[:12] + ["a", "b"]), 3: " ".join(nine[:12] + ["x", "y", "z"])}  # 8 of 10, 8 of 11
    got = {r["doc"]: r["component_id"] for r in similar.cluster(spark.createDataFrame(list(data.items()), "doc_id long, text string")).collect()}
    assert got == slow_heads(data) == {1: 1, 2: 1, 3: 3}


def test_nulls_blanks_repeats_and_clashing_columns(spark):
    data = [(1, None, "a"), (2, " \n", "b"), (3, "one two three four", "c"), (4, "one two three four", "d"), (4, "one two three four", "d"), (None, "ONE two  three four", "e")]
    docs = spark.createDataFrame(data, "doc_id long, text string, tag string")
    assert {(r["doc"], r["component_id"]) for r in similar.cluster(docs).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (None, 3)}
    kept = similar.drop_similar(docs.union(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert similar.cluster(docs.limit(0)).count() == 0


def test_stage_over_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    heads = slow_heads({r["doc_id"]: r["text"] for r in docs.collect()})
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(heads.values()))


def test_simhash_links_copies_that_differ_by_a_word(spark):
    words = [f"w{n * 7919 % 100003}" for n in range(1500)]
    texts = {1: " ".join(words), 2: " ".join(words[:700] + ["other"] + words[701:]), 3: " ".join(reversed(words))}
    base = spark.createDataFrame([(d, d, t) for d, t in texts.items()], "doc long, tag long, text string")
    prints = similar.sketches(base, np.empty(0, np.uint64), 0.8, 5, 42)
    key = {r["doc"]: r["key"] for r in prints.collect()}
    assert [tuple(r) for r in similar.print_pairs(prints, 0.8, 3, 4096).collect()] == [tuple(sorted((key[1], key[2])))]
