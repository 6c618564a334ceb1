import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import lm, plans

SMALL = "/root/testdata/sf0.001"


def slow(docs, share=0.1):
    """{key: row} by brute force; docs: (key, id, text)"""
    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    held = {k: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for k, d, _ in docs}
    words, pairs, first = Counter(), Counter(), Counter()
    for k, _, t in docs:
        if not held[k]:
            own = tokens(t)
            words.update(own)
            pairs.update(zip(["<>", *own], own))
            first.update(["<>", *own[:-1]])
    n, v = sum(words.values()), len(words)
    single = lambda w: (words[w] + 0.5) / (n + 0.5 * (v + 1))
    both = lambda a, w: share * pairs[a, w] / first[a] + (1 - share) * single(w) if first[a] else single(w)
    out = {}
    for k, _, t in docs:
        own = tokens(t)
        out[k] = (held[k], len(own), sum(words[w] > 0 for w in own), n, sum(math.log10(single(w)) for w in own), sum(math.log10(both(a, w)) for a, w in zip(["<>", *own], own)))
    return out


def test_query_matches_brute_force(spark):
    docs = [(r["doc_id"], r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = slow(docs)
    rows = plans.op5_lm_score(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], abs=1e-6) and r["score"] == pytest.approx(w[5], abs=2e-4 * w[1])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_small_shards_files_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "PAIRS", 64)
    monkeypatch.setattr(lm, "WORDS", 16)
    data = [(None, "a b c"), (7, None), (7, ""), (8, "A\tb  c d\n" * 30), (9, "x" * 5000), (9, "x" * 5000)] + [(i, f"w{i % 7} w{i % 3} the end é") for i in range(20, 60)]
    docs = spark.createDataFrame([(d, t, False, -1) for d, t in data], "doc_id long, text string, held boolean, score int").repartition(3)
    want = slow([(i, d, t) for i, (d, t) in enumerate(data)])
    got = sorted(((r["doc"] is not None, r["doc"] or 0, *r[1:4], r["train_tokens"], round(r["base_score"], 6), r["score"]) for r in lm.score_documents(docs).collect()))
    flat = sorted((d is not None, d or 0, w[0], w[1], w[2], w[3], round(w[4], 6), w[5]) for (d, _), w in zip(data, want.values()))
    assert [g[:6] for g in got] == [f[:6] for f in flat]
    assert [g[6] for g in got] == pytest.approx([f[6] for f in flat], abs=1e-5) and [g[7] for g in got] == pytest.approx([f[7] for f in flat], abs=2e-2)
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_trie_answers_what_it_holds():
    rng = np.random.default_rng(3)
    keys = np.unique((rng.integers(1, 40, 3000) << 32) | rng.integers(1, 500, 3000))
    log_p = rng.uniform(-9, 0, len(keys))
    trie = lm.Trie(lm.map_bytes(lm.Trie.build(keys, log_p)))
    assert np.abs(trie.log_p(keys) - log_p).max() < 9 / lm.LEVELS
    others = np.setdiff1d((np.arange(0, 45) << 32)[:, None] | np.arange(0, 505), keys)
    assert np.isnan(trie.log_p(others)).all()
    assert np.isnan(lm.Trie(lm.map_bytes(lm.Trie.build(keys[:0], log_p[:0]))).log_p(keys)).all()
