"""Spelling variants against all pairs of small vocabularies."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import fmindex, plans, spelling

SMALL = "/root/testdata/sf0.001"


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def slow_groups(counts, near=None):
    """{word: (n, n_near, form, form_n, root)}"""
    near = near or {w: [v for v in counts if is_near(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= 2 * counts[w]}
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form.get(w), counts[form[w]] if w in form else None, root)
    return out


def slow_counts(docs, drop_every):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc is None else doc}:{word}".encode())
            n[word if h % drop_every else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    return {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}


def cuts(words):
    """Near words by what is left when a letter is cut out; quicker than all pairs."""
    by_cut, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            by_cut.setdefault(w[:i] + w[i + 1 :], []).append((i, w))
    for short, group in by_cut.items():
        for i, w in group:
            near[w] |= {v for j, v in group if i == j and v != w}
            if short in near:
                near[w].add(short)
                near[short].add(w)
    return near


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abä", min_size=1, max_size=6), min_size=1, max_size=40, unique=True), st.lists(st.text("abzß", min_size=1, max_size=6), max_size=5))
def test_index_finds_words_one_error_away(words, others):
    known = fmindex.Words(words)
    index, asked = known.index(), words + others
    codes = known.encode(asked)
    halves = [len(q) // 2 for q in codes]
    right = fmindex.one_error(index, codes, halves)
    left = fmindex.one_error(index.mirrored(), [q[::-1] for q in codes], [len(q) - h for q, h in zip(codes, halves)])
    found = [{(asked[q], words[v]) for q, v in zip(*(s.tolist() for s in side))} for side in (right, left)]
    want = {(q, w) for q in asked for w in words if is_near(q, w)}
    assert found[0] == {(q, w) for q, w in want if w.startswith(q[: len(q) // 2])}
    assert found[1] == {(q, w) for q, w in want if w.endswith(q[len(q) // 2 :])}


def test_both_sides_stay_in_step():
    words = ["banana", "bandana", "an", "nab", "anna"]
    known = fmindex.Words(words)
    index = known.index()
    text = "|" + "|".join(words)
    around, back = text * 2, text[::-1] * 2

    def count(pattern, where):
        return sum(where.startswith(pattern, i) for i in range(len(text)))

    for pattern in ("an", "ana", "nd", "|an", "a|", "nab|", "b"):
        symbols = [known.code.get(c, 0) for c in pattern]
        for split in range(len(pattern) + 1):  # grow from the middle to the left, then to the right
            state = (np.array([0]), np.array([index.size]), np.array([0]))
            for s in symbols[:split][::-1]:
                state = index.grow_left(np.array([s]), *state)
            for s in symbols[split:]:
                state = index.grow_right(np.array([s]), *state)
            lo, hi, mirror = (int(v[0]) for v in state)
            assert hi - lo == count(pattern, around) == count(pattern[::-1], back)
            first, last, low = index.mirrored().grow_left(np.array([0]), np.array([mirror]), np.array([mirror + hi - lo]), np.array([lo]))
            assert int(last[0] - first[0]) == count(pattern + "|", around)


def test_rotations_of_repeated_text():
    for text in ("|ab|abab|ababab", "|a", "|aaaa|aaa|aa|a|b"):
        codes = np.array([0 if c == "|" else ord(c) - 96 for c in text])
        rows = fmindex.rotations(codes, 2)
        turned = [text[i:] + text[:i] for i in rows]
        assert [t.replace("|", "\0") for t in turned] == sorted(t.replace("|", "\0") for t in turned)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    counts = slow_counts(docs, 97)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in plans.op13_spelling(spark, SMALL).collect()}
    assert got == slow_groups(counts, cuts(counts))
    assert any(r[2] for r in got.values()) and any(r[4] != r[2] for r in got.values() if r[2])


@pytest.mark.parametrize(("block", "asked"), [(1 << 14, 1 << 16), (16, 1 << 16), (9, 12)])
def test_blocks_and_hot_beginnings(spark, block, asked):
    """A third of the words begin alike; blocks are small, asked by many and built several times."""
    rng = random.Random(8)
    words = {"prefix" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(60)}
    words |= {"".join(rng.choice("abcä") for _ in range(rng.randint(1, 5))) for _ in range(80)} | {"x" * 300, "x" * 301, "y" + "x" * 300}
    counts = {w: rng.choice((3, 3, 5, 8, 40)) for w in words}
    got = spelling.nearest(spark.createDataFrame(list(counts.items()), "word string, n long"), block, asked).collect()
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    want = {w: (len(vs), min(vs, key=lambda v: (-counts[v], v))) for w, vs in near.items() if vs}
    assert {r["word"]: (r["n_near"], r["form"]) for r in got} == want and len(got) == len(want)
    assert all(r["form_n"] == counts[r["form"]] for r in got)


def test_odd_rows(spark):
    text = "Straße strase STRASE strase straßen; naïve naive naive naive Éclair éclair"
    docs = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "12 ?!"), (5, "word " * 30000), (6, "wordy words swords " * 3)]
    df = spark.createDataFrame([(d, t, "w", 0) for d, t in docs], "doc_id long, text string, word string, n int")
    got = {r["word"]: tuple(r)[1:] for r in spelling.group_variants(spelling.word_counts(df, drop_every=2)).collect()}
    assert got == slow_groups(slow_counts(docs, 2)) and got
    plain = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert plain["word"] == 30000 and plain["strase"] == 9 and plain["Éclair"] == plain["éclair"] == 3
    assert spelling.group_variants(spelling.word_counts(df.limit(0))).count() == 0
    assert spelling.group_variants(spelling.word_counts(df.filter("doc_id = 4"))).count() == 0
    one = spelling.group_variants(spark.createDataFrame([("alone", 4)], "word string, n long")).collect()
    assert [tuple(r) for r in one] == [("alone", 4, 0, None, None, "alone")]


def test_long_chains_end_at_the_root(spark):
    links = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(40)] + [("x", "w003")]
    assert {(r["word"], r["root"]) for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()} == {(w, "w040") for w, _ in links}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0
