"""Decontamination, line dedup, quality, mixing and the pipeline against plain versions."""

import hashlib
from collections import defaultdict

import pytest

import corpus_pipeline
from folioscope.llm import decontam, lines, mixing, plans, quality
from tests.llm import brute
from tests.llm.test_similar import slow_heads

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]


def test_decontamination_query(spark, small, items):
    want = brute.decontaminate([(r["doc_id"], r["text"]) for r in small], items)
    for r in plans.op1_decontaminate(spark, SMALL).collect():
        n, hit, found = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_decontamination_of_odd_rows_in_one_and_many_blocks(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    tests = [(1, passage), (2, passage), (3, "short item"), (4, None), (5, ""), (None, "w9 w10 other"), (11, " ".join(f"w{i}" for i in range(5, 40)))]
    docs = [(1, None), (2, ""), (3, "...!"), (4, f"x {passage.upper()}, y"), (5, f"x {passage}"), (5, f"x {passage}"), (6, "a short, item w9-w10/other"), (7, " ".join(f"w{i}" for i in range(12, 21))), (8, "z " * 40000 + passage)]
    left = spark.createDataFrame([(d, t, 0, "m") for d, t in docs], "doc_id long, text string, n_hit int, matches string")
    right = spark.createDataFrame(tests, "item_id long, text string")
    want = brute.decontaminate(docs, [("null" if i is None else i, t) for i, t in tests])
    for limit in (1 << 20, 60):
        rows = decontam.find_matches(left, right, test_bytes=limit).collect()
        assert sorted((r["row"]["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows) == sorted((d, want[d][0], want[d][1], tuple(want[d][2])) for d, _ in docs)
    longest = next(r for r in rows if r["row"]["doc_id"] == 4)["matches"]
    assert max((m["words"], m["item"], m["item_place"], m["doc_place"]) for m in longest) == (30, "2", 0, 1)
    assert decontam.find_matches(left, right.limit(0)).selectExpr("sum(n_hit)", "max(n_words)").first() == (0, 40030)
    assert decontam.find_matches(left.limit(0), right).count() == 0
    kept = decontam.drop_contaminated(left, right)
    assert kept.columns == left.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 7]


def test_line_dedup_of_odd_rows(spark):
    a, b = "A line that Many documents share, with Ä in it, indeed", "another line of more than forty characters it is"
    texts = [(i, f" {a}\t\nown {i}\n{b if i < 4 else 'x'}") for i in range(7)] + [(7, None), (8, ""), (9, a.lower() + "\n" + a), (10, "y" * 39 + "\n" + b), (11, "\n\n" + b + "\n")]
    docs = spark.createDataFrame([(d, t, 1, "p") for d, t in texts], "doc_id long, text string, n_lines int, places string")
    rows = lines.dedup_lines(docs).collect()
    want = brute.dedup_lines(texts)
    assert {r["row"]["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows} == want
    twice = lines.dedup_lines(docs.union(docs)).collect()
    assert len(twice) == 2 * len(texts) and {r["row"]["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in twice} == want
    nameless = spark.createDataFrame([(None, b)] * 3 + [(i, b) for i in range(4)], "doc_id long, text string")
    assert sorted((r["row"]["doc_id"] is None, r["n_dropped"]) for r in lines.dedup_lines(nameless).collect()) == sorted([(True, 1)] * 3 + [(False, 1)] * 3 + [(False, 0)])
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_quality_query(spark, small):
    want = brute.quality([(r["doc_id"], r["text"], r["lang"]) for r in small], quality.COMMON)
    for r in plans.op4_quality(spark, SMALL).collect():
        assert ((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]), r["base_failed"], r["kept"]) == want[r["doc_id"]]


def test_quality_of_odd_rows(spark):
    good = " ".join(f"The cat{i} and of dog{i} in a house{i}." for i in range(12))
    texts = [(i, good.replace("cat", "cow" * (i % 3 + 1)), "en") for i in range(25)] + [
        (100, None, "en"), (101, "", "en"), (102, " \n\t", None), (103, "a b c " * 40, "en"), (104, good.replace("a", "#").upper(), "en"), (105, good, None), (106, good, "xx"),
        (107, "x\ny\nx\n\n \nx", "en"), (108, "word " * 30000, "en"), (109, "é" * 100000, "fr"), (110, " ".join(f"{i}%%%|||&&&{i}***" for i in range(80)), "en"),
    ]
    docs = spark.createDataFrame([(d, t, x, 5, True) for d, t, x in texts], "doc_id long, text string, lang string, place int, kept boolean")
    want = brute.quality(texts, quality.COMMON)
    got = {r["row"]["doc_id"]: (tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), r["base_failed"], r["kept"]) for r in quality.assess(docs).collect()}
    assert got == want
    assert got[105][2] and got[106][2] and not got[110][2] and not got[104][2]
    kept = quality.keep_good(docs.union(docs))
    assert kept.columns == docs.columns and kept.count() == 2 * sum(w[2] for w in want.values())
    assert quality.assess(docs.limit(0)).count() == 0


def test_quotas_share_what_a_small_source_cannot_take():
    assert mixing.quotas({"a": 10, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 2}, 210, 3) == pytest.approx({"a": 30, "b": 60, "c": 120})
    assert mixing.quotas({"a": 0, "b": 5}, {"a": 1, "b": 1}, 5, 3) == pytest.approx({"a": 0, "b": 5})


def test_flow_repeats_as_little_as_it_can():
    given = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150.0, "b": 60.0})
    assert sum(given[p].get("a", 0) for p in given) == 150 and sum(given[p].get("b", 0) for p in given) == 60
    assert given[("a", "b")] == {"a": 50, "b": 50} and given[("b",)] == {"b": 10}
    given = mixing.route({("a",): 10}, {"a": 25.0})
    assert given == {("a",): {"a": 25}}


def check_mix(rows, near=0.03):
    of = defaultdict(list)
    for r in rows:
        of[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in own) for s, own in of.items()}
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    target = mixing.quotas(sizes, {s: 1 + i % 3 for i, s in enumerate(names)}, sum(sizes.values()), 3)
    for s, own in of.items():
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * r["size"] for r in own)
        off = abs(sum(r["taken"] for r in own) - target[s])
        assert off <= max(near * target[s], min((r["size"] for r in own if r["size"]), default=0)), (s, off, target[s])


def test_mix_query(spark, small):
    source = {r["doc_id"]: r["source"] for r in small}
    runs = [sorted(plans.op8_mix(spark, SMALL).collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    check_mix([{**r.asDict(), "source": source[r["doc_id"]]} for r in runs[0]], near=0.1)
    assert all(r["size"] == len(brute.words(t["text"])) for r, t in zip(runs[0], sorted(small, key=lambda r: r["doc_id"])))


def test_mix_of_odd_rows(spark):
    data = [(i, "w " * (i % 50 + 1), ["hot", "é", None, "b"][min(i % 9, 3)]) for i in range(400)] + [(900, None, "empty"), (901, "", "hot"), (901, "", "hot"), (None, " x\n", "b"), (902, "y " * 3000, "b")] + [(903, "same text here", "hot")] * 5
    docs = spark.createDataFrame([(d, t, s, 1, "t") for d, t, s in data], "doc_id long, text string, source string, size int, taken string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(data)
    check_mix([{**r.asDict(), "source": r["row"]["source"]} for r in rows])
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(docs.filter("doc_id in (900, 901)")).collect())


def test_mix_of_overlapping_sources(spark):
    data = [(i, "w " * 10, [["a"], ["a", "b"], ["b"]][i % 3]) for i in range(90)]
    rows = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source array<string>"), weights={"a": 3, "b": 1}).collect()
    assert sum(r["taken"] for r in rows) == pytest.approx(900, abs=20) and max(r["taken"] for r in rows) <= 30


def test_pipeline_against_plain_versions(spark, small, items):
    judged = brute.quality([(r["doc_id"], r["text"], r["lang"]) for r in small], quality.COMMON)
    texts = {r["doc_id"]: r["text"] for r in small if judged[r["doc_id"]][2]}
    deduped = brute.dedup_lines(list(texts.items()))
    texts = {d: (t if n else texts[d]) for d, (_, n, t) in deduped.items() if not n or brute.words(t)}
    heads = slow_heads(texts)
    texts = {d: t for d, t in texts.items() if heads[d] == d}
    hits = brute.decontaminate(list(texts.items()), items)
    texts = {d: t for d, t in texts.items() if not hits[d][1]}

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, SMALL)
        assert docs.columns == before, name
        docs = corpus_pipeline.saved(docs)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts
    rows = [r.asDict() for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert all(r["text"] == texts[r["doc_id"]] and 0 < r["taken"] <= 3 * r["size"] for r in rows)
    total = sum(len(brute.words(t)) for t in texts.values())
    assert sum(r["taken"] for r in rows) == pytest.approx(total, rel=0.05)


def test_pipeline_of_no_documents_and_extra_columns(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.saved(stage(spark, empty, SMALL))
        assert empty.count() == 0
    docs = spark.createDataFrame([(1, None, None, None, None, 5, "t")], "doc_id long, text string, lang string, source string, n_chars long, taken int, tag string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = corpus_pipeline.saved(stage(spark, docs, SMALL))
    assert docs.count() == 1 and "mix_taken" in corpus_pipeline.mixed_sources(spark, docs, SMALL).columns
