import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscope.llm import plans, tokens

SMALL = "/root/testdata/sf0.001"
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
COUNT = tokens.counter("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZé \n\t\r\x0b\x1c\x85\xa0 　́İΣß'sre12<|endoftext|>.,-", max_size=80))
def test_sums_over_pieces_equal_whole_texts(text):
    assert tokens.piece_counts([text], COUNT, {}) == [len(WORDS.encode(text, add_special_tokens=False).ids)]


def test_query_equals_the_library(spark):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in plans.op9_token_counts(spark, SMALL).collect()}
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        n = len(WORDS.encode(r["text"] or "", add_special_tokens=False).ids)
        want[r["doc_id"]] = (len((r["text"] or "").encode()), n, n > 2048)
    assert got == want


def test_only_misses_are_encoded_and_appended(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "a b", 5), (2, "a b", 6), (3, None, 7), (4, "", 8)], "doc_id long, text string, n_tokens int")
    got = tokens.count_tokens(first, cache).collect()
    assert sorted((r["row"]["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == [(1, 3, 2), (2, 3, 2), (3, 0, 0), (4, 0, 0)]
    stored = lambda: spark.read.parquet(cache).count()
    assert stored() == 2
    second = spark.createDataFrame([(1, "a b"), (None, "c " * 3000), (9, "c " * 3000)], "doc_id long, text string")
    got = tokens.count_tokens(second, cache, blanks_split=True).collect()
    assert stored() == 3
    assert sorted((r["n_tokens"], r["over_limit"]) for r in got) == [(2, False), (3000, True), (3000, True)]
    assert tokens.count_tokens(second.limit(0), cache).count() == 0
    assert stored() == 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_libraries(spark, tmp_path, name):
    docs = spark.createDataFrame([(1, "Hello world, <|endoftext|>"), (2, "über")], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, str(tmp_path / "c"), tokenizer=name).collect()}
    assert list(got.values()) and got == dict(zip(got, tokens.counter(name)([{1: "Hello world, <|endoftext|>", 2: "über"}[k] for k in got])))
