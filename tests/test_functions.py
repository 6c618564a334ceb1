import hashlib
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.functions import cells, clock, text, vectors


@pytest.mark.parametrize("word", ["Crème Brûlée", "Ångström", "naïve façade", "Ñandú", "tiếng Việt", "é"])
def test_unaccent_matches_canonical_decomposition(one, word):
    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    assert one(text.unaccent, word) == plain


def test_unaccent_spells_ligatures(one):
    assert one(text.unaccent, "Straße Œuvre Łódź") == "Strasse OEuvre Lodz"


@pytest.mark.parametrize("needle,expected", [("100%", True), ("1_0", False), ("BOT_", True), ("ü", True)])
def test_contains_folded_takes_user_text_literally(one, needle, expected):
    assert one(lambda c: text.contains_folded(c, needle), "bot_100% uber") is expected


def test_escape_like():
    assert text.escape_like(r"50%_\x") == r"50\%\_\\x"


def test_terms(one):
    got = one(lambda c: text.informative_terms(text.normalize_search(c)), "How to ＡＰＩ/v1 the 知识库什么 api/v1 x")
    assert got == ["to", "api/v1", "知识", "识库", "库什"]


def test_query_terms_drop_question_words(one):
    got = one(lambda c: text.query_terms(F.lower(c)), "什么 配置 -- abc")
    assert "什么" not in got and "--" not in got and set(got) == {"abc", "配置"}


def test_normalize_answer(one):
    assert one(text.normalize_answer, " The  cat, a the hat! An end.") == "cat hat end"
    assert one(text.normalize_answer, "Übertheke") == "übertheke"


def test_strip_notice(one):
    notice = text.ANSWER_NOTICES[1]
    assert one(text.strip_notice, f"  {notice}\n\nParis") == "Paris"
    assert one(text.strip_notice, " Paris") == " Paris"


def test_attribution_tokens(one):
    got = one(lambda c: text.attribution_tokens(text.nfkc(c)), "Gen. Smith’s well-known boys’ St. Louis")
    assert got == ["general", "smith", "well", "known", "boys", "saint", "louis"]


def test_contains_tokens(one):
    assert one(text.contains_tokens, ["new", "york", "city"], ["york", "city"])
    assert not one(text.contains_tokens, ["new", "york", "city"], ["new", "city"])
    assert not one(lambda a: text.contains_tokens(a, F.array().cast("array<string>")), ["a"])


def test_trigram_similarity(one):
    assert one(text.trigram_similarity, "word", "two words") == pytest.approx(4 / 11)
    assert one(text.trigram_similarity, "same", "same") == 1.0


def test_stable_uuid(one):
    h = hashlib.sha256(b"page:1").hexdigest()
    variant = format((int(h[16:18], 16) & 0x3F) | 0x80, "02x")
    assert one(text.stable_uuid, "page:1") == f"{h[:8]}-{h[8:12]}-4{h[13:16]}-{variant}{h[18:20]}-{h[20:32]}"


def test_quote_hash_unifies_line_ends(one):
    assert one(text.quote_hash, "a\r\nb\rc") == "sha256:" + hashlib.sha256(b"a\nb\nc").hexdigest()


def test_section_title_and_excerpt(one):
    assert one(lambda t: text.section_title(F.lit(""), t, F.lit("Page")), "## One *two*. Three") == "One two"
    assert one(lambda t: text.section_title(F.lit(""), t, F.lit("Page")), "") == "Page · 内容"
    assert one(lambda t: text.section_title(F.lit("Head"), t, F.lit("Page")), "x") == "Head"
    assert one(text.excerpt, "x" * 181) == "x" * 177 + "…"


def test_cosine(one):
    assert one(vectors.cosine_similarity, [1.0, 0.0], [1.0, 0.0]) == pytest.approx(1.0)
    assert one(vectors.cosine_similarity, [0.0, 0.0], [1.0, 0.0]) == 0.0
    assert one(vectors.cosine_similarity, [1.0], [1.0, 0.0]) is None
    assert one(vectors.clamped_similarity, [1.0, 0.0], [-1.0, 0.0]) == 0.0
    assert one(vectors.clamped_similarity, [1.0], [-1.0, 0.0]) is None


@pytest.mark.parametrize(("block", "span"), [(2048, 65536), (4, 65536), (4, 7)])
def test_dense_topk_equals_brute_force_in_one_and_many_blocks(spark, block, span):
    import numpy as np

    rng = np.random.default_rng(5)
    chunks, queries = rng.normal(size=(60, 8)).round(3), rng.normal(size=(11, 8)).round(3)
    chunks[7] = chunks[3]  # a tie at the edge
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(chunks)], "chunk_id long, chunk_vec array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, query_vec array<double>")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in vectors.dense_topk(q, c, 5, block, span).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    distance = 1 - unit(queries) @ unit(chunks).T
    for i in range(11):
        order = sorted(range(60), key=lambda j: (round(distance[i, j], 12), j))[:5]
        assert [got[(i, n + 1)] for n in range(5)] == order
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0] * 8), (4, [])], "query_id long, query_vec array<double>")
    hits = vectors.dense_topk(odd, c.union(spark.createDataFrame([(99, None)], c.schema)), 5, block, span).collect()
    assert {r["query_id"] for r in hits} == {3} and [r["distance"] for r in hits] == [1.0] * 5
    assert vectors.dense_topk(q.limit(0), c, 5).count() == vectors.dense_topk(q, c.limit(0), 5).count() == 0


@pytest.mark.parametrize(
    "raw,expected", [("1,234.5", 1234.5), ("¥ 12", 12.0), ("45%", 45.0), ("-3", -3.0), ("1e3", 1000.0), ("abc", None), ("1.2.3", None), ("", None)]
)
def test_parse_number(one, raw, expected):
    assert one(cells.parse_number, raw) == expected


def test_format_number(one):
    assert one(lambda v: cells.format_number(v, "number"), 1234.5) == "1234.5"
    assert one(lambda v: cells.format_number(v, "percent"), 12.0) == "12%"
    assert one(lambda v: cells.format_number(v, "USD"), -1234.5) == "-$1,234.50"
    assert one(lambda v: cells.format_number(v, "JPY"), 1234.0) == "¥1,234"
    assert one(lambda v: cells.format_number(v, "number"), 10.0) == "10"


@pytest.mark.parametrize(
    "raw,href",
    [
        ("https://a.b/c", "https://a.b/c"), ("mailto:x@y.z", "mailto:x@y.z"), ("a.example.org/x", "https://a.example.org/x"),
        ("javascript:alert(1)", None), ("plain", None), (" ", None),
    ],
)
def test_url_href(one, raw, href):
    assert one(cells.url_href, raw) == href


def test_normalize_cell(one):
    assert one(lambda c: cells.normalize_cell("progress", c), "150") == 100
    assert one(lambda c: cells.normalize_cell("progress", c), "x") is None
    assert one(lambda c: cells.normalize_cell("date", c), "2024-02-30") is None
    assert one(lambda c: cells.normalize_cell("number", c), "") is None
    assert one(lambda c: cells.normalize_cell("multiSelect", c), ["a", "b", "a"]) == ["a", "b"]
    assert one(lambda c: cells.normalize_cell("checkbox", c), "yes?") is False


def test_natural_key_orders_digits_as_numbers(spark):
    names = ["item 10", "Item 9", "item 1a", "ítem 2"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(cells.natural_key(F.col("n")))
    assert [r["n"] for r in df.collect()] == ["item 1a", "ítem 2", "Item 9", "item 10"]


def test_resolve_range():
    now = datetime(2024, 3, 10, 20)  # already the 11th in the local zone
    assert clock.resolve_range("today", now) == (datetime(2024, 3, 10, 16), datetime(2024, 3, 11, 16))
    assert clock.resolve_range("yesterday", now) == (datetime(2024, 3, 9, 16), datetime(2024, 3, 10, 16))
    assert clock.resolve_range("7d", now)[0] == datetime(2024, 3, 4, 16)
    assert clock.resolve_range("custom", now, ("2024-01-01", "2024-01-02")) == (datetime(2023, 12, 31, 16), datetime(2024, 1, 2, 16))
    for bad in (("2024-01-02", "2024-01-01"), ("2023-01-01", "2024-03-01"), ("x", "2024-01-01")):
        with pytest.raises(ValueError):
            clock.resolve_range("custom", now, bad)


def test_week_period():
    now = datetime(2024, 3, 10, 20)  # Monday the 11th in the local zone
    assert clock.week_period("this_week", now) == (datetime(2024, 3, 10, 16), datetime(2024, 3, 17, 16))
    assert clock.week_period("last_week", now) == (datetime(2024, 3, 3, 16), datetime(2024, 3, 10, 16))


@pytest.mark.parametrize(
    "enabled,start,stop,utc,is_open,opens",
    [
        (True, "22:00", "06:00", "2024-01-01 15:00:00", True, None),  # 23:00 local, wraps midnight
        (True, "22:00", "06:00", "2024-01-01 00:00:00", False, "2024-01-01 14:00"),
        (True, "01:00", "05:00", "2024-01-01 00:00:30", False, "2024-01-01 17:01"),
        (True, "25:00", "05:00", "2024-01-01 00:00:00", True, None),  # malformed means disabled
        (True, "05:00", "05:00", "2024-01-01 00:00:00", True, None),
        (False, "01:00", "05:00", "2024-01-01 00:00:00", True, None),
    ],
)
def test_daily_window(one, enabled, start, stop, utc, is_open, opens):
    at = lambda e, a, b, t: (e, a, b, t.cast("timestamp_ntz"))
    assert one(lambda *c: clock.window_open(*at(*c)), enabled, start, stop, utc) is is_open
    got = one(lambda *c: F.date_format(clock.next_open(*at(*c)), "yyyy-MM-dd HH:mm"), enabled, start, stop, utc)
    assert got == opens


def test_dense_products_do_not_grow_with_the_block():
    import tracemalloc

    import numpy as np

    draw = np.random.default_rng(3)
    queries, chunks = draw.normal(size=(512, 4)), draw.normal(size=(1 << 16, 4))
    tracemalloc.start()
    found = list(vectors._nearest(queries, chunks, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 200 << 20


def test_dense_topk_of_many_copies_takes_the_smallest_ids(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vec array<double>")
    c = spark.createDataFrame([(i, [2.0, 0.0] if i != 7 else [1.0, 1.0]) for i in range(50, 0, -1)], "chunk_id int, chunk_vec array<double>")
    assert [r["chunk_id"] for r in vectors.dense_topk(q, c, 3).orderBy("rank").collect()] == [1, 2, 3]
