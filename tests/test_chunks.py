import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.operators import chunks as C

DOC = """intro line

# One
para one
still one
- item a
- item b
| h | i |
| 1 | 2 |
> quote

## Two
```
# not a heading

code
```
# One
tail"""


def test_blocks(spark):
    got = [(r["kind"], r["level"], DOC[r["start"] : r["stop"]]) for r in
           C.markdown_blocks(spark.createDataFrame([(1, DOC)], "doc_id int, text string")).orderBy("block_no").collect()]
    assert got == [
        ("text", 0, "intro line"), ("heading", 1, "# One"), ("text", 0, "para one\nstill one"), ("list", 0, "- item a\n- item b"),
        ("table", 0, "| h | i |\n| 1 | 2 |"), ("quote", 0, "> quote"), ("heading", 2, "## Two"),
        ("fence", 0, "```\n# not a heading\n\ncode\n```"), ("heading", 1, "# One"), ("text", 0, "tail"),
    ]


def test_sections_have_paths_and_counted_keys(spark):
    docs = spark.createDataFrame([(1, "T", DOC)], "doc_id int, title string, text string")
    got = C.sections(docs).orderBy("section_no").collect()
    assert [r["heading_path"] for r in got] == [[], ["One"], ["One", "Two"], ["One"]]
    key = lambda name: hashlib.sha256(f"parent|{name}".encode()).hexdigest()
    assert [r["section_key"] for r in got] == [key("(intro)|1"), key("One|1"), key("One\u001fTwo|1"), key("One|2")]
    assert all(DOC[r["start"] : r["stop"]] == r["section_text"] for r in got)


def test_chunks_pack_and_keep_atomic_blocks_apart(spark):
    docs = spark.createDataFrame([(1, "T", DOC)], "doc_id int, title string, text string")
    got = C.chunk_sections(docs, 60).orderBy("section_no", "chunk_no").collect()
    one = [r for r in got if r["section_no"] == 1]
    assert [r["text"] for r in one] == ["para one\nstill one", "- item a\n- item b", "| h | i |\n| 1 | 2 |", "> quote"]
    assert one[0]["embedding_text"] == "T > One\n\npara one\nstill one"
    assert one[0]["quote_hash"] == "sha256:" + hashlib.sha256(one[0]["text"].encode()).hexdigest()


def test_long_block_breaks_after_a_sentence_in_the_second_half():
    text = "a" * 30 + ". " + "b" * 40
    spans = list(C._cut(text, 0, len(text), 50))
    assert [text[a:b] for a, b in spans] == ["a" * 30 + ".", "b" * 40]
    assert [b - a for a, b in C._cut("x" * 120, 0, 120, 50)] == [50, 50, 20]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #`|>-.\n1。", max_size=300), st.integers(5, 60))
def test_chunks_cover_the_text_once_and_in_order(text, limit):
    sections = C._outline(text, limit)
    pieces, last = [], 0
    for names, nth, start, stop, body, children in sections:
        assert text[start:stop] == body
        for a, b, _, piece in children:
            assert text[a:b] == piece == piece.strip() and a >= last and 0 < b - a <= limit
            last = b
            pieces.append(piece)
    squeeze = lambda s: "".join(s.split())
    headings = "".join(squeeze(text[s:e]) for k, s, e, *_ in C._blocks(text) if k == "heading")
    assert sorted(squeeze("".join(pieces)) + headings) == sorted(squeeze(text))


def test_stable_keys_survive_an_insertion(spark):
    docs = spark.createDataFrame([(1, "T", "# A\nalpha\n\n# B\nbeta\n"), (2, "T", "# A\nalpha\n\n# New\nx\n\n# B\nbeta\n")], "doc_id int, title string, text string")
    keys = {(r["doc_id"], r["text"]): r["stable_key"] for r in C.chunk_sections(docs).collect()}
    assert keys[(1, "beta")] == keys[(2, "beta")] and keys[(1, "alpha")] == keys[(2, "alpha")]


def test_limit_must_be_positive(spark):
    with pytest.raises(ValueError):
        C.outline(F.lit("x"), 0)


def test_table_rows_fill_spans(spark):
    cell = lambda t, header=False, down=1, right=1: (t, header, down, right)
    grid = [[cell("Name", True), cell("", True), cell("Z", True)], [cell("a;b", down=2), cell("x=1", right=2)], [cell("y"), cell("z")]]
    df = spark.createDataFrame([(1, 0, grid)], f"page_id int, table_no int, cells {C.CELLS}")
    got = [r["row_text"] for r in C.table_rows(df).orderBy("row_no").collect()]
    assert got == ["Name=a\\;b; Column 2=x\\=1; Z=x\\=1", "Name=a\\;b; Column 2=y; Z=z"]


def test_mentions_and_attachments(spark):
    content = '{"content":[{"attrs":{"entityId":"u1","entityType":"user"}},{"x":[{"attrs":{"entityType":"page","entityId":"p2"}},{"attrs":{"entityType":"page","entityId":"p1"}},{"attrs":{"entityType":"page","entityId":"p2"}}]},{"attrs":{"attachmentId":"f9"}}]}'
    df = spark.createDataFrame([(1, content)], "page_id int, content string")
    assert [r["entity_id"] for r in C.extract_mentions(df, "page").orderBy("position").collect()] == ["p2", "p1"]
    assert [r["entity_id"] for r in C.extract_mentions(df, "user").collect()] == ["u1"]
    assert [r["attachment_id"] for r in C.extract_attachments(df).collect()] == ["f9"]
