"""Structural chunking: blocks, sections and bounded chunks with stable identities.

A scan of one text is sequential, so a small Arrow UDF finds the spans. It runs next to the document
row without any shuffle; hashes, breadcrumbs and ids are Spark expressions on its output.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from folioscope.functions.text import quote_hash, sha256_hex, squash, stable_uuid, tagged_hash

MAX_CHILD = 900
# How much one page or one shared artifact may produce.
MAX_PAGE_CHUNKS = 200
MAX_PAGE_TABLE_ROWS = 2000
MAX_SHARED_CHUNKS = 500

# Lines that open or continue a block; blanks here never include the line end.
_FENCE, _TABLE, _QUOTE, _ITEM = r"[^\S\n]*```", r"[^\S\n]*\|", r"[^\S\n]*>", r"[^\S\n]*(?:[-*+][ ]|\d+[.)][ ])"
_REST = r"[^\n]*"
_BLOCK = re.compile(
    rf"""^(?:
    (?P<heading>(?P<marks>\#{{1,3}})[^\S\n]+(?P<title>[^\n]+?)[^\S\n]*$)
  | (?P<fence>{_FENCE}{_REST}(?:\n(?!{_FENCE}){_REST})*(?:\n{_FENCE}{_REST})?)
  | (?P<table>{_TABLE}{_REST}(?:\n{_TABLE}{_REST})*)
  | (?P<quote>{_QUOTE}{_REST}(?:\n{_QUOTE}{_REST})*)
  | (?P<list>{_ITEM}{_REST}(?:\n{_ITEM}{_REST})*)
  | (?P<text>[^\S\n]*\S{_REST}(?:\n(?=[^\n]*\S)(?!\#{{1,3}}\s|{_FENCE}|{_TABLE}|{_QUOTE}|{_ITEM}){_REST})*)
    )""",
    re.MULTILINE | re.VERBOSE,
)
_ATOMIC = {"fence", "table", "quote", "list"}

_BLOCKS = ArrayType(
    StructType(
        [
            StructField("kind", StringType()),
            StructField("start", IntegerType()),
            StructField("stop", IntegerType()),
            StructField("level", IntegerType()),
        ]
    )
)
_CHILD = StructType(
    [
        StructField("start", IntegerType()),
        StructField("stop", IntegerType()),
        StructField("nth", IntegerType()),
        StructField("text", StringType()),
    ]
)
_SECTIONS = ArrayType(
    StructType(
        [
            StructField("path", ArrayType(StringType())),
            StructField("nth", IntegerType()),
            StructField("start", IntegerType()),
            StructField("stop", IntegerType()),
            StructField("text", StringType()),
            StructField("children", ArrayType(_CHILD)),
        ]
    )
)


def _blocks(text: str) -> Iterator[tuple[str, int, int, int, str]]:
    for found in _BLOCK.finditer(text):
        kind = found.lastgroup if found.lastgroup not in ("title", "marks") else "heading"
        if found["heading"] is not None:
            yield "heading", found.start(), found.end(), len(found["marks"]), found["title"]
        else:
            yield kind, found.start(), found.end(), 0, ""


def _trim(text: str, start: int, stop: int) -> tuple[int, int]:
    piece = text[start:stop]
    lead = len(piece) - len(piece.lstrip())
    return start + lead, start + lead + len(piece.strip())


def _cut(text: str, start: int, stop: int, limit: int) -> Iterator[tuple[int, int]]:
    """Pieces of at most `limit`, broken after a line or sentence in the second half of a piece."""
    while stop - start > limit:
        window = text[start : start + limit]
        at = max(window.rfind("\n"), *(window.rfind(mark) + 1 for mark in ("。", ". ", "；")))
        step = at if at >= limit // 2 and at > 0 else limit
        yield _trim(text, start, start + step)
        start += step
    yield _trim(text, start, stop)


def _pack(text: str, spans: list[tuple[int, int, bool]], limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring blocks share a chunk while they fit; atomic blocks open a new one."""
    held: tuple[int, int] | None = None
    for start, stop, atomic in spans:
        if held and stop - start <= limit and not atomic and stop - held[0] <= limit:
            held = (held[0], stop)
            continue
        if held:
            yield held
        held = (start, stop) if stop - start <= limit else None
        if held is None:
            yield from _cut(text, start, stop, limit)
    if held:
        yield held


def _outline(text: str, limit: int) -> list[tuple]:
    parts: list[tuple[list[str], int, list[tuple[int, int, bool]]]] = []
    path: dict[int, str] = {}
    for kind, start, stop, level, title in _blocks(text):
        if kind == "heading":
            path = {depth: name for depth, name in path.items() if depth < level} | {level: title}
            parts.append(([path[d] for d in sorted(path)], start, []))
            continue
        if not parts:
            parts.append(([], start, []))
        parts[-1][2].append((*_trim(text, start, stop), kind in _ATOMIC))
    seen_paths: Counter = Counter()
    out = []
    for number, (names, start, spans) in enumerate(parts):
        stop = parts[number + 1][1] if number + 1 < len(parts) else len(text)
        first, last = _trim(text, start, stop)
        seen_paths[tuple(names)] += 1
        seen: Counter = Counter()
        children = []
        for a, b in _pack(text, spans, limit):
            if a < b:
                key = " ".join(text[a:b].split())
                seen[key] += 1
                children.append((a, b, seen[key], text[a:b]))
        out.append((names, seen_paths[tuple(names)], first, last, text[first:last], children))
    return out


def block_spans(text: Column) -> Column:
    """Blocks of a Markdown text: kind, code-point offsets and heading level."""

    @F.pandas_udf(_BLOCKS)
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [b[:4] for b in _blocks(t)] if t else [])

    return scan(text)


def outline(text: Column, limit: int = MAX_CHILD) -> Column:
    if limit <= 0:
        raise ValueError("limit must be positive")

    @F.pandas_udf(_SECTIONS)
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _outline(t, limit) if t else [])

    return scan(text)


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) → one row per block."""
    return docs.select("doc_id", F.posexplode(block_spans(F.col("text"))).alias("block_no", "b")).select(
        "doc_id", "block_no", "b.kind", F.col("b.start").alias("start"), F.col("b.stop").alias("stop"), "b.level"
    )


def sections(docs: DataFrame, limit: int = MAX_CHILD) -> DataFrame:
    """docs(doc_id, title, text) → one row per section, with its chunks nested in it."""
    found = docs.select("doc_id", "title", F.posexplode(outline(F.col("text"), limit)).alias("section_no", "s"))
    identity = F.when(F.size("s.path") > 0, F.array_join("s.path", "\u001f")).otherwise("(intro)")
    return found.select(
        "doc_id", "title", "section_no",
        F.col("s.path").alias("heading_path"),
        sha256_hex(F.concat_ws("|", F.lit("parent"), identity, F.col("s.nth"))).alias("section_key"),
        F.col("s.start").alias("start"), F.col("s.stop").alias("stop"),
        F.col("s.text").alias("section_text"),
        quote_hash(F.col("s.text")).alias("section_quote_hash"),
        F.col("s.children").alias("children"),
    )


def chunk_sections(docs: DataFrame, limit: int = MAX_CHILD) -> DataFrame:
    """docs(doc_id, title, text) → one row per chunk, with offsets that reproduce its text."""
    rows = sections(docs, limit).select(
        "doc_id", "title", "section_no", "section_key", "heading_path", F.posexplode("children").alias("chunk_no", "c")
    )
    trail = F.array_join(F.filter(F.concat(F.array("title"), "heading_path"), lambda t: t != ""), " > ")
    text = F.col("c.text")
    return rows.select(
        "doc_id", "section_no", "chunk_no", "section_key", "heading_path",
        sha256_hex(F.concat_ws("|", F.lit("child"), "section_key", squash(text), F.col("c.nth"))).alias("stable_key"),
        F.col("c.start").alias("start"), F.col("c.stop").alias("stop"),
        text.alias("text"),
        F.when(trail != "", F.concat(trail, F.lit("\n\n"), text)).otherwise(text).alias("embedding_text"),
        quote_hash(text).alias("quote_hash"),
    )


def chunk_identity(chunks: DataFrame) -> DataFrame:
    """Adds chunk_id, which pins the stable key and the exact embedding input.

    Chunks without a stable key get one from lineage and text, repeats told apart by occurrence.
    chunks(artifact_id, stable_key, lineage, text, embedding_text, position)
    """
    from pyspark.sql.window import Window

    legacy = sha256_hex(F.concat_ws("|", "lineage", "text"))
    same = Window.partitionBy("artifact_id", F.xxhash64("lineage", "text")).orderBy("position")
    keyed = chunks.filter(F.col("stable_key").isNotNull())
    bare = chunks.filter(F.col("stable_key").isNull()).withColumn("_n", F.row_number().over(same)).withColumn(
        "stable_key", F.concat(F.lit("legacy:"), F.substring(legacy, 1, 40), F.lit(":"), F.col("_n"))
    )
    rows = keyed.unionByName(bare.drop("_n"))
    name = F.concat_ws(
        ":", F.col("artifact_id").cast("string"), F.lit("chunk"), "stable_key",
        tagged_hash(F.coalesce("embedding_text", "text")),
    )
    return rows.withColumn("chunk_id", stable_uuid(name))


def budget_check(chunks: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Keys that produce more rows than allowed."""
    return chunks.groupBy(key).agg(F.count("*").alias("produced")).filter(F.col("produced") > limit)


# --- tables, links -------------------------------------------------------------------------------------

CELLS = "array<array<struct<text:string,header:boolean,rowspan:int,colspan:int>>>"


def _grid(rows: list) -> list[list]:
    """Cells laid out on a grid; a cell that spans rows or columns is repeated where it reaches."""
    placed: dict[tuple[int, int], dict] = {}
    span = lambda cell, name: max(cell[name] or 1, 1)
    for r, row in enumerate(rows):
        column = 0
        for cell in row:
            while (r, column) in placed:
                column += 1
            for down in range(span(cell, "rowspan")):
                for right in range(span(cell, "colspan")):
                    placed.setdefault((r + down, column + right), cell)
            column += span(cell, "colspan")
    width = max((c for _, c in placed), default=-1) + 1
    return [[placed.get((r, c)) for c in range(width)] for r in range(len(rows))]


def _clean(cell: dict | None) -> str:
    return " ".join((cell["text"] or "").split()) if cell else ""


def _escape(value: str) -> str:
    return value.replace("\\", "\\\\").replace(";", "\\;").replace("=", "\\=")


def _row_texts(rows: list) -> list[str]:
    rows = [list(r["cells"]) for r in rows]
    grid = _grid(rows)
    headed = bool(rows) and any(cell["header"] for cell in rows[0])
    names = [_clean(c) or f"Column {i}" for i, c in enumerate(grid[0], 1)] if headed else []
    lines = []
    for row in grid[1:] if headed else grid:
        labels = names or [f"Column {i}" for i in range(1, len(row) + 1)]
        lines.append("; ".join(f"{_escape(n)}={_escape(_clean(c))}" for n, c in zip(labels, row)))
    return lines


def table_rows(tables: DataFrame) -> DataFrame:
    """tables(page_id, table_no, cells) → `label=value; ..` per data row, spans filled in."""

    @F.pandas_udf(ArrayType(StringType()))
    def texts(cells: pd.Series) -> pd.Series:
        return cells.map(lambda rows: _row_texts(rows) if rows is not None else [])

    # arrays of arrays do not survive the Arrow conversion, so each row travels as a struct
    wrapped = F.transform(F.col("cells").cast(CELLS), lambda row: F.struct(row.alias("cells")))
    return tables.select("page_id", "table_no", F.posexplode(texts(wrapped)).alias("row_no", "row_text"))


def _first_seen(rows: DataFrame, owner: str, items: Column, name: str) -> DataFrame:
    """Distinct items per owner row in the order first met; each owner is one row, so no shuffle."""
    return rows.select(owner, F.posexplode(F.array_distinct(items)).alias("position", name))


def extract_links(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) → link targets in document order."""
    return _first_seen(pages, "page_id", F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1)), "href")


def internal_links(pages: DataFrame) -> DataFrame:
    """Links to pages of the same site, as slugs without query or anchor."""
    return (
        extract_links(pages)
        .filter(F.col("href").startswith("/"))
        .select("page_id", F.regexp_extract("href", r"^/([^?#]*)", 1).alias("slug"))
        .distinct()
    )


def extract_mentions(pages: DataFrame, kind: str) -> DataFrame:
    """pages(page_id, content) → ids of mentioned users or pages, from the JSON of the content.

    Mention attributes are flat objects, so they are cut out of the text and read as JSON; nesting of
    the document around them does not matter.
    """
    objects = F.regexp_extract_all("content", F.lit(r'(\{[^{}]*"entityType"[^{}]*\})'), F.lit(1))
    wanted = F.filter(objects, lambda o: F.get_json_object(o, "$.entityType") == kind)
    return _first_seen(pages, "page_id", F.transform(wanted, lambda o: F.get_json_object(o, "$.entityId")), "entity_id")


def extract_attachments(pages: DataFrame) -> DataFrame:
    objects = F.regexp_extract_all("content", F.lit(r'"attachmentId"\s*:\s*"([^"]+)"'), F.lit(1))
    return _first_seen(pages, "page_id", objects, "attachment_id")


def page_titles(pages: DataFrame) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return pages.select("page_id", squash(title).alias("title"))
