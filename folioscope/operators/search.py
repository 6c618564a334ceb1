"""Page, attachment and suggestion search for one reader."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.fragments import query_terms, with_highlight
from folioscope.functions.text import contains_folded, fold, han_bigrams, latin_terms
from folioscope.operators.paging import any_of, offset_page, priority_first, with_total
from folioscope.session import cut_lineage

# Weight of a hit in the title and in the text.
TITLE_WEIGHT, TEXT_WEIGHT = 1.0, 0.4


def _hits(tokens: Column, terms: list[str]) -> Column:
    """How many of the terms are among the tokens; the last term may match as a prefix."""
    found = [F.array_contains(tokens, t) for t in terms[:-1]] + [F.exists(tokens, lambda x: F.startswith(x, F.lit(terms[-1])))]
    return reduce(lambda a, b: a + b, [f.cast("int") for f in found])


def ranked_pages(rows: DataFrame, query: str, titles_only: bool = False) -> DataFrame:
    """The rows that match, with `score`: weighted share of matching terms; a substring hit matches with score 0.

    A query without any term, as one letter, matches as a substring; an empty one matches nothing. Texts are folded once; those that do not hold
    every term as plain characters, which cannot match, are left out before any is cut into terms.
    """
    asked = rows.sparkSession.range(1).select(query_terms(query).alias("t"), fold(F.lit(query)).alias("q")).first()  # of the literal query
    terms, whole = asked["t"], asked["q"]
    text = F.lit("") if titles_only else fold(F.coalesce("text", F.lit("")))
    folded = rows.withColumns({"_title": fold(F.coalesce("title", F.lit(""))), "_text": text})
    both = [F.col("_title"), F.col("_text")]
    holds = lambda part: both[0].contains(F.lit(part)) | both[1].contains(F.lit(part))
    folded = folded.filter(reduce(lambda a, b: a & b, [holds(t) for t in dict.fromkeys(terms)] or [holds(whole)]) & F.lit(bool(query.strip())))
    if not terms:
        return folded.withColumn("score", F.lit(0.0)).drop("_title", "_text")
    tokens = lambda c: F.array_distinct(F.concat(latin_terms(c), han_bigrams(c)))
    cut = folded.withColumns({"_in_title": _hits(tokens(both[0]), terms), "_in_text": _hits(tokens(both[1]), terms)})
    every = F.greatest("_in_title", "_in_text") == len(terms)
    score = F.round((F.col("_in_title") * TITLE_WEIGHT + F.col("_in_text") * TEXT_WEIGHT) / len(terms), 6)
    return cut.filter(every | holds(whole)).withColumn("score", score).drop("_title", "_text", "_in_title", "_in_text")


def search_pages(
    pages: DataFrame, query: str, visible: DataFrame, page: int = 1, limit: int = 50, space_id=None,
    creator_id=None, modified_from=None, modified_to=None, titles_only: bool = False, page_ids: DataFrame | None = None,
) -> DataFrame:
    """pages(page_id, title, text, space_id, deleted_at): ranked hits the reader may see, with highlighted passages and
    the total of hits.

    Filters reach the scan: the space, the creator (creator_id), the time of change (updated_at), or a table of page_id,
    as the pages of a label. `titles_only` searches titles alone. Access is decided before ranks are cut to a page.
    """
    rows = pages.filter(F.col("deleted_at").isNull())
    for name, test in (
        ("space_id", lambda c: c == space_id if space_id is not None else None),
        ("creator_id", lambda c: c == creator_id if creator_id is not None else None),
        ("updated_at", lambda c: c >= F.lit(modified_from) if modified_from is not None else None),
        ("updated_at", lambda c: c < F.lit(modified_to) if modified_to is not None else None),
    ):
        wanted = test(F.col(name))
        rows = rows if wanted is None else rows.filter(wanted)
    if page_ids is not None:
        rows = rows.join(page_ids, "page_id", "left_semi")
    matching = ranked_pages(rows, query, titles_only).select("page_id", "score")
    hits = cut_lineage(matching.join(visible, "page_id", "left_semi"))  # read twice: for the page and for the total
    cut = offset_page(hits, [F.desc("score"), F.asc("page_id")], page, limit)
    shown = with_total(cut, hits).join(pages.select("page_id", "title", "text"), "page_id")
    return with_highlight(shown, "text", query).drop("text")


def search_attachments(attachments: DataFrame, query: str, visible: DataFrame, limit: int = 25, texts: bool = False) -> DataFrame:
    """attachments(attachment_id, page_id, file_name, text, deleted_at) on pages the reader may see.

    The access filter comes before the limit, so no over-fetching is needed.
    """
    fields = ["file_name", "text"] if texts else ["file_name"]
    hit = any_of([contains_folded(F.col(c), query) for c in fields])
    live = attachments.filter(F.col("deleted_at").isNull() & F.col("page_id").isNotNull())
    return live.filter(hit).join(visible, "page_id", "left_semi").orderBy("file_name", "attachment_id").limit(limit)


def suggest(kind: str, rows: DataFrame, query: str, limit: int, current_space=None) -> DataFrame:
    """rows(id, name, space_id): best names, those of the current space first."""
    hits = rows.filter(contains_folded(F.col("name"), query))
    order = [F.col("name"), F.col("id")]
    if current_space is not None:
        order.insert(0, priority_first(F.col("space_id"), current_space))
    return offset_page(hits, order, 1, limit).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "name")
