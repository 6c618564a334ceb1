"""Passages of a text that show a query best, with every hit marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import fold, han_bigrams, latin_terms

BETWEEN = " ... "


def query_terms(query: str) -> Column:
    """Terms of a query, made as those of texts are: folded latin terms and Han pairs."""
    folded = fold(F.lit(query))
    return F.concat(latin_terms(folded), han_bigrams(folded))


def _term_of(own: Column, folded: Column, terms: list[str]) -> Column:
    """Number from 1 of the first term that a word holds, 0 if none; the last term may be a beginning, a Han pair may lie anywhere."""
    found = F.lit(0)
    for number, term in reversed(list(enumerate(terms, 1))):
        fits = F.array_contains(own, term) if term.isascii() else F.contains(folded, F.lit(term))
        if number == len(terms) and term.isascii():
            fits = F.exists(own, lambda x: F.startswith(x, F.lit(term)))  # noqa: B023
        found = F.when(fits, number).otherwise(found)
    return found


def _next_fragment(rows: DataFrame, size: int) -> DataFrame:
    """One fragment more in `_chosen`, if hits are left outside.

    Among the hits in no fragment, each opens a window of `size` words up to the next fragment. The window with the most different terms is
    taken, of these the shortest from its first hit to the last that it needs, then the first. The fragment has the window in its
    middle, but for the end of the text or of the gap. Steps are columns of their own, so that none is worked out once for each hit.
    """
    gap = lambda place: F.size(F.filter("_chosen", lambda c: c["first"] <= place))
    free = F.filter("_hits", lambda h: ~F.exists("_chosen", lambda c: h["place"].between(c["first"], c["last"])))
    rows = rows.withColumn("_open", F.transform(free, lambda h: F.struct(h["place"].alias("place"), h["term"].alias("term"), gap(h["place"]).alias("gap"))))

    def window(h: Column, i: Column) -> Column:
        near = F.filter(F.slice("_open", i + 1, size), lambda o: (o["gap"] == h["gap"]) & (o["place"] < h["place"] + size))
        firsts = F.aggregate(  # first places of the terms, in order; a window is short
            near, F.array().cast("array<struct<term:int,place:int>>"),
            lambda seen, o: F.when(F.exists(seen, lambda s: s["term"] == o["term"]), seen).otherwise(F.concat(seen, F.array(F.struct(o["term"].alias("term"), o["place"].alias("place"))))),
            lambda seen: F.struct((-F.size(seen)).alias("a"), (F.element_at(seen, -1)["place"] - h["place"]).alias("b"), h["place"].alias("place")),
        )
        return firsts

    rows = rows.withColumn("_best", F.array_min(F.transform("_open", window)))
    place = F.col("_best.place")
    left = F.coalesce(F.array_max(F.transform(F.filter("_chosen", lambda c: c["last"] < place), lambda c: c["last"])), F.lit(-1))
    right = F.coalesce(F.array_min(F.transform(F.filter("_chosen", lambda c: c["first"] > place), lambda c: c["first"])), F.size("_words"))
    rows = rows.withColumns({"_left": left, "_right": right})
    middle = place - F.floor((F.lit(size - 1) - F.col("_best.b")) / 2).cast("int")
    rows = rows.withColumn("_first", F.greatest(F.least(middle, F.col("_right") - size), F.col("_left") + 1))
    more = F.array(F.struct(F.col("_first").alias("first"), F.least(F.col("_first") + F.lit(size - 1), F.col("_right") - 1).alias("last")))
    return rows.withColumn("_chosen", F.when(F.col("_best").isNull(), F.col("_chosen")).otherwise(F.concat("_chosen", more)))


def with_highlight(rows: DataFrame, text: str, query: str, name: str = "highlight", fragments: int = 3, size: int = 10) -> DataFrame:
    """`rows` with up to `fragments` passages of `size` words each of `text` that show the query, in the order of the text, hits in <b>.

    Fragments do not overlap. A text without a hit shows its first words, a null text is empty. Case and accents do not matter.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    asked = rows.sparkSession.range(1).select(query_terms(query).alias("t")).first()["t"]
    marks = F.transform("_own", lambda own, i: _term_of(own, F.get("_folded", i), asked))
    hits = F.filter(F.transform("_marks", lambda t, i: F.struct(i.alias("place"), t.alias("term"))), lambda h: h["term"] > 0)
    out = rows.withColumn("_words", words).withColumn("_folded", F.transform("_words", fold)).withColumn("_own", F.transform("_folded", latin_terms))
    out = out.withColumn("_marks", marks).withColumn("_hits", hits)
    out = out.withColumn("_chosen", F.array().cast("array<struct<first:int,last:int>>"))
    for _ in range(fragments):
        out = _next_fragment(out, size)
    marked = F.transform("_words", lambda w, i: F.when(F.get("_marks", i) > 0, F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    shown = F.transform(F.array_sort("_chosen"), lambda c: F.array_join(F.slice("_marked", c["first"] + 1, c["last"] - c["first"] + 1), " "))
    out = out.withColumn("_marked", marked)
    text_of = F.when(F.size("_chosen") > 0, F.array_join(shown, BETWEEN)).otherwise(F.array_join(F.slice("_words", 1, size), " "))
    return out.withColumn(name, text_of).select(*[c for c in rows.columns if c != name], name)
