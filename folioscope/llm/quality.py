"""Quality rules: simple counts, then the divergence of a document from its language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import checked_broadcast, packed, saved, text_of, unpacked, words_of

# The most common words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that it was for on are as with his they at be this".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo".split(),
    "fr": "de la le et les des en un une que est dans qui par pour au sur pas ne il".split(),
}
CLASSES = 7
MAX_LANGUAGES = 10_000


def char_classes(text: Column, word_chars: Column) -> list[Column]:
    """Characters that are lower case, upper case, digits, symbols, other ASCII signs, beyond ASCII, and white space."""
    rest = F.regexp_replace(text, "[a-z\\x20\\x09-\\x0D]+", "")
    without = lambda pattern: F.length(F.regexp_replace(F.col("rest"), pattern, ""))
    upper, digit = F.length("rest") - without("[A-Z]+"), F.length("rest") - without("[0-9]+")
    beyond = without("[\\x00-\\x7F]+")
    signs = F.length("rest") - upper - digit - F.col("n_symbols") - beyond
    return [rest, word_chars - F.length("rest"), upper, digit, F.col("n_symbols"), signs, beyond, F.length(text) - word_chars]


def common_hits(words: Column, language: Column) -> Column:
    """The words that are common in the language, in lower case and without the sign behind them."""
    plain = F.transform(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    among = lambda listed: F.filter(plain, lambda w: w.isin(listed))
    return reduce(lambda rest, item: F.when(language == item[0], among(item[1])).otherwise(rest), COMMON.items(), F.array().cast("array<string>"))


def common_words(hits: Column, language: Column) -> Column:
    """How often each common word of the language occurs; an empty list for a language without list."""
    times = lambda x: F.size(F.filter(hits, lambda w: w == x))
    counts = lambda listed: F.array(*[times(x) for x in listed])
    return reduce(lambda rest, item: F.when(language == item[0], counts(item[1])).otherwise(rest), COMMON.items(), F.array().cast("array<int>"))


def repeated_words(marked: Column) -> Column:
    """Words inside windows of three that the text holds twice or more.

    `marked` holds (hash, place) of all windows in order of hash, none where no window repeats; equal neighbours are
    repeats. Their places in order give the words covered: three for each window, fewer where the next one begins before
    its end.
    """
    same = lambda m, k: F.coalesce(F.get(marked, k)["h"] == m["h"], F.lit(False))
    twice = F.filter(marked, lambda m, k: F.when(k > 0, same(m, k - 1)).otherwise(F.lit(False)) | same(m, k + 1))
    places = F.array_sort(F.transform(twice, lambda m: m["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")))["n"]


def measure(docs: DataFrame, text: str, language: str) -> DataFrame:
    """Columns row, language, n_words, the base counts, classes and common (histograms as counts)."""
    base = packed(docs, text=text, language=language).withColumn("text", text_of())
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    base = base.select(
        "*", words_of(F.col("text")).alias("words"), lines.alias("lines"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).alias("n_symbols"),
    )
    rest, *classes = char_classes(F.col("text"), F.col("word_chars"))
    base = base.select("*", F.length(F.array_join("words", "")).alias("word_chars"), rest.alias("rest"))
    window = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    base = base.select("*", window.alias("windows"), common_hits(F.col("words"), F.col("language")).alias("hits"))
    base = base.withColumn("marked", F.array_sort(F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"), F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))),
    ).otherwise(F.array().cast("array<struct<h:long,i:int>>"))))
    return base.select(
        "row", "language", F.size("words").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("marked")).cast("long").alias("n_repeat_words"),
        F.array(*classes).alias("classes"), common_words(F.col("hits"), F.col("language")).alias("common"),
        F.monotonically_increasing_id().alias("place"),
    )


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c / total)


def with_rest(counts: Column, total: Column) -> Column:
    """Counts with what is missing from the total as the last one."""
    return F.concat(counts, F.array(total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares, 0 to 1."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2))


def references(measured: DataFrame, min_words: int) -> DataFrame:
    """Median shares of character classes and common words of each language's documents of `min_words` words.

    Medians, unlike means, do not move with the minority of documents that the reference is to tell apart.
    """
    part = measured.filter(F.col("n_words") >= min_words)
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, c: a + c)
    of = part.select("language", shares(F.col("classes"), total).alias("c"), shares(with_rest(F.col("common"), F.col("n_words")), F.col("n_words")).alias("w"))
    width = max(len(x) for x in COMMON.values()) + 1
    middle = lambda x: F.percentile_approx(x, 0.5, 500)
    found = of.groupBy("language").agg(
        F.count("*").alias("n"), F.max(F.size("w")).alias("width"),
        F.array(*[middle(F.col("c")[k]) for k in range(CLASSES)]).alias("c"), F.array(*[middle(F.get("w", F.lit(k))) for k in range(width)]).alias("w"),
    )
    whole = lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda a, c: a + c))
    return found.select(F.col("language").alias("of_language"), whole(F.col("c")).alias("of_classes"), whole(F.slice("w", 1, F.col("width"))).alias("of_words"), F.col("n").alias("of_docs"))


def assess(
    docs: DataFrame, text: str = "text", language: str = "lang", min_words: int = 50, repeat_percent: int = 50,
    class_distance: float = 0.17, word_distance: float = 0.5, guard_words: int = 45, min_documents: int = 20,
) -> DataFrame:
    """Columns row (the input), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance,
    base_failed, kept; one row per input row.

    base_failed: fewer than `min_words` words, or more than `repeat_percent` in a hundred of them inside windows of three
    words that the text repeats. kept: not base_failed, and both Jensen-Shannon distances to the language's reference are
    within their limits, which are wider by guard_words / n_words, as short texts stray further. References are the median shares over all documents of a language that have `min_words` words; a
    language with fewer than `min_documents` of those is not judged by distance. A language without a list of common
    words is judged by character classes. Null language is a language of its own; null and empty texts have no words and
    fail; repeated rows are judged alike; an empty table gives an empty table.

    Texts are measured where they lie, once for the references and once for the verdict; only one row of sketches for
    each language and task is shuffled. References are broadcast up to MAX_LANGUAGES languages and joined by shuffle above.
    """
    # A filter on the verdict stops above the place; without it the planner copies all that measures a text into the filter.
    measured = measure(docs, text, language).filter("place >= 0")
    known = saved(references(measured, min_words))
    known = checked_broadcast(known, known.count(), MAX_LANGUAGES)
    total = reduce(lambda a, b: a + b, [F.col("classes")[k] for k in range(CLASSES)])
    judged = measured.join(known, F.col("language").eqNullSafe(F.col("of_language")), "left").select(
        "*",
        F.when(F.col("n_words") >= min_words, divergence(shares(F.col("classes"), total), F.col("of_classes"))).alias("class_distance"),
        F.when(F.col("n_words") >= min_words, divergence(shares(with_rest(F.col("common"), F.col("n_words")), F.col("n_words")), F.col("of_words"))).alias("word_distance"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    room = 1 + guard_words / F.greatest(F.col("n_words"), F.lit(1))
    near = (F.col("class_distance") <= class_distance * room) & (F.col("word_distance") <= word_distance * room)
    kept = ~failed & (near | F.coalesce(F.col("of_docs") < min_documents, F.lit(True)))
    return judged.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", failed.alias("base_failed"), kept.alias("kept")
    )


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The documents that the rules keep."""
    return unpacked(assess(docs, **how).filter("kept"), docs)
