"""Personal data: fixed patterns seed contexts, contexts are scored, and trusted ones find more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import packed, row_tag, saved, text_of
from folioscope.llm.spans import find_spans, in_order

KINDS = ["email", "ip", "card", "phone"]
# The patterns. Repetitions are possessive and starts are held to where a run begins (or a match has ended)
# where that changes no match, so that long runs stay cheap.
RULES = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9]){13,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
PART = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"
BYTES = f"^(?:{PART})(?:\\.{PART}){{3}}$"
# Candidates: a word with a sign for "at", in plain or in a bracket; else a run of digit groups with one or two separators
# between them, which may begin with + or an open bracket; else a word that begins with a letter and holds a digit.
AT = "(?:@|\\(at\\)|\\[at\\])"
CANDIDATE = (
    f"(?<![^\\x20\\x09-\\x0D])(?:(?!{AT})[^\\x20\\x09-\\x0D])++{AT}[^\\x20\\x09-\\x0D]++"
    "|(?<![0-9A-Za-z])[+(]{0,2}[0-9]++(?:[\\x20().:/-]{1,2}[0-9]++)*+[A-Za-z]*+"
    "|(?<![^\\x20\\x09-\\x0D])[A-Za-z][^\\x20\\x09-\\x0D0-9]*+[0-9][^\\x20\\x09-\\x0D]*+"
)
LEFT_WORD, RIGHT_WORD = "([^\\x20\\x09-\\x0D]++)[\\x20\\x09-\\x0D]*+$", "^[\\x20\\x09-\\x0D]*+([^\\x20\\x09-\\x0D]++)"
# Digits that a candidate without a sign for "at" has at least, and characters on both sides that a neighbouring word is taken from.
FEWEST_DIGITS = 4
AROUND = 200


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, F.lit(2)).otherwise(F.lit(1)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def valid(span: Column) -> Column:
    digits = digits_of(span["hit"])
    count = F.length(digits)
    return (
        F.when(span["kind"] == "ip", span["hit"].rlike(BYTES))
        .when(span["kind"] == "card", F.when(count.between(14, 19), luhn(digits)).otherwise(F.lit(False)))
        .when(span["kind"] == "phone", count.between(10, 15))
        .otherwise(F.lit(True))
    )


def base_spans(text: Column) -> Column:
    return in_order(F.filter(F.concat(*[find_spans(text, kind, rule) for kind, rule in RULES.items()]), valid), KINDS)


def shape_of(c: Column) -> Column:
    """Digits as 9, letters as a, other signs as they are; all signs for "at" as one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), AT, "@"), "[0-9]++", "9"), "[a-z]++", "a")


def candidates(text: Column, base: Column) -> Column:
    """Whole runs that may be identifiers, without signs at either end, with the words before and behind as the text has them,
    the shape, and the kind of a base span they touch. A neighbouring word with digits stands for its shape."""
    words = F.filter(find_spans(text, "word", CANDIDATE, AROUND), lambda s: (F.length(digits_of(s["hit"])) >= FEWEST_DIGITS) | s["hit"].rlike(AT))

    def context(s: Column) -> Column:
        core = F.regexp_extract(s["hit"], "[A-Za-z0-9+(].*[A-Za-z0-9]", 0)
        first = s["start"] + F.length(F.regexp_extract(s["hit"], "^[^A-Za-z0-9+(]*+", 0))
        over = F.filter(base, lambda b: (b["start"] < s["stop"]) & (b["stop"] > s["start"]))
        beside = lambda side, rule: F.regexp_replace(F.lower(F.regexp_extract(s[side], rule, 1)), "[0-9]++", "9")
        return F.struct(
            first.alias("start"), (first + F.length(core)).alias("stop"), core.alias("surface"),
            beside("before", LEFT_WORD).alias("before"), beside("behind", RIGHT_WORD).alias("behind"),
            shape_of(core).alias("shape"), F.get(over, F.lit(0))["kind"].alias("kind"),
        )

    return F.transform(words, context)


def trusted_patterns(graph: DataFrame, rounds: int, trust: float, support: int) -> DataFrame:
    """(pattern, kind, score) of the patterns that hold up.

    graph: (pattern, surface, kind) without repeats, kind null where no seed is known. Seeds are believed fully. A round
    gives each pattern and kind the belief in its instances over their number and one more, and each other instance the
    best score among its patterns of that kind that have `support` seeds.
    """
    seeds = graph.filter("kind is not null").select("surface", "kind").distinct().withColumn("belief", F.lit(1.0))
    degree = graph.groupBy("pattern").agg(F.count_distinct("surface").alias("n"))
    edges = saved(graph.select("pattern", "surface").distinct())
    belief = seeds
    for turn in range(rounds):
        held = edges.join(belief, "surface").groupBy("pattern", "kind").agg(F.sum("belief").alias("held"), F.sum((F.col("belief") == 1.0).cast("long")).alias("seeds"))
        scored = saved(held.join(degree, "pattern").filter(F.col("seeds") >= support).select("pattern", "kind", (F.col("held") / (F.col("n") + 1)).alias("score")))
        if turn + 1 < rounds:
            spread = edges.join(scored.filter(F.col("score") >= trust), "pattern").join(seeds.select("surface"), "surface", "left_anti")
            spread = spread.groupBy("surface", "kind").agg(F.max("score").alias("belief"))
            belief = saved(spread.unionByName(seeds))
    return scored.filter(F.col("score") >= trust)


def find_personal_data(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", rounds: int = 3, trust: float = 0.8, support: int = 3,
) -> DataFrame:
    """Columns doc, base, spans (array<struct<kind, start, stop, hit>>); one row per input row.

    base: matches of the fixed patterns that are valid. spans: base and what contexts add. Runs of digit groups, words with a sign
    for "at" and words with digits are the instances, whole; a pattern is an instance's shape with the word before it, or with the word behind it, or both. Instances in
    base spans are seeds. After `rounds` rounds over the graph of patterns and instances, patterns of `trust` and `support`
    distinct seeds name every further instance they hold; an instance that several kinds claim takes the best score.

    Null is empty text without spans; an empty table gives an empty table; repeated rows count once in the graph, as copies
    do, and get equal spans. A text is scanned as a whole, once; what is found, not the text, is shuffled. A frequent
    pattern is summed map-side and is a key of joins against one row a pattern, which Spark splits.
    """
    base = packed(docs, doc=doc, text=text).withColumn("tag", row_tag("doc", "text")).withColumn("text", text_of())
    base = base.withColumn("base", base_spans(F.col("text")))
    scanned = saved(base.select("doc", "tag", "base", candidates(F.col("text"), F.col("base")).alias("words")))
    found = scanned.select("doc", "tag", F.inline("words")).select(
        "*", F.explode(F.array(F.struct(F.col("before").alias("l"), F.lit("").alias("r")), F.struct(F.lit("").alias("l"), F.col("behind").alias("r")), F.struct(F.col("before").alias("l"), F.col("behind").alias("r")))).alias("side")
    ).filter("side.l <> '' or side.r <> ''")
    found = found.withColumn("pattern", F.concat_ws("\x1f", "side.l", "shape", "side.r")).drop("side")
    trusted = trusted_patterns(found.select("pattern", "surface", "kind").distinct(), rounds, trust, support)
    new = found.filter("kind is null").drop("kind").join(trusted, "pattern")
    new = new.groupBy("doc", "tag", "start", "stop", "surface").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))
    new = new.groupBy("doc", "tag").agg(F.collect_set(F.struct("kind", "start", "stop", F.col("surface").alias("hit"))).alias("added"))
    new = new.select(F.col("doc").alias("of_doc"), F.col("tag").alias("of_tag"), "added")
    joined = scanned.join(new, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("tag") == F.col("of_tag")), "left")
    return joined.select("doc", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(in_order(F.concat("base", "added"), KINDS)).alias("spans"))
