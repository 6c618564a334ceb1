"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# English and Chinese words that carry no search meaning.
TERM_STOP_WORDS = ["and", "are", "for", "how", "the", "what", "when", "where", "which", "who", "why"]
TERM_STOP_BIGRAMS = ["什么", "如何", "多少", "时候", "的是", "一下"]
EVIDENCE_STOP_WORDS = TERM_STOP_WORDS + ["is"]
EVIDENCE_STOP_BIGRAMS = ["上的", "的是", "什么", "如何", "多少", "时候", "一下", "今天", "是多"]
QUESTION_STOP_TERMS = [
    "请问", "麻烦", "帮", "帮忙", "帮我", "我查", "一下", "告诉", "想", "想要",
    "了解", "介绍", "能不能", "不能", "可以", "能否", "是否", "应该", "需要",
    "怎么回事", "怎样才能", "干什么", "什么", "什么样", "哪些", "哪里", "哪个",
    "如何", "怎么", "怎么办", "怎样", "为什么", "为何", "是不是", "有没有",
    "具体", "意思", "指", "情况", "相关", "关于", "内容", "说明", "一些", "有关",
]
CONTENT_STOP_WORDS = (
    "a an the of and or but in on at to for with by from as is are was were be been "
    "being have has had do does did will would could should may might must can this that "
    "these those it its his her their our your my he she they we you i not no nor so than "
    "then there here when where which who whom whose what how why all any both each few "
    "more most other some such only own same too very s t just don now"
).split()
# Notices that may open an answer given without workspace evidence.
ANSWER_NOTICES = [
    "> 以下回答基于通用模型知识，未引用企业知识库。",
    "> This answer uses general model knowledge and does not cite the workspace knowledge base.",
]
# Titles written short.
TITLE_ABBREVIATIONS = {
    "gen": "general", "lt": "lieutenant", "col": "colonel", "sgt": "sergeant",
    "capt": "captain", "pres": "president", "gov": "governor", "sen": "senator",
    "rep": "representative", "mt": "mount", "st": "saint",
}
ASCII_PUNCTUATION = "[!-/:-@\\[-`{-~]"


def _diacritic_map() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter plus marks, then the bare marks."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = [c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != letter:
            source.append(letter)
            target.append(base[0])
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


_ACCENTED, _PLAIN = _diacritic_map()


def unaccent(c: Column) -> Column:
    """Letters without diacritics; ligatures spelled out."""
    out = F.translate(c, _ACCENTED, _PLAIN)
    for letter, plain in [("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")]:
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.translate(out, "øØłŁđĐı", "oOlLdDi")


def fold(c: Column) -> Column:
    return F.lower(unaccent(c))


def contains_folded(c: Column, needle: str) -> Column:
    """Accent- and case-insensitive substring test; user text is literal, never a pattern."""
    return F.coalesce(F.contains(fold(c), fold(F.lit(needle))), F.lit(False))


def escape_like(needle: str) -> str:
    return "".join("\\" + c if c in "\\%_" else c for c in needle)


def squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_title(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Spark has no Unicode normalisation; pandas does it per Arrow batch."""
    return values.str.normalize("NFKC")


def normalize_search(c: Column) -> Column:
    return F.lower(nfkc(c))


def latin_terms(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([a-z0-9_./:\-]{2,})"), F.lit(1))


def han_bigrams(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit(r"([\p{IsHan}]{2,})"), F.lit(1))
    return F.flatten(
        F.transform(
            runs,
            lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2))),
        )
    )


def _literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _terms(normalized: Column, words: list[str], bigrams: list[str]) -> Column:
    return F.array_distinct(
        F.concat(
            F.filter(latin_terms(normalized), lambda t: ~t.isin(words)),
            F.filter(han_bigrams(normalized), lambda t: ~t.isin(bigrams)),
        )
    )


def informative_terms(normalized: Column) -> Column:
    """Distinct terms of a text that already went through `normalize_search`."""
    return _terms(normalized, TERM_STOP_WORDS, TERM_STOP_BIGRAMS)


def evidence_terms(normalized: Column) -> Column:
    return _terms(normalized, EVIDENCE_STOP_WORDS, EVIDENCE_STOP_BIGRAMS)


def query_terms(normalized: Column) -> Column:
    """Distinct query lexemes: no punctuation-only term, no question word."""
    terms = F.array_distinct(F.concat(latin_terms(normalized), han_bigrams(normalized)))
    return F.filter(terms, lambda t: t.rlike(r"[a-z0-9\p{IsHan}]") & ~t.isin(QUESTION_STOP_TERMS))


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no article, single spaces."""
    bare = F.regexp_replace(F.lower(c), ASCII_PUNCTUATION, "")
    return squash(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def answer_tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_answer(c), " "), lambda t: t != "")


def strip_notice(c: Column) -> Column:
    body = F.regexp_replace(c, r"^\s+", "")
    out = c
    for notice in ANSWER_NOTICES:
        rest = F.regexp_replace(F.substring(body, len(notice) + 1, 2**31 - 1), r"^\s+", "")
        out = F.when(F.startswith(body, F.lit(notice)), rest).otherwise(out)
    return out


def attribution_tokens(nfkc_text: Column) -> Column:
    """Tokens for evidence matching; the caller passes NFKC text."""
    c = F.translate(nfkc_text, "‘’‚‛′“”„‟″", "'''''\"\"\"\"\"")
    c = F.regexp_replace(c, r"(?iU)'s\b", "")
    c = F.regexp_replace(c, r"(?iU)(?<=s)'(?=\W|$)", "")
    c = F.regexp_replace(c, r"[-–—_*`]+", " ")
    full = F.create_map(*[F.lit(v) for pair in TITLE_ABBREVIATIONS.items() for v in pair])
    return F.transform(answer_tokens(c), lambda t: F.coalesce(full[t], t))


def contains_tokens(haystack: Column, needle: Column) -> Column:
    """True when `needle` occurs in `haystack` as one contiguous run of tokens."""
    glue = lambda tokens: F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return (F.size(needle) > 0) & F.contains(glue(haystack), glue(needle))


def token_recall(reference: Column, context: Column) -> Column:
    wanted = F.array_distinct(reference)
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(wanted, context)) / F.size(wanted)
    )


def content_words(c: Column) -> Column:
    words = F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z0-9'\-]*)"), F.lit(1))
    return F.filter(F.transform(words, F.lower), lambda w: ~w.isin(CONTENT_STOP_WORDS))


def trigrams(c: Column) -> Column:
    """Distinct three-letter pieces of each word padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{IsDigit}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    pieces = F.transform(
        padded,
        lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(pieces))


def trigram_similarity(a: Column, b: Column) -> Column:
    left, right = trigrams(a), trigrams(b)
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def tagged_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), sha256_hex(c))


def quote_hash(c: Column) -> Column:
    """Hash of a quoted passage; line ends are unified first."""
    return tagged_hash(F.regexp_replace(c, r"\r\n?", "\n"))


def stable_uuid(c: Column) -> Column:
    """Version-4-shaped identifier derived from a name."""
    h = sha256_hex(c)
    variant = F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"),
        F.lower(F.hex(variant)), F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12),
    )


def clip(c: Column, size: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size - 1), F.lit(mark))).otherwise(c)


def excerpt(c: Column) -> Column:
    flat = squash(c)
    return F.when(F.length(flat) > 180, F.concat(F.substring(flat, 1, 177), F.lit("…"))).otherwise(flat)


def section_title(heading: Column, text: Column, page_title: Column) -> Column:
    """Last heading, else the first sentence (32 characters at most), else the page title."""
    flat = F.regexp_replace(text, r"^\s*#{1,6}\s+", "")
    flat = squash(F.regexp_replace(flat, r"[`*_>\[\]]", ""))
    sentence = F.trim(F.regexp_extract(flat, r"^([^。！？.!?]*)", 1))
    named = F.when(page_title != "", F.concat(page_title, F.lit(" · 内容"))).otherwise(F.lit("内容片段"))
    return (
        F.when(F.trim(heading) != "", F.trim(heading))
        .when(sentence != "", clip(sentence, 32))
        .otherwise(named)
    )


def error_detail(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"[\p{Cc}\s]+", " ")), 1, 500)
