"""Cells of typed tables: parsing, formatting, normal forms, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column types, and words read as a checked box.
TYPES = ["text", "number", "select", "multiSelect", "person", "page", "date", "checkbox", "url", "progress"]
MULTI = {"multiSelect", "person", "page"}
REFERENCES = {"person", "page"}
TRUTHY = ["yes", "true", "1", "y", "✓", "x", "是", "对"]
CURRENCY_SIGNS = {"CNY": "CN¥", "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥"}
DATE_FORM = r"^\d{4}-\d{2}-\d{2}$"


def parse_number(text: Column) -> Column:
    """User input such as "1,234.5", "¥ 12" or "45%"; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\s", ""), ",", "")
    bare = F.regexp_replace(bare, r"^[^\d+\-.]+|[^\d.]+$", "")
    good = bare.rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$")
    return F.when(good, bare.try_cast("double"))


def _grouped(value: Column, decimals: int | None) -> Column:
    """Thousands separators; without fixed decimals the shortest form with at most ten."""
    if decimals is not None:
        return F.format_number(value, decimals)
    return F.regexp_replace(F.regexp_replace(F.format_number(value, 10), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def format_number(value: Column, fmt: str = "number", decimals: int | None = None) -> Column:
    """number has no grouping, grouped has; percent shows 12 as 12%; currencies use two decimals (JPY none)."""
    if fmt == "number":
        return F.replace(_grouped(value, decimals), F.lit(","), F.lit(""))
    if fmt == "percent":
        return F.concat(_grouped(value, decimals), F.lit("%"))
    if fmt in CURRENCY_SIGNS:
        places = decimals if decimals is not None else (0 if fmt == "JPY" else 2)
        sign = F.when(value < 0, "-").otherwise("")
        return F.concat(sign, F.lit(CURRENCY_SIGNS[fmt]), F.format_number(F.abs(value), places))
    return _grouped(value, decimals)


def url_href(text: Column) -> Column:
    """A safe link for http, https and mailto texts and bare domains, else null."""
    t = F.trim(text)
    scheme = t.rlike(r"(?i)^(https?://[^\s/?#]+|mailto:\S)")
    bare = t.rlike(r"^[\w-]+(\.[\w-]+)+(:\d+)?(/\S*)?$")
    return F.when(scheme, t).when(bare, F.concat(F.lit("https://"), t))


def strict_date(text: Column) -> Column:
    """YYYY-MM-DD and a real calendar day, else null."""
    return F.when(text.rlike(DATE_FORM), F.try_to_date(text, "yyyy-MM-dd"))


def normalize_cell(kind: str, raw: Column) -> Column:
    """Typed value of a raw text cell; multi-value cells arrive as arrays of ids."""
    if kind in ("text", "url"):
        return F.coalesce(raw, F.lit(""))
    if kind == "number":
        return F.nullif(F.trim(raw), F.lit("")).try_cast("double")
    if kind == "progress":
        value = F.nullif(F.trim(raw), F.lit("")).try_cast("double")
        return F.when(value.isNotNull(), F.least(F.greatest(F.floor(value + 0.5), F.lit(0)), F.lit(100))).cast("int")
    if kind == "select":
        return F.nullif(raw, F.lit(""))
    if kind in MULTI:
        return F.array_distinct(F.filter(F.coalesce(raw, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "")))
    if kind == "date":
        return strict_date(raw)
    if kind == "checkbox":
        return F.coalesce(raw.try_cast("boolean"), F.lit(False))
    return F.coalesce(raw, F.lit(""))


def is_empty(kind: str, value: Column) -> Column:
    """Emptiness of a normalised value."""
    if kind == "checkbox":
        return ~F.coalesce(value, F.lit(False))
    if kind in MULTI:
        return F.coalesce(F.size(value) <= 0, F.lit(True))
    if kind in ("text", "url", "select"):
        return F.coalesce(value == "", F.lit(True))
    return value.isNull()


def option_map(options: list[tuple[str, str]]) -> Column:
    if not options:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(v) for pair in options for v in pair])


def display_text(kind: str, value: Column, options: list[tuple[str, str]], fmt: str = "number", decimals: int | None = None) -> Column:
    """Readable text of a normalised value."""
    if kind == "select":
        return F.coalesce(option_map(options)[value], F.lit(""))
    if kind in MULTI:
        names = option_map(options)
        return F.array_join(F.filter(F.transform(value, lambda v: names[v]), lambda n: n.isNotNull() & (n != "")), ", ")
    if kind == "checkbox":
        return F.when(value, "✓").otherwise("")
    if kind == "number":
        return F.coalesce(format_number(value, fmt, decimals), F.lit(""))
    if kind == "progress":
        return F.coalesce(F.concat(value.cast("string"), F.lit("%")), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def natural_key(text: Column) -> Column:
    """Sort key in which digits compare as numbers and case and accents do not count."""
    from folioscope.functions.text import fold

    runs = F.regexp_extract_all(fold(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 20, "0")).otherwise(r))
    return F.array_join(padded, "")


def option_names(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, "[,，]"), lambda n: F.trim(n)), lambda n: n != ""))
