"""Views of typed tables: filters, sorting, grouping, calendars, column changes.

Definitions are small Python objects that compile to Column expressions, so a filtered and sorted view
is one plan that Spark pushes down as far as it goes.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.cells import (
    MULTI,
    REFERENCES,
    TRUTHY,
    TYPES,
    display_text,
    is_empty,
    natural_key,
    normalize_cell,
    option_names,
    parse_number,
    strict_date,
)
from folioscope.functions.clock import date_span
from folioscope.functions.frames import literal_rows
from folioscope.operators.paging import global_rank

# Keys of groups that are not options.
EMPTY_GROUP, CHECKED_GROUP, UNCHECKED_GROUP = "__empty__", "__checked__", "__unchecked__"


@dataclass(frozen=True)
class TableColumn:
    id: str
    name: str = ""
    kind: str = "text"
    options: tuple[tuple[str, str], ...] = ()
    fmt: str = "number"
    decimals: int | None = None


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Group:
    mode: str = "and"
    items: tuple = ()


@dataclass(frozen=True)
class View:
    search: str = ""
    where: Group = field(default_factory=Group)
    sorts: tuple[tuple[str, str], ...] = ()
    shown: tuple[str, ...] = ()
    group_order: tuple[str, ...] = ()
    card_order: dict[str, tuple[str, ...]] = field(default_factory=dict)


def clean_columns(columns: list[TableColumn]) -> list[TableColumn]:
    """Blank and repeated ids go, unknown types become text, a text title column comes first."""
    seen: dict[str, TableColumn] = {}
    for c in columns:
        if c.id.strip() and c.id not in seen:
            seen[c.id] = c if c.kind in TYPES else replace(c, kind="text")
    rest = list(seen.values())
    if not rest:
        return [TableColumn("text", "Text")]
    title = next((c for c in rest if c.kind == "text"), None)
    if title is None:
        name = "title"
        while name in seen:
            name += "_"
        title = TableColumn(name, "Title")
    return [title, *[c for c in rest if c is not title]]


def typed_table(rows: DataFrame, columns: list[TableColumn]) -> DataFrame:
    """rows(row_id, position, values map<string,string>, lists map<string,array<string>>) as typed columns."""
    cells = [
        normalize_cell(c.kind, F.col("lists" if c.kind in MULTI else "values")[c.id]).alias(c.id) for c in clean_columns(columns)
    ]
    return rows.select("row_id", "position", *cells)


def read_value(column: TableColumn) -> Column:
    """The value without ids of options that no longer exist."""
    value, known = F.col(column.id), [o for o, _ in column.options]
    if column.kind == "select":
        return F.when(value.isin(known), value) if known else F.lit(None).cast("string")
    if column.kind in MULTI:
        return F.filter(value, lambda v: v.isin(known) if known else F.lit(False))
    return value


def cell_text(column: TableColumn) -> Column:
    return display_text(column.kind, F.col(column.id), list(column.options), column.fmt, column.decimals)


def match_condition(c: Condition, column: TableColumn) -> Column:
    """One condition; a missing target is ignored rather than hiding every row."""
    value, empty = read_value(column), is_empty(column.kind, read_value(column))
    if c.op in ("isEmpty", "isNotEmpty"):
        return empty if c.op == "isEmpty" else ~empty
    if c.op in ("isChecked", "isUnchecked"):
        checked = F.coalesce(value, F.lit(False))
        return checked if c.op == "isChecked" else ~checked
    if c.value is None or c.value == "" or c.value == [] or c.value == ():
        return F.lit(True)
    no = lambda test: F.coalesce(test, F.lit(False))
    if column.kind in ("number", "progress"):
        target = F.lit(float(c.value))
        tests = {"eq": value == target, "gt": value > target, "gte": value >= target, "lt": value < target, "lte": value <= target}
        return ~no(value == target) if c.op == "neq" else no(tests[c.op]) if c.op in tests else F.lit(True)
    if column.kind == "date":
        target = F.lit(c.value).cast("date")
        tests = {
            "is": value == target, "before": value < target, "after": value > target,
            "onOrBefore": value <= target, "onOrAfter": value >= target,
        }
        return no(tests[c.op]) if c.op in tests else F.lit(True)
    if column.kind == "select":
        hit = no(value.isin(list(c.value)))
        return {"isAnyOf": hit, "isNoneOf": ~hit}.get(c.op, F.lit(True))
    if column.kind in MULTI:
        wanted = F.array(*[F.lit(v) for v in c.value])
        any_of = F.arrays_overlap(value, wanted)
        return {
            "hasAnyOf": any_of, "hasAllOf": F.size(F.array_except(wanted, value)) == 0, "hasNoneOf": ~any_of
        }.get(c.op, F.lit(True))
    text, target = F.lower(cell_text(column)), F.lit(str(c.value).lower())
    tests = {
        "contains": F.contains(text, target), "notContains": ~F.contains(text, target), "is": text == target, "isNot": text != target,
        "startsWith": F.startswith(text, target), "endsWith": F.endswith(text, target),
    }
    return tests.get(c.op, F.lit(True))


def filter_group(group: Group, columns: list[TableColumn]) -> Column:
    """Nested AND/OR tree as one predicate; empty groups and unknown columns pass."""
    by_id = {c.id: c for c in columns}
    tests = [
        filter_group(item, columns) if isinstance(item, Group)
        else match_condition(item, by_id[item.column]) if item.column in by_id else F.lit(True)
        for item in group.items
    ]
    if not tests:
        return F.lit(True)
    return reduce(lambda a, b: a | b, tests) if group.mode == "or" else reduce(lambda a, b: a & b, tests)


def search_rows(query: str, columns: list[TableColumn]) -> Column:
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(F.lower(cell_text(c)), F.lit(needle)) for c in columns])


def sort_keys(columns: list[TableColumn], sorts: tuple[tuple[str, str], ...], tie: str = "position") -> list[Column]:
    """Order of a view: empty cells last either way, options in their order, text in natural order."""
    by_id = {c.id: c for c in columns}
    keys: list[Column] = []
    for name, direction in sorts:
        if name not in by_id:
            continue
        column = by_id[name]
        value = read_value(column)
        if column.kind == "select" or column.kind in MULTI:
            order = F.array(*[F.lit(o) for o, _ in column.options]) if column.options else F.array().cast("array<string>")
            value = (
                F.array_position(order, value) if column.kind == "select"
                else F.array_sort(F.transform(value, lambda v: F.array_position(order, v)))
            )
        elif column.kind in ("text", "url"):
            value = natural_key(value)
        empty = F.lit(False) if column.kind == "checkbox" else is_empty(column.kind, read_value(column))
        keys.append(F.asc(F.when(empty, 1).otherwise(0)))
        keys.append(F.desc(value) if direction == "desc" else F.asc(value))
    return [*keys, F.asc(tie)]


def table_view(rows: DataFrame, columns: list[TableColumn], view: View) -> DataFrame:
    kept = rows.filter(filter_group(view.where, columns) & search_rows(view.search, columns))
    ordered = kept.orderBy(*sort_keys(columns, view.sorts))
    shown = [columns[0].id, *[c for c in view.shown if c != columns[0].id]] if view.shown else [c.id for c in columns]
    return ordered.select("row_id", *shown)


def row_groups(column: TableColumn) -> Column:
    """Group keys a row belongs to."""
    value = read_value(column)
    if column.kind == "checkbox":
        return F.array(F.when(F.coalesce(value, F.lit(False)), CHECKED_GROUP).otherwise(UNCHECKED_GROUP))
    ids = value if column.kind in MULTI else F.array_compact(F.array(value))
    return F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit(EMPTY_GROUP)))


def group_spine(rows: DataFrame, column: TableColumn, view: View) -> DataFrame:
    """(group_key, group_position) of all groups in display order."""
    natural = [UNCHECKED_GROUP, CHECKED_GROUP] if column.kind == "checkbox" else [*[o for o, _ in column.options], EMPTY_GROUP]
    listed = [k for k in view.group_order if k in natural]
    ordered = listed + [k for k in natural if k not in listed]
    return literal_rows(rows.sparkSession, "group_key string, group_position int", list(zip(ordered, range(len(ordered)))))


def group_rows(rows: DataFrame, columns: list[TableColumn], by: str, view: View) -> DataFrame:
    """(group_key, group_position, row_id, card): rows in every group they have, empty groups kept.

    Without sorts the manual card order of a group comes first. Members and documents form a group only
    while some row refers to them. Places come from one range-partitioned sort on (group, order), so a
    group that holds a third of the rows is spread over many tasks.
    """
    column = next(c for c in columns if c.id == by)
    spine = F.broadcast(group_spine(rows, column, view))
    placed = rows.withColumn("group_key", F.explode(row_groups(column)))
    manual = F.lit(None).cast("int")
    if not view.sorts:
        for key, ids in view.card_order.items():
            spot = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("row_id").cast("string"))
            manual = F.when((F.col("group_key") == key) & (spot > 0), spot).otherwise(manual)
    ranked = global_rank(placed, [F.asc("group_key"), F.asc_nulls_last(manual), *sort_keys(columns, view.sorts)])
    starts = ranked.groupBy("group_key").agg(F.min("place").alias("first"))
    cards = ranked.join(starts, "group_key").select("group_key", "row_id", (F.col("place") - F.col("first") + 1).alias("card"))
    grouped = spine.join(cards, "group_key", "left")
    if column.kind in REFERENCES:
        grouped = grouped.filter(F.col("row_id").isNotNull() | (F.col("group_key") == EMPTY_GROUP))
    return grouped


def calendar_rows(rows: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """(row_id, start, stop, day): one row per calendar cell; rows without a start are left out."""
    first, last = date_span(F.col(start), F.col(end) if end else F.col(start))
    spans = rows.filter(F.col(start).isNotNull()).select("row_id", first.alias("start"), last.alias("stop"))
    return spans.withColumn("day", F.explode(F.sequence("start", "stop", F.expr("interval 1 day"))))


def move_group(column: TableColumn, value: Column, source: str, target: str) -> Column:
    """Cell value after a row moved from one group to another."""
    if column.kind == "checkbox":
        return F.lit(target == CHECKED_GROUP)
    if column.kind == "select":
        return F.lit(None if target == EMPTY_GROUP else target).cast("string")
    if column.kind in MULTI:
        if target == EMPTY_GROUP:
            return F.array().cast("array<string>")
        left = F.array_remove(value, source)
        return F.when(F.array_contains(left, target), left).otherwise(F.array_append(left, target))
    return value


def filter_defaults(group: Group, columns: list[TableColumn]) -> dict[str, object]:
    """Values a new row needs to pass the plain AND conditions of a view."""
    if group.mode != "and":
        return {}
    by_id = {c.id: c for c in columns}
    plain = [i for i in group.items if isinstance(i, Condition)]
    out: dict[str, object] = {}
    for c in plain:
        if c.column not in by_id or sum(other.column == c.column for other in plain) > 1:
            continue
        kind, v = by_id[c.column].kind, c.value
        day = date.fromisoformat(v) if kind == "date" and isinstance(v, str) else None
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        found = {
            "isChecked": True,
            **dict.fromkeys(("is", "contains", "startsWith", "endsWith", "eq", "gte", "lte", "onOrAfter", "onOrBefore"), v),
            "gt": v + 1 if number else None,
            "lt": v - 1 if number else None,
            "after": (day + timedelta(days=1)).isoformat() if day else None,
            "before": (day - timedelta(days=1)).isoformat() if day else None,
            "isAnyOf": v[0] if isinstance(v, (list, tuple)) and len(v) == 1 else None,
            **dict.fromkeys(("hasAnyOf", "hasAllOf"), list(v) if isinstance(v, (list, tuple)) else None),
        }.get(c.op)
        if found is None or found == "":
            continue
        out[c.column] = min(max(round(found), 0), 100) if kind == "progress" else found
    return out


# --- column changes ------------------------------------------------------------------------------------


def plain_text(column: TableColumn) -> Column:
    """Text of a cell for conversions."""
    if column.kind == "checkbox":
        return F.when(F.col(column.id), "Yes").otherwise("No")
    if column.kind in ("number", "progress"):
        return F.coalesce(display_text("number", F.col(column.id).cast("double"), []), F.lit(""))
    return cell_text(column)


def column_options(rows: DataFrame, column: TableColumn) -> DataFrame:
    """(key, name, position): options made from the texts of a column, first spelling kept, case ignored."""
    names = rows.select("position", F.posexplode(option_names(plain_text(column))).alias("n", "name"))
    first = F.struct("position", "n")
    options = names.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", first).alias("name"), F.min(first).alias("_at"))
    return options.select("key", "name", F.col("_at.position").alias("position"), F.col("_at.n").alias("n"))


def convert_column(rows: DataFrame, column: TableColumn, kind: str) -> DataFrame:
    """The column with its values in the new type; new options are named by their lower-case text."""
    if kind in REFERENCES:
        return rows.withColumn(column.id, F.array().cast("array<string>"))
    text = F.trim(plain_text(column))
    if kind in ("select", "multiSelect"):
        if column.kind in ("select", "multiSelect"):
            ids = F.col(column.id) if column.kind == "multiSelect" else F.array_compact(F.array(column.id))
        else:
            ids = F.array_distinct(F.transform(option_names(text), F.lower))
        return rows.withColumn(column.id, ids if kind == "multiSelect" else F.try_element_at(ids, F.lit(1)))
    if kind == "checkbox":
        return rows.withColumn(column.id, F.lower(text).isin(TRUTHY))
    if kind == "date":
        dashed = F.regexp_replace(F.regexp_replace(text, "[/.]", "-"), r"-(\d)(?!\d)", "-0$1")
        return rows.withColumn(column.id, strict_date(dashed))
    if kind == "number":
        return rows.withColumn(column.id, parse_number(text))
    if kind == "progress":
        return rows.withColumn(column.id, normalize_cell("progress", parse_number(text).cast("string")))
    return rows.withColumn(column.id, text)


def add_column(rows: DataFrame, columns: list[TableColumn], new: TableColumn) -> tuple[DataFrame, list[TableColumn]]:
    source = F.lit(None).cast("array<string>" if new.kind in MULTI else "string")
    return rows.withColumn(new.id, normalize_cell(new.kind, source)), [*columns, new]


def duplicate_column(rows: DataFrame, columns: list[TableColumn], source: str, new_id: str) -> tuple[DataFrame, list[TableColumn]]:
    """A copy of a column right after it."""
    at = next(i for i, c in enumerate(columns) if c.id == source)
    copy = replace(columns[at], id=new_id, name=f"{columns[at].name} (copy)")
    return rows.withColumn(new_id, F.col(source)), [*columns[: at + 1], copy, *columns[at + 1 :]]


def delete_column(rows: DataFrame, columns: list[TableColumn], name: str, view: View) -> tuple[DataFrame, list[TableColumn], View]:
    """Drops a column and every use of it in the view; the title column stays."""
    if name == columns[0].id:
        raise ValueError("the title column cannot be deleted")

    def prune(group: Group) -> Group:
        kept = [prune(i) if isinstance(i, Group) else i for i in group.items if isinstance(i, Group) or i.column != name]
        return replace(group, items=tuple(kept))

    slim = replace(
        view, where=prune(view.where), sorts=tuple(s for s in view.sorts if s[0] != name), shown=tuple(s for s in view.shown if s != name)
    )
    return rows.drop(name), [c for c in columns if c.id != name], slim


def shift_dates(rows: DataFrame, start: str, end: str | None, days: int, only_end: bool = False) -> DataFrame:
    """Moves a span, or only its end, which never passes before the start."""
    if only_end:
        moved = F.greatest(F.date_add(F.coalesce(F.col(end), F.col(start)), days), F.col(start))
        return rows.withColumn(end, moved)
    names = [start] + ([end] if end else [])
    return rows.withColumns({n: F.date_add(n, days) for n in names})
