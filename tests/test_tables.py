import pytest
from pyspark.sql import functions as F

from folioscope.operators import views as V

COLUMNS = [
    V.TableColumn("name", "Name"),
    V.TableColumn("n", "N", "number"),
    V.TableColumn("status", "Status", "select", (("todo", "To do"), ("done", "Done"))),
    V.TableColumn("tags", "Tags", "multiSelect", (("a", "Alpha"), ("b", "Beta"))),
    V.TableColumn("who", "Who", "person", (("u1", "Ann"), ("u2", "Bob"))),
    V.TableColumn("ok", "OK", "checkbox"),
]


@pytest.fixture
def table(rows):
    raw = rows(
        "row_id string, position int, values map<string,string>, lists map<string,array<string>>",
        ("r1", 0, {"name": "item 10", "n": "5", "status": "done", "ok": "true"}, {"tags": ["a", "b"], "who": ["u1"]}),
        ("r2", 1, {"name": "Item 9", "status": "gone"}, {"tags": ["gone"]}),
        ("r3", 2, {"name": "", "n": "-1", "status": "todo"}, {"tags": ["b"], "who": ["u1"]}),
        ("r4", 3, {"name": "item 10", "n": "x"}, {}),
    )
    return V.typed_table(raw, COLUMNS)


def _view(table, **kw):
    return [r["row_id"] for r in V.table_view(table, COLUMNS, V.View(**kw)).collect()]


def test_sorts_put_empty_cells_last_in_both_directions(table):
    assert _view(table, sorts=(("name", "asc"),)) == ["r2", "r1", "r4", "r3"]
    assert _view(table, sorts=(("name", "desc"),)) == ["r1", "r4", "r2", "r3"]
    assert _view(table, sorts=(("n", "desc"),)) == ["r1", "r3", "r2", "r4"]
    assert _view(table, sorts=(("status", "asc"),)) == ["r3", "r1", "r2", "r4"]
    assert _view(table, sorts=(("tags", "asc"),)) == ["r1", "r3", "r2", "r4"]
    assert _view(table, sorts=(("missing", "asc"),)) == ["r1", "r2", "r3", "r4"]


def test_filters(table):
    one = lambda *a: _view(table, where=V.Group("and", (V.Condition(*a),)))
    assert one("n", "neq", 5) == ["r2", "r3", "r4"] and one("n", "gt", 0) == ["r1"]
    assert one("status", "isEmpty") == ["r2", "r4"] and one("status", "isNoneOf", ("done",)) == ["r2", "r3", "r4"]
    assert one("tags", "isEmpty") == ["r2", "r4"] and one("tags", "hasAllOf", ("a", "b")) == ["r1"]
    assert one("name", "contains", "ITEM") == ["r1", "r2", "r4"] and one("name", "contains", "") == ["r1", "r2", "r3", "r4"]
    assert one("ok", "isUnchecked") == ["r2", "r3", "r4"]
    both = V.Group("or", (V.Condition("n", "lt", 0), V.Group("and", (V.Condition("ok", "isChecked"), V.Condition("zzz", "is", "q")))))
    assert _view(table, where=both) == ["r1", "r3"]
    assert _view(table, search=" beta") == ["r1", "r3"]


def test_groups(table):
    got = {}
    for r in V.group_rows(table, COLUMNS, "status", V.View(group_order=("done",), card_order={"__empty__": ("r4",)})).orderBy("group_position", "card").collect():
        got.setdefault(r["group_key"], []).append(r["row_id"])
    assert list(got.items()) == [("done", ["r1"]), ("todo", ["r3"]), ("__empty__", ["r4", "r2"])]
    who = {r["group_key"] for r in V.group_rows(table, COLUMNS, "who", V.View()).collect()}
    assert who == {"u1", "__empty__"}  # a member nobody refers to has no group
    tags = sorted((r["group_key"], r["row_id"]) for r in V.group_rows(table, COLUMNS, "tags", V.View()).collect())
    assert tags == [("__empty__", "r2"), ("__empty__", "r4"), ("a", "r1"), ("b", "r1"), ("b", "r3")]


def test_filter_defaults():
    where = V.Group("and", (V.Condition("n", "gt", 4), V.Condition("status", "isAnyOf", ("todo",)), V.Condition("ok", "isChecked"), V.Condition("tags", "hasNoneOf", ("a",)), V.Condition("name", "is", "x"), V.Condition("name", "isNot", "y")))
    assert V.filter_defaults(where, COLUMNS) == {"n": 5, "status": "todo", "ok": True}
    due = [V.TableColumn("due", kind="date")]
    assert V.filter_defaults(V.Group("and", (V.Condition("due", "before", "2024-03-01"),)), due) == {"due": "2024-02-29"}
    assert V.filter_defaults(V.Group("or", (V.Condition("n", "gt", 4),)), COLUMNS) == {}


def test_title_column_is_first_and_text():
    kinds = [(c.id, c.kind) for c in V.clean_columns([V.TableColumn("a", kind="number"), V.TableColumn("b"), V.TableColumn("a"), V.TableColumn("c", kind="weird")])]
    assert kinds == [("b", "text"), ("a", "number"), ("c", "text")]
    assert V.clean_columns([V.TableColumn("title", kind="date")])[0].id == "title_"


def test_delete_column_cleans_the_view(table):
    view = V.View(where=V.Group("and", (V.Condition("n", "gt", 1), V.Condition("ok", "isChecked"))), sorts=(("n", "asc"),), shown=("n", "ok"))
    rows, columns, slim = V.delete_column(table, COLUMNS, "n", view)
    assert "n" not in rows.columns and slim.sorts == () and slim.shown == ("ok",) and len(slim.where.items) == 1
    with pytest.raises(ValueError):
        V.delete_column(table, COLUMNS, "name", view)


def test_options_keep_the_first_spelling(rows):
    df = rows("position int, t string", (0, "Red, blue"), (1, "BLUE，green,"))
    got = sorted((r["key"], r["name"]) for r in V.column_options(df, V.TableColumn("t")).collect())
    assert got == [("blue", "blue"), ("green", "green"), ("red", "Red")]


def test_move_and_dates(rows):
    df = rows("tags array<string>, s date, e date", (["a"], None, None)).withColumns({"s": F.lit("2024-01-01").cast("date"), "e": F.lit("2024-01-03").cast("date")})
    tags = COLUMNS[3]
    assert df.select(V.move_group(tags, F.col("tags"), "a", "b").alias("v")).first()["v"] == ["b"]
    assert df.select(V.move_group(tags, F.col("tags"), "a", "__empty__").alias("v")).first()["v"] == []
    assert [str(r) for r in V.shift_dates(df, "s", "e", 2).select("s", "e").first()] == ["2024-01-03", "2024-01-05"]
    assert str(V.shift_dates(df, "s", "e", -9, only_end=True).first()["e"]) == "2024-01-01"
