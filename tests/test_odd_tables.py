"""Registered queries against their SQL on tables with odd rows."""

from datetime import datetime, timedelta

import pytest

from folioscope.plans import catalog

SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string",
    "conversations": "conv_id long, turn long, role string, text string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


@pytest.fixture
def agree(spark, tmp_path):
    """Writes the given tables and compares a query with its SQL on them; returns the rows."""

    def run(query, **tables):
        import duckdb

        from tools.check import rows_of

        con = duckdb.connect()
        for name, data in tables.items():
            spark.createDataFrame(data, SCHEMAS[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
            con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        df = catalog.QUERIES[query](spark, str(tmp_path))
        got = [tuple(r) for r in df.collect()]
        cursor = con.execute(catalog.CHECKS[query])
        assert rows_of(df.columns, got) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
        return got

    return run


@pytest.mark.parametrize("query", ["delayed_summary", "promote_due"])
def test_schedules_of_keys_below_zero_and_beyond_doubles(agree, query):
    keys = [-41, -7, -1, 0, 19, 20 * 2**53 - 1]
    events = [(i, datetime(2024, 1, 2) + timedelta(hours=i), 1, "view", 1.0, f'{{"k": {k}}}') for i, k in enumerate(keys)]
    assert agree(query, events=events, region=[(i, "R") for i in range(5)])


def test_sessions_that_go_on_are_not_due(agree):
    """Page 1 is quiet two hours before now in the middle of a session only; rows without a page have no workspace."""
    at = lambda day, hour, minute=0: datetime(2024, 1, day, hour, minute)
    seen = [(1, at(19, 20)), (1, at(19, 21, 30)), (1, at(19, 23)), (1, at(20, 0, 30)), (7, at(19, 23)), (8, at(19, 23, 0)), (8, at(20, 1))]
    events = [(i, ts, 1, "view", 1.0, f'{{"k": {k}}}') for i, (k, ts) in enumerate(seen)] + [(9, at(3, 1), 1, "view", 1.0, "{}")]
    assert agree("promote_due", events=events, region=[(i, "R") for i in range(5)]) == [(1, 1, "2024-01-20 01:00:00")]


def test_start_of_workspaces_with_nothing_due(agree):
    events = [(i, datetime(2024, 1, 25, 3), 1, "view", 1.0, f'{{"k": {k}}}') for i, k in enumerate([5, 45, 65])]
    found = agree("delayed_summary", events=events, region=[(i, "R") for i in range(5)])
    assert sorted((r[0], r[1], r[2], r[-1]) for r in found) == [(0, 1, 0, "2024-01-20 01:00:00"), (2, 1, 0, "2024-01-20 14:00:00"), (3, 1, 0, "2024-01-20 01:00:00")]


def test_reuse_rounds_halves_to_even(agree):
    customer = [(1, "c", 0, 2.5, "x"), (2, "c", 0, 3.5, "x")]
    line = [(1, 1, 1, 1, 2.0, "A"), (1, 1, 2, 2, 4.0, "A")]
    assert sorted(agree("reuse_candidates", customer=customer, orders=[(1, 1), (2, 2)], lineitem=line)) == [(1,), (2,)]


def test_grounding_counts_a_lone_stop_word(agree):
    turns = [(1, 0, "user", "of the a b"), (1, 1, "assistant", "one of them"), (2, 0, "user", "Red fox ran"), (2, 1, "assistant", "a red fox")]
    assert sorted(agree("reference_grounding", conversations=turns)) == [(1, 1, 1, "grounded"), (2, 1, 1, "grounded")]


def test_evidence_quotes_whole_documents(agree, monkeypatch):
    from folioscope.sources import datasets

    asked = []
    verify = datasets.verified_evidence
    monkeypatch.setattr(datasets, "verified_evidence", lambda items, docs: (asked.append(items), verify(items, docs))[1])
    text = " ".join(f"word{i}" for i in range(40))
    docs = [(1, text, "en", "s", 0), (2, text, "de", "s", 0), (3, " \n ", "en", "s", 0), (4, None, "en", "s", 0)]
    assert agree("verified_evidence", documents=docs) == [(1,)]
    quotes = next(r["quotes"] for r in asked[0].collect() if r["doc_id"] == 1)
    assert len(quotes) == -(-len(text) // 60) + 1 and "".join(quotes).replace(" ", "") == text.replace(" ", "")


def test_row_scores_bind_the_text_once(spark):
    """An expression inside a filter would be evaluated again for every term."""
    from pyspark.sql import functions as F

    from folioscope.operators.context import term_score

    df = spark.createDataFrame([(["ab", "zz", "x1"], "AB X1")], "terms array<string>, text string")
    scored = df.select(term_score(F.col("terms"), F.lower("text")).alias("score"))
    assert scored.first()["score"] == 8
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(lower" not in plan.lower()


def test_recipients_send_no_pairs_through_an_exchange(rows, spark):
    from folioscope.operators.members import recipients

    pages = rows("page_id long, space_id int", (1, 1), (2, 1), (3, None), (1, 1), (5, 2), (6, 1), (6, 3))
    watching = rows("space_id int, user_id long", (1, 10), (1, 11), (1, 11), (None, 14), (2, None), (3, 11), (3, 17))
    own = rows("page_id long, user_id long", (1, 10), (1, 12), (2, 13), (2, 13), (3, 14), (4, 15), (5, 16), (6, 17), (6, 18))
    muted = rows("page_id long, user_id long", (1, 11), (2, 13), (5, 19))
    found = recipients(own, pages, watching, muted)
    want = [(1, 10), (1, 12), (2, 10), (2, 11), (3, 14), (4, 15), (5, None), (5, 16), (6, 10), (6, 11), (6, 17), (6, 18)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    # above the join of pages with watchers there is a union and no exchange
    top = found._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert top.startswith("Union")


def test_recipients_keep_pages_of_a_space_together(rows, spark):
    from itertools import groupby

    from pyspark.sql import functions as F

    from folioscope.operators.members import recipients

    pages = rows("page_id long, space_id int", *[(i, i % 4) for i in range(4000)])
    watching = rows("space_id int, user_id long", *[(i % 4, i) for i in range(12)])
    none = rows("page_id long, user_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4kb")  # pages are too many for a broadcast, watchers are not
    try:
        found = recipients(none, pages, watching, none).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 12000
    for _, part in groupby(found, lambda r: r["part"]):
        spaces = [s for s, _ in groupby(part, lambda r: r["page_id"] % 4)]
        assert len(spaces) == len(set(spaces))
