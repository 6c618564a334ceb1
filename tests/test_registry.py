import re
from pathlib import Path

import pytest

from folioscope.operators import paging as P
from folioscope.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_every_check_has_a_query():
    assert set(catalog.CHECKS) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 150


def test_no_operator_shortens_lineage_without_files():
    source = "\n".join(p.read_text() for p in Path("folioscope").rglob("*.py"))
    assert not re.search(r"localCheckpoint|crossJoin|toPandas\(", source)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="tables not here")
@pytest.mark.parametrize("name", ["daily_series", "acl_visible", "rrf_fused", "retrieval_metrics", "view_group", "stream_debounce"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from tools.check import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SMALL)
    cursor = con.execute(catalog.CHECKS[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_keyset_pages_walk_a_table_once(spark):
    df = spark.range(25).selectExpr("id % 4 as a", "id % 3 as b", "id as c")
    fields = [("a", "desc"), ("b", "asc"), ("c", "desc")]
    seen, cursor = [], None
    while True:
        page = P.keyset_page(df, fields, 7, after=cursor).collect()
        seen += [r["c"] for r in page[:7]]
        if len(page) <= 7:
            break
        cursor = P.page_cursor(page[6], fields)
    assert seen == [r["c"] for r in sorted(df.collect(), key=lambda r: (-r["a"], r["b"], -r["c"]))]
    back = P.keyset_page(df, fields, 3, before=cursor).collect()
    at = seen.index(P.decode_cursor(cursor)[2])
    assert [r["c"] for r in back[-3:]] == seen[at - 3 : at]


def test_offset_pages_are_as_large_as_asked(spark):
    assert P.offset_page(spark.range(300), ["id"], 1, 999).count() == 300
    assert [r["id"] for r in P.offset_page(spark.range(300), ["id"], 2, 120).collect()] == list(range(120, 240))
    for page, limit in ((0, 5), (1, 0)):
        with pytest.raises(ValueError):
            P.offset_page(spark.range(300), ["id"], page, limit)


def test_global_rank_equals_the_sorted_position(spark):
    df = spark.range(500).selectExpr("id", "(id * 7919) % 83 as k").repartition(5)
    got = {r["id"]: r["place"] for r in P.global_rank(df, ["k", "id"]).collect()}
    want = sorted(((r["k"], r["id"]) for r in df.collect()))
    assert [got[i] for _, i in want] == list(range(1, 501))


def test_guards_bound_what_one_task_reads(spark):
    from folioscope.session import apply_guards

    apply_guards(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16MB"
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_python_gets_small_batches_of_long_texts(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from folioscope.session import apply_guards

    apply_guards(spark)

    @F.pandas_udf("long")
    def rows_at_once(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    long = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    assert 0 < long.select(rows_at_once("text").alias("n")).agg(F.max("n")).first()[0] < 500
