import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope.operators import activity as A
from folioscope.operators import provenance as V
from folioscope.operators import usage as U
from folioscope.sources import datasets as D
from folioscope.sources import feeds as FE
from folioscope.streaming import streams as ST


def _at(*parts):
    return datetime(2024, *parts)


def test_rolling_users_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    start = datetime(2024, 1, 1, 16)
    events = [(rng.randrange(6), start + timedelta(days=rng.uniform(-35, 20))) for _ in range(120)]
    df = spark.createDataFrame(events, "user_id int, ts timestamp_ntz")
    got = {r["day"]: (r["wau"], r["mau"]) for r in A.rolling_active(df, start, start + timedelta(days=15), {"wau": 7, "mau": 30}).collect()}
    local = [(u, (t + timedelta(hours=8)).date()) for u, t in events]
    for i in range(15):
        day = date(2024, 1, 2) + timedelta(days=i)
        count = lambda n: len({u for u, d in local if day - timedelta(days=n) < d <= day})
        assert got[day] == (count(7), count(30))


def test_stock_counts_until_the_day_before_the_end(rows):
    users = rows("created_at timestamp_ntz, deleted_at timestamp_ntz, deactivated_at timestamp_ntz", (_at(1, 1), None, None), (_at(1, 2), _at(1, 4), None), (_at(1, 3), None, _at(1, 3)), (_at(1, 5), None, None))
    spaces = rows("created_at timestamp_ntz", (_at(1, 2),))
    gone = rows("created_at timestamp_ntz, metadata string", (_at(1, 4), '{"spaceCreatedAt":"2024-01-01 00:00:00"}'), (_at(1, 4), '{"spaceCreatedAt":"bad"}'))
    got = [(r["user_count"], r["space_count"]) for r in A.daily_stock(users, spaces, gone, date(2024, 1, 1), date(2024, 1, 5)).orderBy("day").collect()]
    assert got == [(1, 1), (2, 2), (2, 2), (1, 1), (2, 1)]


def test_usage_attribution(rows):
    users = rows("id string, name string, email string, user_type string", ("u1", "Ann", "a@x", "human"), ("bot", "Bot_100%", "b@x", "agent"))
    keys = rows("id string, name string, key_type string, creator_id string, deleted_at timestamp_ntz, expires_at timestamp_ntz", ("k1", "Key", None, "u1", None, None), ("k2", "Old", "personal", "u1", _at(1, 1), None))
    meta = lambda **kw: json.dumps(kw)
    events = rows(
        "event_id int, ts timestamp_ntz, user_id string, op string, metadata string",
        (1, _at(1, 1, 1), "bot", "page.read", meta(apiKeyId="k1", channel="api", delegatedUserId="u1")), (2, _at(1, 1, 2), "bot", "x", meta(channel="mcp", outcome="error")),
        (3, _at(1, 1, 3), "u1", "x", meta(apiKeyId="k2", channel="api")), (4, _at(1, 1, 4), "nobody", "x", "not json"),
    )
    ops = U.attribute_ops(events, users, keys)
    got = {r["event_id"]: (r["attributed_user_id"], r["key_type"], r["outcome"], r["is_agent"]) for r in ops.collect()}
    assert got == {1: ("u1", "agent", "called", True), 2: (None, "agent", "error", True), 3: ("u1", "personal", "called", False), 4: (None, "unknown", "called", None)}
    groups = {r["group_id"]: r for r in U.usage_groups(U.usage_base(ops, "user"), _at(2, 1)).collect()}
    assert groups["u1"]["ops"] == 2 and groups["u1"]["status"] == "revoked" and groups["__none__"]["failed_ops"] == 1
    assert [r["event_id"] for r in U.usage_base(ops, search="bot_100%").collect()] == [1, 2]


@pytest.mark.parametrize("op,category", [("page.read", "read"), ("mcp:query_knowledge", "query"), ("mcp:search_x", "search"), ("mcp:odd", "other"), ("mcp:delete_page", "delete"), ("zzz", "other")])
def test_op_categories(one, op, category):
    assert one(A.op_category, op) == category


def test_cooldown_batch_and_stream_agree(spark, tmp_path):
    times = [0, 5, 11, 12, 13, 25, 30, 37]
    data = [("u", i, _at(1, 1) + timedelta(hours=h)) for i, h in enumerate(times)] + [("v", 100, _at(1, 1))]
    df = spark.createDataFrame(data, "user_id string, notice_id int, ts timestamp_ntz")
    want = [0, 3, 5, 7, 100]
    assert sorted(r["notice_id"] for r in ST.cooldown(df, ["user_id"], 12).collect()) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = ST.stream_cooldown(stream, "user_id", 12).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["notice_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_stream_cooldown_orders_a_key_across_arrow_batches(spark, tmp_path):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    data = [("u", i, _at(1, 1) + timedelta(hours=i)) for i in range(40)]
    df = spark.createDataFrame(data[::-1], "user_id string, notice_id int, ts timestamp_ntz").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    try:
        spark.conf.set(size, "4")
        query = ST.stream_cooldown(stream, "user_id", 12).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(size, before)
    assert sorted(r["notice_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 12, 24, 36]


def test_debounce_takes_out_of_order_changes(rows):
    df = rows("page_id int, ts timestamp_ntz", (1, _at(1, 1, 1, 30)), (1, _at(1, 1, 1, 0)), (1, _at(1, 1, 4, 0)))
    got = sorted((r["change_count"], str(r["eligible_at"])) for r in ST.debounce(df).collect())
    assert got == [(1, "2024-01-01 05:00:00"), (2, "2024-01-01 02:30:00")]


def test_logs(rows):
    line = json.dumps({"time": "t", "level": 50, "req": {"method": "GET", "url": "/x"}, "res": {"statusCode": 500}, "err": {"type": "E", "stack": "a\nb"}})
    r = FE.flatten_logs(rows("value string", (line,), ('{"time":"t","level":30}',))).collect()
    assert (r[0]["res_status"], r[0]["err_stack"], r[0]["user_id"], r[0]["raw"]) == (500, "a\nb", "", line)
    assert (r[1]["res_status"], r[1]["req_url"], r[1]["res_time_ms"]) == (None, "", None)


def test_append_events(rows, spark, tmp_path):
    df = rows("event string, route string, ts timestamp_ntz", ("page_view", "home", _at(1, 1)), ("page_view", "odd", _at(1, 2)), ("agent_op", "x" * 80, _at(1, 2)))
    FE.append_events(df, ["home"], str(tmp_path / "e"))
    FE.append_events(df.limit(1), ["home"], str(tmp_path / "e"))
    got = spark.read.parquet(str(tmp_path / "e"))
    assert got.count() == 4 and {r["route"] for r in got.collect()} == {"home", "other", "x" * 64}


def test_publish_replaces_only_touched_artifacts(rows, spark, tmp_path):
    path = str(tmp_path / "k")
    page = lambda *d: rows("artifact_id int, title string", *d)
    chunk = lambda *d: rows("artifact_id int, text string", *d)
    FE.publish_chunks(page((1, "a"), (2, "b")), {"chunks": chunk((1, "x"), (1, "y"), (2, "z"))}, path)
    for _ in range(2):  # publishing twice changes nothing
        FE.publish_chunks(page((1, "a2")), {"chunks": chunk((1, "w"))}, path)
    read = lambda name, c: sorted((r["artifact_id"], r[c]) for r in FE.read_table(spark, path, "artifact_id", name).collect())
    assert read("pages", "title") == [(1, "a2"), (2, "b")] and read("chunks", "text") == [(1, "w"), (2, "z")]
    FE.publish_chunks(page((2, "b2")), {"chunks": chunk((2, "q")).limit(0)}, path)
    assert read("chunks", "text") == [(1, "w")]


def test_corpus(spark, tmp_path):
    write = lambda name, docs: (tmp_path / name).write_text(json.dumps(docs))
    write("a.json", [{"title": "A", "text": "x", "idx": 7}, {"title": "B", "text": "y", "idx": 8}])
    assert [r["doc_id"] for r in D.load_corpus(spark, str(tmp_path / "a.json"), "idx").collect()] == ["7", "8"]
    assert [r["doc_id"] for r in D.load_corpus(spark, str(tmp_path / "a.json")).collect()] == ["0", "1"]
    for name, docs in {"b.json": [{"title": "A"}], "c.json": [{"title": "A", "text": "x", "id": 1}] * 2}.items():
        write(name, docs)
        with pytest.raises(ValueError):
            D.load_corpus(spark, str(tmp_path / name), "id")


def test_space_export(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a|b.md").write_text("# Head\ntext")
    (tmp_path / "plain.md").write_text("no heading")
    (tmp_path / "blank.md").write_text(" \n")
    got = sorted((r["doc_id"], r["title"]) for r in D.read_space_export(spark, str(tmp_path)).collect())
    assert got == [("plain", "plain"), ("sub_a_b", "Head")]


def test_musique(rows):
    corpus = rows("doc_id string, title string, text string", ("d1", "T", "one"), ("d2", "T", "two"))
    para = "array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
    step = "array<struct<id:int,question:string,answer:string,paragraph_support_idx:int>>"
    schema = f"id string, question string, answer string, answer_aliases array<string>, paragraphs {para}, question_decomposition {step}"
    row = ("2hop__1_2", "q", "A", ["B", "A", ""], [(0, "T", "two", True), (1, "X", "no", False)], [(1, "s", "a", 0), (2, "t", "b", 1)])
    got = D.normalize_musique(rows(schema, row), corpus).first()
    assert got["sample_id"] == "musique:2hop__1_2" and got["answers"] == ["A", "B"] and got["gold_doc_ids"] == ["d2"] and got["hop_prefix"] == "2hop"
    assert [(s["support_doc_id"], s["support_title"]) for s in got["steps"]] == [("d2", "T"), (None, "X")]
    with pytest.raises(ValueError):
        D.normalize_musique(rows(schema, (*row[:4], [(0, "T", "zzz", True)], None)), corpus)


def test_qa_titles_must_be_unique(rows):
    schema = "id string, question string, answer string, supporting_facts array<array<string>>"
    corpus = rows("doc_id string, title string", ("d1", "A"), ("d2", "B"), ("d3", "B"))
    ok = D.normalize_qa(rows(schema, ("1", "q", "a", [["A", "0"], ["A", "1"]])), corpus, "set").first()
    assert ok["gold_doc_ids"] == ["d1"]
    with pytest.raises(ValueError):
        D.normalize_qa(rows(schema, ("1", "q", "a", [["B", "0"]])), corpus, "set")


def test_samples_are_repeatable_and_quotas_add_up(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 700, "hot").when(F.col("id") < 970, "b").otherwise("c").alias("s"))
    got = D.sample_stratified(df, "k", "s", 33, 5)
    assert {r["s"]: r["count"] for r in got.groupBy("s").count().collect()} == {"hot": 23, "b": 9, "c": 1}
    assert sorted(r["k"] for r in got.collect()) == sorted(r["k"] for r in D.sample_stratified(df.repartition(7), "k", "s", 33, 5).collect())


def test_merge_flags_artifacts_over_budget_and_keeps_their_text(rows):
    df = rows("artifact_id int, source_id int, title string, text string", (1, 2, "two", "b"), (1, 1, "one", "a"), (1, 3, "x", "a"), *[(2, i, "t", f"p{i}") for i in range(9)])
    got = {r["artifact_id"]: (r["title"], r["text"], r["over_budget"]) for r in V.merge_contributions(df, budget=5).collect()}
    assert got == {1: ("one", "a\n\nb", False), 2: ("t", "\n\n".join(f"p{i}" for i in range(9)), True)}
    assert V.merged_pieces(df).filter("artifact_id = 2").count() == 9
