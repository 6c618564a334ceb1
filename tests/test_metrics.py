from math import log2

import pytest
from pyspark.sql import functions as F

from folioscope.operators import attribute as AT
from folioscope.operators import diagnostics as D
from folioscope.operators import evaluate as E


def _retrieved(rows, *pages):
    return rows("sample_id int, position int, page_id string", *[(1, i, p) for i, p in enumerate(pages)])


def _map(rows):
    return rows("page_id string, doc_id string", ("p1", "d1"), ("p1b", "d1"), ("p2", "d2"), ("p3", "d3"))


def _values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_unmapped_pages_keep_their_rank(rows):
    ranked = E.ranked_docs(_retrieved(rows, "p1", "x", "p1b", "p2"), _map(rows))
    assert [(r["doc_id"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [("d1", 1), ("__unmapped__:x", 2), ("d2", 3)]


def test_retrieval_metrics(rows):
    gold = rows("sample_id int, doc_id string", (1, "d2"), (1, "d3"))
    got = _values(E.retrieval_metrics(E.ranked_docs(_retrieved(rows, "p1", "x", "p2"), _map(rows)), gold, (2, 5)))
    assert got["mrr"] == pytest.approx(1 / 3)
    assert got["recall@5"] == 0.5 and got["recall@2"] == 0.0
    assert got["precision@5"] == pytest.approx(1 / 3)  # three documents came back
    assert got["retrieval_f1"] == pytest.approx(2 * (1 / 3) * 0.5 / (1 / 3 + 0.5))
    assert got["ndcg@5"] == pytest.approx((1 / log2(4)) / (1 / log2(2) + 1 / log2(3)))
    assert got["hit@5"] == 1.0 and got["full_coverage@5"] == 0.0


def test_empty_result_scores_zero_and_no_gold_gives_no_row(rows):
    gold = rows("sample_id int, doc_id string", (2, "d1"))
    got = E.retrieval_metrics(E.ranked_docs(_retrieved(rows, "p1"), _map(rows)), gold, (2,)).collect()
    assert {r["sample_id"] for r in got} == {2} and all(r["value"] == 0.0 for r in got)


@pytest.mark.parametrize(
    "prediction,references,em,f1",
    [
        ("The Cat!", ["cat"], 1.0, 1.0), ("red blue", ["blue green", "x"], 0.0, 0.5), ("a", ["the"], 1.0, 1.0), ("", ["x"], 0.0, 0.0), ("go go go", ["go go stop"], 0.0, 2 / 3),
    ],
)
def test_answers(rows, prediction, references, em, f1):
    got = _values(E.answer_metrics(rows("sample_id int, prediction string", (1, prediction)), rows("sample_id int, reference string", *[(1, r) for r in references])))
    assert got["em"] == em and got["f1"] == pytest.approx(f1)


def test_graph_exclusive_share(rows):
    gold = rows("sample_id int, doc_id string", (1, "d1"), (1, "d2"))
    snippets = rows("sample_id int, position int, chunk_id string, origin string, page_id string", (1, 0, "c1", "graph", "p1"), (1, 1, "c1", "direct", "p1"), (1, 2, "c2", "graph", "p2"), (1, 3, "c3", "graph", "p3"))
    got = _values(E.graph_metrics(snippets, gold, _map(rows)))
    assert got == {"graph_neighbor_gold_snippets": 2.0, "graph_neighbor_precision": pytest.approx(2 / 3), "graph_exclusive_gold_share": 0.5}


def test_missing_metrics_count_as_zero_in_a_scope(rows):
    metrics = rows("sample_id int, metric string, value double", (1, "f1", 1.0))
    samples = rows("sample_id int, answer_mode string", (1, "knowledge"), (2, "general"), (3, None))
    got = {r["scope"]: r["mean"] for r in E.metric_summary(metrics, samples).collect()}
    assert got == {"overall": pytest.approx(1 / 3), "knowledge_only": 1.0}


def test_judge_scores(rows):
    data = [
        ("faithfulness", '{"claims":[{"verdict":"supported"},{"verdict":"unclear"}]}', 0.5), ("faithfulness", '{"claims":[]}', None),
        ("context_relevancy", '{"passages":[{"useful":true}]}', 1.0), ("answer_correctness", '{"verdict":"partial"}', 0.5), ("answer_correctness", '{"verdict":"?"}', None),
        ("answer_relevancy", '{"similarity":-0.5}', 0.0),
    ]
    df = rows("i int, kind string, verdict string", *[(i, k, v) for i, (k, v, _) in enumerate(data)])
    got = [r["s"] for r in df.orderBy("i").select(E.judge_score(F.col("kind"), F.col("verdict")).alias("s")).collect()]
    assert got == [want for _, _, want in data]


def test_a_response_to_another_question_is_an_error(rows):
    samples = rows("sample_id int, question string", (1, "q"))
    responses = rows("sample_id int, question string, answer string, http_status int", (1, "other", "a", 200))
    empty = rows("sample_id int, position int, page_id string")
    with pytest.raises(Exception, match="question differs"):
        E.evaluate(samples, responses, rows("sample_id int, reference string", (1, "a")), rows("sample_id int, doc_id string", (1, "d1")), empty, empty.drop("position"), _map(rows)).collect()


BASE = dict(answer_mode="knowledge", answer_correct=False, generation_empty=False, compiled_missing=0, hit=1.0, recall=1.0, coverage=1.0,
            chain_status=None, grounded=None, terms_lost=False, graph_exclusive=0.0, gold_count=2, uncited_gold=0.0)


@pytest.mark.parametrize(
    "change,cause",
    [
        ({}, "answer_incorrect"), ({"answer_correct": True}, "answer_correct"), ({"answer_correct": True, "answer_mode": "general"}, "generation_fallback"),
        ({"generation_empty": True}, "generation_empty"), ({"compiled_missing": 1}, "compiled_answer_missing"), ({"answer_mode": "general", "hit": 0.0}, "generation_fallback"),
        ({"answer_mode": "general", "recall": 0.5}, "retrieval_evidence_incomplete"), ({"answer_mode": "general", "grounded": False}, "retrieval_evidence_incomplete"),
        ({"answer_mode": "general"}, "generation_ignored_retrieval"), ({"answer_mode": "general", "recall": None}, "unknown"), ({"chain_status": "partial"}, "retrieval_evidence_incomplete"),
        ({"uncited_gold": 2.0}, "citation_dropped"), ({"hit": 0.0, "terms_lost": True}, "compiled_away"), ({"hit": 0.0}, "retrieval_miss"), ({"coverage": 0.5}, "graph_edge_missing"),
        ({"coverage": 0.5, "graph_exclusive": 0.5}, "answer_incorrect"), ({"answer_mode": None}, "unknown"),
    ],
)
def test_root_cause(rows, change, cause):
    values = {**BASE, **change}
    schema = ("sample_id int, answer_mode string, answer_correct boolean, generation_empty boolean, compiled_missing int, hit double, recall double, coverage double, "
              "chain_status string, grounded boolean, terms_lost boolean, graph_exclusive double, gold_count int, uncited_gold double")
    assert AT.root_cause(rows(schema, (1, *values.values()))).first()["root_cause"] == cause


def test_evidence_chain(rows):
    steps = rows("sample_id int, position int, answer string, support_title string, support_text string", (1, 1, "Paris", "France", "Paris is the capital of France"), (1, 2, "1889", "Tower", "Built in 1889 by Eiffel"), (2, 1, "x", "y", "z"))
    evidence = rows("sample_id int, position int, title string, text string", (1, 0, "France", "Paris is the capital of France."), (1, 1, "", "Eiffel built"))
    judged = AT.evidence_steps(steps, evidence)
    got = {(r["sample_id"], r["position"]): r["status"] for r in judged.collect()}
    assert got == {(1, 1): "supported", (1, 2): "partial", (2, 1): "missing"}
    chain = {r["sample_id"]: r["status"] for r in AT.evidence_chain(judged, rows("sample_id int, answer_mode string", (1, "general"))).collect()}
    assert chain == {1: "partial", 2: "incomplete"}


@pytest.mark.parametrize(
    "code,category",
    [("PAGE_TIMEOUT", "budget_timeout"), ("llm_error", "provider"), ("rate_limited", "provider"), ("merge_conflict", "publication"), ("embedding_failed", "infrastructure"), ("odd", "other"), ("", None), (None, None)],
)
def test_error_classes(rows, code, category):
    assert rows("c string", (code,)).select(D.classify_error(F.col("c")).alias("v")).first()["v"] == category


def test_p95_is_nearest_rank(rows):
    df = rows("k string, v int", *[("a", i) for i in range(1, 21)], ("b", 7), ("b", None))
    assert {r["k"]: r["p95"] for r in D.p95(df, "k", "v").collect()} == {"a": 19, "b": 7}


def test_health_scores(rows):
    pages = rows("page_id int, space_id int, space_name string, has_text boolean, deleted_at string", (1, 1, "s", True, None), (2, 1, "s", True, None), (3, 1, "s", False, None), (4, 1, "s", True, "x"), (5, 1, "s", True, None))
    sources = rows("page_id int, stale_at string, deleted_at string", (1, "old", None), (1, None, None), (2, "old", "x"), (5, "old", None))
    chunks = rows("page_id int, stale_at string, has_embedding boolean", (1, None, False), (1, "x", False), (5, None, True))
    policies = rows("page_id int, stale_at string", (1, "x"), (5, None))
    got = {r["page_id"]: r["score"] for r in D.page_health(pages, sources, chunks, policies).collect()}
    assert got == {1: 30, 2: 30, 3: 100, 5: 70}


def test_metrics_of_a_sample_are_joined_without_a_sort(rows, spark):
    from folioscope.operators import evaluate

    metrics = rows("sample_id int, metric string, value double", (1, "mrr", 1.0), (2, "mrr", 0.5), (2, "em", 0.0))
    samples = rows("sample_id int, gold_count int, reference_count int, answer_mode string", (1, 0, 1, "general"), (2, 1, 0, "knowledge"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = evaluate.available_metrics(metrics, samples)
        means = evaluate.metric_summary(metrics, samples)
        assert [tuple(r) for r in found.collect()] == [(2, "mrr", 0.5)]
        assert {(r["scope"], r["metric"], r["mean"]) for r in means.collect()} == {("overall", "mrr", 0.75), ("overall", "em", 0.0), ("knowledge_only", "mrr", 0.5), ("knowledge_only", "em", 0.0)}
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
