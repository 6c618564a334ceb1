"""Evidence of metrics: operands give the values, and the rows behind them are the right ones."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import evaluate as E
from folioscope.operators import evidence as EV


@pytest.fixture
def run(rows):
    retrieved = rows("sample_id int, position int, page_id string", (1, 3, "p3"), (1, 1, "p1"), (1, 2, "lost"), (1, 4, "p1b"), (1, 5, None), (2, 1, "p2"), (3, 1, "p1"))
    pages = rows("page_id string, doc_id string", ("p1", "d1"), ("p1b", "d1"), ("p2", "d2"), ("p3", "d3"), ("p4", "d4"))
    gold = rows("sample_id int, doc_id string", (1, "d3"), (1, "d4"), (2, "d9"), (4, "d1"))
    return retrieved, pages, gold


def test_documents_keep_rank_of_unmapped_pages_and_first_page_of_a_document(run):
    got = {r["sample_id"]: [(d["rank"], d["page_id"], d["doc_id"], d["is_gold"]) for d in r["documents"]] for r in EV.document_rows(*run).collect()}
    assert got == {1: [(1, "p1", "d1", False), (2, "lost", None, False), (3, "p3", "d3", True)], 2: [(1, "p2", "d2", False)], 3: [(1, "p1", "d1", False)]}


def test_retrieval_values_equal_the_metrics(run):
    retrieved, pages, gold = run
    got = EV.retrieval_evidence(retrieved, pages, gold, (1, 2, 5))
    name = F.concat("metric", F.coalesce(F.concat(F.lit("@"), "k"), F.lit("")))
    mine = {(r["sample_id"], r["m"]): r["value"] for r in got.withColumn("m", name).collect()}
    plain = {(r["sample_id"], r["metric"]): r["value"] for r in E.retrieval_metrics(E.ranked_docs(retrieved, pages), gold, (1, 2, 5)).collect()}
    assert set(mine) == set(plain) and all(mine[key] == pytest.approx(plain[key]) for key in plain)
    cell = next(r for r in got.collect() if (r["sample_id"], r["metric"], r["k"]) == (1, "recall", 5))
    assert (cell["numerator"], cell["denominator"], cell["gold_doc_ids"], len(cell["documents"])) == (1, 2, ["d3", "d4"], 3)


def test_tokens_are_aligned_occurrence_by_occurrence(rows):
    pred = rows("sample_id int, prediction string", (1, "the red fox and red dog red"), (2, None), (3, "x"))
    refs = rows("sample_id int, reference string", (1, "Red, red! dog"), (1, "cat"), (2, "a"), (2, "b"), (3, "x"))
    got = {(r["sample_id"], r["reference"]): r for r in EV.answer_evidence(pred, refs).collect()}
    first = got[1, "Red, red! dog"]
    assert [tuple(t) for t in first["shared_tokens"]] == [(0, 0, "red"), (3, 1, "red"), (4, 2, "dog")]
    assert (first["answer_tokens"], first["reference_tokens"], first["precision"], first["recall"], first["f1"]) == (6, 3, 0.5, 1.0, pytest.approx(2 / 3))
    assert got[1, "cat"]["shared_tokens"] == [] and got[1, "cat"]["f1"] == 0
    assert got[2, "a"]["f1"] == 1.0 and got[2, "b"]["f1"] == 0.0 and got[3, "x"]["exact_match"]
    best = {(r["sample_id"], r["metric"]): r["value"] for r in E.answer_metrics(pred, refs).collect()}
    for sample in (1, 2, 3):
        assert best[sample, "f1"] == pytest.approx(max(r["f1"] for (s, _), r in got.items() if s == sample))


def test_citations_name_what_was_left_out(rows, run):
    retrieved, pages, gold = run
    cited = rows("sample_id int, position int, page_id string", (1, 1, "p1b"), (1, 2, "lost"), (5, 1, "p4"))
    texts = rows("sample_id int, page_id string, excerpt string", (1, "p1b", "what it says"), (1, "p1b", ""), (1, None, "no page"))
    got = {(r["sample_id"], r["metric"]): r for r in EV.citation_evidence(cited, retrieved, gold, pages, texts).collect()}
    plain = E.citation_metrics(cited, retrieved.select("sample_id", "page_id"), gold, pages)
    for r in plain.collect():
        assert got[r["sample_id"], r["metric"]]["value"] == pytest.approx(r["value"]), r
    assert [d["doc_id"] for d in got[1, "uncited_count"]["difference"]] == ["d3"] and got[1, "citation_recall"]["difference"] is None
    assert [tuple(e) for e in got[1, "uncited_count"]["excerpts"]] == [("p1b", "what it says")]
    assert {s for s, _ in got} == {1, 2, 3, 4, 5}
    assert EV.citation_evidence(cited.limit(0), retrieved.limit(0), gold.limit(0), pages).count() == 0


def test_graph_snippets_and_exclusive_documents(rows, run):
    _, pages, gold = run
    snippets = rows("sample_id int, position int, chunk_id string, origin string, page_id string", (1, 1, "c1", "graph", "p3"), (1, 1, "c1", "graph", "p4"), (1, 2, "c2", "direct", "p4"), (1, 3, "c1", "direct", "p4"), (1, 4, "c3", None, "lost"), (2, 1, "c1", "graph", "p1"))
    got = {(r["sample_id"], r["metric"]): r for r in EV.graph_evidence(snippets, gold, pages).collect()}
    for r in E.graph_metrics(snippets, gold, pages).collect():
        assert got[r["sample_id"], r["metric"]]["value"] == pytest.approx(r["value"]), r
    one = got[1, "graph_exclusive_gold_share"]
    assert one["exclusive_gold_doc_ids"] == ["d3"] and [s["gold_doc_ids"] for s in one["snippets"]] == [["d3", "d4"], ["d4"], ["d4"], []]
    assert got[4, "graph_neighbor_precision"]["snippets"] == []


def test_judged_operands(rows):
    verdicts = rows("kind string, verdict string", ("faithfulness", '{"claims": [{"verdict": "supported"}, {"verdict": "no"}]}'), ("faithfulness", "{}"), ("context_relevancy", '{"passages": []}'), ("answer_relevancy", '{"similarity": 1.5}'), ("answer_correctness", '{"verdict": "partial"}'), ("answer_correctness", "broken"))
    got = EV.judge_evidence(verdicts).withColumn("score", E.judge_score(F.col("kind"), F.col("verdict"))).collect()
    assert [(r["numerator"], r["denominator"], r["value"]) for r in got] == [(1, 2, 0.5), (None, None, None), (0, 0, None), (1.5, 1, 1.0), (0.5, 1, 0.5), (None, 1, None)]
    assert [r["value"] for r in got] == [r["score"] for r in got] and got[4]["grade"] == "partial"


def test_a_list_is_shown_once_for_all_metrics_that_look_at_it(spark, rows):
    from pyspark.sql import functions as F

    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def length(documents):
        calls.add(1)
        return len(documents)

    retrieved = rows("sample_id int, position int, page_id string", (1, 1, "p1"), (1, 2, "p2"), (1, 3, "p3"))
    pages = rows("page_id string, doc_id string", ("p1", "a"), ("p2", "b"), ("p3", "c"))
    gold = rows("sample_id int, doc_id string", (1, "b"))
    got = EV.retrieval_evidence(retrieved, pages, gold, (1, 2), shown=length).collect()
    assert {(r["metric"], r["k"]): (r["value"], r["documents"]) for r in got if r["metric"] in ("mrr", "recall")} == {
        ("mrr", None): (0.5, 3), ("recall", 1): (0.0, 1), ("recall", 2): (1.0, 2)
    }
    assert len(got) == 12 and calls.value == 3
