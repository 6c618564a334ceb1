import pytest
from pyspark.sql import functions as F

from folioscope.operators import context as CX
from folioscope.operators import retrieve as R


def _list(rows, *data):
    return rows("query_id int, chunk_id string, signal string, score double, position int, weight double", *data)


def test_rrf_is_independent_of_list_order_and_breaks_ties_by_signal(rows):
    lists = _list(
        rows, (1, "a", "lexical", 1.0, 0, 1.0), (1, "b", "semantic", 0.2, 0, 1.0), (1, "c", "exact-title", 1.0, 0, 1.0), (1, "a", "semantic", 0.3, 1, 1.0)
    )
    got = [(r["chunk_id"], round(r["fused"], 6)) for r in R.rrf_fuse(lists, 5).orderBy("rank").collect()]
    assert got == [("a", round(1 / 61 + 1 / 62, 6)), ("c", round(1 / 61, 6)), ("b", round(1 / 61, 6))]
    again = [(r["chunk_id"], round(r["fused"], 6)) for r in R.rrf_fuse(lists.orderBy(F.desc("chunk_id")), 5).orderBy("rank").collect()]
    assert got == again


def test_gate(rows):
    lists = _list(
        rows, (1, "far", "semantic", 0.46, 0, 1.0), (1, "near", "semantic", 0.45, 1, 1.0), (1, "zero", "lexical", 0.0, 0, 1.0), (1, "word", "lexical", 1.2, 1, 1.0), (1, "title", "exact-title", 0.5, 0, 1.0)
    )
    kept = R.rrf_fuse(lists, 10).filter(R.relevant())
    assert sorted(r["chunk_id"] for r in kept.collect()) == ["near", "title", "word"]


def test_common_terms_never_qualify(rows, spark):
    texts = [(i, "common filler") for i in range(40)] + [(100, "common rareword"), (101, "rareword extra")]
    chunks = spark.createDataFrame(texts, "chunk_id int, text string")
    queries = rows("query_id int, text string", (1, "common"), (2, "common rareword"))
    got = [(r["query_id"], r["chunk_id"], r["coverage"]) for r in R.lexical_topk(queries, chunks, 10).orderBy("query_id", "rank").collect()]
    assert got == [(2, 100, 1), (2, 101, 1)]


def test_title_prefixes(rows):
    titles = rows("chunk_id int, title string", (1, "Release  Notes"), (2, "Release Notes 2024"), (3, "Notes"), (4, "R"))
    queries = rows("query_id int, text string", (1, " release notes"), (2, "r"), (3, "zzz"))
    got = sorted((r["query_id"], r["chunk_id"], r["score"]) for r in R.title_topk(queries, titles, 5).collect())
    assert got == [(1, 1, 1.0), (1, 2, 0.5), (2, 1, 0.5), (2, 2, 0.5), (2, 4, 1.0)]


def test_trigram_topk_equals_brute_force(spark):
    from folioscope.functions.text import trigram_similarity

    names = ["small ring", "smaller rings", "red widget", "blue widget", "ring", "string", "widget red", "mall"]
    pages = spark.createDataFrame([(i, n) for i, n in enumerate(names * 3)], "page_id int, title string")
    signals = spark.createDataFrame([("s1", "small rings"), ("s2", "red widgets"), ("s3", "strung")], "signal_id string, value string")
    got = sorted((r["signal_id"], r["rank"], r["page_id"]) for r in R.trigram_topk(signals, pages, 6).collect())
    every = signals.crossJoin(pages).withColumn("s", trigram_similarity(F.col("value"), F.col("title"))).filter("s >= 0.3").collect()
    want = []
    for key in ("s1", "s2", "s3"):
        best = sorted((-r["s"], r["page_id"]) for r in every if r["signal_id"] == key)[:6]
        want += [(key, n, p) for n, (_, p) in enumerate(best, 1)]
    assert got == sorted(want)


def _graph(rows):
    seeds = rows("query_id int, page_id string, weight double, top_weight double", (1, "s", 1.0, 1.0))
    pages = rows("page_id string, space_id string, stale_at string", ("s", "x", None), ("n1", "x", None), ("n2", "x", None), ("far", "y", None), ("old", "x", "t"))
    links = rows(
        "link_id string, from_id string, to_id string, space_id string, link_type string, is_dangling boolean, stale_at string",
        ("l1", "s", "n1", "x", "mention", False, None), ("l2", "s", "far", "x", "mention", False, None), ("l3", "s", "old", "x", "mention", False, None),
        ("l4", "n2", "s", "x", "mention", False, None), ("l5", "s", "n2", "x", "catalog_entry", False, None),
    )
    link_sources = rows("link_id string, source_id string", ("l1", "open"), ("l2", "open"), ("l3", "open"), ("l4", "secret"), ("l5", "open"))
    page_sources = rows("page_id string, source_id string", ("s", "open"), ("n1", "open"), ("s", "secret"), ("n2", "secret"), ("far", "open"))
    return seeds, links, link_sources, pages, page_sources, rows("source_id string", ("open",))


def test_edges_fail_closed(rows):
    got = sorted((r["edge_id"], r["type"]) for r in R.expand_edges(*_graph(rows), 20).collect())
    assert got == [("l1", "link"), ("shared:n1:s", "shared-source")]


def test_neighbors_leave_seeds_out(rows):
    parts = _graph(rows)
    got = [(r["page_id"], r["anchor"]) for r in R.neighbor_scores(R.expand_edges(*parts, 20), parts[0], 8).collect()]
    assert got == [("n1", 0.7)]


def test_reserved_tail(rows):
    direct = rows("query_id int, chunk_id string, rank int", *[(1, f"d{i}", i) for i in range(1, 10)], (2, "d1", 1))
    graph = rows("query_id int, chunk_id string, rank int", (1, "d1", 1), (1, "g1", 2), (1, "g2", 3), (1, "g3", 4), (2, "g1", 1), (2, "g2", 2), (2, "g3", 3))
    got = {}
    for r in R.merge_reserved(direct, graph, 8).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {1: ["d1", "d2", "d3", "d4", "d5", "d6", "g1", "g2"], 2: ["d1", "g1", "g2", "g3"]}


def test_pack_context(rows):
    items = rows("query_id int, rank int, item_id string, title string, text string", (1, 1, "a", "T", "x" * 10), (1, 2, "b", "T", "y" * 50), (1, 3, "c", "T", "z"))
    got = [(r["item_id"], r["disposition"], r["included"]) for r in CX.pack_context(items, 40).orderBy("position").collect()]
    assert got == [("a", "included", 10), ("b", "clipped", 20), ("c", "omitted", 0)]
    context = CX.context_text(items, CX.pack_context(items, 40)).first()["context"]
    assert context == "# T\n" + "x" * 10 + "\n\n# T\n" + "y" * 20 and len(context) == 40


def test_answer_modes(rows):
    raw = rows("a string", ("[[answer:general]] <general_reason>no\n hit</general_reason> hi",), ("plain",), (" [[knowledge:no_match]]x",))
    mode, content, reason = CX.parse_answer(F.col("a"))
    got = [tuple(r) for r in raw.select(mode, content, reason).collect()]
    assert got == [("general", "hi", "no hit"), ("knowledge", "plain", None), ("no_match", "x", None)]


def test_citations(one):
    text = "One [[cite:a]]  two [[cite:b]] \nthree [[cite:a]]"
    assert one(CX.citation_ids, text) == ["a", "b"]
    assert one(CX.strip_citations, text) == "One two\nthree"


def test_windows_need_a_matching_hash(rows):
    from folioscope.functions.text import quote_hash

    refs = rows("query_id int, source_id int, start int, stop int, quote string", (1, 1, 0, 5, "hello"), (1, 1, 0, 5, "hello"), (1, 1, 0, 4, "jell"), (1, 1, 6, 99, "x"))
    refs = refs.withColumn("quote_hash", quote_hash(F.col("quote"))).drop("quote")
    got = CX.source_windows(refs, rows("source_id int, text string", (1, "hello world"))).collect()
    assert [(r["start"], r["text"]) for r in got] == [(0, "hello")]


@pytest.mark.parametrize("k", [4, 8])
def test_window_recall_equals_a_sequential_pass(rows, k):
    direct_rows = [(1, f"d{i}", i, i == 3) for i in range(1, 7)]
    fused_rows = [(1, c, i, o) for i, (c, o) in enumerate([("g1", "graph"), ("d2", "direct"), ("g2", "graph"), ("g3", "graph"), ("d1", "direct"), ("d3", "direct")], 1)]
    got = R.window_recall_select(
        rows("query_id int, chunk_id string, rank int, origin string", *fused_rows), rows("query_id int, chunk_id string, rank int, by_title boolean", *direct_rows), k
    ).orderBy("position")
    chosen, graph = ["d3"], 0
    for c, o in [(c, o) for _, c, _, o in fused_rows] + [(c, "direct") for _, c, _, _ in direct_rows]:
        if len(chosen) < k and c not in chosen and not (o == "graph" and graph >= k // 4):
            chosen.append(c)
            graph += o == "graph"
    assert [r["chunk_id"] for r in got.collect()] == chosen


def test_channels_are_fused_once_with_both_tags_and_quotas(rows):
    queries = rows("query_id int, text string", (1, "red fox"))
    vectors = rows("query_id int, query_vec array<double>", (1, [1.0, 0.0]))
    chunk = "chunk_id string, text string"
    title = "chunk_id string, title string"
    vector = "chunk_id string, chunk_vec array<double>"
    evidence = (
        rows(chunk, ("a", "a red fox"), ("b", "blue"), ("both", "the red fox ran")), rows(title, ("a", "Red  Fox"), ("b", "Blue")),
        rows(vector, ("a", [1.0, 0.1]), ("b", [0.9, 0.3]), ("both", [1.0, 0.0])),
    )
    memory = (rows(chunk, ("m", "grey"), ("both", "the red fox ran")), rows(title, ("m", "Other")), rows(vector, ("m", [0.0, 1.0]), ("both", [1.0, 0.0])))
    found = R.recall_channels(queries, vectors, {"evidence": evidence, "memory": memory}, 10, 10).orderBy("rank").collect()
    tags = {r["chunk_id"]: (r["channels"], r["signals"]) for r in found}
    assert len(found) == len(tags) == 4
    assert tags["both"] == (["evidence", "memory"], ["lexical", "semantic"]) and tags["a"] == (["evidence"], ["exact-title", "lexical", "semantic"])
    assert [r["chunk_id"] for r in found] == ["both", "a", "m", "b"]
    few = R.recall_channels(queries, vectors, {"evidence": evidence, "memory": memory}, 10, 3, {"evidence": 3})
    assert [r["chunk_id"] for r in few.orderBy("rank").collect()] == ["both", "a", "b"]
    assert R.recall_channels(queries.limit(0), vectors.limit(0), {"evidence": evidence}, 5, 5).count() == 0


def test_images_of_citations_do_not_go_through_the_driver(rows):
    from folioscope.operators import context

    citations = rows("query_id int, position int, page_id int, answer string, evidence string", (1, 1, 1, "about red maps", "see the red map"))
    images = rows("page_id int, attachment_id string, alt string, caption string, ordinal int", (1, "a", "red map", "a red map", 1), (2, "b", "sea", "sea", 1))
    out = context.citation_images(citations, images)
    assert [(r["query_id"], r["attachment_id"], r["kind"]) for r in out.collect()] == [(1, "a", 1)]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_lexical_pairs_stay_in_their_block_and_span(rows, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    monkeypatch.setattr(R, "CHUNK_SPAN", 5)
    monkeypatch.setattr(R, "CELLS", 8)
    words = ["red fox", "red fox ran", "fox", "red red", "a1 b2 c3 d4", "a1 b2 c3", "a1 b2 c3 zz zz", "日本語", "日本", ""]
    chunks = rows("chunk_id long, text string", *[(i, w) for i, w in enumerate(words * 2)], (20, None))
    queries = rows("query_id long, text string", *enumerate(["red fox", "a1 b2 c3 d4", "日本語", "none of these", "", "red", "zz", "fox d4"]), (8, None))
    found = R.lexical_topk(queries, chunks, 3)
    held = [(i, w.split() if w.isascii() else [], [w[j : j + 2] for j in range(len(w) - 1)] if not w.isascii() else []) for i, w in enumerate(words * 2)]
    want = []
    for q, asked in enumerate([["red", "fox"], ["a1", "b2", "c3", "d4"], ["日本", "本語"], ["none", "of", "these"], [], ["red"], ["zz"], ["fox", "d4"]]):
        hits = []
        for i, latin, han in held:
            latin = [w for w in latin if len(w) > 1]
            covered = len(set(asked) & set(latin + han))
            r = sum(w in asked for w in latin) / max(len(latin), 1)
            if asked and covered >= (len(asked) if len(asked) < 3 else len(asked) * 3 // 4):
                hits.append((-covered - r / (r + 1), i, covered))
        want += [(q, i, c, -s, n) for n, (s, i, c) in enumerate(sorted(hits)[:3], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # no table of pairs is made: the only rows with both ids are the best of a span
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Aggregate [" in line and "query_id" in line and "chunk_id" in line]
