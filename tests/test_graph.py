import random
from math import log

import pytest
from pyspark.sql import functions as F

from folioscope.operators import graph as G


def _greedy(pairs, cap):
    used, kept = {}, []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if used.get(a, 0) < cap and used.get(b, 0) < cap:
            kept.append((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    return sorted(kept)


@pytest.mark.parametrize("seed,cap", [(1, 2), (2, 6)])
def test_greedy_rounds_equal_the_sequential_pass(spark, seed, cap):
    rng = random.Random(seed)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(150)) if a != b})
    scored = [(a, b, float(rng.randrange(6))) for a, b in pairs]
    got = G.greedy_edges(spark.createDataFrame(scored, "a int, b int, score double"), cap)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == _greedy(scored, cap)


def test_pairs_within_cover_each_pair_once_over_blocks(spark):
    members = spark.range(300).select(F.lit("hot").alias("g"), F.col("id").alias("n"))
    pairs = G._pairs_within(members, "g", "n")
    assert pairs.count() == pairs.distinct().count() == 300 * 299 // 2


def test_semantic_candidates(rows):
    nodes = rows("page_id int, page_type string", (1, "entity"), (2, "concept"), (3, None), (4, "entity"))
    sources = rows("page_id int, source_id int", (1, 10), (2, 10), (1, 11), (2, 11), (9, 10))
    edges = rows("from_id int, to_id int", (1, 3), (4, 3))
    got = {(r["a"], r["b"]): (r["score"], r["label"]) for r in G.semantic_candidates(nodes, sources, edges).collect()}
    assert got == {(1, 2): (9.2, "共享来源"), (1, 4): (round(1.5 / log(2) + 0.8, 3), "共同邻居")}


def test_a_view_is_as_large_as_asked(spark):
    pages = spark.range(12_000).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("stale_at"), F.col("id").alias("updated_at"))
    owned = pages.select("page_id", F.lit(1).alias("source_id"))
    readable = spark.range(1).select(F.lit(1).alias("source_id"))
    assert G.graph_nodes(pages, owned, readable, 11_000).count() == 11_000


def test_communities_of_two_cliques(spark):
    clique = lambda ids: [(a, b, 1.0) for a in ids for b in ids if a < b]
    edges = spark.createDataFrame(clique(range(6)) + clique(range(10, 15)) + [(5, 10, 1.0)], "a int, b int, weight double")
    nodes = spark.createDataFrame([(i,) for i in [*range(6), *range(10, 15), 99]], "page_id int")
    got = G.communities(nodes, edges)
    groups = {}
    for r in got.collect():
        groups.setdefault(r["community"], []).append(r["node"])
    assert {k: sorted(v) for k, v in groups.items()} == {"community-1": [0, 1, 2, 3, 4, 5], "community-2": [10, 11, 12, 13, 14], "community-3": [99]}
    assert G.modularity(got.select("node", "community"), edges) > 0.4


def _modularity(edges, of):
    k, m = {}, 0.0
    for a, b, w in edges:
        k[a], k[b], m = k.get(a, 0) + w, k.get(b, 0) + w, m + w
    inner = sum(w for a, b, w in edges if of[a] == of[b])
    mass = {}
    for n, v in k.items():
        mass[of[n]] = mass.get(of[n], 0) + v
    return inner / m - sum(v * v for v in mass.values()) / (4 * m * m)


def test_settled_communities_have_no_open_move_and_hang_together(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted((rng.randrange(16), rng.randrange(16)))) for _ in range(12)} | {(a, b) for g in (0, 5, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)}
    edges = [(a, b, float(rng.randint(1, 3))) for a, b in sorted(pairs) if a != b]
    df = spark.createDataFrame(edges, "a int, b int, weight double")
    start = spark.range(16).select(F.col("id").cast("int").alias("node"), (F.col("id") % 8).alias("community"))  # pairs that are no community
    assert G.open_moves(start, df).count() > 0
    found = G.settle(start, df)
    of = {r["node"]: r["community"] for r in found.collect()}
    best = _modularity(edges, of)
    assert best == pytest.approx(G.modularity(found, df)) and best > 0.2
    for n in of:
        for target in {*of.values(), "new"}:
            assert _modularity(edges, {**of, n: target}) <= best + 1e-9, (n, target)
    for c in set(of.values()):
        members, seen = {n for n in of if of[n] == c}, set()
        todo = [min(members)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b if a == x else a for a, b, _ in edges if x in (a, b) and {a, b} <= members]
        assert seen == members
    assert G.open_moves(found, df).count() == 0


def test_adamic_adar_and_insights(rows):
    edges = rows("from_id int, to_id int", (1, 2), (3, 2), (4, 2), (1, 5), (3, 5))
    got = G.adamic_adar(rows("a int, b int", (1, 3), (1, 2)), edges).collect()
    assert [(r["a"], r["b"], round(r["score"], 6)) for r in got] == [(1, 3, round(1 / log(3) + 1 / log(2), 6))]
    nodes = rows("page_id int", (1,), (2,), (7,))
    flags = {r["node"]: (r["isolated"], r["bridge"]) for r in G.graph_insights(nodes, edges, rows("node int, community string", (1, "x"), (2, "y"), (3, "x"), (4, "y"), (5, "x"))).collect()}
    assert flags == {1: (False, True), 2: (False, True), 7: (True, False)}


def test_community_rounds_broadcast_nothing(rows, monkeypatch):
    from folioscope.operators import graph

    plans, write = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    nodes = rows("page_id int", *[(i,) for i in range(4)])
    edges = rows("a int, b int, weight double", (0, 1, 1.0), (2, 3, 1.0))
    assert graph.communities(nodes, edges, rounds=2, levels=1).count() == 4
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
