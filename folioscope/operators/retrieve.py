"""Batch hybrid retrieval: recall lists, fusion, gates, graph expansion, selection.

Every stage takes many queries at once and is keyed by query_id. Lists have the columns query_id,
chunk_id, signal, score and a rank from 0.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import han_bigrams, latin_terms, normalize_title, query_terms, trigrams
from folioscope.functions.vectors import CELLS, dense_topk
from folioscope.operators.paging import top_per_key

# Fusion, gates and graph weights.
RRF_K = 60
LIST_WEIGHTS = {"semantic": 1.0, "lexical": 0.8, "exact-title": 1.2}
GRAPH_WEIGHTS = {"semantic": 0.85, "lexical": 0.15}
MAX_DISTANCE = 0.45
GRAPH_SLACK = 0.1
STRONG_SEED_DISTANCE = 0.4
SEED_LIMIT = 3
SEED_RATIO = 0.5
EDGE_WEIGHTS = {"link": 0.7, "shared-source": 0.2}
COMMON_RATIO = 0.05
COMMON_MIN = 20
MATCH_RATIO = 0.75
TRIGRAM_FLOOR = 0.3
CONTEXT_CHARS = 12_000
# Queries and chunks that meet in one task of the lexical recall, and characters of these chunks.
QUERY_BLOCK, CHUNK_SPAN, SPAN_CHARS = 1 << 17, 1 << 14, 1 << 25


# --- recall --------------------------------------------------------------------------------------------


def with_terms(rows: DataFrame, text: str = "text", name: str = "terms") -> DataFrame:
    """Distinct search terms of a text column. Callers with non-NFKC text normalise it first."""
    return rows.withColumn(name, query_terms(F.lower(text)))


def term_classes(query_rows: DataFrame, chunk_rows: DataFrame, total: DataFrame) -> DataFrame:
    """(query_id, term, df, common) for exploded terms; total is the one-value frame of the chunk count.

    A term is common when it is in more than 5% of the chunks and in more than 20 of them. df is one
    aggregation with partial counts before any join, so the rows of words go through no exchange.
    """
    df = chunk_rows.groupBy("term").agg(F.count("*").alias("df"))
    bound = F.greatest(F.lit(COMMON_MIN), F.ceil(total.scalar() * COMMON_RATIO))
    return query_rows.join(df, "term", "left").select(
        "query_id", "term", F.coalesce("df", F.lit(0)).alias("df"), (F.coalesce("df", F.lit(0)) > bound).alias("common")
    )


def minimum_match(n: Column) -> Column:
    return F.when(n <= 2, n).otherwise(F.floor(n * MATCH_RATIO)).cast("int")


def _best_covered(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The k best chunks of `held` for each query of `asked`, by how many of its rare terms they hold, then by the density of all its terms."""
    held = held.take(pc.sort_indices(held["chunk_id"]))  # so that places of chunks are in order of their ids
    flat = lambda rows, name: (rows[name].combine_chunks().flatten().to_numpy(), pc.list_value_length(rows[name]).to_numpy())
    words, sizes = flat(held, "held")
    latin, n = held["words"].to_numpy(), held.num_rows
    (rare, rares), (common, commons) = flat(asked, "rare"), flat(asked, "common")
    needed = asked["needed"].to_numpy()
    # places of the words that are asked for, and how often each stands in a chunk; a key is a term and a chunk
    terms = np.unique(np.concatenate([rare, common]))
    chunk = np.repeat(np.arange(n), sizes)
    at = np.searchsorted(terms, words)
    known = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == words)
    counts = known - np.repeat(np.cumsum(sizes) - sizes, sizes)[known] < latin[chunk[known]]
    keys, place = np.unique(at[known] * n + chunk[known], return_inverse=True)
    often, holder = np.bincount(place, counts, len(keys)), keys % n
    first = np.searchsorted(keys, np.arange(len(terms) + 1) * n)
    rare, common = np.searchsorted(terms, rare), np.searchsorted(terms, common)
    rare_ends, common_ends = (np.concatenate([[0], np.cumsum(x)]) for x in (rares, commons))

    def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of all ranges, one after the other."""
        return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())

    found = []
    step = max(1, CELLS // n)
    for start in range(0, asked.num_rows, step):
        stop = min(start + step, asked.num_rows)
        these = rare[rare_ends[start] : rare_ends[stop]]
        lengths = first[these + 1] - first[these]
        row = np.repeat(np.repeat(np.arange(stop - start), rares[start:stop]), lengths)
        coverage = np.bincount(row * n + holder[spread(first[these], lengths)], minlength=(stop - start) * n).reshape(-1, n)
        good = coverage >= needed[start:stop, None]
        # the density adds half a term at most, so a chunk behind the k-th in coverage alone cannot come before it
        many = np.flatnonzero(good.sum(axis=1) > k)
        if len(many):
            edge = np.partition(coverage[many], n - k, axis=1)[:, n - k]
            good[many] &= coverage[many] >= edge[:, None]
        q, c = np.nonzero(good)
        total = np.zeros(len(q))
        for own, ends in ((rare, rare_ends), (common, common_ends)):
            lengths = ends[q + start + 1] - ends[q + start]
            key = own[spread(ends[q + start], lengths)] * n + np.repeat(c, lengths)
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[place] == key if len(keys) else np.zeros(len(key), bool)
            total += np.bincount(np.repeat(np.arange(len(q)), lengths)[hit], often[place[hit]], len(q))
        r = total / np.maximum(latin[c], 1)
        score = coverage[q, c] + r / (r + 1)
        order = np.lexsort((c, -score, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[rank < k]
        found.append((q[order] + start, c[order], coverage[q[order], c[order]], score[order]))
    q, c, covered, score = (np.concatenate(x) for x in zip(*found))
    return pa.table({"query_id": asked["query_id"].take(pa.array(q)), "chunk_id": held["chunk_id"].take(pa.array(c)), "coverage": covered, "score": score})


def lexical_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """queries(query_id, text), chunks(chunk_id, text): best k chunks by rare-term coverage.

    A chunk must hold enough of the query's rare terms; all terms, common ones too, count in the tie-breaking density: the share of a
    chunk's words that are terms of the query. Queries are hashed into blocks and chunks into spans, and a block meets a span in one task, as
    for dense lists: pairs of a query and a chunk are counted there, and only the k best of a span go on. What is exchanged are the words of
    the chunks once for each block of queries and the terms of the queries once for each span. Terms meet as 64-bit hashes.
    """
    lower = F.lower("text")
    words = chunks.select("chunk_id", latin_terms(lower).alias("latin"), F.array_distinct(han_bigrams(lower)).alias("han"))
    terms = with_terms(queries).select("query_id", F.explode("terms").alias("term"))
    each = words.select(F.explode(F.array_distinct(F.concat("latin", "han"))).alias("term"))
    classes = term_classes(terms, each, chunks.agg(F.count("*").alias("total")))
    listed = lambda common: F.collect_list(F.when(F.col("common") == common, F.xxhash64("term")))
    asked = classes.groupBy("query_id").agg(listed(False).alias("rare"), listed(True).alias("common")).filter(F.size("rare") > 0)
    size = chunks.agg(F.count("*"), F.sum(F.length("text"))).first()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    spans = max(1, -(-size[0] // CHUNK_SPAN), -(-(size[1] or 0) // SPAN_CHARS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select("query_id", "rare", "common", minimum_match(F.size("rare")).alias("needed"), part("query_id", blocks).alias("block")).withColumn("span", every(spans))
    hashed = F.transform(F.concat("latin", "han"), lambda w: F.xxhash64(w))
    right = words.select("chunk_id", F.size("latin").alias("words"), hashed.alias("held"), part("chunk_id", spans).alias("span"))
    right = right.filter(F.size("held") > 0).withColumn("block", every(blocks))
    types = tuple(df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (chunks, "chunk_id")))
    schema = "query_id {}, chunk_id {}, coverage long, score double".format(*types)

    def best(these: pa.Table, those: pa.Table) -> pa.Table:
        if these.num_rows and those.num_rows:
            return _best_covered(these, those, k)
        empty = pa.array([], pa.int64()), pa.array([], pa.float64())
        return pa.table({"query_id": these["query_id"].slice(0, 0), "chunk_id": those["chunk_id"].slice(0, 0), "coverage": empty[0], "score": empty[1]})

    found = left.groupBy("block", "span").cogroup(right.groupBy("block", "span")).applyInArrow(best, schema)
    return top_per_key(found, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


PREFIX_STEPS = [1, 2, 4, 8, 16, 32, 64]


def title_topk(queries: DataFrame, titles: DataFrame, k: int) -> DataFrame:
    """queries(query_id, text), titles(chunk_id, title): equality scores 1, a title that starts with the query 0.5.

    Each title offers its prefixes of 1, 2, 4 .. 64 characters and each query asks with the longest of
    these lengths it fills, so the prefix test becomes an equi-join.
    """
    asked = queries.select("query_id", normalize_title(F.col("text")).alias("q")).filter("q != ''")
    step = F.lit(PREFIX_STEPS[0])
    for size in PREFIX_STEPS[1:]:
        step = F.when(F.length("q") >= size, size).otherwise(step)
    asked = asked.withColumn("step", step).withColumn("prefix", F.expr("substring(q, 1, step)"))
    offered = titles.select("chunk_id", normalize_title(F.col("title")).alias("t")).select(
        "chunk_id", "t", F.explode(F.array(*[F.lit(s) for s in PREFIX_STEPS])).alias("step")
    )
    offered = offered.filter(F.col("step") <= F.length("t")).withColumn("prefix", F.expr("substring(t, 1, step)"))
    hits = asked.join(offered, ["step", "prefix"]).filter(F.startswith("t", "q"))
    scored = hits.select("query_id", "chunk_id", F.when(F.col("t") == F.col("q"), 1.0).otherwise(0.5).alias("score"))
    return top_per_key(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def as_list(ranked: DataFrame, signal: str, score: str, weight: float | None = None) -> DataFrame:
    """A recall list in common form; `ranked` carries a rank from 1."""
    return ranked.select(
        "query_id", "chunk_id", F.lit(signal).alias("signal"), F.col(score).cast("double").alias("score"),
        (F.col("rank") - 1).alias("position"), F.lit(LIST_WEIGHTS[signal] if weight is None else weight).alias("weight"),
    )


def recall_lists(*lists: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), lists)


def rrf_fuse(lists: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; ties go to title, then semantic, then lexical hits, then the id."""
    has = lambda name: F.bool_or(F.col("signal") == name)
    of = lambda name: F.max(F.when(F.col("signal") == name, F.col("score")))
    fused = lists.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("weight") / (F.lit(rrf_k) + F.col("position") + 1)).alias("fused"),
        has("exact-title").alias("by_title"), has("semantic").alias("by_semantic"), has("lexical").alias("by_lexical"),
        of("semantic").alias("distance"), of("lexical").alias("lexical_score"),
    )
    fused = fused.withColumn("fused", F.round("fused", 12)).withColumn(
        "priority", F.when(F.col("by_title"), 3).when(F.col("by_semantic"), 2).when(F.col("by_lexical"), 1).otherwise(0)
    )
    order = [F.desc("fused"), F.desc("priority"), F.asc("chunk_id")]
    return top_per_key(fused, ["query_id"], order, k)


def recall_channels(
    queries: DataFrame, query_vectors: DataFrame, channels: dict[str, tuple[DataFrame, DataFrame, DataFrame]], per_list: int, limit: int,
    quotas: dict[str, int] | None = None,
) -> DataFrame:
    """Recall over several channels, each with candidate tables of its own, fused into one list of `limit` chunks per query.

    queries(query_id, text), query_vectors(query_id, query_vec); a channel is chunks(chunk_id, text), titles(chunk_id, title) and
    vectors(chunk_id, chunk_vec). Every channel gives a dense, a lexical and a title list of `per_list` chunks; document frequencies are those of
    the channel. A chunk that several lists name is one row: (query_id, chunk_id, fused, channels, signals, distance, lexical_score, rank), with both
    tag arrays sorted. `quotas`: so many of a channel's best chunks are sure of a place, the rest goes by fused score.
    """
    lists = []
    for name, (chunks, titles, vectors) in channels.items():
        found = [
            as_list(dense_topk(query_vectors, vectors, per_list), "semantic", "distance"),
            as_list(lexical_topk(queries, chunks, per_list), "lexical", "score"),
            as_list(title_topk(queries, titles, per_list), "exact-title", "score"),
        ]
        lists += [rows.withColumn("channel", F.lit(name)) for rows in found]
    of = lambda name, best: best(F.when(F.col("signal") == name, F.col("score")))
    share = F.col("weight") / (F.lit(RRF_K) + F.col("position") + 1)
    hits = recall_lists(*lists).groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(share), 12).alias("fused"), F.array_sort(F.collect_set("channel")).alias("channels"), F.array_sort(F.collect_set("signal")).alias("signals"),
        of("semantic", F.min).alias("distance"), of("lexical", F.max).alias("lexical_score"),
        *[F.round(F.sum(F.when(F.col("channel") == name, share)), 12).alias(f"in_{name}") for name in channels],
    )
    kinds = F.when(F.array_contains("signals", "exact-title"), 3).when(F.array_contains("signals", "semantic"), 2).otherwise(1)
    ties = [F.desc(kinds), F.asc("chunk_id")]
    sure = F.lit(False)
    for name, quota in (quotas or {}).items():
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(f"in_{name}"), *ties))
        hits = hits.withColumn(f"at_{name}", place)
        sure = sure | (F.col(f"in_{name}").isNotNull() & (F.col(f"at_{name}") <= quota))
    kept = top_per_key(hits.withColumn("sure", sure), ["query_id"], [F.desc("sure"), F.desc("fused"), *ties], limit).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), *ties)
    return kept.select("query_id", "chunk_id", "fused", "channels", "signals", "distance", "lexical_score", F.row_number().over(order).alias("rank"))


def relevant(max_distance: float = MAX_DISTANCE) -> Column:
    """Title hits and positive lexical hits pass; semantic ones must be close enough."""
    near = F.col("by_semantic") & F.coalesce(F.col("distance") <= max_distance, F.lit(True))
    return F.col("by_title") | (F.col("by_lexical") & (F.coalesce("lexical_score", F.lit(0.0)) > 0)) | near


def policy_then_fallback(scoped: DataFrame, unscoped: DataFrame) -> DataFrame:
    """Candidates of the policy-filtered recall, or of the open recall for queries it left empty."""
    missing = unscoped.join(scoped.select("query_id").distinct(), "query_id", "left_anti")
    return scoped.withColumn("mode", F.lit("policy")).unionByName(missing.withColumn("mode", F.lit("fallback")))


def authorized(candidates: DataFrame, allowed_chunks: DataFrame) -> DataFrame:
    return candidates.join(allowed_chunks, "chunk_id", "left_semi")


# --- graph expansion -----------------------------------------------------------------------------------


def seed_pages(candidates: DataFrame) -> DataFrame:
    """candidates(query_id, page_id, fused, by_title, distance): up to three strong pages near the top score."""
    strong = F.col("by_title") | F.coalesce(F.col("distance") <= STRONG_SEED_DISTANCE, F.lit(False))
    pages = candidates.groupBy("query_id", "page_id").agg(
        F.max("fused").alias("weight"), F.bool_or(strong).alias("strong")
    )
    top = F.max("weight").over(Window.partitionBy("query_id"))
    near = pages.withColumn("top_weight", top).filter("strong").filter(F.col("weight") >= F.col("top_weight") * SEED_RATIO)
    return top_per_key(near, ["query_id"], [F.desc("weight"), F.asc("page_id")], SEED_LIMIT)


def frontier_sources(seeds: DataFrame, links: DataFrame, link_sources: DataFrame, page_sources: DataFrame) -> DataFrame:
    """(query_id, source_id): sources of the seeds and of every link that touches them."""
    touching = links.select("link_id", F.col("from_id").alias("page_id")).union(links.select("link_id", "to_id"))
    by_link = touching.join(seeds.select("query_id", "page_id"), "page_id").join(link_sources, "link_id")
    by_page = page_sources.join(seeds.select("query_id", "page_id"), "page_id")
    return by_link.select("query_id", "source_id").union(by_page.select("query_id", "source_id")).distinct()


def expand_edges(
    seeds: DataFrame, links: DataFrame, link_sources: DataFrame, pages: DataFrame, page_sources: DataFrame,
    readable: DataFrame, limit: int,
) -> DataFrame:
    """Edges around the seeds: links (weight 0.7) and shared sources (0.2).

    An edge needs at least one source and only readable ones. Both ends are live pages of one space.
    Shared-source edges are held to a quarter of the limit, a quarter is reserved for links. Work is
    linear in the rows that touch a seed: pages of a source never meet each other, only a seed.
    """
    known = readable.select("source_id").distinct().withColumn("_readable", F.lit(True))
    live = pages.filter(F.col("stale_at").isNull()).select("page_id", "space_id")
    start = seeds.select("query_id", "page_id", "weight")
    usable = links.filter(
        (F.col("link_type") != "catalog_entry") & F.col("to_id").isNotNull() & ~F.col("is_dangling") & F.col("stale_at").isNull()
    )
    near = (
        usable.join(start.withColumnRenamed("page_id", "from_id"), "from_id")
        .select("query_id", "link_id", "from_id", "to_id", "space_id", "weight")
        .unionByName(
            usable.join(start.withColumnRenamed("page_id", "to_id"), "to_id").select(
                "query_id", "link_id", "from_id", "to_id", "space_id", "weight"
            )
        )
        .groupBy("query_id", "link_id", "from_id", "to_id", "space_id")
        .agg(F.max("weight").alias("seed_weight"))
    )
    in_space = live.select(F.col("page_id").alias("from_id"), "space_id")
    to_space = live.select(F.col("page_id").alias("to_id"), "space_id")
    near = near.join(in_space, ["from_id", "space_id"]).join(to_space, ["to_id", "space_id"])
    verdict = (
        link_sources.join(near.select("link_id").distinct(), "link_id", "left_semi")
        .join(known, "source_id", "left")
        .groupBy("link_id")
        .agg(F.bool_and(F.coalesce("_readable", F.lit(False))).alias("ok"), F.countDistinct("source_id").alias("sources"))
    )
    link_edges = near.join(verdict.filter("ok"), "link_id").select(
        "query_id", F.col("link_id").cast("string").alias("edge_id"), "from_id", "to_id", F.lit("link").alias("type"), "seed_weight", "sources"
    )
    owned = page_sources.select("page_id", "source_id").distinct()
    seed_sources = owned.join(start, "page_id").join(live, "page_id").select(
        "query_id", F.col("page_id").alias("seed_id"), "space_id", "weight", "source_id"
    )
    neighbours = owned.select(F.col("page_id").alias("other_id"), "source_id")
    pairs = (
        seed_sources.join(neighbours, "source_id")
        .filter(F.col("seed_id") != F.col("other_id"))
        .join(live.select(F.col("page_id").alias("other_id"), F.col("space_id").alias("other_space")), "other_id")
        .filter(F.col("space_id") == F.col("other_space"))
        .join(known, "source_id", "left")
        .groupBy("query_id", F.least("seed_id", "other_id").alias("from_id"), F.greatest("seed_id", "other_id").alias("to_id"))
        .agg(
            F.max("weight").alias("seed_weight"),
            F.bool_and(F.coalesce("_readable", F.lit(False))).alias("ok"),
            F.countDistinct("source_id").alias("sources"),
        )
    )
    shared = pairs.filter("ok").select(
        "query_id", F.concat_ws(":", F.lit("shared"), "from_id", "to_id").alias("edge_id"), "from_id", "to_id",
        F.lit("shared-source").alias("type"), "seed_weight", "sources",
    )
    quarter = max(1, limit // 4)
    order = [F.desc("seed_weight"), F.asc("edge_id")]
    links_ranked = top_per_key(link_edges, ["query_id"], order, limit + quarter, "type_rank")
    shared_ranked = top_per_key(shared, ["query_id"], order, quarter, "type_rank")
    weight = F.create_map(*[F.lit(v) for pair in EDGE_WEIGHTS.items() for v in pair])
    merged = links_ranked.unionByName(shared_ranked).withColumn("type_weight", weight[F.col("type")])
    reserved = (F.col("type") == "link") & (F.col("type_rank") <= quarter)
    return top_per_key(
        merged, ["query_id"], [F.desc(reserved), F.desc("seed_weight"), F.desc("type_weight"), F.asc("edge_id")], limit
    )


def neighbor_scores(edges: DataFrame, seeds: DataFrame, candidate_limit: int) -> DataFrame:
    """One hop from the seeds: (query_id, page_id, anchor), seeds themselves left out."""
    both = edges.select("query_id", F.col("from_id").alias("seed_id"), F.col("to_id").alias("page_id"), "type_weight").union(
        edges.select("query_id", "to_id", "from_id", "type_weight")
    )
    start = seeds.select("query_id", F.col("page_id").alias("seed_id"), (F.col("weight") / F.col("top_weight")).alias("share"))
    hops = (
        both.join(start, ["query_id", "seed_id"])
        .join(seeds.select("query_id", "page_id"), ["query_id", "page_id"], "left_anti")
        .groupBy("query_id", "page_id")
        .agg(F.max("type_weight").alias("type_weight"), F.max(F.col("share") * F.col("type_weight")).alias("anchor"))
    )
    return top_per_key(hops, ["query_id"], [F.desc("type_weight"), F.asc("page_id")], max(candidate_limit * 4, 32))


def edge_anchored_select(
    graph_fused: DataFrame, neighbors: DataFrame, direct: DataFrame, max_distance: float = MAX_DISTANCE
) -> DataFrame:
    """Best chunk of each neighbour that clears the relaxed gate, ordered by anchor, score and id.

    graph_fused(query_id, chunk_id, page_id, fused, by_*, distance, lexical_score)
    """
    fresh = graph_fused.join(direct.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    kept = fresh.filter(relevant(max_distance + GRAPH_SLACK))
    best = top_per_key(kept.drop("rank"), ["query_id", "page_id"], [F.desc("fused"), F.desc("priority"), F.asc("chunk_id")], 1, "_n").drop("_n")
    scored = best.join(neighbors.select("query_id", "page_id", "anchor"), ["query_id", "page_id"])
    window = Window.partitionBy("query_id").orderBy(F.desc("anchor"), F.desc("fused"), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(window))


def merge_reserved(direct: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """Direct hits first, a tail of max(1, k/4) slots for graph hits, more when direct hits are few.

    direct and graph carry (query_id, chunk_id, rank).
    """
    reserve = max(1, k // 4)
    have = graph.groupBy("query_id").agg(F.least(F.count("*"), F.lit(reserve)).alias("graph_slots"))
    head = direct.join(have, "query_id", "left").filter(
        F.col("rank") <= F.greatest(F.lit(k) - F.coalesce("graph_slots", F.lit(0)), F.lit(0))
    ).select("query_id", "chunk_id", F.col("rank").alias("position"), F.lit("direct").alias("origin"))
    taken = head.groupBy("query_id").agg(F.count("*").alias("taken"))
    rest = graph.join(head.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("rank")
    tail = rest.withColumn("n", F.row_number().over(order)).join(taken, "query_id", "left").withColumn(
        "position", F.coalesce("taken", F.lit(0)) + F.col("n")
    ).filter(F.col("position") <= k)
    return head.unionByName(tail.select("query_id", "chunk_id", "position", F.lit("graph").alias("origin")))


def window_recall_select(fused: DataFrame, direct: DataFrame, k: int) -> DataFrame:
    """Fused order with graph hits held to k/4; the best exact-title direct hit stays first.

    fused(query_id, chunk_id, rank, origin), direct(query_id, chunk_id, rank, by_title)
    """
    titled = direct.filter("by_title").groupBy("query_id").agg(F.min_by("chunk_id", "rank").alias("chunk_id"))
    offers = (
        titled.select("query_id", "chunk_id", F.lit(0).alias("turn"), F.lit(0).alias("rank"), F.lit("direct").alias("origin"))
        .unionByName(fused.select("query_id", "chunk_id", F.lit(1).alias("turn"), "rank", "origin"))
        .unionByName(direct.select("query_id", "chunk_id", F.lit(2).alias("turn"), "rank", F.lit("direct").alias("origin")))
    )
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id", "origin").orderBy("turn", "rank"))
    once = offers.withColumn("_f", first).filter("_f = 1").drop("_f")
    has_direct = direct.select("query_id").distinct().withColumn("_d", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("query_id", "origin").orderBy("turn", "rank"))
    once = once.withColumn("nth", nth).join(has_direct, "query_id", "left")
    kept = once.filter((F.col("origin") != "graph") | F.col("_d").isNull() | (F.col("nth") <= k // 4))
    again = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("turn", "rank"))
    kept = kept.withColumn("_f", again).filter("_f = 1")
    return top_per_key(kept, ["query_id"], [F.asc("turn"), F.asc("rank")], k, "position").select(
        "query_id", "chunk_id", "origin", "position"
    )


def drop_reasons(
    candidates: DataFrame, selected: DataFrame, relevant_rows: DataFrame, allowed: DataFrame, threshold: float = MAX_DISTANCE
) -> DataFrame:
    """Why a candidate is not in the result. candidates(query_id, chunk_id, score_type, score)"""
    key = ["query_id", "chunk_id"]
    flag = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    rows = (
        candidates.join(selected.select(*key), key, "left_anti")
        .join(flag(relevant_rows, "_relevant"), key, "left")
        .join(flag(allowed, "_allowed"), key, "left")
    )
    far = (F.col("score_type") == "semantic_distance") & (F.col("score") > threshold)
    reason = (
        F.when(far, "below_threshold").when(F.col("_relevant").isNull(), "filtered").when(F.col("_allowed").isNull(), "unauthorized").otherwise("rank_limit")
    )
    return rows.select(*key, reason.alias("reason")).distinct()


def retrieval_diagnostics(lists: DataFrame, edges: DataFrame) -> DataFrame:
    count = lambda name: F.countDistinct(F.when(F.col("signal") == name, F.col("chunk_id")))
    by_list = lists.groupBy("query_id").agg(
        count("semantic").alias("semantic_candidates"), count("lexical").alias("lexical_candidates"),
        count("exact-title").alias("title_candidates"), F.countDistinct("chunk_id").alias("candidates"),
    )
    by_edge = edges.groupBy("query_id").agg(
        F.count_if(F.col("type") == "link").alias("link_edges"), F.count_if(F.col("type") == "shared-source").alias("shared_edges")
    )
    return by_list.join(by_edge, "query_id", "full_outer").na.fill(0)


def compare_modes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Chunks only one of two selections picked, per query."""
    key = ["query_id", "chunk_id"]
    added = b.select(*key).join(a.select(*key), key, "left_anti").withColumn("change", F.lit("added"))
    gone = a.select(*key).join(b.select(*key), key, "left_anti").withColumn("change", F.lit("displaced"))
    return added.unionByName(gone)


# --- catalog -------------------------------------------------------------------------------------------


def _rarest(rows: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """The rarest pieces of each set that any set this similar must share one of.

    Sets with Jaccard similarity t share at least ceil(t * size) pieces, so one shared piece is always
    among the size - ceil(t * size) + 1 rarest. Frequent trigrams drop out of the join and no match is lost.
    """
    ranked = rows.select(*keys, F.explode("grams").alias("gram"), F.size("grams").alias("size")).join(weights, "gram", "left")
    order = Window.partitionBy(*keys).orderBy(F.coalesce("n", F.lit(0)), "gram")
    return ranked.withColumn("_p", F.row_number().over(order)).filter(
        F.col("_p") <= F.col("size") - F.ceil(F.col("size") * TRIGRAM_FLOOR) + 1
    ).select(*keys, "gram")


def trigram_topk(signals: DataFrame, pages: DataFrame, k: int = 8) -> DataFrame:
    """signals(signal_id, value), pages(page_id, title): k most similar titles with similarity over 0.3.

    Pages that share a title are compared once; of each title only its k smallest ids can qualify.
    """
    titles = pages.select("title").distinct().withColumn("grams", trigrams(F.col("title"))).filter(F.size("grams") > 0)
    asked = signals.select("signal_id", "value").withColumn("grams", trigrams(F.col("value"))).filter(F.size("grams") > 0)
    weights = titles.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    pairs = _rarest(asked, ["signal_id"], weights).join(_rarest(titles, ["title"], weights), "gram").select(
        "signal_id", "title"
    ).distinct()
    shared = F.size(F.array_intersect("a", "b"))
    scored = (
        pairs.join(asked.select("signal_id", F.col("grams").alias("a")), "signal_id")
        .join(titles.select("title", F.col("grams").alias("b")), "title")
        .select("signal_id", "title", (shared / (F.size("a") + F.size("b") - shared)).alias("similarity"))
        .filter(F.col("similarity") >= TRIGRAM_FLOOR)
    )
    heads = top_per_key(pages, ["title"], [F.asc("page_id")], k, "_n").drop("_n")
    return top_per_key(scored.join(heads, "title"), ["signal_id"], [F.desc("similarity"), F.asc("page_id")], k)


def all_terms_topk(signals: DataFrame, texts: DataFrame, k: int = 8) -> DataFrame:
    """signals(signal_id, value), texts(page_id, text): first k pages whose text holds every term.

    Only the rarest term of a signal is joined; the others are tested on the rows it finds.
    """
    asked = with_terms(signals, "value").filter(F.size("terms") > 0).select("signal_id", "terms")
    held = with_terms(texts).select("page_id", "terms")
    exploded = held.select("page_id", F.explode("terms").alias("term"))
    ask_terms = asked.select("signal_id", F.explode("terms").alias("term"))
    df = exploded.join(ask_terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    rarest = ask_terms.join(df, "term", "left").groupBy("signal_id").agg(
        F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term")
    )
    hits = (
        rarest.join(exploded, "term")
        .join(asked.withColumnRenamed("terms", "wanted"), "signal_id")
        .join(held, "page_id")
        .filter(F.size(F.array_except("wanted", "terms")) == 0)
    )
    return top_per_key(hits.select("signal_id", "page_id"), ["signal_id"], [F.asc("page_id")], k)


def catalog_candidates(signals: DataFrame, pages: DataFrame, texts: DataFrame, explicit: DataFrame, limit: int) -> DataFrame:
    """Artifacts that may already cover the signals of a source.

    signals(signal_id, source_id, value, key), pages(page_id, kind, canonical_key, title),
    explicit(source_id, page_id). Five generators are merged per (source, page).
    """
    names = ["explicit_match", "canonical_match", "title_match", "fts_match"]

    def marked(rows: DataFrame, name: str | None, similarity: Column | None = None) -> DataFrame:
        return rows.select(
            "source_id", "page_id", *[F.lit(n == name).alias(n) for n in names],
            (similarity if similarity is not None else F.lit(0.0)).alias("similarity"),
        )

    titled = signals.select("source_id", normalize_title(F.col("value")).alias("t"))
    parts = [
        marked(explicit, "explicit_match"),
        marked(signals.select("source_id", "key").join(pages, F.col("key") == F.col("canonical_key")), "canonical_match"),
        marked(titled.join(pages.withColumn("t", normalize_title(F.col("title"))), "t"), "title_match"),
        marked(trigram_topk(signals, pages.select("page_id", "title")).join(signals.select("signal_id", "source_id"), "signal_id"), None, F.col("similarity")),
        marked(all_terms_topk(signals, texts).join(signals.select("signal_id", "source_id"), "signal_id"), "fts_match"),
    ]
    merged = reduce(lambda a, b: a.unionByName(b), parts).groupBy("source_id", "page_id").agg(
        *[F.bool_or(n).alias(n) for n in names], F.max("similarity").alias("similarity")
    )
    detailed = merged.join(pages, "page_id")
    order = [
        F.desc("explicit_match"), F.desc("canonical_match"), F.desc("title_match"), F.desc("similarity"), F.desc("fts_match"),
        F.asc("kind"), F.asc("canonical_key"), F.asc("page_id"),
    ]
    return top_per_key(detailed, ["source_id"], order, limit)
