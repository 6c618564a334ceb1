"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import apply_guards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

# Row numbers and lengths are 32-bit in Spark and 64-bit in SQL; these columns are widened so that types agree.
LONG_COLUMNS = {
    **dict.fromkeys(
        "ranked_docs metric_evidence dense_topk lexical_topk title_topk page_title_topk rrf_fused gated_authorized seed_pages graph_edges "
        "graph_neighbors edge_anchored trigram_topk catalog_candidates raw_windows".split(),
        ["rank"],
    ),
    **dict.fromkeys(["view_sort", "natural_order"], ["place"]),
    **dict.fromkeys(["chunk_identity", "link_extract", "window_recall", "merge_reserved", "member_order"], ["position"]),
    "occurrences": ["occurrence"],
    "markdown_blocks": ["start", "stop", "block_no"],
    "table_rows": ["row_no"],
    "vocabulary_loss": ["source_chars", "compiled_chars", "source_words", "compiled_words", "kept"],
    "context_packing": ["position", "included"],
    "citation_images": ["position", "rank"],
    "view_group": ["group_position", "card"],
}


def plan(sql: str | None = None, name: str | None = None):
    """Registers a query; `sql` is the equivalent statement on the same tables."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        key = name or fn.__name__
        if key in QUERIES:
            raise KeyError(f"query {key} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            apply_guards(spark)
            df = fn(spark, sf)
            return df.withColumns({c: F.col(c).cast("long") for c in LONG_COLUMNS.get(key, ())})

        QUERIES[key] = run
        if sql:
            CHECKS[key] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
