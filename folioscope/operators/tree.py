"""Page trees: descendants, ancestors, paths, subtree changes.

Pages have page_id and parent_id. A walk joins one level per round, so a round touches only the pages
below the current frontier; every frontier is written as a table to keep lineage short. A walk ends when
nothing is left to reach, however deep that is. The number of rounds is the depth of the tree, never its size.
"""

from __future__ import annotations

from itertools import count

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.session import cut_lineage

# A share reaches this many levels down.
SHARE_LEVELS = 25


def walk_down(
    children: DataFrame, start: DataFrame, carry: dict[str, Column], levels: int | None = None
) -> DataFrame:
    """All rows reached from `start` by following children.parent_id, `start` included, down to `levels` if given.

    `carry` computes the columns of a child from its own columns (prefix `c.`) and those of the parent
    row (prefix `p.`). Pages have one parent, so a page can only be met again through its own start
    page; a walk that carries its start page as `root` stops there.
    """
    columns = ["page_id", *carry]
    level = start.select(*columns)
    children = children.persist(StorageLevel.MEMORY_AND_DISK)  # every round reads it
    out = level
    has_root = "root" in carry
    for _ in count() if levels is None else range(levels):
        below = (
            children.alias("c")
            .join(level.alias("p"), F.col("c.parent_id") == F.col("p.page_id"))
            .select(F.col("c.page_id"), *[expr.alias(name) for name, expr in carry.items()])
        )
        if has_root:
            below = below.filter(F.col("page_id") != F.col("root"))
        level = cut_lineage(below)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    children.unpersist()
    return out


def descendants(pages: DataFrame, roots: DataFrame, live_only: bool = False, levels: int | None = None) -> DataFrame:
    """(page_id, root, depth) for every page in the subtree of each root, the root itself at depth 0."""
    rows = pages.filter(F.col("deleted_at").isNull()) if live_only else pages
    start = roots.select("page_id").distinct()
    if live_only:
        start = start.join(rows.select("page_id"), "page_id", "left_semi")
    start = start.select("page_id", F.col("page_id").alias("root"), F.lit(0).alias("depth"))
    return walk_down(
        rows.select("page_id", "parent_id"), start, {"root": F.col("p.root"), "depth": F.col("p.depth") + 1}, levels
    )


def ancestors(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """(page_id, ancestor_id, depth): the chain from each page up to its root, the page at depth 0.

    A row carries the pages it has passed, so a chain that runs into a circle ends where it would repeat itself.
    """
    parents = pages.select(F.col("page_id").alias("ancestor_id"), "parent_id")
    level = ids.select("page_id").distinct().join(
        parents.select(F.col("ancestor_id").alias("page_id"), "parent_id"), "page_id"
    ).select("page_id", F.col("page_id").alias("ancestor_id"), "parent_id", F.lit(0).alias("depth"), F.array("page_id").alias("_passed"))
    out = level.select("page_id", "ancestor_id", "depth")
    while True:
        level = cut_lineage(
            level.filter(F.col("parent_id").isNotNull() & ~F.array_contains("_passed", F.col("parent_id")))
            .select(
                "page_id", F.col("parent_id").alias("ancestor_id"), (F.col("depth") + 1).alias("depth"),
                F.array_append("_passed", F.col("parent_id")).alias("_passed"),
            )
            .join(parents, "ancestor_id")
        )
        if level.isEmpty():
            return out
        out = out.unionByName(level.select("page_id", "ancestor_id", "depth"))


def breadcrumbs(pages: DataFrame, separator: str = " / ") -> DataFrame:
    """(page_id, depth, trail): titles from the root down to each page, for the whole tree at once."""
    start = pages.filter(F.col("parent_id").isNull()).select(
        "page_id", F.lit(0).alias("depth"), F.col("title").alias("trail")
    )
    return walk_down(
        pages.select("page_id", "parent_id", "title"),
        start,
        {"depth": F.col("p.depth") + 1, "trail": F.concat(F.col("p.trail"), F.lit(separator), F.col("c.title"))},
    )


def with_has_children(pages: DataFrame, all_pages: DataFrame) -> DataFrame:
    parents = all_pages.select(F.col("parent_id").alias("page_id")).filter(F.col("page_id").isNotNull()).distinct()
    return pages.join(parents.withColumn("has_children", F.lit(True)), "page_id", "left").na.fill(
        False, ["has_children"]
    )


def is_self_or_ancestor(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(page_id, other_id) with `related`: whether other is the page or one of its ancestors."""
    chain = ancestors(pages, pairs.select("page_id"))
    hit = chain.select("page_id", F.col("ancestor_id").alias("other_id"), F.lit(True).alias("related"))
    return pairs.join(hit, ["page_id", "other_id"], "left").na.fill(False, ["related"])


def soft_delete(pages: DataFrame, shares: DataFrame, roots: DataFrame, when: str) -> tuple[DataFrame, DataFrame]:
    """New snapshots of pages and shares after moving the live subtrees of `roots` to the trash."""
    gone = descendants(pages, roots, live_only=True).select("page_id").distinct()
    marked = (
        pages.join(gone.withColumn("_gone", F.lit(True)), "page_id", "left")
        .withColumn("deleted_at", F.when(F.col("_gone"), F.lit(when)).otherwise(F.col("deleted_at")))
        .drop("_gone")
    )
    return marked, shares.join(gone, "page_id", "left_anti")


def restore(pages: DataFrame, roots: DataFrame) -> DataFrame:
    """Snapshot with the subtrees of `roots` live again; a root under a deleted parent moves to the top."""
    back = descendants(pages, roots).select("page_id").distinct().withColumn("_back", F.lit(True))
    dead = pages.filter(F.col("deleted_at").isNotNull()).select(
        F.col("page_id").alias("parent_id"), F.lit(True).alias("_dead_parent")
    )
    tops = roots.select("page_id").distinct().withColumn("_top", F.lit(True))
    return (
        pages.join(back, "page_id", "left")
        .join(tops, "page_id", "left")
        .join(dead, "parent_id", "left")
        .withColumn("deleted_at", F.when(F.col("_back").isNull(), F.col("deleted_at")))
        .withColumn(
            "parent_id", F.when(F.col("_top") & F.col("_dead_parent"), F.lit(None)).otherwise(F.col("parent_id"))
        )
        .select(*pages.columns)
    )


def purge(pages: DataFrame, roots: DataFrame) -> DataFrame:
    return pages.join(descendants(pages, roots).select("page_id").distinct(), "page_id", "left_anti")


def deleted_roots(pages: DataFrame) -> DataFrame:
    """Trash entries: deleted pages whose parent is not deleted."""
    dead = pages.filter(F.col("deleted_at").isNotNull())
    return dead.join(dead.select(F.col("page_id").alias("parent_id")), "parent_id", "left_anti")


def nearest_marked(pages: DataFrame, marked: DataFrame, levels: int | None = None) -> DataFrame:
    """(page_id, root, depth): the closest marked page at or above each page that has one.

    The walk starts at the marked pages and stops where the next one begins, so a page is reached once,
    from its nearest mark, and pages with no mark above them are never touched.
    """
    marks = marked.select("page_id").distinct()
    plain = pages.join(marks, "page_id", "left_anti")
    return descendants(plain, marks, levels=levels)


def share_for_page(pages: DataFrame, shares: DataFrame) -> DataFrame:
    """(page_id, share_id, level): nearest share within 25 levels; inherited ones must take in sub-pages."""
    near = nearest_marked(pages, shares, SHARE_LEVELS)
    found = near.join(
        shares.select(F.col("page_id").alias("root"), "share_id", "include_sub_pages"), "root"
    )
    return found.filter((F.col("depth") == 0) | F.col("include_sub_pages")).select(
        "page_id", "share_id", F.col("depth").alias("level")
    )


def path_between(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(page_id, top_id): the pages from page_id up to top_id, for pairs where top is above page."""
    chain = ancestors(pages, pairs.select("page_id")).join(pairs, "page_id")
    reach = chain.filter(F.col("ancestor_id") == F.col("top_id")).select(
        "page_id", "top_id", F.col("depth").alias("top_depth")
    )
    return chain.join(reach, ["page_id", "top_id"]).filter(F.col("depth") <= F.col("top_depth")).select(
        "page_id", "top_id", "ancestor_id", "depth"
    )


def export_closure(pages: DataFrame, allowed: DataFrame) -> DataFrame:
    """Pages kept by an export: allowed, with every page above them in the set allowed as well."""
    kept = cut_lineage(pages.join(allowed.select("page_id").distinct(), "page_id", "left_semi"))
    inside = pages.select(F.col("page_id").alias("parent_id"))
    tops = kept.join(inside, "parent_id", "left_anti").select("page_id")
    return descendants(kept, tops).select("page_id", "depth")


def export_tree_paths(pages: DataFrame) -> DataFrame:
    """(page_id, path): encoded titles joined by '/', equal titles of siblings numbered ` (n)`."""
    order = Window.partitionBy("parent_id", "title").orderBy("page_id")
    nth = F.row_number().over(order)
    named = pages.withColumn("_nth", nth).withColumn(
        "name", F.when(F.col("_nth") > 1, F.concat("title", F.lit(" ("), F.col("_nth") - 1, F.lit(")"))).otherwise(F.col("title"))
    )
    named = named.select("page_id", "parent_id", F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20")).alias("name"))
    start = named.filter(F.col("parent_id").isNull()).select("page_id", F.col("name").alias("path"))
    return walk_down(named, start, {"path": F.concat(F.col("p.path"), F.lit("/"), F.col("c.name"))})
