"""Membership of spaces, roles, watchers and listings that depend on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Roles from the strongest down.
ROLES = ["admin", "writer", "reader"]


def role_rank(role: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(reversed(ROLES), 1):
        rank = F.when(role == name, i).otherwise(rank)
    return rank


def space_users(direct: DataFrame, group_spaces: DataFrame, memberships: DataFrame) -> DataFrame:
    """(space_id, user_id, role) from direct membership and from the groups of a space, all rows kept."""
    via = group_spaces.join(memberships, "group_id").select("space_id", "user_id", "role")
    return direct.select("space_id", "user_id", "role").unionByName(via)


def member_counts(rows: DataFrame) -> DataFrame:
    """Distinct users per space. Duplicates go first, so a large space is spread over all tasks."""
    return rows.select("space_id", "user_id").distinct().groupBy("space_id").agg(F.count("*").alias("members"))


def highest_role(rows: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(r) for r in reversed(ROLES)])
    return rows.groupBy("space_id", "user_id").agg(F.max(role_rank(F.col("role"))).alias("rank")).select(
        "space_id", "user_id", F.try_element_at(names, F.col("rank")).alias("role")
    )


def recipients(page_watchers: DataFrame, pages: DataFrame, space_watchers: DataFrame, muted: DataFrame) -> DataFrame:
    """(page_id, user_id): page watchers and watchers of the page's space, without the muted ones.

    page_watchers(page_id, user_id), pages(page_id, space_id), space_watchers(space_id, user_id), muted(page_id, user_id). Pages of one space and
    watchers of it meet in one join and are distinct by their keys, so the pairs, by far the most rows, go through no exchange: the users a page
    mutes lie beside it as a list, as long as that page's own rows. Only pairs of pages in several spaces are made distinct.
    """
    watching = space_watchers.select("space_id", "user_id").distinct()
    silent = muted.groupBy("page_id").agg(F.collect_set("user_id").alias("_muted"))
    placed = pages.groupBy("page_id").agg(F.collect_set("space_id").alias("_spaces")).join(silent, "page_id", "left")
    heard = ~F.coalesce(F.array_contains("_muted", F.col("user_id")), F.lit(False))
    pairs = lambda some: some.withColumn("space_id", F.explode("_spaces")).join(watching, "space_id").filter(heard).select("page_id", "user_id")
    # pages of one space follow each other, so the same users come again and again, which files keep in little room
    single = placed.filter(F.size("_spaces") == 1).sortWithinPartitions(F.get("_spaces", F.lit(0)), "page_id")
    by_space = pairs(single).unionByName(pairs(placed.filter(F.size("_spaces") > 1)).distinct())
    # page watchers who watch a space of the page as well are there already
    own = page_watchers.select("page_id", "user_id").distinct().join(muted, ["page_id", "user_id"], "left_anti")
    there = own.join(pages.select("page_id", "space_id"), "page_id").join(watching, ["space_id", "user_id"], "left_semi")
    return by_space.unionByName(own.join(there.select("page_id", "user_id"), ["page_id", "user_id"], "left_anti"))


def member_order() -> list[Column]:
    """Strongest role first, groups before users, then name and id."""
    return [F.desc(role_rank(F.col("role"))), F.desc("is_group"), F.asc("name"), F.asc("id")]


def unread_counts(notifications: DataFrame, user_spaces: DataFrame) -> DataFrame:
    """Unread notifications per user inside the spaces the user belongs to."""
    return (
        notifications.filter(F.col("read_at").isNull())
        .join(user_spaces.select("space_id", "user_id").distinct(), ["space_id", "user_id"], "left_semi")
        .groupBy("user_id")
        .agg(F.count("*").alias("unread"))
    )


def label_page_counts(page_labels: DataFrame, pages: DataFrame) -> DataFrame:
    live = pages.filter(F.col("deleted_at").isNull())
    return page_labels.join(live.select("page_id"), "page_id", "left_semi").groupBy("label").agg(
        F.count("*").alias("pages")
    )


def with_labels(pages: DataFrame, page_labels: DataFrame) -> DataFrame:
    """Pages with their labels as an ordered array; a page has few labels."""
    packed = page_labels.groupBy("page_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return pages.join(packed, "page_id", "left")


def nested(rows: DataFrame, key: str, one: dict[str, tuple[str, DataFrame]], many: dict[str, DataFrame]) -> DataFrame:
    """`rows` with objects of other tables inside.

    one: name → (column of `rows`, table(id, ..)), a struct or null; ids are unique. many: name → table(<key>, ..), an array of structs in the order of the
    table's columns, empty where a row has none. All lists are put together in one exchange on the key, however many tables they come from.
    """
    out = rows
    for name, (column, table) in one.items():
        inside = F.struct(*[F.col(c) for c in table.columns]).alias(name)
        out = out.join(table.select(F.col("id").alias(f"_{name}"), inside), F.col(column) == F.col(f"_{name}"), "left").drop(f"_{name}")
    if not many:
        return out
    cells = {name: F.struct(*[F.col(c) for c in table.columns if c != key]) for name, table in many.items()}
    kinds = {name: table.select(cells[name].alias("v")).schema["v"].dataType for name, table in many.items()}
    parts = [
        table.select(F.col(key).alias("_key"), *[(cells[n] if n == name else F.lit(None).cast(kinds[n])).alias(n) for n in many]) for name, table in many.items()
    ]
    lists = reduce(lambda a, b: a.unionByName(b), parts).groupBy("_key").agg(*[F.array_sort(F.collect_list(n)).alias(n) for n in many])
    joined = out.join(lists, F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumns({n: F.coalesce(F.col(n), F.array().cast(T.ArrayType(kinds[n]))) for n in many})


def reply_flags(comments: DataFrame) -> DataFrame:
    """Per comment: whether it has replies, and replies by other people."""
    replies = comments.filter(F.col("parent_id").isNotNull()).groupBy("parent_id", "user_id").agg(F.count("*").alias("n"))
    owners = comments.select("comment_id", F.col("user_id").alias("owner_id"))
    flags = (
        replies.join(owners, replies["parent_id"] == owners["comment_id"])
        .groupBy("comment_id")
        .agg(F.sum("n").alias("replies"), F.bool_or(F.col("user_id") != F.col("owner_id")).alias("by_others"))
    )
    return comments.select("comment_id").join(flags, "comment_id", "left").select(
        "comment_id",
        (F.coalesce("replies", F.lit(0)) > 0).alias("has_replies"),
        F.coalesce("by_others", F.lit(False)).alias("has_replies_by_others"),
    )


def backlinks(links: DataFrame, pages: DataFrame, visible: DataFrame, incoming: bool = True) -> DataFrame:
    """(page_id, other_id): distinct links between live pages the reader may see, by direction."""
    page, other = ("to_id", "from_id") if incoming else ("from_id", "to_id")
    live = pages.filter(F.col("deleted_at").isNull()).join(visible, "page_id", "left_semi").select(
        F.col("page_id").alias("other_id")
    )
    return links.select(F.col(page).alias("page_id"), F.col(other).alias("other_id")).distinct().join(
        live, "other_id", "left_semi"
    )


def backlink_counts(links: DataFrame, pages: DataFrame, visible: DataFrame) -> DataFrame:
    return backlinks(links, pages, visible).groupBy("page_id").agg(F.count("*").alias("backlinks"))


def block_references(embeds: DataFrame, pages: DataFrame, visible: DataFrame) -> DataFrame:
    """(block_id, page_id): live pages the reader may see that embed a block."""
    live = pages.filter(F.col("deleted_at").isNull()).join(visible, "page_id", "left_semi")
    return embeds.select("block_id", "page_id").distinct().join(live.select("page_id"), "page_id", "left_semi")
