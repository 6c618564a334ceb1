"""Page access: a page is visible when every restricted page at or above it grants the reader.

Restrictions are few compared with pages. The plans therefore find, once, the nearest restricted page
of every page below a restriction (its zone), decide access on the small forest of restricted pages,
and join the verdict back by zone. Pages outside all zones never take part in a permission join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import sha256_hex
from folioscope.operators.tree import ancestors, descendants, nearest_marked
from folioscope.session import cut_lineage

# Pairs of pages and readers that one slice of a policy makes.
PAIRS = 1 << 22
# Hex digits of an entry's digest that name its slot in the hash of a policy.
SLOT_DIGITS = 3


def expand_principals(permissions: DataFrame, memberships: DataFrame) -> DataFrame:
    """(page_id, user_id, can_write): grants to users, and grants to groups spread over their members."""
    direct = permissions.filter(F.col("user_id").isNotNull()).select("page_id", "user_id", "role")
    grouped = permissions.filter(F.col("group_id").isNotNull()).select("page_id", "group_id", "role")
    return (
        direct.unionByName(grouped.join(memberships, "group_id").select("page_id", "user_id", "role"))
        .groupBy("page_id", "user_id")
        .agg(F.bool_or(F.col("role") == "writer").alias("can_write"))
    )


def zones(pages: DataFrame, access: DataFrame) -> DataFrame:
    """(page_id, zone, depth): nearest restricted page at or above each page that has one."""
    return nearest_marked(pages, access).select("page_id", F.col("root").alias("zone"), "depth")


def restriction_chain(pages: DataFrame, access: DataFrame, zoned: DataFrame) -> DataFrame:
    """(zone, required, distance): all restricted pages at or above each restricted page, nearest first."""
    marks = access.select("page_id").distinct()
    above = zoned.select(F.col("page_id").alias("parent_id"), F.col("zone").alias("upper"))
    forest = (
        pages.select("page_id", "parent_id")
        .join(marks, "page_id", "left_semi")
        .join(above, "parent_id", "left")
        .select("page_id", F.col("upper").alias("parent_id"))
    )
    return ancestors(forest, marks).select(
        F.col("page_id").alias("zone"), F.col("ancestor_id").alias("required"), F.col("depth").alias("distance")
    )


def passing(chain: DataFrame, grants: DataFrame) -> DataFrame:
    """(zone, user_id, can_edit) for users granted by every restriction of the zone's chain."""
    length = chain.groupBy("zone").agg(F.count("*").alias("needed"))
    return (
        chain.join(grants.withColumnRenamed("page_id", "required"), "required")
        .groupBy("zone", "user_id")
        .agg(
            F.count("*").alias("granted"),
            F.min_by("can_write", "distance").alias("nearest_write"),
            F.min("distance").alias("nearest"),
        )
        .join(length, "zone")
        .filter(F.col("granted") == F.col("needed"))
        .select("zone", "user_id", F.col("nearest_write").alias("can_edit"))
    )


def visible_pages(pages: DataFrame, access: DataFrame, grants: DataFrame, user) -> DataFrame:
    """(page_id, can_edit) for one reader; without any restriction nothing is joined at all."""
    if access.isEmpty():
        return pages.select("page_id", F.lit(True).alias("can_edit"))
    zoned = zones(pages, access)
    mine = passing(restriction_chain(pages, access, zoned), grants.filter(F.col("user_id") == F.lit(user)))
    return (
        pages.select("page_id")
        .join(zoned.select("page_id", "zone"), "page_id", "left")
        .join(mine.select("zone", F.lit(True).alias("ok"), "can_edit"), "zone", "left")
        .filter(F.col("zone").isNull() | F.col("ok"))
        .select("page_id", F.when(F.col("zone").isNull(), F.lit(True)).otherwise(F.col("can_edit")).alias("can_edit"))
    )


def access_levels(pages: DataFrame, access: DataFrame, grants: DataFrame, user) -> DataFrame:
    """Per page: direct or inherited restriction, and what the reader may do."""
    zoned = zones(pages, access)
    chain = restriction_chain(pages, access, zoned)
    mine = passing(chain, grants.filter(F.col("user_id") == F.lit(user)))
    nested = chain.groupBy("zone").agg(F.count("*").alias("needed"))
    return (
        pages.select("page_id")
        .join(zoned, "page_id", "left")
        .join(nested, "zone", "left")
        .join(mine.select("zone", F.lit(True).alias("ok"), "can_edit"), "zone", "left")
        .select(
            "page_id",
            (F.coalesce("depth", F.lit(-1)) == 0).alias("direct_restriction"),
            F.coalesce((F.col("depth") > 0) | (F.col("needed") > 1), F.lit(False)).alias("inherited_restriction"),
            (F.col("zone").isNull() | F.coalesce("ok", F.lit(False))).alias("can_access"),
            F.when(F.col("zone").isNull(), F.lit(True)).otherwise(F.coalesce("can_edit", F.lit(False))).alias("can_edit"),
        )
    )


def _digest(*columns: str) -> Column:
    """A digest of the set of a group's rows, which are distinct; whatever their order and number, it takes no list of them."""
    sums = [F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(20,0)")) for seed in (1, 2)]
    return F.concat_ws(":", F.count("*"), *sums)


def readers_by_policy(chain: DataFrame, permissions: DataFrame, memberships: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(zone, policy) and (policy, user_id): zones that require the same principals share a policy; who passes is found once for each.

    permissions(page_id, user_id, group_id) and memberships(group_id, user_id); without memberships the permissions are (page_id, user_id).
    A policy's candidates are the readers of that requirement which has the fewest, so a group is spread over its members only where
    nothing narrower is required; the other requirements are looked up for the candidates. Zones that nobody can pass have no policy.
    """
    held = permissions.withColumnRenamed("page_id", "required").join(chain.select("required").distinct(), "required", "left_semi")
    direct = held.filter("user_id is not null").select("required", "user_id").distinct()
    entries = direct.select("required", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("principal"))
    if memberships is not None:
        members = memberships.select("group_id", "user_id").distinct()
        grouped = held.filter("group_id is not null").select("required", "group_id").distinct()
        entries = entries.unionByName(grouped.select("required", F.concat(F.lit("group:"), F.col("group_id").cast("string")).alias("principal")))
    content = cut_lineage(entries.groupBy("required").agg(_digest("principal").alias("content")))
    needs = chain.select("zone", "required").join(content, "required", "left").select("zone", "content").distinct()
    marks = needs.groupBy("zone").agg(_digest("content").alias("policy"), F.bool_or(F.col("content").isNull()).alias("closed"))
    policies = cut_lineage(marks.filter(~F.col("closed")).select("zone", "policy"))
    required = cut_lineage(needs.join(policies.groupBy("policy").agg(F.min("zone").alias("zone")), "zone").select("policy", "content"))
    # One page stands for all of the same principals.
    page = content.groupBy("content").agg(F.min("required").alias("required"))
    users = cut_lineage(page.join(direct, "required").select("content", "user_id"))
    reach = users.groupBy("content").agg(F.count("*").alias("n"))
    if memberships is not None:
        groups = cut_lineage(page.join(grouped, "required").select("content", "group_id"))
        sizes = members.groupBy("group_id").agg(F.count("*").alias("n"))
        reach = reach.unionByName(groups.join(sizes, "group_id").groupBy("content").agg(F.sum("n").alias("n")))
    reach = required.join(reach.groupBy("content").agg(F.sum("n").alias("n")), "content", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    least = reach.groupBy("policy").agg(F.min_by("content", F.struct("n", "content")).alias("content"), F.count("*").alias("needed"))
    first = least.join(users, "content")
    if memberships is not None:
        first = first.unionByName(least.join(groups, "content").join(members, "group_id").select(*first.columns)).distinct()
    first = cut_lineage(first)
    more = first.filter("needed > 1").withColumnRenamed("content", "first").join(required, "policy").filter("content <> first").drop("first")
    granted = more.join(users, ["content", "user_id"]).select(*more.columns)
    if memberships is not None:
        by_group = more.join(members, "user_id").join(groups, ["content", "group_id"]).select(*more.columns)
        granted = granted.unionByName(by_group).distinct()
    passed = granted.groupBy("policy", "user_id", "needed").agg(F.count("*").alias("granted")).filter("granted + 1 = needed")
    return policies, cut_lineage(first.filter("needed = 1").select("policy", "user_id").unionByName(passed.select("policy", "user_id")))


def visible_counts(pages: DataFrame, access: DataFrame, grants: DataFrame, users: DataFrame, memberships: DataFrame | None = None) -> DataFrame:
    """(user_id, visible): how many pages each user sees, from zone sizes instead of user-page pairs.

    With memberships, `grants` are permissions of users and groups as they stand, not yet spread over the members.
    """
    zoned = cut_lineage(zones(pages, access))
    policies, readers = readers_by_policy(restriction_chain(pages, access, zoned), grants, memberships)
    sizes = zoned.join(policies, "zone").groupBy("policy").agg(F.count("*").alias("pages"))
    opened = readers.join(sizes, "policy").groupBy("user_id").agg(F.sum("pages").alias("opened"))
    free = pages.join(zoned.select("page_id"), "page_id", "left_anti").agg(F.count("*").alias("free"))
    return users.select("user_id").join(opened, "user_id", "left").select(
        "user_id", (free.scalar() + F.coalesce("opened", F.lit(0))).alias("visible")
    )


def users_with_access(
    pages: DataFrame, access: DataFrame, grants: DataFrame, ids: DataFrame, users: DataFrame | None = None, memberships: DataFrame | None = None
) -> DataFrame:
    """(page_id, user_id) for the pages `ids`, among `users` if given.

    With users, a page outside all zones is open to each of them; without, only restricted pages have rows, as an open
    page has no list of readers. Give the pages and users that are asked for: the rows are their pairs. With memberships, `grants` are
    permissions of users and groups as they stand. Pages meet the readers of their policy in one join, and a policy of many pairs is dealt
    to slices by page, so the pairs go through no exchange and a task makes about PAIRS of them for a slice.
    """
    zoned = cut_lineage(zones(pages, access))
    policies, readers = readers_by_policy(restriction_chain(pages, access, zoned), grants, memberships)
    asked = ids.select("page_id").distinct().join(zoned.select("page_id", "zone"), "page_id", "left").join(policies, "zone", "left")
    if users is None:
        asked = asked.filter("policy is not null")
    else:
        users = users.select("user_id").distinct()
        # An open page has the policy of everybody, so one join finds the readers of all pages.
        asked = asked.filter("policy is not null or zone is null").withColumn("policy", F.coalesce("policy", F.lit("open")))
        readers = readers.join(users, "user_id", "left_semi").select("policy", "user_id").unionByName(users.select(F.lit("open").alias("policy"), "user_id"))
    asked, readers = cut_lineage(asked.select("page_id", "policy")), cut_lineage(readers)
    count = lambda df, name: df.groupBy("policy").agg(F.count("*").alias(name))
    slices = F.ceil(F.col("asked") * F.col("read") / PAIRS).cast("int").alias("slices")
    wide = cut_lineage(count(asked, "asked").join(count(readers, "read"), "policy").select("policy", slices).filter("slices > 1"))
    slices = F.coalesce("slices", F.lit(1))
    left = asked.join(wide, "policy", "left").select("policy", F.pmod(F.xxhash64("page_id"), slices).cast("int").alias("slice"), "page_id")
    right = readers.join(wide, "policy", "left").select("policy", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "user_id")
    return left.join(right, ["policy", "slice"]).select("page_id", "user_id")


def restricted_subtree(pages: DataFrame, access: DataFrame, roots: DataFrame) -> DataFrame:
    """Pages below `roots` that have a restriction at or above them."""
    return descendants(pages, roots).join(zones(pages, access).select("page_id", "zone"), "page_id")


def unrestricted_descendants(pages: DataFrame, access: DataFrame, roots: DataFrame) -> DataFrame:
    """Subtrees of `roots`, cut off at restricted pages."""
    plain = pages.join(access.select("page_id").distinct(), "page_id", "left_anti")
    return descendants(plain, roots.join(access.select("page_id").distinct(), "page_id", "left_anti"))


def parents_with_visible_children(pages: DataFrame, visible: DataFrame) -> DataFrame:
    live = pages.filter(F.col("deleted_at").isNull() & F.col("parent_id").isNotNull())
    return live.join(visible.select("page_id"), "page_id", "left_semi").select(
        F.col("parent_id").alias("page_id")
    ).distinct()


def policy_requirements(chain: DataFrame, permissions: DataFrame) -> DataFrame:
    """(zone, distance, required, principal, role): what a zone requires, nearest restriction first; principal and role are null where it has none.

    Sorted by these columns the rows are the canonical list of a policy.
    """
    principal = F.coalesce(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.concat(F.lit("group:"), F.col("group_id").cast("string"))
    )
    held = permissions.select(F.col("page_id").alias("required"), principal.alias("principal"), "role").filter("principal is not null").distinct()
    return chain.select("zone", "distance", "required").join(held, "required", "left").select("zone", "distance", "required", "principal", "role")


def policy_snapshot(chain: DataFrame, permissions: DataFrame) -> DataFrame:
    """(zone, requirement_count, principal_count, policy_hash).

    The hash is a tree over the canonical list. Entries of a requirement are dealt to 4 096 slots by their digest; a slot's hash covers its sorted
    digests, a requirement's hash its slots in order, the policy's hash its requirements from the nearest on. So no list grows with the number of
    principals but within a slot, equal policies have equal hashes, and two requirements that swap give another.
    """
    rows = policy_requirements(chain, permissions)
    entry = F.when(F.col("principal").isNotNull(), sha256_hex(F.concat_ws("|", "principal", "role")))
    slots = rows.withColumn("entry", entry).groupBy("zone", "distance", "required", F.substring("entry", 1, SLOT_DIGITS).alias("slot")).agg(
        F.count("entry").alias("n"), sha256_hex(F.array_join(F.array_sort(F.collect_list("entry")), ",")).alias("hash")
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "hash"))), lambda s: F.concat_ws(":", s["slot"], s["hash"])), ",")
    requirements = slots.groupBy("zone", "distance", "required").agg(F.sum("n").alias("n"), listed.alias("listed")).select(
        "zone", "distance", "n", sha256_hex(F.concat_ws("|", F.col("required").cast("string"), F.col("n").cast("string"), "listed")).alias("hash")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("distance", "hash"))), lambda r: r["hash"])
    return requirements.groupBy("zone").agg(
        (F.max("distance") + 1).cast("long").alias("requirement_count"), F.sum("n").alias("principal_count"),
        sha256_hex(F.array_join(ordered, ",")).alias("policy_hash"),
    )


def policy_drift(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Sources whose stored policy is missing, stale, or differs in hash or size."""
    old = stored.select(
        "zone",
        F.col("policy_hash").alias("old_hash"),
        F.col("requirement_count").alias("old_count"),
        F.col("stale_at").alias("old_stale"),
    )
    reason = (
        F.when(F.col("old_hash").isNull(), "missing")
        .when(F.col("old_stale").isNotNull(), "stale")
        .when((F.col("old_hash") != F.col("policy_hash")) | (F.col("old_count") != F.col("requirement_count")), "changed")
    )
    return current.join(old, "zone", "left").select("zone", reason.alias("reason")).filter(F.col("reason").isNotNull())


def source_verdicts(policies: DataFrame, requirements: DataFrame, principals: list[str]) -> DataFrame:
    """(source_id, allowed): fresh policy, and for a restricted source every requirement met.

    requirements(source_id, requirement, principal) holds one row per principal; a restricted source
    with no requirement row is denied.
    """
    met = (
        requirements.groupBy("source_id", "requirement")
        .agg(F.bool_or(F.col("principal").isin(principals)).alias("met"))
        .groupBy("source_id")
        .agg(F.bool_and("met").alias("all_met"))
    )
    fresh = policies.groupBy("source_id").agg(
        F.bool_and(F.col("stale_at").isNull()).alias("fresh"), F.bool_or("restricted").alias("restricted")
    )
    return fresh.join(met, "source_id", "left").select(
        "source_id", (F.col("fresh") & (~F.col("restricted") | F.coalesce("all_met", F.lit(False)))).alias("allowed")
    )


def all_sources_allowed(owners: DataFrame, verdicts: DataFrame, owner: str = "chunk_id") -> DataFrame:
    """Owners with at least one source whose sources are all allowed; an unknown source denies."""
    return (
        owners.join(verdicts, "source_id", "left")
        .groupBy(owner)
        .agg(F.bool_and(F.coalesce("allowed", F.lit(False))).alias("ok"))
        .filter("ok")
        .select(owner)
    )


def readable_sources(pages: DataFrame, visible: DataFrame, ids: DataFrame, owner: bool = False) -> DataFrame:
    """Live pages among `ids` the reader may open; an owner reads every live page."""
    live = pages.filter(F.col("deleted_at").isNull()).join(ids.select("page_id").distinct(), "page_id", "left_semi")
    return live.select("page_id") if owner else live.join(visible, "page_id", "left_semi").select("page_id")


def supplemental_access(first: DataFrame, second: DataFrame, restricted: DataFrame) -> DataFrame:
    """Pages readable by the first identity, or restricted and readable by the second."""
    return first.select("page_id").union(
        second.join(restricted.select("page_id"), "page_id", "left_semi").select("page_id")
    ).distinct()


def supplemental_pages(pages: DataFrame, access: DataFrame, grants: DataFrame, first, second) -> DataFrame:
    """`supplemental_access` of two readers; zones, chains and who passes them are found once for both.

    A restricted page is one in a zone, so what stays closed are the pages of zones that neither passes.
    """
    if access.isEmpty():
        return pages.select("page_id").distinct()
    zoned = cut_lineage(zones(pages, access).select("page_id", "zone"))
    passed = passing(restriction_chain(pages, access, zoned), grants.filter(F.col("user_id").isin(first, second)))
    closed = zoned.join(passed.select("zone"), "zone", "left_anti")
    return pages.select("page_id").join(closed.select("page_id"), "page_id", "left_anti").distinct()


def redact_metadata(chunks: DataFrame, page_sources: DataFrame, readable: DataFrame, contributions: DataFrame) -> DataFrame:
    """Title, body and key of a page only when all its sources are readable; otherwise the title comes
    from the chunk's own source contribution, and body and key are blank."""
    open_pages = all_sources_allowed(
        page_sources, readable.select("source_id", F.lit(True).alias("allowed")), "page_id"
    ).withColumn("open", F.lit(True))
    own = contributions.select("page_id", "source_id", F.col("title").alias("own_title"))
    shown = F.coalesce("open", F.lit(False))
    return (
        chunks.join(open_pages, "page_id", "left")
        .join(own, ["page_id", "source_id"], "left")
        .select(
            "chunk_id", "page_id",
            F.when(shown, F.col("title")).otherwise(F.coalesce("own_title", F.lit("Untitled"))).alias("title"),
            F.when(shown, F.col("body")).otherwise("").alias("body"),
            F.when(shown, F.col("canonical_key")).otherwise("").alias("canonical_key"),
        )
    )
