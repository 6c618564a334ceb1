"""Registered queries: trees, access, membership and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import access as AC
from folioscope.operators import members as M
from folioscope.operators import paging as P
from folioscope.operators import tree as T
from folioscope.plans import stage as S
from folioscope.plans.registry import plan, table

READER = 7


def _roots(pages, letter):
    return pages.filter(F.col("page_id").startswith(letter)).select("page_id")


@plan(f"""{S.WITH_TREE} select anc as root, count(*) as pages, max(depth)::bigint as height from up where anc like 'n%' group by 1""")
def tree_descendants(spark, sf):
    pages = S.tree_pages(spark, sf)
    return T.descendants(pages, _roots(pages, "n")).groupBy("root").agg(
        F.count("*").alias("pages"), F.max("depth").cast("long").alias("height")
    )


@plan(f"""with recursive {S.TREE_SQL}, down as (select page_id, page_id as root from tree where page_id like 'r%'
 union all select t.page_id, d.root from down d join tree t on t.parent_id = d.page_id and t.deleted_at is null)
select root, count(*) as pages from down group by 1""")
def tree_descendants_live(spark, sf):
    pages = S.tree_pages(spark, sf)
    return T.descendants(pages, _roots(pages, "r"), live_only=True).groupBy("root").agg(F.count("*").alias("pages"))


@plan(f"{S.WITH_TREE} select page_id, anc as ancestor_id, depth from up")
def tree_ancestors(spark, sf):
    pages = S.tree_pages(spark, sf)
    return T.ancestors(pages, pages)


@plan(f"""with recursive {S.TREE_SQL}, trail as (select page_id, 0 as depth, title as trail from tree where parent_id is null
 union all select t.page_id, p.depth + 1, p.trail || ' / ' || t.title from trail p join tree t on t.parent_id = p.page_id) select * from trail""")
def breadcrumbs(spark, sf):
    return T.breadcrumbs(S.tree_pages(spark, sf))


@plan(f"with {S.TREE_SQL} select page_id, page_id in (select parent_id from tree where parent_id is not null) as has_children from tree")
def has_children(spark, sf):
    pages = S.tree_pages(spark, sf)
    return T.with_has_children(pages.select("page_id"), pages)


@plan(f"""{S.WITH_TREE}, pairs as (select distinct 'o' || l_orderkey as page_id, 'c' || l_suppkey as other_id from lineitem
 union select 'o' || o_orderkey, 'c' || o_custkey from orders)
select p.page_id, p.other_id, u.anc is not null as related from pairs p left join up u on u.page_id = p.page_id and u.anc = p.other_id""")
def self_or_ancestor(spark, sf):
    pairs = table(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey").alias("page_id"), F.concat(F.lit("c"), "l_suppkey").alias("other_id")
    ).union(
        table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"))
    ).distinct()
    return T.is_self_or_ancestor(S.tree_pages(spark, sf), pairs)


def _trash(spark, sf):
    return table(spark, sf, "customer").filter(F.col("c_mktsegment") == "FURNITURE").select(
        F.concat(F.lit("c"), "c_custkey").alias("page_id")
    )


TRASH = "trash as (select 'c' || c_custkey as page_id from customer where c_mktsegment = 'FURNITURE')"


@plan(f"""with recursive {S.TREE_SQL}, {TRASH}, gone as (select page_id from tree where deleted_at is null and page_id in (select page_id from trash)
 union all select t.page_id from gone g join tree t on t.parent_id = g.page_id and t.deleted_at is null)
select page_id, case when page_id in (select page_id from gone) then '2001-01-01' else deleted_at end as deleted_at from tree""")
def tree_soft_delete(spark, sf):
    pages = S.tree_pages(spark, sf)
    shares = pages.select("page_id")
    return T.soft_delete(pages, shares, _trash(spark, sf), "2001-01-01")[0].select("page_id", "deleted_at")


@plan(f"""with recursive {S.TREE_SQL}, top as (select page_id from tree where page_id like 'o%' and deleted_at is not null),
back as (select page_id from tree where page_id in (select page_id from top) union all select t.page_id from back b join tree t on t.parent_id = b.page_id)
select t.page_id, case when t.page_id in (select page_id from top) and p.deleted_at is not null then null else t.parent_id end as parent_id,
case when t.page_id in (select page_id from back) then null else t.deleted_at end as deleted_at from tree t left join tree p on p.page_id = t.parent_id""")
def tree_restore(spark, sf):
    pages = S.tree_pages(spark, sf)
    roots = pages.filter(F.col("page_id").startswith("o") & F.col("deleted_at").isNotNull())
    return T.restore(pages, roots).select("page_id", "parent_id", "deleted_at")


@plan(f"""{S.WITH_TREE}, {TRASH} select page_id from tree where page_id not in (select u.page_id from up u join trash t on t.page_id = u.anc)""")
def tree_purge(spark, sf):
    return T.purge(S.tree_pages(spark, sf), _trash(spark, sf)).select("page_id")


@plan(f"""with {S.TREE_SQL} select t.page_id, t.parent_id from tree t left join tree p on p.page_id = t.parent_id
where t.deleted_at is not null and p.deleted_at is null""")
def trash_roots(spark, sf):
    return T.deleted_roots(S.tree_pages(spark, sf)).select("page_id", "parent_id")


def _shares(spark, sf):
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    return customer.filter(F.col("c_mktsegment") == "AUTOMOBILE").select(
        F.concat(F.lit("c"), "c_custkey").alias("page_id"),
        F.concat(F.lit("share-c"), "c_custkey").alias("share_id"),
        (F.col("c_acctbal") > 4000).alias("include_sub_pages"),
    ).union(
        nation.filter(F.col("n_name").endswith("3")).select(
            F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("share-n"), "n_nationkey"), F.lit(True)
        )
    )


SHARES = """shares as (select 'c' || c_custkey as page_id, 'share-c' || c_custkey as share_id, c_acctbal > 4000 as inc from customer where c_mktsegment = 'AUTOMOBILE'
 union all select 'n' || n_nationkey, 'share-n' || n_nationkey, true from nation where n_name like '%3')"""


@plan(f"""{S.WITH_TREE}, {SHARES}, near as (select u.page_id, min_by(s.share_id, u.depth) as share_id, min_by(s.inc, u.depth) as inc, min(u.depth) as level
 from up u join shares s on s.page_id = u.anc group by 1) select page_id, share_id, level from near where level = 0 or inc""")
def share_nearest(spark, sf):
    return T.share_for_page(S.tree_pages(spark, sf), _shares(spark, sf))


@plan(f"""{S.WITH_TREE}, pairs as (select 'o' || o_orderkey as page_id, 'n' || c_nationkey as top_id from orders join customer on c_custkey = o_custkey where o_orderstatus = 'F')
select p.page_id, p.top_id, u.anc as ancestor_id, u.depth from pairs p join up u on u.page_id = p.page_id join up e on e.page_id = p.page_id and e.anc = p.top_id
where u.depth <= e.depth""")
def share_path(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    pairs = orders.filter(F.col("o_orderstatus") == "F").join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    ).select(F.concat(F.lit("o"), "o_orderkey").alias("page_id"), F.concat(F.lit("n"), "c_nationkey").alias("top_id"))
    return T.path_between(S.tree_pages(spark, sf), pairs)


def _grants(spark, sf):
    return AC.expand_principals(S.tree_permissions(spark, sf), S.tree_memberships(spark, sf))


def _visible(spark, sf):
    return AC.visible_pages(S.tree_pages(spark, sf), S.tree_access(spark, sf), _grants(spark, sf), READER)


VISIBLE = f"""verdict as (select n.page_id, bool_and(g.user_id is not null) as ok, min_by(coalesce(g.can_write, false), n.depth) as edit
 from needed n left join grants g on g.page_id = n.anc and g.user_id = {READER} group by 1),
visible as (select t.page_id, coalesce(v.edit, true) as can_edit from tree t left join verdict v using (page_id) where coalesce(v.ok, true))"""


@plan(f"{S.WITH_ACCESS}, {VISIBLE} select page_id, can_edit from visible")
def acl_visible(spark, sf):
    return _visible(spark, sf)


@plan(f"""{S.WITH_ACCESS}, {VISIBLE}, r as (select page_id, bool_or(depth = 0) as direct, bool_or(depth > 0) as inherited from needed group by 1)
select t.page_id, coalesce(r.direct, false) as direct_restriction, coalesce(r.inherited, false) as inherited_restriction,
coalesce(v.ok, true) as can_access, coalesce(v.ok and v.edit, true) as can_edit
from tree t left join r using (page_id) left join verdict v using (page_id)""")
def acl_levels(spark, sf):
    return AC.access_levels(S.tree_pages(spark, sf), S.tree_access(spark, sf), _grants(spark, sf), READER)


NATION = "NATION_7"


@plan(f"""{S.WITH_ACCESS}, per as (select n.page_id, count(*) as needed_n from needed n group by 1),
ok as (select n.page_id, g.user_id from needed n join grants g on g.page_id = n.anc join per p on p.page_id = n.page_id group by n.page_id, g.user_id, needed_n having count(*) = needed_n),
opened as (select user_id, count(*) as n from ok group by 1)
select s_suppkey as user_id, (select count(*) from tree) - (select count(*) from per) + coalesce(n, 0) as visible from supplier left join opened on user_id = s_suppkey""")
def acl_visible_counts(spark, sf):
    users = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return AC.visible_counts(S.tree_pages(spark, sf), S.tree_access(spark, sf), S.tree_permissions(spark, sf), users, S.tree_memberships(spark, sf))


@plan(f"""{S.WITH_ACCESS}, per as (select n.page_id, count(*) as needed_n from needed n group by 1)
select n.page_id, g.user_id from needed n join grants g on g.page_id = n.anc join per p on p.page_id = n.page_id group by n.page_id, g.user_id, needed_n having count(*) = needed_n""")
def users_with_access(spark, sf):
    pages = S.tree_pages(spark, sf)
    return AC.users_with_access(pages, S.tree_access(spark, sf), S.tree_permissions(spark, sf), pages, memberships=S.tree_memberships(spark, sf))


NATION = "NATION_7"


@plan(f"""{S.WITH_ACCESS}, per as (select n.page_id, count(*) as needed_n from needed n group by 1),
ok as (select n.page_id, g.user_id from needed n join grants g on g.page_id = n.anc join per p on p.page_id = n.page_id group by n.page_id, g.user_id, needed_n having count(*) = needed_n)
select t.page_id, s_suppkey as user_id from tree t, supplier join nation on n_nationkey = s_nationkey where n_name = '{NATION}' and (t.page_id not in (select page_id from per) or (t.page_id, s_suppkey) in (select (page_id, user_id) from ok))""")
def users_with_access_listed(spark, sf):
    """Every page with its readers among the users of one country, open pages included."""
    pages = S.tree_pages(spark, sf)
    nation = table(spark, sf, "nation").filter(F.col("n_name") == NATION).select(F.col("n_nationkey").alias("s_nationkey"))
    users = table(spark, sf, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("user_id"))
    return AC.users_with_access(pages, S.tree_access(spark, sf), S.tree_permissions(spark, sf), pages, users, S.tree_memberships(spark, sf))


@plan(f"""{S.WITH_ACCESS} select distinct u.page_id, u.anc as root from up u join needed n using (page_id) where u.anc like 'r%'""")
def restricted_subtree(spark, sf):
    pages = S.tree_pages(spark, sf)
    return AC.restricted_subtree(pages, S.tree_access(spark, sf), _roots(pages, "r")).select("page_id", "root")


@plan(f"""{S.WITH_ACCESS} select u.page_id, u.anc as root from up u where u.anc like 'r%' and u.page_id not in (select page_id from needed)""")
def descendants_unrestricted(spark, sf):
    pages = S.tree_pages(spark, sf)
    return AC.unrestricted_descendants(pages, S.tree_access(spark, sf), _roots(pages, "r")).select("page_id", "root")


@plan(f"""{S.WITH_ACCESS}, {VISIBLE} select distinct parent_id as page_id from tree where deleted_at is null and parent_id is not null and page_id in (select page_id from visible)""")
def parents_with_children(spark, sf):
    return AC.parents_with_visible_children(S.tree_pages(spark, sf), _visible(spark, sf))


@plan(f"""{S.WITH_ACCESS}, {VISIBLE}, kept as (select u.page_id, max(u.depth) as depth, bool_and(v.page_id is not null) as ok from up u left join visible v on v.page_id = u.anc group by 1)
select page_id, depth from kept where ok""")
def export_closure(spark, sf):
    return T.export_closure(S.tree_pages(spark, sf), _visible(spark, sf))


@plan(f"""with recursive {S.TREE_SQL}, named as (select page_id, parent_id, replace(url_encode(title || case when row_number() over w > 1 then ' (' || (row_number() over w - 1) || ')' else '' end), '+', '%20') as name
 from tree window w as (partition by parent_id, title order by page_id)),
paths as (select page_id, name as path from named where parent_id is null union all select n.page_id, p.path || '/' || n.name from paths p join named n on n.parent_id = p.page_id)
select page_id, replace(replace(path, '%28', '('), '%29', ')') as path from paths""")
def export_paths(spark, sf):
    out = T.export_tree_paths(S.tree_pages(spark, sf))
    return out.withColumn("path", F.replace(F.replace("path", F.lit("%28"), F.lit("(")), F.lit("%29"), F.lit(")")))


POLICY = """chain as (select n.page_id as zone, n.anc as required, row_number() over (partition by n.page_id order by n.depth) - 1 as distance from needed n where n.page_id in (select page_id from restricted)),
held as (select distinct page_id, coalesce('user:' || user_id, 'group:' || group_id) as principal, role from permission where user_id is not null or group_id is not null),
prows as (select c.zone, c.required, c.distance, principal, role, case when principal is not null then sha256(concat_ws('|', principal, role)) end as entry from chain c left join held p on p.page_id = c.required),
slots as (select zone, required, distance, substr(entry, 1, 3) as slot, count(entry) as n, sha256(coalesce(string_agg(entry, ',' order by entry), '')) as hash from prows group by all),
reqs as (select zone, distance, sum(n) as n, sha256(concat_ws('|', required, sum(n), string_agg(concat_ws(':', slot, hash), ',' order by slot))) as hash from slots group by zone, distance, required),
policy as (select zone, (max(distance) + 1)::bigint as requirement_count, sum(n)::bigint as principal_count, sha256(string_agg(hash, ',' order by distance)) as policy_hash from reqs group by 1)"""


@plan(f"{S.WITH_ACCESS}, {POLICY} select zone, distance, required, principal, role from prows")
def policy_requirements(spark, sf):
    pages, access = S.tree_pages(spark, sf), S.tree_access(spark, sf)
    chain = AC.restriction_chain(pages, access, AC.zones(pages, access))
    return AC.policy_requirements(chain, S.tree_permissions(spark, sf)).withColumn("distance", F.col("distance").cast("long"))


@plan(f"{S.WITH_ACCESS}, {POLICY} select * from policy")
def policy_snapshot(spark, sf):
    return _policy(spark, sf)


def _policy(spark, sf):
    pages, access = S.tree_pages(spark, sf), S.tree_access(spark, sf)
    chain = AC.restriction_chain(pages, access, AC.zones(pages, access))
    return AC.policy_snapshot(chain, S.tree_permissions(spark, sf))


@plan(f"""{S.WITH_ACCESS}, {POLICY}, aged as (select zone, case when principal_count > 4 then 'other' else policy_hash end as policy_hash, requirement_count, case when principal_count = 1 then '1999' end as stale_at from policy where principal_count > 0)
select p.zone, case when a.policy_hash is null then 'missing' when a.stale_at is not null then 'stale' else 'changed' end as reason
from policy p left join aged a using (zone) where a.policy_hash is null or a.stale_at is not null or a.policy_hash <> p.policy_hash""")
def policy_drift(spark, sf):
    now = _policy(spark, sf)
    stored = now.filter(F.col("principal_count") > 0).select(
        "zone",
        F.when(F.col("principal_count") > 4, "other").otherwise(F.col("policy_hash")).alias("policy_hash"),
        "requirement_count",
        F.when(F.col("principal_count") == 1, "1999").alias("stale_at"),
    )
    return AC.policy_drift(now, stored)


def _verdicts(spark, sf):
    """Sources are parts, requirements their brand and type groups."""
    part = table(spark, sf, "part")
    policies = part.filter(F.col("p_size") > 1).select(
        F.col("p_partkey").alias("source_id"),
        (F.col("p_type") != "STANDARD").alias("restricted"),
        F.when(F.col("p_size") > 48, F.lit("1999")).alias("stale_at"),
    )
    requirements = part.filter(F.col("p_retailprice") > 905).select(
        F.col("p_partkey").alias("source_id"),
        F.inline(
            F.array(
                F.struct(F.lit("brand").alias("requirement"), F.col("p_brand").alias("principal")),
                F.struct(F.lit("type").alias("requirement"), F.col("p_type").alias("principal")),
            )
        ),
    )
    principals = ["ECONOMY", "PROMO", *[f"Brand#{i}" for i in range(1, 20)]]
    return AC.source_verdicts(policies, requirements, principals)


MINE = "mine as (select unnest(['ECONOMY', 'PROMO'] || [('Brand#' || i) for i in range(1, 20)]) as principal)"
VERDICTS = f"""{MINE}, verdicts as (select p_partkey as source_id, p_size <= 48 and (p_type = 'STANDARD' or
 (p_retailprice > 905 and p_brand in (select principal from mine) and p_type in (select principal from mine))) as allowed from part where p_size > 1)"""


@plan(f"""with {VERDICTS} select l_orderkey as chunk_id from lineitem left join verdicts on source_id = l_partkey group by 1 having bool_and(coalesce(allowed, false))""")
def authorized_chunks(spark, sf):
    owners = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("source_id")
    )
    return AC.all_sources_allowed(owners, _verdicts(spark, sf))


@plan(f"""{S.WITH_ACCESS}, {VISIBLE} select page_id from tree where deleted_at is null and page_id in (select page_id from visible)
 and page_id in (select 'o' || l_orderkey from lineitem where l_returnflag = 'R')""")
def readable_sources(spark, sf):
    ids = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.concat(F.lit("o"), "l_orderkey").alias("page_id")
    )
    return AC.readable_sources(S.tree_pages(spark, sf), _visible(spark, sf), ids)


@plan(f"""{S.WITH_ACCESS}, {VISIBLE}, other as (select n.page_id from needed n left join grants g on g.page_id = n.anc and g.user_id = 3 group by 1 having bool_and(g.user_id is not null))
select page_id from visible union select page_id from other""")
def supplemental_access(spark, sf):
    pages, access, grants = S.tree_pages(spark, sf), S.tree_access(spark, sf), _grants(spark, sf)
    return AC.supplemental_pages(pages, access, grants, READER, 3)


@plan(f"""with {VERDICTS}, ps as (select distinct l_orderkey as page_id, l_partkey as source_id from lineitem),
open as (select page_id from ps left join verdicts using (source_id) group by 1 having bool_and(coalesce(allowed, false)))
select l_orderkey || '-' || l_linenumber || '-' || l_partkey as chunk_id, l_orderkey as page_id, case when o.page_id is not null then o_orderpriority
 else coalesce(p_name, 'Untitled') end as title, case when o.page_id is not null then o_orderstatus else '' end as body, case when o.page_id is not null then 'k' || o_custkey else '' end as canonical_key
from lineitem join orders on o_orderkey = l_orderkey left join open o on o.page_id = l_orderkey left join part on p_partkey = l_partkey and p_size > 10""")
def metadata_redaction(spark, sf):
    line, orders, part = (table(spark, sf, n) for n in ("lineitem", "orders", "part"))
    chunks = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("chunk_id"),
        F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("source_id"),
        F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("body"),
        F.concat(F.lit("k"), "o_custkey").alias("canonical_key"),
    )
    bridge = line.select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("source_id")).distinct()
    titles = bridge.join(
        part.filter(F.col("p_size") > 10).select(F.col("p_partkey").alias("source_id"), F.col("p_name").alias("title")), "source_id"
    )
    readable = _verdicts(spark, sf).filter("allowed").select("source_id")
    return AC.redact_metadata(chunks, bridge, readable, titles)


# --- membership ---------------------------------------------------------------------------------------


def _space_users(spark, sf):
    line, orders, customer, nation, supplier = (
        table(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation", "supplier")
    )
    direct = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .filter(F.col("l_quantity") > 45)
        .select(
            F.col("c_nationkey").alias("space_id"), F.col("l_suppkey").alias("user_id"),
            F.when(F.col("l_returnflag") == "A", "writer").otherwise("reader").alias("role"),
        )
    )
    group_spaces = nation.select(
        F.col("n_nationkey").alias("space_id"), F.col("n_regionkey").alias("group_id"),
        F.when(F.col("n_name").endswith("1"), "admin").otherwise("reader").alias("role"),
    )
    members = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("group_id"), F.col("s_suppkey").alias("user_id")
    )
    return M.space_users(direct, group_spaces, members)


SPACE_USERS = """su as (select c_nationkey as space_id, l_suppkey as user_id, case when l_returnflag = 'A' then 'writer' else 'reader' end as role
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_quantity > 45
 union all select n.n_nationkey, s_suppkey, case when n.n_name like '%1' then 'admin' else 'reader' end from nation n join nation m on m.n_regionkey = n.n_regionkey join supplier on s_nationkey = m.n_nationkey)"""


@plan(f"with {SPACE_USERS} select space_id, count(distinct user_id) as members from su group by 1")
def member_counts(spark, sf):
    return M.member_counts(_space_users(spark, sf))


@plan(f"with {SPACE_USERS} select space_id, user_id, case max(case role when 'admin' then 3 when 'writer' then 2 else 1 end) when 3 then 'admin' when 2 then 'writer' else 'reader' end as role from su group by 1, 2")
def highest_role(spark, sf):
    return M.highest_role(_space_users(spark, sf))


@plan("""with pw as (select distinct l_orderkey as page_id, l_suppkey as user_id from lineitem), sw as (select o_orderkey as page_id, s_suppkey as user_id from orders join customer on c_custkey = o_custkey join supplier on s_nationkey = c_nationkey),
muted as (select l_orderkey as page_id, l_suppkey as user_id from lineitem where l_returnflag = 'R')
select * from (select * from pw union select * from sw) except select * from muted""")
def recipients(spark, sf):
    line, orders, customer, supplier = (table(spark, sf, n) for n in ("lineitem", "orders", "customer", "supplier"))
    pair = [F.col("l_orderkey").alias("page_id"), F.col("l_suppkey").alias("user_id")]
    pages = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("page_id"), F.col("c_nationkey").alias("space_id"))
    watchers = supplier.select(F.col("s_nationkey").alias("space_id"), F.col("s_suppkey").alias("user_id"))
    return M.recipients(line.select(*pair), pages, watchers, line.filter(F.col("l_returnflag") == "R").select(*pair))


@plan(f"""with {SPACE_USERS}, top as (select space_id, user_id, max(case role when 'admin' then 3 when 'writer' then 2 else 1 end) as rank from su group by 1, 2),
rows as (select 's' || user_id as id, s_name as name, rank, 0 as is_group from top join supplier on s_suppkey = user_id where space_id = 1
 union all select 'g' || n_regionkey, 'Region ' || n_regionkey, case when n_name like '%1' then 3 else 1 end, 1 from nation where n_nationkey = 1)
select id, name, case rank when 3 then 'admin' when 2 then 'writer' else 'reader' end as role, row_number() over (order by rank desc, is_group desc, name, id) as position from rows order by position limit 100""")
def member_order(spark, sf):
    from pyspark.sql.window import Window

    users = M.highest_role(_space_users(spark, sf)).filter(F.col("space_id") == 1).join(
        table(spark, sf, "supplier"), F.col("user_id") == F.col("s_suppkey")
    ).select(F.concat(F.lit("s"), "user_id").alias("id"), F.col("s_name").alias("name"), "role", F.lit(0).alias("is_group"))
    groups = table(spark, sf, "nation").filter(F.col("n_nationkey") == 1).select(
        F.concat(F.lit("g"), "n_regionkey").alias("id"), F.concat(F.lit("Region "), "n_regionkey").alias("name"),
        F.when(F.col("n_name").endswith("1"), "admin").otherwise("reader").alias("role"), F.lit(1).alias("is_group"),
    )
    page = P.offset_page(users.unionByName(groups), M.member_order(), 1, 100)
    return page.withColumn("position", F.row_number().over(Window.orderBy(*M.member_order()))).drop("is_group")


@plan(f"""with {SPACE_USERS}, notes as (select l_suppkey as user_id, c_nationkey as space_id from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey where l_linestatus = 'O')
select user_id, count(*) as unread from notes where (space_id, user_id) in (select space_id, user_id from su) group by 1""")
def unread_counts(spark, sf):
    line, orders, customer = (table(spark, sf, n) for n in ("lineitem", "orders", "customer"))
    notes = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.col("l_suppkey").alias("user_id"), F.col("c_nationkey").alias("space_id"),
        F.when(F.col("l_linestatus") == "F", F.lit("read")).alias("read_at"),
    )
    return M.unread_counts(notes, _space_users(spark, sf))


@plan("""with marks as (select doc_id, 'quality-' || quality as label from labels union all select doc_id, 'toxic-' || toxic from labels)
select label, count(*) as pages from marks join documents using (doc_id) where lang <> 'es' group by 1""")
def label_page_counts(spark, sf):
    return M.label_page_counts(_page_labels(spark, sf), _doc_pages(spark, sf))


def _page_labels(spark, sf):
    labels = table(spark, sf, "labels")
    return labels.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("quality-"), "quality").alias("label")).union(
        labels.select("doc_id", F.concat(F.lit("toxic-"), "toxic"))
    )


def _doc_pages(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("space_id"), "n_chars",
        F.when(F.col("lang") == "es", F.lit("1999")).alias("deleted_at"),
    )


@plan("""with marks as (select doc_id, 'quality-' || quality as label from labels union select doc_id, 'toxic-' || toxic from labels)
select doc_id as page_id, source as space_id, string_agg(label, ',' order by label) as labels from documents left join marks using (doc_id) group by 1, 2""")
def pages_with_labels(spark, sf):
    return M.with_labels(_doc_pages(spark, sf), _page_labels(spark, sf)).select(
        "page_id", "space_id", F.array_join("labels", ",").alias("labels")
    )


@plan("""with lab as (select l_orderkey as id, string_agg(distinct l_returnflag, ',' order by l_returnflag) as labels from lineitem group by 1),
lin as (select l_orderkey as id, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' order by l_linenumber, l_partkey, l_suppkey) as lines from lineitem group by 1)
select o.o_orderkey as page_id, c_custkey::varchar || '/' || c_acctbal as creator, n_name as space, q.o_orderpriority as parent, coalesce(labels, '') as labels, coalesce(lines, '') as lines
from orders o left join customer on c_custkey = o.o_custkey left join nation on n_nationkey = o.o_custkey % 25 left join orders q on q.o_orderkey = o.o_orderkey // 2 and o.o_orderkey > 0 left join lab on lab.id = o.o_orderkey left join lin on lin.id = o.o_orderkey""")
def page_objects(spark, sf):
    """Orders as pages: customer, nation and parent page inside as objects, flags and lines as ordered lists."""
    orders, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    pages = orders.select(
        F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("creator_id"), (F.col("o_custkey") % 25).cast("int").alias("space_id"),
        F.when(F.col("o_orderkey") > 0, F.floor(F.col("o_orderkey") / 2)).alias("parent_id"), F.col("o_orderpriority").alias("title"),
    )
    out = M.nested(
        pages, "page_id",
        one={
            "creator": ("creator_id", table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))),
            "space": ("space_id", table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))),
            "parent": ("parent_id", pages.select(F.col("page_id").alias("id"), "title")),
        },
        many={
            "labels": line.select(F.col("l_orderkey").alias("page_id"), F.col("l_returnflag").alias("name")).distinct(),
            "lines": line.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")),
        },
    )
    listed = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["no"], x["part"], x["supplier"])), ",")
    return out.select(
        "page_id", F.concat(F.col("creator.id").cast("string"), F.lit("/"), F.col("creator.balance").cast("string")).alias("creator"), F.col("space.name").alias("space"), F.col("parent.title").alias("parent"),
        F.array_join(F.transform("labels", lambda x: x["name"]), ",").alias("labels"), listed.alias("lines"),
    )


@plan("""with c as (select conv_id * 1000 + turn as comment_id, case when turn > 0 then conv_id * 1000 + (turn // 2) end as parent_id, role as user_id from conversations),
f as (select p.comment_id, count(*) as n, bool_or(r.user_id <> p.user_id) as others from c p join c r on r.parent_id = p.comment_id group by 1)
select comment_id, coalesce(n, 0) > 0 as has_replies, coalesce(others, false) as has_replies_by_others from c left join f using (comment_id)""")
def reply_flags(spark, sf):
    comments = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("parent_id"),
        F.col("role").alias("user_id"),
    )
    return M.reply_flags(comments)


def _links(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey").alias("from_id"), F.concat(F.lit("c"), "l_suppkey").alias("to_id")
    )


@plan(f"""{S.WITH_ACCESS}, {VISIBLE}, links as (select distinct 'o' || l_orderkey as from_id, 'c' || l_suppkey as to_id from lineitem),
live as (select page_id from tree where deleted_at is null and page_id in (select page_id from visible))
select to_id as page_id, count(*) as backlinks from links where from_id in (select page_id from live) group by 1""")
def backlink_counts(spark, sf):
    return M.backlink_counts(_links(spark, sf), S.tree_pages(spark, sf), _visible(spark, sf))


@plan(f"""{S.WITH_ACCESS}, {VISIBLE}, links as (select distinct 'o' || l_orderkey as from_id, 'c' || l_suppkey as to_id from lineitem),
live as (select page_id from tree where deleted_at is null and page_id in (select page_id from visible))
select from_id as page_id, to_id as other_id from links where to_id in (select page_id from live)""")
def outgoing_links(spark, sf):
    return M.backlinks(_links(spark, sf), S.tree_pages(spark, sf), _visible(spark, sf), incoming=False)


@plan(f"""{S.WITH_ACCESS}, {VISIBLE} select distinct l_partkey as block_id, 'o' || l_orderkey as page_id from lineitem where 'o' || l_orderkey in
 (select page_id from tree where deleted_at is null and page_id in (select page_id from visible))""")
def block_references(spark, sf):
    embeds = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("block_id"), F.concat(F.lit("o"), "l_orderkey").alias("page_id")
    )
    return M.block_references(embeds, S.tree_pages(spark, sf), _visible(spark, sf))
