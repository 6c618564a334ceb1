from pyspark.sql import functions as F

from folioscope.operators import access as A
from folioscope.operators import search as S
from folioscope.operators import tree as T

TREE = [("root", None), ("mid", "root"), ("leaf", "mid"), ("other", "root"), ("solo", None)]


def _pages(rows, dead=()):
    return rows("page_id string, parent_id string, title string, deleted_at string", *[(p, q, p.upper(), "x" if p in dead else None) for p, q in TREE])


def _ids(df, name="page_id"):
    return sorted(r[name] for r in df.collect())


def _access(rows, *ids):
    return rows("page_id string", *[(i,) for i in ids])


def _grants(rows, *data):
    permissions = rows("page_id string, user_id string, group_id string, role string", *data)
    members = rows("group_id string, user_id string", ("g", "ann"), ("g", "bob"))
    return A.expand_principals(permissions, members)


def test_without_restriction_everything_is_visible(rows):
    pages = _pages(rows)
    got = A.visible_pages(pages, rows("page_id string"), _grants(rows, ("x", "u", None, "reader")), "ann")
    assert len(_ids(got)) == 5


def test_every_restricted_ancestor_has_to_grant(rows):
    pages, access = _pages(rows), _access(rows, "root", "leaf")
    grants = _grants(rows, ("root", None, "g", "reader"), ("leaf", "ann", None, "writer"))
    see = lambda user: {r["page_id"]: r["can_edit"] for r in A.visible_pages(pages, access, grants, user).collect()}
    assert see("ann") == {"root": False, "mid": False, "other": False, "leaf": True, "solo": True}
    assert see("bob") == {"root": False, "mid": False, "other": False, "solo": True}
    assert see("eve") == {"solo": True}


def test_restricting_a_page_never_adds_results(rows):
    pages, grants = _pages(rows), _grants(rows, ("root", "ann", None, "reader"))
    few = set(_ids(A.visible_pages(pages, _access(rows, "root", "mid"), grants, "ann")))
    more = set(_ids(A.visible_pages(pages, _access(rows, "root"), grants, "ann")))
    assert few < more


def test_levels_users_and_counts(rows, spark):
    pages, access = _pages(rows), _access(rows, "root", "leaf")
    grants = _grants(rows, ("root", None, "g", "reader"), ("leaf", "ann", None, "writer"))
    levels = {r["page_id"]: tuple(r)[1:] for r in A.access_levels(pages, access, grants, "ann").collect()}
    assert levels["leaf"] == (True, True, True, True)
    assert levels["mid"] == (False, True, True, False)
    assert levels["root"] == (True, False, True, False)
    assert levels["solo"] == (False, False, True, True)
    users = A.users_with_access(pages, access, grants, pages)
    assert sorted((r["page_id"], r["user_id"]) for r in users.filter("page_id = 'leaf'").collect()) == [("leaf", "ann")]
    counts = A.visible_counts(pages, access, grants, rows("user_id string", ("ann",), ("bob",), ("eve",)))
    assert {r["user_id"]: r["visible"] for r in counts.collect()} == {"ann": 5, "bob": 4, "eve": 1}


def test_sources_without_requirements_or_policy_deny(rows):
    policies = rows("source_id int, restricted boolean, stale_at string", (1, False, None), (2, True, None), (3, True, None), (4, False, "x"))
    requirements = rows("source_id int, requirement int, principal string", (2, 1, "u"), (2, 1, "v"), (2, 2, "g"))
    verdicts = {r["source_id"]: r["allowed"] for r in A.source_verdicts(policies, requirements, ["u", "g"]).collect()}
    assert verdicts == {1: True, 2: True, 3: False, 4: False}
    owners = rows("chunk_id string, source_id int", ("a", 1), ("a", 2), ("b", 1), ("b", 9), ("c", 3))
    ok = A.all_sources_allowed(owners, A.source_verdicts(policies, requirements, ["u", "g"]))
    assert _ids(ok, "chunk_id") == ["a"]


def test_policy_hash_follows_content_not_order(rows):
    chain = rows("zone string, required string, distance int", ("z", "z", 0), ("z", "r", 1))
    schema = "page_id string, user_id string, group_id string, role string"
    data = [("z", "u", None, "reader"), ("r", None, "g", "writer"), ("z", "w", None, "reader")]
    one = A.policy_snapshot(chain, rows(schema, *data)).first()
    two = A.policy_snapshot(chain, rows(schema, *reversed(data))).first()
    three = A.policy_snapshot(chain, rows(schema, *data[:2])).first()
    assert one["policy_hash"] == two["policy_hash"] != three["policy_hash"]
    assert (one["requirement_count"], one["principal_count"]) == (2, 3)


def test_trash_and_restore(rows):
    pages = _pages(rows)
    gone, shares = T.soft_delete(pages, _access(rows, "leaf", "solo"), _access(rows, "mid"), "now")
    assert _ids(gone.filter("deleted_at = 'now'")) == ["leaf", "mid"] and _ids(shares) == ["solo"]
    back = {r["page_id"]: (r["parent_id"], r["deleted_at"]) for r in T.restore(gone, _access(rows, "leaf")).collect()}
    assert back["leaf"] == (None, None) and back["mid"] == ("root", "now")
    assert _ids(T.deleted_roots(gone)) == ["mid"]
    assert _ids(T.purge(pages, _access(rows, "mid"))) == ["other", "root", "solo"]


def test_cycles_end(rows):
    pages = rows("page_id string, parent_id string, deleted_at string", ("a", "b", None), ("b", "a", None))
    assert _ids(T.descendants(pages, rows("page_id string", ("a",)))) == ["a", "b"]


def test_share_stops_at_the_nearest(rows):
    shares = rows("page_id string, share_id string, include_sub_pages boolean", ("root", "s1", True), ("mid", "s2", False))
    got = {r["page_id"]: r["share_id"] for r in T.share_for_page(_pages(rows), shares).collect()}
    assert got == {"root": "s1", "other": "s1", "mid": "s2"}


def test_export_paths_number_equal_titles(rows):
    pages = rows("page_id int, parent_id int, title string", (1, None, "A b"), (2, 1, "x"), (3, 1, "x"))
    got = {r["page_id"]: r["path"] for r in T.export_tree_paths(pages).collect()}
    assert got == {1: "A%20b", 2: "A%20b/x", 3: "A%20b/x%20%281%29"}


def test_redaction(rows):
    chunks = rows("chunk_id int, page_id int, source_id int, title string, body string, canonical_key string", (1, 1, 1, "T1", "b", "k"), (2, 2, 2, "T2", "b", "k"), (3, 2, 3, "T2", "b", "k"))
    bridge = rows("page_id int, source_id int", (1, 1), (2, 2), (2, 3))
    own = rows("page_id int, source_id int, title string", (2, 2, "mine"))
    got = {r["chunk_id"]: (r["title"], r["body"]) for r in A.redact_metadata(chunks, bridge, rows("source_id int", (1,), (2,)), own).collect()}
    assert got == {1: ("T1", "b"), 2: ("mine", ""), 3: ("Untitled", "")}


def test_a_restriction_holds_however_deep_a_page_lies(spark):
    pages = spark.range(1, 106).selectExpr("id as page_id", "nullif(id - 1, 0) as parent_id", "cast(null as string) as deleted_at")
    access = spark.createDataFrame([(1,)], "page_id long")
    grants = spark.createDataFrame([(1, "known", True)], "page_id long, user_id string, can_write boolean")
    assert A.visible_pages(pages, access, grants, "stranger").count() == 0
    assert A.visible_pages(pages, access, grants, "known").count() == 105


def test_walks_end_in_circles(rows):
    pages = rows("page_id int, parent_id int, deleted_at string", (1, 3, None), (2, 1, None), (3, 2, None), (4, 3, None), (5, 5, None))
    up = T.ancestors(pages, pages.select("page_id"))
    assert sorted(r["ancestor_id"] for r in up.filter("page_id = 4").collect()) == [1, 2, 3, 4]
    assert up.filter("page_id = 1").count() == 3 and up.filter("page_id = 5").count() == 1
    down = T.descendants(pages, rows("page_id int", (1,)))
    assert sorted(r["page_id"] for r in down.collect()) == [1, 2, 3, 4]


def test_search_ranks_what_the_reader_may_see(rows):
    pages = rows(
        "page_id int, title string, text string, space_id string, deleted_at string, creator_id int, updated_at int",
        *[(i, "t", "fährt über morgen die Brücke", "s", None, 1, i) for i in range(700)], (900, "知识图谱", "x", "s", None, 2, 5), (901, "a", "world, hello", "s", None, 2, 6),
    )
    seen = pages.filter("page_id >= 650").select("page_id")
    got = S.search_pages(pages, "über die", seen, limit=10).collect()
    assert len(got) == 10 and {r["total"] for r in got} == {50} and min(r["page_id"] for r in got) == 650
    ids = lambda q, **kw: sorted(r["page_id"] for r in S.search_pages(pages, q, pages.select("page_id"), limit=1000, **kw).collect())
    assert ids("world, hello") == ids("hello world") == [901] and ids("知识图") == [900] and ids(" ") == []
    assert len(ids("über b", creator_id=1, modified_from=10, modified_to=20)) == 10
    assert ids("hello", titles_only=True) == [] and ids("hello", page_ids=rows("page_id int", (3,))) == []


def test_policy_hash_changes_when_requirements_swap_and_not_with_the_order_of_rows(rows):
    from folioscope.operators import access as AC

    permissions = rows("page_id int, user_id int, group_id int, role string", *[(10, u, None, "reader") for u in range(50)], (11, None, 7, "writer"), (12, None, None, "reader"))
    chain = rows("zone int, required int, distance int", (1, 10, 0), (1, 11, 1), (2, 11, 0), (2, 10, 1), (3, 12, 0), (4, 10, 0), (4, 11, 1))
    got = {r["zone"]: r for r in AC.policy_snapshot(chain, permissions).collect()}
    assert got[1]["policy_hash"] != got[2]["policy_hash"] and got[1]["policy_hash"] == got[4]["policy_hash"]
    assert (got[1]["requirement_count"], got[1]["principal_count"], got[3]["principal_count"]) == (2, 51, 0)
    again = {r["zone"]: r["policy_hash"] for r in AC.policy_snapshot(chain.orderBy(F.desc("required")), permissions.orderBy(F.desc("user_id")).union(permissions)).collect()}
    assert again == {z: r["policy_hash"] for z, r in got.items()}
    listed = AC.policy_requirements(chain, permissions).filter("zone = 1").orderBy("distance", "required", "principal").collect()
    assert len(listed) == 51 and listed[-1]["principal"] == "group:7"


def test_nested_objects(rows):
    from folioscope.operators.members import nested

    pages = rows("page_id int, creator_id int", (1, 5), (2, 9), (3, None))
    users = rows("id int, name string", (5, "Ann"))
    labels = rows("page_id int, label string", (1, "b"), (1, "a"))
    files = rows("page_id int, size int, file string", (1, 2, "x"), (2, 1, None), (9, 1, "z"))
    got = {r["page_id"]: r for r in nested(pages, "page_id", {"creator": ("creator_id", users)}, {"labels": labels, "files": files}).collect()}
    assert got[1]["creator"]["name"] == "Ann" and got[2]["creator"] is None and got[3]["creator"] is None
    assert [r["label"] for r in got[1]["labels"]] == ["a", "b"] and got[3]["labels"] == [] == got[3]["files"]
    assert [tuple(r) for r in got[2]["files"]] == [(1, None)]


def test_groups_are_spread_only_where_nothing_narrower_is_required(rows, monkeypatch):
    monkeypatch.setattr(A, "PAIRS", 2)
    pages, access = _pages(rows), _access(rows, "root", "leaf", "other")
    permissions = rows(
        "page_id string, user_id string, group_id string, role string",
        ("root", None, "g", "reader"), ("root", "dan", None, "reader"), ("leaf", "ann", None, "writer"), ("leaf", "eve", None, "reader"), ("leaf", None, "empty", "reader"),
    )
    members = rows("group_id string, user_id string", ("g", "ann"), ("g", "bob"))
    users = rows("user_id string", ("ann",), ("bob",), ("dan",), ("eve",))
    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    want = [("leaf", "ann"), *[(page, user) for page in ("mid", "root") for user in ("ann", "bob", "dan")]]
    assert pairs(A.users_with_access(pages, access, permissions, pages, memberships=members)) == want
    assert pairs(A.users_with_access(pages, access, permissions, pages, users, members)) == want + [("solo", u) for u in ("ann", "bob", "dan", "eve")]
    counts = A.visible_counts(pages, access, permissions, users, members)
    assert pairs(counts) == [("ann", 4), ("bob", 3), ("dan", 3), ("eve", 1)]


def test_supplemental_pages_find_zones_once_for_both_readers(spark, rows, monkeypatch):
    from folioscope.operators import access as AC
    from folioscope.plans import catalog

    pages = rows("page_id string, parent_id string", ("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", "d"), ("f", None), ("g", "f"))
    access = rows("page_id string", ("b",), ("d",), ("e",), ("f",))
    grants = rows("page_id string, user_id long, can_write boolean", ("b", 1, False), ("d", 1, True), ("d", 2, False), ("e", 2, False), ("f", 3, False))
    seen = lambda user: AC.visible_pages(pages, access, grants, user)
    want = AC.supplemental_access(seen(1), seen(2), AC.zones(pages, access))
    ids = lambda df: sorted(r["page_id"] for r in df.collect())
    assert ids(AC.supplemental_pages(pages, access, grants, 1, 2)) == ids(want) == ["a", "b", "c", "d", "e"]
    assert ids(AC.supplemental_pages(pages, access.limit(0), grants, 1, 2)) == ids(pages)
    calls, real = [], AC.zones
    monkeypatch.setattr(AC, "zones", lambda *args: calls.append(1) or real(*args))
    catalog.QUERIES["supplemental_access"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
