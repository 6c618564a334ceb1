import re

from folioscope.llm import licenses, plans

SMALL = "/root/testdata/sf0.001"


def slow_sentences(text):
    out = []
    for piece in re.split(r"(?<=[.!?])(?<!\bv\.)[ \t-\r]+|\n[ \t\x0b-\r]*\n[ \t-\r]*", text or ""):
        form = licenses.plain(piece)
        for x in [form] if form in licenses.KNOWN else map(licenses.plain, piece.split("\n")):
            if x in licenses.KNOWN:
                out.append(licenses.KNOWN[x])
    return out


def slow_licences(names):
    line = [n for i, n in enumerate(names) if i == 0 or names[i - 1] != n]
    held = {k for k, rules in licenses.RULES.items() for r in rules for i in range(len(line)) if line[i : i + len(r)] == r}
    return sorted(held - {k for k, w in licenses.WIDER.items() if w in held})


def test_names_and_triggers_hold():
    assert len(licenses.KNOWN) == len(licenses.SENTENCES)
    assert list(licenses.RULES) == sorted(licenses.RULES)
    assert all(n in licenses.SENTENCES for rules in licenses.RULES.values() for r in rules for n in r)
    assert all(re.search(licenses.TRIGGER, s) for s in licenses.KNOWN)


def test_query_matches_brute_force(spark):
    got = {r["doc_id"]: (r["n_sentences"], r["sentences"], r["licences"]) for r in plans.op7_licenses(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        names = slow_sentences(r["text"])
        assert got[r["doc_id"]] == (len(names), ",".join(names), ",".join(slow_licences(names)))
    assert any(x[2] for x in got.values())


def test_full_texts_order_and_odd_rows(spark):
    s = licenses.SENTENCES
    mit = f"Copyright 2020 X\n\n{s['mit-grant']}\n\n{s['mit-notice']}\n\n{s['mit-warranty']} {s['mit-liability']}"
    texts = [
        mit, mit.replace(" and ", "\n   and ").upper(), f"{s['mit-notice']}\n\n{s['mit-grant']}",
        f"{s['bsd-grant']}\n\n1. {s['bsd-source']}\n\n2. {s['bsd-binary']}\n\n3. {s['bsd-endorse']}",
        f"{s['bsd-grant']}\n\n* {s['bsd-source']}\n\n* {s['bsd-binary']}", f"# {s['mpl-subject']} {s['mpl-obtain']}", "junk.***\nAll rights reserved.\nAll Rights  Reserved!", None, "", "x" * 100000 + "\n" + s["mit-name"],
    ]
    docs = spark.createDataFrame([(i, t, "row") for i, t in enumerate(texts)] + [(7, None, "again")], "doc_id long, text string, sentences string")
    got = sorted((r["row"]["doc_id"], r["sentences"], r["licences"]) for r in licenses.scan_licences(docs).collect())
    assert got == sorted([(i, slow_sentences(t), slow_licences(slow_sentences(t))) for i, t in enumerate(texts)] + [(7, [], [])])
    named = {i: x for i, _, x in got}
    assert [named[i] for i in range(10)] == [["MIT"], ["MIT"], [], ["BSD-3-Clause"], ["BSD-2-Clause"], ["MPL-2.0"], ["all-rights-reserved"], [], [], ["MIT"]]
    assert licenses.scan_licences(docs.limit(0)).count() == 0
