import random
import re

import pytest

from folioscope.functions.fragments import with_highlight


def slow(text, terms, count, size):
    words = (text or "").split()
    marks = []
    for w in words:
        own = re.findall(r"[a-z0-9_./:\-]{2,}", w.lower())
        marks.append(next((k + 1 for k, t in enumerate(terms) if t in own or (k == len(terms) - 1 and any(x.startswith(t) for x in own))), 0))
    chosen = []
    for _ in range(count):
        best = None
        for p, m in enumerate(marks):
            if not m or any(a <= p <= b for a, b in chosen):
                continue
            end = min([p + size] + [a for a, _ in chosen if a > p])
            first = {}
            for q in range(p, min(end, len(words))):
                if marks[q]:
                    first.setdefault(marks[q], q)
            key = (-len(first), max(first.values()) - p, p)
            best = key if best is None or key < best else best
        if best is None:
            break
        p, length = best[2], best[1]
        left = max([b for _, b in chosen if b < p], default=-1)
        right = min([a for a, _ in chosen if a > p], default=len(words))
        start = max(min(p - (size - 1 - length) // 2, right - size), left + 1)
        chosen.append((start, min(start + size - 1, right - 1)))
    show = [" ".join(f"<b>{words[i]}</b>" if marks[i] else words[i] for i in range(a, b + 1)) for a, b in sorted(chosen)]
    return " ... ".join(show) if chosen else " ".join(words[:size])


def test_two_words_far_apart_give_two_fragments_and_folded_terms_are_marked(rows):
    filler = " ".join(f"f{i}" for i in range(30))
    df = rows("id int, text string", (1, f"{filler} Café {filler} garden, {filler}"), (2, "no such word here at all"), (3, None), (4, "cafes in the GARDEN"))
    got = {r["id"]: r["highlight"] for r in with_highlight(df, "text", "cafe gard", fragments=3, size=5).collect()}
    assert got[1] == "f28 f29 <b>Café</b> f0 f1 ... f28 f29 <b>garden,</b> f0 f1"
    assert got[2] == "no such word here at" and got[3] == "" and got[4] == "cafes in the <b>GARDEN</b>"


def test_han_pairs_are_marked(rows):
    got = with_highlight(rows("t string", ("前文 知识库检索 后文",)), "t", "知识").first()["highlight"]
    assert got == "前文 <b>知识库检索</b> 后文"


@pytest.mark.parametrize("size", [3, 6])
def test_against_a_plain_version(rows, size):
    rng = random.Random(size)
    texts = [" ".join(rng.choice(["red", "Fox", "redder", "foxes", "a", "bb", "cc,", "Red-fox", "x"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    df = rows("id int, text string", *enumerate(texts))
    for query in ("red fox", "bb", "zz red"):
        got = {r["id"]: r["highlight"] for r in with_highlight(df, "text", query, fragments=3, size=size).collect()}
        assert got == {i: slow(t, query.split(), 3, size) for i, t in enumerate(texts)}
