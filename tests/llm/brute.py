"""Plain versions of operators, one document at a time, for small tables."""

import math
import re
from collections import Counter, defaultdict

SPACE = "[\x20\x09-\x0d]"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def benchmark_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text or ""))


def decontaminate(docs, items):
    """{id: (n_words, n_hit, items)}"""
    windows = defaultdict(set)
    for item, text in items:
        own = benchmark_words(text)
        for k in range(max(1, len(own) - 9) if own else 0):
            windows[tuple(own[k : k + 10])].add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        own, hit, found = benchmark_words(text), set(), set()
        for n in lengths:
            for k in range(len(own) - n + 1):
                if (w := tuple(own[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[w]
        out[doc] = (len(own), len(hit), sorted(found))
    return out


def line_key(line):
    return ascii_lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))


def dedup_lines(docs, min_chars=40, min_docs=5):
    """{id: (n_lines, n_dropped, text)}"""
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                holders[line_key(line)].add(doc)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        gone = lambda line: len(own := holders.get(line_key(line), ())) >= min_docs and doc != max(d for d in own if d is not None)
        kept = [line for line in lines if not gone(line)]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def base_counts(text):
    own = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(zip(own, own[1:], own[2:]))
    inside = {k + j for k, w in enumerate(zip(own, own[1:], own[2:])) if seen[w] > 1 for j in range(3)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def divergence(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q)) / 2))


def quality(docs, common, limit=0.17, word_limit=0.5, guard=45, fewest=20):
    """{key: (counts, base_failed, kept)}; docs: (key, text, language)"""
    def histograms(text, language):
        text = text or ""
        own = words(text)
        chars = Counter(
            0 if c.isascii() and c.islower() else 1 if c.isascii() and c.isupper() else 2 if c.isascii() and c.isdigit() else 6 if re.match(SPACE, c) else 3 if c in "#*$%&|<>" else 5 if not c.isascii() else 4
            for c in text
        )
        listed = common.get(language)
        told = Counter(w.rstrip(".,;:!?").lower() for w in own)
        shares = [told[w] / len(own) for w in listed] if listed else []
        return [chars[k] / len(text) for k in range(7)], [*shares, 1 - sum(shares)]

    middle = lambda v: sorted(v)[math.ceil(len(v) / 2) - 1]
    norm = lambda v: [x / sum(v) for x in v]
    found, by_language, out = {}, defaultdict(list), {}
    for key, text, language in docs:
        found[key] = base_counts(text)
        if found[key][0] >= 50:
            by_language[language].append(histograms(text, language))
    reference = {x: [norm([middle(col) for col in zip(*side)]) for side in zip(*own)] for x, own in by_language.items()}
    for key, text, language in docs:
        n, *_, repeats = found[key]
        failed = n < 50 or 100 * repeats > 50 * n
        kept = not failed
        if kept and len(by_language[language]) >= fewest:
            room = 1 + guard / n
            near = [divergence(p, q) for p, q in zip(histograms(text, language), reference[language])]
            kept = near[0] <= limit * room and near[1] <= word_limit * room
        out[key] = (found[key], failed, kept)
    return out
