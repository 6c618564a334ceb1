"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import packed
from folioscope.llm.markup import HEADINGS, Block, Element, Page

# Share of one deviation that a path's score has to reach, weights of neighbours, weight of what an article element holds.
THRESHOLD, KERNEL, WITHIN = 0.5, (0.25, 0.5, 0.25), 10.0
# Shares of the selected text that the article's element holds, and of link text from which a path is a list of links.
SEMANTIC_SHARE, ROOT_SHARE, LINKS = 0.6, 0.8, 0.5
PUNCTUATION = ".,;:!?…。，；：！？、"


def smoothed(values: np.ndarray) -> np.ndarray:
    """Weighted means with both neighbours; the ends count twice."""
    before, own, after = KERNEL
    return before * np.concatenate([values[:1], values[:-1]]) + own * values + after * np.concatenate([values[1:], values[-1:]])


def path_scores(blocks: list[Block]) -> tuple[dict[int, float], dict[int, float], np.ndarray]:
    """Score and share of link text of each path, and the scores of all blocks in page order.

    Characters and punctuation a block are averaged over all blocks of a path (the tag-path ratios), so that a short paragraph counts
    like the long ones beside it. Both series are smoothed in page order and fused; link text and what is around the article weigh nothing.
    """
    places: dict[int, int] = {}
    at = np.array([places.setdefault(b.element.path, len(places)) for b in blocks])
    paths = list(places)
    nodes = np.bincount(at, minlength=len(paths))
    chars = np.array([len(b.text) for b in blocks], float)
    marks = np.array([sum(map(b.text.count, PUNCTUATION)) for b in blocks], float)
    linked = np.bincount(at, [b.linked for b in blocks], len(paths)) / np.bincount(at, chars, len(paths))
    text_ratio, mark_ratio = (np.bincount(at, v, len(paths)) / nodes for v in (chars, marks))
    fused = smoothed(text_ratio[at]) * np.sqrt(1 + smoothed(mark_ratio[at])) * np.clip(1 - linked[at], 0, 1)
    fused *= np.array([WITHIN if b.element.within else 1.0 for b in blocks])
    means = np.bincount(at, fused, len(paths)) / nodes
    return dict(zip(paths, means.tolist())), dict(zip(paths, linked.tolist())), fused


def article_root(elements: list[Element], selected: list[Block]) -> tuple[Element, bool]:
    """The element that holds the article, and whether it says so itself (article or main).

    The deepest article or main with most of the selected text; else the deepest element with nearly all of it.
    """
    for b in selected:
        b.element.held += len(b.text)
    for e in elements[:0:-1]:
        e.parent.held += e.held
    total = elements[0].held
    said = [e for e in elements if e.tag in ("article", "main") and e.held >= SEMANTIC_SHARE * total]
    root = max(said or [e for e in elements if e.held >= ROOT_SHARE * total], key=lambda e: e.depth)
    return root, bool(said)


def main_blocks(html: str) -> list[Block]:
    """The blocks of the article, in page order."""
    page = Page(html)
    blocks = [b for b in page.blocks if not b.element.around and not (b.element.header and not (b.element.within and b.element.tag in HEADINGS))]
    if not blocks:
        return []
    scores, links, every = path_scores(blocks)
    threshold = min(THRESHOLD * float(every.std()), max(scores.values()))
    chosen = {p for p, s in scores.items() if s >= threshold and s > 0}
    selected = [b for b in blocks if b.element.path in chosen]
    if not selected:
        return []
    root, said = article_root(page.elements, selected)
    for e in page.elements:
        e.inside = e is root or (e.parent is not None and e.parent.inside)
    inside = [b for b in blocks if b.element.inside]
    if said:
        return inside
    fine = [b for b in inside if b.element.path in chosen or links[b.element.path] < LINKS]
    if root.tag not in ("", "html", "body"):
        return fine
    picked = [i for i, b in enumerate(fine) if b.element.path in chosen]
    first, last = picked[0], picked[-1]
    titles = [i for i, b in enumerate(fine[:first]) if b.element.tag == "h1"]
    if titles:
        first = titles[-1]
    while first and fine[first - 1].element.tag in HEADINGS:
        first -= 1
    return fine[first : last + 1]


def extract_main(pages: DataFrame, html: str = "html") -> DataFrame:
    """row, text, n_chars, n_blocks: the article of each page, its blocks joined by an empty line.

    White space in a block is one space, character references are decoded, nothing is cut. Null and empty pages, and those
    without an article, give an empty text. Every row gives one row; repeated rows stay, `row` holds the given columns.
    A page is parsed where it is read, without a shuffle; a task holds one batch of rows.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_blocks(page) if page else [] for page in batch.column(1).to_pylist()]
            texts = ["\n\n".join(b.text for b in blocks) for blocks in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(list(map(len, found)), pa.int64()),
                ],
                names=["row", "text", "n_chars", "n_blocks"],
            )

    held = packed(pages, html=html)
    schema = held.selectExpr("row", "'' as text", "0L as n_chars", "0L as n_blocks").schema
    return held.mapInArrow(extract, schema)
