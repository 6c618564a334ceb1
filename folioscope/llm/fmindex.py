"""A bidirectional FM-index over a delimited list of words, asked by a search scheme for words one error away.

The text is the words with a delimiter before each, read as a circle, so that every word stands between two delimiters. Rows
of the index are the sorted rotations of the text; a pattern is a range of rows, and a second index over the mirrored text
holds the range of the mirrored pattern in step with it. So a pattern can grow at either end. All steps work on arrays of ranges.
"""

from __future__ import annotations

import numpy as np

DELIMITER = 0
# Queries whose ranges are held at once.
CHUNK = 4096


def rotations(text: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the rotations of `text` in sorted order, by doubling of the compared length."""
    n = len(text)
    length, rank, at = 1, text.astype(np.int64), np.arange(n)
    while (length + 1) * bits <= 62 and length < n:
        rank = rank << bits | text[(at + length) % n]
        length += 1
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(rank[order[1:]] != rank[order[:-1]])])
        if length >= n or new[order[-1]] == n - 1:
            return order
        rank = new * n + new[(at + length) % n]
        length *= 2


class Wavelet:
    """A sequence of symbols as bit levels; a range of it is narrowed to one symbol in as many steps as a symbol has bits."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []  # shift, zeros before each place, zeros in all
        for shift in range(bits - 1, -1, -1):
            bit = symbols >> shift & 1
            zeros = np.concatenate([[0], np.cumsum(bit == 0)]).astype(np.int32)
            self.levels.append((shift, zeros, int(zeros[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(1 << bits)
        self.start = np.zeros(1 << bits, np.int64)
        self.start = self.narrow(every, np.zeros_like(every), np.zeros_like(every))[0]

    def narrow(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of the symbol before lo and before hi, and how many smaller symbols lie between."""
        smaller = np.zeros(len(lo), np.int64)
        for shift, zeros, all_zeros in self.levels:
            zeros_lo, zeros_hi = zeros[lo], zeros[hi]
            one = (symbol >> shift & 1).astype(bool)
            smaller += np.where(one, zeros_hi - zeros_lo, 0)
            lo, hi = np.where(one, all_zeros + lo - zeros_lo, zeros_lo), np.where(one, all_zeros + hi - zeros_hi, zeros_hi)
        return lo - self.start[symbol], hi - self.start[symbol], smaller

    def symbols(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All symbols in each range: which range, symbol, occurrences before lo and hi, smaller symbols in the range."""
        of, symbol, smaller = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for _, zeros, all_zeros in self.levels:
            zeros_lo, zeros_hi = zeros[lo], zeros[hi]
            lo = np.concatenate([zeros_lo, all_zeros + lo - zeros_lo])
            hi = np.concatenate([zeros_hi, all_zeros + hi - zeros_hi])
            smaller = np.concatenate([smaller, smaller + (zeros_hi - zeros_lo)])
            symbol = np.concatenate([symbol << 1, symbol << 1 | 1])
            of = np.concatenate([of, of])
            some = hi > lo
            of, symbol, lo, hi, smaller = of[some], symbol[some], lo[some], hi[some], smaller[some]
        return of, symbol, lo - self.start[symbol], hi - self.start[symbol], smaller


class Side:
    """The index of one reading direction: rows by first symbol, the symbols before them, and the word of each delimiter row."""

    def __init__(self, words: list[np.ndarray], sigma: int, bits: int) -> None:
        lengths = np.array([len(w) + 1 for w in words])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        text = np.concatenate([part for w in words for part in (np.zeros(1, np.int64), w)])
        rows = rotations(text, bits)
        self.rows_before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.before = Wavelet(text[rows - 1], bits)
        self.word = np.searchsorted(starts, rows[: len(words)])


class BiIndex:
    """Both sides in step. A range is (lo, hi, mirror lo); the mirror range is as wide."""

    def __init__(self, left: Side, right: Side, size: int) -> None:
        self.left, self.right, self.size = left, right, size

    def mirrored(self) -> BiIndex:
        return BiIndex(self.right, self.left, self.size)

    def grow_left(self, symbol, lo, hi, mirror):
        """Ranges of the patterns with the symbol put before them."""
        first, last, smaller = self.left.before.narrow(symbol, lo, hi)
        base = self.left.rows_before[symbol]
        return base + first, base + last, mirror + smaller

    def grow_right(self, symbol, lo, hi, mirror):
        mirror, end, lo = BiIndex.grow_left(self.mirrored(), symbol, mirror, mirror + (hi - lo), lo)
        return lo, lo + (end - mirror), mirror

    def all_right(self, lo, hi, mirror):
        """Every symbol that follows each pattern: which pattern, symbol, and the longer range."""
        of, symbol, first, last, smaller = self.right.before.symbols(mirror, mirror + (hi - lo))
        longer = lo[of] + smaller
        return of, symbol, longer, longer + (last - first), self.right.rows_before[symbol] + first


class Words:
    """Encoded words: symbols from 1 by code point, one more than the index has for any it lacks."""

    def __init__(self, known: list[str]) -> None:
        self.known = known
        letters = sorted({c for w in known for c in w})
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        self.unknown = len(letters) + 1
        self.bits = max(1, self.unknown.bit_length())

    def encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array([self.code.get(c, self.unknown) for c in w], np.int64) for w in words]

    def index(self) -> BiIndex:
        plain = self.encode(self.known)
        left = Side(plain, self.unknown + 1, self.bits)
        right = Side([w[::-1] for w in plain[::-1]], self.unknown + 1, self.bits)
        right.word = len(plain) - 1 - right.word
        return BiIndex(left, right, sum(map(len, plain)) + len(plain))


def one_error(index: BiIndex, queries: list[np.ndarray], halves: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word): the first `half` symbols of the query begin the word, and the rest is one error from it.

    The half is matched from its end to the delimiter before the word; then the pattern grows to the right. As long as it has
    no error it may take one at each step: another symbol, one symbol more or one less. With an error it has to match to the delimiter.
    """
    found = [_one_error(index, queries[at : at + CHUNK], np.array(halves[at : at + CHUNK], np.int64)) for at in range(0, len(queries), CHUNK)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    query = np.concatenate([q + i * CHUNK for i, (q, _) in enumerate(found)])
    return query, np.concatenate([w for _, w in found])


def _one_error(index: BiIndex, queries: list[np.ndarray], half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(q) for q in queries], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    flat = np.concatenate([part for q in queries for part in (q, np.zeros(1, np.int64))])  # a delimiter after each query
    q = np.arange(len(queries))
    lo, hi, mirror = np.zeros(len(q), np.int64), np.full(len(q), index.size), np.zeros(len(q), np.int64)
    for step in range(int(half.max()) + 1):
        at = half[q] - 1 - step
        moving = at >= -1
        symbol = np.where(at >= 0, flat[begins[q] + np.maximum(at, 0)], DELIMITER)
        new = index.grow_left(symbol[moving], lo[moving], hi[moving], mirror[moving])
        lo[moving], hi[moving], mirror[moving] = new
        some = hi > lo
        q, lo, hi, mirror = q[some], lo[some], hi[some], mirror[some]
    at = half[q]
    errors = np.zeros(len(q), bool)
    out_query, out_word = [], []
    while len(q):
        here = flat[begins[q] + at]
        last = at == lengths[q]
        go = errors | ~last
        new = index.grow_right(here[go], lo[go], hi[go], mirror[go])
        ended = (errors & last)[go] & (new[1] > new[0])
        out_query.append(q[go][ended])
        out_word.append(index.left.word[new[0][ended]])
        on = ~last[go] & (new[1] > new[0])
        states = [(q[go][on], at[go][on] + 1, *[v[on] for v in new], errors[go][on])]
        clean = np.flatnonzero(~errors)
        of, symbol, *longer = index.all_right(lo[clean], hi[clean], mirror[clean])
        inner = symbol != DELIMITER
        more = clean[of[inner]]
        longer = [v[inner] for v in longer]
        states.append((q[more], at[more], *longer, np.ones(len(more), bool)))
        other = (symbol[inner] != here[more]) & ~last[more]
        states.append((q[more[other]], at[more[other]] + 1, *[v[other] for v in longer], np.ones(int(other.sum()), bool)))
        less = clean[~last[clean]]
        states.append((q[less], at[less] + 1, lo[less], hi[less], mirror[less], np.ones(len(less), bool)))
        q, at, lo, hi, mirror, errors = (np.concatenate(parts) for parts in zip(*states))
    if not out_query:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(index.left.word)
    pairs = np.unique(np.concatenate(out_query) * n + np.concatenate(out_word))
    return pairs // n, pairs % n
