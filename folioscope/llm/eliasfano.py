"""Compact sorted sequences that are read in place, and containers of arrays that can be memory-mapped."""

from __future__ import annotations

import json
import mmap
import tempfile
from urllib.parse import urlparse

import numpy as np

ONE = np.uint64(1)
CHUNK = 1 << 17


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays one behind another, each at a multiple of 8 bytes, behind a header that says where."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, len(a), at]
        parts.append(data + b"\0" * (-len(data) % 8))
        at += len(parts[-1])
    told = json.dumps(head).encode()
    told += b" " * (-len(told) % 8)
    return len(told).to_bytes(8, "little") + told + b"".join(parts)


def load(buffer) -> dict[str, np.ndarray]:
    """The arrays as views into the buffer; nothing is copied."""
    size = int.from_bytes(buffer[:8], "little")
    return {k: np.frombuffer(buffer, kind, n, 8 + size + at) for k, (kind, n, at) in json.loads(bytes(buffer[8 : 8 + size])).items()}


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes, attempt: str) -> None:
    """Writes a whole file under another name, then moves it; a task that is run again replaces it by the same bytes."""
    system, path = file_system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{path}.{attempt}") as out:
        out.write(data)
    system.move(f"{path}.{attempt}", path)


def map_bytes(data: bytes) -> mmap.mmap:
    """A memory map over a file that has no name, gone with the map."""
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def map_file(uri: str) -> mmap.mmap:
    """A shared file, mapped where it lies if it has a local path, else from a local copy without name."""
    if urlparse(uri).scheme in ("", "file"):
        with open(urlparse(uri).path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    system, path = file_system(uri)
    with system.open_input_stream(path) as f:
        return map_bytes(f.read())


def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """A sorted sequence of uint64: low bits side by side, high bits in unary, counts of zeros before each word of those."""
    n = len(values)
    if not n:
        return {f"{name}.meta": np.zeros(4, np.uint64), f"{name}.low": np.zeros(16, np.uint8), f"{name}.high": np.zeros(1, np.uint64), f"{name}.zeros": np.zeros(1, np.int64)}
    own = values - values[0]
    width = max(0, (int(own[-1]) // n).bit_length() - 1)
    high = (own >> np.uint64(width)).astype(np.int64)
    bits = np.zeros(-(-(int(high[-1]) + n + 1) // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = bits.reshape(-1, 64).sum(axis=1, dtype=np.int64)
    zeros = np.arange(len(words)) * 64 - (np.cumsum(ones) - ones)
    low = np.zeros((n, width), np.uint8)
    for b in range(width):
        low[:, b] = own >> np.uint64(b) & ONE
    packed = np.packbits(low.ravel(), bitorder="little")
    meta = np.array([n, width, int(values[0]), int(values[-1])], np.uint64)
    return {f"{name}.meta": meta, f"{name}.low": np.concatenate([packed, np.zeros(16, np.uint8)]), f"{name}.high": words, f"{name}.zeros": zeros}


class EliasFano:
    """Reads an encoded sequence in place, for many places or values at once."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        n, width, self.first, self.last = (int(x) for x in arrays[f"{name}.meta"])
        self.n, self.width = n, width
        self.low, self.high, self.zeros = arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.zeros"]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th zero, or one, in the high bits."""
        before = np.arange(len(self.zeros)) * 64 - self.zeros if one else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        held = self.high[word] if one else ~self.high[word]
        bits = np.unpackbits(np.ascontiguousarray(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + (np.cumsum(bits, axis=1, dtype=np.uint8) <= (k - before[word])[:, None]).sum(axis=1)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at * self.width
        byte = bit >> 3
        out = np.zeros(len(at), np.uint64)
        for k in range(8):
            out |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        shift = (bit & 7).astype(np.uint64)
        out >>= shift
        if self.width > 56:  # the rest stands in a ninth byte
            out |= np.where(shift > 0, self.low[byte + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, ONE)), np.uint64(0))
        return out & np.uint64((1 << self.width) - 1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at some places."""
        if not len(at):
            return np.zeros(0, np.uint64)
        high = (self._select(at, True) - at).astype(np.uint64)
        return np.uint64(self.first) + (high << np.uint64(self.width) | self._low(at))

    def search(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where the sequence does not hold it."""
        return np.concatenate([self._search(values[k : k + CHUNK]) for k in range(0, max(1, len(values)), CHUNK)])

    def _search(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        ask = np.flatnonzero((values >= np.uint64(self.first)) & (values <= np.uint64(self.last)))
        if not len(ask):
            return out
        own = values[ask] - np.uint64(self.first)
        bucket = (own >> np.uint64(self.width)).astype(np.int64)
        want = own & np.uint64((1 << self.width) - 1)
        start = np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), False) - (bucket - 1), 0)
        stop = self._select(bucket, False) - bucket
        low, high = start.copy(), stop.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            less = self._low(middle) < want[open_]
            low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
        there = np.flatnonzero(low < stop)
        there = there[self._low(low[there]) == want[there]]
        out[ask[there]] = low[there]
        return out
