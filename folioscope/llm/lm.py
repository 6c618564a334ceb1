"""Language-model scores from an Elias-Fano n-gram trie."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from folioscope.llm.common import each_text, packed, saved, scratch_folder, slices
from folioscope.llm.eliasfano import EliasFano, dump, encode, load, map_bytes, map_file, put_file

END = b""  # no word is empty
SIGN = np.uint64(1 << 63)
# Words in a file of the first level, pairs of words in a shard of the second, bytes of text routed at once.
WORDS, PAIRS, TEXT_BYTES = 1 << 20, 1 << 21, 12 << 20
LEVELS = 1 << 16  # of quantised probabilities


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def squeeze(values: np.ndarray) -> bytes:
    """Compressed by byte planes, which suits sorted numbers and their steps."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, n) of every token of the training documents, the end among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches):
            lengths = [len(t) for t in texts]
            at = 0
            for part in slices(batch, lengths, TEXT_BYTES):
                seen: Counter = Counter()
                for text in texts[at : at + part.num_rows]:
                    seen.update(tokens_of(text))
                seen[END] = part.num_rows
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(hash_words(list(seen)).view(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["hash", "n"])

    counted = docs.filter("not held").select("text").mapInArrow(count, "hash long, n long")
    return counted.groupBy("hash").agg(F.sum("n").alias("n"))


def write_words(counts: DataFrame, files: int, folder: str) -> list[Row]:
    """First level: files of word hashes in order with their counts; (first, n, uri) of each, in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy().view(np.uint64) ^ SIGN, b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            hashes, n = (np.concatenate(x) for x in zip(*held))
            task = TaskContext.get()
            uri = f"{folder}/words-{task.partitionId()}.ef"
            put_file(uri, dump({**encode(hashes, "word"), "n": n}), f"{task.taskAttemptId()}")
            yield pa.RecordBatch.from_pylist([{"first": int(hashes[0] ^ SIGN) - (1 << 64) * (int(hashes[0] ^ SIGN) >> 63), "n": len(hashes), "uri": uri}])

    ordered = counts.repartitionByRange(files, "hash").sortWithinPartitions("hash")
    return sorted(ordered.mapInArrow(write, "first long, n long, uri string").collect())


@dataclass
class Level:
    """The first level as a task sees it; a word's number is its rank among all hashes, from 1."""

    firsts: np.ndarray
    starts: np.ndarray
    uris: list[str]

    def __post_init__(self):
        self.open: dict[int, tuple[EliasFano, np.ndarray]] = {}

    def file(self, k: int) -> tuple[EliasFano, np.ndarray]:
        if k not in self.open:
            arrays = load(map_file(self.uris[k]))
            self.open[k] = EliasFano(arrays, "word"), arrays["n"]
        return self.open[k]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, 0 for words that no training document has."""
        out = np.zeros(len(hashes), np.int64)
        own = hashes ^ SIGN
        which = np.searchsorted(self.firsts, own, "right") - 1
        for k in np.unique(which[which >= 0]).tolist():
            rows = np.flatnonzero(which == k)
            at = self.file(k)[0].search(own[rows])
            out[rows[at >= 0]] = self.starts[k] + at[at >= 0] + 1
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        which = np.searchsorted(self.starts, numbers - 1, "right") - 1
        for k in np.unique(which[numbers > 0]).tolist():
            rows = np.flatnonzero((which == k) & (numbers > 0))
            out[rows] = self.file(k)[1][numbers[rows] - 1 - self.starts[k]]
        return out


@dataclass
class Model:
    """What every task knows; the counts of words are read from the files of the first level."""

    files: list[tuple]
    total: int  # training tokens
    kinds: int  # distinct ones
    documents: int  # training documents, the count of what stands before a first word
    share: float  # of what follows a word against all words
    shards: int

    def level(self) -> Level:
        firsts = np.array([f[0] for f in self.files], np.int64).view(np.uint64) ^ SIGN
        starts = np.concatenate([[0], np.cumsum([f[1] for f in self.files])])[: len(self.files)].astype(np.int64)
        return Level(firsts, starts, [f[2] for f in self.files])

    @property
    def begin(self) -> int:
        return self.kinds + 1

    def single(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.kinds + 1))

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % self.shards


class Trie:
    """Second level of a shard: for each first word the words behind it, with the probability of each.

    first: the first words in order. pointer: where the list of each begins. second: all lists as one rising sequence, each
    counted from the last value of the list before, so that a word is found relative to its context. code: smoothed
    log10 probabilities in LEVELS steps.
    """

    def __init__(self, buffer):
        arrays = load(buffer)
        self.first, self.pointer, self.second = (EliasFano(arrays, k) for k in ("first", "pointer", "second"))
        self.code, (self.least, self.step) = arrays["code"], arrays["scale"]

    @staticmethod
    def build(keys: np.ndarray, log_p: np.ndarray) -> bytes:
        """keys: first word << 32 | second word, in order and without repeats."""
        first, second = keys >> 32, (keys & 0xFFFFFFFF).astype(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(keys)).astype(np.int64)
        lasts = second[ends - 1] + np.uint64(1) if len(starts) else np.zeros(0, np.uint64)
        base = np.cumsum(lasts) - lasts
        rising = second + np.repeat(base, ends - starts) if len(starts) else second
        least, most = (float(log_p.min()), float(log_p.max())) if len(log_p) else (0.0, 0.0)
        step = (most - least) / (LEVELS - 1) or 1.0
        return dump({
            **encode(first[starts].astype(np.uint64), "first"), **encode(np.append(starts, len(keys)).astype(np.uint64), "pointer"), **encode(rising, "second"),
            "code": np.round((log_p - least) / step).astype(np.uint16), "scale": np.array([least, step]),
        })

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each pair, NaN for pairs the trie does not hold."""
        out = np.full(len(keys), np.nan)
        context = self.first.search((keys >> 32).astype(np.uint64))
        rows = np.flatnonzero(context >= 0)
        if not len(rows):
            return out
        begin, stop = self.pointer.access(context[rows]).astype(np.int64), self.pointer.access(context[rows] + 1).astype(np.int64)
        base = np.where(begin > 0, self.second.access(np.maximum(begin - 1, 0)) + np.uint64(1), np.uint64(0))
        at = self.second.search(base + (keys[rows] & 0xFFFFFFFF).astype(np.uint64))
        there = (at >= begin) & (at < stop)
        out[rows[there]] = self.least + self.step * self.code[at[there]]
        return out


def route(model: Model) -> Callable:
    """Pairs of a slice of documents by shard, and what the first level alone says of the documents.

    A slice gives one row for each shard, of pairs in order, their documents and which of those are held out, and one row of
    its own (shard -1) with an Arrow batch of its documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, task, turn = model.level(), TaskContext.get().partitionId(), 0
        for batch, texts in each_text(batches):
            at = 0
            for part in slices(batch.drop_columns(["text"]), [len(t) for t in texts], TEXT_BYTES):
                local: dict[bytes, int] = {END: 0}
                tokens: list[int] = []
                sizes = []
                for text in texts[at : at + part.num_rows]:
                    own = tokens_of(text)
                    tokens += [local.setdefault(w, len(local)) for w in own]
                    tokens.append(0)
                    sizes.append(len(own) + 1)
                at += part.num_rows
                numbers = level.numbers(hash_words(list(local)))
                counts = level.counts(numbers)
                word = np.array(tokens)
                doc = np.repeat(np.arange(part.num_rows), sizes)
                second = numbers[word]
                first = np.concatenate([[model.begin], second[:-1]])
                first[np.cumsum([0, *sizes[:-1]])] = model.begin
                single = np.log10(model.single(counts))[word]
                by_doc = lambda x, doc=doc, n=part.num_rows: np.bincount(doc, weights=x, minlength=n)
                routed = (first > 0) & (second > 0) if model.documents else np.zeros(len(word), bool)
                alone = np.where(routed, 0.0, single + np.where((first > 0) & (model.documents > 0), np.log10(1 - model.share), 0.0))
                head = part.append_column("n_tokens", pa.array(sizes, pa.int64())).append_column("n_known", pa.array(by_doc(counts[word] > 0).astype(np.int64)))
                head = head.append_column("base_score", pa.array(by_doc(single))).append_column("score", pa.array(by_doc(alone)))
                keys, owner = first[routed] << 32 | second[routed], doc[routed].astype(np.uint32)
                shard = model.shard_of(keys)
                order = np.lexsort((owner, keys, shard))
                keys, owner, shard = keys[order], owner[order], shard[order]
                cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
                name = task << 32 | turn
                turn += 1
                held = np.packbits(np.array(part.column("held").to_pylist(), np.uint8)).tobytes()
                rows = [{"slice": name, "shard": -1, "keys": head_bytes(head), "owners": b"", "held": b""}]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    steps = np.diff(keys[a:b], prepend=0)
                    rows.append({"slice": name, "shard": int(shard[a]), "keys": squeeze(steps), "owners": squeeze(owner[a:b]), "held": held})
                for k in range(0, len(rows), 16):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 16], schema=ROUTED)

    return run


ROUTED = pa.schema([("slice", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("held", pa.binary())])
ANSWERED = pa.schema([("slice", pa.int64()), ("head", pa.binary()), ("sums", pa.binary())])


def head_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Runs of rows with one key; a run is held whole. Rows with a negative key come one by one."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row[key] != held[0][key] or row[key] < 0):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def answer(model: Model) -> Callable:
    """Builds the trie of each shard from the pairs of training documents and looks up the pairs of all documents."""

    def shard_sums(rows: list[dict], level: Level) -> Iterator[dict]:
        keys = [np.cumsum(expand(r["keys"], "<i8")) for r in rows]
        owners = [expand(r["owners"], "<u4") for r in rows]
        taught = [k[np.unpackbits(np.frombuffer(r["held"], np.uint8))[o] == 0] for k, o, r in zip(keys, owners, rows)]
        known, n = np.unique(np.concatenate(taught), return_counts=True)

        def parts(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first, second = pairs >> 32, pairs & 0xFFFFFFFF
            before = np.where(first == model.begin, model.documents, level.counts(np.where(first == model.begin, 0, first)))
            return before, (1 - model.share) * model.single(level.counts(second))

        before, rest = parts(known)
        trie = Trie(map_bytes(Trie.build(known, np.log10(model.share * n / before + rest))))
        asked, back = np.unique(np.concatenate(keys), return_inverse=True)
        log_p = trie.log_p(asked)
        missing = np.isnan(log_p)
        log_p[missing] = np.log10(parts(asked[missing])[1])
        at = 0
        for r, own in zip(rows, owners):
            sums = np.bincount(own, weights=log_p[back[at : at + len(own)]])
            at += len(own)
            yield {"slice": r["slice"], "head": None, "sums": zstandard.ZstdCompressor(level=1).compress(sums.tobytes())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = model.level()
        for rows in grouped(batches, "shard"):
            out = [{"slice": r["slice"], "head": r["keys"], "sums": None} for r in rows] if rows[0]["shard"] < 0 else list(shard_sums(rows, level))
            for k in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist(out[k : k + 256], schema=ANSWERED)

    return run


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each slice with the sums of all its shards."""
    for rows in grouped(batches, "slice"):
        head = next(pa.ipc.open_stream(r["head"]).read_next_batch() for r in rows if r["head"] is not None)
        score = head.column("score").to_numpy().copy()
        for r in rows:
            if r["sums"] is not None:
                sums = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["sums"]))
                score[: len(sums)] += sums
        yield pa.RecordBatch.from_arrays([*head.columns[:-1], pa.array(score)], names=head.schema.names)


def score_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", folds: int = 5, held_fold: int = 1, share: float = 0.1) -> DataFrame:
    """Columns doc, held, n_tokens, n_known, base_score, score, train_tokens; one row per input row.

    Tokens are words, lower-cased in A-Z, and one end. Documents whose crc32(id as text) mod `folds` is not `held_fold`
    teach the model; a row without id teaches too. base_score sums log10 of (c + 0.5) / (N + 0.5 (V + 1)). score uses pairs:
    share * c(first second) / c(first) + (1 - share) * that, where the first word is known, else that alone; all
    probabilities behind a word add up to 1. Probabilities of known pairs are quantised. Null and empty texts are one end;
    repeated rows teach as often as they stand; an empty table gives an empty table.

    All counts are over all training text. The words' counts are Elias-Fano files in the shared folder that tasks map into
    memory. Pairs go to shards by a hash of both words, so no word makes a shard large, as compressed blocks of a slice of
    documents; a shard builds its trie, maps it, and answers the pairs of all documents with one sum for each document of
    a slice. The model is as large as its corpus and never in one place.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc").cast("string")) % folds
    base = packed(docs, doc=doc, text=text).select("doc", F.coalesce(fold == held_fold, F.lit(False)).alias("held"), "text")
    counts = saved(word_counts(base))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = base.agg(F.count("*").alias("rows"), F.coalesce(F.sum((~F.col("held")).cast("long")), F.lit(0)).alias("taught")).first()
    if kinds >= 1 << 32:
        raise ValueError("word numbers have 32 bits")
    folder = scratch_folder(spark, "words")
    files = write_words(counts, max(1, -(-kinds // WORDS)), folder) if kinds else []
    tokens = total * ends["rows"] // max(1, ends["taught"])
    model = Model([tuple(f) for f in files], total, kinds, ends["taught"], share, max(1, -(-tokens // PAIRS)))

    names = base.schema["doc"].dataType.simpleString()
    routed = base.mapInArrow(route(model), "slice long, shard long, keys binary, owners binary, held binary")
    place = F.when(F.col("shard") < 0, F.hash("slice")).otherwise(F.hash("shard"))
    answered = routed.repartition(2 * model.shards, place).sortWithinPartitions("shard").mapInArrow(answer(model), "slice long, head binary, sums binary")
    scored = answered.repartition("slice").sortWithinPartitions("slice").mapInArrow(
        gather, f"doc {names}, held boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
