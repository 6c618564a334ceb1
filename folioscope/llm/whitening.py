"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Vectors are read on a grid: x = floor(scale * entry) + offset, a long. The model is fitted on each distinct x once:
sums and the centred scatter are added up in tasks, the driver sees d sums and one d x d matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import packed, saved

SCALE, OFFSET = 64.0, 1_000_000
# Grid values stay below this, so that sums of a batch and differences are exact in 64 bits.
LARGEST = float(1 << 48)
# A pivot below this share of its own variance is rounding, not variance.
NOISE = 1e-11
# The driver factors one matrix of this size at most; it does not grow with the rows.
WIDEST = 2048
ROWS = 8192


def grid(vectors: pa.Array, dims: int | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which rows have a vector on the grid (of length `dims`, if given), and for each length their places and x values."""
    offsets = vectors.offsets.to_numpy()
    lengths = np.diff(offsets)
    there = vectors.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
    if dims is not None:
        there &= lengths == dims
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become nan
    groups = []
    usable = np.zeros(len(lengths), bool)
    for length in np.unique(lengths[there]).tolist():
        places = np.flatnonzero(there & (lengths == length))
        entries = np.floor(flat[offsets[places][:, None] + np.arange(length)] * SCALE)
        fine = (np.abs(entries) < LARGEST).all(axis=1)  # false for nan and infinite entries
        usable[places[fine]] = True
        groups.append((places[fine], entries[fine].astype(np.int64) + OFFSET))
    return usable, groups


def grid_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, x in grid(batch.column(0))[1]:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists], names=["x"])


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.column(0).slice(at, ROWS)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G with a = G G', rows in the order of `a`, one column for each pivot above rounding."""
    d = len(a)
    rest, taken = np.diag(a).copy(), np.zeros(d, bool)
    floor = NOISE * rest
    g = np.zeros((d, d))
    for k in range(d):
        free = ~taken & (rest > floor)
        if not free.any():
            return g[:, :k]
        p = int(np.argmax(np.where(free, rest, -1.0)))
        column = (a[:, p] - g[:, :k] @ g[p, :k]) / np.sqrt(rest[p])
        column[taken] = 0.0  # the upper part of the triangle
        column[p] = np.sqrt(rest[p])
        taken[p] = True
        g[:, k] = column
        rest -= column * column
    return g


def one_sided_jacobi(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of `g`, rotated in pairs until all are orthogonal; their norms are singular values of `g`.

    Pairs are taken in rounds of disjoint ones (a round-robin), so that a round is a few array operations.
    """
    g = g.copy()
    r = g.shape[1]
    if r < 2:
        return g
    seats = list(range(r + r % 2))  # an odd number of columns leaves one out in each round
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], seats[: half - 1 : -1]) if max(p, q) < r]
            p, q = (np.array(side) for side in zip(*pairs))
            left, right = g[:, p], g[:, q]
            a, b, c = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            norms = np.sqrt(a * b)
            angle = np.divide(np.abs(c), norms, out=np.zeros_like(c), where=norms > 0)
            worst = max(worst, float(angle.max()))
            turn = angle > 1e-16
            if turn.any():
                zeta = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                cos = 1 / np.sqrt(1 + t * t)
                cos, sin = np.where(turn, cos, 1.0), np.where(turn, cos * t, 0.0)
                g[:, p], g[:, q] = cos * left - sin * right, sin * left + cos * right
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst <= 1e-15 * np.sqrt(len(g)):
            break
    return g


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    g = one_sided_jacobi(pivoted_cholesky(covariance))
    values = (g * g).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], g[:, order] / np.sqrt(values[order])
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])]) if len(values) else np.ones(0)
    return values, vectors * signs


@dataclass
class Whitening:
    """A fitted model: n vectors of `dims` entries with exact sums, and components in columns by falling eigenvalue."""

    n: int = 0
    dims: int = 0
    sums: list[int] = field(default_factory=list)
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.empty(0))
    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    identity_error: float = 0.0

    def __post_init__(self) -> None:
        # S/n in two parts: a whole number near it and what is left, so that x - S/n keeps all its digits.
        self.whole = [s // self.n for s in self.sums]
        self.rest = [s - self.n * w for s, w in zip(self.sums, self.whole)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.whole, np.int64)) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - S)^2 for each row, exact: n^2 A - 2 n B + C of small whole numbers."""
        y, rest = x - np.array(self.whole, np.int64), np.array(self.rest, np.int64)
        most = float(np.abs(y).max(initial=0))
        if self.dims * most * max(most, self.n) >= 2**62:
            y, rest = y.astype(object), rest.astype(object)
        c = sum(r * r for r in self.rest)
        return [self.n * (self.n * a - 2 * b) + c for a, b in zip((y * y).sum(axis=1).tolist(), (y * rest).sum(axis=1).tolist())]

    def projected(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def summed(df: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], width: int) -> np.ndarray:
    """A matrix of that width added up over all tasks; each gives its rows (i, values)."""
    parts = df.mapInArrow(fold, "i int, part array<double>").select("i", F.posexplode("part").alias("j", "v"))
    total = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    return total


def scatter(df: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of the outer products of of(x) over all rows."""

    def fold(batches):
        total = np.zeros((width, width))
        for x in matrices(batches):
            y = of(x)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part"])

    return summed(df, fold, width)


def column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in matrices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1]), pa.int32()), pa.array(x.sum(axis=0))], names=["j", "s"])


def fit(vectors: DataFrame, column: str = "embedding", components: int = 16) -> Whitening:
    """The whitening of the distinct grid vectors of `column`.

    Rows without a vector, with null, non-finite or too large (2^42) entries, or of another length than most distinct vectors
    (of equally common lengths the longest) take no part. No rows, or equal ones only: a model without components. Vectors
    longer than 2 048 raise. The distinct vectors are written as a table, as three passes read them.
    """
    distinct = saved(vectors.select(F.col(f"`{column}`").alias("v")).mapInArrow(grid_rows, "x array<bigint>").distinct())
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return Whitening()
    dims, n = lengths["d"], lengths["count"]
    if dims > WIDEST:
        raise ValueError(f"vectors of {dims} entries: at most {WIDEST} can be whitened")
    fitted = distinct.filter(F.size("x") == dims)
    totals = fitted.mapInArrow(column_sums, "j int, s bigint").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    model = Whitening(n, dims, [int(r["s"]) for r in sorted(totals, key=lambda r: r["j"])])
    covariance = scatter(fitted, model.centred, dims) / n
    model.trace = float(np.trace(covariance))
    values, found = eigen(covariance)
    model.values, model.vectors = values[:components], found[:, :components]
    k = len(model.values)
    if k:
        model.identity_error = float(np.abs(whitened_covariance(fitted, model, k) - np.eye(k)).max())
    return model


def whitened_covariance(fitted: DataFrame, model: Whitening, k: int) -> np.ndarray:
    """Covariance of the whitened distinct vectors, centred by their own mean."""
    once = scatter(fitted, lambda x: np.hstack([np.ones((len(x), 1)), model.projected(x)]), k + 1) / model.n
    mean = once[0, 1:]
    return scatter(fitted, lambda x: model.projected(x) - mean, k) / model.n


def apply(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """row, deviation decimal(38,0), whitened array<double>: every row of `vectors` that has a vector of the model's length.

    `row` holds the given columns, whatever their names. A deviation of more than 38 digits is null. Repeated rows stay.
    """

    def project(batches):
        for batch in batches:
            usable, groups = grid(batch.column(1), model.dims)
            for places, x in groups:
                for at in range(0, len(x), ROWS):
                    part = x[at : at + ROWS]
                    exact = [Decimal(v) if v < 10**38 else None for v in model.deviations(part)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(places[at : at + ROWS])), pa.array(exact, pa.decimal128(38, 0)),
                            pa.array(list(model.projected(part)), pa.list_(pa.float64())),
                        ],
                        names=["row", "deviation", "whitened"],
                    )

    held = packed(vectors, v=column)
    schema = held.select("row", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened")).schema
    if not len(model.values):
        return held.select("row", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened")).filter("false")
    return held.mapInArrow(project, schema)


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 16) -> DataFrame:
    """One row for each vector and component: row, component (from 1), n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, column, components)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    each = apply(vectors, model, column).select("row", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "row", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
