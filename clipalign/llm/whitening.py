"""Whitening of embeddings by incremental eigendecomposition.

Each partition keeps the eigenvalues and eigenvectors of the scatter of its vectors and changes them by centred rank-one updates: the new
eigenvalues are the roots of the secular equation between the old ones, and directions that an update doesn't touch, or that share an
eigenvalue, are deflated. Spectra of partitions are combined in the same way, an update for each direction of the other one and one for
the distance of the means, some at a time. A last pass over all vectors forms their covariance in the basis found and turns the basis to
its Ritz vectors, so what the updates have lost in accuracy comes back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clipalign.session import materialize

#: Rows whose scatter is brought to as many rows as there are dimensions, by a QR decomposition, before the updates.
BLOCK = 1024
#: Spectra that one task combines.
FAN_IN = 16
SCALE, SHIFT = 1024, 100_000
_EPS = np.finfo(float).eps


def _secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum z2 / (d - t) = 0 for rising d: the nearest pole of each, and its distance from that pole.

    Root i lies between d[i] and d[i + 1], the last one before d[-1] + sum(z2). Interpolation by one simple fraction for the poles up to i
    and another for the rest, kept inside a bracket that shrinks with each sign found.
    """
    n = len(d)
    gap = np.append(d[1:] - d[:-1], z2.sum())
    rows = np.arange(n)
    f_middle = 1 + (z2 / (d[None, :] - d[:, None] - gap[:, None] / 2)).sum(axis=1)
    # a positive value at the middle: the root is nearer to the pole below
    pole = np.where((f_middle >= 0) | (rows == n - 1), rows, np.minimum(rows + 1, n - 1))
    shifted = d[None, :] - d[pole][:, None]
    below = np.tril(np.ones((n, n), bool))
    low = np.where(pole == rows, np.where(f_middle >= 0, 0.0, gap / 2), -gap / 2)
    high = np.where(pole == rows, np.where(f_middle >= 0, gap / 2, gap), 0.0)
    to_lower, to_upper = np.where(pole == rows, 0.0, -gap), np.where(pole == rows, gap, 0.0)
    t = (low + high) / 2
    for _ in range(100):
        away = shifted - t[:, None]
        terms = z2 / away
        slopes = terms / away
        f = 1 + terms.sum(axis=1)
        done = np.abs(f) <= 16 * _EPS * (1 + np.abs(terms).sum(axis=1))
        if done.all():
            break
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        from_lower, from_upper = to_lower - t, to_upper - t
        s = np.where(below, slopes, 0).sum(axis=1) * from_lower ** 2
        r = np.where(below, 0, slopes).sum(axis=1) * from_upper ** 2
        # c + s / (lower - t) + r / (upper - t) has the value and the slopes of both sides here; its root between the poles comes next
        c = f - s / from_lower - np.divide(r, from_upper, out=np.zeros(n), where=r > 0)
        b = c * (to_lower + to_upper) + s + r
        e = c * to_lower * to_upper + s * to_upper + r * to_lower
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(b * b - 4 * c * e, 0))
            q = (b + np.where(b >= 0, root, -root)) / 2
            one, two = q / c, e / q
            one[-1] = to_lower[-1] + s[-1] / c[-1]  # above it lies no pole
        new = np.where((one > low) & (one <= high), one, two)
        new = np.where((new > low) & (new <= high), new, (low + high) / 2)
        t = np.where(done, t, new)
    return pole, t


@dataclass
class Spectrum:
    """n vectors with `mean`; their scatter has the rising eigenvalues `values` and the eigenvectors in the columns of `vectors`."""

    n: float
    mean: np.ndarray
    values: np.ndarray = field(default=None)
    vectors: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.values is None:
            self.values, self.vectors = np.zeros(len(self.mean)), np.eye(len(self.mean))

    def update(self, v: np.ndarray) -> None:
        """Add v v' to the scatter."""
        d, z = self.values, v @ self.vectors
        size = max(d[-1], z @ z)
        if not size:
            return
        tolerance = 8 * _EPS * size
        vectors = self.vectors
        # equal eigenvalues: turn their directions so that one alone meets the update
        for i in np.flatnonzero(d[1:] - d[:-1] <= tolerance):
            r = np.hypot(z[i], z[i + 1])
            if r and z[i]:
                c, s = z[i + 1] / r, z[i] / r
                z[i], z[i + 1] = 0.0, r
                vectors[:, [i, i + 1]] = vectors[:, [i, i + 1]] @ np.array([[c, s], [-s, c]])
        kept = np.flatnonzero(np.abs(z) * np.sqrt(size) > tolerance)
        if not len(kept):
            return
        poles, z = d[kept], z[kept]
        poles = np.maximum.accumulate(poles)
        z2 = z * z
        nearest, away = _secular_roots(poles, z2)
        # pole i minus root k, without cancellation
        distance = poles[:, None] - poles[nearest][None, :] - away[None, :]
        # the weights for which these are exactly the roots make the directions orthogonal
        n = len(poles)
        between = poles[:, None] - poles[None, :]
        np.fill_diagonal(between, 1.0)
        # root k lies between poles k and k + 1: for the poles up to k it is paired with pole k + 1, for the others with pole k
        paired = np.where(np.tri(n, n, -1, bool), between, np.roll(between, -1, axis=1))
        paired[:, -1] = 1.0
        weights = np.sqrt(np.abs(np.prod(distance / paired, axis=1)))
        turned = np.copysign(weights, z)[:, None] / distance
        turned /= np.linalg.norm(turned, axis=0)
        vectors[:, kept] = vectors[:, kept] @ turned
        d[kept] = poles[nearest] + away
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], np.ascontiguousarray(vectors[:, order])

    def add(self, other: Spectrum | np.ndarray) -> None:
        """Take in other vectors, given as a block of rows or by their spectrum."""
        if isinstance(other, np.ndarray):
            mean = other.mean(axis=0)
            rows = np.linalg.qr(other - mean, mode="r") if len(other) > len(mean) else other - mean
            other = Spectrum(len(other), mean, np.ones(len(rows)), rows.T)
        if not other.n:
            return
        total = self.n + other.n
        for value, v in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(np.sqrt(value) * v)
        self.update(np.sqrt(self.n * other.n / total) * (other.mean - self.mean))
        self.mean = self.mean + (other.n / total) * (other.mean - self.mean)
        self.n = total


def whole_numbers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """Entries as floor(scale * c) + shift; null for a vector that is null, empty, or holds null or a number that isn't finite."""
    doubles = vector.cast("array<double>")
    fine = F.coalesce((F.size(doubles) > 0) & F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return F.when(fine, F.transform(doubles, lambda c: F.floor(c * scale) + shift))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column of lists of one length."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _blocks(batches, column: int = 0):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            if part.num_rows:
                yield part, _matrix(part.column(column))


def spectra(vectors: DataFrame, column: str) -> DataFrame:
    """id (the partition's), n, sums, mean, values and vectors of the scatter of each partition's arrays of whole numbers."""
    schema = T._parse_datatype_string("struct<id bigint, n bigint, sums array<bigint>, mean array<double>, values array<double>, vectors array<double>>")
    arrow = to_arrow_schema(schema)

    def run(batches):
        found, sums = None, 0
        for _, x in _blocks(batches):
            found = found or Spectrum(0, np.zeros(x.shape[1]))
            found.add(x.astype(float))
            sums = sums + x.sum(axis=0)
        if found:
            yield pa.RecordBatch.from_pylist([{"id": TaskContext.get().partitionId(), "n": int(found.n), "sums": sums.tolist(), "mean": found.mean.tolist(),
                                               "values": found.values.tolist(), "vectors": found.vectors.ravel().tolist()}], arrow)

    return vectors.select(F.col(f"`{column}`")).mapInArrow(run, schema)


def _combine(group: pd.DataFrame) -> pd.DataFrame:
    whole, sums = None, 0
    for row in group.sort_values("id").itertuples():
        d = len(row.mean)
        one = Spectrum(row.n, np.array(row.mean), np.array(row.values), np.array(row.vectors).reshape(d, d))
        sums = sums + np.array(row.sums)
        if whole is None:
            whole = one
        else:
            whole.add(one)
    return pd.DataFrame({"id": [int(group.id.min()) // FAN_IN], "n": [int(whole.n)], "sums": [sums.tolist()], "mean": [whole.mean.tolist()],
                         "values": [whole.values.tolist()], "vectors": [whole.vectors.ravel().tolist()]})


def combined(parts: DataFrame) -> DataFrame:
    """One spectrum of all, from groups of FAN_IN in as many rounds as they need."""
    parts = materialize(parts)
    left = 1 + (parts.agg(F.max("id")).first()[0] or 0)
    while left > 1:
        parts = parts.groupBy(F.expr(f"id div {FAN_IN}").alias("g")).applyInPandas(_combine, parts.schema)
        left = -(-left // FAN_IN)
    return parts


def _scatter(vectors: DataFrame, column: str, centre: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The sum over all rows of y y' with y = (x - centre) turn: summed in each task, then over the tasks."""
    k = turn.shape[1]

    def run(batches):
        total = np.zeros((k, k))
        for _, x in _blocks(batches):
            y = (x - centre) @ turn
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["place", "value"])

    cells = vectors.select(F.col(f"`{column}`")).mapInArrow(run, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(k * k)
    for row in cells.collect():  # the cells of one small matrix
        out[row.place] = row.value
    return out.reshape(k, k)


@dataclass(frozen=True)
class Whitening:
    """What whitens vectors of whole numbers: n of them with `sums`, components in columns by falling eigenvalue, and the trace of V."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return self.sums / self.n

    @property
    def turn(self) -> np.ndarray:
        """Columns that give whitened entries; zero for a component without variance."""
        with np.errstate(divide="ignore"):
            scale = np.where(self.values > self.trace * len(self.centre) * _EPS, 1 / np.sqrt(self.values), 0.0)
        return self.components * scale


def fit(vectors: DataFrame, column: str) -> Whitening | None:
    """The whitening of all arrays of whole numbers in a column without nulls; None if there are none."""
    found = combined(spectra(vectors, column)).first()  # one spectrum
    if found is None:
        return None
    d = len(found.mean)
    basis = np.linalg.qr(np.array(found.vectors).reshape(d, d))[0]
    sums = np.array(found.sums)
    scatter = _scatter(vectors, column, sums / found.n, basis) / found.n
    values, ritz = np.linalg.eigh((scatter + scatter.T) / 2)
    order = np.argsort(-values, kind="stable")
    return Whitening(found.n, sums, basis @ ritz[:, order], np.maximum(values[order], 0), float(np.trace(scatter)))


def identity_error(vectors: DataFrame, column: str, whitening: Whitening, k: int) -> float:
    """The largest absolute entry of the first k whitened dimensions' covariance minus the identity."""
    turn = whitening.turn[:, :k]
    n = whitening.n
    ones = np.append(whitening.centre, 0.0)
    # a further column of ones gives the means
    padded = np.zeros((len(ones), turn.shape[1] + 1))
    padded[:-1, :-1], padded[-1, -1] = turn, 1.0
    with_one = vectors.select(F.concat(F.col(f"`{column}`"), F.array(F.lit(1).cast("bigint"))).alias("x"))
    cells = _scatter(with_one, "x", ones, padded) / n
    means = cells[-1, :-1]
    return float(np.abs(cells[:-1, :-1] - np.outer(means, means) - np.eye(len(means))).max())


def whiten(vectors: DataFrame, column: str, k: int = 8, into: str = "whitening") -> DataFrame:
    """Whiten the vectors in `column`, fitted on all of them, and add struct `into`: n, deviation, whitened (array of up to k entries),
    explained (each component's share of the variance) and identity_error.

    Entries count as whole numbers, floor(1024 c) + 100000. Rows whose vector is null, empty, or holds null or a number that isn't finite
    are dropped, and so are those of another length than the most frequent one (the longest of equally frequent). Repeated rows count and
    stay. A component without variance has whitened entries of zero. `deviation` is the sum over dimensions of (n x - S)^2, exact as long
    as it fits 64 bits, and refused else. An existing column `into` is replaced, all others pass through.
    """
    names = [c for c in vectors.columns if c != into]
    packed = vectors.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], whole_numbers(F.col(f"`{column}`")).alias("x"))
    packed = packed.filter(F.col("x").isNotNull())
    lengths = packed.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    found = None
    if lengths:
        packed = packed.filter(F.size("x") == lengths.d)
        found = fit(packed, "x")
    if not found:
        nothing = F.lit(None).cast("struct<n:bigint,deviation:bigint,whitened:array<double>,explained:array<double>,identity_error:double>")
        return packed.filter(F.lit(False)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], nothing.alias(into))
    k = min(k, len(found.centre))
    turn, error = found.turn[:, :k], identity_error(packed, "x", found, k)
    explained = [float(v / found.trace) if found.trace else 0.0 for v in found.values[:k]]
    n, sums, centre = found.n, found.sums, found.centre
    out = T.StructType([*packed.schema.fields[:-1], T.StructField("out", T._parse_datatype_string("struct<deviation bigint, whitened array<double>>"))])
    last = len(names)

    def run(batches):
        for part, x in _blocks(batches, last):
            if n * float(np.abs(x).max()) > 2.0 ** 62 or ((n * (x - centre)) ** 2).sum(axis=1).max() > 2.0 ** 62.9:
                raise OverflowError("a deviation needs more than 64 bits")
            apart = n * x - sums
            whitened = apart / n @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(whitened.ravel()))
            made = pa.StructArray.from_arrays([pa.array((apart * apart).sum(axis=1)), lists], names=["deviation", "whitened"])
            yield pa.RecordBatch.from_arrays([*part.columns[:last], made], names=[*part.schema.names[:last], "out"])

    done = packed.mapInArrow(run, out)
    made = F.struct(F.lit(n).cast("bigint").alias("n"), "out.deviation", "out.whitened",
                    F.array(*map(F.lit, explained)).alias("explained"), F.lit(error).alias("identity_error"))
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], made.alias(into))
