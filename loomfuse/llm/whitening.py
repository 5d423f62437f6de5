"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries c become the integers floor(256 * c); the fit list is each distinct integer vector once (one aggregation, combined on
the map side, so that a vector with any number of copies is a row a task). Two passes over it give, exactly:

* n and the sums S of each dimension;
* the scatter of the vectors centred at the integers nearest to S / n. What is left of the centring is settled in whole
  numbers: n * scatter - sums * sums' is n squared times the covariance V, with no rounding whatever the partitions.

V (dimensions squared, the only thing that the driver sees besides S) is factored with diagonal pivoting, V = L L'; plane
rotations of L's columns make them orthogonal. Their squared norms are the eigenvalues, their directions the components.
A last pass over the fit list measures the covariance of the whitened vectors.

A row is left out if its vector is null, holds null or non-finite entries, or has another length than most vectors (ties:
the longer). Repeated rows are returned as often as they are there. Components without variance are not returned: none with
fewer than two distinct vectors. A deviation beyond a long is null; integers beyond a long are its ends. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfuse.llm.common import cut

COMPONENTS, ROWS = 4, 4096
LIMB = 42
MASK = (1 << LIMB) - 1
TOP = 2.0**63


def integers(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(length of each vector, -1 where one is left out; for each length its rows and their integers)."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    fine = np.r_[0, np.cumsum(~np.isfinite(flat))]
    lengths[(lengths >= 0) & (fine[starts + np.maximum(lengths, 0)] > fine[starts])] = -1
    found = []
    for d in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == d)
        x = np.floor(256 * flat[starts[rows][:, None] + np.arange(d)]) + 0.0
        high, low = x >= TOP, x <= -TOP
        x = np.where(high | low, 0, x).astype(np.int64)
        x[high], x[low] = 2**63 - 1, -(2**63)
        found.append((rows, x))
    return lengths, found


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, in the least of 2, 4 and 8 bytes an entry."""
    out = np.empty(len(x), object)
    need = np.abs(np.maximum(x, -(2**63) + 1)).max(1, initial=0)
    wide = np.where(need < 2**15, 2, np.where(need < 2**31, 4, 8))
    for w in (2, 4, 8):
        at = np.flatnonzero(wide == w)
        mark = np.full((len(at), 1), w, np.uint8)
        raw = np.concatenate([mark, np.frombuffer(x[at].astype(f"<i{w}").tobytes(), np.uint8).reshape(len(at), w * x.shape[1])], 1)
        out[at] = [r.tobytes() for r in raw]
    return out.tolist()


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    out = np.empty((len(column), d), np.int64)
    rows = column.to_pylist()
    wide = np.array([r[0] for r in rows])
    for w in (2, 4, 8):
        at = np.flatnonzero(wide == w)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i][1:] for i in at), f"<i{w}").reshape(len(at), d)
    return out


def gram(y: np.ndarray) -> np.ndarray:
    """y' y without rounding: int64, or Python's integers where it needs them."""
    most = int(np.abs(y).max(initial=0)) if y.size and y.min(initial=0) > -(2**63) else 2**63
    if most * most * max(1, len(y)) < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)  # every partial sum is a whole number below 2**53
    if most * most * 64 < 2**53:
        return sum((gram(y[k : k + 64]).astype(object) for k in range(0, len(y), 64)), np.zeros((y.shape[1],) * 2, object))
    z = y.astype(object)
    return z.T @ z


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as a + b * 2**42 + c * 2**84, whose parts may be summed as longs."""
    if values.dtype != object:
        return [values & MASK, (values >> LIMB) & MASK, values >> 63]
    return [np.array([int(v) >> k & MASK if k < 2 * LIMB else int(v) >> k for v in values], np.int64) for k in (0, LIMB, 2 * LIMB)]


def exact_sums(df: DataFrame, part, cells: int) -> list[int]:
    """Sums over all rows of what ``part(batch)`` gives (arrays of ``cells`` whole numbers). A task sends one row a cell."""
    names = ["cell", "a", "b", "c"]

    def run(batches):
        total = np.zeros(cells, object)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                total = total + part(batch.slice(k, ROWS)).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), *map(pa.array, limbs(total))], names)

    got = df.mapInArrow(run, "cell int, a long, b long, c long").groupBy("cell").agg(*(F.sum(x).alias(x) for x in "abc")).collect()
    out = [0] * cells
    for r in got:
        out[r.cell] = r.a + (r.b << LIMB) + (r.c << 2 * LIMB)
    return out


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L): v[order][:, order] = L L', with L's columns as many as v's rank, its diagonal falling."""
    d = len(v)
    order, left, rows = np.arange(d), v.copy(), []
    least = d * np.finfo(float).eps * max(v.diagonal().max(initial=0), 0)
    for k in range(d):
        p = k + int(np.argmax(left.diagonal()[k:]))
        if left[p, p] <= least:
            break
        if p != k:
            for a in (order, left, left.T, *rows):
                a[[k, p]] = a[[p, k]]
        column = np.zeros(d)
        column[k:] = left[k:, k] / np.sqrt(left[k, k])
        left[k:, k:] -= np.outer(column[k:], column[k:])
        rows.append(column)
    return order, np.array(rows).T.reshape(d, len(rows))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors, by row) of factor * factor': rotations make the factor's columns orthogonal. The pairs
    of a round share no column and are rotated together."""
    a = np.ascontiguousarray(factor.T)
    r = len(a)
    ring = np.arange(r + r % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            both = (p < r) & (q < r)
            p, q = p[both], q[both]
            x, y = a[p], a[q]
            nx, ny, dot = (np.einsum("ij,ij->i", s, t) for s, t in ((x, x), (y, y), (x, y)))
            at = np.flatnonzero(np.abs(dot) > 1e-15 * np.sqrt(nx * ny))
            if len(at):
                turned = True
                zeta = (ny[at] - nx[at]) / (2 * dot[at])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = (1 / np.hypot(1, t))[:, None]
                s = c * t[:, None]
                a[p[at]], a[q[at]] = c * x[at] - s * y[at], s * x[at] + c * y[at]
            ring = np.r_[ring[:1], np.roll(ring[1:], 1)]
        if not turned:
            break
    values = np.einsum("ij,ij->i", a, a)
    by = np.argsort(-values, kind="stable")
    values, a = values[by], a[by]
    unit = a / np.sqrt(values)[:, None] if r else a
    sign = np.sign(unit[np.arange(r), np.abs(unit).argmax(1)]) if r else np.ones(0)
    return values, unit * sign[:, None]


@dataclass
class Whitening:
    """The fit: n and sums of the distinct integer vectors, falling eigenvalues and components (rows), trace, and the error measured."""

    d: int
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    error: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer vectors."""
        n, whole = self.n, np.array([s // self.n for s in self.sums], np.float64)
        part = np.array([s % self.n / n for s in self.sums])
        return ((x - whole) - part) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of (n x - S)^2 over dimensions, whether it is a long), exact."""
        sums = np.array(self.sums, object)
        near = (((x.astype(np.float64) * self.n) - sums.astype(np.float64)) ** 2).sum(1)
        far = max(int(np.abs(x.astype(np.float64)).max(initial=0)), 1) * self.n + max(map(abs, self.sums), default=0)
        out = np.zeros(len(x), np.int64)
        if far < 2**62 and far * far * max(1, self.d) < 2**63:
            z = x * self.n - sums.astype(np.int64)
            return (z * z).sum(1), np.ones(len(x), bool)
        fits = near < 2.0**64
        for i in np.flatnonzero(fits):
            v = int(((x[i].astype(object) * self.n - sums) ** 2).sum())
            fits[i] = v < 2**63
            out[i] = v if fits[i] else 0
        return out, fits


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """d, x (packed), rows: each distinct integer vector of (vector) once, and how many rows have it."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                for at, x in integers(batch.slice(k, ROWS).column(0))[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array(packed(x), pa.binary())], ["d", "x"])

    return rows.mapInArrow(run, "d int, x binary").groupBy("d", "x").agg(F.count("*").alias("rows"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table (vector), or None if no vector is left."""
    every = cut(distinct_vectors(rows), "whitening")
    lengths = every.groupBy("d").agg(F.sum("rows").alias("rows"), F.count("*").alias("n")).orderBy(F.desc("rows"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = lengths.d, lengths.n
    list_ = every.where(F.col("d") == d).select("x")

    def total_of(b: pa.RecordBatch) -> np.ndarray:
        x = unpacked(b.column(0), d)
        return (x if np.abs(x.astype(np.float64)).max(initial=0) < 2**50 else x.astype(object)).sum(0)

    sums = exact_sums(list_, total_of, d) if d else []
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], object)  # the nearest integers
    narrow = all(abs(c) < 2**40 for c in centre)
    upper = np.triu_indices(d)

    def scatter(b: pa.RecordBatch) -> np.ndarray:
        x = unpacked(b.column(0), d)
        y = x - centre.astype(np.int64) if narrow and np.abs(x.astype(np.float64)).max(initial=0) < 2**60 else x.astype(object) - centre
        return (gram(y) if y.dtype != object else y.T @ y)[upper]

    total = exact_sums(list_, scatter, len(upper[0])) if d else []
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    v = np.zeros((d, d))
    for i, j, g in zip(*upper, total):
        v[i, j] = v[j, i] = (n * g - rest[i] * rest[j]) / (n * n)
    order, factor = pivoted_cholesky(v)
    values, unit = one_sided_jacobi(factor)
    unit, back = np.zeros_like(unit), unit
    unit[:, order] = back
    made = Whitening(d, n, sums, values[:components], unit[:components], float(np.trace(v)))
    made.error = identity_error(list_, made)
    return made


def identity_error(list_: DataFrame, made: Whitening) -> float:
    """Largest entry, in size, of the covariance of the whitened fit list minus the identity."""
    k, d = len(made.values), made.d
    if not k:
        return 0.0

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = made.scores(unpacked(batch.slice(at, ROWS).column(0), d))
                m = np.c_[w, np.ones(len(w))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange((k + 1) * k)), pa.array((m.T @ w).ravel())], ["cell", "v"])

    got = np.zeros((k + 1) * k)
    for r in list_.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        got[r.cell] = r.v
    got = got.reshape(k + 1, k) / made.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


NAMES = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def apply(rows: DataFrame, made: Whitening | None) -> DataFrame:
    """Per row of (vec_id, vector) and component: n, deviation, whitened, explained, identity_error."""
    if made is None or not len(made.values):
        return rows.sparkSession.createDataFrame([], SCHEMA)
    k = len(made.values)
    told = rows.sparkSession.sparkContext.broadcast(made)  # of ``components`` vectors, whatever the table's size

    def run(batches):
        w = told.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                for here, x in integers(b.column(1))[1]:
                    if x.shape[1] != w.d:
                        continue
                    far, fits = w.deviations(x)
                    each = lambda values, kind: pa.array(np.repeat(values, k), kind)
                    deviation = pa.array(np.repeat(far, k), pa.int64(), mask=np.repeat(~fits, k))
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pa.array(np.repeat(here, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(here))), each(np.full(len(here), w.n), pa.int64()), deviation,
                        pa.array(w.scores(x).ravel()), pa.array(np.tile(w.values / w.trace, len(here))), each(np.full(len(here), w.error), pa.float64()),
                    ], NAMES)

    return rows.mapInArrow(run, SCHEMA)


def whiten(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitening of a table: fitted on its distinct integer vectors, applied to all its rows."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return apply(rows, fit(rows.select("vector"), components))
