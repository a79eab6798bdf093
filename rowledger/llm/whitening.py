"""Embedding whitening by incremental eigendecomposition.

Every partition of the distinct vectors keeps a spectrum: number, mean, eigenvalues and eigenvectors of its scatter. A
vector is added by one centred rank-one update, whose new eigenvalues are the roots of the secular equation; what the
update can't move, or can't tell apart, is deflated first. Of a large block, QR makes at most as many rows as there are
dimensions, of the same centred scatter, and these are the updates: the same spectrum for a fraction of the time. Two spectra are combined by updating one with each scaled
eigenvector of the other and with the distance of the means, in a tree over the partitions. Their vectors span the
space in which a Rayleigh-Ritz step over all vectors, also summed in a tree, gives the final components; a second such
step measures them.

A state is as large as the square of the dimension and doesn't grow with the rows. States are folded in the order of
their partitions, so a repeated task gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowledger.llm.common import write_once

COMPONENTS = 4
SCALE = 256
BLOCK = 4096        # vectors turned into fewer rows at a time
FAN_IN = 8          # states folded by one task of the tree
ENTRIES = 1 << 20   # vector entries held as one matrix
EPS = np.finfo(float).eps


class Spectrum:
    """Mean and scatter of vectors; the scatter as ascending eigenvalues and eigenvectors (columns)."""

    def __init__(self, size: int) -> None:
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(size), np.zeros(size), np.eye(size)

    def add(self, x: np.ndarray) -> None:
        self._shift(x - self.mean, 1)

    def add_block(self, rows: np.ndarray) -> None:
        """Many vectors: centred, turned by QR into at most as many rows as dimensions with the same scatter, and added."""
        if len(rows) <= rows.shape[1] + 1:
            for x in rows:
                self.add(x)
            return
        mean = rows.mean(axis=0)
        for u in np.linalg.qr(rows - mean, mode="r"):
            self._update(u)
        self._shift(mean - self.mean, len(rows))

    def combine(self, other: Spectrum) -> None:
        if other.n == 0:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._update(vector * np.sqrt(value))
        self._shift(other.mean - self.mean, other.n)

    def _shift(self, off: np.ndarray, more: int) -> None:
        """Count ``more`` vectors whose mean lies ``off`` from this one's; their own scatter is added apart."""
        n = self.n + more
        self._update(off * np.sqrt(self.n * more / n))
        self.mean, self.n = self.mean + off * (more / n), n

    def _update(self, u: np.ndarray) -> None:
        """Eigenvalues and eigenvectors of the scatter plus u u'."""
        d, v, z = self.values, self.vectors, self.vectors.T @ u
        rho = float(z @ z)
        if not rho:
            return
        size = np.sqrt(rho)
        d, v, z = _deflate_ties(d, v, z, 8 * EPS * max(abs(d).max(), rho) / rho * size)
        moved = np.abs(z) * size > 8 * EPS * max(abs(d).max(), rho)
        if moved.any():
            roots, turn = secular(d[moved], z[moved])
            d, v = d.copy(), v.copy()
            d[moved], v[:, moved] = roots, v[:, moved] @ turn
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], v[:, order]

    def to_bytes(self) -> bytes:
        return np.concatenate([[float(self.n)], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, size: int) -> Spectrum:
        numbers, found = np.frombuffer(data), cls(size)
        found.n, found.mean, found.values = int(numbers[0]), numbers[1 : size + 1], numbers[size + 1 : 2 * size + 1]
        found.vectors = numbers[2 * size + 1 :].reshape(size, size)
        return found


def _deflate_ties(d: np.ndarray, v: np.ndarray, z: np.ndarray, small: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turn pairs of eigenvectors whose eigenvalues are all but equal, so that the update meets only one of each pair."""
    meets = np.flatnonzero(np.abs(z) > small)
    a, b = z[meets[:-1]], z[meets[1:]]
    if not (np.diff(d[meets]) * np.abs(a * b) <= 8 * EPS * max(abs(d).max(), z @ z) * (a * a + b * b)).any():
        return d, v, z
    d, v, z = d.copy(), v.copy(), z.copy()
    last = meets[0]
    for i in meets[1:]:
        r = np.hypot(z[last], z[i])
        c, s = z[i] / r, z[last] / r
        gap = d[i] - d[last]
        if gap * abs(c * s) <= 8 * EPS * max(abs(d).max(), z @ z):
            z[last], z[i] = 0.0, r
            v[:, last], v[:, i] = c * v[:, last] - s * v[:, i], s * v[:, last] + c * v[:, i]
            d[last], d[i] = d[last] + gap * s * s, d[i] - gap * s * s
        last = i
    return d, v, z


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + z z', for ascending distinct d and z without zeros.

    Each root of 1 + sum(z_j^2 / (d_j - x)) lies between two neighbours of d. It is kept as the distance from the
    nearer one, found by rational interpolation of the two poles beside it, and by halving where that leaves the
    bracket. The eigenvectors come from the z that has exactly these roots, so they are orthogonal.
    """
    m, weight = len(d), z * z
    # the last root is at most the sum of weights beyond the last of d
    upper = np.append(d[1:], d[-1] + 2 * weight.sum())
    gap = upper - d
    rows, left = np.arange(m), np.tri(m, dtype=bool)
    delta = d[None, :] - d[:, None]
    # the sign in the middle tells the nearer pole; beyond the last one there is none
    far = 1 + (weight / (delta - gap[:, None] / 2)).sum(axis=1) < 0
    far[-1] = False
    delta[far] = d[None, :] - upper[far][:, None]
    low, high = np.where(far, -gap / 2, 0.0), np.where(far, 0.0, gap / 2)
    x = (low + high) / 2
    pole_a, pole_b = np.where(far, -gap, 0.0), np.where(far, 0.0, gap)
    live = rows
    for _ in range(100):
        at = delta[live] - x[live, None]
        part = weight / at
        slope = part / at
        below, above = np.where(left[live], part, 0).sum(axis=1), np.where(left[live], 0, part).sum(axis=1)
        value = 1 + below + above
        done = np.abs(value) <= EPS * m * (1 + np.abs(below) + np.abs(above))
        low[live], high[live] = np.where(value < 0, x[live], low[live]), np.where(value > 0, x[live], high[live])
        slope_a = np.where(left[live], slope, 0).sum(axis=1)
        slope_b = slope.sum(axis=1) - slope_a
        a, b = pole_a[live] - x[live], pole_b[live] - x[live]
        p = (a + b) * value - a * b * (slope_a + slope_b)
        q = a * b * value
        c = value - a * slope_a - b * slope_b
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
        new = x[live] + step
        halved = (low[live] + high[live]) / 2
        new = np.where(np.isfinite(new) & (new >= low[live]) & (new <= high[live]) & (new != 0), new, halved)
        done |= (np.abs(new - x[live]) <= EPS * np.abs(x[live])) | (halved == low[live]) | (halved == high[live])
        x[live] = np.where(done, x[live], new)
        live = live[~done]
        if not len(live):
            break
    from_root = delta - x[:, None]             # d_j - root_i
    apart = d[None, :] - d[:, None]            # d_j - d_i
    np.fill_diagonal(apart, 1.0)
    exact = np.sqrt(np.abs(np.prod(from_root / apart, axis=0))) * np.sign(z)
    turn = (exact / from_root).T
    turn /= np.linalg.norm(turn, axis=0)
    return np.where(far, upper, d) + x, turn


def _matrices(batches: Iterator[pa.RecordBatch], name: str, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches and their vectors as rows of whole numbers, filled up with zeros to ``size``."""
    step = max(1, ENTRIES // max(1, size))
    for whole in batches:
        for first in range(0, whole.num_rows, step):
            batch = whole.slice(first, step)
            column = batch.column(batch.schema.get_field_index(name))
            length = column.value_lengths().to_numpy(zero_copy_only=False)
            rows = np.zeros((len(length), size), np.int64)
            rows[np.arange(size) < length[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            yield batch, rows


def _per_partition(fit: DataFrame, size: int, state: Callable[[Iterator[np.ndarray]], bytes]) -> DataFrame:
    """(part, state) of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = state(rows for _, rows in _matrices(batches, "x", size))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([found], pa.binary())], ["part", "state"])

    return fit.mapInArrow(run, "part long, state binary")


def _fold_tree(states: DataFrame, fold: Callable[[list[bytes]], bytes]) -> bytes:
    """Fold the states of all partitions, ``FAN_IN`` in a task, until one is left."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN_IN], "state": [fold([bytes(s) for s in rows["state"]])]})

    states = write_once(states, "states")
    parts = states.agg(F.max("part") + 1).first()[0]
    while parts > 1:
        states = states.groupBy(F.floor(F.col("part") / FAN_IN).alias("next")).applyInPandas(merge, "part long, state binary")
        parts = -(-parts // FAN_IN)
    return bytes(states.first()["state"])


def _scatter_in(fit: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum of products of all centred vectors, seen in the basis."""
    size, width = basis.shape

    def state(blocks: Iterator[np.ndarray]) -> bytes:
        total = np.zeros((width, width))
        for rows in blocks:
            seen = (rows - mean) @ basis
            total += seen.T @ seen
        return total.tobytes()

    def fold(states: list[bytes]) -> bytes:
        return sum(np.frombuffer(s) for s in states).tobytes()

    return np.frombuffer(_fold_tree(_per_partition(fit, size, state), fold)).reshape(width, width)


def _sums(fit: DataFrame, size: int) -> list[int]:
    """Exact sum of every dimension; halves of 32 bits are added apart, so no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for _, rows in _matrices(batches, "x", size):
            high, low = (rows >> 32).sum(axis=0), (rows & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([str(t) for t in total])], ["at", "total"])

    sums = fit.mapInArrow(run, "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["at"]: int(r["total"]) for r in sums.collect()}
    return [found.get(i, 0) for i in range(size)]


class Whitening:
    """What a row needs to be whitened: number, sums, weights by component, shares of variance, largest error."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, values: np.ndarray, explained: np.ndarray, error: float) -> None:
        self.n, self.sums, self.components, self.values, self.explained, self.error = n, sums, components, values, explained, error

    def deviation(self, rows: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; null where that is no long."""
        most = max([abs(s) for s in self.sums], default=0) + self.n * max(abs(int(rows.min(initial=0))), int(rows.max(initial=0)))
        if most * most * max(1, len(self.sums)) < 1 << 63:
            off = self.n * rows - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * int(x) - s) ** 2 for x, s in zip(row, self.sums)) for row in rows]
        return [e if e < 1 << 63 else None for e in exact]


def fit_whitening(fit: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """Whitening learned from the whole-number vectors ``x`` of ``fit``, a written table; None without vectors.

    ``block`` vectors at a time are turned into fewer rows of the same scatter before they update the spectrum; 1 adds
    each as it is.
    """
    n, size = fit.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return None
    sums = _sums(fit, size)
    mean = np.array([s / n for s in sums])

    def state(blocks: Iterator[np.ndarray]) -> bytes:
        found = Spectrum(size)
        for rows in blocks:
            for first in range(0, len(rows), block):
                found.add_block(rows[first : first + block].astype(float))
        return found.to_bytes()

    def fold(states: list[bytes]) -> bytes:
        found = [Spectrum.from_bytes(s, size) for s in states]
        for other in found[1:]:
            found[0].combine(other)
        return found[0].to_bytes()

    found = Spectrum.from_bytes(_fold_tree(_per_partition(fit, size, state), fold), size)
    # Rayleigh-Ritz: the covariance seen from the vectors found, by all rows; its eigenvectors turn them into place
    basis, _ = np.linalg.qr(found.vectors)
    values, turn = np.linalg.eigh(_scatter_in(fit, mean, basis) / n)
    total = float(values.sum())
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > size * EPS * max(total, 0.0)][:components]
    values, basis = values[order], basis @ turn[:, order]
    basis *= np.where(basis[np.abs(basis).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0) if size and len(order) else 1.0
    white = basis / np.sqrt(values)
    error = np.abs(_scatter_in(fit, mean, white) / n - np.eye(len(order))).max(initial=0.0)
    return Whitening(n, sums, white, values, values / total if total else values, float(error))


def whole_vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and has finite entries only, with ``x``: each entry times ``SCALE``, rounded down."""
    c = F.col(column)
    sound = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return embeddings.where(F.coalesce(sound, F.lit(False))).withColumn("x", F.transform(c, lambda e: F.floor(e.cast("double") * SCALE)))


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per sound row and component.

    Learned from each distinct whole-number vector once. Rows whose vector is null or holds a null, NaN or infinite
    entry are left out; repeated rows and null ids are kept as they are. Shorter vectors, also empty ones, count as
    filled up with zeros. Components without variance (all of them if there is one vector only) give no rows, and
    so does an empty table. Among equal eigenvalues the components are any that span their space. Long vectors are held
    ``ENTRIES`` entries at a time; the states grow with the square of the dimension. Other columns are not read.
    """
    rows = whole_vectors(embeddings, column).select("vec_id", "x")
    model = fit_whitening(write_once(rows.select("x").distinct(), "vectors"), components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    size, k = model.components.shape
    mean = np.array([s / model.n for s in model.sums])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, "x", size):
            seen = (x - mean) @ model.components
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviation = pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), model.n)),
                    deviation, pa.array(seen.ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(k * len(x), model.error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(project, schema)
