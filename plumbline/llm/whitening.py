"""Embedding whitening; components by spectral divide and conquer over QDWH polar decompositions.

Vectors are rounded down to whole multiples of ``1 / scale``. The fit runs over the distinct rounded
vectors in three aggregations, each one small table per task: exact sums, the centred second moments, and
the second moments of the whitened result as a check. The covariance has the square of a vector's length in
entries whatever the number of rows, and is taken apart on the driver: the polar factor of the covariance
less a shift tells the eigenvalues above the shift from those below; projectors built from it split the
space in two invariant parts, and so on until each part is one component. Components and means go to the
tasks that whiten the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import name
from plumbline.llm.common import stored

AT_ONCE = 4_096    # vectors of a batch taken at once
STEPS = 30         # of the polar iteration; it converges in six or seven
SHIFTS = (0.0, 0.05, -0.05, 0.13, -0.13, 0.29, -0.29, 0.41, -0.41)  # parts of the spread tried beside the mean
LOW = 0xFFFFFFFF


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the QR form of the dynamically weighted Halley iteration."""
    size = len(a)
    eye = np.eye(size)
    x = a / np.linalg.norm(a)
    least = np.finfo(float).eps
    for _ in range(STEPS):
        square = least * least
        d = np.cbrt(4 * (1 - square) / (square * square)) if least < 1 else 0.0
        root = np.sqrt(1 + d)
        w = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        b = (w - 1) ** 2 / 4
        c = w + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        y = b / c * x + (w - b / c) / np.sqrt(c) * (q[:size] @ q[size:].T)
        y = (y + y.T) / 2
        moved = np.linalg.norm(y - x)
        x, least = y, min(1.0, least * (w + b * square) / (1 + c * square))
        if moved < 1e-13 * np.sqrt(size) and 1 - least < 1e-12:
            break
    return x


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant spaces above and below a shift inside the spectrum; none if all eigenvalues are equal."""
    size = len(a)
    scale = np.linalg.norm(a)
    mean = np.trace(a) / size
    spread = np.linalg.norm(a - mean * np.eye(size)) / np.sqrt(size)
    if spread <= 8 * np.finfo(float).eps * scale:
        return None
    best = None
    for part in SHIFTS:
        above = (polar_factor(a - (mean + part * spread) * np.eye(size)) + np.eye(size)) / 2
        rank = int(round(np.trace(above)))
        if not 0 < rank < size:
            continue
        basis = np.random.default_rng(size).standard_normal((size, rank))
        for _ in range(3):
            basis, _ = np.linalg.qr(above @ basis)
        whole, _ = np.linalg.qr(basis, mode="complete")
        high, low = whole[:, :rank], whole[:, rank:]
        left = np.linalg.norm(low.T @ a @ high) / scale
        if best is None or left < best[0]:
            best = left, high, low
        if left <= 32 * np.finfo(float).eps * np.sqrt(size):
            break
    return best and best[1:]


def top_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    Of equal eigenvalues any orthonormal basis of their space may come. Each vector's largest entry is positive.
    """
    def parts(block: np.ndarray, wanted: int) -> list[np.ndarray]:
        if not wanted:
            return []
        halves = _halves(block) if len(block) > 1 else None
        if halves is None:
            return list(np.eye(len(block)).T)[:wanted]
        found: list[np.ndarray] = []
        for basis in halves:
            found += [basis @ v for v in parts(_even(basis.T @ block @ basis), min(wanted - len(found), basis.shape[1]))]
        return found

    scale = np.abs(a).max() if a.size else 0.0
    vectors = np.array(parts(_even(a) / scale, min(k, len(a)))).T if scale > 0 else np.empty((len(a), 0))
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    if vectors.size:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values[order], vectors


def _even(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


@dataclass(frozen=True)
class Whitening:
    """The fit for vectors of one length."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray        # eigenvalues of the components
    vectors: np.ndarray       # unit eigenvectors as columns
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the exact sum of ``(n * x - S) ** 2``; null where it does not fit in a long."""
        most = self.n * max(1, abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, self.sums))
        if most * most * x.shape[1] < 1 << 63:
            apart = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def finite(vector: Column) -> Column:
    """Not null, not empty, no null, NaN or infinite entry."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their vectors as a matrix, one length and a bounded number at a time."""
    lists = batch["x"]
    offsets = np.asarray(lists.offsets)
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        for part in np.array_split(rows, -(-len(rows) // AT_ONCE)):
            yield part, values[offsets[part][:, None] + np.arange(dim)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length and axis the count and the sums of the upper and lower halves of the values."""
    held: dict[int, list] = {}
    for batch in batches:
        for _, x in _blocks(batch):
            n, high, low = held.get(x.shape[1], (0, 0, 0))
            held[x.shape[1]] = [n + len(x), high + (x >> 32).sum(0), low + (x & LOW).sum(0)]
    for dim, (n, high, low) in held.items():
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array([dim] * dim, pa.int32()), "axis": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()),
            "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())})


def _moments(fit: DataFrame, turned: dict[int, Whitening] | None, means: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per length the sum of outer products of the centred vectors, or of the whitened ones."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _blocks(batch):
                dim = x.shape[1]
                y = turned[dim].project(x) if turned else x - means[dim]
                held[dim] = held.get(dim, 0) + y.T @ y
        for dim, sums in held.items():
            row, column = (i.reshape(-1) for i in np.indices(sums.shape))
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array(np.full(len(row), dim), pa.int32()), "row": pa.array(row, pa.int32()),
                "column": pa.array(column, pa.int32()), "value": pa.array(sums.reshape(-1), pa.float64())})

    out = {dim: np.zeros((len(turned[dim].values),) * 2 if turned else (dim, dim)) for dim in means}
    summed = fit.mapInArrow(partial, "dim int, row int, column int, value double").groupBy("dim", "row", "column").agg(F.sum("value").alias("value"))
    for r in summed.collect():  # the square of the vectors' length, whatever the number of rows
        out[r["dim"]][r["row"], r["column"]] = r["value"]
    return out


def fit_whitening(fit: DataFrame, components: int = 4) -> dict[int, Whitening]:
    """Per vector length the components of the covariance of ``x`` over the rows of ``fit``, taken once each.

    Eigenvalues that are zero to double precision have no component. No rows, no fits.
    """
    sums = fit.mapInArrow(_sums, "dim int, axis int, n long, high long, low long").groupBy("dim", "axis").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    totals: dict[int, dict[int, tuple[int, int]]] = {}
    for r in sums.collect():  # one row per axis
        totals.setdefault(r["dim"], {})[r["axis"]] = (r["n"], (int(r["high"]) << 32) + int(r["low"]))
    plain = {dim: (axes[0][0], tuple(axes[i][1] for i in range(dim))) for dim, axes in totals.items()}
    means = {dim: np.array([float(Fraction(s, n)) for s in sums]) for dim, (n, sums) in plain.items()}
    fits: dict[int, Whitening] = {}
    for dim, moments in (_moments(fit, None, means) if means else {}).items():
        n, axis_sums = plain[dim]
        covariance = _even(moments / n)
        values, vectors = top_components(covariance, components)
        there = values > 128 * dim * np.finfo(float).eps * values.max(initial=0.0)
        fits[dim] = Whitening(n, axis_sums, values[there], vectors[:, there], float(np.trace(covariance)))
    checked = _moments(fit, fits, means) if fits else {}
    return {dim: Whitening(f.n, f.sums, f.values, f.vectors, f.trace,
                           float(np.abs(checked[dim] / f.n - np.eye(len(f.values))).max(initial=0.0))) for dim, f in fits.items()}


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per usable row and component ``vec_id, component, n, deviation, whitened, explained, identity_error, dim``.

    Rows whose vector is null or empty or holds null or non-finite entries have no rows in the result. Each other
    entry c counts as ``floor(scale * c)``, limited to the range of a long. The fit takes each distinct rounded vector
    once; vectors of different lengths have fits of their own. ``n`` is the number of vectors fitted, ``deviation`` the
    exact sum over the axes of ``(n * x - S) ** 2`` (null where that exceeds a long), ``whitened`` the projection over
    the root of the eigenvalue, ``explained`` the eigenvalue's share of the trace, ``identity_error`` the largest entry of
    the whitened covariance less the identity. Components go by falling eigenvalue from 1; those with eigenvalue zero
    (to double precision: fewer distinct vectors than axes, constant axes) have no rows, so one vector alone has none.
    Null and repeated ids are kept as they are; other columns are not read. No rows give no rows.
    """
    rounded = F.transform(name(vector_column), lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    rows = stored(vectors.where(finite(name(vector_column))).select(name(id_column).alias("vec_id"), rounded.alias("x")), "rounded")
    fits = fit_whitening(stored(rows.select("x").distinct(), "fit"), components)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch):
                f = fits[x.shape[1]]
                k = len(f.values)
                each = np.repeat(np.arange(len(part)), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch["vec_id"].take(pa.array(part[each])), "component": pa.array(np.tile(np.arange(1, k + 1), len(part)), pa.int32()),
                    "n": pa.array(np.full(len(each), f.n), pa.int64()), "deviation": pa.array(f.deviations(x), pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(f.project(x).reshape(-1), pa.float64()), "explained": pa.array(np.tile(f.values / f.trace, len(part)), pa.float64()),
                    "identity_error": pa.array(np.full(len(each), f.identity_error), pa.float64()), "dim": pa.array(np.full(len(each), x.shape[1]), pa.int32())})

    kinds = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
             ("explained", T.DoubleType()), ("identity_error", T.DoubleType()), ("dim", T.IntegerType())]
    return rows.mapInArrow(told, T.StructType([rows.schema["vec_id"], *[T.StructField(c, kind) for c, kind in kinds]]))
