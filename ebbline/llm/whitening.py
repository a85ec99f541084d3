"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

One pass gives the number of vectors, sums and products of all dimensions as exact integers (an entry c
counts as `floor(1024 * c)`; a constant added to all entries changes no centred value). From them come the
scatter `n * sum(x x') - S S'`, exact and centred before it is rounded, and the covariance V. Pivoted Cholesky gives
`V = L L'` down to its rank; rotations from the right make the columns of L orthogonal, `L R = U diag(s)`, and
`V = U diag(s^2) U'`: squared column norms are eigenvalues and normalised columns are components.

What reaches the driver is d * (d + 1) / 2 sums, bounded by the dimension d; tasks send one partial sum
each, added up by Spark under one key a pair of dimensions. Vectors never leave their task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.shared import quoted

#: Scale of an entry, and what is added to it.
SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
#: Rows turned into arrays at a time.
BLOCK_ROWS = 4_096
#: Products of whole numbers are exact in doubles up to here.
EXACT = 2.0**53


def _vectors(batch: pa.RecordBatch, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and `floor(1024 c)` as a matrix of doubles, for the usable vectors of each length."""
    lists = batch.column("vector").cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)  # null entries become NaN
    lengths, usable = np.diff(offsets), lists.is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[usable]) if dims is None else [dims]:
        if d == 0:
            continue
        rows = np.flatnonzero(usable & (lengths == d))
        for at in range(0, len(rows), BLOCK_ROWS):
            some = rows[at : at + BLOCK_ROWS]
            matrix = values[offsets[some][:, None] + np.arange(d)]
            good = np.isfinite(matrix).all(axis=1)
            if good.any():
                yield some[good], np.floor(matrix[good] * SCALE)


def _products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and products y' y as Python integers; y holds whole numbers."""
    most = float(np.abs(y).max(initial=1.0))
    sums, gram = np.zeros(y.shape[1], object), np.zeros((y.shape[1],) * 2, object)
    if most * most > EXACT:  # too large for one product: work on Python integers
        y = np.array([[int(v) for v in row] for row in y], object)
        return y.sum(axis=0), y.T @ y
    step = max(1, int(EXACT / (most * most)))
    for at in range(0, len(y), step):
        part = y[at : at + step]
        sums += part.sum(axis=0).astype(np.int64).astype(object)
        gram += (part.T @ part).astype(np.int64).astype(object)
    return sums, gram


_SUMS = pa.schema([("dims", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.decimal128(38, 0))])


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a pair of dimensions i <= j; i = -1 has the sums, i = j = -1 the number of vectors."""
    found: dict[int, list] = {}
    for batch in batches:
        for rows, y in _vectors(batch):
            d = y.shape[1]
            held = found.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
            sums, gram = _products(y)
            held[0] += len(rows)
            held[1] += sums
            held[2] += gram
    for d, (n, sums, gram) in found.items():
        i, j = np.triu_indices(d)
        first = np.concatenate(([-1], np.full(d, -1), i))
        second = np.concatenate(([-1], np.arange(d), j))
        totals = [n, *sums.tolist(), *gram[i, j].tolist()]
        arrays = [np.full(len(first), d), first, second]
        yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int32)) for a in arrays), pa.array(map(_decimal, totals), pa.decimal128(38, 0))], schema=_SUMS)


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(int(value))


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with `v = L L'`, as many columns as v has rank; the largest remaining diagonal entry is next.

    Rows are those of v, so L is lower triangular up to the order of its rows. It ends where the rest is rounding.
    """
    v = np.array(v, np.float64)
    d, rest, factor = len(v), np.diag(v).copy(), np.zeros_like(v)
    least = max(float(rest.max(initial=0.0)), 0.0) * d * np.finfo(float).eps
    for k in range(d):
        pivot = int(np.argmax(rest))
        if rest[pivot] <= least:
            return factor[:, :k]
        column = v[:, pivot] - factor[:, :k] @ factor[pivot, :k]
        factor[:, k] = column / np.sqrt(rest[pivot])
        rest = rest - factor[:, k] ** 2
        rest[pivot] = 0.0
    return factor


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of factor rotated in pairs until all are orthogonal to rounding."""
    a = np.asfortranarray(factor, np.float64).copy(order="F")
    r = a.shape[1]
    for _ in range(sweeps):
        turned = False
        for p in range(r - 1):
            for q in range(p + 1, r):
                x, y = a[:, p], a[:, q]
                alpha, beta, gamma = x @ x, y @ y, x @ y
                if alpha < beta:  # larger norms move to the front
                    a[:, p], a[:, q] = y.copy(), x.copy()
                    x, y, alpha, beta = a[:, p], a[:, q], beta, alpha
                if abs(gamma) <= 1e-15 * np.sqrt(alpha * beta):
                    continue
                turned = True
                zeta = (beta - alpha) / (2.0 * gamma)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.sqrt(1.0 + zeta * zeta))
                c = 1.0 / np.sqrt(1.0 + t * t)
                a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    return a


@dataclass
class Whitening:
    """Fitted numbers: n, exact sums of floor(1024 c), unit components (rows) by falling eigenvalue, trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(quoted(id_col).alias("id"), quoted(vector_col).alias("vector"))


def fit_whitening(df: DataFrame, vector_col: str = "embedding") -> Whitening | None:
    """Fit over all usable vectors: not null, without null or non-finite entries, of the commonest length.

    Of equally common lengths the larger counts; an empty vector is not usable. None without usable vectors.
    Repeated vectors count as often as they occur.
    """
    partial = df.select(quoted(vector_col).alias("vector")).mapInArrow(_partial_sums, "dims int, i int, j int, total decimal(38,0)")
    totals = partial.groupBy("dims", "i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    totals = totals.persist()
    try:
        counts = totals.where("i = -1 AND j = -1").orderBy(F.desc("total"), F.desc("dims")).limit(1).collect()
        if not counts:
            return None
        d, n = counts[0]["dims"], int(counts[0]["total"])
        table = totals.where(F.col("dims") == d).toArrow()
    finally:
        totals.unpersist()
    sums, gram = [0] * d, {}
    for i, j, total in zip(*(table.column(c).to_pylist() for c in ("i", "j", "total")), strict=True):
        if i >= 0:
            gram[i, j] = int(total)
        elif j >= 0:
            sums[j] = int(total)
    v = np.empty((d, d))
    for (i, j), total in gram.items():
        v[i, j] = v[j, i] = (n * total - sums[i] * sums[j]) / (n * n)
    columns = jacobi_columns(pivoted_cholesky(v))
    norms = np.sqrt((columns**2).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return Whitening(n, sums, (columns[:, order] / norms[order]).T.copy(), norms[order] ** 2, float(np.trace(v)))


def _project(fit: Whitening, y: np.ndarray, k: int) -> np.ndarray:
    """Centred rows on the first k components, over the roots of their eigenvalues."""
    centred = y - np.array([s / fit.n for s in fit.sums])
    return centred @ (fit.components[:k] / np.sqrt(fit.eigenvalues[:k])[:, None]).T


def identity_error(df: DataFrame, fit: Whitening, vector_col: str = "embedding", components: int = COMPONENTS) -> float:
    """Largest absolute entry of (covariance of all whitened vectors - identity); 0 without components.

    Tasks send their number of rows, means and centred products, which are merged by Spark's sums.
    """
    k = min(components, len(fit.eigenvalues))
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, y in _vectors(batch, fit.dims):
                w = _project(fit, y, k)
                sums += w.sum(axis=0)
                products += w.T @ w
        i, j = np.triu_indices(k)
        cells = [*((-1, c, s) for c, s in enumerate(sums.tolist())), *zip(i.tolist(), j.tolist(), products[i, j].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["i", "j", "total"])

    partial = df.select(quoted(vector_col).alias("vector")).mapInArrow(moments, "i int, j int, total double")
    cells = partial.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    means = {r["j"]: r["total"] / fit.n for r in cells if r["i"] < 0}
    # The vectors are centred already: the mean taken off here is rounding.
    return max(abs(r["total"] / fit.n - means[r["i"]] * means[r["j"]] - (r["i"] == r["j"])) for r in cells if r["i"] >= 0)


def _whiten(fit: Whitening, components: int) -> Callable:
    k = min(components, len(fit.eigenvalues))
    most = 2**63 - 1

    def deviations(y: np.ndarray) -> list[int | None]:
        largest = float(np.abs(y).max(initial=1.0)) * fit.n + max(map(abs, fit.sums))
        if largest * largest * fit.dims < 2.0**62:
            apart = y.astype(np.int64) * fit.n - np.array(fit.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum((fit.n * int(v) - s) ** 2 for v, s in zip(row, fit.sums, strict=True)) for row in y.tolist()]
        return [e if e <= most else None for e in exact]

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, y in _vectors(batch, fit.dims):
                ids, w = batch.column("id").take(pa.array(rows)), _project(fit, y, k)
                each = np.repeat(np.arange(len(rows)), k)
                deviation = pa.array(deviations(y), pa.int64()).take(pa.array(each))
                component = np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(each)), pa.array(component), deviation, pa.array(w.reshape(-1))], names=["id", "component", "deviation", "whitened"])

    return whiten


def whiten(df: DataFrame, fit: Whitening | None = None, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: `id`, `component`, `n`, `deviation`, `whitened`, `explained`.

    Components are numbered from 1 by falling eigenvalue; one whose eigenvalue is 0 (constant or linearly
    dependent dimensions) cannot be whitened and gives no row, nor do unusable vectors (see `fit_whitening`).
    deviation is the exact sum of `(n * x - S)^2`, null where it is beyond a long. Repeated rows and null ids
    give rows as any other; an empty table gives an empty result. Other columns are not read.
    """
    fit = fit or fit_whitening(df, vector_col)
    rows = _rows(df, id_col, vector_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, component int, deviation long, whitened double"
    if fit is None or not len(fit.eigenvalues):
        found = df.sparkSession.createDataFrame([], schema)
        return found.select("id", "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.lit(0.0).alias("explained"))
    shares = F.array(*(F.lit(float(e / fit.trace)) for e in fit.eigenvalues[:components]))
    found = rows.mapInArrow(_whiten(fit, components), schema)
    return found.select("id", "component", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("component") - 1].alias("explained"))
