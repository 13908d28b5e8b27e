"""Embedding whitening from an exact integer scatter.

Vectors are integers, x = floor(scale * c) + offset. A shift, the integer vector of one row, is subtracted; each task
adds up the differences and their cross-products in arbitrary precision and gives them out as signed limbs of 30 bits,
which Spark adds by position, so no sum can overflow and the result does not depend on how rows are dealt out. Of the
sums the driver forms n * X'X - S S' exactly, d * d whole numbers for vectors of length d, and only then turns it into
floating-point numbers, which eigh takes apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a limb; sums of up to 2**33 limbs fit a long.
LIMB = 30
#: Rows of cross-products that are added at once.
ROWS = 4096


def whole(values: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """floor(scale * c) + offset, as longs where they are far from the end of a long, else as Python's integers."""
    if not values.size or np.abs(values).max() < 2.0**40:
        return np.floor(values * scale).astype(np.int64) + offset
    exact = [int(c) * scale if abs(c) >= 2.0**53 else math.floor(c * scale) for c in values.ravel().tolist()]
    return np.array([x + offset for x in exact], object).reshape(values.shape)


def _fits(x: np.ndarray, terms: int) -> bool:
    """Whether sums of so many products of two of these integers stay in a long."""
    return x.dtype != object and (not x.size or int(np.abs(x).max()) ** 2 * terms < 2**62)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) for each length among the vectors of a batch."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)]


@dataclass
class Sums:
    """n, and the sums and cross-products of what is left of a vector after the shift."""

    n: int
    first: np.ndarray
    cross: np.ndarray

    @classmethod
    def none(cls, dim: int) -> Sums:
        return cls(0, np.zeros(dim, object), np.zeros((dim, dim), object))

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), ROWS):
            d = x[at : at + ROWS]
            if not _fits(d, len(d)):
                d = d.astype(object)
            elif int(np.abs(d).max(initial=0)) ** 2 * len(d) < 2**52:  # exact in floating point too, where products are fast
                self.cross += (d.astype(float).T @ d.astype(float)).astype(np.int64).astype(object)
                self.first += d.sum(axis=0).astype(object)
                continue
            self.first += d.sum(axis=0).astype(object)
            self.cross += (d.T @ d).astype(object)
        self.n += len(x)


def _limbs(x: int) -> list[int]:
    out, sign, x = [], -1 if x < 0 else 1, abs(x)
    while x:
        out.append(sign * (x & ((1 << LIMB) - 1)))
        x >>= LIMB
    return out


def _scatter(batches: Iterator[pa.RecordBatch], scale: int, offset: int, shifts: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    """(dim, i, j, limb, value) of a task: cross-products at (i, j), sums at (i, -1), the count at (-1, -1)."""
    sums: dict[int, Sums] = {}
    for b in batches:
        for _, v in _by_length(b.column(0)):
            dim, x = v.shape[1], whole(v, scale, offset)
            shift = np.array(shifts[dim], object)
            small = x.dtype != object and all(abs(s) < 2**62 for s in shifts[dim])
            sums.setdefault(dim, Sums.none(dim)).add(x - shift.astype(np.int64) if small else x.astype(object) - shift)
    for dim, s in sums.items():
        cells = [(-1, -1, s.n), *((i, -1, int(x)) for i, x in enumerate(s.first)), *((i, j, int(s.cross[i, j])) for i in range(dim) for j in range(i + 1))]
        rows = [(dim, i, j, k, limb) for i, j, x in cells for k, limb in enumerate(_limbs(x))]
        names, kinds = ["dim", "i", "j", "limb", "value"], [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


@dataclass
class Basis:
    """What whitens vectors of one length: count, exact sums of x, and the leading components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def basis(n: int, shift: list[int], first: list[int], cross: np.ndarray, components: int) -> Basis:
    """From the count, and the sums and cross-products after the shift; a component without variance gets the value 0."""
    s = np.array(first, object)
    scatter = n * cross - np.outer(s, s)  # exact, and the same for any shift
    cov = np.array([[x / (n * n) for x in row] for row in scatter.tolist()], float)  # each entry is rounded once
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)
    trace = sum(int(scatter[i, i]) for i in range(len(s))) / (n * n)
    e = np.where(e > trace * len(s) * 2.0**-48, e, 0)
    return Basis(n, [n * a + b for a, b in zip(shift, first)], e, v, trace)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows whose vector is there and holds finite components only."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def fit(vectors: DataFrame, scale: int = 1024, offset: int = 100_000, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> dict[int, Basis]:
    """The basis of each vector length. The driver holds d * d numbers for each length d, whatever the number of rows.

    Rows count as often as they are repeated. Vectors of another length are whitened among themselves; vectors without
    components, and rows that ``usable`` leaves out, have no basis. An empty table has none at all.
    """
    rows = usable(vectors, id_col, vec_col).where(F.size("v") > 0)
    some = rows.groupBy(F.size("v").alias("dim")).agg(F.min("v").alias("v")).collect()  # one row for each length
    shifts = {r["dim"]: [int(x) for x in whole(np.array(r["v"], float), scale, offset)] for r in some}
    told = rows.select("v").mapInArrow(partial(_scatter, scale=scale, offset=offset, shifts=shifts), "dim int, i int, j int, limb int, value long")
    found: dict[int, dict[tuple[int, int], int]] = {dim: {} for dim in shifts}
    for r in told.groupBy("dim", "i", "j", "limb").agg(F.sum("value").alias("value")).collect():  # d * d numbers
        cell = found[r["dim"]]
        cell[r["i"], r["j"]] = cell.get((r["i"], r["j"]), 0) + (r["value"] << (LIMB * r["limb"]))
    out = {}
    for dim, cell in found.items():
        cross = np.array([[cell.get((max(i, j), min(i, j)), 0) for j in range(dim)] for i in range(dim)], object)
        out[dim] = basis(cell[-1, -1], shifts[dim], [cell.get((i, -1), 0) for i in range(dim)], cross, components)
    return out


def _deviations(d: np.ndarray) -> list[int]:
    """Exact sums of squares by row."""
    if _fits(d, max(1, d.shape[1])):
        return (d * d).sum(axis=1).tolist()
    return [sum(x * x for x in row) for row in d.tolist()]


def _whitened(batches: Iterator[pa.RecordBatch], scale: int, offset: int, bases: dict[int, Basis]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, kind = b.num_rows, pa.schema([("id", b.schema.field(0).type), ("dim", pa.int32()), ("deviation", pa.string()), ("whitened", pa.list_(pa.float64()))])
        dims, deviation, out = np.zeros(n, np.int32), [""] * n, [[]] * n
        for at, v in _by_length(b.column(1)):
            if not v.shape[1]:
                continue
            k = bases[v.shape[1]]
            x = whole(v, scale, offset)
            near = x.dtype != object and (int(np.abs(x).max(initial=0)) + max(map(abs, k.sums))) * k.n < 2**62
            d = k.n * x - np.array(k.sums, np.int64) if near else k.n * x.astype(object) - np.array(k.sums, object)
            far = (d / k.n).astype(float) @ k.vectors
            far = np.where(k.values > 0, far / np.sqrt(np.where(k.values > 0, k.values, 1)), np.nan)
            dims[at] = v.shape[1]
            for i, total, row in zip(at.tolist(), _deviations(d), far.tolist()):
                deviation[i], out[i] = str(total), [None if math.isnan(y) else y for y in row]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims), pa.array(deviation), pa.array(out, kind.field(3).type)], schema=kind)


def whiten(vectors: DataFrame, scale: int = 1024, offset: int = 100_000, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, dim, n, deviation, whitened, values, explained, identity_error) for each usable row.

    deviation: the decimal digits of the sum over dimensions of (n * x - S)**2, exact at any size. whitened: the vector
    along each of the leading components, null where a component has no variance (one row, equal rows, constant
    dimensions). identity_error: the largest entry of whitened's covariance minus the identity, over the components
    that have variance, null without any. Rows whose vector is null, or holds a null or non-finite component, and
    vectors without components give no row; a null id is kept, repeated rows give a row each. Extra columns, whatever
    their names, are ignored; an empty table gives an empty result. A vector is read whole, however long.
    """
    bases = fit(vectors, scale, offset, components, id_col, vec_col)
    rows = usable(vectors, id_col, vec_col).where(F.size("v") > 0)
    kind = rows.schema["id"].dataType.simpleString()
    white = rows.mapInArrow(partial(_whitened, scale=scale, offset=offset, bases=bases), f"id {kind}, dim int, deviation string, whitened array<double>")
    errors = _identity_errors(white, bases)
    told = [(dim, b.n, [float(x) for x in b.values], [float(x) / b.trace if b.trace else None for x in b.values], errors[dim]) for dim, b in bases.items()]
    named = vectors.sparkSession.createDataFrame(told, "dim int, n long, values array<double>, explained array<double>, identity_error double")  # a row for each length
    return white.join(F.broadcast(named), "dim").select("id", "dim", "n", "deviation", "whitened", "values", "explained", "identity_error")


def _identity_errors(white: DataFrame, bases: dict[int, Basis]) -> dict[int, float | None]:
    """Length -> largest entry of the covariance (divisor n, centred as it is added up) minus the identity."""
    width = max([0, *(len(b.values) for b in bases.values())])
    pairs = [(i, j) for i in range(width) for j in range(i + 1)]
    if not pairs:
        return {}
    each = white.groupBy("dim").agg(*(F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs))
    out: dict[int, float | None] = {}
    for r in each.collect():  # a row for each length
        live = [i for i, e in enumerate(bases[r["dim"]].values) if e > 0]
        out[r["dim"]] = max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if i in live and j in live), default=None)
    return out
