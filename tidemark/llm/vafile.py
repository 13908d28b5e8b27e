"""Exact top-k by inner product over a vector-approximation file.

Vectors are integers, floor(scale * x). Equal vectors are one class, searched once for all of its queries. The
approximation file keeps one byte a component, the number of its cell, and the length of what lies beyond the cells;
the cells of a dimension are cut at quantiles of about ``sample`` vectors. A scan of the cells gives each query a lower
and an upper bound of every score, a block of queries against a block of approximations at a time; only vectors whose
upper bound reaches the kth highest lower bound stay. Exact vectors are then read in falling order of the upper bound:
first a band of the highest, then those whose bound reaches the kth score of that band, so that the kth is certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, written

#: Cells of a dimension, numbered by a byte.
CELLS = 256
#: Approximations that are compared at once.
CHUNK = 4096
#: Vector lengths that get cells of their own; vectors of other lengths are bounded by their length alone.
LENGTHS = 64


def _whole(values: list[float], scale: int) -> np.ndarray | None:
    x = np.floor(np.array(values, float) * scale)
    return x.astype(np.int64) if len(x) and np.abs(x).max() < 2**62 else None


def _integers(batches: Iterator[pa.RecordBatch], scale: int, k: int, every: int) -> Iterator[pa.RecordBatch]:
    """(id, dim, exact, query) rows. Of equal vectors in a batch only queries and the k + 1 smallest ids stay."""
    for b in batches:
        copies: dict[bytes, list[int]] = {}
        rows = []
        for i, v in sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), key=lambda r: r[0]):
            x = _whole(v, scale)
            if x is None:
                continue
            exact, query = x.tobytes(), i % every == 0
            seen = copies.setdefault(exact, [])
            if seen and seen[-1] == i:
                continue
            if len(seen) <= k:
                seen.append(i)
            elif not query:
                continue
            rows.append((i, len(x), exact, query))
        out = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.bool_()))], names=["id", "dim", "exact", "query"])


def cells_of(some: list[bytes]) -> dict[int, np.ndarray]:
    """Vector length -> cell edges (CELLS + 1 rows, a column for each dimension) at quantiles of the sample."""
    by: dict[int, list[np.ndarray]] = {}
    for raw in some:
        x = np.frombuffer(raw, np.int64)
        by.setdefault(len(x), []).append(x)
    most = sorted(by, key=lambda d: (-len(by[d]), d))[:LENGTHS]
    return {d: np.quantile(np.stack(by[d]), np.linspace(0, 1, CELLS + 1), axis=0, method="nearest") for d in most}


def _lows(edges: np.ndarray) -> np.ndarray:
    return edges[:-1]


def _highs(edges: np.ndarray) -> np.ndarray:
    """The largest number of each cell; the last cell holds its upper edge."""
    return np.concatenate((np.maximum(edges[1:-1] - 1, edges[:-2]), edges[-1:]))


def _approximate(batches: Iterator[pa.RecordBatch], edges: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(cls, dim, cells, beyond) of (cls, dim, exact): beyond is the length of the part outside the cells, rounded up."""
    for b in batches:
        cells, beyond = [], []
        for dim, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            x, e = np.frombuffer(raw, np.int64), edges.get(dim)
            if e is None:
                cells.append(b"")
                beyond.append(float(np.linalg.norm(x.astype(float))) * (1 + 1e-9))
                continue
            inside = np.clip(x, e[0], e[-1])
            cells.append(_cell(e, inside).tobytes())
            beyond.append(float(np.linalg.norm((x - inside).astype(float))) * (1 + 1e-9))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.binary()), pa.array(beyond, pa.float64())], names=["cls", "dim", "cells", "beyond"])


def _cell(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cells of one vector by a binary search in all dimensions at once."""
    at = np.zeros(len(x), np.int64)
    dims = np.arange(len(x))
    for step in (128, 64, 32, 16, 8, 4, 2, 1):  # to the last cell whose lower edge is not above
        at += step * (edges[at + step, dims] <= x)
    return at.astype(np.uint8)


def _bounded(key: tuple, left: pd.DataFrame, right: pd.DataFrame, edges: dict[int, np.ndarray], k: int) -> pd.DataFrame:
    """Candidates of a block of queries (left) in a block of approximations (right): (query, cls, low, high)."""
    out = [pd.DataFrame({"query": pd.Series(dtype="object"), "cls": pd.Series(dtype="object"), "low": pd.Series(dtype="float64"), "high": pd.Series(dtype="float64")})]
    if not len(left) or not len(right):
        return out[0]
    q = np.stack([np.frombuffer(x, np.int64) for x in left["exact"]]).astype(float)
    up, down, size = np.maximum(q, 0), np.minimum(q, 0), np.linalg.norm(q, axis=1)
    e = edges.get(q.shape[1])
    best = np.full((len(q), k), -np.inf)
    names, queries, dims = right["cls"].to_numpy(), left["cls"].to_numpy(), np.arange(q.shape[1])
    for at in range(0, len(right), CHUNK):
        part = right.iloc[at : at + CHUNK]
        beyond = part["beyond"].to_numpy()
        if e is None:
            low = high = np.zeros((len(q), len(part)))
            long_ = beyond
        else:
            cells = np.stack([np.frombuffer(x, np.uint8) for x in part["cells"]])
            bottom, top = _lows(e)[cells, dims].astype(float), _highs(e)[cells, dims].astype(float)
            high, low = up @ top.T + down @ bottom.T, up @ bottom.T + down @ top.T
            long_ = np.linalg.norm(np.maximum(np.abs(bottom), np.abs(top)), axis=1) + beyond
        # what lies beyond the cells, and what rounding may have lost
        slack = np.outer(size, beyond + long_ * (len(dims) + 2) * 2.0**-50)
        high, low = high + slack, low - slack
        both = np.concatenate((best, low), axis=1)
        best = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
        r, c = np.nonzero(high >= best.min(axis=1)[:, None])
        out.append(pd.DataFrame({"query": queries[r], "cls": names[at + c], "low": low[r, c], "high": high[r, c], "r": r}))
    found = pd.concat(out[1:])
    return found[found["high"].to_numpy() >= best.min(axis=1)[found["r"].to_numpy()]].drop(columns="r")


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, cls, score) of (query, cls, q, exact): inner products, cut to the range of a long."""
    for b in batches:
        out = []
        for q, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            a, c = np.frombuffer(q, np.int64), np.frombuffer(x, np.int64)
            safe = float(np.abs(a.astype(float)) @ np.abs(c.astype(float))) < 2**62
            out.append(int(a @ c) if safe else max(-(2**63), min(2**63 - 1, sum(m * n for m, n in zip(a.tolist(), c.tolist())))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=["query", "cls", "score"])


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50, sample: int = 4096, block: int = 32_768, queries: int = 512, band: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, rank, id, score): for each row whose id is divisible by ``every`` its k highest inner products.

    Candidates are all other rows of the query's dimension; fewer than k give fewer ranks, ties go to the smaller id.
    Rows with a null id, and vectors null, empty, or with null or non-finite components, take no part; components
    beyond 2**62 after scaling count as non-finite, scores beyond a long are cut to its range. Repeated rows count
    once; an id with several vectors asks by the one smallest in bytes, and is never its own neighbour. An empty table
    gives an empty result; other columns, whatever their names, are ignored. Each task holds one block of
    approximations and one block of queries, whatever the table's size; very long vectors are read whole.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.mapInArrow(partial(_integers, scale=scale, k=k, every=every), "id long, dim int, exact binary, query boolean")
    rows = written(rows.withColumn("cls", F.unhex(F.md5("exact"))), "integers")
    asking = written(rows.where("query").groupBy("id").agg(F.min_by("cls", "exact").alias("cls"), F.count_distinct("cls").alias("own")), "queries")
    k1 = k + (asking.agg(F.max("own")).first()[0] or 1)  # the query's own row may be among them, for each of its vectors
    classes = rows.groupBy("cls").agg(F.min("dim").alias("dim"), F.min("exact").alias("exact"), F.slice(F.array_sort(F.collect_set("id")), 1, k1).alias("ids"))
    classes = written(classes, "classes")
    n = classes.count()
    asked = asking.groupBy("cls").agg(F.count("*").alias("rows"))
    asked = written(asked.join(classes.select("cls", "dim", "exact"), "cls"), "asked")
    edges = cells_of([bytes(r["exact"]) for r in classes.where(F.pmod(F.xxhash64("cls"), F.lit(max(1, n // sample))) == 0).select("exact").collect()])  # about ``sample`` rows
    file = written(classes.select("cls", "dim", "exact").mapInArrow(partial(_approximate, edges=edges), "cls binary, dim int, cells binary, beyond double"), "approximations")
    groups, parts = max(1, -(-n // block)), max(1, -(-asked.count() // queries))
    file = file.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(groups))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    ask = asked.withColumn("part", F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    keys = ["dim", "block", "part"]
    seen = ask.groupBy(*keys).cogroup(file.groupBy(*keys)).applyInPandas(partial(_bounded, edges=edges, k=k1), "query binary, cls binary, low double, high double")
    seen = written(seen, "bounds")
    # the kth highest lower bound over all blocks; each block sends its k highest at most
    line = Window.partitionBy("query").orderBy(F.desc("low"))
    kth = seen.select("query", "low", F.row_number().over(line).alias("n")).where(F.col("n") <= k1).groupBy("query").agg(F.min("low").alias("kth"), F.count("*").alias("n"))
    kth = kth.select(F.col("query").alias("k_id"), F.when(F.col("n") < k1, float("-inf")).otherwise(F.col("kth")).alias("kth"))
    near = seen.join(kth, F.col("query") == F.col("k_id")).where("high >= kth").select("query", "cls", "high")
    near = written(near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("high"), "cls"))), "candidates")

    def read(some: DataFrame) -> DataFrame:
        full = some.join(classes.select("cls", "exact"), "cls").join(asked.select(F.col("cls").alias("query"), F.col("exact").alias("q")), "query")
        return written(full.select("query", "cls", "q", "exact").mapInArrow(_scores, "query binary, cls binary, score long"), "scores")

    first = read(near.where(F.col("place") <= band * k1))
    best = first.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("n") == k1).select(F.col("query").alias("k_id"), "score")
    rest = near.where(F.col("place") > band * k1).join(best, F.col("query") == F.col("k_id"), "left").where(F.col("score").isNull() | (F.col("high") >= F.col("score")))
    told = first.unionByName(read(rest.select("query", "cls")))
    told = told.join(classes.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("id"))
    told = told.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k1)
    told = told.groupBy(F.col("query").alias("cls")).agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("best"))
    found = keyed(asking.select(F.col("id").alias("query"), "cls"), written(told.join(asked.select("cls", "rows"), "cls"), "told"), "cls", "rows")
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query")), 1, k)
    return found.select("query", F.posexplode(others).alias("at", "x")).select("query", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
