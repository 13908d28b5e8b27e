"""Agreement, overlap and sampling operators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.store import cut


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's κ over half-even rounded ratings: (n, po, pe, kappa).

    1 for one category or pe of 1, 0 for no pairs. The confusion table is bounded by the rating scale.
    """
    rated = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.bround(F.col(a).cast("double")).alias("a"), F.bround(F.col(b).cast("double")).alias("b"))
    cells = rated.groupBy("a", "b").agg(F.count("*").alias("c"))
    sides = cells.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("k")), F.struct(F.lit("b").alias("side"), F.col("b").alias("k")))).alias("s"), "c")
    marginal = sides.groupBy("s.k").agg(F.sum(F.when(F.col("s.side") == "a", F.col("c")).otherwise(0)).alias("x"), F.sum(F.when(F.col("s.side") == "b", F.col("c")).otherwise(0)).alias("y"))
    chance = marginal.agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"), F.count("*").alias("cats"))
    seen = cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    both = seen.join(F.broadcast(chance))  # one row each
    n = F.nullif(F.col("n"), F.lit(0))
    po, pe = F.col("same") / n, F.col("xy") / (n * n)
    value = F.when(F.col("n") == 0, 0.0).when((F.col("cats") <= 1) | (F.abs(1 - pe) < 1e-12), 1.0).otherwise(F.round((po - pe) / (1 - pe), 4))
    return both.select("n", F.round(po, 4).alias("po"), F.round(pe, 4).alias("pe"), value.alias("kappa"))


def pair_ratings(left: DataFrame, right: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Left rows (duplicates kept) with the last right rating of their key."""
    last = right.groupBy(key).agg(F.max_by(value, seq).alias("b"))
    return left.select(key, F.col(value).alias("a")).join(last, key)


def tokens(text: Column) -> Column:
    """Letters and digits in runs, lower-cased; CJK characters alone. No text: one placeholder token."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[一-鿿]|[\p{L}\p{N}&&[^一-鿿]]+"), F.lit(0))
    return F.when(F.size(found) == 0, F.array(F.lit("空"))).otherwise(found)


def hits(a: list[str], b: list[str], n: int) -> int:
    """Clipped overlap of the n-grams of two texts."""
    left, right = (Counter(zip(*(x[i:] for i in range(n)))) for x in (a, b))
    return sum(min(c, right[g]) for g, c in left.items() if g in right)


def _worded(rows: DataFrame, predict: str, target: str, *columns: str) -> DataFrame:
    """The columns, both texts' tokens apart by blanks, which no token holds, and the numbers of tokens."""
    each = rows.select(*columns, tokens(F.col(predict)).alias("__a"), tokens(F.col(target)).alias("__b"))
    return each.select(*columns, F.array_join("__a", " ").alias("__p"), F.array_join("__b", " ").alias("__t"), F.size("__a").alias("__np"), F.size("__b").alias("__nt"))


def _f1_n(n: int) -> Column:
    """F1 of ``_worded`` rows by n-grams, each row by itself: grams are never shuffled."""
    @F.pandas_udf("long")
    def hit(p: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([hits(a.split(" "), b.split(" "), n) for a, b in zip(p, t)], dtype="int64")

    both = sum((F.greatest(F.col(c) - (n - 1), F.lit(0)) for c in ("__np", "__nt")), F.lit(0))
    return F.when(both > 0, F.round(2 * hit("__p", "__t") / both, 6)).otherwise(0.0)


def _f1_l() -> Column:
    """F1 of ``_worded`` rows by the longest common subsequence."""
    @F.pandas_udf("double")
    def f1(p: pd.Series, t: pd.Series) -> pd.Series:
        words = ((a.split(" "), b.split(" ")) for a, b in zip(p, t))
        return pd.Series([round(2 * lcs_length(a, b) / (len(a) + len(b)), 6) for a, b in words], dtype="float64")

    return f1("__p", "__t")


def rouge_n(rows: DataFrame, n: int, keys: tuple[str, ...], predict: str = "predict", target: str = "label") -> DataFrame:
    """ROUGE-n F1 of each row: clipped n-gram overlap, counted within the row, in Arrow batches."""
    return _worded(rows, predict, target, *keys).select(*keys, _f1_n(n).alias("f1"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        u = row & where.get(y, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def rouge_l(rows: DataFrame, keys: tuple[str, ...], predict: str = "predict", target: str = "label") -> DataFrame:
    """ROUGE-L F1 of each row; the subsequence needs Python, in Arrow batches."""
    return _worded(rows, predict, target, *keys).select(*keys, _f1_l().alias("f1"))


def metric_delta(base: DataFrame, tuned: DataFrame, key: str, value: str) -> DataFrame:
    both = base.select(key, F.col(value).alias("base")).join(tuned.select(key, F.col(value).alias("tuned")), key)
    return both.withColumn("delta", F.round(F.col("tuned") - F.col("base"), 4))


def hash_rank(key: Column, seed: int) -> Column:
    """A seeded pseudo-random order that both engines share."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows: n // strata from each stratum, the rest from what is left over, in hash order.

    A histogram of hash beginnings tells first which of a stratum's rows can be among its n // strata; only these are
    ranked, so that no task sorts a whole stratum.
    """
    strata = df.select(stratum).distinct().count()
    base = n // max(1, strata)
    hashed = df.withColumn("__h", hash_rank(F.col(key), seed)).withColumn("__b", F.left("__h", F.lit(3)))
    counts = hashed.groupBy(F.col(stratum).alias("__s"), F.col("__b").alias("__c")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    low = counts.withColumn("__below", F.coalesce(before, F.lit(0))).where(F.col("__below") < base).select("__s", "__c")
    match = F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__c"))
    near, far = hashed.join(low, match, "left_semi"), hashed.join(low, match, "left_anti")
    ranked = near.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key)))
    first = ranked.where(F.col("__r") <= base).drop("__r")
    missing = max(0, n - first.count())
    rest = ranked.where(F.col("__r") > base).drop("__r").unionByName(far).orderBy("__h", key).limit(missing)
    return first.unionByName(rest).drop("__h", "__b")


def split(df: DataFrame, key: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): exactly int(n * share) test rows, those of smallest hash.

    A histogram of hash beginnings, 65,536 rows at most, tells where the cut lies; only rows there are sorted.
    """
    ranked = df.withColumn("__h", F.struct(hash_rank(F.col(key), seed).alias("h"), F.col(key).alias("k")))
    start = F.left("__h.h", F.lit(4))
    counts = sorted((r["b"], r["n"]) for r in ranked.groupBy(start.alias("b")).agg(F.count("*").alias("n")).collect())
    n = int(sum(c for _, c in counts) * share)
    if n <= 0:
        return df, df.limit(0)
    below = 0
    for bucket, c in counts:
        if below + c >= n:
            break
        below += c
    edge = ranked.where(start == bucket).orderBy("__h").select("__h").offset(n - below - 1).limit(1)
    marked = ranked.join(F.broadcast(edge.select(F.col("__h").alias("__cut"))))
    return marked.where("__h > __cut").drop("__h", "__cut"), marked.where("__h <= __cut").drop("__h", "__cut")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with running numbers from 1 in the order of a column: ranges are numbered apart, and each starts where the others end."""
    ranges = cut(df.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id()))
    sizes = ranges.groupBy(F.col("__p").alias("__q")).agg(F.count("*").alias("__n"))  # a row for each partition
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranges.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(order)))
    return placed.join(F.broadcast(starts), F.col("__p") == F.col("__q")).withColumn(name, F.col("__r") + F.col("__start")).drop("__p", "__q", "__n", "__r", "__start")


def nth(df: DataFrame, column: str, n: int, buckets: int = 4096) -> int | None:
    """The n-th smallest whole number of a column, None if there are fewer: histograms of ``buckets`` counts narrow its range."""
    low, high, count = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < 1 or count < n:
        return None
    while low < high:
        width = (high - low) // buckets + 1
        inside = df.where(F.col(column).between(low, high)).select(F.expr(f"(CAST({column} AS DECIMAL(20, 0)) - {low}BD) div {width}").alias("b"))
        for b, c in sorted((r["b"], r["n"]) for r in inside.groupBy("b").agg(F.count("*").alias("n")).collect()):
            if c >= n:
                break
            n -= c
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)
    return low


def rouge_summary(rows: DataFrame, by: str, keys: tuple[str, ...] = (), predict: str = "predict", target: str = "label") -> DataFrame:
    """(by, n, rouge1, rouge2, rougel): mean F1 of each group, to four places; every row counts, whatever its keys."""
    own = _worded(rows, predict, target, by).select(by, _f1_n(1).alias("rouge1"), _f1_n(2).alias("rouge2"), _f1_l().alias("rougel"))
    return own.groupBy(by).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in ("rouge1", "rouge2", "rougel")))


#: The scores of a manual evaluation sheet.
SCORES = ("fact_correctness", "logic_coherence", "completeness")


def scored(rows: DataFrame) -> DataFrame:
    """Rows that have all scores, with their overall score."""
    values = [F.col(c).try_cast("double") for c in SCORES]
    full = rows.withColumns({c: v for c, v in zip(SCORES, values)}).dropna(subset=list(SCORES))
    return full.withColumn("overall_score", F.round(sum((F.col(c) for c in SCORES[1:]), F.col(SCORES[0])) / len(SCORES), 4))


def manual_summary(rows: DataFrame, by: str, total: str = "all") -> DataFrame:
    """Number and average scores for each group of scored rows, and a row for all."""
    means = [F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(f"{c}_avg") for c in (*SCORES, "overall_score"))]
    return rows.groupBy(by).agg(*means).unionByName(rows.agg(*means).withColumn(by, F.lit(total)))


def agreement(left: DataFrame, right: DataFrame, key: str, seq: str, fields: tuple[str, ...] = (*SCORES, "overall_score")) -> DataFrame:
    """(field, n, po, pe, kappa) of two reviewers' sheets, matched by key."""
    out = None
    for f in fields:
        one = kappa(pair_ratings(left, right, key, seq, f), "a", "b").withColumn("field", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


def quotas(total: int, weights: dict[str, int]) -> dict[str, int]:
    """floor(total * share) for each, the remainder one by one in the given order; nothing for total <= 0."""
    if total <= 0:
        return dict.fromkeys(weights, 0)
    whole = sum(weights.values())
    out = {k: total * w // whole for k, w in weights.items()}
    for k in list(out)[: total - sum(out.values())]:
        out[k] += 1
    return out
