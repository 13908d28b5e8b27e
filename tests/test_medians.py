"""Medians by histogram against sorted lists."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import analytics as A


def found(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double").where("v IS NOT NULL")
    return {r["k"]: r["median"] for r in A.median_by(df, ["k"], "v").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_lists(spark, seed):
    """Groups of one to 3,000 rows, ties, negatives and far-off values; a null is a key like any other."""
    at = random.Random(seed)
    rows = [(None if at.random() < 0.1 else "hot" if at.random() < 0.7 else f"k{at.randrange(300)}", at.choice((at.gauss(0, 50), float(at.randrange(-3, 4)), at.uniform(1e3, 1e9), None))) for _ in range(4000)]
    lists = {}
    for k, v in rows:
        if v is not None:
            lists.setdefault(k, []).append(v)
    got = found(spark, rows)
    assert got.keys() == lists.keys()
    assert all(got[k] == pytest.approx(statistics.median(v), rel=1e-12, abs=1e-12) for k, v in lists.items())


def test_extremes(spark):
    inf = float("inf")
    assert found(spark, [("a", -inf), ("a", 5.0), ("a", inf), ("b", inf), ("b", inf), ("c", -0.0), ("c", 0.0), ("d", 7.0)]) == {"a": 5.0, "b": inf, "c": 0.0, "d": 7.0}
    assert found(spark, []) == {}


def test_bucket_never_falls(spark):
    at = random.Random(9)
    values = sorted([at.gauss(0, 10 ** at.randrange(-6, 12)) for _ in range(2000)] + [0.0, 1e308, -1e308, 1.7e308])
    places = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select("v", A.bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert places == sorted(places)


def test_no_group_in_memory(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    plan = A.median_by(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "percentile" not in plan


@pytest.mark.parametrize("sent", (0, A.SENT))
def test_rollup_with_open_buckets(spark, monkeypatch, sent):
    """Close prices in groups of one to 400 rows, a null key among them, whether open buckets are sent or joined by shuffle."""
    monkeypatch.setattr(A, "SENT", sent)
    at = random.Random(4)
    rows = [(at.choice("AB"), at.choice(("t", None)), str(at.randrange(2)), at.randrange(10000, 10100) / 100, f"2026-01-{at.choice((1, 1, 1, 2, 9)):02d}", f"r{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "platform string, product_type string, spec string, price double, at string, row_key string").withColumn("snapshot_time", F.col("at").cast("timestamp_ntz"))
    got = {(r["agg_date"], r["platform"], r["product_type"], r["spec"]): (r["sample_size"], r["p50_price"], r["last_price"]) for r in A.price_rollup(df, "day").collect()}
    groups = {}
    for p, t, s, price, day, key in rows:
        groups.setdefault((day, p, t, s), []).append((key, price))
    assert got.keys() == groups.keys()
    assert all(got[k] == (len(v), pytest.approx(round(statistics.median(x for _, x in v), 4), abs=1e-9), max(v)[1]) for k, v in groups.items())


def test_known_medians_are_not_read_again(spark):
    """Where no bucket is left open, the written sums are all that the result needs: nothing is shuffled or joined once more."""
    df = spark.createDataFrame([("a", 1.0), ("a", 900.0), ("b", 5.0)], "k string, v double")
    plan = A.median_by(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
