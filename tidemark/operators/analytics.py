"""Aggregates and rankings over price snapshots. Every operator takes its point in time as ``as_of``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.store import kept

UNSORTED = "未分类"


def label(c: str, default: str = UNSORTED) -> Column:
    """The value, or a default for null and ''."""
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def since(ts: str, as_of: str, days: int) -> Column:
    """From midnight ``days`` before as_of on, without an upper bound."""
    return F.col(ts) >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz")


def mean_price(c: str) -> Column:
    """Average of a price of two places, rounded half up without binary error: whole cents throughout."""
    cents, n = f"sum(cast(round({c} * 100) AS bigint))", f"nullif(count({c}), 0)"
    return F.expr(f"((2 * {cents} + {n}) div (2 * {n})) / 100")


def day(ts: str) -> Column:
    return F.date_format(F.col(ts), "yyyy-MM-dd")


def total_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """(name, n) for each table; a missing table counts 0."""
    some = next(t for t in tables.values() if t is not None)
    out = None
    for name, t in tables.items():
        one = (some.limit(0) if t is None else t).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def product_stats(df: DataFrame) -> DataFrame:
    """Counts by platform and raw type; null and '' are labelled afterwards, so they may give rows of equal label."""
    return df.groupBy("platform", "product_type").agg(F.count("*").alias("n")).select("platform", label("product_type").alias("product_type"), "n")


def daily_trend(a: DataFrame, b: DataFrame, a_ts: str, b_ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of both tables for each day on which either has any: one shuffle over the tagged union."""
    tagged = a.where(since(a_ts, as_of, days)).select(day(a_ts).alias("day"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    tagged = tagged.unionAll(b.where(since(b_ts, as_of, days)).select(day(b_ts).alias("day"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return tagged.groupBy("day").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b")).orderBy("day")


def price_trend(df: DataFrame, as_of: str, days: int, product_type: str | None = None, platform: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Average, least and highest price and their number for each day (and key)."""
    rows = df.where(since("snapshot_time", as_of, days) & F.col("price").isNotNull())
    for column, value in (("product_type", product_type), ("platform", platform)):
        if value:
            rows = rows.where(F.col(column) == value)
    out = rows.groupBy(day("snapshot_time").alias("day"), *keys)
    return out.agg(mean_price("price").alias("avg_price"), F.round(F.min("price"), 2).alias("min_price"), F.round(F.max("price"), 2).alias("max_price"), F.count("*").alias("n")).orderBy("day", *keys)


def price_by_type_origin(df: DataFrame, as_of: str, days: int, platform: str | None = None) -> DataFrame:
    rows = df.where(since("snapshot_time", as_of, days) & F.col("price").isNotNull())
    rows = rows.where(F.col("platform") == platform) if platform else rows
    rows = rows.select(label("product_type").alias("product_type"), label("origin", "未知").alias("origin"), "price")
    return rows.groupBy("product_type", "origin").agg(mean_price("price").alias("avg_price"), F.count("*").alias("n")).where("n >= 1").orderBy("product_type", F.desc("avg_price"))


def price_rank(df: DataFrame, order: str, limit: int, key: str) -> DataFrame:
    """Top rows by price; any order but price_desc ascends; ties by key."""
    by = F.desc("price") if order == "price_desc" else F.asc("price")
    return df.where(F.col("price").isNotNull()).orderBy(by, key).limit(limit)


def recent(df: DataFrame, ts: str, limit: int, key: str) -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(key)).limit(limit)


def weighted_average(df: DataFrame, avg: str = "avg_price", n: str = "n") -> Column:
    """Σ(avg·n)/Σn over rows that have both, two places; null if there are none."""
    ok = F.col(avg).isNotNull() & (F.col(n) > 0)
    return F.round(F.sum(F.when(ok, F.col(avg) * F.col(n))) / F.nullif(F.sum(F.when(ok, F.col(n))), F.lit(0)), 2)


def spread(avg: str = "avg_price") -> Column:
    """Highest less least average; null for fewer than two."""
    return F.when(F.count(avg) >= 2, F.round(F.max(avg) - F.min(avg), 2))


def channel_compare(online: DataFrame, off: DataFrame, as_of: str, days: int, theme: Column, off_theme: Column, channels: dict[str, str], offline_label: str = "offline") -> DataFrame:
    """Average of price_per_kg or price by channel under a theme, and one offline row unless it has no price."""
    name = F.col("platform")
    for code, text in channels.items():
        name = F.when(F.col("platform") == code, text).otherwise(name)
    price = F.coalesce("price_per_kg", "price")
    rows = online.where(since("snapshot_time", as_of, days) & theme & price.isNotNull())
    a = rows.groupBy(name.alias("channel")).agg(F.round(F.avg(price), 2).alias("avg_price"), F.count("*").alias("n"))
    b = off.where(since("snapshot_time", as_of, days) & off_theme & F.col("price").isNotNull()).agg(F.round(F.avg("price"), 2).alias("avg_price"), F.count("*").alias("n"))
    return a.unionByName(b.where("avg_price IS NOT NULL").withColumn("channel", F.lit(offline_label)))


def theme_kpis(compared: DataFrame) -> DataFrame:
    return compared.agg(weighted_average(compared).alias("avg_price"), spread().alias("spread"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"))


#: Buckets of a doubling of the value, in the histograms by which medians are found.
FINE = 64


def bucket(value: Column, fine: int = FINE) -> Column:
    """A whole number that never falls as the value rises: its place on a logarithmic scale, with both signs and nan last."""
    size = F.floor(F.log2(F.least(F.abs(value), F.lit(1e308)) + 1) * fine)
    return F.when(F.isnan(value), 2**20).when(value < 0, -size - 1).otherwise(size).cast("int")


#: Most open buckets that are sent to all tasks.
SENT = 500_000


def medians(rows: DataFrame, keys: list[str], value: str, buckets: DataFrame, sums: tuple[Column, ...] = (), near: tuple[str, ...] = ()) -> DataFrame:
    """(keys, sums, median) of the rows' value, exactly: the mean of the two middle ones.

    ``buckets`` is the rows' histogram (keys, b, n, lo, hi) by ``bucket``, with each bucket's least and greatest value; sums
    are further aggregates of its rows, told in the same pass. It tells in which bucket each middle place lies; a bucket
    of one or two rows, or of one value, tells the value too. What is known is written once, a row for each group. Only
    if buckets are left open are rows read once more, those of open buckets alone, counted by value and numbered within
    their bucket. Up to SENT open buckets go to all tasks, so that no other row is shuffled; ``near`` names keys by which
    rows can be left out before the joins that they come from. So no task holds a group, and what is sorted together is
    the distinct values of one bucket: a doubling's 64th.
    """
    group = Window.partitionBy(*keys)
    placed = buckets.withColumn("till", F.sum("n").over(group.orderBy("b"))).withColumn("n_all", F.sum("n").over(group))
    told, middle = (F.col("n") <= 2) | (F.col("lo") == F.col("hi")), []
    for name, place in (("low", F.expr("(n_all - 1) div 2")), ("high", F.expr("n_all div 2"))):
        at = place - (F.col("till") - F.col("n"))
        here = at.between(0, F.col("n") - 1)
        middle += [F.max(F.when(here & told, F.when(at == 0, F.col("lo")).otherwise(F.col("hi")))).alias(name), F.max(F.when(here & ~told, F.struct("b", at.alias("at")))).alias(f"{name}_in")]
    known = kept(placed.groupBy(*keys).agg(*sums, *middle), "medians")
    open_ = known.where("low_in IS NOT NULL OR high_in IS NOT NULL").select(
        *(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), "low_in", "high_in", F.explode(F.array_distinct(F.array_compact(F.array("low_in.b", "high_in.b")))).alias("kb"))
    number = open_.count()
    if not number:
        return known.withColumn("median", (F.col("low") + F.col("high")) / 2).drop("low", "high", "low_in", "high_in")

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if number <= SENT else df

    def same(names: Sequence[str], prefix: str) -> Column:
        return reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{prefix}{keys.index(c)}")) for c in names), F.lit(True))

    inner = rows.withColumn("b", bucket(F.col(value)))
    if near:
        some = open_.select(*(F.col(f"k{keys.index(c)}").alias(f"n{keys.index(c)}") for c in near), F.col("kb").alias("nb")).distinct()
        inner = inner.join(sent(some), (F.col("b") == F.col("nb")) & same(near, "n"), "left_semi")
    inner = inner.join(sent(open_), (F.col("b") == F.col("kb")) & same(keys, "k"))
    counted = inner.groupBy(*keys, "b", "low_in", "high_in", F.col(value).alias("v")).agg(F.count("*").alias("n"))
    inside = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "b").orderBy("v")))
    hits = [F.max(F.when((F.col(c)["b"] == F.col("b")) & (F.col(c)["at"] >= F.col("upto") - F.col("n")) & (F.col(c)["at"] < F.col("upto")), F.col("v"))).alias(f"{c}_v") for c in ("low_in", "high_in")]
    found = inside.groupBy(*(F.col(c).alias(f"m{i}") for i, c in enumerate(keys))).agg(*hits)
    whole = known.join(sent(found), same(keys, "m"), "left")
    median = (F.coalesce("low", "low_in_v") + F.coalesce("high", "high_in_v")) / 2
    return whole.withColumn("median", median).drop("low", "high", "low_in", "high_in", "low_in_v", "high_in_v", *(f"m{i}" for i in range(len(keys))))


def median_by(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the exact median of each group's values, nulls apart; groups without a value give no row."""
    rows = rows.where(F.col(value).isNotNull()).select(*keys, value)
    buckets = rows.groupBy(*keys, bucket(F.col(value)).alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return medians(rows, keys, value, buckets)


def price_rollup(df: DataFrame, grain: str) -> DataFrame:
    """price_history_agg: per day, week or month and key, number, least, highest, average, median and last price.

    Rows are first aggregated by group and bucket of the price, so that a group of any size is dealt to many tasks.
    """
    keys = ["agg_date", "platform", "product_type", "spec"]
    at = F.date_trunc(grain, F.col("snapshot_time").cast("timestamp_ntz")).cast("date")
    rows = df.where("price IS NOT NULL").select(at.alias("agg_date"), *keys[1:], "price", "snapshot_time", "row_key")
    last = F.struct("snapshot_time", "row_key", "price")
    parts = rows.groupBy(*keys, bucket(F.col("price")).alias("b")).agg(
        F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.sum(F.expr("CAST(round(price * 100) AS bigint)")).alias("cents"), F.max(last).alias("last")
    )
    sums = (
        F.sum("n").alias("sample_size"), F.min("lo").alias("min_price"), F.max("hi").alias("max_price"),
        F.expr("((2 * sum(cents) + sum(n)) div (2 * sum(n))) / 100").alias("avg_price"), F.max("last").getField("price").alias("last_price"),
    )
    whole = medians(rows.select(*keys, "price"), keys, "price", parts, sums, ("agg_date", "platform"))
    return whole.select(F.date_format("agg_date", "yyyy-MM-dd").alias("agg_date"), F.lit(grain).alias("agg_grain"), *keys[1:], "sample_size", "min_price", "max_price", "avg_price", F.round("median", 4).alias("p50_price"), "last_price")


def cap_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group: a windowed rank, limited before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def ratio_to_total(df: DataFrame, key: str) -> DataFrame:
    """(key, n, ratio): the total is one aggregated row, joined back."""
    c = df.groupBy(key).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.join(F.broadcast(total)).select(key, "n", F.round(F.col("n") / F.col("total"), 4).alias("ratio"))


#: The counters of a crawl that heals its credentials.
HEAL_COUNTERS = ("pages_attempted", "pages_succeeded", "token_expired_count", "level1_attempts", "level1_recovered", "level2_attempts", "level2_recovered", "level3_fused")


def heal_stats(runs: DataFrame) -> DataFrame:
    """One row: the sums of all counters and the share of pages that succeeded, 0 without any."""
    sums = runs.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in HEAL_COUNTERS))
    return sums.withColumn("page_success_rate", F.coalesce(F.round(F.col("pages_succeeded") / F.nullif(F.col("pages_attempted"), F.lit(0)), 4), F.lit(0.0)))
