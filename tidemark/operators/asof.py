"""As-of price change: latest price at or before a time against the one days earlier, by window, in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _latest(df: DataFrame, keys: list[str], as_of: Column, name: str) -> Column:
    return F.max_by("price", F.when((F.col("snapshot_time") <= as_of) & F.col("price").isNotNull(), F.struct("snapshot_time", "row_key", "price"))).alias(name)


def _percent(latest: Column, base: Column) -> Column:
    return F.when(base > 0, F.round((latest - base) / base * 100, 4))


def price_change(df: DataFrame, as_of: str, days: int, keys: tuple[str, ...] = ("platform", "product_type", "spec", "shop")) -> DataFrame:
    """(keys, latest, baseline, change_pct) at as_of; days counts 1 at least; null without or with a non-positive baseline.

    Leave ``shop`` out of keys to match any shop.
    """
    days = max(1, days)
    now = F.lit(as_of).cast("timestamp_ntz")
    before = now - F.expr(f"INTERVAL {days} DAY")
    out = df.groupBy(*keys).agg(_latest(df, list(keys), now, "latest"), _latest(df, list(keys), before, "baseline"))
    return out.select(*keys, "latest", "baseline", _percent(F.col("latest"), F.col("baseline")).alias("change_pct"))


def backfill(df: DataFrame, platform: str, today: str, days: tuple[int, ...] = (7, 30), keys: tuple[str, ...] = ("platform", "product_type", "spec")) -> DataFrame:
    """Changes against each horizon for every row of one platform and day with type and spec: a window for all rows.

    The latest price is that of the day's last row of the key; a frame that ends days earlier gives the baseline.
    """
    rows = df.where((F.col("platform") == platform) & (F.col("product_type") != "") & (F.col("spec") != "") & (F.col("snapshot_time") < F.date_add(F.lit(today).cast("date"), 1).cast("timestamp_ntz")))
    # one price for each key and day: the last
    daily = rows.where("price IS NOT NULL").groupBy(*keys, F.to_date("snapshot_time").alias("d")).agg(F.max_by("price", F.struct("snapshot_time", "row_key", "price")).alias("p"))
    n = F.datediff("d", F.lit("1970-01-01").cast("date"))
    daily = daily.withColumn("n", n)
    for h in days:
        w = Window.partitionBy(*keys).orderBy("n").rangeBetween(Window.unboundedPreceding, -h)
        daily = daily.withColumn(f"base_{h}d", F.last("p", ignorenulls=True).over(w))
    daily = daily.where(F.col("d") == F.lit(today).cast("date"))
    return daily.select(*keys, F.col("p").alias("latest"), *(_percent(F.col("p"), F.col(f"base_{h}d")).alias(f"change_{h}d") for h in days))
