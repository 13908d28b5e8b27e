"""The price and corpus relations as views of the driver's tables, for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, d: str, part: bool = True, supplier: bool = False) -> DataFrame:
    """product_snapshot: one row for each line item; price_per_kg is null where there is no discount.

    part and supplier join the tables of keyword, title, type and spec, and of shop and origin; every line has both,
    so a query that reads none of their columns does without.
    """
    rows = table(spark, d, "lineitem")
    columns = [
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"), F.col("l_returnflag").alias("platform"),
        F.col("l_extendedprice").alias("price"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_kg"),
        F.col("l_shipdate").alias("snapshot_time"), F.col("l_linestatus").alias("status"),
    ]
    if part:
        rows = rows.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        columns += [F.col("p_brand").alias("keyword"), F.col("p_name").alias("title"), F.col("p_type").alias("product_type"), F.col("p_size").cast("string").alias("spec")]
    if supplier:
        rows = rows.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        columns += [F.col("s_name").alias("shop"), F.col("n_name").alias("origin")]
    return rows.select(*columns)


PRODUCTS = """products AS (
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key, l_returnflag AS platform,
        p_brand AS keyword, p_name AS title, p_type AS product_type, CAST(p_size AS VARCHAR) AS spec, s_name AS shop,
        l_extendedprice AS price, CASE WHEN l_discount > 0 THEN l_extendedprice / l_quantity END AS price_per_kg,
        n_name AS origin, l_shipdate AS snapshot_time, l_linestatus AS status
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey)"""


def offline(spark: SparkSession, d: str) -> DataFrame:
    """offline_price_snapshot: one row for each order."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source_name"), F.col("c_mktsegment").alias("market_name"),
        F.col("o_orderstatus").alias("product_type"), F.concat_ws(" ", "c_name", "o_orderstatus").alias("product_name_raw"),
        F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("snapshot_time"), F.col("c_nationkey").alias("region"),
    )


OFFLINE = """offline AS (
    SELECT o_orderkey AS id, o_orderpriority AS source_name, c_mktsegment AS market_name, o_orderstatus AS product_type,
        concat_ws(' ', c_name, o_orderstatus) AS product_name_raw, o_totalprice AS price, o_orderdate AS snapshot_time,
        c_nationkey AS region
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def intel(spark: SparkSession, d: str) -> DataFrame:
    """intel_item: one row for each document; pub_time in three text forms, one of them unreadable."""
    day = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    form = F.col("doc_id") % 4
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"),
        F.col("source").alias("org"), F.col("lang").alias("region"),
        F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("source_type"),
        F.when(form == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(form == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(form == 2, F.date_format(day, "yyyy/MM/dd")).otherwise(F.lit("unknown")).alias("pub_time"),
        F.concat(F.lit("https://example.org/d/"), (F.col("doc_id") % 700).cast("string")).alias("source_url"),
    )


INTEL = """intel AS (
    SELECT doc_id AS id, substring(text, 1, 60) AS title, text AS content, source AS org, lang AS region,
        concat('t', doc_id % 3) AS source_type,
        CASE doc_id % 4 WHEN 0 THEN strftime(DATE '2025-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d 00:00:00')
            WHEN 1 THEN strftime(DATE '2025-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d')
            WHEN 2 THEN strftime(DATE '2025-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y/%m/%d') ELSE 'unknown' END AS pub_time,
        concat('https://example.org/d/', doc_id % 700) AS source_url
    FROM documents)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """crawl_run: one row for each event."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source_name"), F.col("ts").alias("started_at"), F.col("value").alias("items"),
        F.when(F.col("event_type") == "error", "FAIL").otherwise("SUCCESS").alias("status"), F.col("user_id"), F.col("props").alias("raw_json"),
    )


RUNS = """runs AS (
    SELECT event_id AS id, event_type AS source_name, ts AS started_at, value AS items,
        CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'SUCCESS' END AS status, user_id, props AS raw_json FROM events)"""
