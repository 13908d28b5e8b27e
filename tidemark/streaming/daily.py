"""Streaming: daily snapshots from a file stream, with a watermark, and idempotent upserts per micro-batch.

An addition: the source of these semantics polls instead of streaming.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.merge import Policy
from tidemark.operators.store import shared_dir
from tidemark.streaming.upserts import BucketedTable, append_once, upsert_stream


def daily_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "1 day") -> DataFrame:
    """(day, key, n, total) in tumbling days; rows later than ``late`` behind the watermark go."""
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    days = stamped.groupBy(F.window("__ts", "1 day"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), key, "n", "total")


def file_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, then stop; a rerun goes on where the checkpoint ends."""
    df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: The last event of a user and type in an hour counts; the first one's time stays.
VISITS = Policy({"user_id": None, "event_type": None, "hour": None}, ("value", "props"))


def visits(events: DataFrame) -> DataFrame:
    return events.withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))


def _stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Events upserted from a stream whose only batch is delivered three times: by the stream, again under its number,
    and again under the next one. The table is as after one delivery."""
    events = spark.read.parquet(f"{d}/events.parquet")
    base = f"{shared_dir(spark)}/upserts-{uuid.uuid4().hex}"
    stream = visits(spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(d))
    table = BucketedTable(spark, f"{base}/table", stream.schema, VISITS, ["ts", "event_id"], buckets=16)
    upsert_stream(stream, table, f"{base}/checkpoint")
    last = table._manifests()[-1]
    table.merge(visits(events), last)
    table.merge(visits(events), last + 1)
    return table.rows().select("user_id", "event_type", "hour", F.col("event_id").alias("first_id"), "value", "props")


def _stream_append(spark: SparkSession, d: str) -> DataFrame:
    """Events of a feed that delivers each of them twice, once each, by type."""
    events = spark.read.parquet(f"{d}/events.parquet")
    base = f"{shared_dir(spark)}/appends-{uuid.uuid4().hex}"
    twice = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    run_available(append_once(twice, ["event_id"], "ts").drop("copy"), f"{base}/events", f"{base}/checkpoint")
    return spark.read.schema(events.schema).parquet(f"{base}/events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """The stream's result over the events table, read as one file stream in complete mode.

    Each call has a folder of its own in the shared one, so it reads all events again; the sink is a Parquet table.
    """
    events = spark.read.parquet(f"{d}/events.parquet")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    days = daily_counts(spark.readStream.schema(events.schema).option("pathGlobFilter", "events*.parquet").parquet(d))

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/days")

    days.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(days.schema).parquet(f"{base}/days")


Q = {
    "stream_daily": (
        _stream_daily,
        "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    ),
    "stream_upsert": (
        _stream_upsert,
        "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H') AS hour, arg_min(event_id, (ts, event_id)) AS first_id, arg_max({'v': value}, (ts, event_id)).v AS value, arg_max({'p': props}, (ts, event_id)).p AS props FROM events GROUP BY 1, 2, 3",
    ),
    "stream_append": (_stream_append, "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1"),
}
