"""Table sources and sinks by name: Parquet, JDBC, JSON lines, CSV."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.udf import arrow_udf
from tidemark.operators.store import Log

Source = Callable[[SparkSession, str], DataFrame]
SOURCES: dict[str, Source] = {
    "parquet": lambda spark, path: spark.read.parquet(path),
    "jsonl": lambda spark, path: spark.read.json(path),
    "csv": lambda spark, path: spark.read.option("header", True).csv(path),
    "text": lambda spark, path: spark.read.text(path, wholetext=True, recursiveFileLookup=True),
}


def jdbc(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table read in ranges of a numeric column, in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def run_sources(spark: SparkSession, config: list[dict]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(union of all enabled sources, (name, error) of those that failed to resolve); a failure stops no other."""
    out, failed = None, []
    for c in config:
        if not c.get("enabled", True):
            continue
        try:
            one = SOURCES[c["format"]](spark, c["path"]).withColumn("source_name", F.lit(c["name"]))
        except Exception as e:  # any reader's error belongs to its source alone
            failed.append((c["name"], str(e)[:200]))
            continue
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out, failed


#: Backends of a table, the first of them where another is named.
BACKENDS = ("parquet", "jdbc")


def open_table(spark: SparkSession, name: str, backend: str | None, path: str, **options) -> DataFrame:
    """A table of the backend: Parquet below the path, or JDBC at it; an unknown backend is taken for the first."""
    kind = (backend or "").strip().lower()
    return jdbc(spark, path, name, **options) if kind == "jdbc" else spark.read.parquet(f"{path}/{name}.parquet")


class Reloaded:
    """What ``load`` gives, read again once it is older than ``seconds``: rules of a stream, asked for in each micro-batch."""

    def __init__(self, load: Callable[[], object], seconds: float, clock: Callable[[], float] = time.monotonic) -> None:
        self.load, self.seconds, self.clock, self.at, self.value = load, max(1.0, seconds), clock, None, None

    def get(self, force: bool = False):
        now = self.clock()
        if force or not self.value or self.at is None or now - self.at >= self.seconds:
            self.value, self.at = self.load(), now
        return self.value


def markdown(rows: DataFrame, order: str) -> DataFrame:
    """(line_no, line) of a Markdown table of rows, a report of a few groups, in the order of a column."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.orderBy(order)) + 2).alias("line_no"), cells.alias("line"))
    head = [(1, "| " + " | ".join(rows.columns) + " |"), (2, "|" + "---|" * len(rows.columns))]
    return rows.sparkSession.createDataFrame(head, "line_no int, line string").unionByName(body)


def predictions(rows: DataFrame) -> DataFrame:
    defaults = {"predict": "", "label": "", "template_type": "unknown"}
    return rows.select(*((F.coalesce(c, F.lit(v)) if c in rows.columns else F.lit(v)).alias(c) for c, v in defaults.items()))


@arrow_udf("string")
def _gb18030(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else bytes(b).decode("gb18030", "replace"))


def decode(raw: Column) -> Column:
    """Text of bytes: UTF-8, with or without a mark, else GB18030, which Spark itself doesn't read."""
    text = raw.cast("string")
    return F.regexp_replace(F.when(F.is_valid_utf8(text), text).otherwise(_gb18030(raw)), "^\ufeff", "")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def append_raw(rows: DataFrame, path: str, batch: str | None = None) -> tuple[int, int]:
    """raw_event: append-only, with ids that go on where the last batch ended; gives the first id and the number of rows.

    Equal rows get ids of their own. A batch that is given again under its name is left out and tells what it told
    before, so that what points at its ids stays right after a retry. Rows are written once as they come, each with its
    place in its partition; the partitions' sizes, a number each, then give every partition its first id.
    """
    spark, name = rows.sparkSession, batch or uuid.uuid4().hex
    log = Log(spark, f"{path}/_log")
    told = {n: log.read(n) for n in log.names()}
    if name in told:
        return told[name]["first"], told[name]["n"]
    first = max((t["first"] + t["n"] for t in told.values()), default=1)
    staged, own = f"{path}/_staged-{uuid.uuid4().hex}", F.monotonically_increasing_id()
    rows.select("*", F.shiftright(own, 33).cast("int").alias("__part"), own.bitwiseAND(2**33 - 1).alias("__place")).write.parquet(staged)
    there = spark.read.parquet(staged)
    sizes = sorted((r["__part"], r["n"]) for r in there.groupBy("__part").agg(F.count("*").alias("n")).collect())
    starts = spark.createDataFrame([(p, first + sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)], "__part int, __first long")  # a row for each task
    there.join(F.broadcast(starts), "__part").withColumn("id", F.col("__first") + F.col("__place")).drop("__part", "__place", "__first").write.mode("overwrite").parquet(f"{path}/batch={name}")
    log.commit(name, {"first": first, "n": sum(n for _, n in sizes)})
    log.fs().delete(log.hadoop(f"../{staged.rpartition('/')[2]}"), True)
    return first, sum(n for _, n in sizes)
