"""Keyed upserts of a stream into a table dealt into hash buckets.

A batch rewrites only the buckets that its keys fall into. New files of a bucket lie in a folder named by the batch; what
counts is the batch's manifest, a small file that names each bucket's folder and is renamed into place last. So a batch
that fails half-way leaves the table as it was, one that comes again under its number is left out, and rows that come
again under another number change nothing: the table keeps of each key the first and the last row in the order of
``seq``, and merging is a minimum and a maximum.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.merge import Policy, finished, merged, started
from tidemark.operators.store import Log


class BucketedTable:
    """A table of upserted rows in a folder that driver and executors share.

    path: the folder; schema: of the rows; seq: columns that order the rows of a key in full. The number of buckets is
    fixed at the first commit, by the manifest; a later one given here is ignored.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, policy: Policy, seq: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.policy, self.seq = spark, path.rstrip("/"), schema, policy, seq
        self.log = Log(spark, f"{self.path}/log")
        self.state = started(spark.createDataFrame([], schema), policy, seq).schema
        found = self._manifests()
        self.buckets = self._manifest(found[-1])["buckets"] if found else buckets

    def _manifests(self) -> list[int]:
        return sorted(int(n) for n in self.log.names() if n.isdigit())

    def _manifest(self, number: int) -> dict:
        return self.log.read(str(number))

    def _commit(self, number: int, told: dict) -> None:
        self.log.commit(str(number), told)

    def _read(self, folders: dict[int, str], some: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{f}/bucket={b}" for b, f in sorted(folders.items()) if some is None or b in some]
        return self.spark.read.schema(self.state).parquet(*paths) if paths else self.spark.createDataFrame([], self.state)

    def merge(self, batch: DataFrame, number: int) -> list[int]:
        """Merges a batch, and returns the buckets it rewrote; none if its number, or a later one, is committed."""
        found = self._manifests()
        if found and number <= found[-1]:
            return []
        before = self._manifest(found[-1])["folders"] if found else {}
        folders = {int(b): f for b, f in before.items()}
        new = started(batch.select(*self.schema.names), self.policy, self.seq)
        bucket = F.pmod(F.xxhash64("__key"), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())  # ``buckets`` numbers at most
        own = f"batch-{number}-{uuid.uuid4().hex}"
        if touched:
            both = merged(self._read(folders, touched).unionByName(new))
            both.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{own}")
        self._commit(number, {"buckets": self.buckets, "folders": folders | {b: own for b in touched}, "replaced": {b: folders[b] for b in touched if b in folders}})
        if found:  # what the batch before replaced is read by nobody but those who read the table two batches ago
            for b, f in self._manifest(found[-1])["replaced"].items():
                self.log.fs().delete(self.log.hadoop(f"../{f}/bucket={b}"), True)
        return touched

    def rows(self) -> DataFrame:
        """The table as the last committed batch left it."""
        found = self._manifests()
        folders = {int(b): f for b, f in self._manifest(found[-1])["folders"].items()} if found else {}
        return finished(self._read(folders), self.schema.names)


def upsert_stream(rows: DataFrame, table: BucketedTable, checkpoint: str) -> None:
    """Merges all there is of a stream, a micro-batch at a time, and stops; a rerun goes on where the checkpoint ends."""
    rows.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_once(rows: DataFrame, key: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """A feed without rows whose key came before, as far as the watermark reaches back; its state is bounded by that."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
