"""Cutting lineage in the shared checkpoint folder, and logs of what was committed to a folder."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode a temporary one where unset."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        kept = context._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the folder of spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame, what: str) -> DataFrame:
    """df, computed and written as a table in the shared folder, in columns and compressed."""
    path = f"{shared_dir(df.sparkSession)}/tables/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Log:
    """Small JSON files, each renamed into a folder once: what has been committed there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def hadoop(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def fs(self):
        return self.hadoop().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def names(self) -> list[str]:
        fs = self.fs()
        found = [x.getPath().getName() for x in fs.listStatus(self.hadoop())] if fs.exists(self.hadoop()) else []
        return sorted(n for n in found if n[0] not in "._")

    def read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def commit(self, name: str, told: dict) -> None:
        """An error if the name is there already."""
        fs, hidden = self.fs(), self.hadoop(f"_{name}-{uuid.uuid4().hex}")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if fs.exists(self.hadoop(name)) or not fs.rename(hidden, self.hadoop(name)):
            fs.delete(hidden, False)
            raise RuntimeError(f"{name} was committed by another writer")
