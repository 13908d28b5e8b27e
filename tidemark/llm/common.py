"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode a temporary one where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, what: str, options: dict | None = None) -> DataFrame:
    """df as a table in the shared folder, written with these options: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{what}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    done._written_to = path
    return done


def forget(df: DataFrame) -> None:
    """Removes the folder of a written table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A key is hot if it holds more than this share of a table's rows; so there are few hot keys, and they may be broadcast.
HOT = 1000


def keyed(rows: DataFrame, known: DataFrame, key: str, count: str, keep: bool = False, how: str = "inner") -> DataFrame:
    """rows joined to known, which has one row for each of its keys and tells in ``count`` how many rows have it.

    A hot key's rows stay where they are and meet known by broadcast; all others are shuffled by key. The hot keys, of
    which there are fewer than HOT, are named in the plan. keep: with the column ``count``.
    """
    total = known.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > total
    names = [r[0] for r in known.where(hot).select(key).collect()]
    few, many = known.where(hot), known.where(~hot)
    if not keep:
        few, many = few.drop(count), many.drop(count)
    if not names:
        return rows.join(many, key, how)
    named = F.coalesce(F.col(key).isin(names), F.lit(False))
    return rows.where(named).join(F.broadcast(few), key).unionByName(rows.where(~named).join(many, key, how))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, remainder: int, modulus: int = 5) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder
