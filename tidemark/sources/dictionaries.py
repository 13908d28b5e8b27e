"""Rule dictionaries kept as tables: seeds merged by key, versions that readers load again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators.store import Log

#: Columns of a type rule; those of its key; rows that a dictionary may have.
TYPES = "product_type string, pattern string, priority int, confidence double, is_active boolean"
KEY = ("product_type", "pattern")
MOST = 10_000


def type_seeds(spark: SparkSession) -> DataFrame:
    """The fixed type rules, in order."""
    return spark.createDataFrame([(i, r.product_type, r.pattern, r.priority, r.confidence, True) for i, r in enumerate(R.TYPE_RULES)], f"seq long, {TYPES}")


def upserted(stored: DataFrame | None, seeds: DataFrame, seq: str = "seq") -> DataFrame:
    """A dictionary after row-by-row upserts of seeds in the order of ``seq``: (id, columns).

    A key that is there keeps its id and takes the columns of its last seed, nulls too; a new one gets the next id, in the
    order of first seeds. Rows without a part of the key go. A dictionary is small by the check of its readers.
    """
    columns = [c for c in seeds.columns if c != seq]
    new = seeds.dropna(subset=list(KEY)).groupBy(*KEY).agg(F.max_by(F.struct(*columns), seq).alias("x"), F.min(seq).alias("at"))
    if stored is None:
        old = new.select(*(F.col(c).alias(f"__{c}") for c in KEY), F.lit(0).cast("long").alias("id"), F.lit(None).cast(new.schema["x"].dataType).alias("kept")).limit(0)
    else:
        old = stored.select(*(F.col(c).alias(f"__{c}") for c in KEY), "id", F.struct(*columns).alias("kept"))
    both = old.join(new, [F.col(f"__{c}") == F.col(c) for c in KEY], "full")
    place = F.row_number().over(Window.partitionBy(F.col("id").isNull()).orderBy("at"))
    most = F.max(F.coalesce("id", F.lit(0))).over(Window.partitionBy())
    told = both.select(F.coalesce("id", most + place).cast("long").alias("id"), F.coalesce("x", "kept").alias("x"))
    return told.select("id", *(F.col("x")[c].alias(c) for c in columns))


class Dictionary:
    """Versions of a dictionary in a shared folder; readers see the last one committed, whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, Log(spark, f"{path}/log")

    def version(self) -> int:
        return max((int(n) for n in self.log.names()), default=0)

    def rows(self) -> DataFrame | None:
        n = self.version()
        return self.spark.read.parquet(f"{self.path}/v{n}") if n else None

    def upsert(self, seeds: DataFrame, seq: str = "seq") -> int:
        """Merges seeds into a new version and gives its number."""
        n = self.version() + 1
        upserted(self.rows(), seeds, seq).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v{n}")
        self.log.commit(str(n), {})
        return n

    def rules(self) -> R.Rules:
        """The active type rules of the last version, as ``enrich`` takes them."""
        rows = self.rows()
        some = rows.where("is_active").limit(MOST + 1).collect() if rows is not None else []
        if len(some) > MOST:
            raise ValueError(f"more than {MOST:,} rules")
        return R.Rules(types=tuple(R.TypeRule(r["id"], r["product_type"], r["pattern"], r["priority"], r["confidence"]) for r in sorted(some, key=lambda r: (r["priority"], r["id"]))))
