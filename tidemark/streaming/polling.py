"""Polling: all there is now, then stop; each micro-batch is classified by the rules as they are then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.matching import first_rule
from tidemark.sources.dictionaries import Dictionary
from tidemark.sources.tables import Reloaded


def poll(rows: DataFrame, dictionary: Dictionary, out: str, checkpoint: str, text: str, ttl: float = 1, cache: Reloaded | None = None) -> Reloaded:
    """Writes rows with (product_type, rules) to the folder ``batch=n`` of ``out``: the first rule that matches, and the
    version of the rules.

    Rules are read again in a micro-batch that finds them older than ``ttl`` seconds. A batch that is delivered again
    replaces its own folder. Gives the cache, for the next poll.
    """
    cache = cache or Reloaded(lambda: (dictionary.version(), dictionary.rules()), ttl)

    def store(batch: DataFrame, number: int) -> None:
        version, rules = cache.get()
        first = first_rule(F.col(text), [(r.pattern, r.product_type) for r in rules.types])
        batch.withColumns({"product_type": F.coalesce(first, F.lit("unknown")), "rules": F.lit(version)}).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return cache
