"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets are shared out by weight and capped at ``passes`` times a source's size. Blocks of ``block`` words are
allocated to sources by highest quotients target / (2a + 1), each source's blocks to its groups of shards, and each
group's to its shards, by highest quotients size / (2a + 1). A shard's documents stand in seeded order as one run of words; its quota takes the run's
first blocks, again from the start after a whole pass.
"""

from __future__ import annotations

import heapq
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, written


#: Sources up to which their plan, one row for each, is broadcast; beyond, the plan is joined by a shuffle.
BROADCAST = 10_000
#: Shards of a group; a group's shards, or a source's groups, are one task's at most.
GROUP = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], passes: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none above passes * size; the excess goes to the others by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        rest = total - sum(x for i, x in enumerate(out) if i not in set(open_))
        per = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if per * weights[i] > passes * sizes[i]]
        for i in open_:
            out[i] = float(passes * sizes[i]) if i in over else per * weights[i]
        if not over:
            break
        open_ = [i for i in open_ if i not in set(over)]
    return out


def apportion(claims: list[float], seats: int) -> list[int]:
    """Sainte-Laguë: seats by highest quotients claim / (2a + 1), ties to the earlier claim.

    Starts from the rounded shares, which differ from the result by a seat for each claim at most in sum, and moves
    single seats by their quotients until the highest free quotient is no longer above the lowest taken one.
    """
    total = sum(claims)
    if total <= 0 or seats <= 0:
        return [0] * len(claims)
    got = [int(c / total * seats + 0.5) for c in claims]
    free = [(-c / (2 * got[i] + 1), i) for i, c in enumerate(claims)]
    taken = [(c / (2 * got[i] - 1), -i) for i, c in enumerate(claims) if got[i]]
    heapq.heapify(free)
    heapq.heapify(taken)

    def move(i: int, by: int) -> None:
        got[i] += by
        heapq.heappush(free, (-claims[i] / (2 * got[i] + 1), i))
        if got[i]:
            heapq.heappush(taken, (claims[i] / (2 * got[i] - 1), -i))

    def live(heap: list, low: bool) -> tuple[float, int]:
        while True:
            q, i = heap[0]
            n = abs(i)
            if low and got[n] and q == claims[n] / (2 * got[n] - 1) or not low and -q == claims[n] / (2 * got[n] + 1):
                return abs(q), n
            heapq.heappop(heap)

    short = seats - sum(got)
    for _ in range(abs(short)):
        move(live(free, False)[1], 1) if short > 0 else move(live(taken, True)[1], -1)
    while any(got):
        (high, i), (low, j) = live(free, False), live(taken, True)
        if high < low or high == low and i >= j or i == j:
            return got
        move(i, 1)
        move(j, -1)
    return got


def _shared(pdf: pd.DataFrame, part: str) -> pd.DataFrame:
    """Blocks of the parts among which the rows' common number of blocks is shared by size."""
    pdf = pdf.sort_values(part)
    pdf["blocks"] = apportion(pdf["size"].astype(float).tolist(), int(pdf["of"].iloc[0]))
    return pdf.drop(columns="of")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), block: int = 64, passes: int = 3, seed: int = 42, shard_docs: int = 400, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken) for each row of docs.

    Sources in code point order, null last, weigh ``weights`` in turn; they share the words of all documents. A
    document's taken words are its overlap with the blocks that its shard takes, at most ``passes`` times its size.
    Null and empty texts have size 0 and give 0 words; a source without words gets target 0. Repeated rows count
    each. The order in a shard is by a seeded hash of id and text, then id; equal rows share one interval's parts in
    any order. An empty table gives an empty result; other columns, whatever their names, are ignored. The driver
    holds one row for each source, a task 4,096 shards (``shard_docs`` rows each) of a source; a document belongs to
    one shard, so a hot source spreads over many. Very long texts are counted whole.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("mix"),
    )
    rows = written(rows, "sizes").withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))  # texts are read once
    spark = docs.sparkSession
    found = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (not r["key"], r["key"]))  # Python's order of str is by code point
    sizes = [r["source_size"] for r in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], passes)
    quotas = apportion(aims, max(1, round(sum(aims) / block))) if found else []
    plan = spark.createDataFrame(
        [(r["key"], s, t, q, max(1, -(-r["n"] // shard_docs))) for r, s, t, q in zip(found, sizes, aims, quotas)],
        "key string, source_size long, target double, source_blocks long, shards long",
    )
    dealt = rows.join(F.broadcast(plan) if len(found) <= BROADCAST else plan, "key").withColumn("shard", F.pmod(F.xxhash64("mix"), F.col("shards")))
    shards = dealt.groupBy("key", "shard", F.floor(F.col("shard") / GROUP).alias("grp"), "source_blocks").agg(F.sum("size").alias("size"))
    shards = written(shards, "shards")
    groups = shards.groupBy("key", "grp", F.col("source_blocks").alias("of")).agg(F.sum("size").alias("size"))
    groups = groups.groupBy("key").applyInPandas(partial(_shared, part="grp"), "key string, grp long, size long, blocks long")
    quota = shards.join(groups.select("key", "grp", F.col("blocks").alias("of")), ["key", "grp"]).select("key", "grp", "shard", "size", "of")
    quota = quota.groupBy("key", "grp").applyInPandas(partial(_shared, part="shard"), "key string, grp long, shard long, size long, blocks long")
    quota = quota.select("key", "shard", F.col("size").alias("shard_size"), "blocks")
    line = Window.partitionBy("key", "shard").orderBy("mix", "id")
    start = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = dealt.withColumn("start", start).join(quota, ["key", "shard"])
    whole = F.when(F.col("shard_size") > 0, F.floor(F.col("blocks") * block / F.col("shard_size"))).otherwise(0)
    rest = F.col("blocks") * block - whole * F.col("shard_size")
    part = F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    taken = F.least(whole * F.col("size") + part, F.col("size") * passes).cast("long")
    return placed.select("id", "source", "size", "source_size", "target", taken.alias("taken"))
