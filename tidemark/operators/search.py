"""Keyword search over the relations. LIKE wildcards in a keyword stay active; matching ignores case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_like(keyword: str, *columns: str) -> Column:
    return reduce(Column.__or__, (F.col(c).ilike(f"%{keyword}%") for c in columns))


def search(df: DataFrame, keyword: str | None, columns: tuple[str, ...], equal: dict[str, str | None], order: list, limit: int) -> DataFrame:
    """Conjunction of the given equalities and a keyword in any of the columns; the first ``limit`` rows in order."""
    for column, value in equal.items():
        if value:
            df = df.where(F.col(column) == value)
    if keyword:
        df = df.where(any_like(keyword, *columns))
    return df.orderBy(*order).limit(max(1, min(int(limit), 500)))


def time_of(text: Column) -> Column:
    """The first of three forms that reads: date and time, date with dashes, date with slashes."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-M-d H:mm:ss", "yyyy-M-d", "yyyy/M/d")))


def intel_order(mode: str) -> list:
    """Order of intel_item: org_time, region_time, or time for any other mode; unreadable times last, ties by id."""
    latest = [time_of(F.col("pub_time")).desc_nulls_last(), F.desc("id")]
    first = {"org_time": ["org"], "region_time": ["region"]}.get(mode, [])
    return [*first, *latest]
