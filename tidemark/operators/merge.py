"""Keyed upserts: the last row of a key gives the update columns, the first gives all others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import fallback_key, strip


@dataclass(frozen=True)
class Policy:
    """How a relation takes a row whose key it has.

    key: column -> prefix length that counts, or None; update: columns the last row sets, or, if empty, all columns but
    ``fixed``; required: a row without them goes; ignore_case: keys are compared without case.
    """

    key: dict[str, int | None]
    update: tuple[str, ...] = ()
    fixed: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    ignore_case: bool = False

    def updates(self, columns: list[str]) -> list[str]:
        return [c for c in columns if (c in self.update if self.update else c not in self.fixed)]


#: Key prefix lengths and update columns of each relation's upsert.
SNAPSHOT = Policy({"platform": 16, "product_type": 32, "spec_weight_normalized": 16, "shop": 48, "snapshot_time": None}, fixed=("platform", "product_type", "spec_weight_normalized", "snapshot_time"), ignore_case=True)
INTEL_BATCH = Policy({"source_url": 150}, ("title", "pub_time", "org", "content", "tags_json", "extra_json", "raw_id"), ignore_case=True)
INTEL_SQLITE = Policy({"source_url": None}, ("title", "content", "pub_time", "pub_time_norm", "region", "org", "source_type", "tags", "extra", "updated_at"))
INTEL_MYSQL = Policy({"source_url": 150}, ("title", "pub_time", "org", "region", "content", "tags_json", "extra_json", "fetched_at"), required=("source_url",), ignore_case=True)
PAPER = Policy({"url": 150}, ("abstract", "keywords_json", "raw_id"), ignore_case=True)
OFFLINE = Policy({"source_name": 32, "market_name": 48, "product_type": 32, "snapshot_time": None}, ("product_name_raw", "spec", "min_price", "max_price", "price", "unit", "storage_method", "date_str", "remark", "raw_id"), ignore_case=True)
#: Fixed value: what a snapshot without price unit or currency has.
CURRENCY = "CNY"


def snapshot_defaults(df: DataFrame) -> DataFrame:
    """Snapshots with the key's parts and the units filled: a type from the keyword, a specification from the URL."""

    def filled(*columns: Column) -> Column:
        return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))

    own = {
        "price_unit": filled(F.col("price_unit"), F.lit(CURRENCY)), "currency": filled(F.col("currency"), F.lit(CURRENCY)), "shop": strip(F.coalesce("shop", F.lit(""))),
        "product_type": F.left(strip(filled(F.col("product_type"), F.col("keyword"), F.lit("unknown"))), F.lit(64)),
        "spec_weight_normalized": F.left(strip(filled(F.col("spec_weight_normalized"), fallback_key(F.col("detail_url")))), F.lit(32)),
    }
    return df.withColumns(own)


def _key(df: DataFrame, policy: Policy) -> list[Column]:
    out = []
    for c, n in policy.key.items():
        text = dict(df.dtypes)[c] == "string"
        k = F.substring(c, 1, n) if n else F.col(c)
        out.append((F.lower(k) if policy.ignore_case and text else k).alias(f"__{c}"))
    return out


def upsert(df: DataFrame, policy: Policy, seq: list[str]) -> DataFrame:
    """One row for each key, as row-by-row upserts in the order of ``seq`` would leave it: one aggregate, one shuffle.

    A last row's nulls win, as they do row by row. seq must order the rows of a key in full.
    """
    for c in policy.required:
        df = df.where(F.col(c).isNotNull() & (F.trim(c) != ""))
    update = policy.updates([c for c in df.columns if c not in seq])
    insert = [c for c in df.columns if c not in update]
    order = F.struct(*seq)
    done = df.groupBy(*_key(df, policy)).agg(F.max_by(F.struct(*update), order).alias("__u"), F.min_by(F.struct(*insert), order).alias("__i"))
    return done.select(*((F.col("__u") if c in update else F.col("__i"))[c].alias(c) for c in df.columns))


def started(df: DataFrame, policy: Policy, seq: list[str]) -> DataFrame:
    """Rows as an upsert's state: a row for each key, with its first row and the update columns of its last.

    Equal rows give equal states, in whatever order or number they come; ``merged`` unites states.
    """
    for c in policy.required:
        df = df.where(F.col(c).isNotNull() & (F.trim(c) != ""))
    update = policy.updates([c for c in df.columns if c not in seq])
    order = F.struct(*seq)
    insert = F.struct(*(c for c in df.columns if c not in update))
    return merged(df.select(F.struct(*_key(df, policy)).alias("__key"), order.alias("__from"), insert.alias("__first"), order.alias("__to"), F.struct(*update, *seq).alias("__last")))


def merged(states: DataFrame) -> DataFrame:
    least, most = F.min_by("__first", "__from"), F.max_by("__last", "__to")
    return states.groupBy("__key").agg(F.min("__from").alias("__from"), least.alias("__first"), F.max("__to").alias("__to"), most.alias("__last"))


def finished(states: DataFrame, columns: list[str]) -> DataFrame:
    """What row-by-row upserts would have left: see ``upsert``."""
    last = set(states.schema["__last"].dataType.names)
    first = set(states.schema["__first"].dataType.names)
    return states.select(*(F.col("__first" if c in first else "__last")[c].alias(c) for c in columns if c in first | last))


def start_run(log: DataFrame, started: DataFrame) -> DataFrame:
    """The run log with a RUNNING row, of no items, for each of started(id, source_name, started_at)."""
    return log.unionByName(started.select("id", "source_name", "started_at", F.lit("RUNNING").alias("status"), F.lit(0).cast("long").alias("items")), allowMissingColumns=True)


def finish_run(log: DataFrame, ended: DataFrame) -> DataFrame:
    """The run log with end, status, items and error text of ended(id, ...), one row for each run; other runs stay."""
    new = ["ended_at", "status", "items", "error_text"]
    both = log.join(ended.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in new)), F.col("id") == F.col("__id"), "left")
    done = F.col("__id").isNotNull()
    return both.select(*(F.when(done, F.col(f"__{c}")).otherwise(F.col(c) if c in log.columns else F.lit(None)).alias(c) if c in new else F.col(c) for c in [*log.columns, *(c for c in new if c not in log.columns)]))


def column_prune(df: DataFrame, target: list[str], required: set[str]) -> DataFrame:
    """The columns that the target has; an error if a required one is missing from it."""
    if missing := sorted(required - set(target)):
        raise ValueError(f"target lacks required columns: {', '.join(missing)}")
    return df.select(*(c for c in df.columns if c in target))


def defaults_and_require_key(df: DataFrame, defaults: dict[str, str], key: str) -> DataFrame:
    """Blank fields take defaults; rows without the key go."""
    out = df.select(*(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in df.columns))
    return out.where(F.col(key).isNotNull() & (F.trim(key) != ""))


def latest_status(events: DataFrame, run: str, ts: str, cols: list[str], tie: str) -> DataFrame:
    """The latest event of each run."""
    return events.groupBy(run).agg(F.max_by(F.struct(*cols), F.struct(ts, tie)).alias("x")).select(run, "x.*")


def unified_feed(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def lineage(rows: DataFrame, raw: DataFrame, raw_id: str, key: str) -> DataFrame:
    return rows.join(raw, rows[raw_id] == raw[key], "left")


#: Fields of the raw export, in order, with the names they may have and their default.
EXPORTED = (
    ("source_name", ("source_name",)), ("market_name", ("market_name",)), ("region", ("region",)), ("product_type", ("product_type",)), ("品名", ("product_name", "product_name_raw")),
    ("spec", ("spec",)), ("min_price", ("min_price",)), ("max_price", ("max_price",)), ("price", ("avg_price", "price")), ("unit", ("unit",)),
    ("storage_method", ("storage_method",)), ("日期", ("date", "date_str")), ("remark", ("remark",)),
)


def raw_export(rows: DataFrame, source_name: str, limit: int = 1000) -> DataFrame:
    """The latest raw events of a source, their parsed row, normalised row or own fields spread over the export's columns."""
    some = rows.where(F.col("source_name") == source_name).orderBy(F.desc("id")).limit(limit)
    parsed = F.coalesce(*(F.when(~x.isin("{}", "null", "", "0", "false", "[]"), x) for x in (F.get_json_object("raw_json", "$.parsed_row"), F.get_json_object("raw_json", "$.normalized"))), F.col("raw_json"))
    rows = some.withColumn("__p", parsed).where(F.col("__p").startswith("{"))
    other = {"source_name": F.lit(source_name), "品名": F.coalesce("title", F.lit("")), "unit": F.lit("元/公斤"), "日期": F.coalesce("pub_time", F.lit(""))}
    fields = [F.coalesce(*(F.get_json_object("__p", f"$['{n}']") for n in names), other.get(c, F.lit(""))).alias(c) for c, names in EXPORTED]
    return rows.select(*fields, F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("snapshot_time"), F.col("id").alias("raw_event_id"))
