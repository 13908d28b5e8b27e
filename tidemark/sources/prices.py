"""Price sources: CSV files, HTML tables, JSON of several shapes, JSONP product lists; validation of rows."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rules import storage_of_offline, type_of_offline
from tidemark.functions.text import clean_nbsp, clean_text, mid_price, nonblank, parse_float, parse_time, strip, strip_html
from tidemark.functions.udf import arrow_udf

#: CSV header aliases by field, and header words of HTML tables in order.
ALIASES = {
    "source_name": ("source_name", "数据来源", "来源", "source"),
    "market_name": ("market_name", "市场", "批发市场", "market"),
    "region": ("region", "地区", "区域"),
    "product_type": ("product_type", "品种", "品类标识", "type"),
    "product_name_raw": ("product_name_raw", "品名", "原始品名", "product_name", "品种名称", "prodName", "name"),
    "spec": ("spec", "规格", "specification"),
    "min_price": ("min_price", "最低价", "最低", "minPrice"),
    "max_price": ("max_price", "最高价", "最高", "maxPrice"),
    "price": ("price", "均价", "价格", "avg_price", "avgPrice"),
    "unit": ("unit", "单位", "价格单位"),
    "storage_method": ("storage_method", "存储方式", "冷藏方式", "storage"),
    "date_str": ("date_str", "日期", "报价日期", "date", "reportDate"),
    "remark": ("remark", "备注", "说明", "note"),
    "snapshot_time": ("snapshot_time", "采集时间", "快照时间"),
}
HEADER_WORDS = (
    ("product_name", "品名|品种|品类|产品名|product|产品"), ("market_name", "市场|批发市场|market"), ("min_price", "最低|min"), ("max_price", "最高|max"),
    ("avg_price", "均价|平均|avg|价格|price|大宗价"), ("unit", "单位|unit"), ("date", "日期|date|报价|发布"), ("spec", "规格|spec"),
    ("remark", "备注|产地|remark|note|存储|冷冻"), ("region", "地区|region|区域"),
)
UNIT = "元/公斤"
HIGHEST = 100_000


def header_map(headers: list[str]) -> dict[str, int]:
    """Field -> column by exact alias, case ignored; a field's earlier alias wins."""
    low = [h.strip().strip("﻿").lower() for h in headers]
    return {f: low.index(a.lower()) for f, names in ALIASES.items() for a in reversed(names) if a.lower() in low}


def table_header_map(headers: list[str]) -> dict[str, int]:
    """Field -> column by the first matching word; a field's first column wins."""
    out: dict[str, int] = {}
    for i, h in enumerate(headers):
        field = next((f for f, p in HEADER_WORDS if h.strip() and re.search(p, h.lower())), None)
        if field:
            out.setdefault(field, i)
    return out


def read_csv(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(file, row_num, cells) of the CSV files of a folder or file, read as lines so that each file's header maps alone.

    Whole files are rows here: price sheets are small. Row numbers start at 2, below the header.
    """
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


_ROWS = "array<struct<row_num:int,error:string," + ",".join(f"{f}:string" for f in ALIASES) + ">>"


@arrow_udf(_ROWS)
def _csv_rows(texts: pd.Series) -> pd.Series:
    import csv
    import io

    def rows(text: str | None) -> list[dict]:
        lines = list(csv.reader(io.StringIO((text or "").lstrip("﻿"))))
        names = header_map(lines[0]) if lines else {}
        if not lines or not any(h.strip() for h in lines[0]):
            return [{"row_num": 1, "error": "no header"}]
        if not {"product_name_raw", "price"} & set(names):
            return [{"row_num": 1, "error": "neither product name nor price in the header"}]
        return [{"row_num": i, **{f: c[k] if k < len(c) else "" for f, k in names.items()}} for i, c in enumerate(lines[1:], 2) if any(x.strip() for x in c)]

    return texts.map(rows)


def csv_rows(files: DataFrame, text: str = "text") -> DataFrame:
    """A row for each non-blank line of files(file, text), fields by header alias; a bad header gives one error row."""
    out = files.select("file", F.explode(_csv_rows(F.col(text))).alias("r")).select("file", "r.*")
    return out.select("file", "row_num", "error", *(clean_nbsp(F.col(f)).alias(f) for f in ALIASES))


def errors_of(name: Column, price: Column, low: Column, high: Column) -> Column:
    """All errors of a row: array of (field, message)."""
    p, a, b = parse_float(price), parse_float(low), parse_float(high)

    def error(hit: Column, field: str, message: str) -> Column:
        return F.when(hit, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))

    found = [error(F.coalesce(name, F.lit("")) == "", "product_name_raw", "品名为空"), error(p.isNull() & (a.isNull() | b.isNull()), "price", "缺少价格")]
    for field, x in (("price", p), ("min_price", a), ("max_price", b)):
        found += [error(x < 0, field, "价格为负"), error(x > HIGHEST, field, "价格异常高")]
    found.append(error(a > b, "min_price", "最低价>最高价"))
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def validated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("errors", errors_of(F.col("product_name_raw"), F.col("price"), F.col("min_price"), F.col("max_price")))


def snapshots(rows: DataFrame, source_name: str = "offline_csv", fallback_time: str = "1970-01-01 00:00:00") -> DataFrame:
    """Valid rows as offline_price_snapshot; what is missing is inferred from name, spec and remark."""
    ok = validated(rows.where("error IS NULL")).where(F.size("errors") == 0)
    low, high = parse_float(F.col("min_price")), parse_float(F.col("max_price"))
    hint = F.concat_ws(" ", "product_name_raw", "spec", "remark")
    return ok.select(
        F.coalesce(nonblank(F.col("source_name")), F.lit(source_name)).alias("source_name"), "market_name", "region",
        F.coalesce(nonblank(F.col("product_type")), type_of_offline(F.col("product_name_raw"))).alias("product_type"), "product_name_raw", "spec",
        low.alias("min_price"), high.alias("max_price"), mid_price(parse_float(F.col("price")), low, high).alias("price"), F.coalesce(nonblank(F.col("unit")), F.lit(UNIT)).alias("unit"),
        F.coalesce(nonblank(F.col("storage_method")), storage_of_offline(hint)).alias("storage_method"), "date_str", "remark",
        F.coalesce(parse_time(F.col("snapshot_time")), parse_time(F.col("date_str")), F.lit(fallback_time).cast("timestamp")).cast("timestamp_ntz").alias("snapshot_time"),
    )


def row_errors(rows: DataFrame) -> DataFrame:
    bad = validated(rows.where("error IS NULL")).select("file", "row_num", F.explode("errors").alias("e")).select("file", "row_num", "e.field", "e.message")
    return bad.unionByName(rows.where("error IS NOT NULL").select("file", "row_num", F.lit("header").alias("field"), F.col("error").alias("message")))


class _Tables(HTMLParser):
    """Cells of every table: [(has thead, [row of cell texts])]; cells keep text alone."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            self.cell = []
            if not self.open[-1]:
                self.open[-1].append([])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def html_tables(html: str | None) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(html or "")
    return [[r for r in t if r] for t in p.tables if any(t)]


_FIELDS = ("product_name", "market_name", "region", "spec", "min_price", "max_price", "avg_price", "unit", "date", "remark")


@arrow_udf("array<struct<" + ",".join(f"{f}:string" for f in _FIELDS) + ">>")
def _table_rows(pages: pd.Series) -> pd.Series:
    def rows(html: str | None) -> list[dict]:
        out = []
        for t in html_tables(html):
            names = table_header_map(t[0])
            if {"product_name", "avg_price"} & set(names):
                out += [{f: c[k] if k < len(c) else "" for f, k in names.items()} for c in t[1:] if len(c) > 1]
        return out

    return pages.map(rows)


def _priced(rows: DataFrame, *keys: str) -> DataFrame:
    """Parsed price rows from string fields: average from the ends, default unit, storage by words; unpriced or unnamed rows go."""
    low, high = parse_float(F.col("min_price"), False), parse_float(F.col("max_price"), False)
    text = [clean_text(F.col(c)).alias(c) for c in ("product_name", "market_name", "region", "spec", "date", "remark")]
    out = rows.select(*keys, *text, low.alias("min_price"), high.alias("max_price"), mid_price(parse_float(F.col("avg_price"), False), low, high).alias("avg_price"), F.coalesce(nonblank(F.col("unit")), F.lit(UNIT)).alias("unit"))
    return out.withColumn("storage_method", storage_of_offline(F.concat_ws(" ", "product_name", "spec", "remark"))).where((F.col("product_name") != "") & F.col("avg_price").isNotNull())


def html_prices(pages: DataFrame, key: str, html: str) -> DataFrame:
    return _priced(pages.select(key, F.explode(_table_rows(F.col(html))).alias("r")).select(key, "r.*"), key)


def json_chart(rows: DataFrame, key: str, body: str) -> DataFrame:
    """A row for each market and price of {date, x, y, variety_name}; the shorter list ends it, null prices go."""
    j = F.from_json(body, "date string, x array<string>, y array<string>, variety_name string")
    out = rows.select(key, j.alias("j")).where("j.x IS NOT NULL AND j.y IS NOT NULL").select(key, "j.date", "j.variety_name", F.posexplode(F.arrays_zip("j.x", "j.y")).alias("i", "z"), F.least(F.size("j.x"), F.size("j.y")).alias("n"))
    price = F.col("z.y").try_cast("double")
    return out.where((F.col("i") < F.col("n")) & price.isNotNull()).select(key, F.coalesce("variety_name", F.lit("")).alias("product_name"), clean_text(F.col("z.x")).alias("market_name"), price.alias("avg_price"), clean_text(F.col("date")).alias("date"))


def _field(j: Column, *names: str) -> Column:
    """The first name whose value is neither blank, nor 0, nor false."""
    def value(n: str) -> Column:
        v = F.get_json_object(j, f"$['{n}']")
        return F.when(~v.isin("", "0", "0.0", "false", "[]", "{}"), v)

    return F.coalesce(*map(value, names))


def json_list(rows: DataFrame, key: str, body: str) -> DataFrame:
    """Price rows of a list, or of data, data.list, data.rows, data.records, list or rows of an object."""
    def items(path: str) -> Column:
        found = F.from_json(F.get_json_object(body, path), "array<string>")
        return F.when(F.size(found) > 0, found)

    found = F.coalesce(*(items(p) for p in ("$.data", "$.data.list", "$.data.rows", "$.data.records", "$.list", "$.rows")), F.from_json(F.col(body), "array<string>"))
    item = rows.select(key, F.explode(found).alias("j")).where(F.col("j").startswith("{"))
    j = F.col("j")
    flat = item.select(
        key, _field(j, "prodName", "product_name", "name", "品名").alias("product_name"), _field(j, "marketName", "market_name", "市场").alias("market_name"), _field(j, "region", "地区").alias("region"),
        _field(j, "spec", "规格").alias("spec"), _field(j, "minPrice", "最低价").alias("min_price"), _field(j, "maxPrice", "最高价").alias("max_price"), _field(j, "avgPrice", "price", "均价").alias("avg_price"),
        _field(j, "unit", "单位").alias("unit"), _field(j, "reportDate", "date", "日期").alias("date"), _field(j, "remark", "备注").alias("remark"),
    )
    return _priced(flat, key)


def jsonp_products(rows: DataFrame, key: str, body: str, keyword: str) -> DataFrame:
    """Products of callback({ret, data: {itemsArray}}); a ret without SUCCESS, items without title or address go."""
    inner = F.regexp_extract(body, r"(?s)^\s*[\w$.]+\((.*)\)\s*;?\s*$", 1)
    ok = rows.select(key, keyword, F.when(inner != "", inner).otherwise(F.col(body)).alias("b")).where(F.get_json_object("b", "$.ret").contains("SUCCESS"))
    item = ok.select(key, keyword, F.posexplode(F.from_json(F.get_json_object("b", "$.data.itemsArray"), "array<string>")).alias("pos", "j"))
    j = F.col("j")
    ident = _field(j, "item_id", "itemId")
    url = strip(F.coalesce(_field(j, "itemUrl", "url", "detail_url"), F.lit("")))
    address = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.rlike("^https?://"), url).when(url.startswith("/"), F.concat(F.lit("https://s.taobao.com"), url)).otherwise(F.concat(F.lit("https://item.taobao.com/item.htm?id="), ident))
    place = F.filter(F.split(F.coalesce(_field(j, "procity"), F.lit("")), r"(?U)\s+"), lambda x: x != "")
    return item.select(
        key, keyword, "pos", ident.alias("item_id"), strip_html(_field(j, "title")).alias("title"), parse_float(_field(j, "price"), False).alias("price"),
        parse_float(_field(j, "origPrice", "priceBeforeCoupon", "originalPrice"), False).alias("original_price"), _field(j, "realSales", "sales").alias("sales"),
        nonblank(_field(j, "nick", "shopName")).alias("shop"), F.get(place, F.lit(0)).alias("province"), F.get(place, F.lit(1)).alias("city"), address.alias("detail_url"),
    ).where((F.col("title") != "") & F.col("detail_url").isNotNull())


def scholar(rows: DataFrame, key: str, body: str, query: str, year_from: int | None = None, limit: int = 100) -> DataFrame:
    """Papers of {data: [...]}: null years stay, a missing time is the year's first day, a missing address a hash."""
    kind = "data array<struct<title:string,year:int,publicationDate:string,url:string,abstract:string,venue:string,citationCount:int,authors:array<struct<name:string>>>>"
    p = rows.select(key, query, F.posexplode(F.slice(F.from_json(body, kind)["data"], 1, max(1, min(limit, 100)))).alias("pos", "p")).select(key, query, "pos", "p.*")
    p = p.where(nonblank(F.col("title")).isNotNull())
    if year_from:
        p = p.where(F.col("year").isNull() | (F.col("year") >= year_from))
    title = strip(F.col("title"))
    return p.select(
        key, "pos", title.alias("title"), F.coalesce(nonblank(F.col("abstract")), title).alias("content"),
        F.coalesce(nonblank(F.col("publicationDate")), F.when(F.col("year").isNotNull(), F.concat(F.col("year"), F.lit("-01-01"))), F.lit("")).alias("pub_time"),
        F.coalesce(nonblank(F.col("url")), F.concat(F.lit("scholar:"), F.sha1(F.concat_ws("||", query, title)))).alias("source_url"),
        F.filter(F.transform("authors", lambda a: a["name"]), lambda n: n.isNotNull() & (n != "")).alias("authors"),
    )


def keyword_filter(rows: DataFrame, column: str, keywords: tuple[str, ...], strict: bool = False) -> DataFrame:
    """Rows with any keyword, taken literally and case ignored; strict: salmon and trout words alone."""
    words = "|".join(r"\Q" + k + r"\E" for k in keywords)
    return rows.where(F.col(column).rlike("(?i)三文鱼|鲑|鳟|salmon|trout" if strict else f"(?i)({words})")) if strict or words else rows.limit(0)


def filter_or_all(rows: DataFrame, hit: Column) -> DataFrame:
    """The rows that hit, or all if none does: one flag, found first, rather than a window over everything."""
    some = rows.agg(F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("__any"))
    return rows.join(F.broadcast(some)).where(hit | (F.col("__any") == 0)).drop("__any")
