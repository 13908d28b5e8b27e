"""Queries over the relations, each with the SQL that the oracle runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import analytics as A
from tidemark.operators import asof, merge, search
from tidemark.plans import views as V

Q: dict[str, tuple] = {}
AS_OF, EVENTS_AS_OF, DOCS = "2001-11-05", "2024-01-31", "2025-12-31"


def q(name: str, sql: str | None = None, views: str = ""):
    def add(f):
        Q[name] = (f, f"WITH {views} {sql}" if sql and views else sql)
        return f

    return add


DAY = "strftime(snapshot_time, '%Y-%m-%d')"
MEAN = "((2 * sum(CAST(round(price * 100) AS BIGINT)) + count(price)) // (2 * count(price))) / 100"
TREND = f"SELECT {DAY} AS day, {MEAN} AS avg_price, round(min(price), 2) AS min_price, round(max(price), 2) AS max_price, count(*) AS n FROM products WHERE snapshot_time >= TIMESTAMP '2001-11-05' - INTERVAL 365 DAY AND price IS NOT NULL"


@q("price_trend", f"{TREND} AND product_type = 'ECONOMY' GROUP BY 1", V.PRODUCTS)
def _(s, d):
    return A.price_trend(V.products(s, d), AS_OF, 365, product_type="ECONOMY")


@q("price_trend_by_type", f"SELECT {DAY} AS day, product_type, {MEAN} AS avg_price, round(min(price), 2) AS min_price, round(max(price), 2) AS max_price, count(*) AS n FROM products WHERE snapshot_time >= TIMESTAMP '2001-11-05' - INTERVAL 90 DAY AND price IS NOT NULL AND platform = 'R' GROUP BY 1, 2", V.PRODUCTS)
def _(s, d):
    return A.price_trend(V.products(s, d), AS_OF, 90, platform="R", keys=("product_type",))


@q("total_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("lineitem", "orders", "documents", "events")) + " UNION ALL SELECT 'missing', 0")
def _(s, d):
    return A.total_counts({t: V.table(s, d, t) for t in ("lineitem", "orders", "documents", "events")} | {"missing": None})


@q("source_stats", "SELECT source_type, count(*) AS n FROM intel GROUP BY 1", V.INTEL)
def _(s, d):
    return A.counts_by(V.intel(s, d), "source_type")


LABEL = "coalesce(nullif(product_type, ''), '未分类')"


@q("product_stats", f"SELECT platform, {LABEL} AS product_type, count(*) AS n FROM (SELECT platform, CASE WHEN spec = '1' THEN '' WHEN spec = '2' THEN '未分类' ELSE product_type END AS product_type FROM products) AS t GROUP BY platform, t.product_type", V.PRODUCTS)
def _(s, d):
    kind = F.when(F.col("spec") == "1", "").when(F.col("spec") == "2", A.UNSORTED).otherwise(F.col("product_type"))
    return A.product_stats(V.products(s, d).withColumn("product_type", kind))


@q("daily_trend", "SELECT day, sum(a) AS n_a, sum(b) AS n_b FROM (SELECT strftime(snapshot_time, '%Y-%m-%d') AS day, 1 AS a, 0 AS b FROM products WHERE snapshot_time >= TIMESTAMP '2001-11-05' - INTERVAL 400 DAY UNION ALL SELECT strftime(snapshot_time, '%Y-%m-%d'), 0, 1 FROM offline WHERE snapshot_time >= TIMESTAMP '2001-11-05' - INTERVAL 400 DAY) GROUP BY 1", V.PRODUCTS + ", " + V.OFFLINE)
def _(s, d):
    return A.daily_trend(V.products(s, d, part=False), V.offline(s, d), "snapshot_time", "snapshot_time", AS_OF, 400)


@q("price_by_type_origin", f"SELECT coalesce(nullif(product_type, ''), '未分类') AS product_type, coalesce(nullif(CASE WHEN origin LIKE 'A%' THEN '' ELSE origin END, ''), '未知') AS origin, {MEAN} AS avg_price, count(*) AS n FROM products WHERE snapshot_time >= TIMESTAMP '2001-11-05' - INTERVAL 730 DAY AND price IS NOT NULL GROUP BY 1, 2", V.PRODUCTS)
def _(s, d):
    return A.price_by_type_origin(V.products(s, d, supplier=True).withColumn("origin", F.when(F.col("origin").startswith("A"), "").otherwise(F.col("origin"))), AS_OF, 730)


for _name, _order in (("price_rank_desc", "DESC"), ("price_rank_asc", "ASC")):
    @q(_name, f"SELECT row_key, title, price FROM products WHERE price IS NOT NULL ORDER BY price {_order}, row_key LIMIT 50", V.PRODUCTS)
    def _(s, d, order=_name.replace("rank_", "")):
        return A.price_rank(V.products(s, d), order, 50, "row_key").select("row_key", "title", "price")


@q("recent_runs", "SELECT id, source_name, status, strftime(started_at, '%Y-%m-%d %H:%M') AS started FROM runs ORDER BY started_at DESC, id DESC LIMIT 20", V.RUNS)
def _(s, d):
    return A.recent(V.runs(s, d), "started_at", 20, "id").select("id", "source_name", "status", F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("started"))


for _name, _column in (("distinct_platforms", "platform"), ("distinct_types", "product_type"), ("distinct_hints", "keyword")):
    @q(_name, f"SELECT DISTINCT {_column} FROM products WHERE {_column} IS NOT NULL AND {_column} <> ''", V.PRODUCTS)
    def _(s, d, column=_column):
        return V.products(s, d).select(column).where(f"{column} IS NOT NULL AND {column} <> ''").distinct().orderBy(column)


@q("distinct_sources", "SELECT DISTINCT source_name FROM runs", V.RUNS)
def _(s, d):
    return V.runs(s, d).select("source_name").distinct().orderBy("source_name")


@q("product_search", "SELECT row_key, title, product_type, strftime(snapshot_time, '%Y-%m-%d %H:%M') AS at FROM products WHERE platform = 'N' AND title ILIKE '%re_%' ORDER BY snapshot_time DESC, row_key LIMIT 100", V.PRODUCTS)
def _(s, d):
    found = search.search(V.products(s, d), "re_", ("title",), {"platform": "N", "product_type": None}, [F.desc("snapshot_time"), "row_key"], 100)
    return found.select("row_key", "title", "product_type", F.date_format("snapshot_time", "yyyy-MM-dd HH:mm").alias("at"))


@q("product_search_or", "SELECT row_key, title, keyword FROM products WHERE title ILIKE '%#1%' OR keyword ILIKE '%#1%' ORDER BY snapshot_time DESC, row_key LIMIT 500", V.PRODUCTS)
def _(s, d):
    return search.search(V.products(s, d), "#1", ("title", "keyword"), {}, [F.desc("snapshot_time"), "row_key"], 900).select("row_key", "title", "keyword")


@q("paper_search", "SELECT item_id, text FROM benchmark WHERE text ILIKE '%the%' OR CAST(item_id AS VARCHAR) ILIKE '%the%' ORDER BY item_id DESC LIMIT 50")
def _(s, d):
    papers = V.table(s, d, "benchmark").withColumn("key", F.col("item_id").cast("string"))
    return search.search(papers, "the", ("text", "key"), {}, [F.desc("item_id")], 50).select("item_id", "text")


@q("intel_search", "SELECT id, title FROM intel WHERE title ILIKE '%tion%' OR content ILIKE '%tion%' ORDER BY id DESC LIMIT 100", V.INTEL)
def _(s, d):
    return search.search(V.intel(s, d), "tion", ("title", "content"), {}, [F.desc("id")], 100).select("id", "title")


@q("offline_search", "SELECT id, product_name_raw FROM offline WHERE product_name_raw ILIKE '%7%' OR market_name ILIKE '%7%' OR source_name ILIKE '%7%' ORDER BY snapshot_time DESC, id DESC LIMIT 100", V.OFFLINE)
def _(s, d):
    return search.search(V.offline(s, d), "7", ("product_name_raw", "market_name", "source_name"), {}, [F.desc("snapshot_time"), F.desc("id")], 100).select("id", "product_name_raw")


TIME = "coalesce(try_strptime(pub_time, '%Y-%m-%d %H:%M:%S'), try_strptime(pub_time, '%Y-%m-%d'), try_strptime(pub_time, '%Y/%m/%d'))"
for _mode, _first in (("time", ""), ("org", "org, "), ("region", "region, ")):
    @q(f"intel_order_{_mode}", f"SELECT id, org, region, coalesce(pub_time, '') AS pub_time FROM intel WHERE title ILIKE '%e%' ORDER BY {_first}{TIME} DESC NULLS LAST, id DESC LIMIT 200", V.INTEL)
    def _(s, d, mode=f"{_mode}_time"):
        found = V.intel(s, d).where(search.any_like("e", "title")).orderBy(*search.intel_order(mode)).limit(200)
        return found.select("id", "org", "region", F.coalesce("pub_time", F.lit("")).alias("pub_time"))


@q("intel_enhanced", f"SELECT id, substring(content, 1, 200) AS content FROM intel WHERE source_type = 't1' ORDER BY {TIME} DESC NULLS LAST, id DESC LIMIT 80", V.INTEL)
def _(s, d):
    return search.search(V.intel(s, d), None, (), {"source_type": "t1"}, search.intel_order("time"), 80).select("id", F.left("content", F.lit(200)).alias("content"))


@q("species_distribution", "SELECT CASE WHEN title LIKE '%red%' THEN 'red' WHEN title LIKE '%blue%' THEN 'blue' ELSE 'other' END AS species, count(*) AS n FROM products GROUP BY 1", V.PRODUCTS)
def _(s, d):
    kind = F.when(F.col("title").like("%red%"), "red").when(F.col("title").like("%blue%"), "blue").otherwise("other")
    return V.products(s, d).groupBy(kind.alias("species")).agg(F.count("*").alias("n"))


@q("origin_topn", "SELECT origin, count(*) AS n FROM products WHERE origin IS NOT NULL AND origin NOT IN ('', '未知') GROUP BY 1 ORDER BY n DESC, origin LIMIT 10", V.PRODUCTS)
def _(s, d):
    return A.counts_by(V.products(s, d, part=False, supplier=True).where(F.col("origin").isNotNull() & ~F.col("origin").isin("", "未知")), "origin").limit(10)


@q("theme_trend", f"SELECT {DAY} AS day, platform, {MEAN} AS avg_price, count(*) AS n FROM products WHERE snapshot_time >= TIMESTAMP '2001-11-05' - INTERVAL 180 DAY AND (title LIKE '%red%' OR title LIKE '%small%') GROUP BY 1, 2", V.PRODUCTS)
def _(s, d):
    rows = V.products(s, d).where(F.col("title").rlike("red|small"))
    return A.price_trend(rows, AS_OF, 180, keys=("platform",)).drop("min_price", "max_price")


COMPARE = """c AS (SELECT CASE platform WHEN 'A' THEN 'JD' WHEN 'N' THEN 'TB' ELSE platform END AS channel, round(avg(coalesce(price_per_kg, price)), 2) AS avg_price, count(*) AS n
    FROM products WHERE snapshot_time >= TIMESTAMP '2001-11-05' - INTERVAL 365 DAY AND (title LIKE '%red%' OR title LIKE '%small%') GROUP BY 1
    UNION ALL SELECT 'offline', round(avg(price), 2), count(*) FROM offline WHERE snapshot_time >= TIMESTAMP '2001-11-05' - INTERVAL 365 DAY AND product_name_raw LIKE '%1%' HAVING avg(price) IS NOT NULL)"""


def _compared(s, d):
    return A.channel_compare(V.products(s, d), V.offline(s, d), AS_OF, 365, F.col("title").rlike("red|small"), F.col("product_name_raw").contains("1"), {"A": "JD", "N": "TB"})


@q("channel_compare", "SELECT * FROM c", f"{V.PRODUCTS}, {V.OFFLINE}, {COMPARE}")
def _(s, d):
    return _compared(s, d)


@q("theme_kpis", "SELECT round(sum(avg_price * n) / sum(n), 2) AS avg_price, CASE WHEN count(avg_price) >= 2 THEN round(max(avg_price) - min(avg_price), 2) END AS spread, sum(n) AS samples FROM c", f"{V.PRODUCTS}, {V.OFFLINE}, {COMPARE}")
def _(s, d):
    return A.theme_kpis(_compared(s, d))


@q("weighted_avg", "SELECT round(sum(avg_price * n) / sum(n), 2) AS avg_price FROM c", f"{V.PRODUCTS}, {V.OFFLINE}, {COMPARE}")
def _(s, d):
    return _compared(s, d).agg(A.weighted_average(None).alias("avg_price"))


@q("price_spread", "SELECT CASE WHEN count(avg_price) >= 2 THEN round(max(avg_price) - min(avg_price), 2) END AS spread FROM c", f"{V.PRODUCTS}, {V.OFFLINE}, {COMPARE}")
def _(s, d):
    return _compared(s, d).agg(A.spread().alias("spread"))


@q("dashboard_kpis", """SELECT a AS online_avg, b AS offline_avg, na + nb AS samples, round((a * na + b * nb) / (na + nb), 2) AS overall_avg, round(abs(a - b), 2) AS gap FROM
    (SELECT round(avg(coalesce(price_per_kg, price)), 2) AS a, count(*) AS na FROM products WHERE snapshot_time >= TIMESTAMP '2001-11-05' - INTERVAL 30 DAY),
    (SELECT round(avg(price), 2) AS b, count(*) AS nb FROM offline WHERE snapshot_time >= TIMESTAMP '2001-11-05' - INTERVAL 365 DAY)""", f"{V.PRODUCTS}, {V.OFFLINE}")
def _(s, d):
    on = V.products(s, d, part=False).where(A.since("snapshot_time", AS_OF, 30)).agg(F.round(F.avg(F.coalesce("price_per_kg", "price")), 2).alias("a"), F.count("*").alias("na"))
    off = V.offline(s, d).where(A.since("snapshot_time", AS_OF, 365)).agg(F.round(F.avg("price"), 2).alias("b"), F.count("*").alias("nb"))
    n = F.col("na") + F.col("nb")
    return on.join(F.broadcast(off)).select(F.col("a").alias("online_avg"), F.col("b").alias("offline_avg"), n.alias("samples"), F.round((F.col("a") * F.col("na") + F.col("b") * F.col("nb")) / n, 2).alias("overall_avg"), F.round(F.abs(F.col("a") - F.col("b")), 2).alias("gap"))


for _grain in ("day", "week", "month"):
    @q(f"price_rollup_{_grain}", f"SELECT strftime(date_trunc('{_grain}', snapshot_time), '%Y-%m-%d') AS agg_date, '{_grain}' AS agg_grain, platform, product_type, spec, count(*) AS sample_size, min(price) AS min_price, max(price) AS max_price, {MEAN} AS avg_price, round(quantile_cont(price, 0.5), 4) AS p50_price, arg_max(price, (snapshot_time, row_key, price)) AS last_price FROM products WHERE price IS NOT NULL GROUP BY 1, 3, 4, 5", V.PRODUCTS)
    def _(s, d, grain=_grain):
        return A.price_rollup(V.products(s, d), grain)


@q("price_median", "SELECT platform, status, round(quantile_cont(price, 0.5), 4) AS median FROM products WHERE price IS NOT NULL GROUP BY 1, 2", V.PRODUCTS)
def _(s, d):
    """Groups that hold up to half of all rows."""
    return A.median_by(V.products(s, d, part=False), ["platform", "status"], "price").withColumn("median", F.round("median", 4))


@q("today_count", "SELECT count(*) AS n FROM runs WHERE CAST(started_at AS DATE) = DATE '2024-01-15'", V.RUNS)
def _(s, d):
    return V.runs(s, d).where(F.to_date("started_at") == "2024-01-15").agg(F.count("*").alias("n"))


@q("run_stats", "SELECT source_name, count(*) FILTER (WHERE status = 'SUCCESS') AS ok, count(*) FILTER (WHERE status <> 'SUCCESS') AS failed FROM runs GROUP BY 1", V.RUNS)
def _(s, d):
    return V.runs(s, d).groupBy("source_name").agg(F.count_if(F.col("status") == "SUCCESS").alias("ok"), F.count_if(F.col("status") != "SUCCESS").alias("failed"))


HEAL = {"pages_attempted": "true", "pages_succeeded": "status <> 'FAIL'", "token_expired_count": "id % 7 = 0", "level1_attempts": "id % 7 = 0", "level1_recovered": "id % 14 = 0", "level2_attempts": "id % 14 = 7", "level2_recovered": "id % 28 = 7", "level3_fused": "id % 28 = 21"}


@q("heal_stats", "SELECT *, coalesce(round(pages_succeeded / nullif(pages_attempted, 0), 4), 0.0) AS page_success_rate FROM (SELECT " + ", ".join(f"count(*) FILTER (WHERE {x}) AS {c}" for c, x in HEAL.items()) + " FROM runs)", V.RUNS)
def _(s, d):
    return A.heal_stats(V.runs(s, d).select(*(F.expr(x).cast("long").alias(c) for c, x in HEAL.items())))


@q("template_distribution", "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 4) AS ratio FROM documents GROUP BY 1")
def _(s, d):
    return A.ratio_to_total(V.table(s, d, "documents"), "lang")


@q("cap_per_group", "SELECT row_key, origin, CAST(r AS INTEGER) AS rank FROM (SELECT row_key, origin, row_number() OVER (PARTITION BY origin ORDER BY price DESC, row_key) AS r FROM products) WHERE r <= 5", V.PRODUCTS)
def _(s, d):
    return A.cap_per_group(V.products(s, d, part=False, supplier=True), "origin", [F.desc("price"), "row_key"], 5).select("row_key", "origin", "rank")


LAST = "arg_max(price, (snapshot_time, row_key, price)) FILTER (WHERE price IS NOT NULL AND snapshot_time <= TIMESTAMP '2001-11-05'{})"
for _days, _keys in ((7, "platform, product_type, spec, shop"), (30, "platform, product_type, spec")):
    @q(f"price_change_{_days}d", f"SELECT *, CASE WHEN baseline > 0 THEN round((latest - baseline) / baseline * 100, 4) END AS change_pct FROM (SELECT {_keys}, {LAST.format('')} AS latest, {LAST.format(f' - INTERVAL {_days} DAY')} AS baseline FROM products GROUP BY {_keys})", V.PRODUCTS)
    def _(s, d, days=_days, keys=_keys):
        return asof.price_change(V.products(s, d, supplier=days == 7), AS_OF, days, tuple(keys.split(", ")))


@q("price_change_backfill", """day AS (SELECT platform, product_type, spec, CAST(snapshot_time AS DATE) AS d, arg_max(price, (snapshot_time, row_key, price)) AS p FROM products WHERE platform = 'N' AND product_type <> '' AND spec <> '' AND snapshot_time < DATE '2001-06-02' GROUP BY ALL),
    t AS (SELECT * FROM day WHERE d = DATE '2001-06-01')
    SELECT t.platform, t.product_type, t.spec, t.p AS latest, CASE WHEN a.p > 0 THEN round((t.p - a.p) / a.p * 100, 4) END AS change_7d, CASE WHEN b.p > 0 THEN round((t.p - b.p) / b.p * 100, 4) END AS change_30d
    FROM t ASOF LEFT JOIN day a ON t.platform = a.platform AND t.product_type = a.product_type AND t.spec = a.spec AND t.d - INTERVAL 7 DAY >= a.d
    ASOF LEFT JOIN day b ON t.platform = b.platform AND t.product_type = b.product_type AND t.spec = b.spec AND t.d - INTERVAL 30 DAY >= b.d""", V.PRODUCTS + ",")
def _(s, d):
    return asof.backfill(V.products(s, d), "N", "2001-06-01")


ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount")


def _raw(s, d):
    """Snapshots in the order of their line items, with letter case and prefixes that make keys collide."""
    odd = F.col("l_linenumber") % 2 == 1
    return V.table(s, d, "lineitem").select(
        F.when(odd, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("platform"), F.concat(F.lit("keyword"), F.col("l_partkey") % 3).alias("keyword"),
        F.concat(F.lit("title "), F.col("l_partkey")).alias("title"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_discount") > 0, F.col("l_tax")).alias("price_per_kg"),
        F.when(odd, "").alias("price_unit"), F.when(odd, "USD").alias("currency"), F.concat(F.lit(" shop"), F.col("l_suppkey") % 7).alias("shop"),
        F.when(F.col("l_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("type-with-a-name-longer-than-32-chars-"), F.col("l_linestatus"))).alias("product_type"),
        F.when(F.col("l_partkey") % 50 > 0, (F.col("l_partkey") % 50).cast("string")).alias("spec_weight_normalized"), F.concat(F.lit("https://example.org/i/"), F.col("l_partkey") % 200).alias("detail_url"),
        F.col("l_quantity").alias("sales_or_commit"), (F.col("l_tax") > 0.04).alias("is_wild"), F.lit("x").alias("origin_raw"),
        F.col("l_orderkey").alias("raw_id"), F.date_trunc("YEAR", "l_shipdate").cast("timestamp_ntz").alias("snapshot_time"), F.struct(*ORDER).alias("seq"),
    )


#: Columns of the raw snapshots with the defaults of an upsert; the key's columns are those of a key's first row.
RAW = f"""raw AS (SELECT CASE WHEN l_linenumber % 2 = 1 THEN lower(l_returnflag) ELSE l_returnflag END AS platform, concat('keyword', l_partkey % 3) AS keyword, concat('title ', l_partkey) AS title, l_extendedprice AS price,
    CASE WHEN l_discount > 0 THEN l_tax END AS price_per_kg, 'CNY' AS price_unit, CASE WHEN l_linenumber % 2 = 1 THEN 'USD' ELSE 'CNY' END AS currency, concat('shop', l_suppkey % 7) AS shop,
    CASE WHEN l_partkey % 11 = 0 THEN concat('keyword', l_partkey % 3) ELSE concat('type-with-a-name-longer-than-32-chars-', l_linestatus) END AS product_type,
    CASE WHEN l_partkey % 50 > 0 THEN CAST(l_partkey % 50 AS VARCHAR) ELSE concat('url#', substring(md5(concat('https://example.org/i/', l_partkey % 200)), 1, 12)) END AS spec_weight_normalized,
    concat('https://example.org/i/', l_partkey % 200) AS detail_url, l_quantity AS sales_or_commit, l_tax > 0.04 AS is_wild, 'x' AS origin_raw, l_orderkey AS raw_id, date_trunc('year', l_shipdate) AS snapshot_time, ({', '.join(ORDER)}) AS seq FROM lineitem),
    keyed AS (SELECT *, (lower(substring(platform, 1, 16)), lower(substring(product_type, 1, 32)), lower(substring(spec_weight_normalized, 1, 16)), lower(substring(shop, 1, 48)), snapshot_time) AS k FROM raw)"""
LAST = ("keyword", "title", "price", "price_per_kg", "price_unit", "currency", "shop", "detail_url", "sales_or_commit", "is_wild", "origin_raw", "raw_id")


@q("upsert_snapshot", f"""SELECT f.platform, f.product_type, f.spec_weight_normalized, f.snapshot_time, {', '.join(f'l.{c}' for c in LAST)} FROM (
    SELECT arg_min(struct_pack(platform, product_type, spec_weight_normalized, snapshot_time), seq) AS f, arg_max(struct_pack({', '.join(LAST)}), seq) AS l FROM keyed GROUP BY k)""", RAW)
def _(s, d):
    return merge.upsert(merge.snapshot_defaults(_raw(s, d)), merge.SNAPSHOT, ["seq"]).drop("seq")


#: What crawlers add to an item of the view.
ADDED = "concat('[\"', region, '\"]') AS tags_json, concat('{\"n\":', id % 7, '}') AS extra_json, id * 10 AS raw_id, concat('[\"', region, '\"]') AS tags, concat('{\"n\":', id % 7, '}') AS extra, CASE WHEN id % 2 = 0 THEN upper(source_url) ELSE source_url END AS cased"


def _items(s, d):
    """Intel items with tags, extras and raw ids; every other URL in upper case."""
    tags, extra = F.concat(F.lit('["'), "region", F.lit('"]')), F.concat(F.lit('{"n":'), F.col("id") % 7, F.lit("}"))
    return V.intel(s, d).select("*", tags.alias("tags_json"), extra.alias("extra_json"), (F.col("id") * 10).alias("raw_id"), tags.alias("tags"), extra.alias("extra"), F.when(F.col("id") % 2 == 0, F.upper("source_url")).otherwise(F.col("source_url")).alias("cased"))


INTEL_UPSERTS = {"upsert_intel_batch": merge.INTEL_BATCH, "upsert_intel_sqlite": merge.INTEL_SQLITE, "upsert_intel_mysql": merge.INTEL_MYSQL}
for _name, _policy in INTEL_UPSERTS.items():
    _cols = ["source_type", "title", "pub_time", "org", "region", "content", *(("tags", "extra") if _name.endswith("sqlite") else ("tags_json", "extra_json", "raw_id"))]
    _sel = ", ".join(f"{'last' if c in _policy.update else 'first'}({c} ORDER BY id) AS {c}" for c in _cols)
    _url = "CASE WHEN id % 11 = 0 THEN '' ELSE cased END"

    @q(_name, f"SELECT first(url ORDER BY id) AS source_url, {_sel} FROM (SELECT *, {_url} AS url FROM (SELECT *, {ADDED} FROM intel)){' WHERE url <> ' + chr(39) * 2 if _policy.required else ''} GROUP BY {'lower(url)' if _policy.ignore_case else 'url'}", V.INTEL)
    def _(s, d, policy=_policy, cols=tuple(_cols)):
        rows = _items(s, d).withColumn("source_url", F.when(F.col("id") % 11 == 0, "").otherwise(F.col("cased")))
        return merge.upsert(rows.select("id", "source_url", *cols), policy, ["id"]).select("source_url", *cols)


@q("upsert_paper", f"SELECT first(cased ORDER BY id) AS url, first(title ORDER BY id) AS title, first(authors ORDER BY id) AS authors, last(abstract ORDER BY id) AS abstract, last(tags_json ORDER BY id) AS keywords_json, last(raw_id ORDER BY id) AS raw_id FROM (SELECT *, org AS authors, content AS abstract, {ADDED} FROM intel) GROUP BY lower(cased)", V.INTEL)
def _(s, d):
    rows = _items(s, d).select(F.col("cased").alias("url"), "title", F.col("org").alias("authors"), F.col("content").alias("abstract"), F.col("tags_json").alias("keywords_json"), "raw_id", "id")
    return merge.upsert(rows, merge.PAPER, ["id"]).drop("id")


@q("upsert_offline", """SELECT first(source_name ORDER BY id) AS source_name, first(market_name ORDER BY id) AS market_name, product_type, snapshot_time, first(region ORDER BY id) AS region, last(product_name_raw ORDER BY id) AS product_name_raw, last(spec ORDER BY id) AS spec, last(min_price ORDER BY id) AS min_price,
    last(max_price ORDER BY id) AS max_price, last(price ORDER BY id) AS price, last(unit ORDER BY id) AS unit, last(date_str ORDER BY id) AS date_str, last(remark ORDER BY id) AS remark, last(id * 10 ORDER BY id) AS raw_id
    FROM (SELECT * REPLACE (date_trunc('month', snapshot_time) AS snapshot_time, CASE WHEN id % 2 = 0 THEN lower(market_name) ELSE market_name END AS market_name), concat(id % 9, 'kg') AS spec, CASE WHEN id % 3 = 0 THEN price - 1 END AS min_price,
        CASE WHEN id % 3 = 0 THEN price + 1 END AS max_price, '元/公斤' AS unit, strftime(snapshot_time, '%Y-%m-%d') AS date_str, CASE WHEN id % 5 = 0 THEN 'r' END AS remark FROM offline) GROUP BY lower(source_name), lower(market_name), product_type, snapshot_time""", V.OFFLINE)
def _(s, d):
    i = F.col("id")
    rows = V.offline(s, d).withColumns({
        "date_str": F.date_format("snapshot_time", "yyyy-MM-dd"), "snapshot_time": F.date_trunc("MONTH", "snapshot_time").cast("timestamp_ntz"), "market_name": F.when(i % 2 == 0, F.lower("market_name")).otherwise(F.col("market_name")),
        "spec": F.concat(i % 9, F.lit("kg")), "min_price": F.when(i % 3 == 0, F.col("price") - 1), "max_price": F.when(i % 3 == 0, F.col("price") + 1), "unit": F.lit("元/公斤"), "remark": F.when(i % 5 == 0, "r"), "raw_id": i * 10,
    })
    return merge.upsert(rows, merge.OFFLINE, ["id"]).drop("id")


@q("run_log", "SELECT id, source_name, strftime(started_at, '%Y-%m-%d %H:%M') AS started, CASE WHEN id % 10 = 0 THEN 'RUNNING' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN 0 ELSE CAST(floor(items) AS BIGINT) END AS items, CASE WHEN id % 10 <> 0 AND status = 'FAIL' THEN 'error' END AS error_text FROM runs", V.RUNS)
def _(s, d):
    runs = V.runs(s, d)
    ended = runs.where("id % 10 <> 0").select("id", F.col("started_at").alias("ended_at"), "status", F.floor("items").alias("items"), F.when(F.col("status") == "FAIL", "error").alias("error_text"))
    log = merge.start_run(s.createDataFrame([], "id long, source_name string, started_at timestamp_ntz, status string, items long"), runs.select("id", "source_name", F.col("started_at").cast("timestamp_ntz").alias("started_at")))
    return merge.finish_run(log, ended).select("id", "source_name", F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("started"), "status", "items", "error_text")


@q("column_prune", "SELECT platform, keyword, title, snapshot_time FROM products", V.PRODUCTS)
def _(s, d):
    return merge.column_prune(V.products(s, d), ["platform", "keyword", "title", "snapshot_time", "extra"], {"platform", "keyword", "title", "snapshot_time"})


@q("defaults_and_require_key", "SELECT coalesce(nullif(trim(org), ''), 'none') AS org, coalesce(nullif(trim(region), ''), 'x') AS region, source_url FROM (SELECT CASE WHEN id % 3 = 0 THEN ' ' ELSE org END AS org, region, CASE WHEN id % 5 = 0 THEN '' ELSE source_url END AS source_url FROM intel) WHERE trim(source_url) <> ''", V.INTEL)
def _(s, d):
    i = F.col("id")
    rows = V.intel(s, d).select(F.when(i % 3 == 0, " ").otherwise(F.col("org")).alias("org"), "region", F.when(i % 5 == 0, "").otherwise(F.col("source_url")).alias("source_url"))
    return merge.defaults_and_require_key(rows, {"org": "none", "region": "x"}, "source_url")


@q("run_latest_status", "SELECT user_id, arg_max(status, (started_at, id)) AS status, arg_max(items, (started_at, id)) AS items FROM runs GROUP BY 1", V.RUNS)
def _(s, d):
    return merge.latest_status(V.runs(s, d), "user_id", "started_at", ["status", "items"], "id")


@q("unified_feed", "SELECT title, CAST(id AS VARCHAR) AS key, org, NULL AS price FROM intel UNION ALL SELECT product_name_raw, CAST(id AS VARCHAR), NULL, price FROM offline", f"{V.INTEL}, {V.OFFLINE}")
def _(s, d):
    a = V.intel(s, d).select("title", F.col("id").cast("string").alias("key"), "org")
    b = V.offline(s, d).select(F.col("product_name_raw").alias("title"), F.col("id").cast("string").alias("key"), "price")
    return merge.unified_feed(a, b)


@q("all_blocks", "SELECT 'doc' AS kind, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'item', item_id, length(text) FROM benchmark")
def _(s, d):
    a = V.table(s, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    return a.unionByName(V.table(s, d, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("n")))


@q("lineage", "SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def _(s, d):
    return merge.lineage(V.table(s, d, "lineitem"), V.table(s, d, "orders"), "l_orderkey", "o_orderkey").select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderpriority")


BODY = "concat('{\"product_name', CASE WHEN id % 2 = 0 THEN '' ELSE '_raw' END, '\":\"p', id % 9, '\",\"avg_price\":', id % 50, CASE WHEN id % 5 = 0 THEN ',\"unit\":\"kg\"' ELSE '' END, '}')"
EVENTS = f"SELECT id, source_name, started_at, 'T' AS title, CASE WHEN id % 4 = 0 THEN '2024-01-01' END AS pub_time, CASE id % 3 WHEN 0 THEN concat('{{\"parsed_row\":', {BODY}, '}}') WHEN 1 THEN concat('{{\"parsed_row\":null,\"normalized\":', {BODY}, '}}') ELSE {BODY} END AS raw_json FROM runs"


@q("raw_export", f"""SELECT 'click' AS source_name, '' AS market_name, '' AS region, '' AS product_type, concat('p', id % 9) AS 品名, '' AS spec, '' AS min_price, '' AS max_price, CAST(id % 50 AS VARCHAR) AS price, CASE WHEN id % 5 = 0 THEN 'kg' ELSE '元/公斤' END AS unit, '' AS storage_method,
    coalesce(pub_time, '') AS 日期, '' AS remark, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS snapshot_time, id AS raw_event_id FROM ({EVENTS}) WHERE source_name = 'click' ORDER BY id DESC LIMIT 1000""", V.RUNS)
def _(s, d):
    V.runs(s, d).createOrReplaceTempView("runs")
    return merge.raw_export(s.sql(EVENTS).withColumnRenamed("started_at", "fetched_at"), "click", 1000)


@q("serialise_row", "SELECT id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, CAST(CAST(items AS DECIMAL(18, 2)) AS DOUBLE) AS items FROM runs", V.RUNS)
def _(s, d):
    return V.runs(s, d).select("id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.col("items").cast("decimal(18,2)").cast("double").alias("items"))


@q("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(s, d):
    return V.table(s, d, "documents").select("doc_id").join(V.table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@q("raw_event_append", "SELECT id, source_name, raw_json FROM runs UNION ALL SELECT id, source_name, raw_json FROM runs WHERE status = 'FAIL'", V.RUNS)
def _(s, d):
    rows = V.runs(s, d).select("id", "source_name", "raw_json", "status")
    return rows.unionByName(rows.where("status = 'FAIL'")).drop("status")
