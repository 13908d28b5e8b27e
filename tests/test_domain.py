"""Literal vectors of the domain functions."""

import random
import re

from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import text as T
from tidemark.operators import asof, corpus, documents, evaluate, merge
from tidemark.sources import pages, prices


def values(spark, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_texts(spark):
    assert values(spark, [None, "  hello  world  ", "A　B", "a\nb"], T.clean_text) == ["", "hello world", "A B", "a b"]
    assert values(spark, ["2026-02-10", "2026年2月10日", "2025/12/31", "2025.06.15", "2025-03-01T14:30:00Z", "2026-03", "x"], T.norm_pub_time) == [
        "2026-02-10 00:00:00", "2026-02-10 00:00:00", "2025-12-31 00:00:00", "2025-06-15 00:00:00", "2025-03-01 14:30:00", "2026-03-01 00:00:00", ""]
    assert values(spark, ["1,234.5", "", "N/A", "-5"], T.parse_float) == [1234.5, None, None, -5.0]
    assert values(spark, ["-5"], lambda c: T.parse_float(c, False)) == [5.0]
    assert values(spark, ["水产;养殖", "keywords: fish;aquaculture", "x；y"], T.keywords) == [["水产", "养殖"], ["fish", "aquaculture"], ["x；y"]]
    assert values(spark, ["//example.com/c", "/path/page", "page.html"], lambda c: T.absolute_url(c, F.lit("https://example.com/dir/"))) == ["https://example.com/c", "https://example.com/path/page", "https://example.com/dir/page.html"]
    assert values(spark, ["1234。5678。9012。"], lambda c: F.transform(T.chunks(c, 10), F.length)) == [[10, 5]]


def test_rules(spark):
    spec = values(spark, ["虹鳟冷冻切片 500g*2袋", "帝王鲑整条 1.5kg", "虹鳟鱼 3斤装", "2*500g", "新鲜三文鱼"], lambda c: R.extract_spec(c, F.lit("")))
    assert [(s["count"], s["total"], s["weight"]) for s in spec] == [(2, 1000.0, "1000g"), (1, 1500.0, "1500g"), (1, 1500.0, "1500g"), (1, 500.0, "500g"), (None, None, "")]
    own = (R.TypeRule(11, "king_salmon", r"帝王鲑|king\s*salmon", 10, 0.98),)
    kind = values(spark, ["挪威帝王鲑刺身 500g", "有机蔬菜套餐"], lambda c: R.classify_type(c, F.lit(""), F.lit(""), own))
    assert [(k["product_type"], k["rule_id"], k["confidence"]) for k in kind] == [("king_salmon", 11, 0.98), ("unknown", None, 0.0)]
    assert values(spark, ["冷水鱼"], lambda c: R.extract_origin(c, F.lit("新疆"), F.lit("乌鲁木齐"), F.lit("")))[0]["origin"] == "中国-新疆-乌鲁木齐"
    assert values(spark, ["冷冻x", "冰鲜x", "鲜活x", "帝王鲑干货"], R.storage_of_title) == ["frozen", "ice_fresh", "live_fresh", None]
    assert values(spark, ["SC认证 x", "ASC认证"], lambda c: R.cert_flags(c)["cert_qs"]) == [0, 0]


def test_sources(spark):
    names = prices.header_map(["数据来源", "市场", "地区", "品名", "均价", "单位", "日期"])
    assert (names["source_name"], names["market_name"], names["product_name_raw"], names["price"], names["date_str"]) == (0, 1, 3, 4, 6)
    files = spark.createDataFrame([("a", "品名,均价\n,50\n虹鳟,60\n"), ("b", "品名,均价\n虹鳟,50\n,,\n帝王鲑,130\n"), ("c", "")], "file string, text string")
    rows = prices.csv_rows(files)
    assert sorted(r["price"] for r in prices.snapshots(rows).collect()) == [50.0, 60.0, 130.0]
    assert sorted((r["file"], r["row_num"]) for r in prices.row_errors(rows).collect()) == [("a", 2), ("c", 1)]
    assert pages.links_of("<ul><li><a href='./t/1.html'>x</a></li></ul>", "https://a.b/c/")[0]["url"] == "https://a.b/c/t/1.html"
    t = spark.createDataFrame([(1, "<table><tr><td>产品名</td><td>最低</td><td>最高</td></tr><tr><td>鱼</td><td>40</td><td>60</td></tr></table>")], "k int, t string")
    assert [r["avg_price"] for r in prices.html_prices(t, "k", "t").collect()] == [50.0]


def test_tables(spark, tmp_path):
    from tidemark.sources import tables

    raw = [("虹鳟".encode(),), ("\ufeff虹鳟".encode(),), ("虹鳟".encode("gb18030"),)]
    assert [r["t"] for r in spark.createDataFrame(raw, "b binary").select(tables.decode(F.col("b")).alias("t")).collect()] == ["虹鳟"] * 3
    path = str(tmp_path)
    tables.append_raw(spark.createDataFrame([("a", 1), ("b", 2)], "x string, n int"), f"{path}/raw.parquet")
    tables.append_raw(spark.createDataFrame([("c", 3)], "x string, n int"), f"{path}/raw.parquet")
    assert len({r["id"] for r in tables.open_table(spark, "raw", " Parquet ", path).collect()}) == 3 == tables.open_table(spark, "raw", "other", path).count()
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("# T\n\ntext")
    found, failed = tables.run_sources(spark, [{"name": "m", "format": "text", "path": f"{path}/md"}, {"name": "gone", "format": "parquet", "path": f"{path}/none"}, {"name": "off", "enabled": False}])
    assert [(r["value"], r["source_name"]) for r in found.collect()] == [("# T\n\ntext", "m")] and [n for n, _ in failed] == ["gone"]
    now, loads = [0.0], []
    rules = tables.Reloaded(lambda: loads.append(1) or [len(loads)], 10, lambda: now[0])
    first = rules.get()
    now[0] = 9.0
    assert rules.get() is first
    now[0] = 10.0
    assert rules.get() == [2] and rules.get(force=True) == [3]


def test_run_log(spark):
    log = merge.start_run(spark.createDataFrame([], "id long, source_name string, status string, items long"), spark.createDataFrame([(1, "a", "t"), (2, "b", "t")], "id long, source_name string, started_at string"))
    done = merge.finish_run(log, spark.createDataFrame([(1, "u", "SUCCESS", 5, None)], "id long, ended_at string, status string, items long, error_text string"))
    assert sorted((r["id"], r["status"], r["items"], r["ended_at"]) for r in done.collect()) == [(1, "SUCCESS", 5, "u"), (2, "RUNNING", 0, None)]


def test_rouge_l(spark):
    rows = spark.createDataFrame([(1, "t", "a b c d", "a c x"), (2, "t", "", ""), (3, "u", "鱼水", "水鱼")], "k int, kind string, predict string, label string")
    assert {r["k"]: r["f1"] for r in evaluate.rouge_l(rows, ("k",)).collect()} == {1: round(4 / 7, 6), 2: 1.0, 3: 0.5}
    assert {r["kind"]: (r["n"], r["rougel"]) for r in evaluate.rouge_summary(rows, "kind", ("k",)).collect()} == {"t": (2, round((round(4 / 7, 6) + 1) / 2, 4)), "u": (1, 0.5)}


def test_split_of_many_and_few(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    train, test = evaluate.split(df, "k", 0.15, 42)
    order = sorted((r["h"], r["k"]) for r in df.select("k", evaluate.hash_rank(F.col("k"), 42).alias("h")).collect())
    assert {r["k"] for r in test.collect()} == {k for _, k in order[:750]} and train.count() == 4250
    strata = df.withColumn("s", F.when(F.col("k") < 3, "few").otherwise("many"))
    got = evaluate.stratified_sample(strata, "s", "k", 100, 42).collect()
    assert len(got) == 100 and sum(r["s"] == "few" for r in got) == 3


def test_documents(spark):
    assert values(spark, ["前文\n$E = mc^2$\n后文", "inline $x$"], documents.fix_formula) == ["前文\n$$E = mc^2$$\n后文", "inline $x$"]
    table = "| a |\n|---|\n| 1 |\n"
    assert documents.join_tables(table + "\n" + table) == table + "\n| 1 |\n"
    assert "**图1**" in values(spark, ["图1 说明\n\n正文"], documents.figure_captions)[0]
    df = spark.createDataFrame([(1, "这是一个完整的段落。\n\n第二个完整段落内容。"), (2, "")], "k int, t string")
    got = {r["k"]: r for r in documents.availability(df, "t").collect()}
    assert got[1]["is_available"] and got[2]["total_paragraphs"] == 0 and not got[2]["is_available"]


def test_price_change(spark):
    rows = spark.createDataFrame([("p", "t", "s", "x", 100.0, "2026-01-01", "a"), ("p", "t", "s", "x", 120.0, "2026-01-09", "b"), ("p", "t", "u", "x", 5.0, "2026-01-09", "c"), ("p", "t", "z", "x", 0.0, "2026-01-01", "d")],
                                 "platform string, product_type string, spec string, shop string, price double, at string, row_key string")
    rows = rows.withColumn("snapshot_time", F.col("at").cast("timestamp_ntz"))
    got = {r["spec"]: r for r in asof.price_change(rows, "2026-01-09", 7).collect()}
    assert (got["s"]["baseline"], got["s"]["latest"], got["s"]["change_pct"]) == (100.0, 120.0, 20.0)
    assert got["u"]["baseline"] is None and got["u"]["change_pct"] is None and got["z"]["change_pct"] is None


def test_upsert_keeps_first_and_last(spark):
    rows = spark.createDataFrame([(1, "u", "t1", "r1"), (2, "u", None, "r2"), (3, "v", "t3", "r3")], "id int, source_url string, title string, region string")
    got = {r["source_url"]: (r["title"], r["region"]) for r in merge.upsert(rows, merge.INTEL_BATCH, ["id"]).collect()}
    assert got == {"u": (None, "r1"), "v": ("t3", "r3")}


def test_evaluation(spark):
    def kappa(pairs):
        return evaluate.kappa(spark.createDataFrame(pairs, "a double, b double"), "a", "b").collect()[0]

    assert kappa([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 2.0)])["kappa"] == 0.5
    assert kappa([(1.0, 1.0)])["kappa"] == 1.0 and kappa([])["kappa"] == 0.0
    assert kappa([(2.5, 2.0)])["po"] == 1.0
    assert evaluate.quotas(10, corpus.QUOTAS) == {"definition": 3, "reasoning": 2, "comparison": 2, "summary": 2, "application": 1}
    assert evaluate.lcs_length(list("abcde"), list("xaced")) == 3
    train, test = evaluate.split(spark.range(20).withColumnRenamed("id", "k"), "k", 0.15, 42)
    assert (train.count(), test.count()) == (17, 3)


def test_terms():
    assert corpus.terms_in("本文不涉及水产养殖") == []
    assert "饲料" in corpus.terms_in("饲料配方")


def test_sample_builders_cover_every_block_and_template(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(i, f"Feed {i} for the fish pond. " * 8, "en", "s") for i in range(230)] + [(900, "short.", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, pick in (("context_input", "input"), ("sft_outputs", "plain"), ("cot_inject", "cot"), ("sft_candidates", "instruction")):
        got = entry.queries()[name](spark, str(tmp_path)).collect()
        assert len({(r["doc_id"], r["template"]) for r in got}) == len(got) == 231 * 5 and all(r[pick] for r in got), name


def test_rouge_n_counts_within_rows(spark):
    """Repeated grams count as often as both texts hold them; nothing is shuffled, and rows of one key stay apart."""
    rows = spark.createDataFrame([(1, "a a b", "a a a b"), (1, "x", "x y"), (2, "", None), (3, "水产 A", "水a产")], "k int, predict string, label string")
    one = evaluate.rouge_n(rows, 1, ("k",))
    assert sorted(tuple(r) for r in one.collect()) == [(1, round(2 / 3, 6)), (1, round(6 / 7, 6)), (2, 1.0), (3, 1.0)]
    assert sorted(tuple(r) for r in evaluate.rouge_n(rows, 2, ("k",)).collect()) == [(1, 0.0), (1, 0.8), (2, 0.0), (3, 0.0)]
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_to_all_cores(spark):
    from tidemark.plans.domain import texts

    given = texts(spark, "/root/testdata/sf0.001", ("a", "b"))
    assert given.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert sum(n > 0 for n in given.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) > 1


def folded(text: str, least: int = 30) -> list[tuple]:
    """(section, idx, body) line by line, as blocks were built once."""
    section, open_, done = "", "", []
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace("\u3000", " ").replace("\xa0", " ").replace("\r\n", "\n").replace("\r", "\n"))).strip(T.BLANKS)
    for line in (*(x.strip(T.BLANKS) for x in text.split("\n")), ""):
        head = re.match(r"#{1,6}[ \t\n\x0b\f\r]", line)
        if (head or line == "") and open_:
            done.append((section, open_))
        open_ = "" if head or line == "" else open_ + "\n" + line if open_ else line
        section = re.sub(r"^#{1,6}[ \t\n\x0b\f\r]+", "", line).strip(T.BLANKS) if head else section
    return [(s, i, b) for i, (s, b) in enumerate(done) if len(b) >= least and "参考文献" not in s and not b.lower().startswith("references") and not re.fullmatch(r"[-=*_\s]{3,}", b, re.A)]


def test_blocks_against_loop(spark):
    """Headings without a body, within a paragraph and of seven marks, blank lines of all kinds, rules and references; nothing is reckoned in an inferred filter."""
    at = random.Random(5)
    parts = ("# A", "## B b ", "#", "#x", "####### s", "###### six", "#\u2003wide", "# 参考文献", "References here", "---", "words", "a  b\tc", "\u3000", "\u2028", "\x85 y", "一句。", "\n", "\n", "\n\n", "\r\n", "\r", " ", "\x0b#\x0bq")
    docs = [(i, "".join(at.choices(parts, k=at.randrange(40)))) for i in range(400)] + [(400, None), (401, "")]
    df = spark.createDataFrame(docs, "k int, t string").withColumn("stem", F.lit("stem"))
    made = documents.blocks(df, "k", "t", "stem", 10**6, 2)
    want = {(k, *x[:2], x[2]) for k, t in docs for x in folded(t or "", 2)}
    joined = {(k, s, i, "".join(y for x in re.split(r"(?<=[。！？；!?;])", re.sub(r"[ \t]+", " ", b)) if (y := x.strip(T.BLANKS)))) for k, s, i, b in want}
    assert {(r["k"], r["section"], r["idx"], r["chunk"]) for r in made.collect()} == {x for x in joined if x[3]} and len(want) > 300
    assert "(size(" not in made._jdf.queryExecution().executedPlan().toString()


def test_strip_and_short_chunks(spark):
    at = random.Random(6)
    texts = ["".join(at.choices([*T.BLANKS, "\u200b", "\u180e", "鱼", "a", "。", ". "], k=at.randrange(12))) for _ in range(500)] + [None, ""]
    assert values(spark, texts, T.strip) == values(spark, texts, lambda c: T.sub(c, r"(?U)^\s+|\s+$", ""))
    assert values(spark, texts, lambda c: T.chunks(c, 12)) == [[x] if x else [] for x in values(spark, texts, lambda c: F.array_join(T.split_sentences(c), ""))]
