"""Rule dictionaries, polls whose rules change, raw events with ids of their own."""

import pytest

from tidemark.functions import rules as R
from tidemark.sources import dictionaries as D
from tidemark.sources import tables
from tidemark.streaming.polling import poll

KIND = f"seq long, {D.TYPES}"


def test_upserted_row_by_row(spark):
    rows = [(3, "a", "x", 1, 0.5, True), (1, "a", "x", 9, 0.1, False), (2, "b", "y", 2, None, True), (4, None, "z", 1, 1.0, True), (5, "c", "x", 7, 0.2, True), (6, "b", "y", None, 0.3, None)]
    first = D.upserted(None, spark.createDataFrame(rows, KIND))
    assert sorted(map(tuple, first.collect())) == [(1, "a", "x", 1, 0.5, True), (2, "b", "y", None, 0.3, None), (3, "c", "x", 7, 0.2, True)]
    again = D.upserted(first, spark.createDataFrame([(1, "c", "x", 8, 0.9, False), (2, "d", "q", 1, 1.0, True)], KIND))
    assert sorted(map(tuple, again.collect())) == [(1, "a", "x", 1, 0.5, True), (2, "b", "y", None, 0.3, None), (3, "c", "x", 8, 0.9, False), (4, "d", "q", 1, 1.0, True)]
    assert sorted(map(tuple, D.upserted(again, spark.createDataFrame(rows, KIND).limit(0)).collect())) == sorted(map(tuple, again.collect()))


def test_versions_and_rules(spark, tmp_path, monkeypatch):
    d = D.Dictionary(spark, str(tmp_path))
    assert d.version() == 0 and d.rows() is None and d.rules() == R.Rules()
    assert d.upsert(D.type_seeds(spark)) == 1
    assert [(r.product_type, r.pattern, r.priority, r.confidence) for r in d.rules().types] == [(r.product_type, r.pattern, r.priority, r.confidence) for r in R.TYPE_RULES]
    old = d.rows()
    d.upsert(spark.createDataFrame([(1, "salmon_generic", R.TYPE_RULES[2].pattern, 90, 0.7, False), (2, "eel", "eel|aal", 5, 0.9, True)], KIND))
    assert [r.product_type for r in d.rules().types] == ["eel", "king_salmon", "rainbow_trout"] and old.count() == 3 and d.rows().count() == 4
    monkeypatch.setattr(D, "MOST", 2)
    with pytest.raises(ValueError):
        d.rules()


def test_poll_with_rules_that_change(spark, tmp_path):
    d, feed, out = D.Dictionary(spark, f"{tmp_path}/rules"), f"{tmp_path}/feed", f"{tmp_path}/out"
    d.upsert(D.type_seeds(spark))
    kind = spark.createDataFrame([], "k int, t string").schema
    now, cache = [0.0], None
    loads = tables.Reloaded(lambda: (d.version(), d.rules()), 10, lambda: now[0])
    for i, (at, rows) in enumerate([(0, [(1, "Salmon"), (2, "eel")]), (5, [(3, "eel")]), (11, [(4, "EEL"), (5, None)])]):
        now[0] = float(at)
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(feed)
        cache = poll(spark.readStream.schema(kind).parquet(feed), d, out, f"{tmp_path}/c", "t", cache=loads)
        if i == 0:
            d.upsert(spark.createDataFrame([(1, "eel", "eel|aal", 5, 0.9, True)], KIND))
    assert cache is loads
    # the second poll comes while the rules are still fresh, the third after their time
    assert sorted(map(tuple, spark.read.parquet(out).select("k", "product_type", "rules").collect())) == [(1, "salmon_generic", 1), (2, "unknown", 1), (3, "unknown", 1), (4, "eel", 2), (5, "unknown", 2)]
    poll(spark.readStream.schema(kind).parquet(feed), d, out, f"{tmp_path}/c", "t")
    assert spark.read.parquet(out).count() == 5


def test_raw_events(spark, tmp_path, monkeypatch):
    same, path = spark.createDataFrame([("a", 1)] * 40 + [(None, None)] * 3, "x string, n int").repartition(5), f"{tmp_path}/raw"
    assert tables.append_raw(same, path, "one") == (1, 43)
    assert tables.append_raw(same, path, "two") == (44, 43)
    before = sorted(map(tuple, spark.read.parquet(path).select("id", "x", "n").collect()), key=str)
    assert tables.append_raw(same, path, "one") == (1, 43)
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "x", "n").collect()), key=str) == before
    assert sorted(r[0] for r in before) == list(range(1, 87))
    # a batch that was written but not committed is written anew under the same ids
    with monkeypatch.context() as m:
        m.setattr(tables.Log, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            tables.append_raw(same, path, "three")
    assert tables.append_raw(same, path, "three") == (87, 43)
    assert tables.append_raw(same.limit(0), path, "none") == (130, 0) and tables.append_raw(same, path)[0] == 130
    assert sorted(r["id"] for r in spark.read.parquet(path).select("id").collect()) == list(range(1, 173))
