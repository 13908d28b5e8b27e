"""Streams: upserts into buckets under re-delivery and failure, feeds without repeats, rules that change."""

import datetime as dt
import random

import pytest

from tidemark.operators.merge import Policy, upsert
from tidemark.streaming import upserts

KIND = "k string, part int, v int, w string, ts timestamp, n long"
POLICY = Policy({"k": 4, "part": None}, ("v", "w"), ignore_case=True)
SEQ = ["ts", "n"]


def rows_of(seed, n=300):
    r = random.Random(seed)
    return [(r.choice(["abcd1", "ABCD2", "xy", None, "", "Zz"]), r.choice([1, 2, None]), r.choice([None, 1, 2, 3]), r.choice(["a", None]), dt.datetime(2024, 1, 1 + r.randrange(3)), seed * 1000 + i) for i in range(n)]


def plain(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def table(spark, tmp_path, name="t", **more):
    return upserts.BucketedTable(spark, f"{tmp_path}/{name}", spark.createDataFrame([], KIND).schema, POLICY, SEQ, **({"buckets": 8} | more))


def test_batches_in_any_order_and_number(spark, tmp_path):
    batches = [spark.createDataFrame(rows_of(i), KIND) for i in (1, 2, 3)]
    whole = batches[0].unionByName(batches[1]).unionByName(batches[2])
    want = plain(upsert(whole, POLICY, SEQ).select("k", "part", "v", "w", "ts", "n").drop("ts", "n"))
    for name, order in (("a", (0, 1, 2)), ("b", (2, 0, 1, 0, 2, 2))):
        t = table(spark, tmp_path, name)
        for number, i in enumerate(order):
            assert t.merge(batches[i], number)
            assert t.merge(batches[(i + 1) % 3], number) == []  # a number comes again: left out
        assert plain(t.rows().drop("ts", "n")) == want
        assert t.rows().count() == len({(str(r[0])[:4].lower() if r[0] is not None else None, r[1]) for r in whole.collect()})
    assert t.merge(whole.limit(0), 99) == [] and plain(t.rows().drop("ts", "n")) == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path, buckets=64)
    many = spark.createDataFrame([(f"k{i}", i, 1, "a", dt.datetime(2024, 1, 1), i) for i in range(200)], KIND)
    assert len(t.merge(many, 0)) > 40
    before = t._manifest(0)["folders"]
    touched = t.merge(many.where("part = 7").selectExpr("k", "part", "9 as v", "w", "ts", "n + 1000 as n"), 1)
    after = t._manifest(1)["folders"]
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == {str(touched[0])}
    assert t.rows().where("v = 9").count() == 1 and t.rows().count() == 200
    # the number of buckets stays what it was; the third batch removes what the second replaced
    again = table(spark, tmp_path, buckets=3)
    assert again.buckets == 64
    again.merge(many.where("part = 8"), 2)
    assert not (tmp_path / "t" / before[str(touched[0])] / f"bucket={touched[0]}").exists()
    assert again.rows().count() == 200


def test_a_batch_that_fails_half_way(spark, tmp_path, monkeypatch):
    t, first, second = table(spark, tmp_path), spark.createDataFrame(rows_of(1), KIND), spark.createDataFrame(rows_of(2), KIND)
    t.merge(first, 0)
    want = plain(t.rows())

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(t, "_commit", fail)
        with pytest.raises(OSError):
            t.merge(second, 1)
    assert plain(t.rows()) == want
    t.merge(second, 1)
    assert plain(t.rows().drop("ts", "n")) == plain(upsert(first.unionByName(second), POLICY, SEQ).select("k", "part", "v", "w"))
    with pytest.raises(RuntimeError):
        t._commit(1, {})


def test_streamed(spark, tmp_path):
    """Files that come between two runs, and a checkpoint that is lost so that all files come again."""
    t, src = table(spark, tmp_path), f"{tmp_path}/in"
    spark.createDataFrame(rows_of(4), KIND).write.parquet(src)

    def run(checkpoint):
        stream = spark.readStream.schema(spark.createDataFrame([], KIND).schema).option("maxFilesPerTrigger", 1).parquet(src)
        upserts.upsert_stream(stream, t, f"{tmp_path}/{checkpoint}")

    run("c1")
    spark.createDataFrame(rows_of(5), KIND).write.mode("append").parquet(src)
    run("c1")
    want = plain(upsert(spark.read.parquet(src), POLICY, SEQ).select("k", "part", "v", "w"))
    assert plain(t.rows().drop("ts", "n")) == want
    run("c2")
    assert plain(t.rows().drop("ts", "n")) == want


def test_empty_table(spark, tmp_path):
    assert table(spark, tmp_path).rows().count() == 0


def test_feed_without_repeats(spark, tmp_path):
    src = f"{tmp_path}/in"
    some = spark.createDataFrame([(i % 50, dt.datetime(2024, 1, 1, 0, i % 60)) for i in range(200)], "id long, ts timestamp")
    some.write.parquet(f"{src}/a")
    some.limit(60).write.parquet(f"{src}/b")
    stream = spark.readStream.schema(some.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    out = []
    upserts.append_once(stream, ["id"], "ts").writeStream.foreachBatch(lambda b, _: out.extend(r["id"] for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == list(range(50))
