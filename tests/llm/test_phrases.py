"""Phrase collocations against brute force, over small blocks."""

import glob
import random
import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases
from tidemark.llm.common import written

DOCS = "doc_id long, text string, lang string, n int, words string, phrase array<string>"


def plain(rows, least, most=5, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        t = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + m]) for m in range(1, most + 1) for i in range(len(w) - m + 1))
    f = {k: a for k, a in f.items() if a >= least}
    found = {}
    for (lang, *w), a in f.items():
        if len(w) > 1:
            cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            inside = any(x[0] == lang and len(x) - 1 > len(w) and b >= a and any(list(x[i : i + len(w)]) == w for i in range(1, len(x) - len(w) + 1)) for x, b in f.items())
            if not inside:
                found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, x, r, n[lang], -s) for lang, each in found.items() for i, (s, a, p, x, r) in enumerate(sorted(each)[:top]))


def told(df):
    return sorted(tuple(r) for r in df.collect())


def rows_of(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["New", "york", "is", "a", "a", "big", "Stadt", "é", "ÀB", "x\x0by", "day"]
    out = []
    for i in range(n):
        w = [r.choice(vocabulary) + r.choice(["", "", "", ",", ". ", "\t", "!?", "\n"]) for _ in range(r.randrange(60))]
        out.append((i, " ".join(w) + r.choice(["", " in the city of new york is great"]), r.choice(["en", "en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("block,sent", [(2_000_000, 32_000_000), (150, -1)])
def test_against_brute_force(spark, monkeypatch, block, sent):
    monkeypatch.setattr(phrases, "SENT", sent)
    rows = rows_of(5)
    given = spark.createDataFrame([(*r, 1, "w", ["p"]) for r in rows], DOCS)
    # blocks are cut in the workers, which get the bound from here
    for name in ("_lists", "_counted", "_sent_lists"):
        monkeypatch.setattr(phrases, name, phrases.partial(getattr(phrases, name), block=block))
    for least, top in ((12, 2000), (30, 3)):
        want = plain(rows, least, top=top)
        assert len(want) > (4 if top == 3 else 30)
        assert told(phrases.collocations(given.repartition(3), least=least, top=top)) == want


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", None), (3, " ,., ;\n", "en"), (None, "a b", None), (None, "a b", "und"), (4, "solo", "fr"), (5, "a b " * 30_000, "long"), (6, "x" * 100_000, "long"), (7, "..." * 50_000 + "a b", "und")]
    given = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)
    got = told(phrases.collocations(given, least=3))
    assert [r for r in got if r[0] == "und"] == [("und", 1, "a b", 3, 3, 3, 6, 2000)]
    assert got == plain(rows, 3)
    assert told(phrases.collocations(given.limit(0))) == []


def test_words():
    found, piece, text = phrases.words([b"A b,c", b"", b" d\te.. f"])
    assert found.to_pylist() == [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert piece.tolist() == [0, 0, 1, 2, 2, 3] and text.tolist() == [0, 0, 0, 2, 2, 2]


def test_levels_are_small_in_memory(spark):
    """However many blocks a task's input makes, it holds few: levels come in row groups of few blocks, word lists once."""
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(f"w{x}" for x in rng.integers(0, 1 << 20, 20_000))) for i in range(64)]
    given = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).select(F.lit("en").alias("lang"), "text")
    words = {f"w{x}".encode(): x for x in range(1 << 20)}
    spelt = pa.array(list(words), pa.binary())
    sent = spark.sparkContext.broadcast({"en": (spelt, np.arange(len(words)))})
    level = written(given.mapInArrow(partial(phrases._sent_lists, known=sent, block=20_000), phrases.LEVEL), "level-1", phrases.ROWS | {"parquet.block.size": 1 << 18})
    assert level.where("starts is null and phrase is null and phrases is null").count() == level.count() == 64
    (path,) = glob.glob(level._written_to + "/*.parquet")
    held = pq.ParquetFile(path).metadata
    assert max(held.row_group(i).num_rows for i in range(held.num_row_groups)) <= 8
    assert sum(len(one.at) for b in level.toArrow().to_batches() for one in phrases.Level.each(b)) == 64 * 20_000
