"""Sample acceptance against a plain loop over the same attempts, and places found by histograms."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions.matching import held_terms
from tidemark.operators import corpus as C
from tidemark.operators.evaluate import nth


@pytest.mark.parametrize("seed", range(2))
def test_nth(spark, seed):
    at = random.Random(seed)
    values = [at.choice((at.randrange(-5, 5), at.randrange(-(2**63), 2**63), 7)) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    assert [nth(df, "v", n, 64) for n in (0, 1, 77, 200, 201)] == [None, min(values), sorted(values)[76], max(values), None]
    assert nth(df.limit(0), "v", 1) is None


def _blocks(spark):
    """Repeated blocks, blocks without any term, a block too long to be taken whole, and one that is too short."""
    fish = "养殖水质与饲料影响成活率。溶解氧不足会引起应激。苗种质量决定产量，密度应当控制在合理范围之内。应及时换水。"
    rows = [("a", fish), ("b", "天气很好，我们去公园散步。" * 6), ("c", "养殖" + "很长的句子" * 900 + "。"), ("a", fish), ("d", "短"), ("e", fish + "另外还要检查盐度。"), ("a", fish)]
    return spark.createDataFrame([(i * 10, k, "题目" + k, "节", t, []) for i, (k, t) in enumerate(rows)] + [(None, "z", "t", "s", fish, [])], "ord long, doc_id string, title string, section string, content string, keywords array<string>")


def test_against_loop(spark):
    targets = {"definition": 6, "reasoning": 0, "summary": 5}
    blocks = _blocks(spark)
    samples, refused = C.generated(blocks, targets)
    ready = C.prepared(blocks)
    want, counts, taken = [], {}, set()
    for template in ("definition", "summary"):
        target, made = targets[template], 0
        wrapped = round(target * C.SUMMARY_COT)
        tries = max(40 * target, 200)
        grid = C.candidates(ready, template, tries).withColumn("plain_terms", C.domain_terms(F.concat_ws("\n", "title", "content", "plain")))
        attempts = sorted(grid.collect(), key=lambda r: r["attempt"])
        assert [r["attempt"] for r in attempts] == list(range(tries))
        for r in attempts:
            if made == target:
                break
            cot = template == "summary" and made < wrapped
            output, terms = (r["cot"], r["terms"]) if cot else (r["plain"], r["plain_terms"])
            key = (r["instruction"], r["input"])
            why = "incomplete" if not 50 <= len(output) <= 4096 else "duplicate" if key in taken else "domain_irrelevant" if not terms else None
            if why:
                counts[template, why] = counts.get((template, why), 0) + 1
                continue
            taken.add(key)
            made += 1
            want.append((template, made, r["attempt"], r["doc_id"], *key, output, cot))
    got = sorted(tuple(r[c] for c in ("template", "rank", "attempt", "doc_id", "instruction", "input", "output", "cot_injected")) for r in samples.collect())
    assert got == sorted(want)
    assert {(r["template"], r["reason"]): r["n"] for r in refused.collect()} == counts
    assert {w for _, w in counts} == {"incomplete", "duplicate", "domain_irrelevant"}


def test_no_blocks(spark):
    samples, refused = C.generated(_blocks(spark).limit(0), {"definition": 2})
    assert samples.count() == refused.count() == 0


def test_whole_texts_are_not_batched_by_arrow(spark):
    """Arrow would hand a worker 10,000 texts at once."""
    built = C.of_each_block(C.prepared(_blocks(spark))).withColumn("held", held_terms(F.col("cot"), C.TERMS))
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_terms_and_phrases_against_loops(seed):
    at = random.Random(seed)
    words = (*C.DOMAIN_TERMS, *C.NEGATIONS, *C.GENERIC, "abc", "x", "，", "。" * 13, " ")
    for text in [None, "", *("".join(at.choices(words, k=at.randrange(60))) for _ in range(200))]:
        want, weights = [], Counter()
        for t in C.TERMS:
            places = [i for i in range(len(text or "")) if text.startswith(t, i)]
            free, end = False, 0
            for i in places:
                if i >= end and not free:
                    free, end = not any(n in text[max(0, i - 12) : i + len(t) + 12] for n in C.NEGATIONS), i + len(t)
            want += [t] if free else []
        assert C.terms_in(text) == want[:8]
        for p in C._RUN.findall(text or ""):
            if p not in C.GENERIC:
                weights[p] += 5 if p in C.TERMS else 1
        assert C.phrases_in(text, frozenset(C.TERMS)) == [p for p, _ in weights.most_common(8)]
