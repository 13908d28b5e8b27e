"""Rules and terms by one automaton against trying each of them."""

import random
import re

import pytest

from tidemark.functions import matching
from tidemark.functions import rules as R
from tidemark.operators import corpus as C


@pytest.mark.parametrize("pattern,want", [("salmon|trout", {"salmon", "trout"}), ("King.{0,9}Salmon", {"salmon"}), ("a?b*", None), ("(?:ab|c+)x", {"x"}), ("(?:ab|c+)x?", {"ab", "c"}), ("[ab]c", {"c"}), ("x{2,}y", {"x"}), ("(abc)?", None), ("\\p{L}+z", None), ("", None), ("帝王鲑|三文鱼", {"帝王鲑", "三文鱼"})])
def test_literals(pattern, want):
    assert matching.literals(pattern) == want


def test_rules_against_each(spark):
    r = random.Random(2)
    bits = ["ab", "Cd", "e", "f1", "é", "Ü", " ", "-"]
    patterns = ["".join(r.choice(["ab", "cd", "e+", "f?1", "[a-c]", "(?:cd|é)", ".", "a|b", "é"]) for _ in range(r.randrange(1, 4))) for _ in range(300)] + ["zzz", "", "q\\b"]
    patterns[:] = [p if i < 40 else p + "q" for i, p in enumerate(patterns)]
    rules = [(i, f"t{i}", p, r.randrange(4) + (9 if len(p) < 3 else 0)) for i, p in enumerate(patterns)] + [(999, "none", None, 0)]
    texts = [(i % 150, "".join(r.choice(bits + ["q"]) for _ in range(r.randrange(12)))) for i in range(400)] + [(1, None), (2, "")]
    got = R.classify_join(spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(rules, "id int, product_type string, pattern string, priority int"), "t", "k")
    ordered = sorted((x for x in rules if x[2] is not None), key=lambda x: (x[3], x[0]))
    want = sorted((k, next((y for _, y, p, _ in ordered if t is not None and re.search(p, t, re.I | re.A)), "unknown")) for k, t in texts)
    assert sorted((x["k"], x["product_type"]) for x in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    with pytest.raises(ValueError):
        R.classify_join(spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(rules, "id int, product_type string, pattern string, priority int"), "t", "k", most=10)


def test_many_rules_find_something(spark):
    import __spark_entry__ as entry

    got = {r["product_type"] for r in entry.OWN["rule_classify_many"][0](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) > 3


def test_terms_against_each(spark):
    r = random.Random(3)
    terms = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(3000)] + [None, "", "abc", "abc", "Abc"]
    texts = [("".join(r.choice("abcdeé ") for _ in range(60)),) for _ in range(40)] + [(None,), ("",)]
    one = C.term_coverage(spark.createDataFrame(texts, "output string").repartition(5), spark.createDataFrame([(t,) for t in terms], "term string")).first()
    assert (one["covered"], one["total"]) == (sum(t is not None and any(t in (x or "") for x, in texts) for t in terms), len(terms))
    empty = spark.createDataFrame([], "output string")
    assert tuple(C.term_coverage(empty, spark.createDataFrame([("a",)], "term string")).first()) == (0, 1)
    assert tuple(C.term_coverage(empty, spark.createDataFrame([], "term string")).first()) == (0, 0)
    with pytest.raises(ValueError):
        matching.held_terms(spark.range(1).id, ["x"] * (matching.BITS + 1))
