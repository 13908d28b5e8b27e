"""Secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's regex gives a Boolean trigram query: trigrams that any match must hold, as alternatives of sets. The
index holds the postings of the trigrams that queries name; the postings of a set are intersected, the sets of a
rule united, and only candidates are verified by the regex. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _parser  # type: ignore[attr-defined]

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


@dataclass(frozen=True)
class Rule:
    """kind: its name; group ``group`` of a match must have ``least`` characters or more, else the match is dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The base rules, then further common secret formats.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[baprs]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"://[^/:@\x00-\x20]+:[^/:@\x00-\x20]+@"),
)
#: Alternatives up to which literal strings are multiplied out.
WIDE = 64

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _grams(text: str) -> frozenset[str]:
    low = text.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def _absorbed(query: set[frozenset[str]]) -> Query:
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    return _absorbed({x | y for x, y in product(a, b)}) if len(a) * len(b) <= WIDE * WIDE else a


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """(the strings that match, if few; else None, the query that any match meets)."""
    exact: set[str] | None = {""}
    run, query, whole = {""}, ANY, True

    def flush() -> None:
        nonlocal run, query
        query = _both(query, _absorbed({_grams(s) for s in run}))
        run = {""}

    for op, arg in nodes:
        some: set[str] | None
        own: Query = ANY
        name = str(op)
        if name == "LITERAL":
            some = {chr(arg)}
        elif name == "IN":
            chars = [range(a, a + 1) if str(o) == "LITERAL" else range(a[0], a[1] + 1) if str(o) == "RANGE" else range(2**20) for o, a in arg]
            some = {chr(c) for r in chars for c in r} if sum(map(len, chars)) <= 8 else None
        elif name == "SUBPATTERN":
            some, own = _walk(arg[3])
        elif name == "BRANCH":
            each = [_walk(x) for x in arg[1]]
            some = set().union(*(s for s, _ in each)) if all(s is not None for s, _ in each) else None
            own = _absorbed(set().union(*(q for _, q in each)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            some, own = _walk(inner)
            if (low, high) == (0, 1) and some is not None:
                some = some | {""}
            elif low == 0:
                some, own = None, ANY
            elif (low, high) != (1, 1):
                if some is not None and len(run) * len(some) <= WIDE:
                    run = {a + b for a, b in product(run, some)}
                some = None
        elif name == "AT":
            continue
        else:
            some = None
        if some is not None and len(run) * len(some) <= WIDE:
            run = {a + b for a, b in product(run, some)}
        else:
            whole = False
            flush()
            query = _both(query, own)
    if whole:
        exact = run
    else:
        exact = None
        flush()
    return exact, query if not whole else _absorbed({_grams(s) for s in run})


def trigram_query(regex: str) -> Query:
    """Sets of lower-case trigrams, one of which every match of the regex holds in full; an empty set: no demand."""
    return _walk(list(_parser.parse(regex)))[1]


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches, leftmost and non-overlapping, in code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else hits
    parts = F.split(text, rule.regex, -1)
    kind = "array<struct<start:int,end:int>>"
    steps = F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), F.arrays_zip(hits.alias("hit"), judged.alias("judged")), lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h["hit"]).alias("size"), F.length(h["judged"]).alias("judged")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        grown = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(x["judged"] >= rule.least, grown).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def _tagged(found: Column, rank: int, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row of docs; spans: array of (start, rank, end, kind) by start, then rank of the rule.

    Null texts count as empty and hold nothing. Repeated rows get the same spans each, a null id is a value like any
    other. Spans of different rules may overlap, and of ties the rule of lower rank comes first; very long texts are
    scanned whole. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    clauses = [(r.kind, i, len(c), g) for r in rules if ANY != queries[r.kind] for i, c in enumerate(sorted(queries[r.kind], key=sorted)) for g in sorted(c)]
    spark = docs.sparkSession
    rows = base
    if clauses:
        wanted = F.array(*(F.lit(g) for g in sorted({g for *_, g in clauses})))
        low = base.select("id", "h", ascii_lower(F.col("text")).alias("low"))
        postings = low.select("id", "h", F.explode(F.filter(wanted, lambda g: F.contains("low", g))).alias("gram"))
        demand = spark.createDataFrame(clauses, "kind string, clause int, n int, gram string")  # bounded by the rules
        met = postings.join(F.broadcast(demand), "gram").groupBy("id", "h", "kind", "clause", "n").agg(F.count_distinct("gram").alias("got")).where("got = n")
        found = met.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set("kind").alias("__kinds"))
        rows = base.join(found, base["id"].eqNullSafe(found["__id"]) & (base["h"] == found["__h"]), "left")
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"
    none = F.array().cast(kind)
    each = []
    for rank, r in enumerate(rules):
        if queries[r.kind] != ANY:
            may = F.array_contains("__kinds", r.kind)
        else:  # a full scan, which a match of the least length starts
            may = F.col("text").rlike(r.regex[:-1] + f"{{{r.least}}}" if r.least and re.fullmatch(r"\[[^\]]+\]\+", r.regex) else r.regex)
        each.append(F.when(may, _tagged(spans(F.col("text"), r), rank, r.kind)).otherwise(none))
    return rows.select("id", F.array_sort(F.concat(*each)).alias("spans"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
