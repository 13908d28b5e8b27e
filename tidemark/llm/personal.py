"""Personal data: rules, and boosted trees over candidates that the rules leave.

Generators propose overlapping spans with high recall: mail-like strings with spelt-out signs too, and runs of
neighbouring digit groups that could be an address, a card or a phone number. What the rules take is the label: a
candidate that is a rule's span counts as 1, any other, parts of such a span too, as 0. A phone number is shown a second
time as it would stand without its country's digits. The trees see the format of a candidate and its context,
and nothing of what decides the rule (the plus sign, the checksum, the bound of 255, the form of the at sign); so they
know what personal data looks like where a rule's own sign is missing. Scores are calibrated by rising steps on
candidates that the trees were not fitted to; a kind's threshold is where its steps reach ``precision``.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import forget, written
from .toxicity import isotonic

#: Kinds in the order of spans; kinds that the trees add; cue words of each kind.
KINDS = ("email", "ip", "card", "phone")
ADDED = tuple(f"{k}_like" for k in KINDS)
CUES = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel", "adresse"),
    "ip": ("ip", "host", "server", "address", "addr", "from", "login"),
    "card": ("card", "visa", "master", "karte", "carte", "tarjeta", "konto", "account"),
    "phone": ("phone", "tel", "call", "fax", "mobil", "cell", "fon", "whatsapp"),
}
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Generators.
AT = re.compile(r"@|\x20?[(\[{](?:at|AT|@)[)\]}]\x20?|\x20(?:at|AT)\x20(?=[A-Za-z0-9-]+\x20(?:dot|DOT)\x20)")
DOT = re.compile(r"\.|\x20?[(\[{](?:dot|DOT|\.)[)\]}]\x20?|\x20(?:dot|DOT)\x20")
HOST = re.compile(rf"[A-Za-z0-9-]+(?:(?:{DOT.pattern})[A-Za-z0-9-]+)*")
#: One of these stands in any text that AT matches.
SIGNS = ("@", "(at", "[at", "{at", "(AT", "[AT", "{AT", " dot ", " DOT ")
CHAIN = re.compile(r"[0-9]+(?:[().\x20/:_-]{1,3}[0-9]+)*")
GROUP = re.compile(r"[0-9]+")
DIGITS = (7, 19)
#: Characters of context to either side.
NEAR = 40

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the rules: leftmost matches of each kind that do not overlap; each scan is linear."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    for m in NUMBERS.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in four):
                out.append((1, start, start + size))
            start += size + 1
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() > 15 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def proposals(text: str) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(kind, start, end, format numbers) of all candidates; they may overlap. A linear scan, a bounded number each group."""
    out = []
    for m in AT.finditer(text) if any(x in text for x in SIGNS) else ():
        start = m.start()
        while start and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, m.end())
        if start == m.start() or not host:
            continue
        name, labels = text[start : m.start()], DOT.split(host[0])
        digits = sum("0" <= c <= "9" for c in name)
        for n, end in sorted({(len(labels), host.end()), (1, host.start() + len(labels[0]))}):
            last = labels[n - 1]
            out.append((0, start, end, (n, len(name), digits, len(last), last.isalpha(), len(labels[0]), name.count("."), name[0].isalpha(), end == host.end(), sum(map(len, labels[:n])))))
    for m in CHAIN.finditer(text):
        if m.end() - m.start() < DIGITS[0]:
            continue
        groups = [g.span() for g in GROUP.finditer(text, m.start(), m.end())]
        for i in range(len(groups)):
            n = 0
            for j in range(i, len(groups)):
                n += groups[j][1] - groups[j][0]
                if n > DIGITS[1]:
                    break
                quad = j - i == 3 and all(text[groups[k][1] : groups[k + 1][0]] == "." for k in range(i, j))
                if n < DIGITS[0] and not quad:
                    continue
                start, end = groups[i][0], groups[j][1]
                if text[start - 1 : start] == "(" and ")" in text[start:end]:
                    start -= 1
                plus = text[start - 1 : start] == "+"
                sizes = [b - a for a, b in groups[i : j + 1]]
                inner = text[start:end]
                shape = (n, j - i + 1, sizes[0], sizes[-1], max(sizes), min(sizes), inner.count(" "), inner.count("-"), inner.count("."), inner.count("("), inner.count("/") + inner.count(":"), len(set(inner) & _DIGITS), i, len(groups) - 1 - j)
                if quad:
                    out.append((1, start, end, shape))
                if n >= 13:
                    out.append((2, start, end, shape))
                if DIGITS[0] <= n <= 15:
                    out.append((3, start - plus, end, shape))
    return out


_DIGITS = frozenset("0123456789")


def _class(c: str) -> int:
    return 0 if not c else 1 if c in " \t" else 2 if c in "\r\n" else 3 if c.isalpha() else 4 if c.isdigit() else 5


def features(text: str, kind: int, start: int, end: int, shape: tuple[int, ...]) -> list[float]:
    """Format numbers, then the context: neighbours, cue words before, what surrounds it."""
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    if kind == 3 and text[start : start + 1] == "+":
        shape = shape[:12] + (0,) + shape[13:]  # a plus sign starts a number
    low, around = before.lower(), before + after
    cue = max((low.rfind(w) for w in CUES[KINDS[kind]]), default=-1)
    tail = before.rstrip(" ")[-1:]
    return [*map(float, shape), float(_class(before[-1:])), float(_class(after[:1])), float(_class(tail)), float(tail in (":", "=")), float(cue >= 0), float(len(low) - cue if cue >= 0 else 99), sum(c.isdigit() for c in around) / max(1, len(around)), sum(c.isupper() for c in around) / max(1, len(around)), sum(not c.isalnum() and c != " " for c in around) / max(1, len(around))]


def _domestic(text: str, start: int, end: int) -> list[float] | None:
    """Features of a phone number as it would be without plus sign and first group."""
    first = re.compile(r"\+[0-9]+[^0-9(]*(?=[0-9(])").match(text, start, end)
    if not first:
        return None
    near = text[max(0, start - NEAR) : start] + text[first.end() : end + NEAR]
    at = min(start, NEAR)
    return next((features(near, k, s, e, shape) for k, s, e, shape in proposals(near) if (k, s, e) == (3, at, at + end - first.end())), None)


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int, int, int, list[float]]]:
    """(kind, start, end, label, features) of every candidate; a number shown without its country has no place, -1."""
    taken = set(base)
    for k, s, e, shape in proposals(text):
        yield k, s, e, int((k, s, e) in taken), features(text, k, s, e, shape)
    for k, s, e in base:
        if k == 3 and (x := _domestic(text, s, e)):
            yield 3, -1, -1, 1, x


@dataclass
class Model:
    """Trees of one kind, the calibration's steps over their margins, and the least calibrated score of a span."""

    trees: boost.Trees
    at: np.ndarray
    value: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margin(x), self.at, self.value)


def model_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, precision: float) -> Model | None:
    """None where either half lacks a label, or where no score is as precise as asked for."""
    if any(len(np.unique(y[h])) < 2 for h in (held, ~held)):
        return None
    trees = boost.fit(x[~held], y[~held], w[~held])
    at, value = isotonic(trees.margin(x[held]), y[held], w[held])
    return Model(trees, at, value, precision) if value.max() >= precision else None


SPAN = "kind:int,start:int,end:int"
#: Candidates that are held at once.
CHUNK = 8192


def _chunks(items: Iterator) -> Iterator[list]:
    while some := list(islice(items, CHUNK)):
        yield some


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, label, held, x) of every candidate; held: it calibrates, told by a hash of its row's id and its place."""

    def each() -> Iterator[tuple]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                for k, s, _, label, x in candidates(text, base_spans(text)):
                    yield k, label, zlib.crc32(f"{i}:{s}".encode()) % 4 == 0, x

    kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.float32()))
    for some in _chunks(each()):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names=["kind", "label", "held", "x"])


def added(text: str, base: list[Span], models: dict[int, Model]) -> list[tuple[int, int, int, float]]:
    """Candidates above their threshold that touch no rule's span: highest score first, then longest, then leftmost."""
    good = []
    for some in _chunks((k, s, e, x) for k, s, e, _, x in candidates(text, base) if s >= 0 and k in models):
        for k, model in models.items():
            own = [c for c in some if c[0] == k]
            if own:
                good += [(p, *c[:3]) for c, p in zip(own, model.scores(np.array([c[3] for c in own], np.float32)).tolist()) if p >= model.threshold]
    ends, starts, out = [], [], []
    for s, e in sorted((s, e) for _, s, e in base) if good else ():  # as spans that don't overlap
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for p, k, s, e in sorted(good, key=lambda c: (-c[0], c[2] - c[3], c[2], c[1])):
        at = bisect_right(starts, s)
        if (not at or ends[at - 1] <= s) and (at == len(starts) or e <= starts[at]):
            starts.insert(at, s)
            ends.insert(at, e)
            out.append((k, s, e, p))
    return sorted(out)


def _structs(rows: list[list[tuple]], names: tuple[str, ...], kinds: tuple) -> pa.Array:
    cols = list(zip(*(c for r in rows for c in r))) or [()] * len(names)
    inner = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=list(names))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int32()), inner)


def _found(batches: Iterator[pa.RecordBatch], models: dict[int, Model]) -> Iterator[pa.RecordBatch]:
    """(id, base, added) of (id, text)."""
    names, kinds = ("kind", "start", "end"), (pa.int32(),) * 3
    for b in batches:
        base, more = [], []
        for t in b.column(1):
            text = t.as_py()
            base.append(base_spans(text))
            more.append(added(text, base[-1], models))
        yield pa.RecordBatch.from_arrays([b.column(0), _structs(base, names, kinds), _structs(more, (*names, "score"), (*kinds, pa.float64()))], names=["id", "base", "added"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fit(docs: DataFrame, max_examples: int = 8192, precision: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> dict[int, Model]:
    """The models by kind. Equal candidates are one example, weighed by their number.

    Of each kind and label at most ``max_examples`` distinct candidates come to the driver, by a hash of their features;
    their weights stand for the rest. One in four, by a hash of its place, calibrates. A kind without both labels on
    either side has no model.
    """
    each = _texts(docs, id_col, text_col).mapInArrow(_examples, "kind int, label int, held boolean, x array<float>")
    each = written(each.groupBy("kind", "label", "held", "x").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("kind", "x")), "examples")
    there = {(r["kind"], r["label"]): r["n"] for r in each.groupBy("kind", "label").count().withColumnRenamed("count", "n").collect()}
    # a tenth less than the bound, since a hash takes a share, not a number
    cuts = F.array(*(F.lit(min(2**20, int(2**20 * 0.9 * max_examples / there.get((k, y), 1)))) for k in range(len(KINDS)) for y in (0, 1)))
    some = each.where(F.pmod("h", F.lit(2**20)) < F.get(cuts, F.col("kind") * 2 + F.col("label")))
    found: dict[int, list] = {}
    for r in some.collect():
        found.setdefault(r["kind"], []).append(r)
    out = {}
    for k, rows in sorted(found.items()):
        rows.sort(key=lambda r: (r["h"], r["held"]))
        kept = [r for y in (0, 1) for r in [r for r in rows if r["label"] == y][:max_examples]]
        model = model_of(np.array([r["x"] for r in kept], np.float32), np.array([r["label"] for r in kept], float), np.array([r["n"] for r in kept], float), np.array([r["held"] for r in kept]), precision)
        if model:
            out[k] = model
    forget(each)
    return out


def find(docs: DataFrame, max_examples: int = 8192, precision: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): spans as (kind, start, end) in code points, end exclusive; added ones with their score.

    Null texts count as empty and hold nothing. Repeated rows get the same spans each; a null id is a value like any
    other. Of overlapping candidates the one of the highest score stays, of ties the longest, then the leftmost. Spans
    of the rules may overlap each other, added ones overlap none. Very long texts are scanned whole in one pass. An
    empty table gives an empty result; extra columns, whatever their names, are ignored. Texts are read twice, for the
    examples and for the spans, so that nothing of them is stored and a task holds CHUNK candidates of one at a time.
    """
    rows, models = _texts(docs, id_col, text_col), fit(docs, max_examples, precision, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(partial(_found, models=models), f"id {kind}, base array<struct<{SPAN}>>, added array<struct<{SPAN},score:double>>")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with [KIND] for each span; spans that overlap are one, named by the first."""
    out, last = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])):
        if s >= last:
            out += [text[last:s], f"[{KINDS[k].upper()}]"]
        last = max(last, e)
    return "".join(out) + text[last:]


def _redact(batches: Iterator[pa.RecordBatch], models: dict[int, Model], at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        new = []
        for t in b.column(at):
            if text := t.as_py():
                base = base_spans(text)
                text = redacted(text, [*base, *(c[:3] for c in added(text, base, models))])
            new.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(new, b.schema.field(i).type) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)


def redact(docs: DataFrame, models: dict[int, Model], text_col: str = "text") -> DataFrame:
    """docs with every span in the text replaced by its kind; a null text stays null, all other columns as they are."""
    return docs.mapInArrow(partial(_redact, models=models, at=docs.columns.index(text_col)), docs.schema)
