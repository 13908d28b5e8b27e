"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

``fit`` reads at most ``max_examples`` labelled rows, up to half of them of label 1 and the rest of label 0 (the
smallest by a seeded hash of the id; the bound is a parameter), and each example weighs as many labelled rows as it
stands for. It keeps the terms (words and word beginnings) whose presence goes with the label, and numbers them; all
other words of a text count as one background term, so that cosine tells one chance hit from many. One pass over all
documents counts the terms of each text and their document frequency over all documents; idf rests on that. Examples
are dealt into blocks; a block holds the postings of its own terms, and the index holds each term's largest weight in
each block. A query sums these maxima to an upper bound for each block, reads blocks in falling order of bound, and
stops when no bound reaches the kth similarity: the neighbours are exact. Votes weighted by similarity become a
probability by isotonic calibration on the examples themselves, each scored without itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_EDGE = b".,;:!?\"'()[]{}<>|*#%&_-+=/\\"
_LETTER = re.compile(rb"[a-z\x80-\xff]")


#: Bytes of the word beginnings that serve as terms beside whole words.
PREFIXES = (4, 5, 6, 7)


def features(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words without ASCII punctuation at their edges."""
    return [w for w in (x.strip(_EDGE) for x in (text or b"").lower().split()) if w]


@dataclass(frozen=True)
class Model:
    """terms: word or beginning -> number, the background term has the next; examples as rows of (term numbers, counts), labels; all bounded by the parameters of fit."""

    terms: dict[bytes, int]
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    rows: list[tuple[np.ndarray, np.ndarray]]
    k: int
    block: int


def _counted(text: bytes | None, terms: dict[bytes, int], starts: set[bytes]) -> tuple[list[int], list[int]]:
    words = tokens(text)
    found: Counter = Counter()
    hits = 0
    for w in words:
        if w[:4] in starts:
            own = [t for t in map(terms.get, features(w)) if t is not None]
            found.update(own)
            hits += bool(own)
    if len(words) > hits:
        found[len(terms)] = len(words) - hits
    at = sorted(found)
    return at, [found[t] for t in at]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_examples: int = 4096, max_terms: int = 4096, min_docs: int = 4, least_chi2: float = 15.0, k: int = 15, block: int = 64) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, label): rows without text, id or label take no part.

    A document labelled more than once counts as 1 if any label is 1; of rows that repeat an id each is an example.
    docs must hold the training rows only.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg((F.max(F.col(label_col).cast("int")) == 1).cast("int").alias("__y"))
    known = docs.select(F.col("doc_id").alias("__id")).distinct()
    marks = written(marks.join(known, "__id", "left_semi"), "labels")
    there = {r["__y"]: r["n"] for r in marks.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    ones = min(there.get(1, 0), max(max_examples // 2, max_examples - there.get(0, 0)))
    taken = {1: ones, 0: min(there.get(0, 0), max_examples - ones)}
    order = (F.xxhash64("__id", F.lit(17)), "__id")
    chosen = marks.where("__y = 1").orderBy(*order).limit(taken[1]).unionAll(marks.where("__y = 0").orderBy(*order).limit(taken[0]))
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("__id")).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"), "__y")
    rows = written(rows, "examples")
    seen = rows.mapInArrow(_tallied, "word binary, left binary, ones long, zeros long").groupBy("word", "left").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    tally = seen.groupBy("word").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.count_if(F.col("ones") > 0).alias("lefts"))
    sizes = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    ones, zeros = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    terms: dict[bytes, int] = {}
    if ones and zeros:
        a, b = F.col("ones"), F.col("zeros")
        chi2 = (ones + zeros) * F.pow(a * (zeros - b) - b * (ones - a), F.lit(2.0)) / (F.lit(ones * zeros) * (a + b) * (ones + zeros - a - b + 1e-9))
        spread = F.col("lefts") * 2 >= a  # in copies a word always follows the same one
        best = tally.where((a + b >= min_docs) & spread).withColumn("chi2", chi2).where(F.col("chi2") >= least_chi2).orderBy(F.desc("chi2"), "word").limit(max_terms)
        terms = {bytes(r["word"]): i for i, r in enumerate(best.select("word").collect())}
    made = rows.mapInArrow(partial(_numbered, terms=terms), "id long, y int, terms array<int>, counts array<int>").collect()
    made.sort(key=lambda r: ([len(r["terms"]) < 2, r["terms"], r["counts"]], r["id"] or 0, r["y"]))  # like beside like: tight block maxima
    rows_of = [(np.array(r["terms"], np.int64), np.array(r["counts"], float)) for r in made]
    weights = np.array([there[r["y"]] / taken[r["y"]] for r in made], float)
    return Model(terms, np.array([-1 if r["id"] is None else r["id"] for r in made], np.int64), np.array([r["y"] for r in made], float), weights, rows_of, k, block)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            words = tokens(text)
            first = dict(zip(reversed(words), reversed([b"", *words[:-1]])))  # the left neighbour of the first occurrence
            seen = {(f, x) for w, x in first.items() if _LETTER.search(w) for f in features(w)}
            sums[y == 1].update(dict(sorted(seen)).items())
        both = sorted({*sums[0], *sums[1]})
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in both], pa.binary()), pa.array([x for _, x in both], pa.binary()), *(pa.array([sums[y][w] for w in both], pa.int64()) for y in (1, 0))],
            names=["word", "left", "ones", "zeros"],
        )


def _numbered(batches: Iterator[pa.RecordBatch], terms: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """The other columns, and the numbers and counts of the terms in the text (the second column)."""
    starts = {t[:4] for t in terms}
    for b in batches:
        found = [_counted(t, terms, starts) for t in b.column(1).to_pylist()]
        rest = [b.column(0), *(b.column(i) for i in range(2, b.num_columns))]
        names = [b.schema.names[0], *b.schema.names[2:]]
        yield pa.RecordBatch.from_arrays([*rest, pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.int32()))], names=[*names, "terms", "counts"])


class Index:
    """Block-max inverted index over the examples' unit TF-IDF vectors."""

    def __init__(self, model: Model, idf: np.ndarray):
        self.model, self.idf, self.block = model, idf, model.block
        self.silent = np.array([not len(t) for t, _ in model.rows], bool)
        n = -(-len(model.rows) // self.block)
        #: Each block's terms and their postings (terms x examples), and each term's largest weight in each block.
        self.postings: list[tuple[np.ndarray, np.ndarray]] = []
        self.most = np.zeros((len(idf), n))
        for i in range(n):
            part = model.rows[i * self.block : (i + 1) * self.block]
            unit = self.units([t for t, _ in part], [c for _, c in part])
            own = np.flatnonzero(unit.any(axis=0))
            self.postings.append((own, np.ascontiguousarray(unit[:, own].T)))
            self.most[own, i] = self.postings[i][1].max(axis=1, initial=0)

    def units(self, terms: list, counts: list) -> np.ndarray:
        """Unit vectors, a row for each text; zero for a text without words."""
        out = np.zeros((len(terms), len(self.idf)))
        row = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        if len(row):
            at = np.concatenate([np.asarray(t, np.int64) for t in terms])
            tf = np.concatenate([np.asarray(c, float) for c in counts])
            out[row, at] = (1 + np.log(np.maximum(tf, 1.0))) * self.idf[at]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)

    def nearest(self, q: np.ndarray, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, cosines) of the k examples nearest to each row of q, ties to the earlier; but: an example to leave out of each.

        Padded with number -1 and cosine 0. A block is read for the queries alone whose bound reaches their kth cosine.
        """
        k, n = self.model.k, len(q)
        best, who = np.zeros((n, k)), np.full((n, k), -1, np.int64)
        bound = q @ self.most + 1e-9
        first = bound.argmax(axis=1) if self.postings else np.zeros(n, np.int64)

        def read(b: int, rows: np.ndarray) -> None:
            own, weights = self.postings[b]
            sims = np.round(q[np.ix_(rows, own)] @ weights, 9)
            numbers = np.arange(b * self.block, b * self.block + sims.shape[1])
            if but is not None:
                sims[numbers[None, :] == but[rows, None]] = 0
            both = np.concatenate((best[rows], sims), axis=1)
            ids = np.concatenate((who[rows], np.broadcast_to(numbers, sims.shape)), axis=1)
            ids = np.where(both > 0, ids, -1)
            order = np.lexsort((np.where(ids < 0, 1 << 60, ids), -both), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)

        for b in range(len(self.postings)):
            if (rows := np.flatnonzero((first == b) & (bound[:, b] > 1e-9))).size:
                read(b, rows)
        for b in np.argsort(-bound.mean(axis=0)).tolist() if n else []:
            if (rows := np.flatnonzero((first != b) & (bound[:, b] > 1e-9) & (bound[:, b] >= best[:, -1]))).size:
                read(b, rows)
        return who, best

    def votes(self, who: np.ndarray, best: np.ndarray, base: float) -> np.ndarray:
        """Similarity-weighted shares of label 1, drawn to the base rate with half a vote."""
        y, w = np.append(self.model.labels, 0.0)[who], np.append(self.model.weights, 0.0)[who] * best
        return ((w * y).sum(1) + 0.5 * base) / (w.sum(1) + 0.5)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps fitted to y over x, by weights w, by pooling neighbours that fall: (x, value) knots."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        if pools and pools[-1][3] == a:
            pools[-1] = [pools[-1][0] + b * c, pools[-1][1] + c, pools[-1][2], a]
        else:
            pools.append([b * c, c, a, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    knots = [(e, p[0] / p[1]) for p in pools for e in (p[2], p[3])]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


class Scorer:
    """Index, calibration and the score of texts without any word."""

    def __init__(self, model: Model, n_docs: int, df: dict[int, int]):
        idf = np.array([math.log((1 + n_docs) / (1 + df.get(i, 0))) + 1 for i in range(len(model.terms) + 1)])
        self.index = Index(model, idf)
        y, w, silent = model.labels, model.weights, self.index.silent
        self.base = (float((w * y).sum()) + 0.5) / (float(w.sum()) + 1)
        self.none = (float((w * y)[silent].sum()) + 0.5 * self.base) / (float(w[silent].sum()) + 0.5)
        loud = np.flatnonzero(~silent)
        self.knots = (np.array([0.0, 1.0]), np.array([self.base, self.base]))
        if len(loud):
            votes = [self.votes([model.rows[i] for i in part], part)[0] for part in np.array_split(loud, -(-len(loud) // 512))]
            self.knots = isotonic(np.concatenate(votes), y[loud], w[loud])

    def votes(self, rows: list, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, best = self.index.nearest(self.index.units([t for t, _ in rows], [c for _, c in rows]), but)
        return self.index.votes(who, best, self.base), who, best

    def scores(self, rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        votes, who, best = self.votes(rows)
        return np.where(who[:, 0] < 0, self.none, np.interp(votes, *self.knots)) if len(rows) else votes, who, best


def _judged(scorer: Scorer, terms: list, counts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, neighbours' numbers, cosines) of each row; rows that make the same vector are looked up once."""
    slot: dict[tuple, int] = {}
    firsts: list[int] = []
    at = np.empty(len(terms), np.int64)
    for i, (t, c) in enumerate(zip(terms, counts)):
        key = (tuple(t), tuple(c) if len(t) > 1 else ())
        if key not in slot:
            slot[key] = len(firsts)
            firsts.append(i)
        at[i] = slot[key]
    parts = [scorer.scores([(terms[i], counts[i]) for i in firsts[k : k + 512]]) for k in range(0, len(firsts), 512)]
    return tuple(np.concatenate(x)[at] for x in zip(*parts)) if parts else scorer.scores([])


def _scored(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    model = scorer.index.model
    ids, labels = np.append(model.ids, 0), np.append(model.labels, 0).astype(np.int32)
    for b in batches:
        score, who, best = _judged(scorer, b.column(1).to_pylist(), b.column(2).to_pylist())
        real = who >= 0
        flat = pa.StructArray.from_arrays([pa.array(ids[who[real]]), pa.array(best[real]), pa.array(labels[who[real]])], names=["example", "similarity", "label"])
        ends = np.concatenate(([0], np.cumsum(real.sum(axis=1)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "score", "evidence"])


def _tallies(batches: Iterator[pa.RecordBatch], terms: int, parts: int) -> Iterator[pa.RecordBatch]:
    """One row for each task: in how many of its texts each term is."""
    n = np.zeros(terms, np.int64)
    for b in batches:
        n += np.bincount(pc.list_flatten(b.column(0)).to_numpy(), minlength=terms)
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % parts], pa.int32()), pa.array([n.tobytes()], pa.binary())], names=["part", "n"])


def _added(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    n = np.zeros(terms, np.int64)
    for b in batches:
        for one in b.column(1):
            n += np.frombuffer(one.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], names=["n"])


#: Tasks that add up the others' document frequencies.
ADDERS = 16


def _frequencies(docs: DataFrame, model: Model, id_col: str, text_col: str) -> tuple[DataFrame, Scorer]:
    """The terms and counts of each text, and the scorer with the document frequencies over all of them."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = written(rows.mapInArrow(partial(_numbered, terms=model.terms), "id long, terms array<int>, counts array<int>"), "term-counts")
    size = len(model.terms) + 1  # max_terms and the background
    each = rows.select("terms").mapInArrow(partial(_tallies, terms=size, parts=ADDERS), "part int, n binary").repartition(ADDERS, "part")
    sums = each.mapInArrow(partial(_added, terms=size), "n binary").collect()  # ADDERS rows
    df = sum((np.frombuffer(bytes(r["n"]), np.int64) for r in sums), np.zeros(size, np.int64))
    return rows, Scorer(model, rows.count(), dict(enumerate(df.tolist())))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence) for each row of docs: score from 0 to 1; evidence: up to k (example, similarity, label).

    Null and empty texts get the share of label 1 among such examples.
    Equal texts get equal scores; repeated rows stay; ties between neighbours go to the earlier in the index. Very long
    texts are read whole. An empty table gives an empty result, a model without labels the base rate. Other columns of
    docs, whatever their names, are ignored.
    """
    rows, scorer = _frequencies(docs, model, id_col, text_col)
    return rows.mapInArrow(partial(_scored, scorer=scorer), "id long, score double, evidence array<struct<example:long,similarity:double,label:int>>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score ``threshold`` or more, with all columns.

    Each row is judged by its own text in one pass, whatever its id: a null or repeated id changes nothing. Null and
    empty texts, ties, long texts and an empty table are as in ``scores``.
    """
    _, scorer = _frequencies(docs, model, id_col, text_col)
    terms, starts = model.terms, {t[:4] for t in model.terms}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        found = [_counted(t, terms, starts) for t in texts]
        return pd.Series(_judged(scorer, [t for t, _ in found], [c for _, c in found])[0])

    return docs.where(score(F.col(text_col).cast("binary")) < threshold)
