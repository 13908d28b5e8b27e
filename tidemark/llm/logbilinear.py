"""Log-bilinear language model, trained in numpy by noise-contrastive estimation.

Outputs are the ``shortlist`` most frequent tokens and classes of all other tokens by their last three bytes: a class
of its own for each of the ``endings`` endings that hold most tokens, and ``rest`` hashed classes for other endings. A
class gives its tokens their training shares. Unseen tokens are one further type that takes the share of tokens seen
once (Good-Turing). So the probabilities of all known tokens and the unseen type sum to one after every context. The
context is the two outputs before a token; its predicted vector is the sum of their vectors, each times its place's
weights, and a token's score is its inner product with the token's vector plus a bias.

Counts cover all training texts. Training takes two rounds, over one text in eight (by hash) and over all: each task
starts from the same parameters and trains on what it reads, and the results are averaged by tokens, so that scores
depend on how the input is dealt into tasks. The scoring pass normalises exactly: batched matrix products give each
distinct context's log partition.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The token that ends a text; no word holds a space.
END = b" "
#: Bytes of texts that are taken apart at once (one text at least), and distinct words after which a task's counts are flushed.
SLICE, FLUSH = 4_000_000, 300_000


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased (A-Z) words of all texts, and where each text's begin; one more place ends the last."""
    lower = pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string()))
    parts = pc.ascii_split_whitespace(lower)  # \x20 and \x09-\x0D
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    seen = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return flat.filter(full).view(pa.binary()), seen[parts.offsets.to_numpy()]


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(numbers, types, ends): tokens of all texts as numbers of types, an end after each text; ends: one past each text's end."""
    flat, starts = words(texts)
    coded = flat.dictionary_encode()
    numbers = np.insert(coded.indices.to_numpy().astype(np.int64), starts[1:], len(coded.dictionary))
    return numbers, pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())]), starts[1:] + np.arange(1, len(starts))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows; the text is the last column."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy()) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows] if b.num_rows else []
        for first, last in zip(cuts, cuts[1:]):
            yield b.slice(first, last - first)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    kept, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        whole = pa.concat_tables(kept).group_by("word").aggregate([("n", "sum")])
        yield from whole.rename_columns({"n_sum": "n"}).select(["word", "n"]).cast(kind).to_batches(max_chunksize=50_000)

    for b in _slices(batches):
        found = pc.value_counts(words(b.column(0))[0])
        values = pa.concat_arrays([found.field("values"), pa.array([END], pa.binary())])
        kept.append(pa.table([values, pa.concat_arrays([found.field("counts"), pa.array([b.num_rows])])], schema=kind))
        size += len(values)
        if size > FLUSH:
            yield from flush()
            kept, size = [], 0
    if kept:
        yield from flush()


@dataclass
class Vocabulary:
    """Bounded by its parameters: the most frequent words and their counts, the first ``short`` of which are outputs; the classes' endings and masses."""

    head: pa.Array
    counts: np.ndarray
    short: int
    endings: pa.Array
    rest: int
    mass: np.ndarray
    tokens: int
    types: int
    once: int

    @property
    def end(self) -> int:
        return self.head.slice(0, self.short).index(END).as_py()

    def outputs(self, types: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(output, place in the head or -1) of each type."""
        at = pc.fill_null(pc.index_in(types, value_set=self.head), -1).to_numpy().astype(np.int64)
        tail = pc.binary_slice(types, -3, None).dictionary_encode()
        own = pc.fill_null(pc.index_in(tail.dictionary, value_set=self.endings), -1).to_numpy()
        hashed = np.array([len(self.endings) + zlib.crc32(x) % self.rest for x in tail.dictionary.to_pylist()], np.int64)
        classes = np.where(own >= 0, own, hashed)[tail.indices.to_numpy()]
        return np.where((at >= 0) & (at < self.short), at, self.short + classes), at


def vocabulary(counts: DataFrame, shortlist: int, endings: int, rest: int, head: int) -> Vocabulary:
    """From counts(word, n) over all training texts. The driver holds ``head`` words at most."""
    step = F.floor(F.log2(F.col("n")) * 32)
    levels = counts.groupBy(step.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).orderBy(F.desc("level")).collect()
    total, types, once = (sum(r[c] for r in levels) for c in ("n", "words", "once"))
    fit, held = 1 << 62, 0  # the least level down to which all words find room
    for r in levels:
        held += r["words"]
        if held > head:
            break
        fit = r["level"]
    top = sorted(((bytes(r["word"]), r["n"]) for r in counts.where((step >= fit) & (F.col("word") != END)).collect()), key=lambda x: (-x[1], x[0]))
    ends = [r["n"] for r in counts.where(F.col("word") == END).collect()]
    top.insert(min(len(top), shortlist - 1), (END, ends[0] if ends else 0))  # the end is an output, however rare
    top[:shortlist] = sorted(top[:shortlist], key=lambda x: (-x[1], x[0]))
    tail = counts.select("n", "word", F.when(F.length("word") > 3, F.substring("word", -3, 3)).otherwise(F.col("word")).alias("ending"))
    out = [w for w, _ in top[:shortlist]]
    tail = tail.where(~F.col("word").isin(out)).groupBy("ending").agg(F.sum(F.col("n") + 0.5).alias("m"))
    best = [bytes(r["ending"]) for r in tail.orderBy(F.desc("m"), "ending").limit(endings).collect()]
    classes = counts.sparkSession.createDataFrame([(e, i) for i, e in enumerate(best)], "e binary, c int")  # ``endings`` rows at most
    named = tail.join(F.broadcast(classes), F.col("ending") == F.col("e"), "left").groupBy(F.coalesce("c", (F.crc32("ending") % rest + len(best)).cast("int")).alias("c")).agg(F.sum("m").alias("m"))
    mass = np.full(len(best) + rest, 0.5)
    for r in named.collect():
        mass[r["c"]] = r["m"]
    return Vocabulary(pa.array([w for w, _ in top], pa.binary()), np.array([n for _, n in top], float), min(shortlist, len(top)), pa.array(best, pa.binary()), rest, mass, total, types, once)


@dataclass
class Parameters:
    """Vectors of context outputs and of targets, weights of the two places, biases; squares: Adagrad's sums for each."""

    context: np.ndarray
    target: np.ndarray
    place: np.ndarray
    bias: np.ndarray
    squares: list[np.ndarray]

    @classmethod
    def first(cls, noise: np.ndarray, dim: int, seed: int) -> Parameters:
        r = np.random.default_rng(seed)
        n = len(noise)
        parts = (r.standard_normal((n, dim)) * 0.1).astype("f4"), (r.standard_normal((n, dim)) * 0.1).astype("f4"), np.ones((2, dim), "f4"), np.log(noise).astype("f4")
        return cls(*parts, [np.zeros_like(x) for x in parts])

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.place, self.bias, *self.squares]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Parameters:
        return cls(*(x.astype("f4") for x in parts[:4]), [x.astype("f4") for x in parts[4:]])


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by number: sorted, then in runs."""
    order = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")  # 16 bits sort by radix
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out = np.zeros((n, rows.shape[1]), "f4")
    out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def train(p: Parameters, ids: np.ndarray, noise: np.ndarray, rng: np.random.Generator, rate: float, drawn: int = 64, batch: int = 2048) -> None:
    """One NCE pass over rows of two context outputs and a target, in place, by Adagrad.

    Each batch shares ``drawn`` noise outputs.
    """
    log_noise = np.log(noise * drawn).astype("f4")
    cdf, n, one = np.cumsum(noise), len(noise), np.float32(1)
    ids = ids[rng.permutation(len(ids))]
    for k in range(0, len(ids), batch):
        c2, c1, w = ids[k : k + batch].T
        v2, v1 = p.context[c2], p.context[c1]
        r = v2 * p.place[0] + v1 * p.place[1]
        s = np.minimum(np.searchsorted(cdf, rng.random(drawn)), n - 1)
        own, other = p.target[w], p.target[s]
        with np.errstate(over="ignore"):  # e to a great power is infinite, its reciprocal zero
            g = one - one / (one + np.exp(log_noise[w] - p.bias[w] - np.einsum("ij,ij->i", r, own)))
            h = r @ -other.T
            h += log_noise[s] - p.bias[s]
            np.exp(h, out=h)
        h += one
        np.reciprocal(h, out=h)
        back = g[:, None] * own
        back -= h @ other
        target = _summed(w, g[:, None] * r, n)
        np.add.at(target, s, -(h.T @ r))
        bias = np.bincount(w, g, n).astype("f4")
        np.add.at(bias, s, -h.sum(0))
        context = _summed(np.concatenate((c2, c1)), np.concatenate((back * p.place[0], back * p.place[1])), n)
        place = np.stack((np.einsum("ij,ij->j", back, v2), np.einsum("ij,ij->j", back, v1)))
        for x, q, d in zip(p.parts(), p.squares, (context, target, place, bias)):
            q += d * d
            x += np.float32(rate) * d / np.sqrt(q + np.float32(1e-6))


def _rows(outputs: np.ndarray, ends: np.ndarray, end: int) -> np.ndarray:
    """Two context outputs and the target of each token; before a text stand two ends."""
    c1 = np.concatenate(([end], outputs[:-1]))
    c2 = np.concatenate(([end], c1[:-1]))
    c2[ends[:-1]] = end  # the first token of each later text; its c1 is the end of the text before
    return np.stack((c2, c1, outputs), axis=1).astype(np.int32)


def _noise(v: Vocabulary) -> np.ndarray:
    n = np.concatenate((np.maximum(v.counts[: v.short], 0.5), v.mass))
    return n / n.sum()


def _trained(batches: Iterator[pa.RecordBatch], v: Vocabulary, start: list[np.ndarray], seed: int, rate: float) -> Iterator[pa.RecordBatch]:
    """What one task makes of the parameters: (weight, parts) if it read any text."""
    p, noise, end, seen = Parameters.of(start), _noise(v), v.end, 0
    rng = np.random.default_rng(seed)
    for b in _slices(batches):
        numbers, types, ends = tokens(b.column(0))
        seen += len(numbers)
        train(p, _rows(v.outputs(types)[0][numbers], ends, end), noise, rng, rate)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([pickle.dumps(p.parts())], pa.binary())], names=["weight", "parts"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight, sums = 0.0, None
    for b in batches:
        for w, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parts = [x.astype(float) * w for x in pickle.loads(raw)]
            weight, sums = weight + w, parts if sums is None else [a + c for a, c in zip(sums, parts)]
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([pickle.dumps([(x / weight).astype("f4") for x in sums])], pa.binary())], names=["weight", "parts"])


def fit(texts: DataFrame, v: Vocabulary, dim: int = 16, first: int = 8, seed: int = 42, rate: float = 0.1) -> Parameters:
    """Parameters from texts(text): a round over one text in ``first`` by hash, then one over all."""
    parts = Parameters.first(_noise(v), dim, seed).parts()
    for some in (texts.where(F.pmod(F.xxhash64("text"), F.lit(first)) == 0), texts):
        each = some.mapInArrow(partial(_trained, v=v, start=parts, seed=seed, rate=rate), "weight double, parts binary")
        # averages of averages, so that no task and not the driver holds all tasks' parameters
        mixed = written(each, "trained").repartition(16).mapInArrow(_averaged, "weight double, parts binary")
        got = [(r["weight"], pickle.loads(r["parts"])) for r in mixed.collect()]
        total = sum(w for w, _ in got)
        if got:
            parts = [sum(w / total * x[i] for w, x in got) for i in range(len(parts))]
    return Parameters.of(parts)


class Normaliser:
    """Natural-log probabilities of outputs after contexts; each distinct context is normalised once."""

    def __init__(self, p: Parameters):
        self.p = p
        n = len(p.bias)
        self.known = np.full(n * n, np.nan, "f4")
        self.parts = (p.context * p.place[0], p.context * p.place[1])

    def log_prob(self, rows: np.ndarray) -> np.ndarray:
        n, p = len(self.p.bias), self.p
        at = rows[:, 0].astype(np.int64) * n + rows[:, 1]
        fresh = np.unique(at[np.isnan(self.known[at])])
        for k in range(0, len(fresh), 128):  # so that a block stays in the processor's cache
            c = fresh[k : k + 128]
            z = (self.parts[0][c // n] + self.parts[1][c % n]) @ p.target.T
            z += p.bias
            top = z.max(1, keepdims=True)
            z -= top
            np.exp(z, out=z)
            self.known[c] = top[:, 0] + np.log(z.sum(1))
        out = p.bias[rows[:, 2]] - self.known[at].astype(float)
        for k in range(0, len(rows), 1 << 16):
            c2, c1, w = rows[k : k + (1 << 16)].T
            out[k : k + (1 << 16)] += np.einsum("ij,ij->i", self.parts[0][c2] + self.parts[1][c1], p.target[w])
        return out


def _scored(batches: Iterator[pa.RecordBatch], v: Vocabulary, p: Parameters) -> Iterator[pa.RecordBatch]:
    """A row for each text (word: a space and the row's number) and one for each of its words outside the head.

    n: occurrences; known, base and score: what is certain of the text; of a word the score if it is known, without
    its count's logarithm.
    """
    norm, end = Normaliser(p), v.end
    seen = np.log10(max(1e-12, 1 - v.once / max(1, v.tokens))) if v.once < v.tokens else -0.30103
    tail = seen - np.log10(v.mass)
    bottom = np.log10(v.tokens + 0.5 * (v.types + 1))
    logs = np.append(np.log10(v.counts + 0.5), np.nan)
    names = ["id", "row", "word", "n", "n_tokens", "n_known", "base", "score"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    for b in _slices(batches):
        numbers, types, ends = tokens(b.column(2))
        out, at = v.outputs(types)
        out, log = out[numbers], logs[at[numbers]]
        value = norm.log_prob(_rows(out, ends, end)) / np.log(10.0)
        value += np.where(out < v.short, seen, tail[np.maximum(out - v.short, 0)])
        sure = ~np.isnan(log)
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        known = np.bincount(text, sure, len(ends))
        base = np.bincount(text, np.where(sure, log, 0), len(ends)) - known * bottom
        score = np.bincount(text, np.where(sure, value + np.where(out < v.short, 0, log), 0), len(ends))
        keys = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip((b.column(0), b.column(1), [b" %d" % k for k in keys], np.zeros(len(ends), np.int64), np.diff(ends, prepend=0), known.astype(np.int64), base, score), kinds)], names=names
        )
        pair, back = np.unique(text[~sure] * len(types) + numbers[~sure], return_inverse=True)
        at, zero = pair // len(types), np.zeros(len(pair), np.int64)
        n, sums = np.bincount(back, minlength=len(pair)), np.bincount(back, value[~sure], len(pair))
        for k in range(0, len(pair), 50_000):
            cut = slice(k, k + 50_000)
            own = pa.array(at[cut])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(own), b.column(1).take(own), types.take(pa.array(pair[cut] % len(types))), *(pa.array(x, t) for x, t in zip((n[cut], zero[cut], zero[cut], zero[cut].astype(float), sums[cut]), kinds[3:]))], names=names
            )


def scores(docs: DataFrame, training: Column, shortlist: int = 1000, endings: int = 256, rest: int = 64, head: int = 200_000, dim: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; log10 probabilities of the text.

    training: which rows to learn from. Null and empty texts hold the end alone. Repeated rows are learnt from and
    scored each; a null id is a value like any other. If nothing is there to learn from, every token is unseen. Words
    outside the head (the most frequent, ``head`` at most) meet their counts by a join; very long texts are read
    whole. Equally frequent words go into the shortlist by their bytes. An empty table gives an empty result; other
    columns of docs, whatever their names, are ignored.
    """
    texts = docs.where(training).select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counts = written(texts.mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    v = vocabulary(counts, shortlist, endings, rest, head)
    p = fit(texts, v, dim)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = "id long, row long, word binary, n long, n_tokens long, n_known long, base double, score double"
    made = rows.mapInArrow(partial(_scored, v=v, p=p), kind)
    joined = made.join(counts.select(F.col("word").alias("w"), F.col("n").alias("c")), F.col("word") == F.col("w"), "left")
    bottom = float(np.log10(v.tokens + 0.5 * (v.types + 1)))
    fresh = float(np.log10(max(v.once, 0.5) / max(v.tokens, 1))) if v.once < v.tokens else -0.30103
    known = F.col("c").isNotNull()
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    return joined.groupBy("id", "row").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(known, F.col("n")).otherwise(0)).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        F.sum(F.col("base") + F.col("n") * (log - bottom)).alias("base_score"),
        F.sum(F.when(F.col("n") == 0, F.col("score")).when(known, F.col("score") + F.col("n") * log).otherwise(F.col("n") * fresh)).alias("score"),
    ).drop("row")
