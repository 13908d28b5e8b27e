"""Phrase collocations over vertical positional inverted lists.

Texts are cut into blocks of bounded size; a block gives each of its words a list of positions, ascending, and leaves a
gap wherever a piece ends. A phrase's list holds where it begins. Phrases of k words are extended by merging the places
where they would go on (start + k) with the lists of the adjacent words; what meets is the list of the longer phrase in
that block, and the sum of the lists' lengths over all blocks is its exact frequency. Only phrases that are frequent
over all blocks are extended: between two levels a block sends the lengths of its lists and learns which of them
stay: from a copy of all frequent phrases where these take SENT bytes at most, else by a join, so that no task and no
driver need hold the phrases of all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

#: Words of a block; a piece is never cut, so a block may hold one piece more.
BLOCK = 1_000_000
#: Different words that are counted together.
COUNTS = 65_536
#: Bytes of text that are taken apart at once.
SLICE = 500_000
#: Classes of bytes: 0 of a word, 1 blank, 2 end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: A row for each list of a block's words, and one for the block with packed numbers: its lists, one after the other,
#: and their lengths.
WORDS = "block long, lang string, word binary, local int, n long, starts binary, sizes binary"
#: Frequencies of words in some of the texts.
COUNTED = "lang string, word binary, n long"
#: A block at a level: positions of the adjacent words, these words and their ids; the phrases' beginnings, the phrases
#: and their ids (null at level 1, where they are the words').
LEVEL = "block long, at binary, of binary, ids binary, starts binary, phrase binary, phrases binary"
#: Lengths of a block's lists of longer phrases.
GROWN = "block long, local int, prefix long, last long, n long"
#: How levels are written: a row group for every few blocks, which take megabytes each, so that a task holds no more,
#: writing and reading, however many blocks its input makes.
ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, KINDS[t]) for n, t in (f.split() for f in ddl.split(", "))])


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as differences, their bytes by place, compressed."""
    raw = np.diff(x.astype(np.int64), prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    raw = pa.decompress(b[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the words, one after the other; the piece of each, counted through; the text of each)."""
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    kind = KIND[data]
    inside = kind == 0
    first = inside & ~np.concatenate(([False], inside[:-1]))
    begin = np.flatnonzero(first)
    piece = np.cumsum(np.diff(np.cumsum(kind == 2, dtype=np.int32)[begin], prepend=0) > 0)  # numbers without a gap
    letters = data[inside]
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[begin] - 1, len(letters)).astype(np.int32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    found = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())])
    return found, piece, np.searchsorted(ends, begin, side="right")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[str, bytes]], np.ndarray, np.ndarray]]:
    """Slices of (lang, text): (lang, word) of each word, the word at each place and its piece."""
    for b in batches:
        langs, texts = b.column(0), b.column(1)
        cut = np.cumsum(np.append(0, pc.binary_length(texts).fill_null(0).to_numpy()), dtype=np.int64)[:-1] // SLICE
        for s in np.unique(cut):
            some = np.flatnonzero(cut == s).tolist()
            found, piece, text = words([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in (texts[i] for i in some)])
            if not len(found):
                continue
            coded = found.dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            tongue, lang = np.unique([langs[i].as_py() for i in some], return_inverse=True)
            both, own = np.unique(codes.astype(np.int64) * len(tongue) + lang[text], return_inverse=True)
            yield [(str(tongue[x % len(tongue)]), names[x // len(tongue)]) for x in both.tolist()], own, piece


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[int, list[tuple[str, bytes]], np.ndarray, np.ndarray]]:
    """Blocks of (lang, text): number, (lang, word) of each word, all positions ascending and the word at each."""
    held: dict[tuple[str, bytes], int] = {}
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = gap = made = 0

    def flush() -> tuple:
        nonlocal held, parts, size, gap, made
        done = (TaskContext.get().partitionId() << 32) + made, list(held), *(np.concatenate(x) for x in zip(*parts))
        held, parts, size, gap, made = {}, [], 0, 0, made + 1
        return done

    for keys, own, piece in _slices(batches):
        ends = np.flatnonzero(np.diff(piece, append=piece[-1] + 1)) + 1  # where pieces end
        done = 0
        while done < len(own):
            upto = int(ends[min(np.searchsorted(ends, done + max(1, block - size)), len(ends) - 1)])
            used = np.unique(own[done:upto])
            named = np.zeros(len(keys), np.int64)
            named[used] = [held.setdefault(keys[i], len(held)) for i in used.tolist()]
            at = np.arange(done, upto) + piece[done:upto] - done - piece[done] + size + gap
            parts.append((at.astype(np.int32), named[own[done:upto]].astype(np.int32)))
            gap += int(piece[upto - 1] - piece[done]) + 1
            size += upto - done
            done = upto
            if size >= block:
                yield flush()
    if parts:
        yield flush()


def _counted(batches: Iterator[pa.RecordBatch], block: int = COUNTS) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), of some texts each, and given as soon as they name ``block`` words."""
    held: dict[tuple[str, bytes], int] = {}

    def told() -> Iterator[pa.RecordBatch]:
        keys = list(held)
        yield from _rows({"lang": [k for k, _ in keys], "word": [w for _, w in keys], "n": list(held.values())}, COUNTED)

    for keys, own, _ in _slices(batches):
        for k, n in zip(keys, np.bincount(own, minlength=len(keys)).tolist()):
            held[k] = held.get(k, 0) + n
        if len(held) >= block:
            yield from told()
            held.clear()
    if held:
        yield from told()


def _lists(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """A row for each of a block's words with its frequency, and one with the lists."""
    for name, keys, at, of in _blocks(batches, block):
        order, n = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(keys))  # the lists, each ascending
        yield from _rows({"block": np.full(len(keys), name), "lang": [k for k, _ in keys], "word": [w for _, w in keys], "local": np.arange(len(keys), dtype=np.int32), "n": n})
        yield from _rows({"block": [name], "starts": [pack(at[order])], "sizes": [pack(n)]})


def _sent_lists(batches: Iterator[pa.RecordBatch], known, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Level 1 of each block, by the ids of the frequent words."""
    frequent = known.value
    for name, keys, at, of in _blocks(batches, block):
        own = np.full(len(keys), -1)
        tongues = np.array([k for k, _ in keys], object)
        for lang, (spelt, ids) in frequent.items():
            here = np.flatnonzero(tongues == lang)
            found = pc.index_in(pa.array([keys[i][1] for i in here.tolist()], pa.binary()), spelt).fill_null(-1).to_numpy()
            own[here] = np.where(found >= 0, ids[found], -1)
        stays = np.where(own >= 0, np.cumsum(own >= 0) - 1, -1)
        word, own = stays[of], own[own >= 0]
        at, word = at[word >= 0], word[word >= 0]
        yield from Level(name, at, word, own).row()


def _rows(cols: dict, ddl: str = WORDS) -> Iterator[pa.RecordBatch]:
    n, kind = len(next(iter(cols.values()))), _schema(ddl)
    for i in range(0, n, 100_000):
        some = [pa.array(cols[f.name][i : i + 100_000], f.type) if f.name in cols else pa.nulls(min(n - i, 100_000), f.type) for f in kind]
        yield pa.RecordBatch.from_arrays(some, schema=kind)


class Level:
    """A block's lists at a level: at ascends and tells with of where which adjacent word stands, starts ascends and
    tells with phrase where which phrase begins; both name ids by their places. At level 1 the words are the phrases,
    and their lists are kept once."""

    def __init__(self, block: int, *parts: np.ndarray):
        self.block, self.parts = block, parts
        self.at, self.of, self.ids, self.starts, self.phrase, self.phrases = parts if len(parts) == 6 else parts * 2

    @classmethod
    def each(cls, rows: pa.RecordBatch | pa.Table) -> Iterator[Level]:
        names = [f.name for f in _schema(LEVEL) if f.name != "block"]
        for i in range(rows.num_rows):  # one block's lists at a time
            packed = (rows.column(n)[i].as_py() for n in names)
            yield cls(rows.column("block")[i].as_py(), *(unpack(x) for x in packed if x is not None))

    def row(self) -> Iterator[pa.RecordBatch]:
        yield from _rows({"block": [self.block]} | {f.name: [pack(x)] for f, x in zip(list(_schema(LEVEL))[1:], self.parts)}, LEVEL)

    def extend(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lists of k + 1 words: (prefix, last) ids and length of each; where they begin, which list begins there.

        Positions of phrases and of adjacent words both ascend, so the search is a merge of the lists.
        """
        meet = np.searchsorted(self.at, self.starts + k)
        hit = meet < len(self.at)
        hit[hit] = self.at[meet[hit]] == self.starts[hit] + k
        both, lists, n = np.unique(self.phrase[hit] * len(self.ids) + self.of[meet[hit]], return_inverse=True, return_counts=True)
        width = max(1, len(self.ids))
        return self.phrases[both // width], self.ids[both % width], n, self.starts[hit], lists

    def kept(self, k: int, local: np.ndarray, ids: np.ndarray, starts: np.ndarray, lists: np.ndarray) -> Level:
        """The next level of lists ``local``, now called ``ids``; other words' positions can end no longer phrase."""
        stays = np.full(int(lists.max(initial=-1)) + 1, -1)
        stays[local] = np.arange(len(local))
        phrase = stays[lists]
        starts, phrase = starts[phrase >= 0], phrase[phrase >= 0]
        used = np.isin(self.at, starts + k, assume_unique=True)
        names, of = np.unique(self.of[used], return_inverse=True)
        return Level(self.block, self.at[used], of, self.ids[names], starts, phrase, ids)


def _first(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Level 1 of a block: left holds its words' lists, right the (local, id) of those that stay."""
    if not left.num_rows or not right.num_rows:
        return _schema(LEVEL).empty_table()
    local, ids = (right.column(c).to_numpy() for c in ("local", "id"))
    starts, sizes = (unpack(left.column(c)[0].as_py()) for c in ("starts", "sizes"))
    stays = np.full(len(sizes), -1)
    stays[local] = np.arange(len(local))
    phrase = np.repeat(stays, sizes)
    starts, phrase = starts[phrase >= 0], phrase[phrase >= 0]
    go = np.argsort(starts)
    starts, phrase = starts[go], phrase[go]
    return pa.Table.from_batches(list(Level(left.column("block")[0].as_py(), starts, phrase, ids).row()))


def _grown(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for level in Level.each(b):
            prefix, last, n, *_ = level.extend(k)
            yield from _rows({"block": np.full(len(n), level.block), "local": np.arange(len(n), dtype=np.int32), "prefix": prefix, "last": last, "n": n}, GROWN)


def _sent(batches: Iterator[pa.RecordBatch], k: int, known) -> Iterator[pa.RecordBatch]:
    """The next level, by the frequent phrases: what prefixes and last words they have, their pairs of places, their ids."""
    prefixes, lasts, pairs, ids = known.value
    for b in batches:
        for level in Level.each(b):
            prefix, last, _, starts, lists = level.extend(k)
            p, x = (np.minimum(np.searchsorted(a, b), len(a) - 1) for a, b in ((prefixes, prefix), (lasts, last)))
            own = p * len(lasts) + x
            at = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
            local = np.flatnonzero((pairs[at] == own) & (prefixes[p] == prefix) & (lasts[x] == last))
            yield from level.kept(k, local, ids[at[local]], starts, lists).row()


def _joined(key: tuple, left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The next level of a block, where the frequent phrases are too many to send to every task."""
    if not left.num_rows or not right.num_rows:
        return _schema(LEVEL).empty_table()
    level = next(Level.each(left))
    *_, starts, lists = level.extend(k)
    return pa.Table.from_batches(list(level.kept(k, right.column("local").to_numpy(), right.column("id").to_numpy(), starts, lists).row()))


#: Bytes of frequent phrases up to which they go to every task; more of them are joined by shuffle.
SENT = 32_000_000


def _frequent(rows: DataFrame, keys: list[str], least: int, what: str) -> DataFrame:
    known = rows.groupBy(*keys).agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return written(known.withColumn("id", F.monotonically_increasing_id()), what)


def _back(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Which lists of which block stay, by their ids."""
    return rows.select(F.col("block").alias("to"), "local", *keys).join(known.drop("a"), keys).select("to", "local", "id")


def _next(level: DataFrame, known: DataFrame, k: int) -> DataFrame:
    spark, n = level.sparkSession, known.count()
    if 24 * n > SENT:
        back = _back(level.mapInArrow(partial(_grown, k=k), GROWN), known, ["prefix", "last"])
        return level.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(partial(_joined, k=k), LEVEL)
    if not n:
        return level.limit(0)
    table = known.select("prefix", "last", "id").toPandas()  # SENT bytes at most
    prefixes, p = np.unique(table["prefix"].to_numpy(np.int64), return_inverse=True)
    lasts, x = np.unique(table["last"].to_numpy(np.int64), return_inverse=True)
    pairs = p * len(lasts) + x
    by = np.argsort(pairs)
    sent = spark.sparkContext.broadcast((prefixes, lasts, pairs[by], table["id"].to_numpy(np.int64)[by]))
    return level.mapInArrow(partial(_sent, k=k, known=sent), LEVEL)


def count(docs: DataFrame, least: int = 100, most: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, words, m, a) of every phrase of 1 to ``most`` words that occurs ``least`` times or more in its language,
    and (lang, n) of all words of each."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    counts = written(rows.mapInArrow(_counted, COUNTED).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    total = written(counts.groupBy("lang").agg(F.sum("n").alias("n")), "words-of-languages")
    known = written(counts.where(F.col("n") >= least).select("lang", "word", F.col("n").alias("a"), F.monotonically_increasing_id().alias("id")), "phrases-1")
    forget(counts)
    if (known.agg(F.sum(F.length("lang") + F.length("word") + 24)).first()[0] or 0) <= SENT:
        frequent = known.select("lang", "word", "id").toArrow()  # SENT bytes at most
        each = {lang: frequent.filter(pc.equal(frequent["lang"], lang)) for lang in frequent["lang"].unique().to_pylist()}
        sent = rows.sparkSession.sparkContext.broadcast({lang: (t["word"].combine_chunks(), t["id"].to_numpy()) for lang, t in each.items()})
        level = written(rows.mapInArrow(partial(_sent_lists, known=sent), LEVEL), "level-1", ROWS)
    else:
        lists = written(rows.mapInArrow(_lists, WORDS), "lists")
        blocks = lists.where("sizes is not null").select("block", "starts", "sizes")
        back = _back(lists.where("word is not null"), known, ["lang", "word"])
        level = written(blocks.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(_first, LEVEL), "level-1", ROWS)
        forget(lists)
    found = known.select("lang", F.array(F.col("word").cast("string")).alias("words"), "a", "id")
    single, out, used = found, [found], [known]
    for k in range(1, most):
        known = _frequent(level.mapInArrow(partial(_grown, k=k), GROWN), ["prefix", "last"], least, f"phrases-{k + 1}")
        longer = known.join(found.select(F.col("id").alias("prefix"), "lang", "words"), "prefix").join(single.select(F.col("id").alias("last"), F.col("words").alias("more")), "last")
        found = longer.select("lang", F.concat("words", "more").alias("words"), "a", "id")
        out.append(found)
        used.append(known)
        if k + 1 < most:
            last, level = level, written(_next(level, known, k), f"level-{k + 1}", ROWS)
            forget(last)
    whole = written(reduce(DataFrame.unionByName, (f.select("lang", "words", F.size("words").alias("m"), "a") for f in out)), "phrases")
    for t in (level, *used):
        forget(t)
    return whole, total


def collocations(docs: DataFrame, least: int = 100, most: int = 5, top: int = 2000, salts: int = 64, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``most`` words.

    A phrase counts within pieces of text; its score is that of its weakest cut, floor(1000 * a * n / (l * r)), of ties
    the shortest first part. Phrases inside a longer one that is as frequent are left out. A null language is ``und``,
    null and empty texts hold no word; repeated rows count each time. Ties in the score go to the more frequent, then
    to the phrase that is less in UTF-8 bytes. Texts are read whole, however long; a text may be cut between blocks,
    a piece never. An empty table gives an empty result; extra columns, whatever their names, are ignored.
    """
    known, total = count(docs, least, most, lang_col, text_col)
    text = known.select("lang", F.concat_ws(" ", "words").alias("phrase"), "words", "m", "a")
    phrases = text.where("m > 1")
    parts = text.select(F.col("lang"), F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = phrases.select("lang", "phrase", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))).alias("head"), F.concat_ws(" ", F.slice("words", F.col("k") + 1, F.col("m") - F.col("k"))).alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(F.broadcast(total), "lang")  # a row for each language

    score = F.expr("(cast(a as decimal(17,0)) * cast(n as decimal(16,0)) * 1000bd) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    inside = phrases.where("m > 2").select("lang", F.explode(F.array(F.concat_ws(" ", F.slice("words", F.lit(1), F.col("m") - 1)), F.concat_ws(" ", F.slice("words", F.lit(2), F.col("m") - 1)))).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))  # a longer one that holds it as often has one that is a word longer
    best = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)  # salts * top rows a language
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
