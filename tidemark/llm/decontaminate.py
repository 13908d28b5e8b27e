"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most k edits leaves at least one of its k + 1 pieces unchanged. The pieces
of a bounded block of items form one Aho-Corasick automaton; every piece hit gives the window in which the item would
lie, and Myers' bit-parallel distance verifies it. Texts and items are compared after Unicode lower-casing, with each
run of white space as one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cuts = [round(i * len(item) / (k + 1)) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def peq(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def nearest(masks: dict[str, int], m: int, window: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any part of the window, end of the first such part): Myers' algorithm."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(window):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def budget(item: str, rate: float, least: int) -> int:
    """Errors that an item may hold: the rate of its length; none under ``least`` characters."""
    return int(len(item) * rate) if len(item) >= least else 0


def joins(a: str, b: str) -> bool:
    """Whether two characters, one after the other, belong to one word; scripts without blanks have no such bounds."""
    return all((c.isalnum() or c == "_") and not re.match("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]", c) for c in (a, b))


def alone(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] begins and ends at word boundaries."""
    return not (start and joins(text[start - 1], text[start]) or end < len(text) and joins(text[end - 1], text[end]))


class Finder:
    """Finds a block of items (id, normalised text, error budget) in texts."""

    def __init__(self, items: list[tuple[int | None, str, int]], least: int):
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item, k) in enumerate(items):
            for at, piece in pieces(item, k):
                found.setdefault(piece, []).append((n, at))
        self.items, self.least, self.masks = items, least, {}
        self.tree = ahocorasick.Automaton()
        for piece, where in found.items():
            self.tree.add_word(piece, (len(piece), where))
        self.tree.make_automaton()

    def find(self, raw: str | None, any_: bool = False) -> dict[int, tuple[int, int]]:
        """Of each item that the text holds: (distance, end); with any_ the first one found is enough."""
        text, items = normal(raw), self.items
        best: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}
        for stop, (size, where) in self.tree.iter(text):
            for n, at in where:
                item, k = items[n][1:]
                if best.get(n, (k + 1, 0))[0] == 0:
                    continue
                start = stop + 1 - size - at  # of the item, if no letter came or went before the piece
                if done.get(n) == start:
                    continue
                done[n] = start
                if len(item) < self.least and not alone(text, start, start + len(item)):
                    continue
                if 0 <= start and text.startswith(item, start):
                    best[n] = (0, start + len(item))
                else:
                    left = max(0, start - k)
                    if n not in self.masks:
                        self.masks[n] = peq(item)
                    d, end = nearest(self.masks[n], len(item), text[left : start + len(item) + k])
                    if d <= k and d < best.get(n, (k + 1, 0))[0]:
                        best[n] = (d, left + end)
                if any_ and best:
                    return best
        return best


def _matched(batches: Iterator[pa.RecordBatch], items: list[tuple[int | None, str, int]], least: int) -> Iterator[pa.RecordBatch]:
    finder = Finder(items, least)
    kind = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int64())])
    for b in batches:
        out: list[list] = [[], [], [], []]
        for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for n, (d, end) in finder.find(raw).items():
                for column, x in zip(out, (doc, items[n][0], d, end)):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, kind)], schema=kind)


def _blocks(benchmark: DataFrame, rate: float, least: int, block_chars: int) -> Iterator[list[tuple[int | None, str, int]]]:
    """The items in blocks of about ``block_chars`` characters, one at a time in the driver; those without text are left out."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    for i in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        own = sorted(((r["item_id"], t, budget(t, rate, least)) for r in part.collect() if (t := normal(r["text"]))), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if own:
            yield own


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, least: int = 40, block_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, distance, end) for each row of docs and item that it holds within the item's error budget.

    The budget is ``rate`` of the item's characters; items under ``least`` characters must stand in the text without
    an edit, between word boundaries. Null and blank items are left out; null and empty texts hold nothing. An item
    with a null id is searched like any other. distance: the least over the
    text's verified windows; end: where the first such place ends in the normalised text. Items with equal texts
    each match; repeated item ids with different texts each count; repeated rows of docs each give rows. Items are
    taken in blocks of at most ``block_chars`` characters, one pass over docs for each block, so that no automaton
    grows with the benchmark; very long texts are searched whole. An empty table on either side gives an empty
    result; other columns of docs, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for own in _blocks(benchmark, rate, least, block_chars):
        hit = rows.mapInArrow(partial(_matched, items=own, least=least), "id long, item_id long, distance int, end long")
        out = hit if out is None else out.unionByName(hit)
    return rows.limit(0).select("id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("distance"), F.lit(0).cast("long").alias("end")) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, least: int = 40, block_chars: int = 2_000_000, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a test item, with all columns, as ``matches`` finds them.

    Each row is judged by its own text in one pass, whatever its id: a null or repeated id changes nothing.
    """

    def clean(own: list[tuple[int | None, str, int]]) -> Column:
        @F.pandas_udf("boolean")
        def judged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            finder = Finder(own, least)
            for texts in parts:
                yield texts.map(lambda t: not finder.find(t, any_=True)).astype(bool)

        return judged(F.col(text_col))

    for own in _blocks(benchmark, rate, least, block_chars):
        docs = docs.where(clean(own))
    return docs
