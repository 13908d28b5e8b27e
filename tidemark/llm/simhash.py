"""SimHash near-duplicate groups, found by covering-code anchors.

The 64 bits fall into blocks, so that two fingerprints within ``threshold`` bits differ in at most threshold // blocks
bits of one of them. A block's first bits have a covering code (Golay [23,12], radius 3, or Hamming [15,11], radius 1);
what is left stands plain beside the code word. A fingerprint is at home at one anchor (code word and plain bits) within
the covering radius, and is replicated to every anchor within radius plus block threshold; whatever links to it is
therefore at home at one of these anchors. Fingerprints are compared per anchor, whole and exactly. A crowded anchor
is dealt out over a grid of cells, home parts by replica parts, so that no task holds an unbounded group, and a cell
returns a spanning forest of its links, never all pairs. Three blocks have 24,576 anchors; for many fingerprints two
blocks with 4 million anchors keep the homes at an anchor few. Either finds every link.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, written
from .graph import components

#: First bit, coded bits, plain bits and covering radius of each block, for few and for many fingerprints.
FEW = ((0, 23, 0, 3), (23, 23, 0, 3), (46, 15, 3, 1))
MANY = ((0, 23, 9, 3), (32, 23, 9, 3))
#: Fingerprints from which on MANY is used.
WIDE = 4_000_000
#: Fixed value: the generator polynomial of the binary Golay code [23,12,7].
GOLAY = 0b110001110101
#: Home or replica rows of one cell at most, on average over an anchor's grid.
CELL = 2048


def shingles(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the width-word shingles in order, at most 65,536 at a time; no words: nothing."""
    words = (text or b"").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    for at in range(0, n, 1 << 16):
        yield np.array([xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], "<u8")


def fingerprint(text: bytes | None, width: int) -> int:
    """64-bit SimHash over the XXH64 (seed 42) of width-word shingles, repeats counted; no words: 0."""
    return folded(shingles(text, width))


def folded(hashed: Iterable[np.ndarray]) -> int:
    """The SimHash of shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in hashed:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp) for each row; fp as a signed long. Null texts count as empty; ids pass unchanged, nulls and repeats too."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(partial(_fingerprint_batches, width=width), "id long, fp long")


Block = tuple[int, int, int, int]


def patterns(block: Block, reach: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Syndromes of the coded bits; the home error of each syndrome; errors of up to radius + reach bits, padded with -1.

    An error that takes plain bits leaves that much less of reach to the coded ones.
    """
    _, coded, plain, radius = block
    if coded == 23:
        of_bit = []
        for i in range(coded):
            rest = 1 << i
            for k in range(i, 10, -1):
                if rest >> k & 1:
                    rest ^= GOLAY << (k - 11)
            of_bit.append(rest)
    else:
        of_bit = [*range(1, coded + 1)]
    by: dict[int, list[tuple[int, int]]] = {}
    for weight in range(radius + reach + 1):
        for bits in combinations(range(coded), weight):
            s = e = 0
            for i in bits:
                s, e = s ^ of_bit[i], e | 1 << i
            by.setdefault(s, []).append((weight, e))
    flips = [(n, sum(1 << coded + i for i in bits)) for n in range(reach + 1) for bits in combinations(range(plain), n)]
    rows = {s: [e | f for n, f in flips for weight, e in errors if weight <= radius + reach - n] for s, errors in by.items()}
    table = np.full((max(rows) + 1, max(map(len, rows.values()))), -1, np.int64)
    for s, errors in rows.items():
        table[s, : len(errors)] = errors
    return of_bit, table[:, 0].copy(), table


def anchors(fps: np.ndarray, block: Block, made: tuple[list[int], np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint: its home anchor, and all anchors within covering radius plus reach (-1: padding); made: the block's patterns."""
    first, coded, plain, _ = block
    word = (fps >> np.uint64(first) & np.uint64((1 << coded + plain) - 1)).astype(np.int64)
    of_bit, home, table = made
    s = np.zeros(len(word), np.int64)
    for i, x in enumerate(of_bit):
        s ^= (word >> i & 1) * x
    errors = table[s]
    return word ^ home[s], np.where(errors < 0, -1, word[:, None] ^ errors)


def _mixed(fps: np.ndarray) -> np.ndarray:
    x = fps * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(32)).astype(np.uint64)


def _cells(batches: Iterator[pa.RecordBatch], blocks: tuple[Block, ...], reach: int, common: tuple[int, int], grid: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(anchor, part, fp, home, near) rows. common: parts of homes and of replicas at an anchor; grid: those of crowded anchors."""
    made = [patterns(block, reach) for block in blocks]
    crowded = np.array(sorted(grid), np.int64)
    sizes = np.array([grid[a] for a in crowded.tolist()], np.int64).reshape(-1, 2)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())

    def told(anchor: np.ndarray, part: np.ndarray, fp: np.ndarray, home: np.ndarray | bool, near: bool) -> Iterator[pa.RecordBatch]:
        columns = [np.broadcast_to(x, len(anchor)) for x in (anchor, part, fp.view(np.int64), home, near)]
        for k in range(0, len(anchor), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000], t) for x, t in zip(columns, kinds)], names=["anchor", "part", "fp", "home", "near"])

    for b in batches:
        every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at_once in range(0, len(every), 8192):
            fps = every[at_once : at_once + 8192]
            for number, block in enumerate(blocks):
                home, close = anchors(fps, block, made[number])
                row, col = np.nonzero(close >= 0)
                anchor, fp, is_home = close[row, col] | number << 40, fps[row], close[row, col] == home[row]
                place = np.minimum(np.searchsorted(crowded, anchor), max(0, len(crowded) - 1))
                hot = crowded[place] == anchor if len(crowded) else np.zeros(len(anchor), bool)
                p, q = (np.where(hot, sizes[place, i], common[i]) if len(crowded) else np.full(len(anchor), common[i]) for i in (0, 1))
                mix = _mixed(fp)
                whole = (p == 1) & (q == 1)
                yield from told(anchor[whole], np.int64(0), fp[whole], is_home[whole], True)
                # a home part i and a replica part j meet in the cell i * q + j
                some = ~whole
                replica = (mix[some] % q[some].astype(np.uint64)).astype(np.int64)
                for i in range(int(p[some].max()) if some.any() else 0):
                    on = p[some] > i
                    yield from told(anchor[some][on], (i * q[some] + replica)[on], fp[some][on], False, True)
                some = ~whole & is_home
                own = (mix[some] % p[some].astype(np.uint64)).astype(np.int64)
                for j in range(int(q[some].max()) if some.any() else 0):
                    on = q[some] > j
                    yield from told(anchor[some][on], (own * q[some] + j)[on], fp[some][on], True, False)


def _forest(homes: np.ndarray, near: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that join the fingerprints of a cell as its links do."""
    linked = np.empty((len(homes), len(near)), bool)
    step = max(1, (1 << 20) // max(1, len(near)))
    for k in range(0, len(homes), step):
        linked[k : k + step] = np.bitwise_count(homes[k : k + step, None] ^ near[None, :]) <= threshold
    return _stars(homes, near, linked)


def _stars(homes: np.ndarray, near: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that join homes and near as linked does; a value of both is linked to itself."""
    rows, cols = linked.sum(axis=1) > np.isin(homes, near), linked.any(axis=0)
    if not rows.any():
        return homes[:0], homes[:0]
    homes, near, linked = homes[rows], near[cols], linked[np.ix_(rows, cols)]
    nodes = np.unique(np.concatenate((homes, near)))
    hi, ni, label = np.searchsorted(nodes, homes), np.searchsorted(nodes, near), np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, hi, np.where(linked, label[ni][None, :], len(nodes)).min(axis=1))
        np.minimum.at(label, ni, np.where(linked, label[hi][:, None], len(nodes)).min(axis=0))
        label = label[label]
        if (label == before).all():
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]


def _links(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Spanning edges of each cell (anchor, part); the rows of a cell come one after the other."""

    def starts(cells: np.ndarray) -> list[int]:
        return [0, *(np.flatnonzero((np.diff(cells, axis=0) != 0).any(axis=1)) + 1).tolist()]

    def compared(parts: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cell, fp, home, near = (np.concatenate(x) for x in zip(*parts))
        cuts = starts(cell)
        for a, b in zip(cuts, [*cuts[1:], len(cell)]):
            if b - a > 1 and home[a:b].any():
                u, v = _forest(fp[a:b][home[a:b]], fp[a:b][near[a:b]], threshold)
                if len(u):
                    yield u, v

    def batch(edges: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*edges))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    kept: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if not len(columns[0]):
            continue
        now = (np.stack(columns[:2], axis=1), columns[2].view(np.uint64), columns[3].astype(bool), columns[4].astype(bool))
        if kept and (kept[0][0][0] != now[0][0]).any():
            if edges := list(compared(kept)):
                yield batch(edges)
            kept = []
        last = starts(now[0])[-1]
        if last:  # the last cell may go on in the next batch
            if edges := list(compared([*kept, tuple(x[:last] for x in now)])):
                yield batch(edges)
            kept = []
        kept.append(tuple(x[last:] for x in now))
    if kept and (edges := list(compared(kept))):
        yield batch(edges)


def links(fps: DataFrame, threshold: int = 4, cell: int = CELL, wide: int = WIDE) -> DataFrame:
    """Spanning edges (u, v) of the links between distinct fingerprints of fps(fp); no link between texts is lost."""
    one = fps.select("fp").where("fp is not null")
    blocks = FEW if one.count() <= wide else MANY
    reach = threshold // len(blocks)

    def dealt(common: tuple[int, int], grid: dict[int, tuple[int, int]]) -> DataFrame:
        return one.mapInArrow(partial(_cells, blocks=blocks, reach=reach, common=common, grid=grid), "anchor long, part long, fp long, home boolean, near boolean")

    counts = written(dealt((1, 1), {}).groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("near")), "anchors")
    mean = counts.agg(F.avg("homes"), F.avg("near")).first()
    common = tuple(-(-int(x or 0) // cell) or 1 for x in mean)
    # less than a quarter of the anchors hold four times the mean: 6,144 or 1 million rows
    grid = {r["anchor"]: (-(-r["homes"] // cell) or 1, -(-r["near"] // cell)) for r in counts.where(F.col("near") > 4 * max(cell // 4, mean[1] or 0)).collect()}
    rows = dealt(common, grid).repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return rows.mapInArrow(partial(_links, threshold=threshold), "u long, v long").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, threshold: int = 4) -> DataFrame:
    """(id, fp, component) for each row of docs: near-duplicate groups of the whole texts.

    component: the smallest id reachable over links of fingerprints at ``threshold`` or fewer differing bits.
    Null or empty texts share fingerprint 0 and link like any other; fewer than ``width`` words make one shingle.
    Rows with equal texts, and repeated rows, share a group; rows with a null id are kept and take part in links,
    but a null is no component id unless the group has only nulls. An empty table gives an empty result, and
    columns other than the two named are ignored. Very long texts are hashed whole, 65,536 shingles at a time.
    """
    rows = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "nodes")
    return _grouped(rows, nodes, written(components(links(nodes, threshold)), "roots"))


def _grouped(rows: DataFrame, nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """rows(fp, ...) with a column component, the least of their component; nodes(fp, least, rows); tree(node, root)."""
    whole = tree.union(tree.select("root", "root")).distinct()
    ids = nodes.join(whole, nodes["fp"] == whole["node"]).select("fp", "least", "root")
    least = ids.groupBy("root").agg(F.min("least").alias("component"))
    linked = ids.join(least, "root").select("fp", "component")
    known = nodes.join(linked, "fp", "left").select("fp", "rows", F.coalesce("component", "least").alias("component"))
    return keyed(rows, written(known, "components"), "fp", "rows")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Bands, and minima a band: of pairs at similarity 0.8 all but 0.04 % meet in a band, of those at 0.9 all but 1e-8.
BANDS, DEPTH = 20, 5
_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, (BANDS * DEPTH, 1), np.uint64) * np.uint64(2) + np.uint64(1)
#: A bucket of one set more than this is still compared by a window; larger ones go to cells.
FOLLOW = 32
#: Sets, and shingles, of one side of a cell, on average over a bucket's grid.
PART, VOLUME = 512, 1 << 21


def _sketch_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps, sims, sizes, bands = [], [], [], []
        for t in b.column(1).to_pylist():
            hashed = list(shingles(t, width))
            sims.append(folded(hashed))
            have = np.unique(np.concatenate([np.empty(0, "<u8"), *hashed]))
            low = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(have), 1024):
                low = np.minimum(low, (have[None, at : at + 1024] * _SEEDS).min(axis=1))
            fps.append(xxhash.xxh64_intdigest(have.tobytes(), 42))
            sizes.append(len(have))
            bands.append([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(low.reshape(BANDS, DEPTH))] if len(have) else [])
        ends = np.concatenate(([0], np.cumsum([len(x) for x in bands], dtype=np.int64)))
        keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(sum(bands, []), np.uint64).view(np.int64)))
        marks = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, sims))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *marks, pa.array(sizes, pa.int32()), keys], names=["id", "h", "fp", "sim", "n", "bands"])


def _set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in b.column(0).to_pylist():
            have = np.unique(np.concatenate([np.empty(0, "<u8"), *shingles(t, width)]))
            one = pa.array([have.view(np.int64).tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(have.tobytes(), 42)], pa.uint64()).view(pa.int64()), one], names=["fp", "has"])


def _alike(pairs: DataFrame, texts: DataFrame, width: int, alike: float) -> DataFrame:
    """The pairs (u, v) of sets whose Jaccard similarity is ``alike`` or more; texts(fp, text) holds a text of each set."""
    wanted = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct()
    sets = written(texts.join(wanted, "fp", "left_semi").select("text").mapInArrow(partial(_set_batches, width=width), "fp long, has array<long>"), "sets")
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("has").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("has").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= alike * (F.size("a") + F.size("b") - shared)).select("u", "v")


def _meeting(fps: np.ndarray, first: np.ndarray, second: np.ndarray, sets: list[np.ndarray], alike: float) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that join the sets of a cell as their Jaccard similarities of ``alike`` or more do; first and second: the cell's sides."""
    sizes = np.array([len(x) for x in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # shingles that the same sets hold are one column with a weight
    sign = np.zeros(len(held), np.uint64)
    np.add.at(sign, column, np.random.default_rng(1).integers(1, 1 << 63, len(sets), np.uint64)[row])
    shared = np.flatnonzero(held > 1)
    _, one, weight = np.unique(sign[shared], return_index=True, return_counts=True)
    at = np.full(len(held), -1)
    at[shared[one]] = np.arange(len(one))
    col = at[column]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    common = np.zeros((first.sum(), second.sum()))
    for k in range(0, len(one), 4096):
        lo, hi = np.searchsorted(col, (k, k + 4096))
        has = np.zeros((len(sets), min(4096, len(one) - k)))
        has[row[lo:hi], col[lo:hi] - k] = 1
        common += (has[first] * weight[k : k + 4096]) @ has[second].T
    linked = common >= alike * (sizes[first][:, None] + sizes[second][None, :] - common)
    linked |= fps[first][:, None] == fps[second][None, :]
    return _stars(fps[first], fps[second], linked)


def _met(batches: Iterator[pa.RecordBatch], alike: float) -> Iterator[pa.RecordBatch]:
    """Spanning edges of each cell (key, i, j) of rows (key, i, j, part, fp, root, has); a cell's rows come one after the other."""

    def links(cell: tuple[int, int, int], rows: list[tuple[int, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        part, fps, roots, sets = zip(*rows)
        if len(set(roots)) > 1:
            side = np.array(part)
            u, v = _meeting(np.array(fps, np.int64), side == cell[1], side == cell[2], list(sets), alike)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    now, rows = None, []
    for b in batches:
        keys = zip(*(b.column(i).to_pylist() for i in range(3)))
        rest = zip(*(b.column(i).to_pylist() for i in range(3, 6)))
        lists = b.column(6)
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for n, (cell, (part, fp, root)) in enumerate(zip(keys, rest)):
            if cell != now:
                if rows:
                    yield from links(now, rows)
                now, rows = cell, []
            rows.append((part, fp, root, values[ends[n] : ends[n + 1]].copy()))
    if rows:
        yield from links(now, rows)


def _in_cells(crowded: DataFrame, texts: DataFrame, width: int, alike: float, part: int) -> DataFrame:
    """Links (u, v) that join the sets of large buckets as all links between them do; crowded(key, fp, root, c, s).

    c and s: sets and shingles of the bucket, which is dealt out over a grid of cells, so that each two of its sets
    meet in one of them. A cell compares whole sets and returns a spanning forest.
    """
    sets = written(texts.join(crowded.select("fp").distinct(), "fp", "left_semi").select("text").mapInArrow(partial(_set_batches, width=width), "fp long, has array<long>"), "sets")
    parts = F.ceil(F.greatest(F.col("c") / part, F.col("s") / VOLUME)).cast("int")
    dealt = crowded.withColumn("parts", parts).withColumn("part", F.pmod(F.shiftright(F.xxhash64("key", "fp"), 20), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    cells = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp", "root").join(sets, "fp")
    rows = cells.select("key", "i", "j", "part", "fp", "root", "has").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(partial(_met, alike=alike), "u long, v long")


def _by_simhash(rows: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) between the sets of rows(fp, sim) whose SimHash fingerprints differ in at most ``threshold`` bits: a spanning forest."""
    held = written(rows.select("fp", "sim").distinct(), "simhashes")
    least = written(held.groupBy("sim").agg(F.min("fp").alias("least"), F.max("fp").alias("most")), "fingerprints")
    many = least.where("least <> most").select(F.col("sim").alias("__sim"), "least")
    same = held.join(many, F.col("sim") == F.col("__sim")).where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    met = links(least.select(F.col("sim").alias("fp")), threshold)
    for end in ("u", "v"):
        met = met.join(least.select(F.col("sim").alias(end), F.col("least").alias(f"__{end}")), end)
    return written(same.union(met.select("__u", "__v")), "links")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, alike: float = 0.8, follow: int = FOLLOW, part: int = PART, threshold: int | None = None) -> DataFrame:
    """(id, h, fp, component) for each row of docs: groups of texts linked by Jaccard similarity ``alike`` or more of their sets of shingles.

    With a ``threshold``, texts whose SimHash fingerprints differ in as many bits or fewer link too, as in ``groups``;
    anchors find these links.
    h: xxhash64 of the text, so that (id, h) tells rows with one id apart; component: the least (id, h) of the group,
    null if all its ids are null. fp: hash of the set. Candidates share a band of MinHash minima; every link by
    similarity is verified on the whole sets. First each set is compared with the smallest of its buckets, then, in buckets that
    hold more than one group, with all others of another group: by a window in buckets of up to ``follow`` + 1 sets,
    in cells of ``part`` by ``part`` sets in larger ones. Null texts count as empty, and texts without words are one
    group.
    """
    text = F.col(text_col).cast("binary")
    given = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = written(given.mapInArrow(partial(_sketch_batches, width=width), "id long, h long, fp long, sim long, n int, bands array<long>"), "sketches")
    place = F.struct("id", "h")
    nodes = rows.groupBy("fp").agg(F.min(F.when(F.col("id").isNotNull(), place)).alias("least"), F.min(place).alias("place"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    nodes = written(nodes, "nodes")
    each = nodes.select("fp", "n", F.explode("bands").alias("key"))
    crowd = each.groupBy("key").agg(F.min(F.struct("fp", "n")).alias("m"), F.count("*").alias("c")).where("c > 1")
    met = written(keyed(each, written(crowd, "crowds"), "key", "c"), "buckets")

    def close(a: Column, b: Column) -> Column:
        return F.least(a, b) >= alike * F.greatest(a, b)

    # a text of each set that meets another
    own = nodes.join(met.select("fp").distinct(), "fp", "left_semi").select("fp", F.col("place.id").alias("i"), F.col("place.h").alias("k"))
    texts = given.join(own, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))).select("fp", "text").dropDuplicates(["fp"])
    texts = written(texts, "texts")
    first = written(met.where((F.col("m.fp") != F.col("fp")) & close(F.col("m.n"), F.col("n"))).select(F.col("m.fp").alias("u"), F.col("fp").alias("v")).distinct(), "pairs")
    star = written(_alike(first, texts, width, alike), "links")
    tree = written(components(star), "roots")
    rooted = written(met.join(tree, F.col("fp") == F.col("node"), "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    split = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("c"), F.sum("n").alias("s")).where("a <> b").select("key", "c", "s")
    rest = written(keyed(rooted, written(split, "mixed"), "key", "c", keep=True), "rest")
    after = Window.partitionBy("key").orderBy("fp").rowsBetween(1, follow)
    few = rest.where(F.col("c") <= follow + 1).withColumn("then", F.collect_list(F.struct("fp", "n", "root")).over(after))
    few = few.withColumn("o", F.explode(F.filter("then", lambda o: (o["root"] != F.col("root")) & close(o["n"], F.col("n")))))
    second = few.select(F.least("fp", "o.fp").alias("u"), F.greatest("fp", "o.fp").alias("v")).distinct().join(first, ["u", "v"], "left_anti")
    crowded = _in_cells(rest.where(F.col("c") > follow + 1), texts, width, alike, part)
    more = _alike(written(second, "pairs"), texts, width, alike)
    whole = star.union(more).union(crowded)
    if threshold is not None:
        whole = _by_simhash(rows, threshold).union(whole)
    return _grouped(rows.select("id", "h", "fp"), nodes, written(components(whole), "roots"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, alike: float = 0.8, threshold: int | None = None) -> DataFrame:
    """docs without the near copies: of each group one row stays, with all columns of docs.

    Groups are those of near_groups. The row with the smallest id stays, of several with that id the one of smallest
    xxhash64 of the text, of rows that repeat both one. Rows with one id and unlike texts are told apart. Rows with a
    null id can't be, and all stay. Null and empty texts are one group. An empty table gives an empty result.
    """
    named = docs.where(F.col(id_col).isNotNull())
    marked = near_groups(named, id_col, text_col, width, alike, threshold=threshold)
    stay = marked.where((F.col("id") == F.col("component.id")) & (F.col("h") == F.col("component.h"))).select(F.col("id").cast(docs.schema[id_col].dataType).alias("__id"), F.col("h").alias("__h")).distinct()
    keys = named.withColumn("__k", F.xxhash64(F.col(text_col).cast("binary")))
    kept = keys.join(stay, (F.col(id_col) == F.col("__id")) & (F.col("__k") == F.col("__h")), "left_semi").dropDuplicates([id_col, "__k"]).drop("__k")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
