"""Line dedup by a log-template tree, with DataFrame functions only.

A line goes down a tree of fixed depth: its token count, then its leading tokens, a token with a digit counting as
the variable field <*>. Lines of a leaf that agree with the most frequent tokens at four of five places, or more,
share one template in which the other places are <*>; the others are split by their tokens at a place that varies, and
each part is taken the same way, until a part has no such place: its lines are their own templates, fields masked. A template that recurs across documents is dropped from all of them.

Exact copies of a document are no recurrence (the near-duplicate stage takes them): a template counts once for all
documents of equal text. Edited copies are distinct texts and count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, written

FIELD = "<*>"


def _blanks(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def _masked(line: Column) -> Column:
    """The line with single blanks between its tokens, a token with a digit as the variable field.

    A line of which most tokens are fields, such as a row of numbers, says nothing by its template and stays as it is.
    """
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    one = F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)
    tokens = F.transform(F.split(one, " "), lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))
    fixed = F.size(F.filter(tokens, lambda t: t != FIELD)) * 2 >= F.size(tokens)
    return F.when(line.rlike("[0-9]") & fixed, F.array_join(tokens, " ")).otherwise(one)


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """A row for each line, with its number of tokens n, leaf, template by masking alone, and the masked line."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    cut = rows.select("id", "h", F.posexplode("lines").alias("pos", "line")).select("id", "h", "pos", _masked(F.col("line")).alias("masked"))
    cut = cut.withColumn("n", _blanks(F.col("masked")) + 1)  # filtered by whoever has stored it: here the filter would mask each line again
    return cut.select("id", "h", "pos", "n", F.xxhash64("n", F.substring_index("masked", " ", depth)).alias("leaf"), F.xxhash64("masked").alias("template"), "masked")


def _spread(lines: DataFrame, key: str, min_docs: int, brief_docs: int) -> DataFrame:
    """(key, rows): the keys that stand in ``min_docs`` distinct texts or more, those of brief lines in ``brief_docs`` or more."""
    each = lines.groupBy(key, "h").agg(F.max("brief").alias("brief"), F.count("*").alias("rows"))
    each = each.groupBy(key).agg(F.count("*").alias("n"), F.max("brief").alias("brief"), F.sum("rows").alias("rows"))
    return each.where(F.col("n") >= F.when(F.col("brief"), brief_docs).otherwise(min_docs)).select(key, "rows")


#: Slots of leaf hashes; a table of those in use has so many rows at most, and may be broadcast.
SLOTS = 1 << 20


def _general(tree: DataFrame, narrow: DataFrame, alike: float, min_docs: int) -> DataFrame:
    """(template, rows, l, c): template by masking, its lines, leaf and cluster of the lines that share a cluster's template; only of leaves that can recur often enough."""
    narrow = narrow.where(F.ceil(alike * F.col("n")) < F.col("n"))  # shorter lines share a template only if equal
    varied = narrow.groupBy("leaf").agg(F.min("template").alias("a"), F.max("template").alias("b")).where("a <> b").select("leaf")
    mixed = written(_spread(narrow, "leaf", min_docs, min_docs).join(varied, "leaf", "left_semi"), "leaves")
    slots = mixed.select(F.pmod("leaf", F.lit(SLOTS)).alias("slot")).distinct()
    near = tree.select("leaf", "template", "masked").join(F.broadcast(slots), F.pmod("leaf", F.lit(SLOTS)) == F.col("slot"), "left_semi")
    differ = near.groupBy("leaf", "template").agg(F.first("masked").alias("masked"), F.count("*").alias("rows")).join(mixed.select("leaf"), "leaf", "left_semi")
    now = written(differ.select("leaf", "template", "rows", F.split("masked", " ").alias("tokens"), F.col("leaf").alias("c")), "variants")
    done = None
    while True:
        at = now.select("c", F.posexplode("tokens").alias("p", "token")).groupBy("c", "p", "token").agg(F.count("*").alias("n"))
        place = at.groupBy("c", "p").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("size"))
        varies = (F.col("top.n") > 1) & (F.col("top.n") < alike * F.col("size"))
        modal = place.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("p", "top.token"))).alias("modal"), F.max(F.when(varies, F.struct("top.n", (-F.col("p")).alias("p")))).alias("cut"), F.max("size").alias("size"))
        same = F.size(F.filter(F.zip_with("tokens", "modal", lambda a, b: a == b["token"]), lambda x: x))
        judged = now.join(modal, "c").select("leaf", "template", "rows", "tokens", "c", "size", (same >= alike * F.size("tokens")).alias("hit"), F.col("cut").isNotNull().alias("cut"), F.get("tokens", -F.col("cut.p")).alias("token"))
        # where few agree, the most frequent tokens are those of several templates, and the few do so by chance
        hits = F.count_if("hit").over(Window.partitionBy("c"))
        judged = written(judged.withColumn("hit", F.col("hit") & ((2 * hits >= F.col("size")) | ~F.col("cut"))), "judged")
        hit = judged.where("hit").select("template", "rows", F.col("leaf").alias("l"), "c")
        done = hit if done is None else done.unionByName(hit)
        rest = judged.where("not hit").withColumn("n", F.count("*").over(Window.partitionBy("c", "token"))).withColumn("left", F.count("*").over(Window.partitionBy("c")))
        part = F.xxhash64("c", F.when(F.col("n") > 1, F.col("token")))
        now = written(rest.where("cut or left < size").select("leaf", "template", "rows", "tokens", part.alias("c")), "variants")
        if now.isEmpty():
            return done


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, least: int = 5, brief_docs: int = 10, depth: int = 3, alike: float = 0.8) -> DataFrame:
    """(id, h, pos) of each line to drop; h: xxhash64 of the text; pos: the line's number from 0. See dedup_lines."""
    tree = _lines(docs, id_col, text_col, depth)
    size = F.length("masked")
    brief = ((F.col("n") < least) & (size < 4 * least)).alias("brief")
    narrow = written(tree.select("id", "h", "pos", "n", "leaf", "template", brief, (size > 0).alias("filled")), "lines").where("filled")
    general = _general(tree, narrow, alike, min_docs)
    named = keyed(narrow, written(general, "clusters"), "template", "rows", how="left")
    named = named.select("id", "h", "pos", "brief", F.when(F.col("l").isNotNull(), F.xxhash64(F.lit("leaf"), "leaf", "c")).otherwise(F.col("template")).alias("template"))
    named = written(named, "named-lines")
    often = _spread(named, "template", min_docs, brief_docs)
    return keyed(named, written(often, "recurring"), "template", "rows").select("id", "h", "pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, least: int = 5, brief_docs: int = 10, depth: int = 3, alike: float = 0.8) -> DataFrame:
    """docs with all columns and rows, recurring lines cut from the texts, and a column __dropped: how many went.

    A line recurs if its template stands in ``min_docs`` or more documents of distinct text. Brief lines, of fewer than
    ``least`` tokens and fewer than 4 * ``least`` characters, recur from ``brief_docs`` documents on; blank lines stay. Null texts stay null, empty ones empty; a text of which all lines recur becomes empty.
    Repeated rows get the same result each, a null id is a value like any other; very long texts are parsed whole.
    Ties between a cluster's tokens go to the larger by code point. An empty table gives an empty result.
    """
    gone = recurring(docs, id_col, text_col, min_docs, least, brief_docs, depth, alike)
    gone = gone.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set("pos").alias("__gone"))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text_col]) == gone["__h"]), "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    cols = [F.when(F.col("__gone").isNull(), docs[c]).otherwise(left).alias(c) if c == text_col else docs[c] for c in docs.columns]
    return joined.select(*cols, F.coalesce(F.size("__gone"), F.lit(0)).alias("__dropped"))
