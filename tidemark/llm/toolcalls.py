"""Chat formatting: tool-call linking.

A turn's text may hold calls, <tool_call>{"id", "name", "arguments"}</tool_call>, and results,
<tool_response>{"id", "content"}</tool_response>. Calls and results meet by a hash join on conversation and id; a call
whose arguments hold {"$ref": id} depends on that call, and levels order calls after what they depend on, each result
after its call. Arguments are checked against JSON schemas; turns are written as canonical JSON: sorted keys, no
blanks, unescaped Unicode, integral floats as integers.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

_BLOCK = re.compile(r"<(tool_call|tool_response)>(.*?)</\1>", re.S)
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if isinstance(x, float):
        return int(x) if math.isfinite(x) and x.is_integer() and abs(x) < 2**53 else x if math.isfinite(x) else None
    return x


def canonical(x) -> str:
    return json.dumps(_plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(x, kind: str) -> bool:
    if kind == "integer":
        return isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer()
    if kind == "number":
        return isinstance(x, (int, float)) and not isinstance(x, bool)
    return isinstance(x, _TYPES.get(kind, object))


def errors(x, schema: dict, path: str = "$") -> list[str]:
    """What of the schema (type, enum, required, properties, additionalProperties, items) x breaks; a {"$ref"} passes."""
    if isinstance(x, dict) and set(x) == {"$ref"}:
        return []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(x, k) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = [f"{path}: not in enum"] if "enum" in schema and x not in schema["enum"] else []
    if isinstance(x, dict):
        own = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in x]
        for k in sorted(x):
            if k in own:
                out += errors(x[k], own[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}: unknown")
    if isinstance(x, list) and "items" in schema:
        out += [e for i, v in enumerate(x) for e in errors(v, schema["items"], f"{path}[{i}]")]
    return out


def _refs(x) -> set[str]:
    if isinstance(x, dict):
        own = {x["$ref"]} if isinstance(x.get("$ref"), str) else set()
        return own.union(*map(_refs, x.values()))
    return set().union(*map(_refs, x)) if isinstance(x, list) else set()


def _block(kind: str, raw: str, schemas: dict[str, dict]) -> dict:
    """A call or result as a struct; json null and a note in problems if it can't be read."""
    problems: list[str] = []
    try:
        x = json.loads(raw)
    except ValueError:
        x = None
    if not isinstance(x, dict):
        return {"kind": kind, "id": None, "json": None, "refs": [], "problems": ["not an object"]}
    ident = x.get("id")
    ident = ident if isinstance(ident, str) and ident else None
    if ident is None:
        problems.append("no id")
    if kind == "tool_call":
        name, args = x.get("name"), x.get("arguments", {})
        if isinstance(args, str):
            try:
                args = json.loads(args)
            except ValueError:
                problems.append("arguments: not JSON")
        if not isinstance(name, str):
            problems.append("no name")
        elif name in schemas:
            problems += errors(args, schemas[name])
        elif schemas:
            problems.append("unknown tool")
        return {"kind": kind, "id": ident, "json": canonical({"id": ident, "name": name, "arguments": args}), "refs": sorted(_refs(args)), "problems": problems}
    return {"kind": kind, "id": ident, "json": canonical({"id": ident, "content": x.get("content")}), "refs": [], "problems": problems}


_KIND = "array<struct<kind:string,id:string,json:string,refs:array<string>,problems:array<string>>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("id", pa.string()), ("json", pa.string()), ("refs", pa.list_(pa.string())), ("problems", pa.list_(pa.string()))]))


def _parsed(batches: Iterator[pa.RecordBatch], schemas: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        content, blocks = [], []
        for text in b.column(4).to_pylist():
            found = [_block(m[1], m[2], schemas) for m in _BLOCK.finditer(text)] if text and "<tool_" in text else []
            blocks.append(found)
            content.append(_BLOCK.sub("", text).strip() if found else text)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(content, pa.string()), pa.array(blocks, _ARROW)], names=["row", "conv", "turn", "role", "content", "blocks"])


def _levels(calls: DataFrame) -> DataFrame:
    """(conv, id, level) of calls(conv, id, refs): 0 without known references, else one above the highest of them.

    Calls on a cycle, and those that depend on one, get no row. A round for each step of the longest chain.
    """
    edges = calls.select("conv", F.col("id").alias("to"), F.explode("refs").alias("id")).distinct()
    known = calls.select("conv", F.col("id").alias("id"))
    edges = written(edges.join(known, ["conv", "id"]).select("conv", "to", F.col("id").alias("source")), "references")
    waiting = edges.select("conv", F.col("to").alias("id")).distinct()
    levels = written(known.join(waiting, ["conv", "id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    while not edges.isEmpty():
        got = levels.select("conv", F.col("id").alias("source"), "level")
        state = edges.join(got, ["conv", "source"], "left").groupBy("conv", F.col("to").alias("id")).agg(F.count_if(F.col("level").isNull()).alias("open"), F.max("level").alias("high"))
        ready = written(state.where("open = 0").select("conv", "id", (F.col("high") + 1).alias("level")), "ready")
        if ready.isEmpty():
            break
        before, left = levels, edges
        levels = written(levels.unionByName(ready), "levels")
        edges = written(edges.join(ready.select("conv", F.col("id").alias("to")), ["conv", "to"], "left_anti"), "references")  # those that wait still
        for old in (before, left, ready):
            forget(old)
    return levels


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "turn", "role", "message", "n_calls", "n_results", "n_linked", "n_invalid", "levels"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int32())]
    for b in batches:
        out: list[list] = [[] for _ in names]
        for conv, turn, role, content, blocks, states in zip(*(c.to_pylist() for c in b.columns)):
            state = {s["at"]: s for s in states or []}
            message: dict = {"role": role, "content": content}
            calls, results, linked, bad, levels = [], [], 0, 0, []
            for i, x in enumerate(blocks or []):
                s = state.get(i, {"status": "unreadable", "level": None})
                own = json.loads(x["json"]) if x["json"] else {}
                own |= {"status": s["status"]} | ({"problems": x["problems"]} if x["problems"] else {})
                (calls if x["kind"] == "tool_call" else results).append(own)
                linked, bad = linked + (s["status"] == "linked"), bad + bool(x["problems"])
                levels.append(s["level"])
            message |= ({"tool_calls": calls} if calls else {}) | ({"tool_results": results} if results else {})
            for column, x in zip(out, (conv, turn, role, canonical(message), len(calls), len(results), linked, bad, levels)):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def link(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row for each row of turns(conv_id, turn, role, text): its canonical message, counts and order levels.

    Of several calls (or results) with an id in a conversation the first by turn, a hash of what it says, and place
    owns it, the others are 'duplicate'. A call with a later result is 'linked', as is the result; else 'unanswered'. A result without call
    is an 'orphan', one before its call 'early'. Blocks without an id, or that are not JSON objects, are
    'unreadable'. levels, one for each block in the text's order: 2 x the call's depth, a result one more, null for
    unlinked results and calls on a cycle; (conv_id, level, turn) is a topological order. Null texts give null
    content, null conversation or turn numbers are values like any other but never link. Without schemas nothing is
    validated. Repeated rows are duplicates. An empty table gives an empty result; long texts are read whole; other columns are ignored.
    """
    rows = turns.select(F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    kind = f"row long, conv long, turn long, role string, content string, blocks {_KIND}"
    rows = written(rows.mapInArrow(partial(_parsed, schemas=schemas or {}), kind), "turns")
    blocks = rows.where(F.size("blocks") > 0).select("row", "conv", "turn", F.xxhash64("role", "content", "blocks").alias("said"), F.posexplode("blocks").alias("at", "b")).where(F.col("b.id").isNotNull() & F.col("conv").isNotNull() & F.col("turn").isNotNull())
    blocks = blocks.select("row", "conv", "at", F.struct("turn", "said", "row", "at").alias("place"), F.col("b.kind").alias("kind"), F.col("b.id").alias("id"), F.col("b.refs").alias("refs"))
    is_call = F.col("kind") == "tool_call"
    pairs = blocks.groupBy("conv", "id").agg(F.min(F.when(is_call, F.col("place"))).alias("call"), F.min(F.when(~is_call, F.col("place"))).alias("result"), F.min_by("refs", F.when(is_call, F.col("place"))).alias("refs"))
    pairs = written(pairs, "pairs")
    levels = _levels(pairs.where("call is not null").select("conv", "id", "refs"))
    known = pairs.drop("refs").join(levels, ["conv", "id"], "left")
    ok = F.col("call") < F.col("result")
    status = (
        F.when(is_call, F.when(F.col("place") != F.col("call"), "duplicate").when(ok, "linked").otherwise("unanswered"))
        .when(F.col("place") != F.col("result"), "duplicate").when(F.col("call").isNull(), "orphan").when(ok, "linked").otherwise("early")
    )
    states = blocks.join(known, ["conv", "id"]).withColumn("status", status)
    level = F.when(is_call & (F.col("status") != "duplicate"), 2 * F.col("level")).when(~is_call & (F.col("status") == "linked"), 2 * F.col("level") + 1)
    states = states.groupBy("row").agg(F.collect_list(F.struct("at", "status", level.alias("level"))).alias("states"))  # a turn's own blocks
    full = rows.join(states, "row", "left").select("conv", "turn", "role", "content", "blocks", "states")
    return full.mapInArrow(_told, "conv_id long, turn long, role string, message string, n_calls long, n_results long, n_linked long, n_invalid long, levels array<int>")
