"""Language ID by Bayesian evidence fusion.

log P(lang | page) = host prior + declared markup language + text, up to a constant. The text likelihood is a byte
trigram model, tempered because trigrams overlap; the declared language's likelihood under each language, and the
priors of global, address suffix, domain and host, come from grouped sums of the text posteriors over all pages, each
level smoothed by the one above, a page's own share taken out of its host's.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, written

#: Buckets of hashed byte trigrams.
BUCKETS = 1 << 15
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|nav|footer|head)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")


def visible(page: str | None) -> str:
    return entities.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, white space as one blank."""
    a = np.frombuffer(" ".join(text.lower().split()).encode(), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    return ((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(0x9E3779B1) >> np.uint32(17)).astype(np.int64)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "counts"])


def fit(docs: DataFrame, max_examples: int = 4000, max_langs: int = 64, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, np.ndarray]:
    """lang -> log probability of each bucket, from the ``max_examples`` labelled texts of smallest hash, whole."""
    some = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = some.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id", F.lit(7)), "__id").limit(max_examples)  # ids alone are sorted
    some = some.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(F.lower(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sums: dict[str, np.ndarray] = {}
    for r in some.repartition(4).mapInArrow(_tallied, "lang string, counts binary").collect():  # a row for each task and language
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
    best = sorted(sums, key=lambda k: (-int(sums[k].sum()), k))[:max_langs]
    return {k: np.log((sums[k] + 0.1) / (sums[k].sum() + 0.1 * BUCKETS)) for k in sorted(best)}


def _evidence(batches: Iterator[pa.RecordBatch], model: dict[str, np.ndarray], temper: float) -> Iterator[pa.RecordBatch]:
    langs = list(model)
    table = np.stack(list(model.values()), axis=1) if model else np.zeros((BUCKETS, 0))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64())]
    for b in batches:
        out: list[list] = [[] for _ in kinds]
        for page, url, text in zip(*(c.to_pylist() for c in b.columns)):
            m = _LANG.search(text or "")
            said = m[1].lower() if m else "none"
            h = _HOST.match(url or "")
            host = h[1].lower().strip(".") if h else ""
            labels = host.split(".")
            suffix = labels[-1] if len(labels) > 1 and labels[-1].isalpha() else ""
            domain = ".".join(labels[-2:]) if suffix else host
            log = table[trigrams(visible(text))].sum(axis=0) * temper
            for column, x in zip(out, (page, host, domain, suffix, said if said in langs or said == "none" else "other", (log - log.max()).tolist() if langs else [])):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "host", "domain", "suffix", "said", "log"])


def _unit(logs: Column) -> Column:
    """Probabilities from an array of natural logs."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def classify(pages: DataFrame, model: dict[str, np.ndarray], temper: float = 0.2, strength: float = 8.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, declared, text_lang, lang, probability) for each row of pages.

    Null or empty pages have no text evidence and follow declaration and host; a null or odd url has the host ''.
    Undeclared pages count as 'none', languages outside the model as 'other'. Repeated rows are evidence and result
    each; ties go to the first language by code. Without a model lang is null. Very long pages are read whole. An empty
    table gives an empty result; other columns, whatever their names, are ignored.
    """
    langs = list(model)
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    kind = "id long, host string, domain string, suffix string, said string, log array<double>"
    seen = written(rows.mapInArrow(partial(_evidence, model=model, temper=temper), kind), "evidence")
    if not langs:
        return seen.select("id", "host", F.col("said").alias("declared"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    n = len(langs)
    share = seen.withColumn("p", _unit(F.col("log")))

    def sums(*by: str) -> DataFrame:
        return share.groupBy(*by).agg(F.array(*(F.sum(F.col("p")[i]) for i in range(n))).alias("n"))

    def smoothed(count: Column, above: Column) -> Column:
        total = F.aggregate(count, F.lit(0.0), lambda a, y: a + y)
        return F.zip_with(count, above, lambda c, a: (c + strength * a) / (total + strength))

    flat = F.array(*(F.lit(1.0 / n) for _ in langs))
    total = sums().first()["n"]
    world = [((x or 0.0) + strength / n) / (sum(y or 0.0 for y in total) + strength) for x in total]
    declared = {r["said"]: r["n"] for r in sums("said").collect()}  # languages of the model, none and other
    column = [sum(c[i] for c in declared.values()) for i in range(n)]
    said = F.lit(None).cast("array<double>")
    for word, c in sorted(declared.items()):
        logs = [float(np.log((c[i] + 0.5) / (column[i] + 0.5 * (n + 2)))) for i in range(n)]
        said = F.when(F.col("said") == word, F.array(*map(F.lit, logs))).otherwise(said)
    whole = F.array(*(F.sum(F.col("host_n")[i]) for i in range(n)))
    hosts = share.groupBy("host", "domain", "suffix").agg(F.array(*(F.sum(F.col("p")[i]) for i in range(n))).alias("host_n"), F.count("*").alias("pages"))
    hosts = written(hosts, "hosts")
    by_suffix = hosts.groupBy("suffix").agg(whole.alias("n"), F.count("*").alias("hosts"))
    by_suffix = by_suffix.select("suffix", smoothed(F.col("n"), F.array(*map(F.lit, world))).alias("suffix_p"), "hosts")
    by_domain = hosts.groupBy("domain", "suffix").agg(whole.alias("domain_n"), F.count("*").alias("hosts"))
    by_domain = keyed(by_domain.withColumnRenamed("hosts", "own"), written(by_suffix, "suffixes"), "suffix", "hosts")
    by_domain = written(by_domain.select("domain", smoothed(F.col("domain_n"), F.col("suffix_p")).alias("domain_p"), F.col("own").alias("hosts")), "domains")
    prior = written(keyed(hosts, by_domain, "domain", "hosts").select("host", "host_n", "domain_p", "pages"), "priors")
    near = keyed(share, prior, "host", "pages")
    others = F.zip_with("host_n", "p", lambda c, own: F.greatest(c - own, F.lit(0.0)))
    log = F.zip_with(F.zip_with(F.col("log"), said, lambda a, b: a + b), smoothed(others, F.coalesce("domain_p", flat)), lambda a, b: a + F.log(b))
    done = near.withColumn("post", _unit(log))
    names = F.array(*map(F.lit, langs))

    def best(p: str) -> Column:
        return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))

    return done.select("id", "host", F.col("said").alias("declared"), best("p").alias("text_lang"), best("post").alias("lang"), F.array_max("post").alias("probability"))
