"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lines, logbilinear, mixing, personal, phrases, secrets, simhash, toolcalls, toxicity, vafile, whitening
from .common import held_out, table
from .sql import SQL as SQL


#: What the calls of ``transcripts`` must look like.
SCHEMAS = {"reply": {"type": "object", "properties": {"turn": {"type": "integer"}, "chars": {"type": "integer"}, "after": {"type": "object"}}, "required": ["turn", "chars"], "additionalProperties": False}}


def transcripts(turns: DataFrame) -> DataFrame:
    """Conversations as tool transcripts, since the table's turns hold no calls.

    An assistant's turn calls ``reply`` and refers to the call two turns before; the user's turn after it holds the
    result. The first turn's characters are a float, the fifth's a text, which the schema refuses.
    """
    turn = F.col("turn").cast("string")
    chars = F.length(F.coalesce("text", F.lit(""))).cast("string")
    chars = F.when(F.col("turn") == 1, F.concat(chars, F.lit(".0"))).when(F.col("turn") == 5, F.concat(F.lit('"'), chars, F.lit('"'))).otherwise(chars)
    after = F.when(F.col("turn") > 2, F.concat(F.lit(',"after":{"$ref":"a'), F.col("turn") - 2, F.lit('"}'))).otherwise("")
    call = F.concat(F.lit('\n<tool_call>{"name":"reply","id":"a'), turn, F.lit('","arguments":{"turn":'), turn, F.lit(',"chars":'), chars, after, F.lit("}}</tool_call>"))
    result = F.concat(F.lit('<tool_response>{"id":"a'), F.col("turn") - 1, F.lit('","content":{"turn":'), turn, F.lit("}}</tool_response>\n"))
    said = F.coalesce("text", F.lit(""))
    text = F.when(F.col("role") == "assistant", F.concat(said, call)).when((F.col("role") == "user") & (F.col("turn") > 1), F.concat(result, said)).otherwise(F.col("text"))
    return turns.withColumn("text", text)


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toolcalls.link(transcripts(table(spark, sf_dir, "conversations")), SCHEMAS)
    return found.withColumn("levels", F.array_join(F.col("levels").cast("array<string>"), ",", "-"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.classify(table(spark, sf_dir, "pages"), langid.fit(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "page_id").withColumn("probability", F.round("probability", 6))


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), width=4, threshold=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.fit(docs.where(~held_out(F.col("doc_id"), 0)), labels.where(~held_out(F.col("doc_id"), 0)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scores(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op3_vafile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vafile.top_k(table(spark, sf_dir, "embeddings"), k=5, scale=256, every=50)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op4_logbilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logbilinear.scores(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 1))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.col("__dropped").cast("long").alias("n_dropped"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "distance", "end")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def of(kinds: list[str]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(kinds))

    base = [r.kind for r in secrets.BASE]
    return found.select(
        F.col("id").alias("doc_id"),
        *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(secrets.joined(of(base)), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it passes a long; deviation_digits has it at any size."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = found.select(F.col("id").alias("vec_id"), "n", F.col("deviation").try_cast("long").alias("deviation"), F.col("deviation").alias("deviation_digits"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "x.whitened", "x.explained", "identity_error", "deviation_digits")


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find(table(spark, sf_dir, "documents"))
    base, names = F.col("base"), F.array(*map(F.lit, personal.KINDS + personal.ADDED))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def of(kind: int) -> Column:
        return F.filter(base, lambda s: s["kind"] == kind)

    own = F.array_sort(F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    more = F.transform("added", lambda s: F.struct((s["kind"] + len(personal.KINDS)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(
        F.col("id").alias("doc_id"),
        *(F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(personal.KINDS)),
        F.sha2(joined(own), 256).alias("base_sha256"),
        joined(F.concat(own, F.array_sort(more))).alias("spans"),
    )


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_tool_calls, op2_simhash_groups, op3_vafile_topk, op4_logbilinear, op5_language, op6_line_dedup, op7_toxicity, op8_mixing, op9_decontaminate, op10_secrets, op11_whitening, op12_personal, op13_phrases)}
