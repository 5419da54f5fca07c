"""Readers: tables of text as document IR, source revisions, runs and scripted answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import digest_hex
from docloom.schemas import ANALYSIS_VERSIONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_ir(documents: DataFrame, headings: bool = False, unsupported_every: int = 0) -> DataFrame:
    """doc_id, title (null), language and blocks: a paragraph for each line of the text.

    ``headings``: the first block is a heading; ``unsupported_every``: so many blocks apart one is of another kind."""
    kind = F.lit("paragraph")

    def block(line, i):
        k = kind
        if headings:
            k = F.when(i == 0, F.lit("heading")).otherwise(k)
        if unsupported_every:
            k = F.when(i % unsupported_every == unsupported_every - 1, F.lit("table")).otherwise(k)
        level = F.when(k == "heading", F.lit(1)) if headings else F.lit(None).cast("int")
        return F.struct(k.alias("kind"), level.cast("int").alias("level"), line.alias("text"))

    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return documents.select("doc_id", F.lit(None).cast("string").alias("title"), F.col("lang").alias("language"), F.transform(lines, block).alias("blocks"))


def source_revisions(documents: DataFrame, second_every: int = 10) -> DataFrame:
    """A revision for each document, and a second one, with a line end added, for each ``second_every``-th id."""
    text = F.coalesce("text", F.lit(""))
    first = documents.select("doc_id", F.coalesce("source", F.lit("none")).alias("tenant_ref"), text.alias("content"))
    second = first.where(F.col("doc_id") % second_every == 0).withColumn("content", F.concat("content", F.lit("\n")))
    both = first.unionByName(second)
    return both.select("doc_id", "tenant_ref", F.lit("extractor").alias("owner_context"), F.col("doc_id").cast("string").alias("source_document_id"), F.lit("sha256").alias("content_digest_algorithm"), digest_hex(F.col("content")).alias("content_digest_hex"), F.octet_length("content").cast("long").alias("length_bytes"))


def analysis_identities(sources: DataFrame) -> DataFrame:
    """One run identity for each source revision (source_ref_id)."""
    return sources.withColumns({k: F.lit(v) for k, v in ANALYSIS_VERSIONS.items()})


#: Scripted calls by remainder of the document's id: kinds of the first and the second answer (none: no second script).
SCRIPTS = {0: ("valid", None), 1: ("transient", "valid"), 2: ("empty", "valid"), 3: ("malformed", "malformed"), 4: ("permanent", None), 5: ("far_citation", "valid"), 6: ("oversized", None), 7: ("timeout", "timeout"), 8: ("transient", "empty"), 9: ("malformed", None)}


def scripted_answers(documents: DataFrame, ordinal: int) -> DataFrame:
    """doc_id, ordinal, call_kind (response, transient, permanent, timeout), response, input_tokens, output_tokens,
    provider_request_id, latency_ms of the scripted call with this ordinal; documents without one have no row."""
    names = {k: v[ordinal - 1] for k, v in SCRIPTS.items() if v[ordinal - 1]}
    script = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), (F.col("doc_id") % len(SCRIPTS)).cast("int"))
    answer = lambda index: F.concat(F.lit('{"summary":"doc '), F.col("doc_id").cast("string"), F.lit('","key_points":[{"text":"p","source_block_indexes":[' + index + "]}]}"))
    padding = F.concat(F.lit('{"summary":"'), F.repeat(F.lit("x"), 3000), F.lit('","key_points":[]}'))
    text = F.when(F.col("script") == "valid", answer("0")).when(F.col("script") == "far_citation", answer("999999")).when(F.col("script") == "empty", '{"summary":"","key_points":[]}').when(F.col("script") == "malformed", "{malformed").when(F.col("script") == "oversized", padding)
    kind = F.when(F.col("script").isin("transient", "permanent", "timeout"), F.col("script")).otherwise("response")
    rows = documents.select("doc_id", "n_chars", script.alias("script")).where(F.col("script").isNotNull())
    answered = kind == "response"
    return rows.select("doc_id", F.lit(ordinal).alias("ordinal"), kind.alias("call_kind"), text.alias("response"), F.when(answered, F.expr("n_chars div 4")).alias("input_tokens"), F.when(answered, F.expr("n_chars div 16")).alias("output_tokens"), F.concat_ws("-", F.lit("req"), F.col("doc_id").cast("string"), F.lit(str(ordinal))).alias("provider_request_id"), (F.col("doc_id") % 50 * 10).cast("long").alias("latency_ms"))
