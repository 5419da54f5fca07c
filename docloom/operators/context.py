"""Context packing: whole blocks of a document, in order, under a character budget.

Everything is a narrow projection: rendered lengths are folded in the row to the number of blocks that fit, which says
all, because what is included is always a prefix."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import json_string
from docloom.schemas import ANALYSIS_VERSIONS, MAX_U32, SYSTEM_POLICY, TASK_INSTRUCTION, output_schema


def header(title: Column, language: Column) -> Column:
    return F.concat(F.lit("title: "), json_string(title), F.lit("\nlanguage: "), json_string(language), F.lit("\n"))


def rendered_block(index: Column, block: Column) -> Column:
    """A heading's or paragraph's line; null for any other kind."""
    start = F.concat(F.lit("block "), index.cast("string"))
    end = F.concat(F.lit(": "), json_string(F.coalesce(block["text"], F.lit(""))), F.lit("\n"))
    heading = F.concat(start, F.lit(" heading "), block["level"].cast("string"), end)
    return F.when(block["kind"] == "heading", heading).when(block["kind"] == "paragraph", F.concat(start, F.lit(" paragraph"), end))


def pack_context(docs: DataFrame, budget: int, most_blocks: int = MAX_U32 + 1) -> DataFrame:
    """``docs`` (title, language, blocks) with source_content, included_block_indexes, omitted_block_indexes,
    character_budget, truncated, used_characters and budget_error.

    The first block that doesn't fit, or is of another kind than heading and paragraph, and all after it are omitted.
    A header over the budget is an error (budget_too_small), and so are more blocks than an index can name
    (too_many_blocks): source_content is null then and no block is included. Null blocks count as none."""
    blocks = F.coalesce(F.col("blocks"), F.array().cast(docs.schema["blocks"].dataType))
    lines = docs.withColumn("_header", header(F.col("title"), F.col("language"))).withColumn("_lines", F.transform(blocks, lambda b, i: rendered_block(i, b)))
    start = F.struct(F.char_length("_header").cast("long").alias("used"), F.lit(0).alias("taken"), ((F.char_length("_header") <= budget) & (F.size("_lines") <= most_blocks)).alias("going"))

    def step(acc: Column, line: Column) -> Column:
        used = acc["used"] + F.coalesce(F.char_length(line), F.lit(0))
        fits = acc["going"] & line.isNotNull() & (used <= budget)
        return F.struct(F.when(fits, used).otherwise(acc["used"]).alias("used"), (acc["taken"] + fits.cast("int")).alias("taken"), fits.alias("going"))

    folded = lines.withColumn("_fold", F.aggregate("_lines", start, step))
    taken, n = F.col("_fold.taken"), F.size("_lines")
    problem = F.when(F.char_length("_header") > budget, "budget_too_small").when(n > most_blocks, "too_many_blocks")
    error = problem.isNotNull()
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>")).cast("array<bigint>")
    out = folded.withColumn("source_content", F.when(~error, F.concat(F.col("_header"), F.array_join(F.slice("_lines", F.lit(1), taken), ""))))
    out = out.withColumn("included_block_indexes", span(F.lit(0), taken)).withColumn("omitted_block_indexes", span(taken, n))
    out = out.withColumn("character_budget", F.lit(budget)).withColumn("truncated", taken < n).withColumn("used_characters", F.when(~error, F.col("_fold.used")))
    return out.withColumn("budget_error", problem).drop("_header", "_lines", "_fold")


def generation_request(contexts: DataFrame) -> DataFrame:
    """The five parts of a request, each a column of its own and never joined together."""
    schema = json.dumps(output_schema(), sort_keys=True, separators=(",", ":"))
    parts = {"prompt_version": F.lit(ANALYSIS_VERSIONS["prompt_version"]), "system_policy": F.lit(SYSTEM_POLICY), "task_instruction": F.lit(TASK_INSTRUCTION), "output_schema": F.lit(schema)}
    return contexts.where(F.col("budget_error").isNull()).withColumns(parts)


def repair_request(requests: DataFrame, code: Column) -> DataFrame:
    """The request again, with the validation code added to the task alone."""
    return requests.withColumn("task_instruction", F.concat(F.col("task_instruction"), F.lit("\nRepair validation code: "), code, F.lit(".")))


def checked_citations(manifest: DataFrame, citations: DataFrame) -> DataFrame:
    """doc_id, block_index, problem of each citation (doc_id, block_index, span_hash): unknown_block, omitted_block or
    changed_span; null if the cited block is in the context and still says what was cited."""
    known = manifest.select("doc_id", "block_index", "included", F.col("span_hash").alias("_hash"))
    both = citations.join(known, ["doc_id", "block_index"], "left")
    problem = F.when(F.col("_hash").isNull(), "unknown_block").when(~F.col("included"), "omitted_block").when(~F.col("_hash").eqNullSafe(F.col("span_hash")), "changed_span")
    return both.select("doc_id", "block_index", problem.alias("problem"))


def context_manifest(contexts: DataFrame) -> DataFrame:
    """doc_id, block_index, included, first_char, span_hash: every block of a packed document, whether the context has
    it, where its line begins there, and the hash of its text, to which a citation can be held."""
    n = F.size("included_block_indexes")
    head = F.char_length(header(F.col("title"), F.col("language"))).cast("long")
    blocks = contexts.select("doc_id", n.alias("taken"), head.alias("head"), F.posexplode("blocks").alias("i", "b"))
    line = rendered_block(F.col("i"), F.col("b"))
    begins = F.expr("sum(chars) over (partition by doc_id order by i) - chars") + F.col("head")
    placed = blocks.withColumn("chars", F.coalesce(F.char_length(line), F.lit(0)).cast("long")).withColumn("begins", begins)
    inside = F.col("i") < F.col("taken")
    return placed.select("doc_id", F.col("i").cast("long").alias("block_index"), inside.alias("included"), F.when(inside, F.col("begins")).alias("first_char"), F.sha2(F.coalesce(F.col("b.text"), F.lit("")), 256).alias("span_hash"))
