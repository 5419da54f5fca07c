"""Corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
Every stage but the last keeps the columns of documents, and any others, and drops rows: texts without a language that
was learned, all but the last of equal texts, all but one of each group of near duplicates, and texts that hold a
benchmark item. An empty table stays empty in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from docloom.llm._shared import staged
from docloom.llm.queries import table, word_bpe


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and letterless texts go, and those that score less than nearly all labelled held-out rows; a null lang is no
    fault."""
    return language_id.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are equal; of equal texts the largest doc_id stays (null is the smallest), of repeated rows
    one."""
    return exact_dedup.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row of the smallest doc_id stays; texts without words are in no group and stay;
    rows that repeat id and text stay or go together."""
    return jaccard_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts hold nothing and stay; null and empty items are in no text; repeated rows are judged
    alike."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row's text; null text is empty and has one piece; repeated rows and null ids are
    packed like any other; other columns are left out."""
    return packing.pack(docs, word_bpe(), capacity=4096, end_id=1, keep_ids=False)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Language ID, alignment and tokens are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i + 1 < len(STAGES):
            out, _ = staged(out, f"pipeline-{name.replace(' ', '-')}")
    return out
