"""Strict validation of JSON answers in four steps, with native VARIANT functions: syntax, structure, decoding, citations.

The session must allow repeated keys in objects (the last one counts), see ``prepare``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.schemas import ANALYSIS, CITATIONS, KEY_POINTS, MAX_U32, POINT_CHARS, SUMMARY_CHARS


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def value_of(column: str) -> Column:
    """The value, if the whole text is one JSON value, else null. Text after a value is passed over by the parser, so
    the text is wrapped in two ways that no trailing text survives."""
    in_object = f"try_parse_json(concat('{{\"k\":', {column}, '}}')) is not null"
    listed = f"try_cast(try_parse_json(concat('[', {column}, ']')) as array<variant>)"
    return F.expr(f"case when {in_object} then element_at(filter(array({listed}), l -> size(l) = 1), 1)[0] end")


def is_json(column: str) -> Column:
    return value_of(column).isNotNull()


def _integer(v: str) -> str:
    """An integer of at least 0 by the schema: 1.0 is one."""
    kind = f"schema_of_variant({v})"
    return f"({kind} = 'BIGINT' and cast({v} as bigint) >= 0 or ({kind} like 'DECIMAL%' or {kind} = 'DOUBLE') and cast({v} as double) >= 0 and cast({v} as double) = floor(cast({v} as double)))"


def _object(v: str, keys: list[str]) -> str:
    names = ", ".join(f"'{k}'" for k in sorted(keys))
    return f"schema_of_variant({v}) like 'OBJECT%' and array_sort(map_keys(try_cast({v} as map<string, variant>))) = array({names})"


def _text(v: str, most: int) -> str:
    return f"schema_of_variant({v}) = 'STRING' and char_length(cast({v} as string)) between 1 and {most}"


def _list(v: str, most: int) -> str:
    return f"schema_of_variant({v}) like 'ARRAY%' and size(try_cast({v} as array<variant>)) between 1 and {most}"


def has_structure(v: str) -> Column:
    """Whether a JSON value (a VARIANT column) is an answer by the schema."""
    indexes = "try_variant_get(k, '$.source_block_indexes', 'variant')"
    point = f"{_object('k', ['text', 'source_block_indexes'])} and {_text('''variant_get(k, '$.text')''', POINT_CHARS)} and {_list(indexes, CITATIONS)} and forall(try_cast({indexes} as array<variant>), i -> coalesce({_integer('i')}, false))"
    points = f"variant_get({v}, '$.key_points')"
    whole = f"{_object(v, ['summary', 'key_points'])} and {_text(f'''variant_get({v}, '$.summary')''', SUMMARY_CHARS)} and {_list(points, KEY_POINTS)} and forall(try_cast({points} as array<variant>), k -> coalesce({point}, false))"
    return F.expr(f"coalesce({whole}, false)")


def can_decode(value: str) -> Column:
    """Of a structured answer: every index is written as an integer of 32 bits without sign."""
    points = f"try_cast(variant_get({value}, '$.key_points') as array<variant>)"
    one = f"schema_of_variant(i) = 'BIGINT' and cast(i as bigint) <= {MAX_U32}"
    return F.expr(f"coalesce(forall({points}, k -> forall(try_cast(variant_get(k, '$.source_block_indexes') as array<variant>), i -> coalesce({one}, false))), false)")


def decoded(value: str) -> Column:
    return F.expr(f"try_cast({value} as {ANALYSIS})")


def cites_well(analysis: str, included: str) -> Column:
    """No index twice in a key point, and none outside the included blocks."""
    point = f"size(array_distinct(k.source_block_indexes)) = size(k.source_block_indexes) and size(array_except(k.source_block_indexes, {included})) = 0"
    return F.expr(f"coalesce(forall({analysis}.key_points, k -> {point}), false)")


def validated(answers: DataFrame, response: str = "response", included: str = "included_block_indexes", code: str = "validation_code", analysis: str = "analysis") -> DataFrame:
    """``answers`` with ``code`` (null: accepted) and ``analysis`` (of an accepted answer).

    The steps go from one to the next by column, so a later one looks only at what passed those before."""
    prepare(answers.sparkSession)
    syntax = answers.withColumn("_json", value_of(response))
    structure = syntax.withColumn("_structured", F.when(has_structure("_json"), F.col("_json")))
    typed = structure.withColumn("_typed", F.when(can_decode("_structured"), decoded("_structured")))
    found = F.when(F.col("_json").isNull(), "json_syntax").when(F.col("_structured").isNull(), "schema").when(F.col("_typed").isNull(), "decode").when(~cites_well("_typed", included), "citation")
    out = typed.withColumn(code, found)
    return out.withColumn(analysis, F.when(F.col(code).isNull(), F.col("_typed"))).drop("_json", "_structured", "_typed")
