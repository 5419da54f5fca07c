"""Idempotent identities: get-or-create by natural key, guards, and the constraints of the tables as violation queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import key_id, valid_version
from docloom.schemas import ATTEMPT_OUTCOMES, ATTEMPT_REASONS, DIGEST_PATTERN, MAX_ATTEMPTS, OWNER_PATTERN, RUN_KEY, RUN_STATES, SOURCE_KEY


#: Both sides of these joins grow with the tables, so neither is collected at the driver to be sent to all tasks, which
#: Spark does with what is small enough for its threshold.
NOT_SENT = "merge"


def get_or_create(existing: DataFrame, incoming: DataFrame, key: Sequence[str], id_col: str) -> DataFrame:
    """The key, its id and ``created`` for each distinct incoming key: the existing id, or one made of the key.

    Keys with a null part take part in no identity and are left out."""
    asked = incoming.select(*key).dropna().distinct()
    known = existing.select(*key, F.col(id_col).alias("_known"))
    found = asked.join(known.hint(NOT_SENT), list(key), "left")
    return found.select(F.coalesce("_known", key_id(*(F.col(k) for k in key))).alias(id_col), *key, F.col("_known").isNull().alias("created"))


def source_violation(owner: Column, algorithm: Column, digest: Column) -> Column:
    """The first rule that a source breaks, or null."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    return F.when(~ok(owner.rlike(OWNER_PATTERN)), "owner_context").when(~ok(algorithm == "sha256"), "digest_algorithm").when(~ok(digest.rlike(DIGEST_PATTERN)), "digest_hex")


def version_violation(*names: str) -> Column:
    """The first of these columns that isn't a valid version name, or null."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(~valid_version(F.col(n)), F.lit(n)).otherwise(out)
    return out


def request_id_ok(request_id: Column) -> Column:
    return request_id.isNull() | ((F.octet_length(request_id) > 0) & (F.octet_length(request_id) <= 128))


def repeated_keys(table: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    return table.groupBy(*key).count().where("count > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *key).alias("at"))


def missing_parent(child: DataFrame, parent: DataFrame, column: str, rule: str) -> DataFrame:
    return child.join(parent.select(column).distinct().hint(NOT_SENT), column, "left_anti").select(F.lit(rule).alias("rule"), F.col(column).alias("at")).distinct()


def wrong_policies(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """Attempts of known runs that carry another model policy than their run."""
    known = runs.select("run_id", "model_policy").distinct()
    return attempts.join(known.select("run_id").distinct().hint(NOT_SENT), "run_id", "left_semi").join(known.hint(NOT_SENT), ["run_id", "model_policy"], "left_anti")


def constraint_violations(sources: DataFrame, runs: DataFrame, attempts: DataFrame, outputs: DataFrame) -> DataFrame:
    """(rule, at) for each violation in the four tables; no row means that all rules hold. outputs: run_id, result
    (JSON text), accepted."""
    parsed = "try_parse_json(result)"
    states = runs.where(~F.col("state").isin(RUN_STATES)).select(F.lit("run_state").alias("rule"), F.col("run_id").alias("at"))
    bad = ~F.col("ordinal").between(1, MAX_ATTEMPTS) | ~F.col("reason").isin(ATTEMPT_REASONS) | ~F.col("outcome").isin(ATTEMPT_OUTCOMES) | (F.coalesce("input_tokens", F.lit(0)) < 0) | (F.coalesce("output_tokens", F.lit(0)) < 0) | F.col("provider").isNull() | ~F.coalesce(request_id_ok(F.col("provider_request_id")), F.lit(True))
    found = [
        repeated_keys(sources, SOURCE_KEY, "source_key"),
        repeated_keys(runs, RUN_KEY, "run_key"),
        repeated_keys(attempts, ["run_id", "ordinal"], "attempt_key"),
        repeated_keys(outputs.where("accepted"), ["run_id"], "one_accepted_output"),
        missing_parent(runs, sources, "source_ref_id", "run_source"),
        missing_parent(attempts, runs, "run_id", "attempt_run"),
        missing_parent(outputs, runs, "run_id", "output_run"),
        states,
        wrong_policies(attempts, runs).select(F.lit("attempt_policy").alias("rule"), F.concat_ws("|", "run_id", "ordinal").alias("at")),
        outputs.where(f"{parsed} is null or schema_of_variant({parsed}) not like 'OBJECT<%'").select(F.lit("output_object").alias("rule"), F.col("run_id").alias("at")),
        attempts.where(bad).select(F.lit("attempt_values").alias("rule"), F.concat_ws("|", "run_id", "ordinal").alias("at")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
