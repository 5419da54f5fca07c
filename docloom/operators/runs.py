"""A run of at most two calls as a fixed plan: call, classify, call again where that helps, classify, end.

Calls come as DataFrames (run_id and CALL), one for each ordinal: a scripted provider's or a real one's answers. The budget of two is a constant, so the loop is unrolled into two joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.answers import validated
from docloom.operators.identity import NOT_SENT

ATTEMPT = ["run_id", "ordinal", "reason", "provider", "model_policy", "provider_request_id", "outcome", "validation_code", "error", "stored", "input_tokens", "output_tokens", "latency_ms", "response", "analysis"]
CALL = ["call_kind", "response", "input_tokens", "output_tokens", "provider_request_id", "latency_ms"]


def judged(called: DataFrame, ordinal: int, response_bytes: int, timeout_ms: int) -> DataFrame:
    """``called`` with attempt_<ordinal>: what came of the call in the columns <name>_<ordinal>; no call is exhausted.

    A response is stored before it is looked at, unless it is over ``response_bytes``: then the attempt has failed for
    good. A call that took longer than ``timeout_ms`` is a timeout, whatever it brought. Timeouts and transient failures
    may be retried, invalid answers repaired."""
    col = lambda name: F.col(f"{name}_{ordinal}")
    late = F.coalesce(col("latency_ms") > timeout_ms, F.lit(False))
    kind = F.when(late, "timeout").otherwise(F.coalesce(col("call_kind"), F.lit("exhausted")))
    stored = F.coalesce((kind == "response") & (F.octet_length(col("response")) <= response_bytes), F.lit(False))
    checked = validated(called.withColumn("_answer", F.when(stored, col("response"))), "_answer", code="_code", analysis="_analysis")
    bad = F.col("_code").isNotNull()
    outcome = F.when(kind.isin("timeout", "transient"), "transient_failure").when(~stored, "permanent_failure").when(bad, "invalid").otherwise("accepted")
    error = F.when(kind != "response", kind).when(~stored, "blob").when(bad, "invalid")
    parts = [outcome.alias("outcome"), F.when(stored, F.col("_code")).alias("validation_code"), error.alias("error"), stored.alias("stored"), *(col(c).alias(c) for c in CALL[2:]), col("response").alias("response"), F.col("_analysis").alias("analysis")]
    return checked.withColumn(f"attempt_{ordinal}", F.struct(F.lit(ordinal).cast("smallint").alias("ordinal"), *parts)).drop("_answer", "_code", "_analysis")


def run_attempts(contexts: DataFrame, first: DataFrame, second: DataFrame, response_bytes: int, timeout_ms: int) -> DataFrame:
    """ATTEMPT rows of the runs in ``contexts`` (run_id, included_block_indexes, provider, model_policy), all of them
    queued. An attempt carries its run's provider and policy.

    Both calls meet a run in one row, so contexts and calls are read once; the second counts only after a first that
    may be retried or repaired."""
    called = contexts.select("run_id", "included_block_indexes", "provider", "model_policy")
    for ordinal, calls in ((1, first), (2, second)):
        called = called.join(calls.select("run_id", *(F.col(c).alias(f"{c}_{ordinal}") for c in CALL)).hint(NOT_SENT), "run_id", "left")
    both = judged(judged(called, 1, response_bytes, timeout_ms), 2, response_bytes, timeout_ms)
    one = F.col("attempt_1.outcome")
    with_reason = lambda ordinal, reason: F.struct(reason.alias("reason"), F.col(f"attempt_{ordinal}").alias("a"))
    again = one.isin("transient_failure", "invalid")
    made = F.when(again, F.array(with_reason(1, F.lit("initial")), with_reason(2, F.when(one == "invalid", "repair").otherwise("retry")))).otherwise(F.array(with_reason(1, F.lit("initial"))))
    rows = both.select("run_id", "provider", "model_policy", F.explode(made).alias("m")).select("run_id", "provider", "model_policy", "m.reason", "m.a.*")
    return rows.select(*ATTEMPT)


def run_outcomes(attempts: DataFrame) -> DataFrame:
    """run_id, state (completed or failed), attempts, error (of the last attempt) and the accepted analysis."""
    last = F.max_by(F.struct("outcome", "error", "analysis"), "ordinal")
    ended = attempts.groupBy("run_id").agg(F.count(F.lit(1)).alias("attempts"), last.alias("last"))
    done = F.col("last.outcome") == "accepted"
    return ended.select("run_id", F.when(done, "completed").otherwise("failed").alias("state"), "attempts", F.when(~done, F.col("last.error")).alias("error"), F.when(done, F.col("last.analysis")).alias("analysis"))


def state_log(attempts: DataFrame) -> DataFrame:
    """run_id, seq, to_state: the moves that the attempts made."""
    o, last = F.col("outcome"), F.col("ordinal") == 2
    start = F.when(last & (F.col("reason") == "retry"), F.array()).when(last, F.array(F.lit("model_requested"))).otherwise(F.array(F.lit("context_prepared"), F.lit("model_requested")))
    accepted = F.array(*(F.lit(s) for s in ("response_received", "schema_validated", "persisted", "completed")))
    invalid = F.when(last, F.array(F.lit("response_received"), F.lit("failed"))).otherwise(F.array(F.lit("response_received"), F.lit("repaired")))
    end = F.when(o == "accepted", accepted).when(o == "invalid", invalid).when((o == "transient_failure") & ~last, F.array().cast("array<string>")).otherwise(F.array(F.lit("failed")))
    moves = attempts.select("run_id", "ordinal", F.posexplode(F.concat(start.cast("array<string>"), end)).alias("i", "to_state"))
    return moves.select("run_id", (F.col("ordinal") * 100 + F.col("i")).cast("long").alias("seq"), "to_state")


def resumable(runs: DataFrame, outputs: DataFrame) -> DataFrame:
    """run_id, state, result of each run: a persisted or completed run with an accepted output gives it back without a
    call and is completed; others have no result. The right side is filtered before the join, so no run is lost."""
    accepted = outputs.where("accepted").select("run_id", "result")
    both = runs.join(accepted, "run_id", "left")
    back = F.col("state").isin("persisted", "completed") & F.col("result").isNotNull()
    return both.select("run_id", F.when(back, "completed").otherwise(F.col("state")).alias("state"), F.when(back, F.col("result")).alias("result"), back.alias("replayed"))
