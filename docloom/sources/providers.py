"""Providers of answers: one interface for scripted and real ones, which take requests and give calls.

Calls are written before anything is decided from them, so that no plan asks again; a task that is retried or speculated
does. So a request is asked at least once, and carries an idempotency key of its run and ordinal by which an outside
service can tell that it has answered it. What goes to a remote provider is gated first."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import key_id
from docloom.operators.context import repair_request
from docloom.operators.governance import gated, running_totals
from docloom.operators.runs import CALL, judged, run_attempts
from docloom.sources.stage import staged

CALLS = "call_kind string, response string, input_tokens long, output_tokens long, provider_request_id string, latency_ms long"
#: What a provider sees of a request.
REQUEST = ["run_id", "prompt_version", "system_policy", "task_instruction", "output_schema", "source_content"]


class Provider(Protocol):
    name: str
    remote: bool  #: whether requests leave the cluster

    def calls(self, requests: DataFrame, ordinal: int) -> DataFrame:
        """A row of run_id and CALLS for each request that was answered or failed; requests are rows of REQUEST."""


class ScriptedProvider:
    """Gives calls from a table for each ordinal; a request without a row there finds the script exhausted."""

    name, remote = "scripted", False

    def __init__(self, *scripts: DataFrame) -> None:
        self.scripts = scripts

    def calls(self, requests: DataFrame, ordinal: int) -> DataFrame:
        return self.scripts[ordinal - 1].join(requests.select("run_id"), "run_id", "left_semi").select("run_id", *CALL)


def asked_in_time(ask: Callable[[dict], dict | None], requests: Iterable[dict], timeout_ms: int, at_once: int) -> Iterator[tuple[dict, dict | None, int]]:
    """(request, answer, milliseconds) of each request, ``at_once`` of them in flight, in the order of their ends.

    A call without an answer in ``timeout_ms`` ends as a timeout and its place is free: what it brings later is dropped.
    Its thread can't be stopped; it doesn't keep the process alive."""
    done: queue.SimpleQueue = queue.SimpleQueue()
    flying: dict[int, tuple[dict, float]] = {}

    def call(number: int, request: dict) -> None:
        try:
            answer = ask(request)
        except Exception:  # any failure of an outside service may be passing
            answer = {"call_kind": "transient"}
        done.put((number, answer, time.monotonic()))

    waiting, n = iter(requests), 0
    while True:
        while len(flying) < at_once and (request := next(waiting, None)) is not None:
            flying[n] = request, time.monotonic()
            threading.Thread(target=call, args=(n, request), daemon=True).start()
            n += 1
        if not flying:
            return
        oldest = min(flying)
        try:
            number, answer, ended = done.get(timeout=max(0.0, flying[oldest][1] + timeout_ms / 1000 - time.monotonic()))
        except queue.Empty:
            number, answer, ended = oldest, {"call_kind": "timeout"}, time.monotonic()
        if number in flying:
            request, began = flying.pop(number)
            yield request, answer, int((ended - began) * 1000)


class FunctionProvider:
    """Asks ``ask`` for each request (a dict of REQUEST, ordinal and idempotency_key), in the tasks, ``at_once`` requests of
    a task at a time: it returns a dict of call_kind, response, input_tokens, output_tokens and provider_request_id. What
    it raises is a transient failure; None means that there is no answer; one that takes longer than ``timeout_ms`` is
    cut off. The time that it takes is measured."""

    def __init__(self, name: str, ask: Callable[[dict], dict | None], timeout_ms: int = 30_000, at_once: int = 4, remote: bool = True) -> None:
        self.name, self.ask, self.timeout_ms, self.at_once, self.remote = name, ask, timeout_ms, at_once, remote

    def calls(self, requests: DataFrame, ordinal: int) -> DataFrame:
        ask, timeout_ms, at_once = self.ask, self.timeout_ms, self.at_once

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            text, number = pa.string(), pa.int64()
            kinds = dict(zip(CALL, (text, text, number, number, text, number), strict=True))
            for batch in batches:
                each = (request | {"ordinal": ordinal} for request in batch.to_pylist())
                rows = [{"run_id": request["run_id"], "latency_ms": took} | answer for request, answer, took in asked_in_time(ask, each, timeout_ms, at_once) if answer is not None]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([batch.schema.field("run_id"), *kinds.items()]))

        keyed = requests.select(*REQUEST, key_id(F.col("run_id").cast("string"), F.lit(str(ordinal))).alias("idempotency_key"))
        return keyed.mapInArrow(run, f"run_id {requests.schema['run_id'].dataType.simpleString()}, {CALLS}")


def gated_requests(requests: DataFrame, policy: str = "privacy_policy", scope: str | None = None, tokens: int = 0) -> DataFrame:
    """``requests`` as they may go to a remote provider, with estimated_tokens and refused.

    source_content is what the run's policy lets out: whole, redacted, or null, and refused is then privacy. With a
    ``scope`` (a tenant, a model), runs of it are admitted by run_id (whole numbers) while their contents, a token for
    each four characters, come to ``tokens`` at most; the first one over it and all later ones are refused as budget.
    Refused runs keep their row. A policy that is null or unknown lets nothing out; equal run ids are admitted together."""
    sent = gated(requests, policy, "source_content")
    rows = sent.drop("source_content", "index_text").withColumnRenamed("remote_text", "source_content")
    rows = rows.withColumn("estimated_tokens", F.coalesce(F.expr("(char_length(source_content) + 3) div 4"), F.lit(0)))
    private = F.when(F.col("source_content").isNull(), "privacy")
    if scope is None:
        return rows.withColumn("refused", private)
    spent = running_totals(rows, [scope], "run_id", "estimated_tokens")
    out = spent.withColumn("refused", F.coalesce(private, F.when(F.col("running") > tokens, "budget"))).drop("running")
    return out.withColumn("source_content", F.when(F.col("refused").isNull(), F.col("source_content")))


def provided_attempts(requests: DataFrame, provider: Provider, response_bytes: int, timeout_ms: int) -> DataFrame:
    """ATTEMPT rows of queued runs: ``requests`` are rows of REQUEST with included_block_indexes and model_policy.

    The second call is asked for runs whose first one may be retried or repaired; a repair names the validation code.
    A remote provider is only given gated requests (see gated_requests), and of these only such as aren't refused."""
    if "refused" in requests.columns:
        requests = requests.where("refused is null")
    elif provider.remote:
        raise ValueError("requests to a remote provider must be gated: see gated_requests")
    runs = requests.withColumn("provider", F.lit(provider.name))
    first = staged(provider.calls(runs, 1), "calls")
    named = runs.join(first.select("run_id", *(F.col(c).alias(f"{c}_1") for c in CALL)), "run_id", "left")
    tried = judged(named, 1, response_bytes, timeout_ms)
    again = tried.where(F.col("attempt_1.outcome").isin("transient_failure", "invalid"))
    code = F.col("attempt_1.validation_code")
    plain = again.where(code.isNull()).select(*REQUEST)
    repaired = repair_request(again.where(code.isNotNull()), code).select(*REQUEST)
    second = staged(provider.calls(plain.unionByName(repaired), 2), "calls")
    return run_attempts(runs, first, second, response_bytes, timeout_ms)
