"""Structured Streaming over the events table: windows, inbox dedup, sessions, requests joined with their answers, the
live run state machine and deadlines of runs.

Each function reads the events as a file stream, runs until all of it is processed and returns what the sink holds."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docloom.schemas import LEGAL_EDGES, RUN_STATES
from docloom.sources.stage import work_path
from docloom.sources.store import _exists


#: Files that a trigger takes: the bound of a batch.
FILES = 64


def is_folder(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(found).isDirectory()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with ts as a timestamp, which a watermark needs."""
    path = f"{sf_dir}/events.parquet"
    files = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", FILES)
    # a stream reads folders: a table that is one file is picked out of its folder
    rows = files.parquet(path) if is_folder(spark, path) else files.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, key: list[str] | None = None, path: str | None = None) -> DataFrame:
    """What the query has written when its input is used up. A batch's rows go to a folder of its number, so a repeated
    batch replaces itself; of updated rows with a ``key``, the last one counts. Nothing read, nothing returned. With the ``path`` of an earlier call it
    goes on from there."""
    spark, root = stream.sparkSession, path or work_path(stream.sparkSession, "stream")
    out = f"{root}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if not _exists(spark, out):  # no file has come yet
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(f"{stream.schema.toDDL()}, batch long").option("basePath", out).parquet(out)
    if key is None:
        return rows.select(*stream.columns)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r"))
    return last.select("r.*")


def count_windows(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """window_start, event_type, n, total (value in thousandths) of each hour, to be written in update mode: an hour's
    state goes once no event of it can come within ``lateness``; later ones are dropped."""
    counted = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("total"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(count_windows(event_stream(spark, sf_dir)), "update", ["window_start", "event_type"])


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (user_id, event_type) once, however often and however late it is delivered again: state drops copies within
    60 days, and what is written is one row a key over all batches."""
    seen = event_stream(spark, sf_dir).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    key = ["user_id", "event_type"]
    return drained(seen.select(*key), "append", key)


def close_sessions(events: DataFrame, gap: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """user_id, session_start, session_end, n: a user's events no more than ``gap`` apart, to be appended once a session
    has ended and no event of it can come within ``lateness``."""
    grouped = events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), F.date_format("s.end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_end"), "n")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are over for good: those of the last day may still grow and aren't shown."""
    return drained(close_sessions(event_stream(spark, sf_dir)), "append")


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, state, moves, rejected: each user's events as moves of a run, in order, with the state kept by key."""
    legal = set(LEGAL_EDGES)

    def step(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state, moves, rejected = held.get if held.exists else ("queued", 0, 0)
        rows = pd.concat(list(frames)).sort_values("seq")  # one trigger's events of one run, at most FILES files'
        for to in rows["to_state"]:
            if (state, to) in legal:
                state, moves = to, moves + 1
            else:
                rejected += 1
        held.update((state, moves, rejected))
        yield pd.DataFrame({"run_id": [key[0]], "state": [state], "moves": [moves], "rejected": [rejected]})

    names = F.array(*(F.lit(s) for s in RUN_STATES))
    moves = event_stream(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") * 7 % 9 + 1).cast("int")).alias("to_state"))
    live = moves.groupBy("run_id").applyInPandasWithState(step, "run_id long, state string, moves long, rejected long", "state string, moves long, rejected long", "update", "NoTimeout")
    out = drained(live, "update")
    return out.groupBy("run_id").agg(F.max_by(F.struct("state", "moves", "rejected"), F.col("moves") + F.col("rejected")).alias("r")).select("run_id", "r.state", "r.moves", "r.rejected")


def answered(requests: DataFrame, answers: DataFrame, within: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """request_id, answer_id, waited_ms: each request (subject, request_id, requested_at) with every answer (subject,
    answer_id, answered_at) to its subject that comes ``within`` that time after it; a request that none can answer any
    more comes once, with nulls. Both sides may be late by ``lateness``: later rows are dropped, and a side's rows leave
    the state once the other side's watermark shows that nothing can meet them, so state holds ``within`` plus
    ``lateness`` of each stream. A null subject is answered by nothing."""
    a = requests.withWatermark("requested_at", lateness).withColumnRenamed("subject", "_subject")
    b = answers.withWatermark("answered_at", lateness)
    meet = F.expr(f"_subject = subject and answered_at >= requested_at and answered_at <= requested_at + interval {within}")
    waited = F.unix_millis("answered_at") - F.unix_millis("requested_at")
    return a.join(b, meet, "left_outer").select("request_id", "answer_id", waited.alias("waited_ms"))


def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as requests and the same user's purchases of the next hour as their answers. Requests that could still be
    answered when the input ends are not shown yet."""
    events = lambda kind, name, at: event_stream(spark, sf_dir).where(F.col("event_type") == kind).select(F.col("user_id").alias("subject"), F.col("event_id").alias(name), F.col("ts").alias(at))
    return drained(answered(events("view", "request_id", "requested_at"), events("purchase", "answer_id", "answered_at")), "append")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of many variables and timers needs this store; the session's setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


LIVE = "state string, moves long, rejected long, reason string, ended_ms long"
#: Parts of the runs' state. A part is read and written whole, in a few calls, where a run each would take as many.
BUCKETS = 4096


class Deadlines(StatefulProcessor):
    """Runs' states with timers: without a legal move for ``deadline_ms`` a run fails, whether by the next move, which
    comes too late, or by the watermark. An ended run is kept for ``keep_ms`` to reject what still comes, then forgotten.

    The key is a bucket of runs. Its state is a list of them, its timer the first of theirs."""

    def __init__(self, deadline_ms: int, keep_ms: int, id_type: str) -> None:
        self.deadline_ms, self.keep_ms, self.id_type = deadline_ms, keep_ms, id_type
        self.legal = set(LEGAL_EDGES)
        self.open = {a for a, _ in LEGAL_EDGES}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getListState("run", f"run_id {self.id_type}, {LIVE}, due_ms long")

    def held(self) -> dict:
        return {r[0]: list(r[1:]) for r in self.run.get()} if self.run.exists() else {}

    def next(self, run: list) -> int:
        return run[5] if run[3] is None else run[4] + self.keep_ms

    def hold(self, runs: dict) -> int | None:
        """Writes the bucket; the time of its timer."""
        if not runs:
            self.run.clear()
            return None
        self.run.put([(name, *run) for name, run in runs.items()])
        return min(map(self.next, runs.values()))

    def row(self, name, run: list) -> Row:
        return Row(**dict(zip(["run_id", *(c.split()[0] for c in LIVE.split(", "))], [name, *run[:5]], strict=True)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        mark, runs, moved = timerValues.getCurrentWatermarkInMs(), self.held(), {}
        moves = sorted(((r["at_ms"], r["seq"], r["run_id"], r["to_state"]) for r in rows), key=lambda m: (m[0], m[1] is None, m[1]))  # one trigger's moves of one bucket
        for at, _, name, to in moves:
            run = runs.setdefault(name, ["queued", 0, 0, None, None, at + self.deadline_ms])
            moved[name] = run
            if run[3] is None and at > run[5]:
                run[0], run[3], run[4] = "failed", "deadline", run[5]
            if run[3] is None and (run[0], to) in self.legal:
                run[0], run[1], run[5] = to, run[1] + 1, at + self.deadline_ms
                if to not in self.open:
                    run[3], run[4] = "move", at
            else:
                run[2] += 1
        for name, run in moved.items():
            if run[3] is None and run[5] <= mark:  # over already: one row of a run a trigger
                run[0], run[3], run[4] = "failed", "deadline", run[5]
            yield self.row(name, run)
        due = self.hold(runs)
        timers = list(self.handle.listTimers())
        for old in timers:
            if old != due:
                self.handle.deleteTimer(old)
        if due not in timers:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark, runs = timerValues.getCurrentWatermarkInMs(), {}
        for name, run in self.held().items():
            if self.next(run) > mark:
                runs[name] = run
            elif run[3] is None:
                run[0], run[3], run[4] = "failed", "deadline", run[5]
                runs[name] = run
                yield self.row(name, run)
        due = self.hold(runs)
        if due is not None:
            self.handle.registerTimer(due)


def with_deadlines(moves: DataFrame, deadline_ms: int, keep_ms: int, lateness: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """run_id, state, moves, rejected, reason (how the run ended: deadline or move; null while it is open), ended_ms, to
    be written in update mode, of a stream of (run_id, ts, seq, to_state). A run begins with its first move; moves of one
    trigger are taken by time and seq. Moves later than ``lateness`` behind the watermark are dropped, so ``keep_ms`` of
    at least the span of a run's moves beyond its end keeps a run from beginning again. ``buckets`` is fixed for the life
    of a stream; a bucket has to hold its live runs in a task."""
    kind = dict(moves.dtypes)["run_id"]
    late = moves.withWatermark("ts", lateness).select("run_id", "ts", "seq", "to_state", F.unix_millis("ts").alias("at_ms"), F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket"))
    return late.groupBy("bucket").transformWithState(Deadlines(deadline_ms, keep_ms, kind), f"run_id {kind}, {LIVE}", "update", "eventTime")


def run_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of a day as moves of a run that fails after three hours without a legal one."""
    names = F.array(*(F.lit(s) for s in RUN_STATES))
    run_id = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    moves = event_stream(spark, sf_dir).select(run_id.alias("run_id"), "ts", F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") * 7 % 9 + 1).cast("int")).alias("to_state"))
    with rocksdb(spark):
        return drained(with_deadlines(moves, 3 * 3_600_000, 2 * 86_400_000), "update", ["run_id"])
