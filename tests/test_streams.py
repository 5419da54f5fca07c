"""Stream joins and timers, fed in several triggers: late rows, answers that never come, state that goes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.streaming import streams

ASKED, GIVEN = "subject long, request_id long, requested_at timestamp", "subject long, answer_id long, answered_at timestamp"
START = 1_000_000
MOVES = "run_id long, ts timestamp, seq long, to_state string"


def put(spark, folder, schema, rows, at):
    """One more file; ``at`` names the column that is told in minutes from START."""
    names = [c.split()[0] for c in schema.split(", ")]
    when = names.index(at)
    rows = [tuple(60.0 * (v + START) if i == when and v is not None else v for i, v in enumerate(r)) for r in rows]
    plain = schema.replace(f"{at} timestamp", f"{at} double")
    spark.createDataFrame(rows, plain).withColumn(at, F.timestamp_seconds(at)).select(*names).coalesce(1).write.mode("append").parquet(folder)


def kept(spark, root, **options):
    return spark.read.format("statestore").options(**options).load(f"{root}/checkpoint").count()


def test_requests_meet_answers_over_triggers(spark, tmp_path):
    asked, given, out = (f"file://{tmp_path}/{n}" for n in ("asked", "given", "out"))

    def run():
        a, b = spark.readStream.schema(ASKED).parquet(asked), spark.readStream.schema(GIVEN).parquet(given)
        rows = streams.drained(streams.answered(a, b, "1 hour", "30 minutes"), "append", path=out).collect()
        return sorted((tuple(r) for r in rows), key=str)

    put(spark, asked, ASKED, [(1, 10, 0), (1, 11, 50), (2, 12, 5), (None, 13, 5)], "requested_at")
    put(spark, given, GIVEN, [(1, 90, 60), (1, 91, 60.5), (3, 92, 10), (None, 93, 6)], "answered_at")
    pairs = [(10, 90, 3_600_000), (11, 90, 600_000), (11, 91, 630_000)]  # 91 is half a minute too late for 10
    assert run() == pairs
    put(spark, asked, ASKED, [(4, 14, 400)], "requested_at")
    put(spark, given, GIVEN, [(2, 94, 64), (9, 95, 400)], "answered_at")  # a later trigger still finds its request
    pairs += [(12, 94, 3_540_000)]
    assert run() == sorted([*pairs, (13, None, None)], key=str)  # nothing answers a null subject
    put(spark, asked, ASKED, [(2, 15, 10)], "requested_at")  # behind both watermarks: dropped, not unanswered
    put(spark, given, GIVEN, [(1, 96, 20), (4, 97, 420)], "answered_at")
    pairs += [(14, 97, 1_200_000)]
    assert run() == sorted([*pairs, (13, None, None)], key=str)
    put(spark, asked, ASKED, [(9, 16, 10_000)], "requested_at")
    put(spark, given, GIVEN, [(9, 98, 20_000)], "answered_at")
    run()
    assert kept(spark, out, joinSide="left") <= 1 and kept(spark, out, joinSide="right") <= 1


def test_runs_fail_by_their_timer_and_are_forgotten(spark, tmp_path):
    moves, out = (f"file://{tmp_path}/{n}" for n in ("moves", "out"))

    def run():
        with streams.rocksdb(spark):
            rows = streams.drained(streams.with_deadlines(spark.readStream.schema(MOVES).parquet(moves), 3_600_000, 7_200_000, "10 minutes"), "update", ["run_id"], out)
        return {r.run_id: (r.state, r.moves, r.rejected, r.reason, r.ended_ms and r.ended_ms // 60_000 - START) for r in rows.collect()}

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    put(spark, moves, MOVES, [(1, 0, 1, "context_prepared"), (1, 30, 2, "completed"), (2, 0, 3, "failed"), (2, 1, 4, "queued"), (3, 0, 5, "context_prepared"), (3, 55, 6, "model_requested"), (3, 50, 7, "schema_validated")], "ts")
    assert run() == {1: ("context_prepared", 1, 1, None, None), 2: ("failed", 1, 1, "move", 0), 3: ("model_requested", 2, 1, None, None)}
    with streams.rocksdb(spark):
        assert kept(spark, out, stateVarName="run") == 3
    put(spark, moves, MOVES, [(3, 100, 8, "response_received"), (4, 100, 9, "queued")], "ts")  # the mark is at 90: run 1 was due at 60
    now = run()
    assert now[1] == ("failed", 1, 1, "deadline", 60) and now[3] == ("response_received", 3, 1, None, None) and now[4][:2] == ("queued", 0)
    put(spark, moves, MOVES, [(1, 101, 10, "model_requested"), (3, 161, 11, "schema_validated")], "ts")  # too late for 1 and, by a minute, for 3
    now = run()
    assert now[1] == ("failed", 1, 2, "deadline", 60) and now[3] == ("failed", 3, 2, "deadline", 160)
    put(spark, moves, MOVES, [(5, 1000, 12, "context_prepared")], "ts")
    now = run()
    assert now[4] == ("failed", 0, 1, "deadline", 160) and now[5] == ("context_prepared", 1, 0, None, None)
    put(spark, moves, MOVES, [(5, 1010, 13, "model_requested")], "ts")  # what is over for good leaves the state
    run()
    with streams.rocksdb(spark):
        assert kept(spark, out, stateVarName="run") == 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_runs_of_a_bucket_share_calls_but_not_timers(spark, tmp_path):
    moves, out = (f"file://{tmp_path}/{n}" for n in ("moves", "out"))

    def run():
        with streams.rocksdb(spark):
            rows = streams.drained(streams.with_deadlines(spark.readStream.schema(MOVES).parquet(moves), 3_600_000, 7_200_000, "10 minutes", buckets=2), "update", ["run_id"], out)
        return {r.run_id: (r.state, r.moves, r.rejected, r.reason, r.ended_ms and r.ended_ms // 60_000 - START) for r in rows.collect()}

    first = [(i, i, i, "context_prepared") for i in range(60)] + [(None, 59, None, "context_prepared"), (None, 59, 99, "completed")]
    put(spark, moves, MOVES, first, "ts")
    assert run() == {i: ("context_prepared", 1, 0 if i is not None else 1, None, None) for i in [*range(60), None]}
    with streams.rocksdb(spark):
        state = spark.read.format("statestore").options(stateVarName="run").load(f"{out}/checkpoint")
        assert (state.count(), state.select("key").distinct().count()) == (61, 2)
    put(spark, moves, MOVES, [(50, 100, 100, "model_requested")], "ts")  # the mark is at 90: runs up to 30 are over
    now = run()
    assert all(now[i] == (("failed", 1, 0, "deadline", i + 60) if i <= 30 else ("context_prepared", 1, 0, None, None)) for i in range(60) if i != 50)
    assert now[50] == ("model_requested", 2, 0, None, None) and now[None] == ("context_prepared", 1, 1, None, None)
    put(spark, moves, MOVES, [(10, 101, 101, "model_requested"), (99, 250, 102, "queued")], "ts")  # the mark is at 240
    now = run()
    assert now[10] == ("failed", 1, 1, "deadline", 70) and now[50] == ("failed", 2, 0, "deadline", 160) and now[None][3:] == ("deadline", 119)
    put(spark, moves, MOVES, [(99, 260, 103, "queued")], "ts")
    run()
    with streams.rocksdb(spark):  # runs that ended up to 120 minutes before the mark are forgotten: 60 to 119 and None
        assert sorted(r.run for r in spark.read.format("statestore").options(stateVarName="run").load(f"{out}/checkpoint").selectExpr("list_element.run_id as run").collect()) == [50, 99]


@pytest.mark.parametrize("query", [streams.request_answers, streams.run_deadlines])
def test_streams_of_no_events(spark, sf_dir, tmp_path, query):
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(0).write.parquet(f"file://{tmp_path}/events.parquet")
    assert query(spark, f"file://{tmp_path}").count() == 0
