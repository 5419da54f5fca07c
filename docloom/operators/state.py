"""The run state machine: compare-and-set moves, replay of logs, attempt ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.schemas import LEGAL_EDGES, MAX_ATTEMPTS, RUN_STATES


def is_legal(from_state: Column, to_state: Column) -> Column:
    return F.coalesce(F.concat_ws(">", from_state, to_state).isin([f"{a}>{b}" for a, b in LEGAL_EDGES]), F.lit(False))


def compare_and_set(states: DataFrame, proposals: DataFrame, order: str | None = None, part: int = 256) -> DataFrame:
    """Of (run_id, state) and (run_id, expected_state, to_state): run_id, state after the proposal, changed, one row for
    each proposal (with its ``order``, if that is named).

    A proposal moves a run if its edge is legal and the run is in the expected state when its turn comes: proposals of a
    run are made one after the other by ``order`` (whole numbers), those of equal order by their states' names, so of
    several that expect one state the first wins. Proposals equal in all columns are one. A run without a state changes
    nothing. Stretches of ``part`` numbers are folded from every state at once and then once more from the state in which
    they begin, so a run with most of the proposals is no single row's work."""
    seq = F.col(order).cast("long") if order else F.lit(0).cast("long")
    asked = proposals.select("run_id", seq.alias("seq"), "expected_state", "to_state").distinct()
    stretches = asked.groupBy("run_id", F.floor(F.col("seq") / part).alias("part")).agg(F.sort_array(F.collect_list(F.struct("seq", "expected_state", "to_state"))).alias("moves"))
    stretches = stretches.withColumn("moves", F.transform("moves", lambda m: F.struct(m["seq"].alias("seq"), m["expected_state"].alias("from"), m["to_state"].alias("to"), is_legal(m["expected_state"], m["to_state"]).alias("legal"))))
    names = F.array(*(F.lit(s) for s in RUN_STATES))
    makes = lambda state, m: F.coalesce(m["legal"] & (state == m["from"]), F.lit(False))
    after = lambda state, m: F.when(makes(state, m), m["to"]).otherwise(state)
    ends = stretches.select("run_id", "part", F.transform(names, lambda s: F.aggregate("moves", s, after)).alias("ends"))
    runs = ends.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("part", "ends"))).alias("parts")).join(states.select("run_id", "state"), "run_id")
    begin = F.struct(F.col("state").alias("state"), F.expr("cast(array() as array<struct<part: bigint, state: string>>)").alias("starts"))

    def follow(acc: Column, p: Column) -> Column:
        end = F.coalesce(F.get(p["ends"], F.array_position(names, acc["state"]).cast("int") - 1), acc["state"])
        return F.struct(end.alias("state"), F.concat(acc["starts"], F.array(F.struct(p["part"].alias("part"), acc["state"].alias("state")))).alias("starts"))

    starts = runs.select("run_id", F.explode(F.aggregate("parts", begin, follow)["starts"]).alias("s")).select("run_id", F.col("s.part").alias("part"), F.col("s.state").alias("start"))
    none = F.expr("cast(array() as array<struct<seq: bigint, state: string, changed: boolean>>)")

    def made(acc: Column, m: Column) -> Column:
        row = F.struct(m["seq"].alias("seq"), after(acc["state"], m).alias("state"), makes(acc["state"], m).alias("changed"))
        return F.struct(after(acc["state"], m).alias("state"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    both = stretches.join(starts, ["run_id", "part"], "left")
    rows = both.select("run_id", F.explode(F.aggregate("moves", F.struct(F.col("start").alias("state"), none.alias("rows")), made)["rows"]).alias("r"))
    return rows.select("run_id", *([F.col("r.seq").alias(order)] if order else []), "r.state", "r.changed")


def replayed(log: DataFrame, part: int = 4096) -> DataFrame:
    """Of (run_id, seq, to_state): run_id, state, moves, rejected: each run's log applied in order from queued.

    A stretch of a log is a function from states to states. Stretches of ``part`` numbers are folded from every state
    at once, then a run's stretches are applied one after the other, so a long log is no single row's work."""
    states = F.array(*(F.lit(s) for s in RUN_STATES))
    start = F.transform(states, lambda s: F.struct(s.alias("start"), s.alias("state"), F.lit(0).cast("long").alias("moves"), F.lit(0).cast("long").alias("rejected")))

    def step(acc: Column, to: Column) -> Column:
        def one(x: Column) -> Column:
            ok = is_legal(x["state"], to)
            return F.struct(x["start"].alias("start"), F.when(ok, to).otherwise(x["state"]).alias("state"), (x["moves"] + ok.cast("long")).alias("moves"), (x["rejected"] + (~ok).cast("long")).alias("rejected"))

        return F.transform(acc, one)

    parts = log.groupBy("run_id", F.floor(F.col("seq") / part).alias("part")).agg(F.sort_array(F.collect_list(F.struct("seq", "to_state"))).alias("moves"))
    folded = parts.select("run_id", "part", F.aggregate(F.col("moves.to_state"), start, step).alias("table"))
    runs = folded.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("part", "table"))).alias("parts"))
    begin = F.struct(F.lit("queued").alias("state"), F.lit(0).cast("long").alias("moves"), F.lit(0).cast("long").alias("rejected"))

    def follow(acc: Column, p: Column) -> Column:
        hit = F.filter(p["table"], lambda t: t["start"] == acc["state"])[0]
        return F.struct(hit["state"].alias("state"), (acc["moves"] + hit["moves"]).alias("moves"), (acc["rejected"] + hit["rejected"]).alias("rejected"))

    return runs.select("run_id", F.aggregate("parts", begin, follow).alias("r")).select("run_id", "r.state", "r.moves", "r.rejected")


def settled(attempts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Of attempts and outcomes (run_id, ordinal, outcome): each attempt's outcome after and whether it changed. Only an
    attempt that is requested takes an outcome, so a second report changes nothing; reports of unknown attempts are
    passed over."""
    told = outcomes.select("run_id", "ordinal", F.col("outcome").alias("_told"))
    both = attempts.join(told, ["run_id", "ordinal"], "left")
    changed = F.coalesce((F.col("outcome") == "requested") & F.col("_told").isNotNull(), F.lit(False))
    return both.select("run_id", "ordinal", F.when(changed, F.col("_told")).otherwise(F.col("outcome")).alias("outcome"), changed.alias("changed"))


def next_ordinals(runs: DataFrame, attempts: DataFrame) -> DataFrame:
    """run_id, next_ordinal and within_budget for each run."""
    last = attempts.groupBy("run_id").agg(F.max("ordinal").alias("last"))
    following = F.coalesce(F.col("last"), F.lit(0)) + 1
    return runs.select("run_id").join(last, "run_id", "left").select("run_id", following.cast("int").alias("next_ordinal"), (following <= MAX_ATTEMPTS).alias("within_budget"))
