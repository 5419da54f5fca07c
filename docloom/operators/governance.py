"""Chunks, privacy, budgets, versions, events, entities, metrics and evaluation around the core."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import key_id, redacted
from docloom.schemas import PRIVACY_POLICIES


def chunked(docs: DataFrame, chars: int) -> DataFrame:
    """doc_id, chunk, first_block, last_block, n_chars, content_hash: lines of a document, in order, by the stretch of
    ``chars`` characters in which they begin."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "line"))
    begin = F.expr("coalesce(sum(char_length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)")
    parts = lines.withColumn("chunk", F.floor(begin / chars).cast("long")).withColumn("i", F.col("i").cast("long"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return parts.groupBy("doc_id", "chunk").agg(F.min("i").alias("first_block"), F.max("i").alias("last_block"), F.sum(F.char_length("line")).alias("n_chars"), F.sha2(text, 256).alias("content_hash"))


def conversation_windows(turns: DataFrame, size: int, stride: int) -> DataFrame:
    """conv_id, first_turn, n_turns, n_chars, roles, content_hash: overlapping windows of a conversation's turns."""
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("turn") - size + 1) / stride)), F.floor(F.col("turn") / stride))
    each = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.explode(starts).alias("w"))
    order = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = each.groupBy("conv_id", (F.col("w") * stride).alias("first_turn")).agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.char_length("text")).alias("n_chars"), order.alias("o"))
    return grouped.select("conv_id", "first_turn", "n_turns", "n_chars", F.array_join(F.col("o.role"), ",").alias("roles"), F.sha2(F.array_join(F.col("o.text"), "\n"), 256).alias("content_hash"))


def privacy_decisions(policy: Column) -> dict[str, Column]:
    """What a policy allows; an unknown or missing one allows nothing."""
    known = F.coalesce(policy.isin(PRIVACY_POLICIES), F.lit(False))
    is_ = lambda *names: F.coalesce(policy.isin(*names), F.lit(False))
    return {
        "may_call_remote": is_("remote_allowed_redacted", "remote_allowed_full"),
        "needs_redaction": is_("remote_allowed_redacted"),
        "may_index_text": is_("local_only", "remote_allowed_redacted", "remote_allowed_full"),
        "may_index_metadata": known & ~is_("excluded"),
    }


def gated(rows: DataFrame, policy: str, text: str) -> DataFrame:
    """``rows`` with remote_text, what may be sent to a remote provider (redacted where the policy asks for it, else
    whole, else null), and index_text, what may be indexed."""
    may = privacy_decisions(F.col(policy))
    sent = F.when(may["may_call_remote"], F.when(may["needs_redaction"], redacted(F.col(text))).otherwise(F.col(text)))
    return rows.withColumn("remote_text", sent).withColumn("index_text", F.when(may["may_index_text"], F.col(text)))


def run_usage(attempts: DataFrame, input_price: int, output_price: int) -> DataFrame:
    """run_id, attempts, repairs, tokens, cost (tokens times prices) and elapsed_ms of each run."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return attempts.groupBy("run_id").agg(F.count(F.lit(1)).alias("attempts"), F.count(F.when(F.col("reason") == "repair", 1)).alias("repairs"), (total("input_tokens") + total("output_tokens")).alias("tokens"), (total("input_tokens") * input_price + total("output_tokens") * output_price).alias("cost"), total("latency_ms").alias("elapsed_ms"))


def budget_decisions(usage: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """``usage`` with broken: the first of the limits, by column, that the row is over; null if none."""
    out = F.lit(None).cast("string")
    for column, most in reversed(limits.items()):
        out = F.when(F.col(column) > most, F.lit(column)).otherwise(out)
    return usage.withColumn("broken", out)


def last_success(runs: DataFrame, scope: str, version: str) -> DataFrame:
    """scope, newest and shown (version) and stale, of (scope, version, state): the newest completed version is shown,
    null if there is none, whatever has failed since."""
    done = F.max(F.when(F.col("state") == "completed", F.col(version)))
    sums = runs.groupBy(scope).agg(F.max(version).alias("newest"), done.alias("shown"))
    return sums.withColumn("stale", F.col("shown").isNotNull() & (F.col("shown") < F.col("newest")))


def running_totals(rows: DataFrame, keys: Sequence[str], order: str, value: str, stretch: int = 10_000) -> DataFrame:
    """``rows`` with running: the sum of ``value`` up to each row by ``order`` (whole numbers), within ``keys``.

    Two levels: stretches of ``order`` are summed first, so a key with most of the rows is dealt to many tasks."""
    cut = rows.withColumn("_s", F.floor(F.col(order) / stretch))
    by = ", ".join(f"`{k}`" for k in keys)
    sums = cut.groupBy(*keys, "_s").agg(F.sum(value).alias("_t"))
    before = sums.selectExpr(*(f"`{k}` as `_k_{k}`" for k in keys), "_s as _p", f"sum(_t) over (partition by {by} order by _s) - _t as _before")
    same = F.col("_s") == F.col("_p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = F.expr(f"sum(`{value}`) over (partition by {by}, _s order by `{order}`)")
    return cut.join(before, same).withColumn("running", inside + F.col("_before")).select(*rows.columns, "running")


def pending_units(wanted: DataFrame, built: DataFrame, key: Sequence[str]) -> DataFrame:
    """What a new index version lacks: the set that a resumed build works on."""
    return wanted.select(*key).join(built.select(*key), list(key), "left_anti")


def active_versions(wanted: DataFrame, built: DataFrame, scope: str, unit: str) -> DataFrame:
    """scope, active_version: the newest version in which each wanted unit is built; a version that isn't complete never
    hides an older one."""
    need = wanted.groupBy(scope).agg(F.countDistinct(unit).alias("need"))
    have = built.join(wanted.select(scope, unit).distinct(), [scope, unit], "left_semi").groupBy(scope, "version").agg(F.countDistinct(unit).alias("have"))
    whole = have.join(need, scope).where("have = need").groupBy(scope).agg(F.max("version").alias("active_version"))
    return need.select(scope).join(whole, scope, "left")


def first_deliveries(events: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first event of each key, whatever is delivered again."""
    return events.groupBy(*key).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("deliveries"))


def outbox(outcomes: DataFrame) -> DataFrame:
    """event_id, subject, run_id, attempts: one event for each ended run, references only, no content."""
    subject = F.when(F.col("state") == "completed", "analysis.completed.v1").otherwise("analysis.failed.v1")
    return outcomes.select(key_id(F.col("run_id"), subject).alias("event_id"), subject.alias("subject"), "run_id", "attempts")


#: Second-level names under which domains are registered, in common country domains.
SECOND_LEVEL = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ac.jp", "co.kr", "co.in", "co.za", "com.br", "com.mx", "com.cn", "com.tr"]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/:?#]+)", 1))


def registered_domain(host: Column) -> Column:
    """The last two labels, or three where the last two are a second-level name."""
    return F.when(F.substring_index(host, ".", -2).isin(SECOND_LEVEL), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def host_entities(pages: DataFrame) -> DataFrame:
    """alias, entity, mentions, addresses: hosts as aliases of their registered domain. The alias stays beside the
    entity, so that a merge can be undone."""
    hosts = pages.select("url", host_of(F.col("url")).alias("alias")).where("alias <> ''")
    return hosts.groupBy("alias", registered_domain(F.col("alias")).alias("entity")).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("url").alias("addresses"))


def host_links(pages: DataFrame) -> DataFrame:
    """source, relation (links_to), target, mentions: what pages of a registered domain link to: another's domain, or a
    path under their own."""
    to = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"?#]+)'), F.lit(1))
    each = pages.select(registered_domain(host_of(F.col("url"))).alias("source"), F.explode(to).alias("to")).where("source <> ''")
    outside = registered_domain(host_of(F.col("to")))
    target = F.when(F.col("to").startswith("/"), F.concat("source", "to")).when(outside != "", outside)
    return each.withColumn("target", target).where("target is not null").groupBy("source", F.lit("links_to").alias("relation"), "target").agg(F.count(F.lit(1)).alias("mentions"))


def merged_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """``entities`` (alias, entity) with merged: where its latest merge (version, entity, into, undone) that isn't
    undone sends it. Aliases and entities stay, so undoing a merge gives the old names back."""
    live = merges.groupBy("entity").agg(F.max_by(F.when(~F.col("undone"), F.col("into")), "version").alias("_into"))
    return entities.join(live, "entity", "left").withColumn("merged", F.coalesce("_into", "entity")).drop("_into")


def attempt_metrics(attempts: DataFrame, scope: str, input_price: int = 0, output_price: int = 0) -> DataFrame:
    """Counts over attempts for each scope and for all of them (scope null)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    last_failed = F.col("outcome").isin("permanent_failure") | (F.col("ordinal") == 2) & (F.col("outcome") != "accepted")
    return attempts.rollup(scope).agg(
        F.count(F.lit(1)).alias("provider_requests"),
        F.countDistinct("run_id").alias("analysis_requests"),
        count(last_failed).alias("analysis_failures"),
        total("latency_ms").alias("analysis_duration_ms"),
        count(F.col("reason") == "repair").alias("repair_attempts"),
        count(F.col("validation_code").isNotNull()).alias("validation_failures"),
        count(F.col("validation_code") == "citation").alias("citation_failures"),
        total(F.col("input_tokens") + F.col("output_tokens")).alias("provider_tokens"),
        (total("input_tokens") * input_price + total("output_tokens") * output_price).alias("provider_cost"),
    )


def index_metrics(documents: DataFrame, embedded: DataFrame, built: DataFrame, results: DataFrame) -> DataFrame:
    """name, value: embedding jobs and documents that wait for one, share of documents in the new index (millionths),
    results that searches gave."""
    count = lambda df, name, value=F.count(F.lit(1)): df.agg(value.alias("value")).select(F.lit(name).alias("name"), F.col("value").cast("long"))
    whole = documents.select("doc_id").join(built.select("doc_id", F.lit(1).alias("b")), "doc_id", "left")
    share = F.expr("(count(b) * 1000000) div greatest(count(1), 1)")
    out = count(embedded, "embedding_jobs")
    for more in (count(documents.join(embedded, "doc_id", "left_anti"), "embedding_queue_lag"), count(whole, "reindex_progress", share), count(results, "search_result_count")):
        out = out.unionByName(more)
    return out


def precision_recall(judged: DataFrame, predicted: Column, truth: Column, group: str) -> DataFrame:
    """group, true_positives, precision and recall (millionths; null where there is nothing to divide by)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = judged.groupBy(group).agg(count(predicted & truth).alias("true_positives"), count(predicted).alias("p"), count(truth).alias("t"))
    share = lambda n: F.when(F.col(n) > 0, F.expr(f"(true_positives * 1000000) div {n}"))
    return sums.select(group, "true_positives", share("p").alias("precision"), share("t").alias("recall"))


def reconciled(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key and status of each row of either side: same, changed, missing (only old) or added (only new)."""
    a = old.select(key, F.col(content).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(key, F.col(content).alias("_new"), F.lit(True).alias("_in_new"))
    status = F.when(F.col("_in_new").isNull(), "missing").when(F.col("_in_old").isNull(), "added").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))
