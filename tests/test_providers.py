"""Calls that end in time, and what a remote provider is sent."""

from __future__ import annotations

import threading
import time

import pytest

from docloom.operators import governance
from docloom.sources import providers

REQUESTS = "run_id long, prompt_version string, system_policy string, task_instruction string, output_schema string, source_content string, included_block_indexes array<long>, model_policy string, language string, privacy_policy string"


def requests(spark, rows):
    return spark.createDataFrame([(i, "v", "s", "t", "o", content, [0], "m", language, policy) for i, content, language, policy in rows], REQUESTS)


def test_calls_end_in_time_and_are_made_at_once():
    running, most, lock = 0, 0, threading.Lock()

    def ask(request):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(request["wait"])
        with lock:
            running -= 1
        if request["wait"] == 0.01:
            raise ConnectionError
        return None if request["wait"] == 0.02 else {"call_kind": "response"}

    waits = [60.0, 0.05, 0.01, 0.02] + [0.05] * 12 + [60.0]
    began = time.monotonic()
    found = {r["n"]: (a and a["call_kind"], ms) for r, a, ms in providers.asked_in_time(ask, ({"n": i, "wait": w} for i, w in enumerate(waits)), 1000, 4)}
    assert time.monotonic() - began < 10 and most <= 4 + 1  # an abandoned call runs on beside four others
    assert [found[i][0] for i in range(4)] == ["timeout", "response", "transient", None] and found[16][0] == "timeout"
    assert all(found[i][0] == "response" and found[i][1] < 1000 for i in range(4, 16)) and found[0][1] >= 1000
    assert list(providers.asked_in_time(ask, [], 1000, 4)) == []


def test_a_hanging_call_is_a_timeout_and_retried_with_its_own_key(spark, tmp_path):
    def ask(request):
        (tmp_path / f"{request['run_id']}-{request['ordinal']}").write_text(request["idempotency_key"])
        if request["run_id"] == 1 and request["ordinal"] == 1:
            time.sleep(300)
        return {"call_kind": "response", "response": '{"summary":"s","key_points":[{"text":"p","source_block_indexes":[0]}]}'}

    asked = requests(spark, [(i, "text", "en", None) for i in range(4)])
    made = providers.provided_attempts(asked, providers.FunctionProvider("near", ask, timeout_ms=1500, remote=False), 1000, 30_000)
    assert sorted((r.run_id, r.ordinal, r.outcome, r.error) for r in made.collect()) == [(0, 1, "accepted", None), (1, 1, "transient_failure", "timeout"), (1, 2, "accepted", None), (2, 1, "accepted", None), (3, 1, "accepted", None)]
    keys = [p.read_text() for p in tmp_path.iterdir()]
    assert len(keys) == len(set(keys)) == 5 and all(keys)


def test_a_remote_provider_is_sent_only_what_may_leave(spark):
    policies = ["local_only", "remote_allowed_redacted", "remote_allowed_full", "index_metadata_only", "excluded", None, "other"]
    rows = [(i, f"mail a.b{i}@c.org now", "en" if i % 3 else None, policies[i % 7]) for i in range(28)] + [(90, None, "en", "remote_allowed_full"), (91, "", "de", "remote_allowed_full")]
    asked = requests(spark, rows)
    provider = providers.FunctionProvider("far", lambda r: {"call_kind": "response", "response": "{}", "provider_request_id": r["source_content"]})
    with pytest.raises(ValueError, match="gated"):
        providers.provided_attempts(asked, provider, 100, 1000)
    gate = providers.gated_requests(asked)
    sent = {r.run_id: r.provider_request_id for r in providers.provided_attempts(gate, provider, 100, 30_000).collect() if r.ordinal == 1}
    assert sent == {i: "mail [email] now" if i % 7 == 1 else f"mail a.b{i}@c.org now" for i in range(28) if i % 7 in (1, 2)} | {91: ""}
    assert {r.run_id for r in gate.collect() if r.refused == "privacy"} == {r[0] for r in rows} - set(sent)

    limited = {r.run_id: r for r in providers.gated_requests(asked, scope="language", tokens=9).collect()}
    spent, over = {}, set()
    for i, content, language, policy in sorted(rows, key=lambda r: r[0]):
        text = "mail [email] now" if policy == "remote_allowed_redacted" and content else content if policy == "remote_allowed_full" else None
        spent[language] = spent.get(language, 0) + -(-len(text or "") // 4)
        expected = "privacy" if text is None else "budget" if spent[language] > 9 else None
        over |= {expected}
        assert (limited[i].refused, limited[i].source_content) == (expected, None if expected else text), i
    assert over == {None, "privacy", "budget"} and len(limited) == len(rows)
    assert governance.gated(asked.limit(0), "privacy_policy", "source_content").count() == 0 and providers.gated_requests(asked.limit(0), scope="language", tokens=1).count() == 0
