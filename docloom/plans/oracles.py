"""DuckDB SQL for the registered queries, written apart from the operators that it checks."""

from __future__ import annotations

import math

from docloom.operators.governance import SECOND_LEVEL
from docloom.plans.queries import ANSWER_SQL
from docloom.schemas import ANALYSIS_VERSIONS, LEGAL_EDGES, RUN_STATES, SYSTEM_POLICY, TASK_INSTRUCTION

_STATES = "[" + ", ".join(f"'{s}'" for s in RUN_STATES) + "]"
_EDGES = "[" + ", ".join(f"'{a}>{b}'" for a, b in LEGAL_EDGES) + "]"
_TASK = TASK_INSTRUCTION.replace("'", "''")
_POLICY = SYSTEM_POLICY.replace("'", "''")


def _blocks(headings: bool = False, unsupported: bool = False) -> str:
    """b: doc_id, lang, i, line; r: with rendered (null: unsupported) and header."""
    heading = "WHEN i = 0 THEN 'block 0 heading 1: ' || CAST(to_json(line) AS VARCHAR) || chr(10)" if headings else ""
    table = "WHEN i % 17 = 16 THEN NULL" if unsupported else ""
    return f"""b AS (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
    r AS (SELECT doc_id, i, CASE {table} {heading} WHEN true THEN 'block ' || i || ' paragraph: ' || CAST(to_json(line) AS VARCHAR) || chr(10) END AS rendered,
          'title: null' || chr(10) || 'language: ' || coalesce(CAST(to_json(lang) AS VARCHAR), 'null') || chr(10) AS header FROM b)"""


def _pack(budget: int, **kind: bool) -> str:
    """p: doc_id, header, i, rendered, included."""
    return f"""{_blocks(**kind)},
    s AS (SELECT *, length(header) + sum(coalesce(length(rendered), 0)) OVER w AS running, bool_or(rendered IS NULL) OVER w AS cut FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    p AS (SELECT *, running <= {budget} AND NOT cut AS included FROM s)"""


_FOLD_TOTALS = "count(*) FILTER (included) AS n_included, count(*) FILTER (NOT included) AS n_omitted, count(*) FILTER (NOT included) > 0 AS truncated, CAST(any_value(length(header)) + coalesce(sum(length(rendered)) FILTER (included), 0) AS BIGINT) AS used"
_SOURCE = "any_value(header) || coalesce(string_agg(rendered, '' ORDER BY i) FILTER (included), '')"

#: k: run_id, citable (block 0 is in the context); a: the attempts that the ten scripts must lead to.
_ATTEMPTS = f"""{_pack(1000)},
    k AS (SELECT doc_id AS run_id, any_value(doc_id % 10) AS c, bool_or(included AND i = 0) AS citable FROM p GROUP BY doc_id),
    one AS (SELECT run_id, c, citable, 1 AS ordinal, 'initial' AS reason,
        CASE WHEN c IN (1, 7, 8) THEN 'transient_failure' WHEN c IN (4, 6) THEN 'permanent_failure' WHEN c = 0 AND citable THEN 'accepted' ELSE 'invalid' END AS outcome,
        CASE WHEN c = 2 THEN 'schema' WHEN c IN (3, 9) THEN 'json_syntax' WHEN c = 5 OR c = 0 AND NOT citable THEN 'citation' END AS validation_code,
        CASE WHEN c IN (1, 8) THEN 'transient' WHEN c = 7 THEN 'timeout' WHEN c = 4 THEN 'permanent' WHEN c = 6 THEN 'blob' WHEN c = 0 AND citable THEN NULL ELSE 'invalid' END AS error,
        c IN (0, 2, 3, 5, 9) AS stored FROM k),
    two AS (SELECT run_id, c, citable, 2 AS ordinal, CASE WHEN outcome = 'invalid' THEN 'repair' ELSE 'retry' END AS reason,
        CASE WHEN c IN (0, 9) THEN 'permanent_failure' WHEN c = 7 THEN 'transient_failure' WHEN c IN (1, 2, 5) AND citable THEN 'accepted' ELSE 'invalid' END AS outcome,
        CASE WHEN c = 8 THEN 'schema' WHEN c = 3 THEN 'json_syntax' WHEN c IN (1, 2, 5) AND NOT citable THEN 'citation' END AS validation_code,
        CASE WHEN c IN (0, 9) THEN 'exhausted' WHEN c = 7 THEN 'timeout' WHEN c IN (1, 2, 5) AND citable THEN NULL ELSE 'invalid' END AS error,
        c IN (1, 2, 3, 5, 8) AS stored FROM one WHERE outcome IN ('transient_failure', 'invalid')),
    a AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""
_VALID = "'{\"summary\":\"doc ' || run_id || '\",\"key_points\":[{\"text\":\"p\",\"source_block_indexes\":[0]}]}'"
_RESPONSE = f"""CASE WHEN c = 3 OR c = 9 THEN '{{malformed' WHEN ordinal = 1 AND c = 2 OR ordinal = 2 AND c = 8 THEN '{{"summary":"","key_points":[]}}'
    WHEN ordinal = 1 AND c = 5 THEN '{{"summary":"doc ' || run_id || '","key_points":[{{"text":"p","source_block_indexes":[999999]}}]}}' ELSE {_VALID} END"""
_ENDED = f"""{_ATTEMPTS}, e AS (SELECT run_id, CASE WHEN bool_or(outcome = 'accepted') THEN 'completed' ELSE 'failed' END AS state, count(*) AS attempts, max_by(coalesce(error, ''), ordinal) AS error FROM a GROUP BY run_id)"""

#: g: page_id, title, language, i, text, heading: blocks of the test pages, whose markup is known.
_PAGES = r"""t AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '[ \t\n\f\r]+', ' ', 'g') AS raw_title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language,
        regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script.*?</script>|<style.*?</style>|<title.*?</title>|<nav>.*?</nav>|<footer>.*?</footer>', chr(1), 'g') AS body FROM pages),
    x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '<h1>', chr(1) || chr(2), 'g'), '</?(?:p|h1|div|article|body|html|head|ul|li)(?: [^>]*)?>', chr(1), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS marked FROM t),
    y AS (SELECT page_id, raw_title, language, unnest(string_split(marked, chr(1))) AS piece, generate_subscripts(string_split(marked, chr(1)), 1) AS n FROM x),
    z AS (SELECT *, contains(piece, chr(2)) AS heading, trim(regexp_replace(replace(replace(replace(piece, chr(2), ''), '&quot;', '"'), '&amp;', '&'), '[ \t\n\f\r]+', ' ', 'g')) AS text FROM y),
    g0 AS (SELECT page_id, replace(replace(trim(raw_title), '&quot;', '"'), '&amp;', '&') AS title, language, heading, text, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS i FROM z WHERE text <> ''),
    g AS (SELECT *, max(CASE WHEN heading THEN i END) OVER (PARTITION BY page_id ORDER BY i) AS section FROM g0)"""


def _key(*parts: str) -> str:
    return "sha256(" + " || ".join(f"length({x}) || ':' || {x}" for x in parts) + ")"


_REVISIONS = f"""v AS (SELECT doc_id, coalesce(source, 'none') AS tenant_ref, coalesce(text, '') AS content FROM documents
    UNION ALL SELECT doc_id, coalesce(source, 'none'), coalesce(text, '') || chr(10) FROM documents WHERE doc_id % 10 = 0),
    u AS (SELECT DISTINCT doc_id, tenant_ref, CAST(doc_id AS VARCHAR) AS source_document_id, sha256(content) AS hex FROM v),
    x AS (SELECT *, {_key("tenant_ref", "'extractor'", "source_document_id", "'sha256'", "hex")} AS source_ref_id FROM u)"""
_RUN_ID = _key("source_ref_id", *(f"'{v}'" for v in ANALYSIS_VERSIONS.values()))
_POLICY_NAME = ANALYSIS_VERSIONS["model_policy"]
#: z: a run for each revision; att: the attempts of first revisions' runs, with their run.
_RECORDED = f"""{_REVISIONS}, z AS (SELECT {_RUN_ID} AS rid, * FROM x),
    att AS (SELECT rid, left(rid, 1) AS digit, ordinal, outcome FROM a JOIN documents d ON d.doc_id = a.run_id JOIN z ON z.source_document_id = CAST(d.doc_id AS VARCHAR) AND z.tenant_ref = coalesce(d.source, 'none') AND z.hex = sha256(coalesce(d.text, '')))"""
#: In millionths for a token: input, output.
_COST = "n_chars // 4 * 3 + n_chars // 16 * 15"

# answers, one validation step after the other
_INTEGER = "(json_type(i) IN ('UBIGINT', 'BIGINT') AND TRY_CAST(i AS HUGEINT) >= 0 OR json_type(i) = 'DOUBLE' AND CAST(i AS DOUBLE) >= 0 AND CAST(i AS DOUBLE) = floor(CAST(i AS DOUBLE)))"
_ANSWERS = f"""q AS (SELECT doc_id, {ANSWER_SQL} AS response, len(string_split(coalesce(text, ''), chr(10))) AS n_blocks FROM documents),
    j AS (SELECT *, json_valid(response) AS ok FROM q),
    t AS (SELECT *, ok AND coalesce(json_type(response) = 'OBJECT' AND list_sort(json_keys(response)) = ['key_points', 'summary']
            AND json_type(response, '$.summary') = 'VARCHAR' AND length(json_extract_string(response, '$.summary')) BETWEEN 1 AND 2000
            AND json_type(response, '$.key_points') = 'ARRAY' AND json_array_length(response, '$.key_points') BETWEEN 1 AND 10
            AND len(list_filter(json_extract(response, '$.key_points[*]'), lambda k: NOT coalesce(json_type(k) = 'OBJECT' AND list_sort(json_keys(k)) = ['source_block_indexes', 'text']
                AND json_type(k, '$.text') = 'VARCHAR' AND length(json_extract_string(k, '$.text')) BETWEEN 1 AND 500
                AND json_type(k, '$.source_block_indexes') = 'ARRAY' AND json_array_length(k, '$.source_block_indexes') BETWEEN 1 AND 8
                AND len(list_filter(json_extract(k, '$.source_block_indexes[*]'), lambda i: NOT {_INTEGER})) = 0, false))) = 0, false) AS structured FROM (SELECT doc_id, n_blocks, ok, CASE WHEN ok THEN response ELSE '{{}}' END AS response FROM j)),
    d AS (SELECT *, structured AND len(list_filter(json_extract(response, '$.key_points[*].source_block_indexes[*]'), lambda i: json_type(i) = 'DOUBLE' OR CAST(i AS DOUBLE) > 4294967295)) = 0 AS decodes FROM t),
    c AS (SELECT *, len(list_filter(json_extract(response, '$.key_points[*]'), lambda k: len(list_distinct(CAST(json_extract(k, '$.source_block_indexes') AS BIGINT[]))) <> json_array_length(k, '$.source_block_indexes')
            OR len(list_filter(CAST(json_extract(k, '$.source_block_indexes') AS BIGINT[]), lambda i: i >= n_blocks)) > 0)) = 0 AS cites FROM d WHERE decodes)"""

_TOKENS = r"""d AS (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS tokens FROM documents),
    n AS (SELECT doc_id, source, len(tokens) AS length, unnest(tokens) AS token FROM d),
    post AS (SELECT doc_id, source, token, length, count(*) AS tf FROM n GROUP BY ALL)"""


def _bm25(scope: bool, k: int) -> str:
    on, s, by = ("AND post.source = w.source", "source,", "PARTITION BY source") if scope else ("", "", "")
    words = r"unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+'))) AS token"
    return rf"""{_TOKENS},
    w AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS source, {words} FROM benchmark),
    len AS (SELECT DISTINCT doc_id, source, length FROM post),
    size AS (SELECT {s} count(*) AS n_docs, avg(length) AS mean FROM len GROUP BY {"source" if scope else "ALL"}),
    freq AS (SELECT {s} token, count(*) AS df FROM post GROUP BY ALL),
    hit AS (SELECT query_id, doc_id, CAST(round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)) * 1e6) AS BIGINT) AS part
        FROM w JOIN post ON post.token = w.token {on} JOIN freq ON freq.token = w.token {"AND freq.source = w.source" if scope else ""} {"JOIN size ON size.source = w.source" if scope else "CROSS JOIN size"}),
    score AS (SELECT query_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM hit GROUP BY ALL),
    text_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM score QUALIFY rank <= {k})"""


_SECOND = ", ".join(f"'{d}'" for d in SECOND_LEVEL)


def _host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[a-zA-Z]+://([^/:?#]+)', 1))"


def _domain(host: str) -> str:
    return f"array_to_string(list_slice(string_split({host}, '.'), CASE WHEN array_to_string(list_slice(string_split({host}, '.'), -2, -1), '.') IN ({_SECOND}) THEN -3 ELSE -2 END, -1), '.')"


def _mentions(source: str, out: str) -> str:
    """out: doc_id, alias, mentions, of source (doc_id, tokens)."""
    return f"""{out}_at AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS first FROM {source}),
    {out}_all AS (SELECT doc_id, first, first + k - 1 AS last, alias FROM {out}_at JOIN heads ON head = token JOIN {source} USING (doc_id) WHERE k = 1 OR array_to_string(tokens[first:first + k - 1], ' ') = alias),
    {out}_max AS (SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY first, last DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {out}_all),
    {out} AS (SELECT doc_id, alias, entity, count(*) AS mentions FROM {out}_max JOIN alias USING (alias) WHERE reach IS NULL OR last > reach GROUP BY ALL)"""


_ALIASES = rf"""a_doc AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') AS tokens FROM documents),
    a_ask AS (SELECT item_id AS doc_id, regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') AS tokens FROM benchmark),
    a_page AS (SELECT url, {_domain(_host("url"))} AS domain, coalesce(html, '') AS html FROM pages),
    a_link AS (SELECT domain, unnest(list_zip(regexp_extract_all(html, '<a href="([^"?#]+)">([^<]+)</a>', 1), regexp_extract_all(html, '<a href="([^"?#]+)">([^<]+)</a>', 2))) AS l FROM a_page WHERE domain <> ''),
    a_raw AS (SELECT l[2] AS name, CASE WHEN l[1] LIKE '/%' THEN domain || l[1] WHEN {_domain(_host("l[1]"))} <> '' THEN {_domain(_host("l[1]"))} END AS entity FROM a_link
        UNION ALL SELECT regexp_extract(html, '<title>([^<]*)</title>', 1), regexp_extract(url, '^[a-zA-Z]+://([^?#]+)', 1) FROM a_page
        UNION ALL SELECT {_host("url")}, domain FROM a_page),
    a_named AS (SELECT array_to_string(regexp_extract_all(lower(name), '\p{{L}}+'), ' ') AS alias, entity FROM a_raw),
    alias AS (SELECT alias, entity FROM a_named WHERE alias <> '' AND entity <> '' GROUP BY alias, entity QUALIFY row_number() OVER (PARTITION BY alias ORDER BY count(*) DESC, entity) = 1),
    heads AS (SELECT alias, string_split(alias, ' ')[1] AS head, len(string_split(alias, ' ')) AS k FROM alias)"""


def _vectors(where: str, k: int) -> str:
    return f"""vs AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, CAST(round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) * 1e6) AS BIGINT) AS score
        FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE {where}),
    vector_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs QUALIFY rank <= {k})"""


_EVENT_LOG = f"l AS (SELECT user_id AS run_id, event_id AS seq, {_STATES}[event_id * 7 % 9 + 1] AS to_state FROM events)"
#: Moves are counted one by one along each log.
_STATES_SQL = f"""WITH RECURSIVE {_EVENT_LOG},
    o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM l),
    f AS (SELECT run_id, CAST(0 AS BIGINT) AS n, 'queued' AS state, CAST(0 AS BIGINT) AS moves FROM (SELECT DISTINCT run_id FROM l)
        UNION ALL SELECT f.run_id, o.n, CASE WHEN list_contains({_EDGES}, f.state || '>' || o.to_state) THEN o.to_state ELSE f.state END, f.moves + CAST(list_contains({_EDGES}, f.state || '>' || o.to_state) AS BIGINT) FROM f JOIN o ON o.run_id = f.run_id AND o.n = f.n + 1)
    SELECT run_id, state, moves, n - moves AS rejected FROM f QUALIFY n = max(n) OVER (PARTITION BY run_id)"""

_CALLS = "c AS (SELECT event_type, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CAST(round(value * 1000) AS BIGINT) * 600 AS e FROM events)"
_OVERLAPS = f"""{_CALLS}, p AS (SELECT event_type, at_ms, sum(delta) AS delta FROM (SELECT event_type, s AS at_ms, 1 AS delta FROM c WHERE e > s UNION ALL SELECT event_type, e, -1 FROM c WHERE e > s) GROUP BY ALL HAVING sum(delta) <> 0),
    r AS (SELECT event_type, at_ms, CAST(sum(delta) OVER (PARTITION BY event_type ORDER BY at_ms) AS BIGINT) AS running FROM p)"""
_HOUR = 3_600_000
_DEADLINES = f"""WITH RECURSIVE o AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS run_id, (epoch_us(ts) // 1000) AS at_ms, {_STATES}[event_id * 7 % 9 + 1] AS to_state, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
    f AS (SELECT run_id, CAST(0 AS BIGINT) AS n, 'queued' AS state, CAST(0 AS BIGINT) AS moves, CAST(0 AS BIGINT) AS rejected, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS ended_ms, at_ms + {3 * _HOUR} AS due FROM o WHERE n = 1
        UNION ALL SELECT run_id, n, CASE WHEN ok THEN to_state WHEN over THEN 'failed' ELSE state END, moves + CAST(ok AS BIGINT), rejected + CAST(NOT ok AS BIGINT),
            CASE WHEN over THEN 'deadline' WHEN ok AND to_state IN ('completed', 'failed') THEN 'move' ELSE reason END, CASE WHEN over THEN due WHEN ok AND to_state IN ('completed', 'failed') THEN at_ms ELSE ended_ms END, CASE WHEN ok THEN at_ms + {3 * _HOUR} ELSE due END
        FROM (SELECT f.*  EXCLUDE (n), o.n, o.at_ms, o.to_state, reason IS NULL AND at_ms > due AS over, reason IS NULL AND at_ms <= due AND list_contains({_EDGES}, f.state || '>' || o.to_state) AS ok FROM f JOIN o ON o.run_id = f.run_id AND o.n = f.n + 1)),
    e AS (SELECT *, reason IS NULL AND due <= (SELECT max((epoch_us(ts) // 1000)) - {_HOUR} FROM events) AS over FROM f QUALIFY n = max(n) OVER (PARTITION BY run_id))
    SELECT run_id, CASE WHEN over THEN 'failed' ELSE state END AS state, moves, rejected, CASE WHEN over THEN 'deadline' ELSE reason END AS reason, CASE WHEN over THEN due ELSE ended_ms END AS ended_ms FROM e"""

_PERSONAL = (("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[email]"), ("[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "[ip]"), ("[0-9a-f]{32,}", "[secret]"), ("[+][0-9]{1,2} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}", "[phone]"), ("[0-9]{13,19}", "[number]"))


def _redacted(x: str) -> str:
    for pattern, name in _PERSONAL:
        x = f"regexp_replace({x}, '{pattern}', '{name}', 'g')"
    return x


_REDACT = _redacted("coalesce(text, '')")

ORACLES: dict[str, str] = {
    "context_pack": f"WITH {_pack(1000)} SELECT doc_id, {_FOLD_TOTALS}, sha256({_SOURCE}) AS source_hash FROM p GROUP BY doc_id",
    "context_index_lists": f"WITH {_pack(1000)} SELECT doc_id, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (included), '') AS included, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (NOT included), '') AS omitted, count(*) FILTER (NOT included) > 0 AS truncated FROM p GROUP BY doc_id",
    "context_budget_error": f"WITH {_blocks()} SELECT DISTINCT doc_id, 'budget_too_small' AS budget_error FROM r WHERE length(header) > 25",
    "context_block_limit": f"WITH {_blocks()}, g AS (SELECT doc_id, any_value(length(header)) AS h, count(*) AS n FROM r GROUP BY doc_id), e AS (SELECT doc_id, unnest([25, 1000]) AS budget, h, n FROM g) SELECT doc_id, budget, CASE WHEN h > budget THEN 'budget_too_small' ELSE 'too_many_blocks' END AS budget_error FROM e WHERE h > budget OR n > 12",
    "context_unsupported_cut": f"WITH {_pack(32000, headings=True, unsupported=True)}, g AS (SELECT doc_id, {_FOLD_TOTALS} FROM p GROUP BY doc_id) SELECT doc_id, n_included, truncated, used FROM g",
    "block_render": f"WITH {_blocks(headings=True)} SELECT doc_id, CAST(i AS BIGINT) AS block_index, length(rendered) AS chars, sha256(rendered) AS line_hash FROM r",
    "context_manifest": f"WITH {_pack(1000)}, m AS (SELECT p.doc_id, p.i, included, running - length(rendered) AS begins, line FROM p JOIN b ON b.doc_id = p.doc_id AND b.i = p.i) SELECT doc_id, CAST(i AS BIGINT) AS block_index, included, CASE WHEN included THEN CAST(begins AS BIGINT) END AS first_char, sha256(line) AS span_hash FROM m",
    "generation_request": f"WITH {_pack(1000)} SELECT doc_id, '{ANALYSIS_VERSIONS['prompt_version']}' AS prompt_version, sha256('{_POLICY}{_TASK}') AS instructions_hash, sha256({_SOURCE}) AS source_hash FROM p GROUP BY doc_id",
    "repair_request": f"SELECT doc_id, 'Repair validation code: ' || ['json_syntax', 'schema', 'decode', 'citation'][doc_id % 4 + 1] || '.' AS added, sha256('{_POLICY}') AS policy_hash FROM documents",
    "blob_address": "SELECT doc_id, sha256(coalesce(text, '')) AS digest_hex, CAST(strlen(coalesce(text, '')) AS BIGINT) AS length_bytes, 'sha256/' || left(sha256(coalesce(text, '')), 2) || '/' || sha256(coalesce(text, '')) AS blob_path FROM documents",
    "blob_store_dedup": "WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest_hex, CAST(strlen(coalesce(text, '')) AS BIGINT) AS length_bytes FROM documents) SELECT DISTINCT digest_hex, length_bytes, 'sha256/' || left(digest_hex, 2) || '/' || digest_hex AS blob_path FROM h WHERE length_bytes <= 1048576 AND digest_hex NOT IN (SELECT digest_hex FROM h WHERE doc_id % 3 = 0)",
    "blob_too_large": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS length_bytes, 'too_large' AS error FROM documents WHERE strlen(text) > 4096",
    "blob_integrity": "SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'owner' WHEN doc_id % 6 = 2 THEN 'media_type' WHEN doc_id % 6 = 3 THEN 'algorithm' WHEN strlen(coalesce(text, '')) + CAST(doc_id % 6 = 4 AS INT) > 8192 THEN 'too_large' WHEN doc_id % 6 IN (4, 5) THEN 'content' ELSE 'ok' END AS problem FROM documents",
    "source_guard": "SELECT doc_id, ['ok', 'owner_context', 'owner_context', 'digest_algorithm', 'digest_hex'][doc_id % 5 + 1] AS violation FROM documents",
    "version_guard": "WITH n AS (SELECT doc_id, ['article_v', 'Article_v', '9v', '', 'a b'][doc_id % 5 + 1] || CASE WHEN doc_id % 7 = 0 THEN repeat('z', 60) ELSE '1' END AS version FROM documents) SELECT doc_id, version, regexp_full_match(version, '[a-z][a-z0-9_-]*') AND strlen(version) <= 64 AS valid FROM n",
    "source_revisions": f"WITH {_REVISIONS} SELECT tenant_ref, source_document_id, count(*) AS revisions, min(source_ref_id) AS first_ref FROM x GROUP BY ALL",
    "source_get_or_create": f"WITH {_REVISIONS} SELECT CASE WHEN doc_id % 4 = 0 THEN 'old-' || left(hex, 12) || '-' || source_document_id ELSE source_ref_id END AS source_ref_id, source_document_id, doc_id % 4 <> 0 AS created FROM x",
    "run_get_or_create": f"WITH {_REVISIONS} SELECT {_RUN_ID} AS run_id, source_ref_id, true AS created FROM x",
    "constraint_violations": f"""WITH {_ATTEMPTS}, {_RECORDED},
        n AS (SELECT 'run_state' AS rule, count(*) AS violations FROM z WHERE left(rid, 1) = '0' UNION ALL SELECT 'run_source', count(*) FROM z WHERE left(rid, 1) = '0'
        UNION ALL SELECT 'attempt_key', count(*) FROM att WHERE digit = '1' UNION ALL SELECT 'attempt_values', count(*) FROM att WHERE digit = '2'
        UNION ALL SELECT 'attempt_run', count(DISTINCT rid) FROM att WHERE digit = '3' UNION ALL SELECT 'attempt_policy', count(*) FROM att WHERE digit = '4'
        UNION ALL SELECT 'one_accepted_output', count(*) FROM att WHERE digit = '5' AND outcome = 'accepted' UNION ALL SELECT 'output_run', count(*) FROM att WHERE digit = '6' AND outcome = 'accepted'
        UNION ALL SELECT 'output_object', count(*) FROM att WHERE digit = '7' AND outcome = 'accepted' UNION ALL SELECT 'source_key', count(*) FROM x WHERE left(source_ref_id, 1) = '8' UNION ALL SELECT 'run_key', count(*) FROM z WHERE left(rid, 1) = '9')
        SELECT rule, violations FROM n WHERE violations > 0""",
    "scripted_calls": """WITH s AS (SELECT doc_id, doc_id % 10 AS c, unnest([1, 2]) AS ordinal FROM documents),
        k AS (SELECT doc_id, c, ordinal, CASE WHEN ordinal = 1 AND c IN (1, 8) THEN 'transient' WHEN ordinal = 1 AND c = 4 THEN 'permanent' WHEN c = 7 THEN 'timeout' ELSE 'response' END AS call_kind FROM s WHERE ordinal = 1 OR c NOT IN (0, 4, 6, 9))
        SELECT doc_id, ordinal, call_kind, CAST(CASE WHEN call_kind <> 'response' THEN NULL WHEN c IN (3, 9) THEN 10 WHEN c = 6 THEN 3030 WHEN ordinal = 1 AND c = 2 OR ordinal = 2 AND c = 8 THEN 30
            WHEN ordinal = 1 AND c = 5 THEN 78 + length(CAST(doc_id AS VARCHAR)) ELSE 73 + length(CAST(doc_id AS VARCHAR)) END AS BIGINT) AS response_bytes FROM k""",
    "pipeline_attempts": f"WITH {_ATTEMPTS} SELECT run_id, ordinal, reason, outcome, validation_code, stored FROM a",
    "provider_attempts": f"WITH {_ATTEMPTS} SELECT run_id, ordinal, reason, 'function' AS provider, '{_POLICY_NAME}' AS model_policy, outcome, validation_code, stored, CASE WHEN stored AND reason = 'repair' THEN 'repair' WHEN stored THEN 'first' END AS asked FROM a",
    "attempt_guard": "SELECT doc_id, CAST(CASE doc_id % 6 WHEN 1 THEN 0 WHEN 2 THEN 128 WHEN 3 THEN 129 WHEN 4 THEN 130 WHEN 5 THEN 4 + length(CAST(doc_id AS VARCHAR)) END AS BIGINT) AS id_bytes, doc_id % 6 IN (0, 2, 5) AS allowed FROM documents",
    "call_timeouts": """WITH c AS (SELECT doc_id, doc_id % 10 AS c, doc_id % 50 * 10 > 400 AS late FROM documents),
        o AS (SELECT doc_id, c, 1 AS ordinal, 'initial' AS reason FROM c WHERE late OR c = 7 UNION ALL SELECT doc_id, c, 2, 'retry' FROM c WHERE (late OR c = 7) AND c NOT IN (0, 4, 6, 9))
        SELECT ordinal, reason, 'transient_failure' AS outcome, count(*) AS attempts, count(*) AS measured FROM o GROUP BY ALL""",
    "attempt_append": f"WITH {_ATTEMPTS} SELECT run_id, ordinal, reason, 'scripted' AS provider, '{_POLICY_NAME}' AS model_policy, outcome FROM a",
    "attempt_update": f"WITH {_ATTEMPTS} SELECT run_id, ordinal, CASE WHEN run_id % 7 = 0 THEN 'invalid' ELSE outcome END AS outcome, run_id % 7 <> 0 AS changed FROM a WHERE ordinal = 1",
    "pipeline_outcome": f"WITH {_ENDED} SELECT run_id, state, attempts, nullif(error, '') AS error, CASE WHEN state = 'completed' THEN 'doc ' || run_id END AS summary FROM e",
    "attempt_outcome": f"WITH {_ATTEMPTS} SELECT ordinal, reason, outcome, count(*) AS attempts FROM a GROUP BY ALL",
    "attempt_evidence": f"WITH {_ATTEMPTS}, g AS (SELECT run_id, ordinal, sha256({_RESPONSE}) AS digest_hex FROM a WHERE stored) SELECT run_id, ordinal, 'scripted' AS provider, '{_POLICY_NAME}' AS model_policy, 'req-' || run_id || '-' || ordinal AS provider_request_id, digest_hex, 'sha256/' || left(digest_hex, 2) || '/' || digest_hex AS blob_path, n_chars // 4 AS input_tokens, n_chars // 16 AS output_tokens FROM g JOIN documents ON doc_id = run_id",
    "timeout_class": f"WITH {_ATTEMPTS} SELECT error, outcome, count(*) AS attempts FROM a WHERE error IN ('timeout', 'transient') GROUP BY ALL",
    "validation_code": f"WITH {_ATTEMPTS} SELECT run_id, ordinal, coalesce(validation_code, 'accepted') AS code FROM a WHERE stored",
    "validation_histogram": f"WITH {_ATTEMPTS} SELECT coalesce(validation_code, 'accepted') AS validation_class, count(*) AS attempts FROM a WHERE stored GROUP BY ALL",
    "usage_rollup": f"WITH {_ATTEMPTS} SELECT source, CAST(sum(n_chars // 4) FILTER (stored OR error = 'blob') AS BIGINT) AS input_tokens, CAST(sum(n_chars // 16) FILTER (stored OR error = 'blob') AS BIGINT) AS output_tokens FROM a JOIN documents ON doc_id = run_id GROUP BY source",
    "accepted_outputs": f"WITH {_ATTEMPTS} SELECT run_id, {_key("CAST(run_id AS VARCHAR)", f"sha256({_VALID})")} AS output_id, 'doc ' || run_id AS summary, CAST(1 AS BIGINT) AS n_points, true AS accepted FROM a WHERE outcome = 'accepted'",
    "accept_atomicity": f"WITH {_ATTEMPTS} SELECT run_id, count(*) FILTER (outcome = 'accepted') AS outputs, bool_or(outcome = 'accepted') AS persisted FROM a GROUP BY run_id",
    "resume_lookup": f"WITH s AS (SELECT doc_id AS run_id, {_STATES}[doc_id % 9 + 1] AS state, doc_id % 4 = 0 AS has FROM documents) SELECT run_id, CASE WHEN has AND state = 'persisted' THEN 'completed' ELSE state END AS state, CASE WHEN has AND state IN ('persisted', 'completed') THEN 'doc ' || run_id END AS result, has AND state IN ('persisted', 'completed') AS replayed FROM s",
    "attempt_orphans": "SELECT doc_id * 2 AS run_id FROM documents WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)",
    "attempt_next_ordinal": "SELECT doc_id AS run_id, CAST(doc_id % 3 + 1 AS INT) AS next_ordinal FROM documents",
    "attempt_budget": "SELECT doc_id AS run_id, 'attempt_budget_exhausted' AS error FROM documents WHERE doc_id % 3 = 2",
    "legal_transition_matrix": f"SELECT a.s AS from_state, b.s AS to_state, list_contains({_EDGES}, a.s || '>' || b.s) AS legal FROM (SELECT unnest({_STATES}) AS s) a CROSS JOIN (SELECT unnest({_STATES}) AS s) b",
    "transition_cas": f"""WITH s AS (SELECT doc_id AS run_id, {_STATES}[doc_id % 9 + 1] AS state, {_STATES}[(doc_id + (doc_id // 9) % 2) % 9 + 1] AS expected, {_STATES}[(doc_id + 1 + (doc_id // 18) % 7) % 9 + 1] AS target FROM documents),
        c AS (SELECT *, state = expected AND list_contains({_EDGES}, expected || '>' || target) AS changed FROM s) SELECT run_id, CASE WHEN changed THEN target ELSE state END AS state, changed FROM c""",
    "state_replay": _STATES_SQL,
    "state_log_replay": f"WITH {_ENDED} SELECT run_id, state, CAST(0 AS BIGINT) AS rejected FROM e",
    "answer_schema": "SELECT 2000 AS summary_max, 10 AS points_max, 500 AS point_max, 8 AS citations_max, true AS closed, count(*) AS requests FROM documents",
    "json_syntax_gate": f"WITH {_ANSWERS} SELECT doc_id, ok AS is_json FROM j",
    "structural_validation": f"WITH {_ANSWERS} SELECT doc_id, structured FROM t WHERE ok",
    "decode_validation": f"WITH {_ANSWERS} SELECT doc_id, decodes FROM d WHERE structured",
    "citation_validation": f"WITH {_ANSWERS} SELECT d.doc_id, CASE WHEN NOT d.ok THEN 'json_syntax' WHEN NOT d.structured THEN 'schema' WHEN NOT d.decodes THEN 'decode' WHEN NOT c.cites THEN 'citation' ELSE 'accepted' END AS code FROM d LEFT JOIN c USING (doc_id)",
    "token_df": f"WITH {_TOKENS} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY token",
    "transition_contest": f"""WITH p AS (SELECT doc_id AS run_id, CASE WHEN doc_id % 10 <> 4 THEN {_STATES}[doc_id % 9 + 1] END AS s0, {_STATES}[doc_id % 9 + 1] AS e1, {_STATES}[(doc_id + 1 + doc_id % 7) % 9 + 1] AS t1,
            {_STATES}[(doc_id + 1 + (doc_id // 9) % 8) % 9 + 1] AS t2, {_STATES}[(doc_id + 2 + doc_id % 5) % 9 + 1] AS t3 FROM documents),
        a AS (SELECT *, coalesce(s0 = e1 AND list_contains({_EDGES}, e1 || '>' || t1), false) AS c1 FROM p),
        b AS (SELECT *, CASE WHEN c1 THEN t1 ELSE s0 END AS s1, coalesce(CASE WHEN c1 THEN t1 ELSE s0 END = e1 AND list_contains({_EDGES}, e1 || '>' || t2), false) AS c2 FROM a),
        c AS (SELECT *, CASE WHEN c2 THEN t2 ELSE s1 END AS s2 FROM b),
        d AS (SELECT *, coalesce(s2 = t2 AND list_contains({_EDGES}, t2 || '>' || t3), false) AS c3 FROM c)
        SELECT run_id, 1::BIGINT AS turn, s1 AS state, c1 AS changed FROM d UNION ALL SELECT run_id, 2, s2, c2 FROM d UNION ALL SELECT run_id, 3, CASE WHEN c3 THEN t3 ELSE s2 END, c3 FROM d""",
    "fts_bm25_topk": f"WITH {_bm25(False, 10)} SELECT query_id, doc_id, score, rank FROM text_rank",
    "authorized_search": f"WITH {_bm25(True, 10)} SELECT query_id, doc_id, score, rank FROM text_rank",
    "fts_index_topk": f"WITH {_bm25(False, 10)} SELECT query_id, doc_id, score, rank FROM text_rank",
    "fts_index_merged": f"WITH {_bm25(False, 10).replace('FROM documents)', 'FROM documents WHERE doc_id % 10 <> 7)', 1)} SELECT query_id, doc_id, score, rank FROM text_rank",
    "text_mentions": f"WITH {_ALIASES}, {_mentions('a_doc', 'found')} SELECT doc_id, alias, entity, mentions FROM found",
    "hybrid_mentions": f"""WITH {_bm25(False, 30)}, {_ALIASES}, a_few AS (SELECT * FROM a_doc WHERE doc_id IN (SELECT doc_id FROM text_rank)), {_mentions("a_few", "found")}, {_mentions("a_ask", "asked")},
        q AS (SELECT query_id, t.doc_id, count(DISTINCT found.entity) AS shared FROM text_rank t JOIN asked ON asked.doc_id = query_id JOIN found ON found.doc_id = t.doc_id AND found.entity = asked.entity GROUP BY ALL),
        m AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id) AS rank FROM q),
        z AS (SELECT query_id, doc_id, CAST(sum(CAST(round(1e6 / (60 + rank)) AS BIGINT)) AS BIGINT) AS score FROM (SELECT query_id, doc_id, rank FROM text_rank UNION ALL SELECT * FROM m) GROUP BY ALL),
        f AS (SELECT z.* FROM z JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, sha256(coalesce(text, '')) ORDER BY score DESC, doc_id) = 1)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""",
    "entity_merges": f"""WITH RECURSIVE p AS (SELECT page_id, {_domain(_host("url"))} || '/' || (page_id % 50) AS entity FROM pages),
        b AS (SELECT a.page_id, a.entity, n.entity AS into_ FROM p a JOIN p n ON n.page_id = a.page_id + 1 WHERE a.entity > n.entity),
        e0 AS (SELECT entity, arg_max(into_, page_id) AS into_ FROM b GROUP BY entity),
        kept AS (SELECT entity, into_, max(page_id) AS version FROM b GROUP BY ALL HAVING count(*) FILTER (page_id % 4 < 2) = 0),
        e1 AS (SELECT entity, arg_max(into_, version) AS into_ FROM kept GROUP BY entity),
        w0 AS (SELECT DISTINCT entity, entity AS here, 0 AS n FROM b UNION ALL SELECT w0.entity, into_, n + 1 FROM w0 JOIN e0 ON e0.entity = here),
        w1 AS (SELECT DISTINCT entity, entity AS here, 0 AS n FROM b UNION ALL SELECT w1.entity, into_, n + 1 FROM w1 JOIN e1 ON e1.entity = here)
        SELECT entity, arg_max(w1.here, w1.n) AS now, any_value(x.before) AS before FROM w1 JOIN (SELECT entity, arg_max(w0.here, w0.n) AS before FROM w0 GROUP BY entity) x USING (entity) GROUP BY entity""",
    "vector_ann_recall": f"WITH {_vectors('q.vec_id % 50 = 0', 10)} SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS enough FROM vector_rank",
    "vector_topk": f"WITH {_vectors('q.vec_id % 50 = 0', 10)} SELECT query_id, doc_id, score, rank FROM vector_rank",
    "hybrid_rrf": f"""WITH {_bm25(False, 30)}, {_vectors("q.vec_id IN (SELECT item_id FROM benchmark)", 30)},
        z AS (SELECT query_id, doc_id, CAST(sum(CAST(round(1e6 / (60 + rank)) AS BIGINT)) AS BIGINT) AS score FROM (SELECT query_id, doc_id, rank FROM text_rank UNION ALL SELECT query_id, doc_id, rank FROM vector_rank) GROUP BY ALL),
        h AS (SELECT z.*, CASE WHEN d.doc_id IS NULL THEN 'vector ' || z.doc_id ELSE sha256(coalesce(text, '')) END AS content FROM z LEFT JOIN documents d ON d.doc_id = z.doc_id),
        f AS (SELECT query_id, doc_id, score FROM h QUALIFY row_number() OVER (PARTITION BY query_id, content ORDER BY score DESC, doc_id) = 1)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""",
    "hybrid_signals": f"""WITH {_bm25(False, 30)},
        q AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, doc_id) AS rank FROM text_rank JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
        t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank FROM text_rank),
        z AS (SELECT query_id, doc_id, CAST(sum(CAST(round(1e6 / (60 + rank)) AS BIGINT)) AS BIGINT) AS score FROM (SELECT query_id, doc_id, rank FROM text_rank UNION ALL SELECT * FROM q UNION ALL SELECT * FROM t) GROUP BY ALL),
        f AS (SELECT z.* FROM z JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, sha256(coalesce(text, '')) ORDER BY score DESC, doc_id) = 1)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""",
    "filtered_search": f"WITH {_bm25(False, 10).replace('FROM documents)', "FROM documents WHERE lang = 'en' AND source IN ('src0', 'src1', 'src2', 'src3') AND n_chars >= 200)", 1)} SELECT query_id, doc_id, score, rank FROM text_rank",
    "search_evaluation": rf"""WITH {_bm25(False, 10)},
        i AS (SELECT item_id AS query_id, regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') AS t FROM benchmark),
        rel AS (SELECT DISTINCT query_id, doc_id FROM i JOIN d ON contains(' ' || array_to_string(d.tokens, ' ') || ' ', ' ' || array_to_string(i.t, ' ') || ' ') WHERE len(i.t) >= 5),
        m AS (SELECT query_id, count(*) AS known FROM rel GROUP BY 1), hits AS (SELECT query_id, count(*) AS hits FROM text_rank JOIN rel USING (query_id, doc_id) GROUP BY 1)
        SELECT query_id, coalesce(hits, 0) AS hits, coalesce(hits, 0) * 1000000 // 10 AS precision, CASE WHEN known > 0 THEN coalesce(hits, 0) * 1000000 // known END AS recall FROM i LEFT JOIN hits USING (query_id) LEFT JOIN m USING (query_id)""",
    "dedup_exact": "SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "chunk_documents": """WITH b AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
        s AS (SELECT *, CAST(floor((sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1) / 800) AS BIGINT) AS chunk FROM b)
        SELECT doc_id, chunk, CAST(min(i) AS BIGINT) AS first_block, CAST(max(i) AS BIGINT) AS last_block, CAST(sum(length(line)) AS BIGINT) AS n_chars, sha256(string_agg(line, chr(10) ORDER BY i)) AS content_hash FROM s GROUP BY ALL""",
    "page_blocks": f"WITH {_PAGES} SELECT page_id, title, language, i AS block_index, CASE WHEN heading THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN heading THEN 1 END AS level, sha256(text) AS text_hash, coalesce(CAST(section AS VARCHAR), '') AS path FROM g",
    "page_context_pack": f"""WITH {_PAGES},
        r AS (SELECT *, 'title: ' || coalesce(CAST(to_json(title) AS VARCHAR), 'null') || chr(10) || 'language: ' || coalesce(CAST(to_json(language) AS VARCHAR), 'null') || chr(10) AS header,
            'block ' || i || CASE WHEN heading THEN ' heading 1: ' ELSE ' paragraph: ' END || CAST(to_json(text) AS VARCHAR) || chr(10) AS rendered FROM g),
        s AS (SELECT *, length(header) + sum(length(rendered)) OVER (PARTITION BY page_id ORDER BY i) <= 1000 AS included FROM r)
        SELECT page_id, {_FOLD_TOTALS}, sha256({_SOURCE}) AS source_hash, CAST(NULL AS VARCHAR) AS budget_error FROM s GROUP BY page_id""",
    "page_sections": f"""WITH {_PAGES},
        b AS (SELECT *, coalesce(section, -1) AS sec, CAST(floor((sum(length(text) + 1) OVER (PARTITION BY page_id, coalesce(section, -1) ORDER BY i) - length(text) - 1) / 800) AS BIGINT) AS stretch FROM g),
        c AS (SELECT page_id, sec, stretch, min(i) AS first_block, max(i) AS last_block, CAST(sum(length(text)) AS BIGINT) AS n_chars, sha256(string_agg(text, chr(10) ORDER BY i)) AS content_hash FROM b GROUP BY ALL)
        SELECT c.page_id, row_number() OVER (PARTITION BY c.page_id ORDER BY first_block) - 1 AS chunk, CASE WHEN sec < 0 THEN '' ELSE CAST(sec AS VARCHAR) END AS path, sha256(h.text) AS title_hash, first_block, last_block, n_chars, content_hash
        FROM c LEFT JOIN g h ON h.page_id = c.page_id AND h.i = c.sec""",
    "conversation_windows": """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        w AS (SELECT DISTINCT conv_id, s.first_turn FROM t JOIN (SELECT unnest(range(0, (SELECT max(turn) + 1 FROM conversations), 2)) AS first_turn) s ON turn BETWEEN s.first_turn AND s.first_turn + 3)
        SELECT w.conv_id, w.first_turn, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars, string_agg(role, ',' ORDER BY turn) AS roles, sha256(string_agg(text, chr(10) ORDER BY turn)) AS content_hash
        FROM w JOIN t ON t.conv_id = w.conv_id AND t.turn BETWEEN w.first_turn AND w.first_turn + 3 GROUP BY ALL""",
    "privacy_gate": """WITH p AS (SELECT doc_id, ['local_only', 'remote_allowed_redacted', 'remote_allowed_full', 'index_metadata_only', 'excluded', 'unknown'][doc_id % 6 + 1] AS policy FROM documents)
        SELECT doc_id, policy, starts_with(policy, 'remote') AS may_call_remote, policy = 'remote_allowed_redacted' AS needs_redaction, starts_with(policy, 'remote') OR policy = 'local_only' AS may_index_text, policy NOT IN ('excluded', 'unknown') AS may_index_metadata FROM p""",
    "redact_text": f"SELECT doc_id, sha256({_REDACT}) AS redacted_hash FROM documents",
    "budget_gate": "WITH r AS (SELECT doc_id, source, CAST(sum(n_chars // 4) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS running FROM documents) SELECT *, running <= 20000 AS allowed FROM r",
    "reindex_pending": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id % 3 = 0",
    "active_version": "SELECT source, CASE WHEN bool_or(doc_id % 97 = 5) THEN 1 ELSE 2 END AS active_version FROM documents GROUP BY source",
    "inbox_dedup": "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, min(event_id) AS event_id, count(*) AS deliveries FROM events GROUP BY ALL",
    "outbox_events": f"WITH {_ENDED}, y AS (SELECT CAST(run_id AS VARCHAR) AS run_id, attempts, 'analysis.' || state || '.v1' AS subject FROM e) SELECT {_key("run_id", "subject")} AS event_id, subject, run_id, attempts FROM y",
    "entity_mentions": "WITH h AS (SELECT url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS alias FROM pages) SELECT alias, array_to_string(list_slice(string_split(alias, '.'), CASE WHEN array_to_string(list_slice(string_split(alias, '.'), -2, -1), '.') IN ('co.uk', 'com.au', 'co.jp') THEN -3 ELSE -2 END, -1), '.') AS entity, count(*) AS mentions, count(DISTINCT url) AS addresses FROM h WHERE alias <> '' GROUP BY ALL",
    "metrics_rollup": f"""WITH {_ATTEMPTS} SELECT source, count(*) AS provider_requests, count(DISTINCT run_id) AS analysis_requests, count(*) FILTER (outcome = 'permanent_failure' OR ordinal = 2 AND outcome <> 'accepted') AS analysis_failures,
        CAST(coalesce(sum(doc_id % 50 * 10) FILTER (ordinal = 1 OR c NOT IN (0, 9)), 0) AS BIGINT) AS analysis_duration_ms,
        count(*) FILTER (reason = 'repair') AS repair_attempts, count(*) FILTER (validation_code IS NOT NULL) AS validation_failures, count(*) FILTER (validation_code = 'citation') AS citation_failures,
        CAST(coalesce(sum(n_chars // 4 + n_chars // 16) FILTER (stored OR error = 'blob'), 0) AS BIGINT) AS provider_tokens, CAST(coalesce(sum({_COST}) FILTER (stored OR error = 'blob'), 0) AS BIGINT) AS provider_cost
        FROM a JOIN documents ON doc_id = run_id GROUP BY ROLLUP (source)""",
    "run_budgets": f"""WITH {_ATTEMPTS}, g AS (SELECT run_id, count(*) AS attempts, count(*) FILTER (reason = 'repair') AS repairs, CAST(coalesce(sum(n_chars // 4 + n_chars // 16) FILTER (stored OR error = 'blob'), 0) AS BIGINT) AS tokens,
        CAST(coalesce(sum({_COST}) FILTER (stored OR error = 'blob'), 0) AS BIGINT) AS cost, CAST(coalesce(sum(doc_id % 50 * 10) FILTER (ordinal = 1 OR c NOT IN (0, 9)), 0) AS BIGINT) AS elapsed_ms FROM a JOIN documents ON doc_id = run_id GROUP BY run_id)
        SELECT *, CASE WHEN attempts > 2 THEN 'attempts' WHEN repairs > 1 THEN 'repairs' WHEN tokens > 600 THEN 'tokens' WHEN cost > 2500 THEN 'cost' WHEN elapsed_ms > 900 THEN 'elapsed_ms' END AS broken FROM g""",
    "service_metrics": f"""WITH {_bm25(False, 10)} SELECT 'embedding_jobs' AS name, count(*) AS value FROM embeddings UNION ALL SELECT 'embedding_queue_lag', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
        UNION ALL SELECT 'reindex_progress', CAST(count(*) FILTER (doc_id % 3 <> 0) * 1000000 // greatest(count(*), 1) AS BIGINT) FROM documents UNION ALL SELECT 'search_result_count', count(*) FROM text_rank""",
    "last_success": f"""WITH {_ENDED}, rev AS (SELECT run_id AS doc_id, 1 AS revision, state FROM e UNION ALL SELECT run_id, 2, CASE WHEN run_id % 2 = 0 THEN 'completed' ELSE 'failed' END FROM e WHERE run_id % 3 = 0),
        g AS (SELECT doc_id, max(revision) AS newest, max(revision) FILTER (state = 'completed') AS shown FROM rev GROUP BY doc_id) SELECT *, shown IS NOT NULL AND shown < newest AS stale FROM g""",
    "gated_requests": f"SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN sha256({_REDACT}) WHEN 2 THEN sha256(coalesce(text, '')) END AS remote_hash, CASE WHEN doc_id % 6 IN (0, 1, 2) THEN sha256(coalesce(text, '')) END AS index_hash FROM documents",
    "page_links": """WITH h AS (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"?#]+)', 1)) AS target FROM pages),
        l AS (SELECT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS source, lower(regexp_extract(target, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS there, target FROM h),
        t AS (SELECT source, CASE WHEN starts_with(target, '/') THEN source || target WHEN there <> '' THEN array_to_string(list_slice(string_split(there, '.'), -2, -1), '.') END AS target FROM l WHERE source <> '')
        SELECT source, 'links_to' AS relation, target, count(*) AS mentions FROM t WHERE target IS NOT NULL GROUP BY ALL""",
    "citation_spans": f"WITH {_ATTEMPTS} SELECT run_id AS doc_id, CAST(0 AS BIGINT) AS block_index, CASE WHEN run_id % 4 = 1 THEN 'changed_span' END AS problem FROM a WHERE outcome = 'accepted'",
    "import_reconciliation": "SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS status FROM documents WHERE doc_id % 11 <> 3 OR doc_id % 5 <> 0",
    "import_reconciliation_digests": "SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS status FROM documents WHERE doc_id % 11 <> 3 OR doc_id % 5 <> 0",
    "eval_precision_recall": """WITH g AS (SELECT lang, count(*) FILTER (n_chars >= 1000 AND quality = 1) AS true_positives, count(*) FILTER (n_chars >= 1000) AS p, count(*) FILTER (quality = 1) AS t FROM labels JOIN documents USING (doc_id) GROUP BY lang)
        SELECT lang, true_positives, true_positives * 1000000 // nullif(p, 0) AS precision, true_positives * 1000000 // nullif(t, 0) AS recall FROM g""",
    "concurrency_peaks": f"WITH {_OVERLAPS} SELECT event_type, running AS peak, at_ms AS peak_at_ms FROM r QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY running DESC, at_ms) = 1",
    "concurrency_periods": f"""WITH {_OVERLAPS}, m AS (SELECT *, lead(at_ms) OVER w AS until_ms, running > 8 AS over, coalesce(lag(running > 8) OVER w, false) AS was FROM r WINDOW w AS (PARTITION BY event_type ORDER BY at_ms)),
        g AS (SELECT *, sum(CAST(over AND NOT was AS INT)) OVER (PARTITION BY event_type ORDER BY at_ms) AS k FROM m)
        SELECT event_type, min(at_ms) AS from_ms, max(until_ms) AS until_ms, max(running) AS peak FROM g WHERE over GROUP BY event_type, k""",
    "latency_rank_error": "SELECT event_type, quantile, count(*) AS n, true AS within FROM events, (SELECT unnest([0.5, 0.9, 0.99]::DOUBLE[]) AS quantile) WHERE value IS NOT NULL GROUP BY ALL",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL",
    "stream_inbox": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CAST(coalesce(ts - lag(ts) OVER w >= INTERVAL 1 HOUR, true) AS INT) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
    "stream_states": _STATES_SQL,
    "stream_deadlines": _DEADLINES,
    "stream_answers": """WITH r AS (SELECT user_id, event_id AS request_id, ts FROM events WHERE event_type = 'view'), a AS (SELECT user_id, event_id AS answer_id, ts FROM events WHERE event_type = 'purchase'),
        m AS (SELECT request_id, answer_id, (epoch_us(a.ts) // 1000) - (epoch_us(r.ts) // 1000) AS waited_ms FROM r JOIN a ON r.user_id = a.user_id AND a.ts BETWEEN r.ts AND r.ts + INTERVAL 1 HOUR),
        w AS (SELECT least((SELECT max(ts) FROM r), (SELECT max(ts) FROM a)) - INTERVAL 1 HOUR AS mark)
        SELECT * FROM m UNION ALL SELECT request_id, NULL, NULL FROM r, w WHERE r.ts + INTERVAL 1 HOUR < mark AND request_id NOT IN (SELECT request_id FROM m)""",
}

ORACLES["remote_attempts"] = f"""WITH {_pack(1000)}, k AS (SELECT doc_id, {_SOURCE} AS packed FROM p GROUP BY doc_id),
    c AS (SELECT doc_id AS run_id, lang, CASE doc_id % 6 WHEN 1 THEN {_redacted("packed")} WHEN 2 THEN packed END AS sent FROM k JOIN documents USING (doc_id)),
    t AS (SELECT *, coalesce((length(sent) + 3) // 4, 0) AS estimated_tokens FROM c),
    u AS (SELECT *, CASE WHEN sent IS NULL THEN 'privacy' WHEN sum(estimated_tokens) OVER (PARTITION BY lang ORDER BY run_id) > 3000 THEN 'budget' END AS refused FROM t)
    SELECT run_id, estimated_tokens, refused, CASE WHEN refused IS NULL THEN sha256(sent) END AS seen_hash FROM u"""

#: Draws of a Poisson number of mean 1 by 32 hashed bits: as many as bounds are reached.
_POISSON = " + ".join(f"CAST(u >= floor(4294967296 * exp(-1) * ({' + '.join(f'1.0 / {math.factorial(i)}' for i in range(n + 1))})) AS INT)" for n in range(12))
ORACLES["evaluation_intervals"] = rf"""WITH ev AS ({ORACLES["search_evaluation"]}), hs AS ({ORACLES["hybrid_signals"]}),
    d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+'), ' ') || ' ' AS said FROM documents),
    i AS (SELECT item_id AS query_id, regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') AS t FROM benchmark),
    rel AS (SELECT DISTINCT query_id, doc_id FROM i JOIN d ON contains(said, ' ' || array_to_string(i.t, ' ') || ' ') WHERE len(i.t) >= 5),
    known AS (SELECT query_id, count(*) AS known FROM rel GROUP BY 1), found AS (SELECT query_id, count(*) AS n FROM hs JOIN rel USING (query_id, doc_id) GROUP BY 1),
    j AS (SELECT query_id, 'precision' AS metric, ev.precision AS ours, coalesce(n, 0) * 1000000 // 10 AS theirs FROM ev LEFT JOIN found USING (query_id)
        UNION ALL SELECT query_id, 'recall', ev.recall, coalesce(n, 0) * 1000000 // known FROM ev JOIN known USING (query_id) LEFT JOIN found USING (query_id)),
    u AS (SELECT j.*, replica, CAST('0x' || md5('1:' || query_id || ':' || replica)[1:8] AS BIGINT) AS u FROM j, (SELECT unnest(range(1000)) AS replica)),
    w AS (SELECT *, {_POISSON} AS w FROM u),
    r AS (SELECT metric, replica, CAST(floor(sum(w * ours) / sum(w)) AS BIGINT) AS mean, CAST(floor(sum(w * (ours - theirs)) / sum(w)) AS BIGINT) AS difference FROM w WHERE w > 0 GROUP BY ALL),
    s AS (SELECT metric, count(*) AS n, list_sort(list(mean)) AS m, list_sort(list(difference)) AS d FROM r GROUP BY 1),
    a AS (SELECT metric, count(*) AS queries, CAST(floor(avg(ours)) AS BIGINT) AS mean, CAST(floor(sum(ours - theirs) / count(*)) AS BIGINT) AS difference FROM j GROUP BY 1),
    b AS (SELECT metric, queries, mean, m[n * 25 // 1000 + 1] AS low, m[n - n * 25 // 1000] AS high, difference, d[n * 25 // 1000 + 1] AS difference_low, d[n - n * 25 // 1000] AS difference_high, CAST(CASE metric WHEN 'precision' THEN 500000 ELSE 300000 END AS BIGINT) AS least FROM a JOIN s USING (metric))
    SELECT *, low >= least AS passes, CASE WHEN difference_low > 0 THEN 'better' WHEN difference_high < 0 THEN 'worse' ELSE 'undecided' END AS verdict FROM b"""
