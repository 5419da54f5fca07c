"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import centroid_clusters, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, minhash_dedup, packing, sharding, suffix_dedup, token_counts, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_documents=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16, stable_input=True)
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    return out.select("doc_id", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(table(spark, sf_dir, "documents"), word_bpe(), groups=["lang"])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe(), capacity=4096, end_id=1, keep_ids=False)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.LanguageModel.fit(docs).predicted(docs.select("doc_id", "text"))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept_text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=32)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster_report(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=40, rounds=5)


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_line_dedup, op3_token_counts, op4_warc, op5_sharding, op6_packing, op7_language_id, op8_suffix_dedup, op9_decontamination, op10_jaccard_join, op11_whitening, op12_centroid_clusters, op13_minhash_dedup)}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BASE32 = "translate(" + " || ".join(f"to_base(CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT), 32, 4)" for k in range(8)) + ", '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"



def _near(words: int, share: int) -> str:
    """near: doc_id, n_shingles, component_id."""
    return rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_FOLD.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(words) >= {words} THEN list_distinct(list_transform(range(1, len(words) - {words - 2}), lambda i: array_to_string(words[i:i + {words - 1}], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w),
        e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {share} * (a.n + b.n - count(*))),
        l AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c),
        r AS (SELECT doc_id AS start, doc_id AS node FROM s UNION SELECT r.start, l.b FROM r JOIN l ON l.a = r.node),
        near AS (SELECT s.doc_id, CAST(len(any_value(shingles)) AS BIGINT) AS n_shingles, min(node) AS component_id FROM s JOIN r ON r.start = s.doc_id GROUP BY s.doc_id)"""


def _clusters(k: int, rounds: int) -> str:
    steps = [f"""
        WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS j, x AS y FROM v QUALIFY j < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min([d, j]) AS best FROM (
                SELECT vec_id, x, j, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}) GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT j, list(CAST(floor(s / n) AS BIGINT) - CASE WHEN CAST(floor(s / n) AS BIGINT) * n > s THEN 1 ELSE 0 END ORDER BY dim) AS y FROM (
                SELECT best[2] AS j, dim, sum(x[dim])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) t(dim) GROUP BY ALL) GROUP BY j),
            c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m{i}.y, c{i}.y) AS y FROM c{i} LEFT JOIN m{i} USING (j))""")
    return ",\n".join(steps) + f"""
        SELECT vec_id, CAST(best[2] AS INT) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
               CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON j = best[2]"""


ORACLES: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_FOLD.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op2_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT doc_id, pos, line, {_FOLD.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
        c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN c USING (key) GROUP BY doc_id""",
    "op4_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, max(page_id) OVER (PARTITION BY h) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM q""",
    "op8_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
        p AS (SELECT doc_id, unnest(range(0, n_bytes - 399)) AS pos, raw FROM d WHERE n_bytes >= 400),
        h AS (SELECT doc_id, pos, sha256(raw[pos + 1:pos + 400]) AS h FROM p),
        t AS (SELECT doc_id, pos FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
        o AS (SELECT doc_id, pos, CAST(coalesce(pos - lag(pos) OVER w > 400, true) AS INT) AS opens FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        g AS (SELECT doc_id, pos, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM o),
        s AS (SELECT doc_id, min(pos) AS lo, max(pos) + 400 AS hi FROM g GROUP BY doc_id, g),
        k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM s),
        q AS (SELECT k.doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(hex(raw[since + 1:lo]), '' ORDER BY lo) || hex(any_value(raw)[max(hi) + 1:any_value(n_bytes)]) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
        SELECT d.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN kept IS NULL THEN sha256(raw) ELSE sha256(unhex(kept)) END AS kept_sha256,
               decode(CASE WHEN kept IS NULL THEN raw ELSE unhex(regexp_replace(kept, '([0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].)|..', '\\1', 'g')) END) AS kept_text
        FROM d LEFT JOIN q USING (doc_id)""",
    "op10_jaccard_join": f"{_near(5, 80)} SELECT doc_id, n_shingles, component_id FROM near",
    "op12_centroid_clusters": _clusters(k=40, rounds=5),
    "op13_minhash_dedup": f"{_near(3, 85)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near",
}
