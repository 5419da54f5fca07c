"""Each operator against a plain version of itself, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docloom.llm import _bytes as B
from docloom.llm import decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, packing, queries, sharding, suffix_dedup, token_counts, warc
from docloom.llm._anchors import StringHashes
from docloom.llm._bloom import may_be_in
from docloom.llm._bwt import Collection
from docloom.llm._tokens import UnitTokenizer
from docloom.llm.components import connected_components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept_text string, row string, class string, lang_pred string, shard string, kept string"
SEPARATORS = re.compile(r"[\x20\x09-\x0d]+")


def fold(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words_of(t: str | None) -> list[str]:
    return [w for w in SEPARATORS.split(fold(t or "")) if w]


def texts() -> list[tuple[int | None, str | None]]:
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("etaoinshrdlué") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base, passage, line = prose(120), prose(90), "Common LINE of many"
    out: list[tuple[int | None, str | None]] = [(None, None), (None, "no id here"), (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "ONE"), (6, "one"), (6, "one"), (7, "a b c d e"), (8, "A b c d E"), (9, "é è\n日本 語")]
    out += [(20 + i, base) for i in range(6)]
    for i in range(24):  # near copies, some of them too far away
        w = base.split(" ")
        for _ in range(rnd.choice([1, 1, 2, 3, 6])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary) + "x"
        out.append((40 + i, " ".join(w)))
    for i in range(14):
        out.append((80 + i, f"{prose(40)}\n  {line if i % 2 else line.upper()}\t\n{passage}\n{prose(rnd.randint(1, 60))}"))
    for i in range(40):  # small sets
        w = ["k%d" % j for j in range(rnd.choice([8, 9, 10, 11, 13]))]
        if i % 3:
            w[rnd.choice([0, -1])] = f"z{i % 4}"
        out.append((100 + i, " ".join(w)))
    out.append((200, prose(30_000)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "x", "x", "x", "x", "x", "x", "x") for i, t in texts()]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, t in texts():
        groups[fold(t or "")].append(i)
    got = exact_dedup.dedup_report(docs).collect()
    assert len(got) == len(texts())
    kept = Counter()
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[r.text_sha256]
        assert (r.keep_id, r.group_size) == (max((i for i in ids if i is not None), default=None), len(ids))
        assert not r.kept or r.doc_id == r.keep_id
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted(fold(r.text or "") for r in left.collect()) == sorted(groups)
    assert exact_dedup.dedup_report(empty).count() == 0 == exact_dedup.deduplicated(empty).count()


def test_cuckoo_filter_inserts_deletes_and_grows(spark):
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    shard = exact_dedup.Shard(exact_dedup.CuckooFilter(1), {})
    for k in keys:
        shard.insert(k, (1, 1), 1)
    assert all(k in shard.filter for k in keys) and shard.filter.mask > 255
    for k in keys[:1500]:
        shard.delete(k)
    assert all(k in shard.filter for k in keys[1500:]) and len(shard.content) == 1500
    assert sum(k in shard.filter for k in keys[:1500]) < 30
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys[:50])], "digest string, doc_id long")
    index = exact_dedup.CuckooIndex.build(rows, shard_rows=10).delete(rows.where("doc_id < 20")).insert(rows.where("doc_id >= 15"))
    found = {r.digest: r.group_size for r in index.content().collect()}
    assert found == {k: 1 if i < 20 else 2 for i, k in enumerate(keys[:50]) if i >= 15}
    more = index.insert(spark.createDataFrame([(k, i) for i, k in enumerate(keys[30:])], "digest string, doc_id long"))
    assert more.shards > 10 * index.shards and more.content().count() == 3000 - 15
    assert max(r["count"] for r in more.table.where("kind = 1").groupBy("shard").count().collect()) < 4 * 10
    assert more.delete(rows).content().count() == 2950


def test_line_dedup(docs, empty):
    count = Counter()
    for _, t in texts():
        count.update({fold(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")})
    expected = []
    for i, t in texts():
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (k := fold(x.strip(" \t\n\x0b\x0c\r"))) or count[k] < 10]
        expected.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert any(e[2] for e in expected)
    assert line_dedup.line_dedup(empty).count() == 0


def test_tokens_are_the_tokenizer_s():
    import pyarrow as pa

    from docloom.llm._bytes import text_buffers

    own = UnitTokenizer(TOKENIZER, limit=200, recent=20)
    rnd = random.Random(1)
    many = ["It's we'll THEY'RE x'abc 'tis don''t ''s", "É école ß “quoted”, ‘it’s’ … a—b", "<|endoftext|> hi", "12345 3.14 ½", "İ ΣΑΣ ﬁ", "日本語 русский", "\x01\x02a\x00b \x7f", None, ""]
    many += ["".join(rnd.choice("abZ'é1.,-“ \ń½_İ<|>") for _ in range(50)) for _ in range(200)]
    for k in range(0, len(many), 7):
        part = many[k : k + 7]
        data, offsets = text_buffers(pa.array(part, pa.string()))
        flat, begin = own.ids(data, offsets)
        assert [flat[begin[i] : begin[i + 1]].tolist() for i in range(len(part))] == [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]


def plain_lengths():
    tokenizer = UnitTokenizer(TOKENIZER).tokenizer
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in texts()]


def test_token_counts(docs, empty):
    lengths = [len(x) for _, x in plain_lengths()]
    rows = {r.n_tokens: r for r in token_counts.token_report(docs, TOKENIZER, ["lang"]).collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r.n_documents == lengths.count(n)
        assert (r.documents_from, r.tokens_from) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.total_documents, r.total_tokens, r.truncated_tokens) == (len(lengths), sum(lengths), sum(min(x, n) for x in lengths))
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    histogram = token_counts.length_histogram(docs, TOKENIZER)
    at = token_counts.totals_at(histogram, [50]).first()
    assert (at.truncated_tokens, at.documents_cut) == (sum(min(x, 50) for x in lengths), sum(x > 50 for x in lengths))
    half = token_counts.quantile_lengths(token_counts.limit_report(histogram), [0.5]).first().n_tokens
    assert sum(x <= half for x in lengths) * 2 >= len(lengths) > 2 * sum(x < half for x in lengths)
    assert token_counts.token_report(empty, TOKENIZER, ["lang"]).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/x", "same"), (2, "http://a/y z", "same"), (3, None, ""), (4, "u", None), (5, "http://b", "WARC/1.1\r\n\r\n\r\nx é\r\n\r\n"), (None, "n", "same"), (6, "v", "a" * 3_000_000), (7, "w\r\nX-Page-Id: 9", "tail"), (8, "w", "a" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    got = {r.page_id: r for r in warc.archive_report(pages, path).collect()}
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        first = max(x for x in groups[h or ""] if x is not None)
        raw = (h or "").encode()
        kind = ("response", None) if i == first else ("revisit", first)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *kind)
    index = warc.build_index(spark, path)
    some = warc.read_payloads(index.where("page_id in (5, 7)")).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in some} == {5: rows[4][2], 7: "tail"}
    ranges = warc.coalesced_ranges(index, read_bytes=1 << 30, gap_bytes=1 << 30)
    assert ranges.count() == index.select("file").distinct().count()
    assert warc.archive_report(pages.where("page_id > 99"), f"file://{tmp_path}/none").count() == 0


def test_sharding(docs, empty, spark):
    out = sharding.shuffle_into_shards(docs, shards=5, cell_rows=4).collect()
    assert Counter(r.text for r in out) == Counter(t for _, t in texts())
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(5))
    for s in range(5):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert sharding.shuffle_into_shards(empty, shards=5).count() == 0
    clashing = docs.select("doc_id", F.lit("x").alias("file"), F.lit("y").alias("order"), F.lit("z").alias("cell"))
    assert sharding.shuffle_into_shards(clashing, shards=3).where("file = 'x' and order = 'y' and cell = 'z'").count() == len(texts())


def test_shards_do_not_depend_on_how_files_are_split(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 64)
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = []
    for split in ("1g", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        found.append({(r.doc_id, r.shard, r.slot) for r in sharding.shuffle_into_shards(docs, shards=4, cell_rows=10, stable_input=True).collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and len(found[0]) == docs.count()


def test_communication_matrix_has_the_law_of_a_uniform_shuffle():
    m = sharding.communication_matrix(np.array([5, 0, 7]), np.array([4, 4, 4]), 1)
    assert m.sum(axis=1).tolist() == [5, 0, 7] and m.sum(axis=0).tolist() == [4, 4, 4]
    # against direct enumeration of every placement of six rows into six places
    counts, sizes = [3, 2, 1], [2, 3, 1]
    owner, shard = [p for p, n in enumerate(counts) for _ in range(n)], [s for s, n in enumerate(sizes) for _ in range(n)]
    law = Counter()
    for order in itertools.permutations(range(6)):
        made = np.zeros((3, 3), int)
        for row, place in enumerate(order):
            made[owner[row], shard[place]] += 1
        law[made.tobytes()] += 1
    draws = 4000
    seen = Counter(sharding.communication_matrix(np.array(counts), np.array(sizes), seed).astype(int).tobytes() for seed in range(draws))
    assert set(seen) <= set(law)
    chi = sum((seen[k] - draws * n / 720) ** 2 / (draws * n / 720) for k, n in law.items())
    assert chi < len(law) + 5 * (2 * len(law)) ** 0.5


def test_large_hypergeometric_draws(monkeypatch):
    good, bad, n = 9, 14, 8
    law = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(n + 1)]
    monkeypatch.setattr(sharding, "LARGE", 0)
    rng, draws = np.random.default_rng(3), 20_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(draws))
    assert sum((seen[k] - draws * p) ** 2 / (draws * p) for k, p in enumerate(law)) < 35
    assert [sharding.hypergeometric(rng, *x) for x in ((0, 5, 3), (5, 0, 3), (4, 4, 8), (4, 4, 0))] == [0, 3, 4, 0]
    monkeypatch.undo()
    counts, sizes = np.full(4, 500_000_000), np.array([700_000_000, 700_000_000, 600_000_000])
    made = np.array([sharding.communication_matrix(counts, sizes, seed) for seed in range(60)])
    assert (made.sum(axis=1) == sizes).all() and (made.sum(axis=2) == counts).all()
    mean, var = 500e6 * 0.35, 500e6 * 0.35 * 0.65 * (2e9 - 500e6) / (2e9 - 1)
    first = made[:, :, 0].ravel()
    assert abs(first.mean() - mean) < 4 * (var / 60) ** 0.5 and 0.7 < first.std() ** 2 / var < 1.35


def test_best_fit_plan():
    rnd = random.Random(8)
    for capacity in (10, 64, 4096):
        for _ in range(20):
            counts = {rnd.randint(1, capacity): rnd.randint(1, 40) for _ in range(rnd.randint(1, 30))}
            plan = packing.best_fit_plan(counts, capacity)
            used = defaultdict(list)
            for n, entries in plan.items():
                for k in range(counts[n]):
                    first, b, each, at = max(e for e in entries if e[0] <= k)
                    used[b + (k - first) // each].append((at + (k - first) % each * n, n))
            for spans in used.values():
                end = 0
                for at, n in sorted(spans):
                    assert at == end
                    end = at + n
                assert end <= capacity
            assert sorted(used) == list(range(len(used)))
            bins: list[int] = []  # best fit over the documents themselves
            for n in sorted((n for n in counts for _ in range(counts[n])), reverse=True):
                room = [i for i, r in enumerate(bins) if r >= n]
                if room:
                    bins[min(room, key=lambda i: bins[i])] -= n
                else:
                    bins.append(capacity - n)
            assert len(used) == len(bins)


def test_packing(docs, empty):
    out = packing.pack(docs, TOKENIZER, capacity=64).collect()
    pieces = Counter()
    for i, ids in plain_lengths():
        ids = [*ids, 1]
        for k in range(0, len(ids), 64):
            pieces[(i, k // 64, k, tuple(ids[k : k + 64]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in out) == pieces
    used = defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end = at + n
        assert end <= 64
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_language_id(spark, sf_dir, empty):
    docs = queries.table(spark, sf_dir, "documents")
    got = queries.op7_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    model = language_id.LanguageModel.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?!"), (4, "日本"), (None, "the and of")], "doc_id long, text string").withColumn("score", F.lit("x"))
    found = {r.text: r.lang_pred for r in model.predicted(odd).collect()}
    assert [found[t] for t in (None, "", "12 ?!")] == ["und"] * 3 and found["日本"] != "und" and found["the and of"] == "en"
    assert language_id.LanguageModel.fit(empty).predicted(odd.drop("score")).select("lang_pred").distinct().first().lang_pred == "und"
    left = {r.doc_id for r in language_id.accepted(docs).collect()}
    assert {r.doc_id for r in got if r.lang_pred == "und"}.isdisjoint(left) and len(left) >= 0.99 * len(got)


def test_language_id_learns_from_all_rows(spark):
    rows = [(i, "abc" if i < 10_000 else "xyz", "aa") for i in range(10_100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5]
    model, made = language_id.LanguageModel.fit(docs), language_id.profiles(17, language_id.DIMENSIONS)
    total = sum(np.rint(made.unit(rows[i][1]) * language_id.SCALE).astype(np.int64) for i in learned)
    assert np.allclose(model.prototypes[0], total / np.linalg.norm(total), atol=1e-12)
    assert set(language_id.labelled(docs, ~language_id.held_out(docs.doc_id), "doc_id", "text", "lang", 5).select("doc_id").toPandas()["doc_id"]) == set(learned)
    rnd = random.Random(3)
    for values in ([], [0.25], [0.0, 1.0, 1.0], [0.5] * 40, [rnd.choice([rnd.random(), 0.75, 0.75 + rnd.random() * 1e-7]) for _ in range(3000)]):
        scores = spark.createDataFrame([(v,) for v in values], "score double")
        for share in (0, 0.0005, 0.3, 0.5, 1):
            expected = float(np.percentile(values, share * 100)) if values else None
            assert language_id.percentile(scores, share) == pytest.approx(expected, abs=1e-12)


def test_language_id_is_the_plain_version_s(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = docs.collect()
    letters: dict[int, np.ndarray] = {}

    def letter(c: str) -> np.ndarray:
        cp = ord(c) if c != " " else 0
        if cp not in letters:
            letters[cp] = np.where(np.random.default_rng([17, cp]).random(512) < 0.5, -1, 1)
        return letters[cp]

    def vector(text):
        t = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip(" ") + " "
        v = np.zeros(512)
        for (a, b, c), n in Counter(t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " ").items():
            v += n * np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        return v / np.linalg.norm(v)

    sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(512))
    for r in rows:
        if r.text and r.lang and any(c.isalpha() for c in r.text) and zlib.crc32(str(r.doc_id).encode()) % 5:
            sums[r.lang] += vector(r.text)
    names = sorted(sums)
    unit = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    mean = unit.mean(axis=0)
    centred = (unit - mean) / np.linalg.norm(unit - mean, axis=1, keepdims=True)
    got = {r.doc_id: r for r in queries.op7_language_id(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        v = vector(r.text) - mean
        cosines = centred @ v / np.linalg.norm(v)
        assert got[r.doc_id].score == pytest.approx((1 + cosines.max()) / 2, abs=1e-4)
        assert cosines[names.index(got[r.doc_id].lang_pred)] >= cosines.max() - 1e-4


def test_language_id_knows_scripts_and_rejects_what_it_has_not_learned(spark):
    rnd = random.Random(5)
    alphabets = {"aa": "abcdefgh", "ru": "абвгдежз", "zh": "的一是不了在人有", "gr": "αβγδεζηθ"}
    text = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(60))
    rows = [(i, text(alphabets[n]), n, "x") for i, n in enumerate(sorted(alphabets) * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    found = language_id.LanguageModel.fit(docs).predicted(docs).collect()
    assert all(r.lang_pred == r.lang for r in found)
    odd = spark.createDataFrame([(1000, text("კლმნოპჟრ"), None, "x"), (1001, "12", None, "x"), (1002, None, None, "x"), (None, text("abcdefgh"), None, "x")], docs.schema)
    left = language_id.accepted(docs.unionByName(odd))
    ids = {r.doc_id for r in left.collect()}
    assert left.columns == docs.columns and not ids & {1000, 1001, 1002} and None in ids and len(ids) >= 399
    assert sorted(r.doc_id for r in language_id.accepted(odd).collect() if r.doc_id) == [1000]


def test_collections_find_repeated_strings():
    rnd = random.Random(3)
    for trial in range(40):
        letters = b"ab" if trial % 2 else b"abcdefghij"
        base = bytes(rnd.choice(letters) for _ in range(300))
        some, at = [], []
        for _ in range(rnd.randint(1, 14)):
            i, n = rnd.randint(0, 200), rnd.randint(0, 90)
            t = bytearray(base[i : i + n])
            for _ in range(rnd.randint(0, 3) if t else 0):
                t[rnd.randrange(len(t))] = rnd.choice(letters)
            some.append(bytes(t))
            at.append(rnd.choice([min(max(250 - i, 0), n), rnd.randint(0, n)]))
        length = rnd.choice([1, 3, 8, 20])
        count = Counter((t[i : i + length], a - i) for t, a in zip(some, at, strict=True) for i in range(min(a, len(t) - length) + 1))
        expected = [[i for i in range(min(a, len(t) - length) + 1) if count[t[i : i + length], a - i] > 1] for t, a in zip(some, at, strict=True)]
        assert [x.tolist() for x in Collection(some, at).repeated(length)] == expected


@pytest.mark.parametrize(("length", "most"), [(60, 2000), (60, 2), (100, 3), (400, 2000)])
def test_suffix_dedup(docs, empty, length, most):
    raw = [(i, (t or "").encode()) for i, t in texts()]
    count = Counter(r[k : k + length] for _, r in raw for k in range(len(r) - length + 1))
    expected = []
    for i, r in raw:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if count[r[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        expected.append((i, len(r), int(gone.sum()), spans, np.frombuffer(r, np.uint8)[~gone].tobytes()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs, length=length, most=most).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert any(e[2] for e in expected)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_decontamination(spark, docs, empty):
    rnd = random.Random(6)
    item = [f"w{rnd.randrange(900)}" for _ in range(40)]
    edited = [*item[:9], "other", *item[10:20], *item[21:33], "more", "words", *item[33:]]
    noise = lambda n: " ".join(f"w{rnd.randrange(900)}" for _ in range(n))
    rows = [(1, f"{noise(50)} {' '.join(item)} {noise(30)}"), (2, f"{noise(20)}\n{' '.join(edited).upper()}*** {noise(9)}"), (3, noise(400)), (4, " ".join(item[:12]) + noise(200)), (5, None), (6, ""), (None, " ".join(item))]
    corpus = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("x"))
    tests = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (10, noise(30)), (11, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(corpus, tests).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)}
    assert got[(1, 7)].score == 1.0 and 0.6 < got[(2, 7)].score < 1
    r = got[(1, 7)]
    assert rows[0][1].encode()[r.start : r.stop].decode() == " ".join(item)
    clean = decontaminate.decontaminated(corpus, tests)
    assert clean.columns == corpus.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6]
    small = decontaminate.Settings(block_bytes=100)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(corpus, tests, small).collect()} == set(got)
    assert decontaminate.leaks(corpus, tests.where("false")).count() == 0 == decontaminate.leaks(empty, tests).count()


def plain_alignment(item: list[str], text: list[str]) -> float:
    above, best = [0.0] * (len(text) + 1), 0.0
    for a in item:
        here = [0.0]
        for j, b in enumerate(text):
            here.append(max(0.0, above[j] + (1 if a == b else -0.5), above[j + 1] - 0.5, here[j] - 0.5))
        above, best = here, max(best, *here)
    return best / len(item)


def test_decontamination_of_dense_edits_repeated_often(spark):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(500)}"
    items = {k: [word() for _ in range(24)] for k in range(6)}
    items[6] = ["again", "and", "again", *items[0][:9], *["again", "and"] * 5, *items[0][9:14]]
    made = []
    for k, item in items.items():
        every = [[f"x{i}" if i % 5 == 4 else w for i, w in enumerate(item)], [x for i, w in enumerate(item) for x in ([w, "y", "y", "y"] if i in (5, 9, 13, 17) else [w])], item[:10] + ["z"] * 14 + item[10:]]
        for _ in range(6):
            w = list(item)
            for _ in range(rnd.choice([3, 6, 9])):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randrange(2)] = [word() for _ in range(rnd.randrange(3))]
            every.append(w)
        made += [([word() for _ in range(30)] + w + [word() for _ in range(rnd.choice([0, 30]))]) for w in every]
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    expected = {}
    for d, w in enumerate(made):
        for k, item in items.items():
            if grams(w) & grams(item) and (score := plain_alignment(item, w)) >= 0.5:
                expected[(d, k)] = round(score, 6)
    assert {(9 * k, k) for k in range(6)} <= set(expected)
    copies = 50  # of each text: 3,150 rows
    corpus = spark.createDataFrame([(d, " ".join(w)) for _ in range(copies) for d, w in enumerate(made)], "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = Counter((r.doc_id, r.item_id, r.score) for r in decontaminate.leaks(corpus, tests).collect())
    assert found == {(d, k, score): copies for (d, k), score in expected.items()}


def test_decontamination_against_alignment_of_all_pairs(spark, sf_dir):
    """Plain Smith-Waterman of every item with every document, seeds or not: nothing wrong is found, and recall is 0.9 or more."""
    docs, tests = (queries.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    numbers: dict[str, int] = {}
    words = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFC", (t or "").casefold()))], np.int64)
    corpus = {r.doc_id: words(r.text) for r in docs.collect()}
    expected = {}
    for r in tests.collect():
        item = words(r.text)
        for d, text in corpus.items():
            if len(item) == 0 or np.isin(item, text).mean() < 0.5:
                continue
            above, ramp, best = np.zeros(len(text) + 1), 0.5 * np.arange(1, len(text) + 1), 0.0
            for w in item:
                here = np.maximum(np.maximum(above[:-1] + np.where(text == w, 1, -0.5), above[1:] - 0.5), 0)
                above[1:] = np.maximum.accumulate(here + ramp) - ramp
                best = max(best, above.max())
            if best / len(item) >= 0.5:
                expected[(d, r.item_id)] = round(best / len(item), 6)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, tests).collect()}
    assert expected and set(got) <= set(expected) and all(s == expected[k] for k, s in got.items())
    assert len(got) >= 0.9 * len(expected)


def test_decontamination_edges(spark):
    greek = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = [(1, "no " * 10 + greek), (2, "tie one two three four"), (3, "tie one two three four"), (4, None)]
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    rnd = random.Random(2)
    long = " ".join(f"v{rnd.randrange(5000)}" for _ in range(200_000))
    rows = [(1, "no " * 10 + "alpha"), (2, "Tie, one two three four."), (2, "Tie, one two three four."), (3, f"{long} {items[1][1]} {long}"), (None, None)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit("x"), "score": F.lit("y")})
    found = Counter((r.doc_id, r.item_id, r.score) for r in decontaminate.leaks(corpus, tests).collect())
    assert found == {(1, 1, 0.55): 1, (2, 2, 1.0): 2, (2, 3, 1.0): 2, (3, 2, 1.0): 1, (3, 3, 1.0): 1}
    assert [r.doc_id for r in decontaminate.decontaminated(corpus, tests).collect()] == [None]
    assert decontaminate.decontaminated(corpus, tests.where("false")).count() == 5


def test_decontamination_folds_every_script(spark):
    items = {1: "Élève déjà très âgé à l’école où naît l’été près du château brûlé", 2: "Съешь же ещё этих мягких французских булок да выпей чаю", 3: "Ο γρήγορος σκύλος πηδάει πάνω από τον τεμπέλη λύκο της αυλής", 4: "Die große Straße führt über Brücken zu schönen Gärten, sagte Ünal"}
    set_anew = lambda t: "“" + t.replace(" ", "\u00a0— ").replace("’", "'") + "”…"
    forms = [str.upper, str.title, lambda t: unicodedata.normalize("NFD", t), lambda t: unicodedata.normalize("NFD", t).upper(), set_anew]
    rows = [(10 * k + i, "avant «" + f(t) + "» après") for k, t in items.items() for i, f in enumerate(forms)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.leaks(corpus, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in found) == [(d, d // 10, 1.0) for d, _ in rows]
    for r in found:
        form = forms[r.doc_id % 10](items[r.item_id]).strip("“”…")
        assert dict(rows)[r.doc_id].encode()[r.start : r.stop].decode() == form
    odd = np.frombuffer(b"a\xe2\x82 \xff\xc3 \xf0\x9f\x98\x80b \xc3", np.uint8)  # not UTF-8, and a sign of four bytes
    assert B.letter_words(odd, np.array([0, len(odd)]))[1].tolist() == [0, 4, 11, 13]


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return sorted(((rows[i][0], len(sets[i]), min((d for d in least[root(i)] if d is not None), default=None)) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("frequent_from", [16, 3])
def test_jaccard_join(docs, empty, monkeypatch, frequent_from):
    monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", frequent_from)
    got = jaccard_join.near_duplicates(docs)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == plain_components(texts())
    assert jaccard_join.near_duplicates(empty).count() == 0
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    wanted = Counter(c for _, n, c in set(plain_components(texts())) if n)
    assert len({r.doc_id for r in left.collect() if words_of(r.text)}) == len(wanted)


@pytest.mark.parametrize(("tile", "frequent_from"), [(7, 16), (3, 2)])
def test_long_lists_are_compared_in_tiles(spark, monkeypatch, tile, frequent_from):
    monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", frequent_from)
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 3])):
            w[rnd.randrange(60)] = f"e{rnd.randrange(5) if i % 2 else i}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == plain_components(rows)


def test_sizes_of_subsets_and_prefixes():
    rule = jaccard_join.Rule()
    assert rule.light_sizes() == 9
    for a in range(1, 40):
        for b in range(a, 40):
            least = next(o for o in range(a + 1) if 100 * o >= 80 * (a + b - o)) if any(100 * o >= 80 * (a + b - o) for o in range(a + 1)) else None
            if least is not None:
                assert rule.overlap(a, b) == least and b in rule.partners(a) and a in rule.partners(b)
                assert least >= a - rule.prefix(a) + 1 and least >= b - rule.prefix(b) + 1


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    order = rnd.sample(range(200), 200)
    links = [(order[i], order[i + 1]) for i in range(119)] + [(order[150], order[i]) for i in range(151, 200)] + [(order[130], order[130])]
    table, _ = connected_components(spark.createDataFrame(links, "a long, b long"))
    got = {r.node: r.component for r in table.collect()}
    assert got == {x: min(order[:120]) for x in order[:120]} | {x: min(order[150:]) for x in order[150:]}


def test_clashing_columns_and_long_lines(spark, docs):
    clash = docs.select("doc_id", "text", *(F.lit("x").alias(c) for c in ("sequence_id", "offset", "n_tokens", "length", "part", "pos", "line", "row_id", "spans", "crc", "n_bytes", "maybe", "n_lines")))
    pieces = packing.pack(clash, TOKENIZER, capacity=64, keep_ids=False)
    assert pieces.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and pieces.where("offset is null").count() == 0
    assert token_counts.token_report(clash, TOKENIZER).count() == token_counts.token_report(docs, TOKENIZER).count()
    cut = suffix_dedup.suffix_dedup(clash, length=60)
    assert cut.where("maybe = 'x' and spans = 'x' and crc = 'x'").count() == len(texts()) and cut.where("n_removed > 0 and n_bytes > 0").count() > 0
    lines = line_dedup.line_dedup(clash)
    assert lines.where("maybe = 'x' and row_id = 'x' and n_dropped > 0 and n_lines > 0").count() > 0
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, None, None)], "page_id long, url string, html string")
    more = pages.withColumns({c: F.lit("x") for c in ("digest", "first_id", "many", "maybe", "n", "value")})
    report = lambda p: sorted(map(repr, warc.archive_report(p).collect()))
    assert report(more) == report(pages)


def test_many_lines_take_time_in_proportion(spark, tmp_path):
    n = 200_000
    common = "\n".join(f"c{i}" for i in range(0, n, 4))
    text = "\n".join(f"c{i}" if i % 4 == 0 else f"own {i}" for i in range(n))
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(0, text), *((k, common) for k in range(1, 11))], "doc_id long, text string").write.parquet(path)
    began = time.monotonic()
    r = line_dedup.line_dedup(spark.read.parquet(path)).where("doc_id = 0").first()
    assert (r.n_lines, r.n_dropped) == (n, n // 4) and r.kept_text == "\n".join(f"own {i}" for i in range(n) if i % 4)
    assert time.monotonic() - began < 60


def test_bloom_filter_keeps_every_key(spark):
    keys = spark.range(3000).select((F.xxhash64("id")).alias("h"))
    maybe = may_be_in(keys, bits=16)
    asked = spark.range(20_000).withColumn("maybe", maybe(F.xxhash64("id")))
    passed = {r.id for r in asked.where("maybe").collect()}
    assert set(range(3000)) <= passed and len(passed) < 7000
    none = may_be_in(keys.where("false"))
    assert spark.range(10).where(none(F.xxhash64("id"))).count() == 0


def test_hashes_name_strings_wherever_they_stand():
    rnd = random.Random(7)
    data = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(3000)), np.uint8)
    at = np.arange(2980)
    names = StringHashes(data).of(at, at + 20)
    strings = [data[i : i + 20].tobytes() for i in at]
    for x in names:
        assert len(set(x.tolist())) == len(set(strings)) == len(set(zip(strings, x.tolist(), strict=True)))
    sets = [np.unique(np.array([rnd.randrange(1 << 63) for _ in range(n)], np.uint64)) for n in (1, 2, 50, 50)]
    assert len({jaccard_join.class_of(s) for s in sets}) == 4 and jaccard_join.class_of(sets[2])[1] >> jaccard_join.CHECK_BITS == 50


def test_lines_are_counted_by_documents(spark):
    """Ten rows of one document are one document, as in the SQL; rows without an id are documents of their own."""
    rows = [(1, "boiler\nown")] * 10 + [(2, "boiler\nx")] + [(None, "lost\ny")] * 9 + [(3, "lost"), (3, "lost\nlost")]
    rows += [(10 + i, "common") for i in range(9)] + [(10, "common\nz"), (20, " COMMON\t")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    kept = {(r.doc_id, r.text): r.kept_text for r in got.collect()}
    assert kept == {(i, t): {"boiler\nown": "boiler\nown", "boiler\nx": "boiler\nx", "lost\ny": "y", "common\nz": "z"}.get(t, "") for i, t in rows}
    with duckdb.connect() as con:
        con.execute("create table documents as select * from (values " + ", ".join(f"({i}, '{t}')" for i, t in rows if i is not None and i < 3).replace("\n", "' || chr(10) || '") + ") t(doc_id, text)")
        assert con.sql(queries.ORACLES["op2_line_dedup"]).df().n_dropped.sum() == 0
