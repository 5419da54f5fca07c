"""Language identification by hyperdimensional profiles.

Each letter of any script has a random vector of +1 and -1, which follows from the seed and its code point. Three
letters in sequence are bound into one vector: the product of their vectors, each rotated by its place. A document's
vector bundles (adds) those of all its letter trigrams, word borders counting as a letter; a language's prototype
bundles its training documents' unit vectors. What all languages have in common, the mean of the prototypes, is taken
off both sides, and a document gets the language of largest cosine.

Texts are read whole. Trigram vectors depend on nothing but the seed and are kept in a worker as they turn up.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm._shared import free_name, frugal, keep_only, remove, ship_package, small_batches, staged

DIMENSIONS = 512
#: The code of a word's border, where letters have their code points, and bits of a code.
BORDER, CODE_BITS = 0, 21
UNDETERMINED = "und"
#: Prototypes are sums of integers, so that the order of partial sums changes nothing.
SCALE = 1 << 20
#: Bins in which scores are counted.
BINS = 1 << 16


class Profiles:
    """Trigram vectors of one seed, and documents' vectors from them."""

    def __init__(self, seed: int, dimensions: int) -> None:
        self.seed, self.dimensions = seed, dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.known, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)  # trigrams in order, and their rows
        self.vectors = np.zeros((1024, dimensions), np.int8)
        self.is_letter = np.array([chr(cp).isalpha() for cp in range(0x110000)])

    def letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            self.letters[cp] = np.where(np.random.default_rng([self.seed, cp]).random(self.dimensions) < 0.5, -1, 1).astype(np.int8)
        return self.letters[cp]

    def encode(self, text: str) -> np.ndarray:
        """Letters' code points with one border before, after and for each run of other signs."""
        cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        code = np.concatenate([[BORDER], np.where(self.is_letter[cp], cp, BORDER), [BORDER]])
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != BORDER) | (code[:-1] != BORDER)
        return code[keep]

    def trigrams(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and counts of the trigrams whose middle is a letter."""
        key = (code[:-2] << CODE_BITS | code[1:-1]) << CODE_BITS | code[2:]
        key, count = np.unique(key[code[1:-1] != BORDER], return_counts=True)
        at = np.searchsorted(self.known, key)
        new = key[self.known[np.minimum(at, len(self.known) - 1)] != key] if len(self.known) else key
        if len(new):
            self._make(new)
            at = np.searchsorted(self.known, key)
        return self.row[at], count

    def _make(self, keys: np.ndarray) -> None:
        rows = len(self.known)
        while rows + len(keys) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        low = (1 << CODE_BITS) - 1
        for i, k in enumerate(keys.tolist()):
            a, b, c = (self.letter(x) for x in (k >> 2 * CODE_BITS, k >> CODE_BITS & low, k & low))
            self.vectors[rows + i] = np.roll(a, 2) * np.roll(b, 1) * c
        known, row = np.concatenate([self.known, keys]), np.concatenate([self.row, rows + np.arange(len(keys))])
        order = np.argsort(known)
        self.known, self.row = known[order], row[order]

    def unit(self, text: str | None) -> np.ndarray | None:
        """The document's vector at length 1; None if the text has no letter."""
        code = self.encode(text) if text else ()
        if len(code) < 3:
            return None
        at, count = self.trigrams(code)
        exact = np.float32 if len(code) < 1 << 24 else np.float64  # sums of whole numbers
        v = count.astype(exact) @ self.vectors[at].astype(exact)
        norm = np.linalg.norm(v)
        return v / norm if norm else v


_MADE: dict[tuple[int, int], Profiles] = {}


def profiles(seed: int, dimensions: int) -> Profiles:
    keep_only("profiles", _MADE.clear)
    key = (seed, dimensions)
    if key not in _MADE or len(_MADE[key].known) > 200_000:  # a bound on the memory that trigrams of many scripts take
        _MADE[key] = Profiles(seed, dimensions)
    return _MADE[key]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning; a null id is not held out, but nothing is learned from it either."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def labelled(docs: DataFrame, wanted: Column, id_col: str, text_col: str, lang_col: str, max_languages: int) -> DataFrame | None:
    """All rows that have an id, a text and a language and are wanted; None if there are none."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & wanted)
    languages = rows.select(lang_col).distinct().limit(max_languages + 1).count()
    if languages > max_languages:
        raise ValueError(f"over {max_languages} languages")
    return rows if languages else None


def percentile(scores: DataFrame, share: float) -> float | None:
    """The exact percentile (interpolated) of all of ``score``, from 0 to 1; None if there is none.

    Scores are counted in BINS bins, and only the bins of the one or two wanted ranks are looked at score by score, so
    that no task or driver holds them all."""
    within = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    counts = sorted(tuple(r) for r in scores.groupBy(within.alias("bin")).agg(F.count("score")).where("bin is not null").collect())  # BINS at most
    n = sum(c for _, c in counts)
    if not n:
        return None
    place = share * (n - 1)
    below, wanted, found = 0, sorted({math.floor(place), math.ceil(place)}), []
    for number, count in counts:
        ranks = [r - below for r in wanted if below <= r < below + count]
        if ranks:
            each = sorted(tuple(r) for r in scores.where(within == number).groupBy("score").count().collect())  # one bin's different scores
            until = list(accumulate(c for _, c in each))
            found += [each[bisect_right(until, r)][0] for r in ranks]
        below += count
    return found[0] + (found[-1] - found[0]) * (place - math.floor(place))


class LanguageModel:
    def __init__(self, languages: list[str], prototypes: np.ndarray, seed: int, dimensions: int) -> None:
        self.languages, self.seed, self.dimensions = languages, seed, dimensions
        unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12) if languages else prototypes
        self.mean = unit.mean(axis=0) if len(languages) > 1 else np.zeros(dimensions)
        centred = unit - self.mean
        self.prototypes = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12) if languages else centred

    @classmethod
    def fit(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int = 2000, seed: int = 17, dimensions: int = DIMENSIONS) -> LanguageModel:
        """Learns from rows that are not held out and have an id, a text and a language.

        All of them are taken, whatever their order. ``max_languages`` bounds the model, which every task gets; more
        raise an error. Repeated rows count each; without any such row the model is empty."""
        ship_package(docs.sparkSession)
        small_batches(docs.sparkSession)
        known = labelled(docs, ~held_out(F.col(id_col)), id_col, text_col, lang_col, max_languages)
        if known is None:
            return cls([], np.zeros((0, dimensions)), seed, dimensions)

        def run(batches):
            made, sums = profiles(seed, dimensions), {}
            for b in batches:
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if (v := made.unit(text)) is not None:
                        sums[lang] = sums.get(lang, 0) + np.rint(v * SCALE).astype(np.int64)
            for lang, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], names=["lang", "at", "value"])

        found = known.select(F.col(lang_col).alias("lang"), text_col).mapInArrow(frugal(run, "profiles"), "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()
        learned = sorted({r["lang"] for r in found})
        out = np.zeros((len(learned), dimensions))
        for r in found:
            out[learned.index(r["lang"]), r["at"]] = r["value"]
        return cls(learned, out, seed, dimensions)

    def predictor(self):
        languages, mean, prototypes, seed, dimensions = self.languages, self.mean, self.prototypes, self.seed, self.dimensions

        @F.arrow_udf("struct<lang: string, score: double>")
        def predict(text: pa.Array) -> pa.Array:
            made, langs, scores = profiles(seed, dimensions), [], []
            for t in text:
                v = made.unit(t.as_py()) if languages else None
                if v is None:
                    langs.append(UNDETERMINED), scores.append(0.0)
                    continue
                v = v - mean
                cosines = prototypes @ (v / max(np.linalg.norm(v), 1e-12))
                best = int(np.argmax(np.round(cosines, 9)))
                langs.append(languages[best]), scores.append(float(min(max((1 + cosines[best]) / 2, 0.0), 1.0)))
            return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

        return predict

    def predicted(self, docs: DataFrame, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
        """``docs`` with lang_pred and score (or columns of these names), (1 + cosine) / 2. Null text, or text without a letter, is und with score 0;
        so is every text if nothing was learned. Equal cosines go to the first language by name; columns of these names
        are replaced."""
        docs = docs.drop(lang, score)
        (p,) = free_name(docs, "prediction")
        out = docs.withColumn(p, self.predictor()(F.col(text_col)))
        return out.withColumn(lang, F.col(p)["lang"]).withColumn(score, F.col(p)["score"]).drop(p)


def accepted(docs: DataFrame, lost_share: float = 0.0005, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int = 2000, **parameters) -> DataFrame:
    """The rows of ``docs`` whose text is in a language that was learned, with all their columns.

    A row goes if it is und or scores less than all but ``lost_share`` of the labelled rows do that were held out and
    are predicted right, all of which are scored: texts in other languages or of no
    language, while clean ones stay. Where nothing was learned, every text with a letter stays; where nothing was held
    out, every score does. Null and empty texts go; repeated rows and rows of null id are judged like any other; an
    empty table stays empty."""
    columns = dict(id_col=id_col, text_col=text_col, lang_col=lang_col, max_languages=max_languages)
    model = LanguageModel.fit(docs, **columns, **parameters)
    if not model.languages:
        return docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    known = labelled(docs, held_out(F.col(id_col)), **columns)
    least = 0.0
    if known is not None:
        scored = model.predicted(known.select(text_col, F.col(lang_col).alias("told")), text_col).where("told = lang_pred")
        scores, path = staged(scored.select("score"), "held-out-scores")
        least = percentile(scores, lost_share) or 0.0
        remove(docs.sparkSession, path)
    lang, score = free_name(docs, "lang_pred", "score")
    out = model.predicted(docs, text_col, lang, score)
    return out.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).select(*docs.columns)
