"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to ``order`` bytes, learned from words with
the space before and after them; contexts don't cross words. The code length of a byte is
that of PPM with escape method C and exclusion, under the learned counts, which scoring
doesn't change. So a word's code lengths never vary and are computed once per worker.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._io import by_text, crc_mod, picked

ORDER = 4
SAMPLE_ROWS = 500
SAMPLE_BYTES = 4 << 20
#: Sampled bytes of all languages together; with many languages each gets an equal part of them.
ALL_BYTES = 64 << 20
MAX_LANGUAGES = 256
#: Bytes that a worker's cache of word lengths may take, about, where the caller names none; longer words aren't kept.
CACHE_BYTES = 96 << 20
CACHED_WORD = 64

RESULT = "struct<lang_pred:string,score:double>"

_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


class PpmTree:
    """Frozen byte counts of one language. counts: context -> byte -> count."""

    def __init__(self, words: Counter, order: int = ORDER) -> None:
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = {}
        for word, n in words.items():
            text = b" " + word + b" "
            for i in range(1, len(text)):
                for k in range(min(i, order) + 1):
                    at = self.counts.setdefault(text[i - k : i], {})
                    at[text[i]] = at.get(text[i], 0) + n

    def bits(self, context: bytes, byte: int) -> float:
        """Code length of the byte after the context, longest known context first."""
        out, excluded = 0.0, set()
        for k in range(min(len(context), self.order), -1, -1):
            seen = self.counts.get(context[len(context) - k :])
            if not seen:
                continue
            left = {b: n for b, n in seen.items() if b not in excluded}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if byte in left:
                return out - math.log2(left[byte] / total)
            out -= math.log2(len(left) / total)
            excluded |= left.keys()
        return out + math.log2(256 - len(excluded))


class LanguageScorer:
    def __init__(self, trees: dict[str, PpmTree], cache_bytes: int = CACHE_BYTES) -> None:
        self.languages = sorted(trees)
        self._trees = [trees[k] for k in self.languages]
        self._order = max((t.order for t in self._trees), default=0)
        #: Entries of a cache: a dict's place, a short key and a number for each language.
        self._most = max(1, cache_bytes // 2 // (250 + 8 * len(trees)))
        self._steps: dict[bytes, np.ndarray] = {}
        self._index: dict[bytes, int] = {}
        self._lengths = np.zeros((1024, len(self._trees)))

    def _word(self, word: bytes) -> np.ndarray:
        text, steps = b" " + word + b" ", self._steps
        out = np.zeros(len(self._trees))
        for i in range(1, len(text)):
            key = text[max(0, i - self._order) : i + 1]
            got = steps.get(key)
            if got is None:
                if len(steps) >= self._most:
                    steps.clear()
                got = steps[key] = np.array([t.bits(key[:-1], key[-1]) for t in self._trees])
            out += got
        return out

    def lengths(self, text: bytes) -> np.ndarray | None:
        """Code length in bits of the whole text under each language; None without any word."""
        words = text.translate(_SPLIT).split()
        if not words:
            return None
        distinct, total = set(words), np.zeros(len(self._trees))
        if long := {w for w in distinct if len(w) > CACHED_WORD}:
            for w in words:
                if w in long:
                    total += self._word(w)
            words = [w for w in words if w not in long]
            distinct -= long
        index = self._index
        new = distinct.difference(index)
        if len(index) + len(new) > self._most:
            index.clear()
            new = distinct
        while len(index) + len(new) > len(self._lengths):
            self._lengths = np.concatenate([self._lengths, np.zeros_like(self._lengths)])
        for w in new:
            self._lengths[len(index)] = self._word(w)
            index[w] = len(index)
        return total + self._lengths[np.fromiter(map(index.__getitem__, words), np.int64, len(words))].sum(0)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        bits = self.lengths(text) if text else None
        if bits is None or not self.languages or not _has_letter(text):
            return "und", 0.0
        best = int(bits.argmin())
        return self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def _has_letter(text: bytes) -> bool:
    return any(c in _LETTERS for c in text[:4096]) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER, all_bytes: int = ALL_BYTES) -> dict[str, PpmTree]:
    """Trees from (id, text, lang) rows, from about ``sample_rows`` rows of each language.

    Rows are taken by a hash of the id and the text, in proportion to the language's number
    of rows, and read in order of that hash up to ``sample_bytes`` of text a language (an
    equal part of ``all_bytes``, if that is less); longer texts than that aren't sampled, and
    equal rows count once. Up to MAX_LANGUAGES languages. No rows give no trees.
    """
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    spark = rows.sparkSession
    most = min(sample_bytes, all_bytes // len(counts))
    share = spark.createDataFrame([(k, min(1.0, 1.1 * sample_rows / n)) for k, n in counts.items()], "lang string, share double")
    hashed = rows.withColumn("hash", F.xxhash64("id", "text")).withColumn("place", F.pmod("hash", F.lit(1 << 20)) / float(1 << 20))
    sample = hashed.join(F.broadcast(share), "lang").where("place < share").where(F.octet_length("text") <= most)
    wanted: dict[str, list[tuple[str, int]]] = {k: [] for k in counts}
    rows_in, bytes_in = Counter(), Counter()
    for r in sorted(sample.select("lang", "place", "hash", F.octet_length("text").alias("size")).distinct().collect()):  # numbers, about sample_rows a language
        lang = r["lang"]
        if rows_in[lang] < sample_rows and bytes_in[lang] + r["size"] <= most:
            rows_in[lang] += 1
            bytes_in[lang] += r["size"]
            wanted[lang].append((lang, r["hash"]))
    chosen = spark.createDataFrame([w for rows_ in wanted.values() for w in rows_], "lang string, hash bigint")
    words: dict[str, Counter] = {k: Counter() for k in counts}
    for r in hashed.join(F.broadcast(chosen), ["lang", "hash"]).select("lang", F.col("text").cast("binary").alias("text")).distinct().toLocalIterator():
        words[r["lang"]].update(bytes(r["text"]).translate(_SPLIT).split())
    return {k: PpmTree(w, order) for k, w in words.items() if w}


def language(text: Column, trees: dict[str, PpmTree], cache_bytes: int = CACHE_BYTES) -> Column:
    """Struct of lang_pred and score of a text column. The trees are bounded by the sample that they were fitted on; the cache changes time and memory only."""
    sent = SparkSession.active().sparkContext.broadcast(trees)

    def judge():
        scorer = LanguageScorer(sent.value, cache_bytes)

        def one(texts: pa.Array) -> pa.Array:
            texts = texts.cast(pa.binary())
            got = [scorer.predict(t.as_py()) for t in texts]
            return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang_pred", "score"])

        return one

    return by_text(RESULT, judge)(text)


def identify(docs: DataFrame, trees: dict[str, PpmTree], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (and the columns to keep).

    The language of the shortest code for the whole text; of equal ones the first in the
    alphabet. score: its posterior probability with equal priors. ``und`` with score 0 for
    a null text, a text without a letter, or if no language was learned. Repeated rows get
    equal results; an empty table gives no rows. A kept column gives way to a result of the same name.
    """
    kept = [c for c in keep if c not in (id_col, "lang_pred", "score")]
    found = docs.select(docs[id_col].alias("id"), *(docs[c].alias(f"k{i}") for i, c in enumerate(kept)), language(docs[text_col], trees).alias("found"))
    return found.select(F.col("id").alias(id_col), *(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), "found.lang_pred", "found.score")


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    return picked(docs, id=id_col, text=text_col, lang=lang_col).where(crc_mod("id", folds) != held).where("text is not null and lang is not null")
