"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Counting: each task counts words by a 64-bit hash and sends sorted runs of (hash, count),
packed, to ranges of the hash; a range's merged words, in the order of their hashes, are a
file. A word's place in these files is its number. Bigrams are pairs of two such numbers,
mixed to one 64-bit hash by a bijection; they are counted likewise. From each range of
merged bigrams go the numbers of followers by count (1, 2, 3 and more) of each first word and
the number of predecessors of each second word, which are summed by ranges of word numbers.

Scoring: the workers map the sorted arrays into memory and look up each batch's distinct
words and bigrams in order. Probabilities are computed from the counts:
p(w|v) = max(c(vw) - D(c), 0) / c(v) + g(v) q(w), q(w) = max(N(.w) - D', 0) / N(..) + g' / (V + 1).
Unknown words share the uniform part. A text is its words and one end; its start is a context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import _store
from factloom.llm._io import crc_mod, new_path, picked
from factloom.llm._text import LOWER_TOKENS, U64, Words, mix, slices

#: Distinct keys that a task gathers before it sends them.
GATHER = 3_000_000
END = U64(0x5851F42D4C957F2D)
#: Word numbers take half of a bigram's key.
MAX_WORDS = (1 << 32) - 2
#: Counts from here on are kept in a list of their own, by place.
MANY = (1 << 32) - 1


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = x ^ (x >> U64(31)) ^ (x >> U64(62))
    x = x * U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> U64(27)) ^ (x >> U64(54))
    x = x * U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _runs(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[new], *(np.add.reduceat(c[order], new) if len(new) else c for c in counts)


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of about equal size of 64-bit hashes."""
    return ((key >> U64(40)) * U64(shards) >> U64(24)).astype(np.int64)


def _send(shard: np.ndarray, key: np.ndarray, *counts: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each shard; the keys are sorted, and go as differences."""
    edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.zeros(0, np.int64)
    for lo in range(0, len(edge) - 1, 64):
        spans = list(zip(edge[lo : lo + 64], edge[lo + 1 : lo + 65], strict=False))
        yield pa.RecordBatch.from_arrays([
            pa.array([int(shard[a]) for a, _ in spans], pa.int64()), pa.array([int(b - a) for a, b in spans], pa.int64()),
            pa.array([packed(np.r_[key[a], np.diff(key[a:b])]) for a, b in spans], pa.binary()),
            *(pa.array([packed(c[a:b]) for a, b in spans], pa.binary()) for c in counts),
        ], names=names)


def _gathered(frame: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, ...]:
    """The rows of one shard, merged."""
    key = np.concatenate([np.cumsum(unpacked(b, n), dtype=U64) for b, n in zip(frame["key"], frame["n"], strict=True)])
    return _runs(key, *(np.concatenate([unpacked(b, n) for b, n in zip(frame[c], frame["n"], strict=True)]) for c in names))


def _discounts(n: list[float]) -> list[float]:
    """D1, D2, D3+ from the numbers of items that occur once, twice, three and four times."""
    if min(n[:3]) <= 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]


@dataclass
class Model:
    """What scoring needs beside the files in ``path``; a few numbers for each shard."""

    path: str
    words: list[int]
    shards: int
    tokens: int
    texts: int
    bigram: list[float]
    unigram: list[float]
    predecessors: float
    uniform: float
    #: Word numbers of one range file, and the number of those.
    width: int
    ranges: int
    #: From this count on, bigram counts are in a list of their own.
    many: int

    @property
    def vocabulary(self) -> int:
        return sum(self.words)


class Vocabulary:
    """Numbers and counts of words."""

    def __init__(self, path: str, words: list[int]) -> None:
        self._hash = [_store.mapped(f"{path}/word-{k}.u8", U64) for k in range(len(words))]
        self._count = [_store.mapped(f"{path}/count-{k}.u8", U64) for k in range(len(words))]
        self.base = np.cumsum([0, *words])

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """key: sorted. (number or -1, count)."""
        number, count = np.full(len(key), -1, np.int64), np.zeros(len(key))
        for k, lo, hi in _by_shard(key, len(self._hash)):
            known = self._hash[k]
            if len(known):
                at = np.searchsorted(known, key[lo:hi])
                at[at == len(known)] = 0
                hit = known[at] == key[lo:hi]
                number[lo:hi][hit] = at[hit] + self.base[k]
                count[lo:hi][hit] = self._count[k][at[hit]]
        return number, count


def _by_shard(key: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    if len(key):
        shard = _shard_of(key, shards)
        edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        yield from zip(shard[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words and ends of the rows."""
    words = Words(data, offsets, LOWER_TOKENS)
    rows = len(offsets) - 1
    at = words.bounds[1:] + np.arange(rows)
    out = np.empty(len(words.hash) + rows, U64)
    word = np.ones(len(out), bool)
    word[at] = False
    out[word], out[at] = words.hash, END
    return out, np.repeat(np.arange(rows), np.diff(words.bounds) + 1)


def _pairs(number: np.ndarray, row: np.ndarray, start: int) -> np.ndarray:
    """The word before each token; the start's number at the beginning of a row."""
    before = np.r_[start, number[:-1]] if len(number) else number
    before[np.r_[True, row[1:] != row[:-1]][: len(row)]] = start
    return before


class _Counter:
    """Counts of keys in a task, sent in sorted runs of bounded size."""

    def __init__(self, shards: int) -> None:
        self._shards, self._held, self._size = shards, [], 0

    def add(self, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._held.append(_runs(key, np.ones(len(key), U64)))
        self._size += len(self._held[-1][0])
        if self._size > 2 * GATHER or len(self._held) > 16:
            self._merge()
            if self._size > GATHER:
                yield from self.close()

    def _merge(self) -> None:
        self._held = [_runs(np.concatenate([k for k, _ in self._held]), np.concatenate([c for _, c in self._held]))]
        self._size = len(self._held[0][0])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self._held:
            self._merge()
            key, count = self._held[0]
            self._held, self._size = [], 0
            yield from _send(_shard_of(key, self._shards), key, count, names=["shard", "n", "key", "count"])


_SENT = "shard bigint, n bigint, key binary, count binary"


def fit(train: DataFrame) -> Model:
    """Counts all rows (id, text) of ``train``; a null text is an empty one. Up to 2^32 - 2 distinct words."""
    spark = train.sparkSession
    path = new_path(spark, "lm")
    source = train.select("text")
    shards = max(8, source.rdd.getNumPartitions())

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(shards)
        for batch in batches:
            for *_, data, offsets in slices(batch.column(0)):
                yield from counter.add(_tokens(data, offsets)[0])
        yield from counter.close()

    def keep_words(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        key, count = _gathered(frame, ["count"])
        _store.put(f"{path}/word-{shard}.u8", key)
        _store.put(f"{path}/count-{shard}.u8", count)
        ends = count[key == END]
        return pd.DataFrame({"shard": [shard], "words": [len(key)], "tokens": [int(count.sum())], "ends": [int(ends.sum())]})

    found = source.mapInArrow(count_words, _SENT).groupBy("shard").applyInPandas(keep_words, "shard bigint, words bigint, tokens bigint, ends bigint").collect()
    words = [0] * shards
    for r in found:
        words[r["shard"]] = r["words"]
    for k in set(range(shards)) - {r["shard"] for r in found}:
        for name in ("word", "count"):
            _store.put(f"{path}/{name}-{k}.u8", np.zeros(0, U64))
    total, start = sum(words), sum(words)
    if total > MAX_WORDS:
        raise ValueError("more than 2^32 - 2 distinct words")
    ranges = max(1, min(shards, -(-(total + 1) // (1 << 16))))
    width = -(-(total + 1) // ranges)

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, vocabulary = _Counter(shards), Vocabulary(path, words)
        for batch in batches:
            for *_, data, offsets in slices(batch.column(0)):
                token, row = _tokens(data, offsets)
                distinct, back = np.unique(token, return_inverse=True)
                number = vocabulary.find(distinct)[0][back]
                yield from counter.add(mix(_pairs(number, row, start).astype(U64) << U64(32) | number.astype(U64)))
        yield from counter.close()

    def keep_bigrams(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        shard = int(frame["shard"].iloc[0])
        key, count = _gathered(frame, ["count"])
        _store.put(f"{path}/pair-{shard}.u8", key)
        _store.put(f"{path}/times-{shard}.u4", np.minimum(count, U64(MANY)).astype(np.uint32))
        many = np.flatnonzero(count >= U64(MANY))
        _store.put(f"{path}/many-{shard}.u8", np.column_stack([many.astype(U64), count[many]]).ravel())
        both = unmix(key)
        of_counts = [int((count == k).sum()) for k in (1, 2, 3, 4)]
        one = [(count == U64(1)).astype(U64), (count == U64(2)).astype(U64), (count > U64(2)).astype(U64)]
        none = np.zeros(len(key), U64)
        names = ["n1", "n2", "n3", "into"]
        first = _runs(both >> U64(32), *one)
        second = _runs(both & U64(0xFFFFFFFF), none + U64(1))
        number, *sums = _runs(np.concatenate([first[0], second[0]]), *(np.concatenate([c, none[: len(second[0])]]) for c in first[1:]), np.concatenate([none[: len(first[0])], second[1]]))
        for part in _send((number // U64(width)).astype(np.int64), number, *sums, names=["range", "n", "key", *names]):
            yield part.to_pandas().assign(of1=None, of2=None, of3=None, of4=None)
        yield pd.DataFrame({"range": [-1], "n": [0], "key": [None], **{c: [None] for c in names}, **{f"of{k + 1}": [c] for k, c in enumerate(of_counts)}})

    def keep(frames: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(keep_bigrams(frames)), ignore_index=True).astype({f"of{k}": "Int64" for k in (1, 2, 3, 4)})

    sums = "range bigint, n bigint, key binary, n1 binary, n2 binary, n3 binary, into binary, of1 bigint, of2 bigint, of3 bigint, of4 bigint"
    merged_path = new_path(spark, "lm-sums")
    source.mapInArrow(count_bigrams, _SENT).groupBy("shard").applyInPandas(keep, sums).write.parquet(merged_path)
    merged = spark.read.schema(sums).parquet(merged_path)
    of = merged.where("range = -1").agg(*(F.sum(f"of{k}") for k in (1, 2, 3, 4)), F.count(F.lit(1))).first()
    bigram = _discounts([float(x or 0) for x in of[:4]])

    def keep_ranges(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["range"].iloc[0])
        key, n1, n2, n3, into = _gathered(frame, ["n1", "n2", "n3", "into"])
        lo = k * width
        dense = np.zeros((width, 2), np.float64)
        at = key.astype(np.int64) - lo
        dense[at, 0] = bigram[0] * n1 + bigram[1] * n2 + bigram[2] * n3
        dense[at, 1] = into
        _store.put(f"{path}/mass-{k}.f8", dense[:, 0])
        _store.put(f"{path}/into-{k}.u4", dense[:, 1].astype(np.uint32))
        return pd.DataFrame({"of1": [int((into == 1).sum())], "of2": [int((into == 2).sum())], "of3": [int((into == 3).sum())], "of4": [int((into == 4).sum())], "more": [int((into > 2).sum())], "all": [int(into.sum())], "range": [k]})

    low = merged.where("range >= 0").groupBy("range").applyInPandas(keep_ranges, "of1 bigint, of2 bigint, of3 bigint, of4 bigint, more bigint, all bigint, range bigint").collect()
    have = {r["range"] for r in low}
    for k in set(range(ranges)) - have:
        _store.put(f"{path}/mass-{k}.f8", np.zeros(width))
        _store.put(f"{path}/into-{k}.u4", np.zeros(width, np.uint32))
    of1, of2, of3, of4, more, predecessors = (float(sum(r[c] for r in low)) for c in ("of1", "of2", "of3", "of4", "more", "all"))
    unigram = _discounts([of1, of2, of3, of4])
    left = unigram[0] * of1 + unigram[1] * of2 + unigram[2] * more
    return Model(path, words, shards, sum(r["tokens"] for r in found), sum(r["ends"] for r in found), bigram, unigram, predecessors, left / predecessors if predecessors else 1.0, width, ranges, MANY)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.m = model
        self.words = Vocabulary(model.path, model.words)
        self._pair: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._range: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _pairs_of(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        if shard not in self._pair:
            try:
                self._pair[shard] = _store.mapped(f"{self.m.path}/pair-{shard}.u8", U64), _store.mapped(f"{self.m.path}/times-{shard}.u4", np.uint32)
            except FileNotFoundError:  # a range without bigrams
                self._pair[shard] = np.zeros(0, U64), np.zeros(0, np.uint32)
        return self._pair[shard]

    def _of_words(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(left-over mass, predecessors) of sorted word numbers."""
        mass, into = np.zeros(len(number)), np.zeros(len(number))
        which = number // self.m.width
        edge = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True]) if len(number) else []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            k = int(which[lo])
            if k not in self._range:
                self._range[k] = _store.mapped(f"{self.m.path}/mass-{k}.f8", np.float64), _store.mapped(f"{self.m.path}/into-{k}.u4", np.uint32)
            at = number[lo:hi] - k * self.m.width
            mass[lo:hi], into[lo:hi] = self._range[k][0][at], self._range[k][1][at]
        return mass, into

    def _times(self, before: np.ndarray, number: np.ndarray) -> np.ndarray:
        key = mix(before.astype(U64) << U64(32) | number.astype(U64))
        distinct, back = np.unique(key, return_inverse=True)
        times = np.zeros(len(distinct))
        for k, lo, hi in _by_shard(distinct, self.m.shards):
            known, count = self._pairs_of(k)
            if len(known):
                at = np.searchsorted(known, distinct[lo:hi])
                at[at == len(known)] = 0
                hit = known[at] == distinct[lo:hi]
                found = count[at[hit]].astype(np.float64)
                if (full := found >= self.m.many).any():
                    places, whole = _store.mapped(f"{self.m.path}/many-{k}.u8", U64).reshape(-1, 2).T
                    found[full] = whole[np.searchsorted(places, at[hit][full].astype(U64))]
                times[lo:hi][hit] = found
        return times[back]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        m, rows = self.m, len(offsets) - 1
        token, row = _tokens(data, offsets)
        distinct, back = np.unique(token, return_inverse=True)
        number, count = self.words.find(distinct)
        known = number >= 0
        order = np.argsort(number[known])
        mass, into = np.zeros(len(distinct)), np.zeros(len(distinct))
        at = np.flatnonzero(known)[order]
        mass[at], into[at] = self._of_words(number[at])
        v = m.vocabulary
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (v + 1)))
        cut = np.select([into == 1, into == 2, into > 2], m.unigram, 0.0)
        low = np.maximum(into - cut, 0) / m.predecessors if m.predecessors else np.zeros(len(into))
        low = low + m.uniform / (v + 1)
        now, number = low[back], number[back]
        before = _pairs(np.where(number < 0, -1, number), row, v)
        begin = before == v
        start_mass = self._of_words(np.array([v]))[0][0] if m.texts else 0.0
        shifted = lambda x: np.r_[0.0, x[back][:-1]] if len(back) else x
        total = np.where(begin, m.texts, shifted(count))
        spare = np.where(begin, start_mass, shifted(mass))
        p = now.copy()
        seen = (before >= 0) & (total > 0)
        p[seen] = spare[seen] / total[seen] * now[seen]
        both = np.flatnonzero(seen & (number >= 0))
        times = self._times(before[both], number[both])
        cut = np.select([times == 1, times == 2, times > 2], m.bigram, 0.0)
        p[both] += np.maximum(times - cut, 0) / total[both]
        return {
            "n_tokens": np.bincount(row, minlength=rows), "n_known": np.bincount(row, (count > 0)[back], rows).astype(np.int64),
            "base_score": np.bincount(row, base[back], rows), "score": np.bincount(row, np.log10(p), rows),
        }


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """All rows outside the held-out fold; a null id is in no fold."""
    return picked(docs, id=id_col, text=text_col).where(F.coalesce(crc_mod("id", folds) != held, F.lit(True)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end alone. Without training rows every token is unknown and
    has probability 1. Repeated rows get equal scores. Other columns are not read.
    """
    source = picked(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        names = ("n_tokens", "n_known", "base_score", "score")
        for batch in batches:
            parts = [scorer.score(data, offsets) for *_, data, offsets in slices(batch.column(1))]
            got = {c: np.concatenate([p[c] for p in parts] or [np.zeros(0)]) for c in names}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got["n_tokens"], pa.int64()), pa.array(got["n_known"], pa.int64()), pa.array(np.full(len(batch), model.tokens), pa.int64()), pa.array(got["base_score"]), pa.array(got["score"])], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
