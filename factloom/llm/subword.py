"""Subword-bag classifiers: hashed n-gram embeddings averaged into a linear softmax.

The embeddings and the softmax are learned together by numpy stochastic gradient descent
on the driver, from a bounded sample of labelled texts. As the softmax is linear, a learned
feature counts in a text by one number, the product of its embedding with the difference of
the two classes' weights; scoring needs that table only, whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._io import by_text, crc_mod, materialize, picked
from factloom.llm._text import LOWER_TOKENS, RAW_TOKENS, U64, Words, mix, slices

HELD_OUT_FOLDS = 5
#: Texts of more than this part of a sample's bytes are long.
LONG_SHARE = 16
#: Bytes of text that are scored at once.
SCORED_BYTES = 1 << 20
#: Bytes of text whose features are made at once in fitting, or of one longer text: that takes some 240 times as much for a moment.
FITTED_BYTES = 1 << 17
#: The bigram of any word and itself.
_AGAIN = U64(0xA5A5A5A5A5A5A5A5)


@dataclass(frozen=True)
class Features:
    """What a text's bag holds. sizes: lengths of byte n-grams within ``<word>``; the word itself counts too."""

    table: str = "lower"
    sizes: tuple[int, ...] = (3, 4, 5)
    bigrams: bool = False
    #: Words of a segment; 0: the whole text is one bag.
    segment: int = 0
    bits: int = 18

    def bags(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bag of each feature, its bucket, row of each bag, first bag of each row). Every row has a bag, if an empty one."""
        table = LOWER_TOKENS if self.table == "lower" else RAW_TOKENS
        words, rows = Words(data, offsets, table), len(offsets) - 1
        count = np.diff(words.bounds)
        per_row = np.maximum(1, -(-count // self.segment)) if self.segment else np.ones(rows, np.int64)
        first = np.cumsum(per_row) - per_row
        place = np.arange(len(words.row)) - words.bounds[:-1][words.row]
        bag = first[words.row] + (place // self.segment if self.segment else 0)
        shift = U64(64 - self.bits)
        bags, buckets = [bag], [words.hash >> shift]
        if self.bigrams and len(bag) > 1:
            same = words.row[1:] == words.row[:-1]
            bags.append(bag[1:][same])
            pair = mix(words.hash[:-1] * U64(3) + words.hash[1:])
            buckets.append(np.where(words.hash[:-1] == words.hash[1:], _AGAIN, pair)[same] >> shift)
        for part_bag, part in self._grams(data, words, bag, table):
            bags.append(part_bag)
            buckets.append(part)
        return np.concatenate(bags), np.concatenate(buckets).astype(np.int64), np.repeat(np.arange(rows), per_row), first

    def _grams(self, data: np.ndarray, words: Words, bag: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = 1 << 18
        for lo in range(0, len(bag), step):  # bounded memory for very long rows
            start, end, own = words.start[lo : lo + step], words.end[lo : lo + step], bag[lo : lo + step]
            long = end - start + 1
            at = np.cumsum(long) - long
            text = np.full(int(long.sum()) + 1, 32, np.uint8)
            inside = np.ones(len(text), bool)
            inside[at] = False
            inside[-1] = False
            source = np.arange(len(text) - 1) - np.repeat(at, long) - 1 + np.repeat(start, long)
            keep = inside[:-1]
            text[:-1][keep] = table[data[source[keep]]]
            word = np.repeat(np.arange(len(long)), long)
            spaces = np.cumsum(~inside)
            value = text.astype(U64) + U64(1)
            for n in self.sizes:
                m = len(text) - n + 1
                if m <= 0:
                    continue
                whole = np.flatnonzero(spaces[n - 2 : n - 2 + m] == spaces[:m]) if n > 2 else np.arange(m)
                key = np.full(len(whole), n, U64)
                for k in range(n):
                    key = key * U64(1099511628211) + value[whole + k]
                yield own[word[whole]], mix(key) >> U64(64 - self.bits)


@dataclass
class Model:
    features: Features
    weight: np.ndarray
    bias: float
    #: Logit of an empty bag: that of label 1's share among the fitted texts.
    prior: float = 0.0

    def logits(self, bag: np.ndarray, bucket: np.ndarray, bags: int) -> np.ndarray:
        n = np.bincount(bag, minlength=bags)
        return np.where(n > 0, np.bincount(bag, self.weight[bucket], bags) / np.maximum(n, 1) + self.bias, self.prior)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: of its whole bag, or of its highest segment."""
        bag, bucket, row, first = self.features.bags(data, offsets)
        if not len(first):
            return np.zeros(0)
        logit = np.maximum.reduceat(self.logits(bag, bucket, len(row)), first)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _packed(bucket: np.ndarray, times: np.ndarray, bits: int) -> np.ndarray:
    """A number for each feature, its repeats above the bits of its bucket: 32 bits unless one repeats more often than fits."""
    kind = np.uint32 if not len(times) or times.max() < 1 << 32 - bits else U64
    return (times.astype(U64) << U64(bits) | bucket.astype(U64)).astype(kind)


def _shares(packed: np.ndarray, bits: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares of their bags' averages) of packed features; of: features of each one's bag, with repeats."""
    kind = packed.dtype.type
    return (packed & kind((1 << bits) - 1)).astype(np.int64), ((packed >> kind(bits)) / of).astype(np.float32)


class _Trainer:
    """Embeddings E and softmax weights, class 0 and 1."""

    def __init__(self, features: Features, dim: int, seed: int) -> None:
        self.rng, self.bits = np.random.default_rng(seed), features.bits
        self.e = self.rng.uniform(-1 / dim, 1 / dim, (1 << features.bits, dim)).astype(np.float32)
        self.w = self.rng.uniform(-0.1, 0.1, (dim, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)

    def batch(self, bags: list[tuple[np.ndarray, float]], labels: np.ndarray, rate: float) -> None:
        """bags: (packed features, how many there are with repeats)."""
        long = np.array([len(b) for b, _ in bags])
        ids, share = _shares(np.concatenate([b for b, _ in bags]), self.bits, np.repeat([n for _, n in bags], long))
        at = np.cumsum(long) - long
        hidden = np.add.reduceat(self.e[ids] * share[:, None], at)
        out = hidden @ self.w + self.b
        out = np.exp(out - out.max(1, keepdims=True))
        grad = out / out.sum(1, keepdims=True)
        grad[np.arange(len(labels)), labels] -= 1
        back = (grad @ self.w.T) * rate
        self.w -= rate * hidden.T @ grad / len(bags)
        self.b -= rate * grad.mean(0)
        np.subtract.at(self.e, ids, np.repeat(back, long, 0) * share[:, None])

    def model(self, features: Features) -> Model:
        return Model(features, (self.e @ (self.w[:, 1] - self.w[:, 0])).astype(np.float32), float(self.b[1] - self.b[0]))


def train(texts: list[bytes], labels: np.ndarray, features: Features, dim: int = 8, epochs: int = 12, rate: float = 0.5, batch: int = 32, warm: int = 2, seed: int = 7) -> Model:
    """Fit on whole texts. With segments, a text stands for its segment that now scores highest; in the first ``warm`` epochs for random ones."""
    trainer = _Trainer(features, dim, seed)
    if not len(texts):
        return trainer.model(features)
    parts: list[tuple[np.ndarray, ...]] = []  # of runs of texts: packed features, edges of the non-empty bags, their features with repeats, their texts
    for lo, _, data, offsets in slices(pa.array(texts, pa.large_binary()), FITTED_BYTES):
        bag, bucket, row, _ = features.bags(data, offsets)
        if not len(bag):
            continue
        key = np.sort((bag << features.bits) + bucket)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times = np.diff(np.r_[new, len(key)])
        bag, bucket = key[new] >> features.bits, key[new] & ((1 << features.bits) - 1)
        edge = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1], True])
        bags = bag[edge[:-1]]
        parts.append((_packed(bucket, times, features.bits), edge, np.bincount(bag, times, len(row))[bags], lo + row[bags]))
    y = np.asarray(labels)
    for epoch in range(epochs if parts else 0):
        now = trainer.model(features)
        bags, texts_of = [], []
        for packed, edge, total, text in parts:
            if epoch >= warm:
                bucket, share = _shares(packed, features.bits, np.repeat(total, np.diff(edge)))
                level = np.add.reduceat(now.weight[bucket] * share, edge[:-1])
            else:
                level = trainer.rng.random(len(text))
            last = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
            for k in np.lexsort((level, text))[last]:
                bags.append((packed[edge[k] : edge[k + 1]], total[k]))
            texts_of.append(text[last])
        target = y[np.concatenate(texts_of)]
        order = trainer.rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            trainer.batch([bags[k] for k in pick], target[pick], rate * (1 - epoch / epochs))
    model = trainer.model(features)
    share = (np.sum(labels) + 1) / (len(labels) + 2)
    model.prior = float(np.log(share / (1 - share)))
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: tuple[int, int], most_bytes: int, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id") -> tuple[list[bytes], np.ndarray]:
    """A bounded sample of labelled texts outside the held-out fold.

    Up to rows_per_class[l] rows of label l, by a hash of the id; of repeated labels the
    largest counts. Texts are taken in that order up to ``most_bytes`` in all, whole or not
    at all; one that doesn't fit any more is passed over, and the next are tried. Texts longer
    than ``most_bytes // LONG_SHARE`` (1 MiB or 768 KiB) come after all others, so that they
    don't take the others' place. Null texts count as empty.
    """
    marks = picked(labels, id=label_id_col, y=label).where("id is not null and y is not null").where(crc_mod("id", HELD_OUT_FOLDS) != 0).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).where("y in (0, 1)").collect()}
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 24)) / float(1 << 24)
    share = F.when(F.col("y") == 1, min(1.0, rows_per_class[1] / max(1, n.get(1, 0)))).when(F.col("y") == 0, min(1.0, rows_per_class[0] / max(1, n.get(0, 0))))
    chosen = marks.withColumn("place", place).where(F.col("place") < share)  # about the sum of rows_per_class
    texts = materialize(picked(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").select("place", "y", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("uid")), "labelled")
    sizes = texts.select("uid", "place", F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"))
    size, wanted = 0, []
    for r in sizes.where(F.col("size") <= most_bytes).orderBy(F.col("size") > most_bytes // LONG_SHARE, "place", "hash").limit(2 * sum(rows_per_class)).collect():
        if size + r["size"] <= most_bytes:
            size += r["size"]
            wanted.append((r["uid"],))
    ids = docs.sparkSession.createDataFrame(wanted, "uid bigint")  # 2 * sum(rows_per_class) at most
    found = texts.join(F.broadcast(ids), "uid").select("place", "y", "text").collect()
    found = sorted(((r["place"], r["text"].encode(), r["y"]) for r in found))
    return [t for _, t, _ in found], np.array([y for *_, y in found], np.int64)


def judged(text: Column, model: Model, threshold: float) -> Column:
    """Struct of score and predicted of a text column."""
    sent = SparkSession.active().sparkContext.broadcast(model)  # 1 MB, fixed

    def judge():
        model = sent.value

        def one(texts: pa.Array) -> pa.Array:
            got = np.concatenate([model.scores(data, offsets) for _, _, data, offsets in slices(texts, SCORED_BYTES)] or [np.zeros(0)])
            return pa.StructArray.from_arrays([pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=["score", "predicted"])

        return one

    return by_text("struct<score:double,predicted:int>", judge)(text)


def score(docs: DataFrame, model: Model, threshold: float, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, score of the whole text, predicted (and the columns to keep).

    Null and empty texts get the share of label 1 among the fitted rows. Repeated rows get equal
    scores; an empty table gives no rows. A kept column gives way to a result of the same name.
    """
    kept = [c for c in keep if c not in (id_col, "score", "predicted")]
    found = docs.select(docs[id_col].alias("id"), *(docs[c].alias(f"k{i}") for i, c in enumerate(kept)), judged(docs[text_col], model, threshold).alias("found"))
    return found.select(F.col("id").alias(id_col), *(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), "found.score", "found.predicted")
