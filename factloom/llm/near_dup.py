"""Near-duplicate documents by BagMinHash signatures of their bags of word shingles.

A document is a multiset of five-word shingles (all of its words if it has fewer). Copies,
whose words are the same, are one vertex. A shingle of weight w is a Poisson process over
the weight levels [0, w). The levels come in dyadic blocks [0, 1), [1, 2), [2, 4), ...,
each a process of its own with a rate of its size; points of a block that the weight covers
in part count if their level lies below the weight. Each point falls into a register; a
register keeps its first point. Two signatures agree in a register with a probability of
exactly the weighted Jaccard similarity. Points are drawn in order and a process ends as
soon as its next point is later than all registers of its document.

Bands of registers give candidates. First a document is compared with two others that it
meets most often as a centre of its bands' buckets: their least member, and the member
that meets most others. Those links join nearly all of a group of near copies. Where a bucket then
still holds several components, its members of different components are compared with each
other, so that no link is lost that joins two components. Candidates
whose signatures agree in too few registers go (longer signatures, made for those members
only, in the second step); the rest are verified on their exact multisets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.llm._io import materialize, new_path, picked, release, scratch
from factloom.llm._store import mapped, put
from factloom.llm._text import ALNUM, ALNUM_SPLIT, U64, Words, mix, shingle_hashes, slices
from factloom.llm.graph import across, components, shared, stars, with_least

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
#: Of 160 registers a pair of similarity 0.8 agrees in 128 on average, with a deviation of 5; in under 105 with a probability of 1e-5.
LEAST_AGREEMENT = 105
#: The same for the longer signatures that are made where components meet. Four bits of a register are kept, of which 1 in 16 agrees by chance: 832 with a deviation of 12.5.
LONG, LONG_AGREEMENT = 1024, 777
#: uid = partition << PART_BITS | place in it, as Spark numbers rows.
PART_BITS = 33

_GOLD = U64(0x9E3779B97F4A7C15)


def bag_minhash(row: np.ndarray, item: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """Signatures (rows x registers, 32 bits). row, item, weight: one entry for each distinct item of a row; weights are whole, 1 at least."""
    first = np.full(rows * registers, np.inf)
    block = 0
    pending: list[tuple[np.ndarray, ...]] = []
    while (use := np.flatnonzero(weight > (1 << block >> 1))).size:
        size = max(1, 1 << block >> 1)
        low = 0 if block == 0 else size
        seed = mix(item[use] + U64((block + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        pending.append((row[use], seed, np.full(len(use), float(size)), np.full(len(use), float(low)), weight[use].astype(float)))
        block += 1
    if not pending:
        return np.zeros((rows, registers), np.uint32)
    who, seed, size, low, most = (np.concatenate(x) for x in zip(*pending, strict=True))
    time, count, step = np.zeros(len(who)), 0, 1
    while len(who):
        k = (np.arange(step, dtype=U64) + U64(count)) * U64(3)
        a = mix(seed[:, None] + (k + U64(1)) * _GOLD)
        gap = -np.log1p(-((a >> U64(11)).astype(float) * 2.0**-53)) / (size * registers)[:, None]
        at = time[:, None] + np.cumsum(gap, 1)
        b = mix(seed[:, None] + (k + U64(2)) * _GOLD)
        register = (b % U64(registers)).astype(np.int64) + (who * registers)[:, None]
        part = most < low + size
        if part.any():
            level = low[part, None] + (mix(seed[part, None] + (k + U64(3)) * _GOLD) >> U64(11)).astype(float) * 2.0**-53 * size[part, None]
            counted = np.ones(at.shape, bool)
            counted[part] = level < most[part, None]
            np.minimum.at(first, register[counted], at[counted])
        else:
            np.minimum.at(first, register.ravel(), at.ravel())
        time, count = at[:, -1], count + step
        go = time < first.reshape(rows, registers).max(1)[who]
        who, seed, size, low, most, time = (x[go] for x in (who, seed, size, low, most, time))
        if count >= 2:
            step = max(1, min(32, (1 << 17) // max(1, len(who))))
    return (mix(first.view(U64)) >> U64(32)).astype(np.uint32).reshape(rows, registers)


def bags_of(words: Words, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, weight) of the rows' shingle bags."""
    row, item = shingle_hashes(words, SHINGLE)
    order = np.lexsort((item, row)) if rows > 1 else np.argsort(item)
    row, item = row[order], item[order]
    if not len(row):
        return row, item, np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
    return row[new], item[new], np.diff(np.r_[new, len(row)])


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of the shingle bags of two texts."""
    row, item = shingle_hashes(Words(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)]), ALNUM), SHINGLE)
    n = int((row == 0).sum())
    _, place = np.unique(item, return_inverse=True)
    x, y = (np.bincount(p, minlength=len(place) + 1) for p in (place[:n], place[n:]))
    most = np.maximum(x, y).sum()
    return float(np.minimum(x, y).sum() / most) if most else 0.0


def _signed(rows: DataFrame) -> DataFrame:
    """(uid, node, n, bands, signature) of the rows (uid, text); the last two only for the first of a task's copies, all but uid null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1), 1 << 20):
                view = memoryview(data)
                split = [bytes(view[a:b]).translate(ALNUM_SPLIT).split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                node = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in split]
                count = [len(w) for w in split]
                del split
                fresh = []
                for i, k in enumerate(node):
                    if k is not None and k not in seen:
                        seen.add(k)
                        fresh.append(i)
                if len(seen) > 200_000:
                    seen.clear()
                bands: list = [None] * len(node)
                signature: list = [None] * len(node)
                if fresh:
                    words = Words(data, offsets, ALNUM)
                    row, item, weight = bags_of(words, len(node))
                    where = np.full(len(node), -1)
                    where[fresh] = np.arange(len(fresh))
                    keep = where[row] >= 0
                    sig = bag_minhash(where[row[keep]], item[keep], weight[keep], len(fresh), BANDS * ROWS)
                    band = np.zeros((len(fresh), BANDS), U64)
                    for k in range(ROWS):
                        band = mix(band * U64(31) + sig[:, k::ROWS].astype(U64) + U64(1))
                    band = mix(band + np.arange(BANDS, dtype=U64) * _GOLD).view(np.int64)
                    for j, i in enumerate(fresh):
                        bands[i], signature[i] = band[j], sig[j].astype(np.uint16).view(np.int16)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(node, pa.binary()), pa.array(count, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signature, pa.list_(pa.int16())),
                ], names=["uid", "node", "n", "bands", "signature"])
        del seen
        release()

    return rows.select("uid", "text").mapInArrow(run, "uid bigint, node binary, n bigint, bands array<bigint>, signature array<smallint>")


def _chosen(rows: DataFrame, ids: DataFrame, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str | StructType | None = None) -> DataFrame:
    """The rows (uid first) whose uid is among ids, or what ``then`` makes of them in the same worker.

    The ids go to the texts: those of a partition of the numbered rows are a sorted array in
    a file of the shared folder, which the tasks that read this partition map. A join would
    shuffle the whole texts.
    """
    folder = new_path(rows.sparkSession, "chosen")

    def store(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        put(f"{folder}/{key[0].as_py()}", np.sort(found.column("uid").to_numpy()))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64())})

    stored = ids.select("uid").distinct().withColumn("part", F.shiftright("uid", PART_BITS)).groupBy("part").applyInArrow(store, "part bigint").collect()  # a number a partition
    parts = rows.sparkSession.sparkContext.broadcast(frozenset(r["part"] for r in stored))

    def wanted(part: int) -> np.ndarray:
        return mapped(f"{folder}/{part}", np.int64) if part in parts.value else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int64))
        for batch in batches:
            uid = batch.column(0).to_numpy()
            keep = np.zeros(len(uid), bool)
            for part in np.unique(uid >> PART_BITS).tolist():
                if last[0] != part:
                    last = (part, wanted(part))
                here = uid >> PART_BITS == part
                keep[here] = np.searchsorted(last[1], uid[here], "right") > np.searchsorted(last[1], uid[here])
            if keep.any():
                yield batch.filter(pa.array(keep))
        release()

    return rows.mapInArrow((lambda batches: then(run(batches))) if then else run, schema or rows.schema)


def packed(signature: np.ndarray) -> np.ndarray:
    """Four bits of each register, 16 registers a word."""
    nibble = (signature & 15).astype(U64).reshape(len(signature), -1, 16)
    return (nibble << (np.arange(16, dtype=U64) * U64(4))).sum(2, dtype=U64).view(np.int64)


def _long_signatures(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(uid, long) of those rows (uid, text) whose uid is among ids; long: packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1), 1 << 18):
                row, item, weight = bags_of(Words(data, offsets, ALNUM), hi - lo)
                sig = packed(bag_minhash(row, item, weight, hi - lo, LONG))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(list(sig), pa.list_(pa.int64()))], names=["uid", "long"])

    return _chosen(rows.select("uid", "text"), ids, run, "uid bigint, long array<bigint>")


def _agreeing(a: str, b: str, n: str, m: str):
    """The bags' sizes and signatures allow the threshold."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (F.least(n, m) >= THRESHOLD * F.greatest(n, m)) & (same >= LEAST_AGREEMENT)


def _agreeing_long(a: str, b: str, n: str, m: str):
    """The same for packed signatures: registers differ where any of four bits does."""

    def differing(x, y):
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x1111111111111111)))

    differ = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    return (F.least(n, m) >= THRESHOLD * F.greatest(n, m)) & (differ <= LONG - LONG_AGREEMENT)


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of the threshold's similarity or more, on their whole texts."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    texts = materialize(_chosen(rows.select("uid", "text"), ids), "candidates")
    both = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [similarity(x, y) for x, y in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], names=["u", "v", "similarity"])
        release()

    return both.mapInArrow(run, "u bigint, v bigint, similarity double").where(F.col("similarity") >= THRESHOLD)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows, stored, with a number ``uid`` each; a column of that name gives way to it."""
    return materialize(docs.drop("uid").withColumn("uid", F.monotonically_increasing_id()), "rows")


def near_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, class, vertex) for each row of a numbered table with uid and text, and verified links (u, v, similarity) between vertices that connect each class.

    vertex: the first uid of the row's words; copies share it. Links join different texts.

    class is the least uid of the connected component. A row without words (null, empty,
    punctuation only) is a class of its own.
    """
    signed = materialize(_signed(rows), "signatures")
    made = signed.where("signature is not null")
    first = made.groupBy("node").agg(F.min("uid").alias("uid"))
    vertex = materialize(made.join(first.select("uid"), "uid", "left_semi"), "vertices")
    entry = shared(vertex.select("uid", F.explode("bands").alias("key")))
    star = stars(entry)
    half = vertex.select("uid", "n", "signature")
    paired = materialize(star.join(half.toDF("a", "na", "sa"), "a").join(half.toDF("b", "nb", "sb"), "b").where(_agreeing("sa", "sb", "na", "nb")).select("a", "b"), "stars")
    links = materialize(_verified(paired, rows), "links")
    label = components(links)
    once = F.array_min(F.array_intersect("bandsx", "bandsy")) == F.col("keyx")
    extra = lambda uids: materialize(_long_signatures(rows, uids).join(vertex.select("uid", "n", "bands"), "uid"), "long")
    cross = across(entry, label, _agreeing_long("longx", "longy", "nx", "ny") & once, extra).join(paired, ["a", "b"], "left_anti")
    more = materialize(_verified(materialize(cross, "cross"), rows), "links")
    if not more.isEmpty():
        links = links.unionAll(more)
        label = components(links)
    at = first.join(label.withColumnRenamed("id", "uid"), "uid", "left").select("node", F.coalesce("label", "uid").alias("class"), F.col("uid").alias("vertex"))
    out = signed.select("uid", "node").join(at, "node", "left").select("uid", F.coalesce("class", "uid").alias("class"), F.coalesce("vertex", "uid").alias("vertex"))
    return out, links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, class_id, kept, n_links, similarity.

    class_id: the least id of the document's class (null if the class has none); kept: true
    for one row of each class, the first stored. n_links: verified links between its text
    and other texts, of those that connect the class; similarity: the highest of theirs, null
    without any. Copies share the links of their text. Texts without words are unlike all
    others. Rows that repeat an id are separate rows. An empty table gives no rows.
    """
    rows = numbered(picked(docs, doc=id_col, text=text_col))
    with scratch(docs.sparkSession, "near-dup"):
        found, links = near_classes(rows)
        end = links.select(F.explode(F.array("u", "v")).alias("vertex"), "similarity").groupBy("vertex").agg(F.count(F.lit(1)).alias("n_links"), F.max("similarity").alias("similarity"))
        found = materialize(found.join(end, "vertex", "left").drop("vertex"), "classes", keep=True)
    named = found.join(rows.select("uid", "doc"), "uid")
    return with_least(named, "doc").select(F.col("doc").alias(id_col), "class_id", (F.col("uid") == F.col("class")).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "similarity")


def deduplicate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of each class of near-duplicates, with all columns of ``docs`` as they were."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = numbered(picked(docs, **{alias: c for c, alias in own.items()}))
    with scratch(docs.sparkSession, "near-dup"):
        first = materialize(near_classes(rows.select("uid", F.col(own[text_col]).alias("text")))[0].where("uid = class").select("uid"), "kept", keep=True)
    return _chosen(rows.select("uid", *own.values()), first).select(*(F.col(alias).alias(c) for c, alias in own.items()))
