"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Bins are planned over the histogram of piece lengths, which has as many entries as a
sequence has tokens, whatever the size of the corpus. A bin is filled greedily with the
longest piece that fits; if a gap is left, its smallest piece gives way to the two unpacked
pieces that fill the expanded gap most tightly. The bin found is repeated as long as all
lengths that it holds last, so a plan has few distinct bins.

Pieces are numbered within their length: by place in their partition while they are
tokenised, then by the number of such pieces in earlier partitions. The plan maps ranges of
these numbers to bins, so no group of equal lengths meets in one task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm._io import materialize, picked, release
from factloom.llm._text import slices

if TYPE_CHECKING:
    from tokenizers import Tokenizer

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048
END_ID = 0
#: Units and ids that a worker keeps, in bytes with what their objects take.
CACHE_BYTES = 128 << 20
CACHED_LENGTH = 48
#: What a unit takes besides its letters.
UNIT_BYTES = 220


#: Runs that the tokenizer's own word pattern also cuts at both ends: Latin letters, one digit, ASCII marks but the apostrophe.
_UNITS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: Texts of such units and ASCII white space.
_PLAIN = re.compile(r"[\t-\r -&(-~ß-öø-ÿ]*")
#: What the tokenizer does to a text before it looks for words, and how it cuts them, if the units above are to be words.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> list[tuple[str, str]]:
    """(byte, letter) where byte-level vocabularies write a byte of a unit, read as Latin-1, by another letter."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    inside = {*"ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ".encode()}
    return [(chr(b), chr(256 + i)) for i, b in enumerate(hidden) if b in inside]


class TextEncoder:
    """Ids of whole texts as little-endian bytes, by way of a cache of the ids of their parts.

    The tokenizer drops white space before it looks for words, lower-cases, and none of its
    words spans white space, so a text's ids are those of its parts in order. A text of plain
    units is cut into those. Any other is cut at ASCII white space, and those runs of it that
    hold something else (apostrophes, other scripts, special tokens) are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._lean = self._lean_of(self._tokenizer)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[n for word, n in vocabulary.items() if word.endswith("</w>")]] = True
        self._letters = _byte_letters()
        self._cache: dict[str, bytes] = {}
        self._held = 0

    @staticmethod
    def _lean_of(tokenizer: Tokenizer) -> Tokenizer | None:
        """The same model without normalising and looking for words, which plain units don't need; None if this tokenizer isn't of that form."""
        from tokenizers import Tokenizer, pre_tokenizers

        form = json.loads(tokenizer.to_str())
        cuts = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
        done = (form["normalizer"] or {}).get("normalizers", [])
        if [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[0]["pattern"] != {"Regex": _WORDS} or cuts[1]["add_prefix_space"] or [d["type"] for d in done] != ["NFC", "Replace", "Lowercase"]:
            return None
        lean = Tokenizer(tokenizer.model)
        lean.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return lean

    def _runs(self, runs: list[str]) -> Iterator[bytes]:
        for at in range(0, len(runs), 4096):
            for e in self._tokenizer.encode_batch_fast(runs[at : at + 4096], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def _units(self, units: list[str]) -> Iterator[bytes]:
        """Many units go as one text: each is one word of the tokenizer, whose last id has the mark of a word's end."""
        for at in range(0, len(units), 512):
            part = units[at : at + 512]
            ids = np.zeros(0, "<u4")
            if self._lean:
                text = " ".join(part).encode().decode("latin-1")
                for byte, letter in self._letters:
                    text = text.replace(byte, letter)
                ids = np.array(self._lean.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self._ends[ids]) + 1
            if len(cut) != len(part):  # another tokenizer
                yield from self._runs(part)
                continue
            data, lo = ids.tobytes(), 0
            for hi in (cut * 4).tolist():
                yield data[lo:hi]
                lo = hi

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        parts: list[list[str]] = []
        whole: set[str] = set()
        for data in texts:
            text = data.decode("utf-8", "replace")
            low = text.lower()
            if b"<|" not in data and _PLAIN.fullmatch(low):
                parts.append(_UNITS.findall(low))
                continue
            units: list[str] = []
            for raw in data.split():
                run = raw.decode("utf-8", "replace")
                low = run.lower()
                if "<|" in run or not _PLAIN.fullmatch(low):
                    whole.add(run)
                    units.append(run)
                else:
                    units += _UNITS.findall(low)
            parts.append(units)
        need = set().union(*parts)
        new = need.difference(self._cache)
        if self._held > CACHE_BYTES:
            self._cache.clear()
            self._held, new = 0, need
        self._held += sum(map(len, new)) + UNIT_BYTES * len(new)
        runs, plain = list(new & whole), list(new - whole)
        self._cache.update(zip(runs, self._runs(runs), strict=True))
        self._cache.update(zip(plain, self._units(plain), strict=True))
        out = [b"".join(map(self._cache.__getitem__, units)) for units in parts]
        for u in new:
            if len(u) > CACHED_LENGTH:
                del self._cache[u]
                self._held -= len(u) + UNIT_BYTES
        return out


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """counts[l]: pieces of length l. Bins as (lengths, longest first; how many such bins)."""
    left = counts.astype(np.int64).copy()
    bins: list[tuple[list[int], int]] = []
    while left[1:].any():
        held, gap = [], capacity
        while gap:
            fit = np.flatnonzero(left[: gap + 1])
            if not len(fit):
                break
            held.append(int(fit[-1]))
            left[held[-1]] -= 1
            gap -= held[-1]
        if gap:
            small = held.pop()
            left[small] += 1
            for k in (pair := best_two(left, gap + small, small) or [small]):
                left[k] -= 1
            held += pair
        need = np.bincount(held, minlength=len(left))
        used = np.flatnonzero(need)
        more = int((left[used] // need[used]).min())
        left[used] -= more * need[used]
        bins.append((sorted(held, reverse=True), 1 + more))
    return bins


def best_two(left: np.ndarray, room: int, over: int) -> list[int]:
    """The two pieces left that fill room most, if that is more than over; else none."""
    have = np.flatnonzero(left[: room + 1])
    if not len(have):
        return []
    other = np.searchsorted(have, room - have, "right") - 1
    same = (other >= 0) & (have[other] == have) & (left[have] < 2)
    other = other - same  # a single piece can't be taken twice; the next shorter one may go with it
    total = np.where(other >= 0, have + have[np.maximum(other, 0)], 0)
    k = int(total.argmax())
    return [int(have[k]), int(have[other[k]])] if total[k] > over else []


def plan_slots(bins: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """Ranges of numbered pieces of one length: key = length << 40 | first number; piece n of the range goes to sequence + n at offset."""
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, times in bins:
        offset = 0
        for k in lengths:
            rows.append((k << 40 | int(used[k]), sequence, offset))
            used[k] += times
            offset += k
        sequence += times
    rows.sort()
    key, seq, off = zip(*rows, strict=True) if rows else ((), (), ())
    return {"key": np.array(key, np.int64), "sequence": np.array(seq, np.int64), "offset": np.array(off, np.int64)}


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, keep_ids: bool) -> DataFrame:
    """A row per piece; part and nth: the partition, and how many pieces of this length came before in it."""
    path = public_tokenizers.path(tokenizer)
    source = picked(docs, id=id_col, text=text_col)
    names = ["id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = TextEncoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        step = capacity * 4
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lo, hi, *_ in slices(texts):
                rows: list[list] = [[] for _ in range(7)]
                for at, ids in zip(range(lo, hi), encode([t or b"" for t in texts.slice(lo, hi - lo).to_pylist()]), strict=True):
                    ids += end
                    for k in range(0, len(ids), step):
                        piece = ids[k : k + step]
                        n = len(piece) // 4
                        for column, x in zip(rows, (at, k // step, k // 4, n, zlib.crc32(piece), piece if keep_ids else None, int(seen[n])), strict=True):
                            column.append(x)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()),
                    pa.array(rows[4], pa.int64()), pa.array(rows[5], pa.binary()), pa.array([part] * len(rows[0]), pa.int32()), pa.array(rows[6], pa.int64()),
                ], names=names)
        del encode
        release()

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, part int, nth bigint")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian, if kept).

    A null text counts as empty; an empty text is one piece of the end id alone. Only
    documents of more than ``capacity`` ids are cut. Repeated rows are packed each by
    itself, and a null id stays null. An empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenized_pieces(docs, id_col, text_col, tokenizer, capacity, keep_ids), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    base = per_part.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    slots = spark.sparkContext.broadcast(plan_slots(plan_bins(counts, capacity), capacity))
    numbered = pieces.join(base, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"), "ids")
    kind = pieces.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = slots.value
        for batch in batches:
            want = (batch.column(3).to_numpy() << 40) | batch.column(5).to_numpy()
            k = np.searchsorted(plan["key"], want, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(plan["sequence"][k] + want - plan["key"][k]), pa.array(plan["offset"][k]), batch.column(6)], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    out = numbered.mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, ids binary")
    return out if keep_ids else out.drop("ids")
