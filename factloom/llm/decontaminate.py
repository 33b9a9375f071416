"""Benchmark decontamination by Wu-Manber search over words.

Every run of ten consecutive words of a benchmark item (all words of a shorter item) is a
test string. Strings of one length share an automaton: the shift table over blocks of two
words says how far the search window may move on; at shift 0 the bucket of the hash of the
last four words holds the strings to try, and comparing all words confirms an occurrence.
A batch of texts is cut into segments, whose windows move all at once.

The automata are arrays in files of the shared folder, built by one task for each
``block_bytes`` of benchmark text and mapped into memory by the workers, so that a
benchmark of any size takes one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import _store
from factloom.llm._io import by_text, new_path, picked
from factloom.llm._text import ALNUM, ALNUM_SPLIT, U64, Words, mix, slices

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Words of which a longer text is searched at a time, in bytes.
PIECE = 4 << 20
#: Window ends of a segment.
SEGMENT = 64
SUFFIX = 4

RESULT = "struct<spans:array<struct<a:bigint,b:bigint>>,items:array<string>,n_words:bigint>"
_PAIR = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_SPLIT).split()


def _folded(hashes: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """One hash of the n words that end at each place."""
    out = np.full(len(ends), U64(n))
    for k in range(n - 1, -1, -1):
        out = mix(out * U64(0x9E3779B97F4A7C15) + hashes[ends - k])
    return out


class WuManber:
    """All test strings of m words, as arrays by name.

    shift: by the top bits of a block's hash, how far the window may move; of blocks that
    share a place the least. suffix: sorted hashes of the strings' last words; whole: their
    hashes; text_start, text_end: their places in the text; owner, owner_end: their items.
    """

    NAMES = {"shift": np.uint8, "suffix": U64, "whole": U64, "text_start": np.int64, "text_end": np.int64, "owner": np.int64, "owner_end": np.int64}

    def __init__(self, m: int, text: np.ndarray, parts: dict[str, np.ndarray]) -> None:
        self.m, self.block, self.last = m, min(2, m), min(SUFFIX, m)
        self.text, self.parts = text, parts
        self._shift = parts["shift"]
        self._down = U64(64 - (len(self._shift).bit_length() - 1))
        self._sure: set[tuple[int, bytes]] = set()

    @classmethod
    def built(cls, m: int, text: np.ndarray, words: Words, ends: np.ndarray, item: np.ndarray) -> WuManber:
        """ends: the last word of each window of m words; item: the number of its item."""
        block, last = min(2, m), min(SUFFIX, m)
        bits = max(10, (len(ends) * (m - block + 1) * 4).bit_length())
        shift = np.full(1 << bits, min(m - block + 1, 255), np.uint8)
        for j in range(m - block, -1, -1):  # a block that ends j words before the string's end
            at = (_folded(words.hash, ends - j, block) >> U64(64 - bits)).astype(np.int64)
            shift[at] = np.minimum(shift[at], min(j, 255))
        suffix, whole = _folded(words.hash, ends, last), _folded(words.hash, ends, m)
        start, end = words.start[ends - m + 1], words.end[ends]
        order = np.lexsort((item, whole, suffix))
        suffix, whole, start, end, item = (x[order] for x in (suffix, whole, start, end, item))
        new = np.r_[True, (whole[1:] != whole[:-1]) | (suffix[1:] != suffix[:-1])]
        for k in np.flatnonzero(~new).tolist():  # equal hashes of other words are another string
            new[k] = text[start[k] : end[k]].tobytes() != text[start[k - 1] : end[k - 1]].tobytes()
        first = np.flatnonzero(new)
        return cls(m, text, {"shift": shift, "suffix": suffix[first], "whole": whole[first], "text_start": start[first], "text_end": end[first], "owner": item, "owner_end": np.r_[first[1:], len(item)]})

    def _ends(self, words: Words) -> np.ndarray:
        """Places of words where a string may end: those that the windows stop at with a shift of 0."""
        lo, hi = words.bounds[:-1] + self.m - 1, words.bounds[1:]
        many = np.maximum(0, -(-(hi - lo) // SEGMENT))
        row = np.repeat(np.arange(len(lo)), many)
        at = lo[row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * SEGMENT
        stop = np.minimum(at + SEGMENT, hi[row])
        found = []
        while len(at):
            step = self._shift[(_folded(words.hash, at, self.block) >> self._down).astype(np.int64)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def search(self, data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last word, string) of each occurrence."""
        ends = self._ends(words)
        want, p = _folded(words.hash, ends, self.last), self.parts
        first, n = np.searchsorted(p["suffix"], want), np.searchsorted(p["suffix"], want, "right")
        n -= first
        at = np.repeat(ends, n)
        string = np.repeat(first, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        like = _folded(words.hash, at, self.m) == p["whole"][string] if len(at) else np.zeros(0, bool)
        at, string = at[like], string[like]
        good = [self._same(data[a:b].tobytes(), k) for a, b, k in zip(words.start[at - self.m + 1].tolist(), words.end[at].tolist(), string.tolist(), strict=True)]
        return at[good], string[good]

    def _same(self, raw: bytes, string: int) -> bool:
        if (string, raw) in self._sure:
            return True
        good = b" ".join(words_of(raw)) == self.text[self.parts["text_start"][string] : self.parts["text_end"][string]].tobytes()
        if good:
            if len(self._sure) >= 20_000:
                self._sure.clear()
            self._sure.add((string, raw))
        return good

    def items(self, string: int) -> list[int]:
        end = self.parts["owner_end"]
        return self.parts["owner"][end[string - 1] if string else 0 : end[string]].tolist()


class Automata:
    """Those of one part of the benchmark, and the names of its items."""

    def __init__(self, by_length: list[WuManber], names: list[str]) -> None:
        self.by_length, self.names = by_length, names

    @classmethod
    def built(cls, rows: list[tuple[str, bytes]], window: int) -> Automata:
        names: dict[str, int] = {}
        texts = [b" ".join(words_of(text)) + b"\n" for _, text in rows]
        data = np.frombuffer(b"".join(texts) or b"\n", np.uint8)
        words = Words(data, np.cumsum([0, *map(len, texts)]), ALNUM)
        own = np.array([names.setdefault(item, len(names)) for item, _ in rows], np.int64)
        n = np.diff(words.bounds)
        place = np.arange(len(words.hash)) - words.bounds[:-1][words.row]
        least = np.minimum(n, window)
        made = []
        for m in np.unique(least[n > 0]).tolist():
            ends = np.flatnonzero((least[words.row] == m) & (place >= m - 1))
            made.append(WuManber.built(m, data, words, ends, own[words.row[ends]]))
        return cls(made, list(names))

    def put(self, path: str) -> None:
        data = [n.encode() for n in self.names]
        _store.put(f"{path}/names.u1", np.array(list(b"".join(data)), np.uint8))
        _store.put(f"{path}/names_end.i8", np.cumsum([len(n) for n in data], dtype=np.int64))
        for a in self.by_length:
            _store.put(f"{path}/text.u1", a.text)
            for name, kind in WuManber.NAMES.items():
                _store.put(f"{path}/{a.m}-{name}", np.asarray(a.parts[name], kind))

    @classmethod
    def mapped(cls, path: str, lengths: list[int]) -> Automata:
        data, end = _store.mapped(f"{path}/names.u1", np.uint8).tobytes(), _store.mapped(f"{path}/names_end.i8", np.int64).tolist()
        text = _store.mapped(f"{path}/text.u1", np.uint8) if lengths else np.zeros(0, np.uint8)
        return cls([WuManber(m, text, {name: _store.mapped(f"{path}/{m}-{name}", kind) for name, kind in WuManber.NAMES.items()}) for m in lengths], [data[a:b].decode() for a, b in zip([0, *end], end, strict=False)])


def _pieces(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, Words, int, int]]:
    """(bytes, words, place of the first word, words that the piece before had too); a long single row comes in several."""
    if len(offsets) > 2 or len(data) <= 2 * PIECE:
        yield data, Words(data, offsets, ALNUM), 0, 0
        return
    lo, done, tail = 0, 0, 0
    while lo < len(data):
        hi = min(len(data), lo + PIECE)
        while hi < len(data) and ALNUM[data[hi]] and ALNUM[data[hi - 1]]:
            hi += 1
        part = data[lo - tail : hi]
        words = Words(part, np.array([0, len(part)]), ALNUM)
        again = len(words_of(data[lo - tail : lo].tobytes()))
        yield part, words, done - again, again
        done += len(words.hash) - again
        keep = min(window - 1, len(words.hash))
        tail = len(part) - int(words.start[len(words.start) - keep]) if keep else 0
        lo = hi


def find(data: np.ndarray, offsets: np.ndarray, automata: list[Automata], window: int) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """For each row: its number of words, its merged spans (a, b), its items in order."""
    rows = len(offsets) - 1
    n_words = np.zeros(rows, np.int64)
    items: list[set[str]] = [set() for _ in range(rows)]
    spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part, words, base, again in _pieces(data, offsets, window):
        n_words += np.diff(words.bounds)
        n_words[0] -= again
        for one in automata:
            for a in one.by_length:
                at, string = a.search(part, words)
                row = words.row[at]
                spans.append((row, at - a.m + 1 - words.bounds[row] + base, at + 1 - words.bounds[row] + base))
                for r, k in set(zip(row.tolist(), string.tolist(), strict=True)):
                    items[r].update(one.names[i] for i in a.items(k))
    row, lo, hi = (np.concatenate([s[k] for s in spans] or [np.zeros(0, np.int64)]) for k in range(3))
    order = np.lexsort((hi, lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    edge = np.searchsorted(row, np.arange(rows + 1))
    return n_words, [_union(lo[a:b], hi[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], [sorted(i) for i in items]


def _union(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Merged spans, as rows (a, b); lo is sorted."""
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    reach = np.maximum.accumulate(hi)
    new = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])
    return np.column_stack([lo[new], np.maximum.reduceat(hi, new)])


def searched(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """From a text column to a struct of the merged word spans, the items and the number of words."""
    spark = benchmark.sparkSession
    folder = new_path(spark, "benchmark")
    tests = picked(benchmark, item=item_col, text=text_col).where("item is not null and text is not null").select(F.col("item").cast("string").alias("item"), "text")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        made = Automata.built(sorted((i, t.encode()) for i, t in zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True)), window)
        made.put(f"{folder}/{part}")
        return pa.table({"part": pa.array([part], pa.int64()), "lengths": pa.array([[a.m for a in made.by_length]], pa.list_(pa.int64()))})

    parts = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-size // block_bytes)))).alias("part")
    built = [(r["part"], r["lengths"]) for r in tests.select(parts, "item", "text").groupBy("part").applyInArrow(build, "part bigint, lengths array<bigint>").collect()]  # a row a part

    def judge():
        automata = [Automata.mapped(f"{folder}/{part}", lengths) for part, lengths in built]

        def one(texts: pa.Array) -> pa.Array:
            words, spans, items = [], [], []
            for *_, data, offsets in slices(texts):
                w, s, i = find(data, offsets, automata, window)
                words.append(w)
                spans += s
                items += i
            pairs = np.concatenate([*spans, np.zeros((0, 2), np.int64)])
            place = pa.array(np.cumsum([0, *map(len, spans)]), pa.int32())
            span = pa.ListArray.from_arrays(place, pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], fields=list(_PAIR)))
            return pa.StructArray.from_arrays([span, pa.array(items, pa.list_(pa.string())), pa.array(np.concatenate([*words, np.zeros(0, np.int64)]), pa.int64())], names=["spans", "items", "n_words"])

        return one

    return by_text(RESULT, judge)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans: the merged word spans [a, b) of the occurrences. Null and empty texts have no
    words and aren't contaminated. Rows of one item id count as one item; a benchmark row
    without id or words tests nothing. Repeated documents are judged alike, each in its own
    row. Other columns are not read. An empty table gives no rows, an empty benchmark no hits.
    """
    search = searched(benchmark, item_col, item_text_col, window, block_bytes)
    state = docs.select(docs[id_col].alias("id"), search(docs[text_col]).alias("found")).select(F.col("id").alias(id_col), "found.*")
    return state.select(
        id_col, "n_words", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"]).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def clean(text: Column, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Column:
    """Whether no test string occurs in the text; also true for null and empty ones."""
    return F.size(searched(benchmark, item_col, item_text_col, window, block_bytes)(text)["spans"]) == 0


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no test string occurs, with all their columns."""
    return docs.where(clean(docs[text_col], benchmark, item_col, item_text_col, window, block_bytes))
