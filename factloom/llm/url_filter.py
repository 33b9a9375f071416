"""URL filter: glob rules in a bit-parallel automaton.

All patterns are simulated together by Shift-And over several 64-bit words. A pattern
of m symbols takes m + 1 bits (its states); a ``*`` gives its state a loop on every
character; ``?`` is any one character; ``\\`` makes the next character literal. A batch of
URLs advances one character at a time, each by two ANDs, an OR and a shift with carry.

A URL is matched in the canonical form ``.host#path``: neither part can hold a ``#``, so a
pattern with one ``#`` splits it in one way only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm._io import picked

Rule = tuple[str, str, str]
Glob = tuple[str, str]

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class GlobAutomaton:
    """Matches whole strings against all patterns at once."""

    def __init__(self, patterns: Sequence[str]) -> None:
        parsed = [self._parse(p) for p in patterns]
        letters = sorted({c for symbols, _ in parsed for c in symbols if c >= 0})
        self._letters = np.array(letters, np.uint32)
        bits = sum(len(symbols) + 1 for symbols, _ in parsed)
        words = max(1, (bits + 63) // 64)
        self._step = np.zeros((len(letters) + 1, words), np.uint64)
        self._loop, self._first, self._last = (np.zeros(words, np.uint64) for _ in range(3))
        self._ends = []
        at = 0
        for symbols, stars in parsed:
            self._set(self._first, at)
            for s in stars:
                self._set(self._loop, at + s)
            for k, c in enumerate(symbols):
                for row in range(len(letters) + 1) if c < 0 else [letters.index(c)]:
                    self._set(self._step[row], at + k + 1)
            self._ends.append(at + len(symbols))
            at += len(symbols) + 1

    @staticmethod
    def _parse(pattern: str) -> tuple[list[int], set[int]]:
        symbols, stars, chars = [], set(), iter(pattern)
        for c in chars:
            if c == "*":
                stars.add(len(symbols))
            else:
                symbols.append(-1 if c == "?" else ord(next(chars, "\\") if c == "\\" else c))
        return symbols, stars

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << bit % 64)

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean matrix: text by pattern."""
        long = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-long, kind="stable")
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.searchsorted(self._letters, points).astype(np.int32)
        other = len(self._letters)
        if other:
            code[(code == other) | (self._letters[np.minimum(code, other - 1)] != points)] = other
        start = (np.cumsum(long) - long)[order]
        sorted_long = long[order]
        state = np.tile(self._first, (len(texts), 1))
        live = len(texts)
        for t in range(int(sorted_long[0]) if len(texts) else 0):
            while sorted_long[live - 1] <= t:
                live -= 1
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self._step[code[start[:live] + t]]) | (now & self._loop)
        out = np.empty((len(texts), len(self._ends)), bool)
        for p, bit in enumerate(self._ends):
            out[order, p] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:stop].translate(_LOWER), rest[stop:]
    return host, rest[: min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))]


def _literal(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], globs: Sequence[Glob] = (), default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    rules: (verdict, host, path); one fits its host and all subdomains of it, if the URL's
    path starts with the rule's. The longest host + path wins, then the longer host, then
    the first given. Where none fits, ``rule`` is null and the first matching glob
    (verdict, pattern over ``.host#path``) gives the verdict, else ``default``.
    A null URL, or one without ``://``, has empty host and path and is judged like others.
    Repeated rows give repeated results; no row is dropped. Other columns are not read.
    """
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), -len(rules[i][1]), i))
    rules = [tuple(rules[i]) for i in ranked]
    patterns = [f"*.{_literal(h)}#{_literal(p)}*" for _, h, p in rules] + [g for _, g in globs]
    verdicts = [v for v, _, _ in rules] + [v for v, _ in globs] + [default]
    source = picked(pages, id=id_col, url=url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(patterns)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            hits = automaton.match([f".{h}#{p}" for h, p in parts])
            hits = np.column_stack([hits, np.ones(len(parts), bool)])
            first = hits.argmax(1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([h for h, _ in parts], pa.string()),
                pa.array([p for _, p in parts], pa.string()),
                pa.array([rules[k][1] + rules[k][2] if k < len(rules) else None for k in first], pa.string()),
                pa.array([verdicts[k] for k in first], pa.string()),
            ], names=[id_col, "host", "path", "rule", "verdict"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
