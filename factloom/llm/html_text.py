"""Main text of web pages.

Structure decides where it can: what a page marks as its article (or main part) is kept,
without the parts in it that tags, classes or roles mark as something else. A page without
such a mark is undecided; the parser says so, not a pattern over the raw html. The undecided
pages of a host are joined to one token stream; its suffix array, sorted to a depth of
``MIN_TOKENS``, shows the runs that several distinct pages share. Tokens in such runs are
boilerplate, the others stay. Of a host too large for one array, the same runs are found by
counting the pages of each hash of ``MIN_TOKENS`` tokens, over the whole host.

Runs inside a marked article are never removed: articles of a host repeat one another's
passages, and those belong to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._io import materialize, picked
from factloom.llm._text import U64, mix
from factloom.llm.url_filter import split_url

MIN_TOKENS = 8
MIN_PAGES = 3
#: Characters of undecided text that one suffix array takes in; of larger hosts, hashes are counted.
GROUP_CHARS = 1 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe noembed noframes xmp noscript svg math".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
DROPPED = frozenset("nav footer aside form head header menu dialog button select option object audio video canvas".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class or id that mark a part of no article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion promoted banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login "
    "comment comments disqus reply replies share sharing social related recommended recommendations widget toolbar pagination pager masthead".split()
)
WHOLE_MARKS = frozenset("header site-header page-header top-header siteheader pageheader".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar note".split())
#: An opening tag ends an open element of these kinds, unless one of the fences lies between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr")), "option": frozenset(("select",))}
P_FENCES = frozenset("article aside blockquote body button caption dd div dt figure footer form header html li main nav object section table td th".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^>"'])*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_MARKED = re.compile(r"[^a-z0-9]+")


def _is_dropped(name: str, rest: str, inside: bool) -> bool:
    if name in DROPPED and not (name == "header" and inside):
        return True
    if "=" not in rest or name in ("html", "body", "article", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id"):
            words = value.split()
            if not WHOLE_MARKS.isdisjoint(words) or not MARKS.isdisjoint(_MARKED.split(value)):
                return True
        elif key == "role" and value.strip() in ROLES:
            return True
    return False


def _is_main(name: str, rest: str) -> bool:
    return name in ("article", "main") or "role" in rest and any(k.lower() == "role" and "".join(v).lower() in ("main", "article") for k, *v in _ATTRIBUTE.findall(rest))


class _Page:
    """A walk over a page's tags. blocks: (inside the main part, text) in page order."""

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[bool, str]] = []
        self._parts: list[str] = []
        #: Open elements: (name, dropped, main, in a header).
        self._open: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
        at, n, lower = 0, len(html), None
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self._text(html[at:lt])
            if lt == n:
                break
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            found = _TAG.match(html, lt) or _LOOSE.match(html, lt)
            if not found:
                if html[lt + 1 : lt + 2] in "!?/" and lt + 1 < n:
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                elif html[lt + 1 : lt + 2].isascii() and html[lt + 1 : lt + 2].isalpha():
                    at = n  # a tag that never ends
                else:
                    self._text("<")
                    at = lt + 1
                continue
            at, name = found.end(), found[2].lower()
            if found[1]:
                self._end(name)
                continue
            self._start(name, found[3])
            if name in RAW and not found[3].endswith("/"):
                lower = html.lower() if lower is None else lower
                end = lower.find(f"</{name}", at) if len(lower) == n else -1
                if len(lower) != n:  # lower-casing changed the length
                    hit = re.compile(f"</{re.escape(name)}", re.IGNORECASE).search(html, at)
                    end = hit.start() if hit else -1
                at = n if end < 0 else end
        self._flush()

    def _text(self, raw: str) -> None:
        _, dropped, _, header = self._open[-1]
        if not dropped and not (header and not any(e[0] in HEADINGS for e in self._open)):
            self._parts.append(unescape(raw) if "&" in raw else raw)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._open[-1][2], text))
            self._parts.clear()

    def _close(self, k: int) -> None:
        if any(e[0] in BLOCKS for e in self._open[k:]):
            self._flush()
        del self._open[k:]

    def _start(self, name: str, rest: str) -> None:
        if name == "br" or name in ("td", "th"):
            self._parts.append(" ")
        if name in BLOCKS:
            self._flush()
            for k in range(len(self._open) - 1, 0, -1):
                if self._open[k][0] == "p":
                    self._close(k)
                    break
                if self._open[k][0] in P_FENCES:
                    break
        if name in ENDS:
            for k in range(len(self._open) - 1, 0, -1):
                if self._open[k][0] in ENDS[name]:
                    self._close(k)
                    break
                if self._open[k][0] in FENCES[name]:
                    break
        if name in VOID:
            return
        _, dropped, main, header = self._open[-1]
        self._open.append((name, dropped or _is_dropped(name, rest, main), main or _is_main(name, rest), header or name == "header"))

    def _end(self, name: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] == name:
                self._close(k)
                return
            if name not in BLOCKS and self._open[k][0] in P_FENCES:
                return
        if name in BLOCKS:
            self._flush()


def blocks_of(html: str | None) -> tuple[bool, list[str]]:
    """(the page has a main part, its blocks; else all blocks that no tag, class or role excludes)."""
    blocks = _Page(html or "").blocks
    inside = [text for main, text in blocks if main]
    return (True, inside) if inside else (False, [text for _, text in blocks])


def repeated(pages: list[np.ndarray], depth: int = MIN_TOKENS, distinct: int = MIN_PAGES) -> list[np.ndarray]:
    """For each page's tokens (numbers >= 0): whether they lie in a run of ``depth`` tokens that ``distinct`` pages hold.

    Suffixes are ranked by prefix doubling, up to the depth.
    """
    long = np.array([len(p) for p in pages], np.int64)
    text = np.concatenate([np.r_[p, -1 - i] for i, p in enumerate(pages)]).astype(np.int64) if len(pages) else np.zeros(0, np.int64)
    page = np.repeat(np.arange(len(pages)), long + 1)
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    known = 1
    while known < depth and n:
        step = min(known, depth - known)
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:]
        _, rank = np.unique(rank.astype(np.int64) * (n + 1) + ahead + 1, return_inverse=True)
        known += step
    order = np.lexsort((page, rank))
    new_rank = np.r_[True, rank[order][1:] != rank[order][:-1]][:n]
    new_page = new_rank | np.r_[True, page[order][1:] != page[order][:-1]][:n]
    group = np.cumsum(new_rank) - 1
    often = np.bincount(group, new_page)[group] >= distinct if n else np.zeros(0, bool)
    start = np.zeros(n + 1, np.int64)
    hit = np.zeros(n, bool)
    hit[order] = often
    place = np.arange(n) - np.repeat(np.cumsum(long + 1) - long - 1, long + 1)
    hit &= place + depth <= np.repeat(long, long + 1)
    np.add.at(start, np.flatnonzero(hit), 1)
    np.add.at(start, np.flatnonzero(hit) + depth, -1)
    covered = np.cumsum(start)[:n] > 0
    edge = np.cumsum(np.r_[0, long + 1])
    return [covered[edge[i] : edge[i + 1] - 1] for i in range(len(pages))]


def run_keys(host: str, tokens: list[str]) -> np.ndarray:
    """For each place that MIN_TOKENS tokens follow: a 64-bit hash of the host and of them."""
    n = len(tokens) - MIN_TOKENS + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    token = pd.util.hash_array(np.array([host, *tokens], object))
    key = np.full(n, token[0], U64)
    for k in range(MIN_TOKENS):
        key = mix(key * U64(3) + token[1 + k : 1 + k + n])
    return key.view(np.int64)


def covered_by(host: str, tokens: list[str], often: np.ndarray) -> np.ndarray:
    """For each token: whether it lies in a run whose key is one of ``often``."""
    start = np.zeros(len(tokens) + 1, np.int64)
    hit = np.flatnonzero(np.isin(run_keys(host, tokens), often))
    start[hit] += 1
    start[hit + MIN_TOKENS] -= 1
    return np.cumsum(start)[:-1] > 0


def own_text(blocks: list[list[str]], cover: np.ndarray) -> str:
    """A page's blocks without the covered runs. A run goes from a block if it fills the block or has MIN_TOKENS tokens in it."""
    at, out = 0, []
    for b in blocks:
        own = cover[at : at + len(b)]
        at += len(b)
        kept, i = [], 0
        while i < len(b):
            j = i
            while j < len(b) and own[j] == own[i]:
                j += 1
            if not own[i] or j - i < min(MIN_TOKENS, len(b)):
                kept += b[i:j]
            i = j
        if kept:
            out.append(" ".join(kept))
    return "\n".join(out)


def unique_text(pages: list[list[str]]) -> list[str]:
    """Each page's blocks without the runs that other pages repeat. Pages of the same blocks count as one."""
    number: dict[str, int] = {}
    place: dict[tuple[str, ...], int] = {}
    own = [place.setdefault(tuple(p), len(place)) for p in pages]
    tokens = [[b.split(" ") for b in p] for p in place]
    covered = repeated([np.array([number.setdefault(t, len(number)) for b in p for t in b], np.int64) for p in tokens])
    text = [own_text(p, cover) for p, cover in zip(tokens, covered, strict=True)]
    return [text[k] for k in own]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    A null or empty html has an empty text. Pages whose URL is null or has no host form one
    host. Repeated rows each have their row; undecided pages of a host with the same blocks
    count as one page, so that copies don't take one another's text. An empty table gives no
    rows. Other columns are not read.
    """
    source = picked(pages, id=id_col, url=url_col, html=html_col)
    kind = source.schema["id"].dataType.simpleString()
    out = f"id {kind}, url string, text string, n_chars bigint"

    def result(ids, urls, text: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["id", "url", "text", "n_chars"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of(h) for h in batch.column(2).to_pylist()]
            mine = pa.array([main or not blocks for main, blocks in found], pa.bool_())
            yield result(batch.column(0).filter(mine), batch.column(1).filter(mine), ["\n".join(blocks) for main, blocks in found if main or not blocks])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of(h) for h in batch.column(2).to_pylist()]
            batch = batch.filter(pa.array([not main and bool(blocks) for main, blocks in found], pa.bool_()))
            blocks = [b for main, b in found if not main and b]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([split_url(u)[0] for u in batch.column(1).to_pylist()], pa.string()),
                pa.array(blocks, pa.list_(pa.string())), pa.array([sum(map(len, b)) for b in blocks], pa.int64()),
            ], names=["id", "url", "host", "blocks", "size"])

    def undecided_text(frame: pd.DataFrame) -> pd.DataFrame:
        text = unique_text([list(b) for b in frame["blocks"]])
        return pd.DataFrame({"id": frame["id"], "url": frame["url"], "text": text, "n_chars": [len(t) for t in text]})

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, page, host, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.unique(run_keys(host, [t for b in blocks for t in b.split(" ")]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), uid, np.int64)), pa.array(np.full(len(keys), page, np.int64)), pa.array(keys)], names=["uid", "page", "key"])

    def uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for host, blocks, often in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                tokens = [b.split(" ") for b in blocks]
                text.append(own_text(tokens, covered_by(host, [t for b in tokens for t in b], np.array(often or [], np.int64))))
            yield result(batch.column(0), batch.column(1), text)

    # Pages are parsed twice, so that no text of decided ones is stored.
    decided = source.mapInArrow(whole, out)
    rest = materialize(source.mapInArrow(parsed, f"id {kind}, url string, host string, blocks array<string>, size bigint").withColumn("uid", F.monotonically_increasing_id()), "undecided")
    if rest.isEmpty():
        return decided.toDF(id_col, "url", "text", "n_chars")
    large = F.broadcast(materialize(rest.groupBy("host").agg(F.sum("size").alias("size")).where(F.col("size") > GROUP_CHARS).select("host"), "hosts"))  # a row per GROUP_CHARS of text at most
    small_text = rest.join(large, "host", "left_anti").groupBy("host").applyInPandas(undecided_text, out)
    big = rest.join(large, "host", "left_semi")
    keys = big.select("uid", F.xxhash64("host", "blocks").alias("page"), "host", "blocks").mapInArrow(keyed, "uid bigint, page bigint, key bigint")
    often = keys.groupBy("key", "page").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("one").alias("pages")).where(F.col("pages") >= MIN_PAGES).select("key")
    runs = keys.join(often, "key").groupBy("uid").agg(F.collect_list("key").alias("often"))
    big_text = big.join(runs, "uid", "left").select("id", "url", "host", "blocks", "often").mapInArrow(uncovered, out)
    return decided.unionAll(small_text).unionAll(big_text).toDF(id_col, "url", "text", "n_chars")
