"""From text blocks with boxes to ordered passages. A page is the unit; nothing here looks across documents."""

from __future__ import annotations

import statistics
from collections import namedtuple
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.names import short_hash
from factloom.schemas import PASSAGES

# Shares of the page's height and width, points, characters.
EDGE, WIDE, LIMIT, LEAST_BODY = 0.12, 0.72, 1500, 20


def clean(text: Column) -> Column:
    t = F.translate(text, "\x00", "")
    t = F.replace(t, F.lit("\x07"), F.lit("•"))
    lines = F.transform(F.split(t, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def furniture_key(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", "#"), r"\s+", " "), F.lit(" ·|—-#"))


def roles(blocks: DataFrame) -> DataFrame:
    """Cleaned blocks with their role: edge blocks whose key two pages or more share are headers or footers."""
    b = blocks.withColumn("text", clean(F.col("text"))).where("text <> '' and x1 > x0 and y1 > y0")
    top, bottom = F.col("y1") <= EDGE * F.col("page_height"), F.col("y0") >= (1 - EDGE) * F.col("page_height")
    edge = b.where(top | bottom).withColumn("key", furniture_key(F.col("text")))
    often = edge.groupBy("document_id", "key").agg(F.count_distinct("page_index").alias("pages")).where("pages >= 2").select("document_id", "key", F.lit(True).alias("often"))
    role = F.when(F.col("often") & top, "header").when(F.col("often") & bottom, "footer").otherwise("body")
    named = edge.join(often, ["document_id", "key"], "left").select(*blocks.columns, role.alias("role"))
    return named.unionByName(b.where(~F.coalesce(top | bottom, F.lit(False))).withColumn("role", F.lit("body")))


def split_text(text: str, limit: int) -> list[tuple[int, str]]:
    """Pieces with their places, each cut at the latest break of any kind in the last two fifths of the limit."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = max(text.rfind(mark, at + int(limit * 0.6), at + limit) for mark in ("\n\n", ". ", "\n", " "))
        if cut < 0:
            cut = at + limit
        elif text.startswith(". ", cut):
            cut += 1
        out.append((at, text[at:cut].rstrip()))
        at = cut + len(text[cut:]) - len(text[cut:].lstrip())
    if text[at:].strip():
        out.append((at, text[at:].rstrip()))
    return out


def _columns(blocks: list, width: float) -> dict[int, int]:
    typical = statistics.median(b.x1 - b.x0 for b in blocks) if blocks else 0
    reach = max(24, min(0.18 * width, 0.55 * typical))
    out, sums = {}, []
    for b in sorted(blocks, key=lambda b: (b.x0, b.block_no)):
        if not sums or b.x0 - sums[-1][0] / sums[-1][1] > reach:
            sums.append([0.0, 0])
        sums[-1][0] += b.x0
        sums[-1][1] += 1
        out[b.block_no] = len(sums) - 1
    return out


Block = namedtuple("Block", "document_id page_index page_width block_no x0 y0 x1 y1 text role")
_PLACED = "document_id string, page_index int, reading_order int, role string, text string, char_start int, char_end int, x0 double, y0 double, x1 double, y1 double"
_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in map(str.split, _PLACED.split(", "))])
#: Passages sent back at once.
ROWS = 5000


def _page(rows: list[Block], limit: int) -> list[tuple]:
    width = float("nan") if rows[0].page_width is None else rows[0].page_width
    body = [r for r in rows if r.role == "body"]
    wide = sorted((r for r in body if r.x1 - r.x0 >= WIDE * width), key=lambda r: (r.y0, r.x0, r.block_no))
    narrow = [r for r in body if r.x1 - r.x0 < WIDE * width]
    column = _columns(narrow, width)
    band = lambda r: sum(w.y0 <= (r.y0 + r.y1) / 2 for w in wide)
    key = {r.block_no: (1, band(r), 1, column[r.block_no], r.y0, r.x0) for r in narrow} | {w.block_no: (1, k, 2, 0, w.y0, w.x0) for k, w in enumerate(wide)}
    key |= {r.block_no: (0 if r.role == "header" else 2, 0, 0, 0, r.y0, r.x0) for r in rows if r.role != "body"}
    merged: list[dict] = []
    for r in sorted(rows, key=lambda r: (key[r.block_no], r.block_no)):
        c, last = column.get(r.block_no, -1), merged[-1] if merged else None
        if last and last["role"] == r.role and last["c"] == c and -1 <= r.y0 - last["y1"] <= 9 and abs(r.x0 - last["x0"]) <= 35 and len(last["text"]) + 1 + len(r.text) <= limit:
            last["text"] += "\n" + r.text
            last["y1"], last["x0"], last["y0"], last["x1"] = max(last["y1"], r.y1), min(last["x0"], r.x0), min(last["y0"], r.y0), max(last["x1"], r.x1)
        else:
            merged.append({"role": r.role, "c": c, "y1": r.y1, "x0": r.x0, "y0": r.y0, "x1": r.x1, "text": r.text})
    out, at = [], 0
    for m in merged:
        for _, text in split_text(m["text"], limit):
            out.append((rows[0].document_id, rows[0].page_index, len(out), m["role"], text, at, at + len(text), m["x0"], m["y0"], m["x1"], m["y1"]))
            at += len(text) + 2
    return out


def _pages(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Passages of the pages of one task, whose blocks come page by page."""
    made: list[tuple] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), _ARROW.types)], schema=_ARROW)
    blocks = chain.from_iterable(map(Block._make, zip(*(c.to_pylist() for c in b.columns))) for b in batches)
    for _, page in groupby(blocks, lambda b: b[:2]):
        made += _page(list(page), limit)
        if len(made) >= ROWS:
            yield batch()
            made = []
    if made:
        yield batch()


def placed(blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Passages with the box of their blocks: x0, y0, x1, y1."""
    flat = roles(blocks)
    at = ["document_id", "page_index"]
    made = flat.select(*Block._fields).repartition(*at).sortWithinPartitions(*at).mapInArrow(lambda batches: _pages(batches, limit), _PLACED)
    return made.withColumns({"id": short_hash("passage_", F.col("document_id"), F.col("page_index"), F.col("reading_order"), F.col("text")), "text_hash": F.sha2("text", 256)}).select(*(c.split()[0] for c in PASSAGES.split(", ")), "x0", "y0", "x1", "y1")


def passages(blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Ordered, merged and split passages of each page, with their offsets in the page."""
    return placed(blocks, limit).drop("x0", "y0", "x1", "y1")


def outside_tables(passages: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Passages (with boxes) without those that a table (document_id, page_index, x0, y0, x1, y1) covers by the share or more; their numbers are the table's."""
    box = lambda s: F.struct(*(F.col(f"{s}.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")))
    p, t = passages.alias("p"), tables.alias("t")
    same = (F.col("p.document_id") == F.col("t.document_id")) & (F.col("p.page_index") == F.col("t.page_index"))
    return p.join(t, same & (overlap(box("p"), box("t")) >= share), "left_anti")


def ocr_needed(pages: DataFrame, made: DataFrame) -> DataFrame:
    """Pages (document_id, page_index) with hardly any body text."""
    size = made.where("role = 'body'").groupBy("document_id", "page_index").agg(F.sum(F.length("text")).alias("n"))
    return pages.select("document_id", "page_index").distinct().join(size, ["document_id", "page_index"], "left").where(F.coalesce("n", F.lit(0)) < LEAST_BODY).select("document_id", "page_index", F.lit("ocr_needed").alias("warning"))


def status(pages: DataFrame, made: DataFrame) -> DataFrame:
    warned = ocr_needed(pages, made).groupBy("document_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("page "), (F.col("page_index") + 1).cast("string"), F.lit(": "), "warning"))).alias("warnings"))
    return pages.select("document_id").distinct().join(warned, "document_id", "left").select("document_id", F.when(F.col("warnings").isNull(), "complete").otherwise("partial").alias("status"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


def clamp(c: Column, low: Column, high: Column, slack: float = 0.5) -> Column:
    """Into the page; null if outside by more than the slack."""
    return F.when((c >= low - slack) & (c <= high + slack), F.least(F.greatest(c, low), high))


def keep_tables(cells: DataFrame) -> DataFrame:
    """Cells of tables with two non-empty rows and two populated columns at least."""
    at = ["document_id", "page_index", "table_index"]
    good = cells.where(F.trim("text") != "").groupBy(*at).agg(F.count_distinct("row_index").alias("r"), F.count_distinct("column_index").alias("c")).where("r >= 2 and c >= 2")
    return cells.join(good.select(*at), at, "left_semi")


def overlap(a: Column, b: Column) -> Column:
    """Share of box a that box b covers."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1") / F.nullif((a["x1"] - a["x0"]) * (a["y1"] - a["y0"]), F.lit(0.0))


__all__ = ["clamp", "clean", "furniture_key", "keep_tables", "ocr_needed", "outside_tables", "overlap", "passages", "placed", "roles", "split_text", "status"]
