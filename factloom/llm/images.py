"""Edited copies of images by local descriptors.

Corners are found on five scales, over a factor of four, and all are kept; each has an
orientation (towards its patch's intensity centroid) and 256 binary tests of smoothed
intensities, turned by that orientation. A descriptor goes into TABLES tables by 64 of its
bits each, chosen at random; descriptors in one cell of a table make their images
candidates. A pair is a copy if enough of its mutually nearest descriptors agree on one
similarity transform (turn, scale, shift), so cropped, scaled, turned, brightened or noisy
copies count.

Equal images are one vertex. The tables are joined one after another: images of a cell that
aren't connected yet are compared with the cell's centre, so that a large group of copies is
one component after the first table. Where cells of any table then still hold several
components, their images of different components are compared with each other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._io import materialize, picked, release, scratch
from factloom.llm._text import U64, mix
from factloom.llm.graph import across, centred, components, with_least

#: Halves and quarters of a scale are scales too, so that copies of half and a quarter of the size have some in common.
SCALES = (1.0, 0.7, 0.5, 0.35, 0.25)
TESTS, TABLES = 256, 6
PATCH = 18
MOST_BITS = 44
#: Tables that are joined at a time.
ROUNDS = (slice(0, 1), slice(1, 3), slice(3, None))
MIN_INLIERS = 6
TOLERANCE = 0.04
#: Images are shrunk to this longest side before corners are sought, the default of a parameter.
MAX_SIDE = 256
SIDE = 64

_rng = np.random.default_rng(11)
_PAIRS = np.clip(_rng.normal(0, PATCH / 2.2, (TESTS, 2, 2)), -PATCH, PATCH).astype(np.float32)
_SUBSETS = np.stack([_rng.choice(TESTS, 64, replace=False) for _ in range(TABLES)])
_DISC = np.array([(x, y) for x in range(-9, 10) for y in range(-9, 10) if x * x + y * y <= 81])


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM or PPM, or of an 8-bit PNG without interlacing; None for anything else."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            return _netpbm(data)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, struct.error, zlib.error):
        pass
    return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    return pixels[..., :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32) if pixels.shape[-1] >= 3 else pixels[..., 0].astype(np.float32)


def _netpbm(data: bytes) -> np.ndarray | None:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h, most = fields
    c = 3 if data[:2] == b"P6" else 1
    if most > 255 or w * h * c == 0:
        return None
    return _grey(np.frombuffer(data, np.uint8, w * h * c, at + 1).reshape(h, w, c))


def _png(data: bytes) -> np.ndarray | None:
    at, parts, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 4, 6):
        return None
    w, h, c = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * c)
    out, above = np.zeros((h, w, c), np.uint8), np.zeros((w, c), np.int32)
    for y in range(h):
        row, kind = raw[y, 1:].reshape(w, c).astype(np.int32), raw[y, 0]
        if kind == 2:
            row = (row + above) & 255
        elif kind == 1:
            row = np.cumsum(row, 0) & 255
        elif kind in (3, 4):
            left, corner = np.zeros(c, np.int32), np.zeros(c, np.int32)
            for x in range(w):
                up = above[x]
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    a, b, d = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))
                left = row[x] = (row[x] + guess) & 255
                corner = up
        out[y], above = row, row
    return _grey(out)


def _resized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Averages of two by two while the target is half the size or less, then linear between neighbours."""
    while image.shape[0] >= 2 * h and image.shape[1] >= 2 * w:
        even = image[: image.shape[0] // 2 * 2, : image.shape[1] // 2 * 2]
        image = (even[::2, ::2] + even[1::2, ::2] + even[::2, 1::2] + even[1::2, 1::2]) / 4
    for axis, n in ((0, h), (1, w)):
        m = image.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        lo = np.minimum(at.astype(int), max(0, m - 2))
        hi = np.minimum(lo + 1, m - 1)
        share = (at - lo).astype(np.float32)
        share = share[:, None] if axis == 0 else share
        image = image.take(lo, axis) * (1 - share) + image.take(hi, axis) * share
    return image


def _smoothed(image: np.ndarray, times: int = 1) -> np.ndarray:
    h, w = image.shape
    for _ in range(times):
        p = np.empty((h + 4, w), image.dtype)
        p[2:-2], p[:2], p[-2:] = image, image[0], image[-1]
        image = (p[:h] + p[4:] + 4 * (p[1 : h + 1] + p[3 : h + 3]) + 6 * p[2 : h + 2]) / 16
        p = np.empty((h, w + 4), image.dtype)
        p[:, 2:-2], p[:, :2], p[:, -2:] = image, image[:, :1], image[:, -1:]
        image = (p[:, :w] + p[:, 4:] + 4 * (p[:, 1 : w + 1] + p[:, 3 : w + 3]) + 6 * p[:, 2 : w + 2]) / 16
    return image


def _highest(values: np.ndarray, reach: int) -> np.ndarray:
    """The highest value within reach, along both axes."""
    for _ in range(2):
        n = len(values)
        p = np.full((n + 2 * reach, values.shape[1]), -np.inf, values.dtype)
        p[reach:-reach] = values
        values = np.maximum.reduce([p[k : k + n] for k in range(2 * reach + 1)]).T
    return values


def describe(image: np.ndarray, max_side: int = MAX_SIDE) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale, angle) and the 256 bits (as four 64-bit words) of all corners on all scales."""
    h, w = image.shape
    shrink = min(1.0, max_side / max(h, w))
    places, words = [], []
    for scale in SCALES:
        s = scale * shrink
        hh, ww = max(1, round(h * s)), max(1, round(w * s))
        if min(hh, ww) < 16:
            continue
        small = _smoothed(_resized(image, hh, ww))
        gy, gx = np.gradient(small)
        a, b, c = (_smoothed(x, 2) for x in (gx * gx, gy * gy, gx * gy))
        strength = a * b - c * c - 0.05 * (a + b) ** 2
        ys, xs = np.nonzero((strength >= _highest(strength, 3)) & (strength > 1.0))
        if not len(ys):
            continue
        smooth = _smoothed(small, 2)
        near = lambda p, n: np.minimum(np.maximum(np.rint(p).astype(np.int32), 0), n - 1)
        at = lambda px, py, hh=hh, ww=ww, smooth=smooth.ravel(): smooth[near(py, hh) * ww + near(px, ww)]
        disc = at(xs[:, None] + _DISC[:, 0], ys[:, None] + _DISC[:, 1])
        angle = np.arctan2(disc @ _DISC[:, 1], disc @ _DISC[:, 0])
        cos, sin = np.cos(angle).astype(np.float32)[:, None, None], np.sin(angle).astype(np.float32)[:, None, None]
        px, py = _PAIRS[None, :, :, 0], _PAIRS[None, :, :, 1]
        values = at(xs[:, None, None] + cos * px - sin * py, ys[:, None, None] + sin * px + cos * py)
        places.append(np.column_stack([(xs + 0.5) / s, (ys + 0.5) / s, np.full(len(xs), 1 / s), angle]))
        words.append(np.packbits(values[..., 0] < values[..., 1], 1).view("<i8"))
    if not places:
        return np.zeros((0, 4)), np.zeros((0, 4), np.int64)
    return np.concatenate(places), np.concatenate(words)


def cells(words: np.ndarray, tables: slice = slice(None)) -> np.ndarray:
    """The distinct cells of an image's descriptors in some of the tables, as hashes."""
    which = np.arange(TABLES)[tables]
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, TESTS // 8), axis=1)
    part = np.ascontiguousarray(np.packbits(bits[:, _SUBSETS[which]], 2)).view("<u8")[..., 0]
    return np.unique(mix(part + which.astype(U64) * U64(0x9E3779B97F4A7C15))).view(np.int64)


def inliers(a: np.ndarray, da: np.ndarray, b: np.ndarray, db: np.ndarray) -> int:
    """Most matches that one similarity transform explains. a, b: places; da, db: descriptors."""
    if not len(a) or not len(b):
        return 0
    distance = np.bitwise_count(da[:, None].view(np.uint64) ^ db[None].view(np.uint64)).sum(2, dtype=np.int64)
    to = distance.argmin(1)
    k = np.flatnonzero((distance.argmin(0)[to] == np.arange(len(a))) & (distance[np.arange(len(a)), to] <= MOST_BITS))
    if len(k) < MIN_INLIERS:
        return 0
    pa_, pb = a[k], b[to[k]]
    turn, scale = pb[:, 3] - pa_[:, 3], pb[:, 2] / pa_[:, 2]
    za, zb = pa_[:, 0] + 1j * pa_[:, 1], pb[:, 0] + 1j * pb[:, 1]
    factor = scale * np.exp(1j * turn)
    off = np.abs(zb[None] - (factor[:, None] * (za[None] - za[:, None]) + zb[:, None]))
    reach = TOLERANCE * np.hypot(np.ptp(b[:, 0]) + 1, np.ptp(b[:, 1]) + 1) + 2
    same_turn = np.abs(np.angle(np.exp(1j * (turn[None] - turn[:, None])))) < 0.5
    same_scale = np.abs(np.log(scale[None] / scale[:, None])) < 0.35
    return int(((off <= reach) & same_turn & same_scale).sum(1).max())


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, image): a vector as a smooth grey picture of a square grid with a cell for each number.

    The tables hold no images; near copies among the vectors become noisy copies of pictures.
    A null or empty vector has a null image; numbers that aren't finite count as 0.
    """
    source = picked(vectors, id=id_col, vector=vector_col).withColumn("vector", F.col("vector").cast("array<float>"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                if not v:
                    out.append(None)
                    continue
                v = np.nan_to_num(np.array([np.nan if x is None else x for x in v], np.float64), nan=0.0, posinf=0.0, neginf=0.0)
                n = int(np.ceil(np.sqrt(len(v))))
                if n not in spread:
                    at = ((np.arange(SIDE) + 0.5) * n / SIDE)[:, None] - np.arange(n) - 0.5
                    m = np.exp(-((at / 0.4) ** 2))
                    spread[n] = m / m.sum(1, keepdims=True)
                level = max(3 * float(v.std()), 1e-9)
                grid = np.zeros(n * n)
                grid[: len(v)] = np.clip((v - v.mean()) / level, -1, 1)
                picture = spread[n] @ grid.reshape(n, n) @ spread[n].T
                out.append(f"P5 {SIDE} {SIDE} 255\n".encode() + np.rint(127.5 + 127.5 * picture).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "image"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, image binary")


def edited_copies(images: DataFrame, id_col: str = "vec_id", image_col: str = "image", max_side: int = MAX_SIDE) -> DataFrame:
    """One row per row of ``images``: id, class_id, kept, n_links.

    class_id: the least id of the row's class of copies (null if the class has none); kept:
    true for one row of each class, the first stored. n_links: verified links between its
    image and other images, of those that connect the class; equal images share them. Images
    that can't be decoded, null ones and ones without corners are alike only if their bytes
    are; null ones are alike to none. Rows that repeat an id are separate rows. An empty
    table gives no rows. Other columns are not read. Images are shrunk to ``max_side``, so
    that details which vanish there tell nothing apart; no corner, cell or candidate is left out.
    """
    source = picked(images, id=id_col, image=image_col).select(F.monotonically_increasing_id().alias("uid"), "id", F.sha2("image", 256).alias("node"), "image")
    kind = source.schema["id"].dataType.simpleString()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                places, words = [], []
                for node, data in zip(part.column(2).to_pylist(), part.column(3), strict=True):
                    image = None if node is None or node in seen else decode(data.as_py())
                    if image is None:
                        places.append(None)
                        words.append(None)
                        continue
                    seen.add(node)
                    p, d = describe(image, max_side)
                    places.append(p.astype(np.float32).ravel())
                    words.append(d.ravel())
                if len(seen) > 100_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(places, pa.list_(pa.float32())), pa.array(words, pa.list_(pa.int64()))], names=["uid", "id", "node", "places", "words"])
        del seen
        release()

    spark = images.sparkSession
    with scratch(spark, "images"):
        rows = materialize(source.mapInArrow(described, f"uid bigint, id {kind}, node string, places array<float>, words array<bigint>"), "descriptors")
        first = rows.where("node is not null").groupBy("node").agg(F.min("uid").alias("uid"), F.min(F.when(F.size("words") > 0, F.col("uid"))).alias("made"))
        full = rows.where("size(words) > 0").select("uid", "places", "words")
        # Of a task's copies only the first has descriptors; those of several tasks are linked as they are equal.
        equal = rows.where("size(words) > 0").select("uid", "node").join(first.select("node", "made"), "node").where("uid > made").select(F.col("made").alias("u"), F.col("uid").alias("v"), F.lit(None).cast("bigint").alias("inliers"))

        def entries(tables: slice) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for lo in range(0, len(batch), 512):
                        found = [(u, cells(np.array(w, np.int64), tables)) for u, w in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for _, k in found])), pa.array(np.repeat([u for u, _ in found], [len(k) for _, k in found]).astype(np.int64))], names=["key", "uid"])
                release()

            return full.select("uid", "words").mapInArrow(run, "key bigint, uid bigint")

        def verify(pairs: DataFrame) -> DataFrame:
            both = pairs.join(full.toDF("a", "pa", "wa"), "a").join(full.toDF("b", "pb", "wb"), "b").select("a", "b", "pa", "wa", "pb", "wb")

            def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for lo in range(0, len(batch), 256):
                        part, got = batch.slice(lo, 256), []
                        for x in zip(*(part.column(c) for c in range(2, 6)), strict=True):
                            p, d, q, e = (np.asarray(v.values).reshape(-1, 4) for v in x)
                            got.append(inliers(p.astype(float), d, q.astype(float), e))
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.int64())], names=["u", "v", "inliers"])
                release()

            return both.mapInArrow(check, "u bigint, v bigint, inliers bigint").where(F.col("inliers") >= MIN_INLIERS)

        links = materialize(equal, "links")
        label, tried = components(links), None
        for tables in ROUNDS:
            pairs = centred(entries(tables), label)
            pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
            tried = pairs if tried is None else tried.unionAll(pairs)
            found = materialize(verify(pairs), "links")
            if not found.isEmpty():
                links = links.unionAll(found)
                label = components(links)
        rest = [materialize(across(entries(tables), label).join(tried, ["a", "b"], "left_anti"), "cross") for tables in ROUNDS]
        more = materialize(verify(reduce(DataFrame.unionAll, rest).distinct()), "links")
        if not more.isEmpty():
            links = links.unionAll(more)
            label = components(links)
        links = links.where("inliers is not null")
        end = links.select(F.explode(F.array("u", "v")).alias("made")).groupBy("made").agg(F.count(F.lit(1)).alias("n_links"))
        at = first.join(label.toDF("made", "label"), "made", "left").join(end, "made", "left").select("node", F.coalesce("label", "uid").alias("class"), "n_links")
        named = materialize(rows.select("id", "uid", "node").join(at, "node", "left").select("id", "uid", F.coalesce("class", "uid").alias("class"), "n_links"), "classes", keep=True)
    return with_least(named, "id").select(F.col("id").alias(id_col), "class_id", (F.col("uid") == F.col("class")).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
