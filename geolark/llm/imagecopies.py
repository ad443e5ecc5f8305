"""Cropped or edited copies in a column of images, by local descriptors.

Corners are found at several scales, each gets an orientation from its intensity centroid and 128 binary tests turned by it. Three
tables hold 43, 42 and 43 of a descriptor's bits; two pictures are a candidate pair if they share MIN_WORDS table words. All corners of a
candidate pair are then compared by Hamming distance, and the pair is linked when enough matches agree on one rotation, scale and shift.

Rows stay linear in the table words: each picture first meets the smallest picture of each of its words, and what links becomes one
class. Only words that still hold several classes are looked at again, each as one list (long ones in blocks) whose task links classes breadth
first and hands on spanning links, never all pairs.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, materialize
from .components import connected_components

#: Levels of the pyramid for each halving, tests, radii of patches and of the centroid, pixels around a corner without another.
STEPS, TESTS, REACH, CENTROID, APART = 3, 128, 13, 10, 4
#: Larger pictures are reduced until the longer side has so many pixels.
MAX_SIDE = 512
ANGLES = 32
#: Table words of a candidate pair, differing bits of a match, words' entries compared in one task.
MIN_WORDS, MAX_HAMMING, LIST_BLOCK = 2, 12, 1024
#: Agreeing matches of a link: so many, and such a share of the corners of the picture that has fewer.
MIN_VOTES, MIN_SHARE = 6, 0.05
#: What a picture is described by: a place in pixels, the level of the pyramid, the angle, 128 bits.
_CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("level", "<i4"), ("angle", "<i4"), ("d0", "<i8"), ("d1", "<i8")])


def decode(image: bytes | None) -> np.ndarray | None:
    """Grey values of an 8-bit PGM, or of an 8-bit PNG without interlace; None for anything else."""
    try:
        if image and image[:2] == b"P5":
            head = image.split(None, 4)
            width, height = int(head[1]), int(head[2])
            return np.frombuffer(image[-width * height :], np.uint8).reshape(height, width).astype(float)
        if image and image[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(image)
    except (ValueError, IndexError, struct.error, zlib.error):
        return None
    return None


def _png(image: bytes) -> np.ndarray | None:
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", image[16:29])
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or not channels:
        return None
    at, data = 8, b""
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        data += image[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.int64)
    for y in range(height):
        line, up, f = raw[y, 1:].astype(np.int64), out[y - 1] if y else np.zeros(width * channels, np.int64), raw[y, 0]
        if f in (0, 2):
            out[y] = (line + (up if f == 2 else 0)) & 255
            continue
        for x in range(len(line)):
            a, b, c = (out[y, x - channels] if x >= channels else 0), up[x], (up[x - channels] if x >= channels else 0)
            p = a + b - c
            guess = a if f == 1 else (a + b) // 2 if f == 3 else min((a, b, c), key=lambda v: abs(p - v))
            out[y, x] = (line[x] + guess) & 255
    pixels = out.reshape(height, width, channels)
    return pixels[:, :, 0].astype(float) if channels < 3 else pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def _box(m: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of side 2r + 1, borders repeated."""
    p = np.pad(m, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(1).cumsum(2)
    k = 2 * r + 1
    return (p[:, k:, k:] - p[:, :-k, k:] - p[:, k:, :-k] + p[:, :-k, :-k]) / k**2


def _zoom(m: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear samples of the images at another size."""

    def ends(new: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.minimum(at.astype(int), max(0, old - 2))
        return low, np.minimum(low + 1, old - 1), at - low

    a, b, f = ends(height, m.shape[1])
    rows = m[:, a] * (1 - f)[None, :, None] + m[:, b] * f[None, :, None]
    a, b, f = ends(width, m.shape[2])
    return rows[:, :, a] * (1 - f) + rows[:, :, b] * f


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each angle the (dy, dx) of the tests' two ends."""
    rng = np.random.default_rng(5)
    ends = np.clip(rng.normal(0, REACH / 2, (2, TESTS, 2)), -REACH * 0.7, REACH * 0.7)
    turn = 2 * np.pi * np.arange(ANGLES) / ANGLES
    c, s = np.cos(turn)[:, None, None, None], np.sin(turn)[:, None, None, None]
    y, x = ends[None, ..., 0:1], ends[None, ..., 1:2]
    out = np.rint(np.concatenate([x * s + y * c, x * c - y * s], -1)).astype(int)
    return out[:, 0], out[:, 1]


_A, _B = _patterns()
_DISC = np.array([(y, x) for y in range(-CENTROID, CENTROID + 1) for x in range(-CENTROID, CENTROID + 1) if y * y + x * x <= CENTROID**2])


def _levels(images: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(level, images): sides shrink by the STEPS-th root of two from level to level, while patches fit."""
    side = max(images.shape[1:])
    level = max(0, int(np.ceil(STEPS * np.log2(side / MAX_SIDE)))) if side else 0
    base, at = images, 0
    while True:
        while level - at >= STEPS and min(base.shape[1:]) >= 2:
            n, h, w = base.shape
            base, at = base[:, : h // 2 * 2, : w // 2 * 2].reshape(n, h // 2, 2, w // 2, 2).mean((2, 4)), at + STEPS
        by = 2.0 ** (-(level - at) / STEPS)
        h, w = round(base.shape[1] * by), round(base.shape[2] * by)
        if min(h, w) < 2 * REACH + 5:
            return
        yield level, base if level == at else _zoom(base, h, w)
        level += 1


def describe(images: np.ndarray) -> list[np.ndarray]:
    """For each image of one shape its corners (see _CORNER), in pixels of the whole image. Every local maximum of the corner strength counts."""
    found: list[list[np.ndarray]] = [[] for _ in range(len(images))]
    for level, now in _levels(images):
        n, h, w = now.shape
        smooth = _box(_box(now, 1), 1)
        gy, gx = np.gradient(smooth, axis=1), np.gradient(smooth, axis=2)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        peak = strength
        for axis in (1, 2):
            pad = [(0, 0), (0, 0), (0, 0)]
            pad[axis] = (APART, APART)
            wide = np.pad(peak, pad, constant_values=-np.inf)
            peak = np.max([wide[:, k : k + h] if axis == 1 else wide[:, :, k : k + w] for k in range(2 * APART + 1)], axis=0)
        edge = REACH + 1
        inner = np.zeros((h, w), bool)
        inner[edge : h - edge, edge : w - edge] = True
        which, y, x = np.nonzero((strength >= peak) & inner & (strength > 1e-3))
        around = smooth[which[:, None], y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
        turn = np.arctan2(around @ _DISC[:, 0], around @ _DISC[:, 1])
        angle = np.rint(turn * ANGLES / (2 * np.pi)).astype(int) % ANGLES
        at = lambda e: smooth[which[:, None], y[:, None] + e[..., 0], x[:, None] + e[..., 1]]  # noqa: E731, B023
        bits = np.packbits(at(_A[angle]) < at(_B[angle]), axis=1).copy().view(">i8")
        corners = np.zeros(len(which), _CORNER)
        corners["x"], corners["y"] = (x + 0.5) * images.shape[2] / w, (y + 0.5) * images.shape[1] / h
        corners["level"], corners["angle"], corners["d0"], corners["d1"] = level, angle, bits[:, 0], bits[:, 1]
        for i, part in enumerate(np.split(corners, np.searchsorted(which, np.arange(1, n)))):
            found[i].append(part)
    return [np.concatenate(x) if x else np.zeros(0, _CORNER) for x in found]


def table_words(corners: np.ndarray) -> np.ndarray:
    """The distinct words of the three tables, table number on top; sorted."""
    d0, d1 = corners["d0"].view(np.uint64), corners["d1"].view(np.uint64)
    low = np.uint64((1 << 21) - 1)
    words = [d0 >> np.uint64(21), ((d0 & low) << np.uint64(21)) | (d1 >> np.uint64(43)), d1 & np.uint64((1 << 43) - 1)]
    return np.unique(np.concatenate([w | np.uint64(n << 43) for n, w in enumerate(words)])).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether enough matches of two pictures' corners agree on one rotation, scale and shift; matches of one place count once.

    Each match proposes a transform; another agrees if it is turned and scaled alike (one step off at most) and lies where
    the transform puts it, with the error that the steps of angle and scale allow.
    """
    least = max(MIN_VOTES, int(np.ceil(MIN_SHARE * min(len(a), len(b)))))
    if min(len(a), len(b)) < least:
        return False
    pairs = []
    for at in range(0, len(a), 1024):
        part = a[at : at + 1024]
        bits = np.bitwise_count(part["d0"][:, None] ^ b["d0"]) + np.bitwise_count(part["d1"][:, None] ^ b["d1"])
        i, j = np.nonzero(bits <= MAX_HAMMING)
        pairs.append((i + at, j))
    i, j = np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])
    if len(i) < least:
        return False
    p, q = a[i], b[j]
    turn, step = (q["angle"] - p["angle"]) % ANGLES, q["level"] - p["level"]
    place = lambda v: (v["x"] // APART).astype(np.int64) << 32 | (v["y"] // APART).astype(np.int64)
    here, there = place(p), place(q)
    for m in range(len(i)):  # few: matches of a candidate pair
        by, rad = 2.0 ** (step[m] / STEPS), turn[m] * (2 * np.pi / ANGLES)
        x, y = p["x"] - p["x"][m], p["y"] - p["y"][m]
        ex = q["x"] - q["x"][m] - by * (np.cos(rad) * x - np.sin(rad) * y)
        ey = q["y"] - q["y"][m] - by * (np.sin(rad) * x + np.cos(rad) * y)
        off = (turn - turn[m] + 1) % ANGLES <= 2
        ok = off & (np.abs(step - step[m]) <= 1) & (np.hypot(ex, ey) <= 4 + 0.15 * by * np.hypot(x, y))
        if ok.sum() >= least and min(len(set(here[ok].tolist())), len(set(there[ok].tolist()))) >= least:
            return True
    return False


def features(images: DataFrame) -> DataFrame:
    """(id, corners, words) of (id, image): the corners as bytes and the table words; corners is null if the image cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 64):
                b = whole.slice(at, 64)
                grey = [decode(x) for x in b.column(1).to_pylist()]
                found: list = [None] * len(grey)
                for shape in {g.shape for g in grey if g is not None}:
                    same = [i for i, g in enumerate(grey) if g is not None and g.shape == shape]
                    group = max(1, 4_000_000 // max(1, shape[0] * shape[1]))
                    for k in range(0, len(same), group):
                        part = same[k : k + group]
                        for i, c in zip(part, describe(np.stack([grey[i] for i in part])), strict=True):
                            found[i] = c
                corners = pa.array([None if c is None else c.tobytes() for c in found], pa.binary())
                words = pa.array([[] if c is None else table_words(c) for c in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), corners, words], names=["id", "corners", "words"])

    return images.select("id", "image").mapInArrow(run, "id long, corners binary, words array<long>")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (src, dst, corners of both) whose pictures are linked."""
    for b in batches:
        ok = [linked(np.frombuffer(x.as_py(), _CORNER), np.frombuffer(y.as_py(), _CORNER)) for x, y in zip(b.column(2), b.column(3), strict=True)]
        yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def list_links(key: int, ids: list[int], comps: list[int], blocks: list[int], corners: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the classes of one table word's pictures, breadth first: pictures of one class are not compared again.

    A pair counts here only if this is the smallest of the words it shares, so each pair is compared in one list. If
    the pictures are of two blocks, only pairs across them count; the others have a task of their own.
    """
    n = len(ids)
    words = [table_words(c) for c in corners]
    owner, flat = np.repeat(np.arange(n), [len(w) for w in words]), np.concatenate(words)
    comp, block = np.asarray(comps), np.asarray(blocks)
    crossed = len(set(blocks)) > 1
    left = np.ones(n, bool)
    out: list[tuple[int, int]] = []
    for seed in range(n):
        if not left[seed]:
            continue
        front = deque(np.flatnonzero(left & (comp == comp[seed])).tolist())
        left[list(front)] = False
        while front and left.any():
            i = front.popleft()
            held = owner[np.isin(flat, words[i])]
            shared = np.bincount(held, minlength=n)
            for j in np.flatnonzero(left & (shared >= MIN_WORDS) & ((block != block[i]) | (not crossed))).tolist():
                if left[j] and int(np.intersect1d(words[i], words[j], assume_unique=True)[0]) == key and linked(corners[i], corners[j]):
                    out.append((ids[i], ids[j]))
                    same = np.flatnonzero(left & (comp == comp[j]))
                    left[same] = False
                    front.extend(same.tolist())
    return out


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, id, comp, block, corners) in the order of key and cell: the links of each list."""
    now: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if len({r[3] for r in now}) > 1:
            found = list_links(now[0][0], [r[2] for r in now], [r[3] for r in now], [r[4] for r in now], [np.frombuffer(r[5], _CORNER) for r in now])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["src", "dst"])
        now.clear()

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if now and now[0][:2] != row[:2]:
                yield from flush()
            now.append(row)
    yield from flush()


def linked_pictures(pictures: DataFrame, list_block: int = LIST_BLOCK) -> DataFrame:
    """(src, dst): links that hold every class of `pictures` (id, corners, words) together, one row a pair.

    Two pictures are linked if they share MIN_WORDS table words and linked() holds; classes are what links connect.
    """
    posted = pictures.select("id", F.explode("words").alias("key"))
    shared = posted.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared, "words")
    met = materialize(posted.join(shared, "key").select("key", "id", "low", "n"), "met")
    first = met.where("id <> low").groupBy("low", "id").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_WORDS).select("low", "id")
    described = pictures.select("id", "corners")
    pairs = dealt_join(materialize(first, "pairs"), described.select(F.col("id").alias("low"), F.col("corners").alias("theirs")), "low", ["id"]).join(described, "id")
    star = materialize(pairs.select(F.col("low").alias("src"), F.col("id").alias("dst"), "theirs", "corners").mapInArrow(_verified, "src long, dst long"), "star")
    comps = materialize(connected_components(star), "comps").withColumnRenamed("node", "id")
    known = met.join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))

    def open_lists(rows: DataFrame) -> DataFrame:
        """Entries of words with several classes, of pictures that have MIN_WORDS of them: a pair that could still link has these in common."""
        several = rows.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
        rows = rows.join(several, "key")
        often = rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_WORDS).select("id")
        return materialize(rows.join(often, "id"), "open")

    still = open_lists(open_lists(known))
    size = still.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > list_block).select("key", F.ceil(F.col("n") / list_block).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = still.join(size, "key", "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("long")).withColumn("blocks", blocks)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda y: F.least("block", y) * 65536 + F.greatest("block", y))
    dealt = dealt.select("key", F.explode(cells).alias("cell"), "id", "comp", "block")
    rows = dealt.join(described, "id").select("key", "cell", "id", "comp", "block", "corners")
    rest = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "id").mapInArrow(_lists, "src long, dst long")
    return star.union(rest).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def image_classes(images: DataFrame) -> DataFrame:
    """(id, class_id, n_links, readable): one row a row of (id, image), other columns are not looked at.

    Equal images are one picture, described once. class_id: the smallest id reachable over linked pictures, itself included; a null id
    takes part but names a class only if all of it is null. n_links: the links of its picture among those that hold its class together
    (a class of k pictures has k - 1 or a few more, not all its pairs). readable: whether the image is a PGM or PNG that
    decode() knows; null for a null image, which is in no class. One that cannot be read, or with a side under 31 pixels, or with few corners, is
    linked to its equals only. Larger sides than MAX_SIDE are reduced first. Repeated rows stay, ties go to the smaller id, an
    empty table gives an empty result.
    """
    rows = materialize(images.select("id", F.sha2(F.col("image"), 256).alias("sha")), "images")
    pictures = rows.where("sha is not null").groupBy("sha").agg(F.min("id").alias("low"))
    pictures = materialize(pictures.select("sha", "low", F.xxhash64("sha").alias("pic")), "pictures")
    distinct = images.where("image is not null").select(F.xxhash64(F.sha2(F.col("image"), 256)).alias("id"), "image").dropDuplicates(["id"])
    described = materialize(features(distinct), "corners")
    pairs = materialize(linked_pictures(described.where("corners is not null")), "links")
    links = pairs.select("src").union(pairs.select("dst")).groupBy("src").agg(F.count("*").alias("n_links")).withColumnRenamed("src", "pic")
    nodes = connected_components(pairs).select(F.col("node").alias("pic"), "component")
    readable = described.select(F.col("id").alias("pic"), F.col("corners").isNotNull().alias("readable"))
    known = pictures.join(readable, "pic").join(nodes, "pic", "left").withColumn("component", F.coalesce("component", "pic"))
    lows = known.groupBy("component").agg(F.min("low").alias("class_id"))
    classes = known.join(lows, "component").join(links, "pic", "left").select("sha", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "readable")
    # written, so that the join has plain shuffles on both sides and the rows of a popular picture can be split
    found = rows.join(materialize(classes, "classes"), "sha", "left")
    return found.select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "readable")


def vector_images(vectors: DataFrame) -> DataFrame:
    """(id, image): each vector v as a PGM of len(v) x len(v) pixels, the smoothed texture of v[i] * v[j]; null for a null or empty vector.

    The given tables have no column of images; this one is derived from `embeddings`. Null and non-finite components count as 0.
    """

    @F.pandas_udf("binary")
    def picture(column: pd.Series) -> pd.Series:
        def one(v) -> bytes | None:
            if v is None or not len(v):
                return None
            x = np.nan_to_num(np.asarray([np.nan if c is None else c for c in v], float), nan=0.0, posinf=0.0, neginf=0.0)
            x = x / (np.sqrt(np.mean(x * x)) or 1)
            grey = np.rint(128 + 50 * _box(np.outer(x, x)[None], 1)[0]).clip(0, 255).astype(np.uint8)
            return b"P5 %d %d 255\n" % (len(x), len(x)) + grey.tobytes()

        return column.map(one)

    return vectors.select(F.col("vec_id").cast("long").alias("id"), picture("embedding").alias("image"))


def op5_image_copies(spark, sf_dir: str) -> DataFrame:
    """Class and links of the picture of every row of `embeddings`."""
    images = vector_images(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return image_classes(images).withColumnRenamed("id", "vec_id")
