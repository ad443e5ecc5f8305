"""SimHash near-duplicates through an inverted index over the fingerprints' positional bytes.

Two 64-bit fingerprints within 4 bits of each other differ in at most 4 of their 8 bytes, so they share at
least 4 positional bytes. Posting lists of single bytes would hold 1/256 of the corpus each; the index is keyed by
three positional bytes instead. Twenty triples (Turan's system for 8, 4, 3) are enough: any four positions
contain at least one of them, so no pair that reaches the minimum of four shared bytes is missed. Pairs that meet
in a list have their shared bytes tallied, those below four are dropped, and the rest are verified bit by bit.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed
from .components import connected_components

MAX_BITS = 4
#: Rows of one posting list that are compared in one task; longer lists are cut into blocks of this size.
LIST_BLOCK = 8192
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def byte_triples() -> list[tuple[int, ...]]:
    """Twenty triples of the positions 0..7 such that any four positions contain one of them."""
    out = [g for g in _GROUPS if len(g) == 3]
    for i, g in enumerate(_GROUPS):
        out += [(a, b, c) for a, b in itertools.combinations(g, 2) for c in _GROUPS[(i + 1) % 3]]
    return out


def fingerprint(text: str | None, shingle: int = 4, block: int = 1 << 16) -> int:
    """Bit majority of the XXH64 (seed 42) of all word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n], ends[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, block):
        a, b = first[at : at + block].tolist(), last[at : at + block].tolist()
        h = np.fromiter((digest(whole[i:j], 42) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, **keys: F.Column) -> DataFrame:
    """(doc_id, fp) and the given `keys` (longs): one row a document; fp holds the 64 bits as a long. Null text counts as empty."""
    names = ["doc_id", *keys, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            fp = np.fromiter((fingerprint(texts[i].as_py(), shingle) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names[:-1]] + [pa.array(fp.view(np.int64))], names=names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[v.alias(k) for k, v in keys.items()], F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """The pairs that join two trees of `parent`, which is updated."""

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            kept.append((x, y))
    return kept


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Where a and b share at least 8 - max_bits positional bytes and, of those, differ in max_bits bits at most."""
    diff = a ^ b
    shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    ok = shared >= 8 - max_bits
    ok[ok] = np.bitwise_count(diff[ok]) <= max_bits
    return ok


def _links_of_list(fp: np.ndarray, side: np.ndarray, parent: dict[int, int], max_bits: int) -> list[tuple[int, int]]:
    """Spanning pairs of one long posting list (or of two blocks of it), breadth first: what is reached is not compared again."""
    left, out = np.arange(len(fp)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            i, front = front[0], front[1:]
            hit = _near(np.full(len(left), fp[i]), fp[left], max_bits)
            new = left[hit]
            out += _forest(np.full(len(new), fp[i]).view(np.int64), fp[new].view(np.int64), parent)
            left, front = left[~hit], np.concatenate([front, new])
    return out


def linked(fps: DataFrame, max_bits: int = MAX_BITS, list_block: int = LIST_BLOCK) -> DataFrame:
    """(src, dst): links between distinct fingerprints that keep every group of near ones connected.

    Each fingerprint enters twenty posting lists. Lists longer than `list_block` are cut into blocks and every
    pair of blocks is compared in a task of its own. A task hands on a spanning forest of the links it verifies,
    at most one row a fingerprint, never all pairs.
    """
    byte = lambda i: F.shiftrightunsigned("fp", 56 - 8 * i).bitwiseAND(F.lit(255))
    keys = [sum((byte(p) * (1 << 8 * (2 - k)) for k, p in enumerate(t)), F.lit(n << 24).cast("long")) for n, t in enumerate(byte_triples())]
    posted = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    long_lists = posted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > list_block).select("key", F.ceil(F.col("n") / list_block).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), blocks).cast("long")
    cells = F.transform(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long")), lambda y: F.least(own, y) * 65536 + F.greatest(own, y))
    dealt = posted.join(long_lists, "key", "left").select("fp", "key", F.explode(cells).alias("cell"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        k0 = c0 = f0 = None
        out: list[tuple[int, int]] = []

        def flush(key: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> None:
            cut = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            start = np.concatenate([[0], cut])
            size = np.diff(np.append(start, len(key)))
            for s, n in zip(start[size > 64], size[size > 64], strict=True):
                out.extend(_links_of_list(fp[s : s + n], cell[s : s + n], parent, max_bits))
            own_size = np.repeat(np.where(size > 64, 1, size), size)
            place = np.arange(len(key)) - np.repeat(start, size)
            for gap in range(1, int(own_size.max(initial=1))):
                i = np.flatnonzero(place + gap < own_size)
                hit = _near(fp[i], fp[i + gap], max_bits)
                i = i[hit]
                out.extend(_forest(fp[i].view(np.int64), fp[i + gap].view(np.int64), parent))

        for b in itertools.chain(batches, [None]):
            if b is not None:
                k, c, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                if k0 is not None:
                    k, c, f = np.concatenate([k0, k]), np.concatenate([c0, c]), np.concatenate([f0, f])
                if not len(k):
                    continue
                tail = np.flatnonzero((k != k[-1]) | (c != c[-1]))
                keep = tail[-1] + 1 if len(tail) else 0  # the last list may go on in the next batch
                k0, c0, f0 = k[keep:], c[keep:], f[keep:]
                k, c, f = k[:keep], c[:keep], f[:keep]
            elif k0 is None:
                continue
            else:
                k, c, f = k0, c0, f0
            if len(k):
                flush(k, c, f.view(np.uint64))
            if len(parent) > 500_000:
                parent.clear()  # only repeats some links
            if out:
                s, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(d, pa.int64())], names=["src", "dst"])
                out.clear()

    return dealt.select("key", "cell", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(compare, "src long, dst long")


def _members(fp: DataFrame, low: F.Column, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, low, component): each distinct fingerprint with the aggregate `low` of its rows; component is the smallest fingerprint it reaches."""
    distinct = materialize(fp.groupBy("fp").agg(low.alias("low")), "fp")
    nodes = connected_components(linked(distinct.select("fp"), max_bits)).select(F.col("node").alias("fp"), "component")
    return distinct.join(nodes, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row a document.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable over fingerprints that
    differ in at most `max_bits` (4 or fewer) bits, itself included. Null and blank texts have fingerprint zero and are
    linked like any other; a null id takes part but never names a component unless all of it is null; repeated
    rows stay; an empty table gives an empty result.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the index guarantees at most 4 differing bits")
    fp = materialize(fingerprints(docs, id_col, text_col, shingle), "fp")
    named = _members(fp, F.min("doc_id"), max_bits)
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "component").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Of each near-duplicate group of rows the one with the smallest id; columns as given.

    Rows without an id come after all others, and of rows that share an id the one with the smallest hash comes first, so every group
    keeps one row. Rows that share an id but are in different groups are different documents. Rows are known by their
    id, a hash of the text and one of all columns; of equal rows one stays.
    """
    keys = {"_text": F.xxhash64("text"), "_hash": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])}
    fp = materialize(fingerprints(docs, **keys), "fp")
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_text"))
    known = F.coalesce(F.col("_keep.doc_id"), F.lit(0).cast("long")).alias("_id")
    keep = _members(fp, lowest).groupBy("component").agg(F.min("low").alias("_keep")).select(known, "_keep._text", "_keep._hash")
    rows = packed(docs, _id=F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), **keys)
    # of equal rows each task hands on one, so that very many don't meet
    return rows.dropDuplicates(["_id", *keys]).join(keep, ["_id", *keys], "left_semi").select("_row.*")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
