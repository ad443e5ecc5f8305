"""Documents that share most of their word shingles, found with a count-vector R-tree.

A document is the set of its distinct shingles' hashes. The hashes fall into GROUPS ranges or, in large sets, more, and the numbers of
hashes by range are the document's point; two sets can't share more than the sum of their points' smaller coordinates. Points are packed into trees whose nodes
keep the largest coordinates below them, so the same sum bounds what any point of a node can share; a search goes from 32 coarse
coordinates to all, and only pairs that may still reach the threshold have their sets compared.

One tree over all points would have to be searched by all of them: hashed counts lie close together, and boxes far up prune nothing but
sizes. Points therefore meet in lists first. With the hashes in one order for all, two sets that link share one of the first
n - ceil(0.8 n) + 1 of either, so each such hash has a list of its documents, and no linked pair is missed. The order ascends, but for
hashes that a sample finds in very many documents (lines that sites repeat), which come last: their lists, which would grow with the
table and be searched by its square, are then only of documents that hold little else. Any order is exact; the sample only picks one. Lists with the same
smallest document are one group, a group has a tree, and groups beyond TREE_ROWS are cut into blocks that meet pairwise. What the trees
leave possible falls into classes, and the sets of a class are compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

SHINGLE, PERCENT = 5, 80
#: Coordinates of a point at least, of the coarse one that nodes keep, and the binary logarithm of the most that a large set's point has.
GROUPS, COARSE, MOST_GROUP_BITS = 256, 32, 16
#: Children of a node.
FAN = 16
#: Points of a block of a tree, and hashes of the sets of a block whose pairs are verified.
TREE_ROWS, SET_HASHES = 4096, 1 << 22
#: Documents of the sample that common shingles are learnt from, documents that make a shingle common, and those of the sample at least.
SAMPLE, COMMON, LEAST = 10_000, 512, 8
#: Bits at most of the bitmap that says which texts are read again.
MOST_BITS = 1 << 26
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of all runs of `shingle` words, ascending; of the whole text if it has fewer, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(w))
    n = len(w) - size + 1
    x = np.full(n, size, np.uint64)
    for i in range(size):
        x = x * _BASE + w[i : i + n]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return np.unique(x ^ (x >> np.uint64(31)))


def point_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes fall into each of so many equal ranges that about four share one; GROUPS at least."""
    bits = min(MOST_GROUP_BITS, max(GROUPS.bit_length() - 1, (len(hashes) // 4).bit_length()))
    return np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)


def folded(counts: np.ndarray, width: int) -> np.ndarray:
    """Points (the last axis) with neighbouring ranges joined until there are `width`."""
    return counts if counts.shape[-1] == width else counts.reshape(*counts.shape[:-1], width, -1).sum(-1, dtype=np.uint32)


def _packed_point(counts: np.ndarray) -> bytes:
    top = int(counts.max(initial=0))
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def _unpacked_point(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, f"<u{cell[0]}", offset=1)


class CountTree:
    """Points of sets of n hashes, packed by splitting them at the median of the coordinate with the largest spread.

    `found(i)` gives the places of all points whose overlap with point i may reach `percent` of the union.
    """

    def __init__(self, n: np.ndarray, counts: Sequence[np.ndarray], percent: int = PERCENT):
        self.n, self.percent = n.astype(np.int64), percent
        widths = np.fromiter(map(len, counts), np.int64, len(counts))
        self.row = np.zeros(len(counts), np.int64)  # of the matrix of its width
        self.width, self.whole = widths, {}
        for w in np.unique(widths).tolist():
            own = np.flatnonzero(widths == w)
            self.row[own], self.whole[w] = np.arange(len(own)), np.stack([counts[i] for i in own.tolist()])
        self.counts = np.zeros((len(counts), GROUPS), np.uint32)
        for w, m in self.whole.items():
            self.counts[widths == w] = folded(m, GROUPS)
        self.coarse = folded(self.counts, COARSE)
        self.order = self._packed(np.column_stack([self.n, self.coarse.astype(np.int64)]))
        self.levels = []  # from the leaves up: largest coarse coordinates, smallest and largest n of each node
        top, low, high = self.coarse[self.order], self.n[self.order], self.n[self.order]
        while len(low) > FAN:
            first = np.arange(0, len(low), FAN)
            top, low, high = np.maximum.reduceat(top, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            self.levels.append((top, low, high))

    def _packed(self, points: np.ndarray) -> np.ndarray:
        out, todo = [], [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= FAN:
                out.append(own)
                continue
            x = points[own]
            middle = max(FAN, (len(own) // 2) // FAN * FAN)  # whole leaves on the left
            half = np.argpartition(x[:, x.var(0).argmax()], middle)
            todo += [own[half[middle:]], own[half[:middle]]]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _may(self, i: int, shared: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where sets of `low` to `high` hashes that share so many at most with i may link to it."""
        n, p = self.n[i], self.percent
        return (p * n <= 100 * high) & (p * low <= 100 * n) & ((100 + p) * shared.astype(np.int64) >= p * (n + low))

    def found(self, i: int) -> np.ndarray:
        at = np.arange(len(self.levels[-1][1]) if self.levels else len(self.order))
        for k in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[k]
            at = at[self._may(i, np.minimum(top[at], self.coarse[i]).sum(1), low[at], high[at])]
            at = (at[:, None] * FAN + np.arange(FAN)).ravel()
            at = at[at < (len(self.levels[k - 1][1]) if k else len(self.order))]
        return self.checked(i, self.order[at])

    def checked(self, i: int, places: np.ndarray) -> np.ndarray:
        """Those of `places` that may link to i, by coarse, then GROUPS, then all coordinates that both have; not i itself."""
        for counts in (self.coarse, self.counts):
            places = places[self._may(i, np.minimum(counts[places], counts[i]).sum(1), self.n[places], self.n[places])]
        own = int(self.width[i])
        mine, out = self.whole[own][self.row[i]], []
        for w in np.unique(self.width[places]).tolist():
            part = places[self.width[places] == w]
            if min(w, own) > GROUPS:
                width = min(w, own)
                shared = np.minimum(folded(self.whole[w][self.row[part]], width), folded(mine, width)).sum(1, dtype=np.int64)
                part = part[self._may(i, shared, self.n[part], self.n[part])]
            out.append(part)
        places = np.concatenate(out) if out else places
        return places[places != i]


class Forest:
    """Classes of names that links join; names are forgotten when they become too many, which only repeats some links."""

    def __init__(self, most: int = 500_000):
        self.up, self.most = {}, most

    def root(self, x: int) -> int:
        up = self.up
        while (to := up.setdefault(x, x)) != x:
            up[x] = up[to]
            x = to
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        x, y = self.root(x), self.root(y)
        self.up[y] = x
        return x != y

    def trim(self) -> None:
        if len(self.up) > self.most:
            self.up.clear()


def possible_links(ids: np.ndarray, n: np.ndarray, counts: Sequence[np.ndarray], percent: int = PERCENT, forest: Forest | None = None) -> list[tuple[int, int]]:
    """Pairs that the points leave possible, as many as keep all of those connected; fewer where `forest` connects them already."""
    tree, names, forest = CountTree(n, counts, percent), ids.tolist(), forest or Forest()
    return [(names[i], names[j]) for i in range(len(n)) for j in tree.found(i).tolist() if forest.join(names[i], names[j])]


def links_within(ids: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, forest: Forest | None = None) -> list[tuple[int, int]]:
    """Links between the sets that keep every class of linked ones connected; fewer where `forest` connects some already."""
    forest = forest or Forest()
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    tree = CountTree(n, [point_of(s) for s in sets], percent)
    names, out = ids.tolist(), []
    left = np.ones(len(n), bool)
    for first in range(len(n)):  # breadth first: what is reached is not compared again
        front = [first] if left[first] else []
        left[first] = False
        while front:
            i = front.pop()
            others = tree.found(i)
            others = others[left[others]]
            if not len(others):
                continue
            mine = forest.root(names[i])
            known = np.array([forest.root(names[j]) == mine for j in others.tolist()])
            new = others[~known]
            if len(new):
                joined, begin = np.concatenate([sets[j] for j in new.tolist()]), np.cumsum(n[new]) - n[new]
                place = np.minimum(np.searchsorted(sets[i], joined), n[i] - 1)
                shared = np.add.reduceat((sets[i][place] == joined).astype(np.int64), begin)
                new = new[(100 + percent) * shared >= percent * (n[i] + n[new])]
            out += [(names[i], names[j]) for j in new.tolist() if forest.join(names[i], names[j])]
            reached = np.append(others[known], new)
            left[reached] = False
            front += reached.tolist()
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with equal first two columns, which are longs; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), len(b)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            key = (x[a], y[a])
            if held and key != last:
                yield pa.concat_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = key
    if held:
        yield pa.concat_batches(held)


def _in_cells(groups: DataFrame, weight: str, most: int) -> DataFrame:
    """`groups` (leader, ...) with `cell`: a leader's rows are cut into blocks of `most` by the sum of `weight`, and every two blocks meet in a cell."""
    large = groups.groupBy("leader").agg(F.sum(weight).alias("_sum")).where(F.col("_sum") > most).select("leader", F.ceil(F.col("_sum") / most).cast("long").alias("_blocks"))
    own, blocks = F.pmod(F.xxhash64("rid"), F.coalesce("_blocks", F.lit(1))), F.coalesce("_blocks", F.lit(1).cast("long"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda y: F.least(own, y) * (1 << 31) + F.greatest(own, y))
    return groups.join(large, "leader", "left").withColumn("cell", F.explode(cells)).drop("_blocks")


def front_of(hashes: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first n - ceil(percent n / 100) + 1 of a set's hashes, ascending but with those in `common` (ascending) last; none of an empty set."""
    n = len(hashes)
    if n and len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: n - (percent * n + 99) // 100 + 1] if n else hashes


def common_shingles(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes, ascending, of the shingles that COMMON documents or more are likely to hold, by about SAMPLE of them; what it misses or adds costs time, no link."""
    rows = docs.count()
    every = max(1, rows // SAMPLE)
    if rows < COMMON:
        return np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(run, "h long")
    found = drawn.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= max(LEAST, COMMON // every)).select("h").toArrow()  # 8 bytes a hash, at most one for LEAST of the sample's
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def described(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(rid, doc_id, r1, r2, n, k1, k2, point, front): a written row for each of (doc_id, text).

    r1, r2: 96 bits that name the row, k1, k2: 128 that name the set; point: its counts; front: its first hashes, of which linked sets share one.
    """
    common = common_shingles(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, keys, points, fronts = b.column("text"), [], [], [], []
            for i in range(len(texts)):
                s = shingle_set(texts[i].as_py(), shingle)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                points.append(_packed_point(point_of(s)))
                fronts.append(front_of(s, common, percent).view(np.int64))
            k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(f) for f in fronts])]).astype(np.int32)
            front = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*fronts, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "r1", "r2")), pa.array(n, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(points, pa.binary()), front],
                names=["doc_id", "r1", "r2", "n", "k1", "k2", "point", "front"],
            )

    out = docs.select("doc_id", *_row_keys(), "text").mapInArrow(run, "doc_id long, r1 long, r2 int, n long, k1 long, k2 long, point binary, front array<long>")
    return materialize(out.withColumn("rid", F.monotonically_increasing_id()), "sets")


def groups_of(sets: DataFrame) -> DataFrame:
    """(leader, rid): all documents of the lists that have the same smallest document; every pair that may link is in one group."""
    posted = sets.select("rid", F.explode("front").alias("h"))
    shared = posted.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    shared = materialize(posted.join(shared, "h", "left_semi"), "lists")
    leaders = shared.groupBy("h").agg(F.min("rid").alias("leader"))
    return materialize(shared.join(leaders, "h").select("leader", "rid").distinct(), "groups")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    src, dst = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def candidate_links(groups: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(src, dst): within each of `groups`, links that the points leave possible; enough to keep all of those connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for g in _runs(batches):
            if len(g) > 1:
                points = [_unpacked_point(x) for x in g.column("point").to_pylist()]
                if found := possible_links(g.column("rid").to_numpy(), g.column("n").to_numpy(), points, percent, forest):
                    yield _edges(found)
                forest.trim()

    cells = _in_cells(groups.withColumn("_one", F.lit(1)), "_one", TREE_ROWS).select("leader", "cell", "rid")
    rows = cells.join(sets.select("rid", "n", "point"), "rid").select("leader", "cell", "rid", "n", "point")
    return rows.repartition("leader", "cell").sortWithinPartitions("leader", "cell").mapInArrow(run, "src long, dst long")


def _row_keys() -> list:
    """96 bits that name a row of (doc_id, text)."""
    return [F.xxhash64("doc_id", "text").alias("r1"), F.hash("text", "doc_id").alias("r2")]


def wanted_rows(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(r1, r2, text) of the rows of `docs` (doc_id, text) that may be among `names` (r1, r2), a few others among them.

    A bitmap of the wanted keys' hashes, MOST_BITS at most whatever their number, keeps the other texts out of the shuffle that finds
    the wanted ones exactly; the fuller it is, the more texts are shuffled for nothing. Repeats of a row in a task go too.
    """
    bits = min(MOST_BITS, 1 << max(16, (16 * names.count()).bit_length()))
    at = F.pmod("r1", F.lit(bits))
    words = names.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            place = b.column("r1").to_numpy() % bits  # as pmod: not negative
            hit = np.flatnonzero(bitmap[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1))
            new = []
            for i, key in zip(hit.tolist(), zip(*(b.column(c).take(pa.array(hit)).to_pylist() for c in ("r1", "r2")), strict=True), strict=True):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            if new:
                yield b.take(pa.array(new))
            if len(seen) > 500_000:
                seen.clear()

    return docs.select(*_row_keys(), "text").mapInArrow(pick, "r1 long, r2 int, text string")


def verified_links(classes: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(src, dst): links between the documents of each of `classes` (leader, rid), by their sets; enough to keep what links connected.

    A document is in one class, so its set is made and shipped once, unless the class is cut into blocks.
    """

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [shingle_set(t.as_py(), shingle).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("leader", "cell", "rid")), pa.array(cells, pa.binary())], names=["leader", "cell", "rid", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for g in _runs(batches):
            if len(g) > 1:
                found = links_within(g.column("rid").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column("hashes")], percent, forest)
                if found:
                    yield _edges(found)
                forest.trim()

    names = materialize(classes.join(sets.select("rid", "n", "r1", "r2"), "rid"), "wanted")
    placed = _in_cells(names, "n", SET_HASHES).select("leader", "cell", "rid", "r1", "r2")
    texts = wanted_rows(docs, names).join(placed, ["r1", "r2"]).select("leader", "cell", "rid", "text")
    hashes = texts.mapInArrow(again, "leader long, cell long, rid long, hashes binary")
    return hashes.repartition("leader", "cell").sortWithinPartitions("leader", "cell").mapInArrow(compare, "src long, dst long")


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row a row of `docs` (doc_id, text).

    Documents link where 100 times the shingles they share reach `percent` times those that either has. component_id: the smallest
    doc_id that links reach, its own included. Null, empty and blank texts have no shingles and link with nothing; fewer words than a
    shingle are one shingle. A null id takes part but names a component only if all of it is null; repeated rows stay, and copies
    are one node; long texts are whole sets; an empty table gives an empty result; other columns take no part. Sets hold 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = described(docs, shingle, percent)
    some = sets.where("n > 0")
    classes = materialize(some.groupBy("k1", "k2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("low"), F.count("*").alias("copies")), "classes")
    repeats = some.select("rid", "k1", "k2").join(classes.where("copies > 1"), ["k1", "k2"]).where("rid <> node").select("rid")
    nodes = some.join(materialize(repeats, "repeats"), "rid", "left_anti")  # one row a class
    close = connected_components(candidate_links(groups_of(nodes), sets, percent)).select(F.col("component").alias("leader"), F.col("node").alias("rid"))
    found = connected_components(verified_links(close, sets, docs, shingle, percent)).withColumnRenamed("component", "root")
    named = materialize(classes.join(found, "node", "left").select("k1", "k2", "low", F.coalesce("root", "node").alias("root")), "named")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "root").select("k1", "k2", "component_id")
    linked = some.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def op12_jaccard(spark, sf_dir: str) -> DataFrame:
    """Shingles and Jaccard component of every document."""
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""
