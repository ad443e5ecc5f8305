"""Line dedup by winnowing over line hashes.

A text is cut into lines: at newlines and, as long lines hold many sentences, also after sentence ends,
before capital letters and, in long stretches without these, at spaces chosen by their neighbours. A gram is the shortest run of lines from a given line on with GRAM_WORDS words; in every
shortest run with RUN_WORDS words the gram with the smallest hash is selected, so any run of RUN_WORDS words that two
texts share (on line borders) has a selected gram in common. Occurrences of a selected gram join the earliest one, each
match is extended both ways while the lines agree, and runs that occurred earlier are deleted. As the earliest text
with a popular gram may share no more than the gram, its occurrences also join the earliest one of each whole run that selected it.

Grams, whole lines and texts are known by 96 bits of two independent hashes, a line beside an anchor by 64.

What stands between two newlines is a window of its own: a whole line of LINE_CHARS characters, and a whole text shorter than
RUN_WORDS words, is selected as it is and deleted wherever it occurred earlier.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, dealt_join, materialize, packed, running_totals

#: Words of a gram, and of the runs whose repetition is guaranteed to be found.
GRAM_WORDS, RUN_WORDS = 20, 40
#: Characters from which a line between two newlines is deleted on its own; those of scripts without spaces count as three.
LINE_CHARS = 24
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x2FFFF))
_BASE = 0x9E3779B97F4A7C15
#: Words without a border on either side of a space from which it may be one, and one of how many such spaces is.
CUT_WORDS, CUT_EVERY = 16, 8
# The ideographic full stop, exclamation and question marks.
IDEOGRAPHIC_STOPS = (0x3002, 0xFF01, 0xFF1F)
#: Bits of a line's number in a place; texts with more lines raise an error.
PLACE_BITS = 25
#: Rows of which a task remembers the keys, to leave out repeats before the shuffle; it starts anew beyond that, and the rest goes after the shuffle.
SEEN = 1_000_000
_DETAIL = "key long, hashes array<long>, words array<int>, grams array<struct<h:long,h2:int,p:int,e:int>>"


def line_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every line; one separator character lies between two of them."""
    starts, lens = _starts(text)
    return list(zip(starts[:-1].tolist(), (starts[:-1] + lens).tolist(), strict=True))


def _points(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _cuts(points: np.ndarray) -> np.ndarray:
    """Where lines end: at white-space characters that are newlines, follow a sentence end or precede a capital letter, and at ideographic sentence ends.

    Where none of these lies within CUT_WORDS words on either side, also at spaces that the characters beside them choose, so that
    long stretches without borders have some, the same ones in every text.
    """
    space = np.flatnonzero((points == 32) | (points == 9) | (points == 10))
    before, after = points[np.maximum(space - 1, 0)], points[np.minimum(space + 1, len(points) - 1)]
    stop = (space > 0) & ((before == ord(".")) | (before == ord("!")) | (before == ord("?")))
    capital = (after >= ord("A")) & (after <= ord("Z")) | (after >= 0xC0) & (after <= 0xDE) & (after != 0xD7)
    border = stop | capital & (space + 1 < len(points)) | (points[space] == 10)
    upto = np.concatenate([[0], np.cumsum(border)])
    place = np.arange(len(space))
    far = (place >= CUT_WORDS) & (place + CUT_WORDS < len(space)) & (upto[np.minimum(place + CUT_WORDS + 1, len(space))] == upto[np.maximum(place - CUT_WORDS, 0)])
    far = np.flatnonzero(far)
    beside = np.zeros(len(far), np.uint64)
    for gap in (-4, -3, -2, -1, 1, 2, 3, 4):
        beside = (beside + points[space[far] + gap].astype(np.uint64)) * np.uint64(_BASE)
    border[far[(beside >> np.uint64(40)) % np.uint64(CUT_EVERY) == 0]] = True
    cuts = space[border]
    if points.max(initial=0) >= IDEOGRAPHIC_STOPS[0]:
        cuts = np.sort(np.append(cuts, np.flatnonzero(np.isin(points, IDEOGRAPHIC_STOPS))))
    return cuts


def _starts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where every line starts (and one entry for the end of the text and a separator), and the lines' lengths."""
    ends = np.append(_cuts(_points(text)), len(text))
    starts = np.concatenate([[0], ends + 1])
    return starts, ends - starts[:-1]


def _wide(points: np.ndarray) -> np.ndarray:
    """Which code points are of scripts without spaces."""
    out = np.zeros(len(points), bool)
    if points.max(initial=0) >= _UNSPACED[0][0]:
        for a, b in _UNSPACED:
            out |= (points >= a) & (points <= b)
    return out


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a and b, sorted."""
    top = int(b.max(initial=0)) + 1
    both = np.unique(a * top + b)
    return both // top, both % top


class Lines:
    """The lines of several texts one after another: hashes, word counts, and where each text's lines begin.

    A hash of a stretch of lines is a polynomial of theirs modulo 2^64, mixed with its length; prefix sums give that of any stretch.
    """

    def __init__(self, hashes: np.ndarray, words: np.ndarray, begin: np.ndarray):
        self.hashes, self.words, self.begin = hashes.view(np.uint64), words.astype(np.int64), begin
        n = len(hashes)
        self.text_end = np.repeat(begin[1:], np.diff(begin))
        self.total = np.concatenate([[0], np.cumsum(self.words)])
        step = lambda base: np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base, np.uint64)))
        power, self.back = step(_BASE), step(pow(_BASE, -1, 1 << 64))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * power[:n], dtype=np.uint64)])

    @classmethod
    def of_texts(cls, texts: list[str]) -> tuple[Lines, Lines, np.ndarray, np.ndarray]:
        """The lines, the same with independent hashes, and from and to which line each stretch goes that counts on its own: a long enough line between newlines, or a short text."""
        joined = "\n".join(texts)
        points = _points(joined)
        ends = np.append(_cuts(points), len(points))  # where the separator after each line stands
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        lines = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        try:
            hashes = np.fromiter(map(digest, lines), np.uint64, len(lines))
        except UnicodeEncodeError:  # lone surrogates
            lines = [x.encode("utf-8", "surrogatepass") for x in lines]
            hashes = np.fromiter(map(digest, lines), np.uint64, len(lines))
        again = np.fromiter(map(digest, lines, repeat(1)), np.uint64, len(lines))
        spaces, unspaced = np.flatnonzero(points == 32), np.flatnonzero(_wide(points))
        inside = lambda places, a, b: np.searchsorted(places, b) - np.searchsorted(places, a)
        words = np.where(ends > starts, inside(spaces, starts, ends) + 1 + inside(unspaced, starts, ends) // 2, 0)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        begin = np.concatenate([[0], np.searchsorted(ends, text_ends) + 1])

        def long_enough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            extra = 2 * inside(unspaced, a, b)
            ok = b - a + extra >= LINE_CHARS
            for i in np.flatnonzero(ok).tolist():
                ok[i] = len(joined[a[i] : b[i]].strip()) + extra[i] >= LINE_CHARS
            return ok

        out = cls(hashes, words, begin)
        b = np.append(np.flatnonzero(points == 10), len(points))
        a = np.concatenate([[0], b[:-1] + 1])
        whole = long_enough(a, b)
        first, last = np.searchsorted(ends, a - 1) + (a > 0), np.searchsorted(ends, b) + 1
        amount = out.total[begin[1:]] - out.total[begin[:-1]]
        short = (amount > 0) & (amount < RUN_WORDS) & long_enough(text_ends - np.diff(text_ends, prepend=-1) + 1, text_ends)
        return out, cls(again, words, begin), *_distinct(np.append(first[whole], begin[:-1][short]), np.append(last[whole], begin[1:][short]))

    def hash_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash (signed) of the lines from each a up to each b."""
        x = (self.prefix[b] - self.prefix[a]) * self.back[a] + (b - a).astype(np.uint64) * np.uint64(_BASE)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return (x ^ (x >> np.uint64(31))).view(np.int64)

    def winnow(self, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, place, hash) of every shortest run of `run_words` words and of the gram selected in it: the smallest, rightmost of equals."""
        n = len(self.hashes)
        ahead = lambda least: np.searchsorted(self.total, self.total[:n] + least)
        run, gram = ahead(run_words), ahead(gram_words)
        at = np.flatnonzero((run <= self.text_end) & (self.words > 0))
        if not len(at):
            return at, at, at, at
        last = np.searchsorted(gram, run[at], "right") - 1  # the last gram that ends within the run
        value = self.hash_of(np.arange(n), np.minimum(gram, n))
        better = lambda i, j: np.where(value[j] <= value[i], j, i)  # noqa: E731, the right one of equals
        level = np.log2(last - at + 1).astype(np.int64)
        best = np.zeros(len(at), np.int64)
        table = np.arange(n)
        for k in range(int(level.max()) + 1):
            mine = np.flatnonzero(level == k)
            best[mine] = better(table[at[mine]], table[last[mine] - (1 << k) + 1])
            table = better(table[: max(0, len(table) - (1 << k))], table[1 << k :])
        return at, run[at], best, value[best]

    def runs_around(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place of the gram) of every run that selected a gram where `chosen` is true: the shortest from each line on, and up to each line.

        Of any run of RUN_WORDS words, these cover every line.
        """
        begin, end, place, _ = self.winnow()
        if not len(begin):
            return begin, begin
        of = np.full(len(self.hashes) + 1, -1)
        of[begin] = place
        till = np.flatnonzero(self.words) + 1
        start = np.searchsorted(self.total, self.total[till] - RUN_WORDS, "right") - 1
        text_begin = np.repeat(self.begin[:-1], np.diff(self.begin))
        ok = (start >= text_begin[till - 1]) & (self.total[till] >= RUN_WORDS)
        till, start = till[ok], start[ok]
        a, b = np.append(begin, start), np.append(end, till)
        keep = (of[a] >= 0) & chosen[of[a]]
        a, b = _distinct(a[keep], b[keep])
        return self.hash_of(a, b), of[a]


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without the repeats of rows of one task: of very many equal rows only one a task (and SEEN rows) is shuffled."""
    seen: set[int] = set()
    for b in batches:
        new = []
        for i, key in enumerate(b.column(0).to_pylist()):
            if key not in seen:
                seen.add(key)
                new.append(i)
        yield b if len(new) == len(b) else b.take(pa.array(new, pa.int64()))
        if len(seen) > SEEN:
            seen.clear()


def _details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in _unseen(batches):
        for at in range(0, len(whole), 500):
            b = whole.slice(at, 500)
            lines, other, first, end = Lines.of_texts([x or "" for x in b.column(1).to_pylist()])
            size = np.diff(lines.begin)
            if size.max(initial=0) >> PLACE_BITS:
                raise ValueError(f"a text of more than {1 << PLACE_BITS} lines")
            place = np.unique(lines.winnow()[2])
            p, till = np.append(place, first), np.append(np.searchsorted(lines.total, lines.total[place] + GRAM_WORDS), end)
            h, h2, e = lines.hash_of(p, till), other.hash_of(p, till) >> 32, np.append(np.zeros(len(place), np.int64), end)
            owner = np.searchsorted(lines.begin, p, "right") - 1
            order = np.argsort(owner, kind="stable")
            h, h2, p, e, owner = h[order], h2[order], p[order], e[order], owner[order]
            p, e = p - lines.begin[owner], np.where(e > 0, e - lines.begin[owner], 0)
            gram = pa.StructArray.from_arrays([pa.array(h, pa.int64()), pa.array(h2.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32))], ["h", "h2", "p", "e"])
            columns = [_lists(size, pa.array(lines.hashes.view(np.int64))), _lists(size, pa.array(lines.words.astype(np.int32))), _lists(np.bincount(owner, minlength=len(b)), gram)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["key", "hashes", "words", "grams"])


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _offsets(column: pa.ListArray) -> np.ndarray:
    at = column.offsets.to_numpy().astype(np.int64)
    return at - at[0]


def _run_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with popular grams at some places: the runs that selected these."""
    for whole in batches:
        for at in range(0, len(whole), 500):
            b = whole.slice(at, 500)
            lines = Lines(_flat(b.column(1)).astype(np.int64), _flat(b.column(2)), _offsets(b.column(1)))
            chosen = np.zeros(len(lines.hashes), bool)
            chosen[_flat(b.column(3)) + np.repeat(lines.begin[:-1], np.diff(_offsets(b.column(3))))] = True
            h, p = lines.runs_around(chosen)
            owner = np.searchsorted(lines.begin, p, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(h, pa.int64()), pa.array((p - lines.begin[owner]).astype(np.int32))], names=["no", "h", "p"])


def _later(places: DataFrame, name: str, keys: tuple[str, ...] = ("h",)) -> DataFrame:
    """(`places` and n, first): what stands at several places, as the hashes in `keys` say, without the earliest one; n places in all, the earliest is `first`.

    The table of earliest places is written, so that the join has plain shuffles on both sides and the rows of a popular hash can be split.
    """
    found = places.groupBy(*keys).agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    return places.join(materialize(found, name), [*keys]).drop(*keys)


def _text(place: str) -> F.Column:
    return F.shiftright(place, PLACE_BITS)


def _line(place: str) -> F.Column:
    return F.col(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _place(text: str, line: str) -> F.Column:
    return F.shiftleft(F.col(text), PLACE_BITS).bitwiseOR(F.col(line).cast("long"))


def extended(x: np.ndarray, y: np.ndarray, here: np.ndarray, there: np.ndarray) -> list[tuple[int, int]]:
    """The runs of x that anchors (a line of x beside one of y) grow to while the lines agree."""
    out: set[tuple[int, int]] = set()
    shift = here - there
    for d in np.unique(shift).tolist():
        low, high = max(0, d), min(len(x), len(y) + d)
        differ = np.concatenate([[low - 1], np.flatnonzero(x[low:high] != y[low - d : high - d]) + low, [high]])
        p = here[shift == d]
        k = np.searchsorted(differ, p)
        agree = differ[k] != p
        out.update(zip((differ[k[agree] - 1] + 1).tolist(), differ[k[agree]].tolist(), strict=True))
    return sorted(out)


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matched runs of one later text and one earlier one; inside one text only what lies further back counts as earlier."""
    for b in batches:
        no, earlier = b.column(0).to_pylist(), b.column(1).to_pylist()
        (mine, m_at), (theirs, t_at) = ((_flat(b.column(i)), _offsets(b.column(i)).tolist()) for i in (2, 3))
        pairs, p_at = b.column(4).flatten(), _offsets(b.column(4)).tolist()
        here_all, there_all = (pairs.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        keys, begins, ends = [], [], []
        for i, k in enumerate(no):
            here, there = here_all[p_at[i] : p_at[i + 1]], there_all[p_at[i] : p_at[i + 1]]
            if k == earlier[i]:
                here, there = here[here > there], there[here > there]
            found = extended(mine[m_at[i] : m_at[i + 1]], theirs[t_at[i] : t_at[i + 1]], here, there)
            keys += [k] * len(found)
            begins += [x for x, _ in found]
            ends += [x for _, x in found]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], names=["no", "begin", "end"])


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, runs): for each distinct (id, text) with repeated lines, as hash `key`, the line ranges to delete.

    The earlier occurrence is that of the smaller id (null first), within a text the earlier line. A line that is deleted
    stays at its earliest occurrence, as every match points to an earlier place.
    """
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") > 0)
    detail = materialize(rows.select("key", "text").mapInArrow(_details, _DETAIL), "lines")
    same = ["t1", "t2", "size"]  # what equal texts have in common
    texts = rows.select("key", "id", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), F.length(F.trim("text")).alias("size")).distinct().withColumn("one", F.lit(1))
    order = materialize(running_totals(texts, ["id", "key"], {"no": "one"}).select("key", "no", *same), "order")
    first = order.groupBy(*same).agg(F.min("no").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("size") >= LINE_CHARS))
    copies = materialize(order.join(materialize(first, "texts"), same).where("no > first").select("key"), "copies")
    # of repeated rows one is looked at; the join has put them side by side
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    known = detail.join(order.select("key", "no").join(copies, "key", "left_anti"), "key").withColumn("nth", nth).where("nth = 1")
    known = materialize(known.select("no", "hashes", "words", "grams"), "known", replaces=detail)
    place = known.select("no", F.explode("grams").alias("g")).select("g.h", "g.h2", _place("no", "g.p").alias("place"), "g.e")
    found = materialize(_later(place, "first", ("h", "h2")), "found")
    grams = found.where("e = 0")
    # of two places of a gram the earlier one is the partner of any run around it; of more, it may be another one for each run
    popular = grams.where("n > 2").groupBy(_text("place").alias("no")).agg(F.collect_set(_line("place")).alias("lines"))
    lines = known.select("no", "hashes", "words")
    wide = popular.join(lines, "no").select("no", "hashes", "words", "lines").mapInArrow(_run_hashes, "no long, h long, p int")
    wide = materialize(wide.select("h", _place("no", "p").alias("place")), "wide")
    anchors = grams.select("place", "first").union(_later(wide, "first_wide").select("place", "first")).where("place <> first")
    at = F.collect_set(F.struct(_line("place").alias("p"), _line("first").alias("p1"))).alias("pairs")
    pairs = materialize(anchors.groupBy(_text("place").alias("no"), _text("first").alias("earlier")).agg(at), "pairs")
    # an early text with a popular passage meets very many later ones: its lines are dealt over copies
    near = dealt_join(pairs, lines.select(F.col("no").alias("earlier"), F.col("hashes").alias("theirs")), "earlier", ["no"])
    reach = near.join(lines.select("no", F.col("hashes").alias("mine")), "no")
    runs = reach.select("no", "earlier", "mine", "theirs", "pairs").mapInArrow(_extend, "no long, begin int, end int")
    whole = found.where("e > 0 and place <> first").select(_text("place").alias("no"), _line("place").alias("begin"), F.col("e").alias("end"))
    cut = runs.union(whole).distinct().groupBy("no").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("runs"))
    all_of_it = F.array(F.struct(F.lit(0).alias("begin"), F.lit((1 << 31) - 1).alias("end")))
    return cut.join(order.select("key", "no"), "no").select("key", "runs").union(copies.select("key", all_of_it.alias("runs")))


def row_key(id_col: str, text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def cut_runs(text: str, runs: list[tuple[int, int]], starts: np.ndarray | None = None) -> tuple[str, int]:
    """`text` without the lines of `runs` (sorted) and the separators after them, and the number of lines deleted. starts: as _starts() gives them."""
    starts = _starts(text)[0] if starts is None else starts
    n = len(starts) - 1
    out, at, gone, last = [], 0, 0, False
    for a, b in runs:
        a, b = max(a, at), min(b, n)
        if a < b:
            out.append(text[starts[at] : starts[a]])
            at, gone, last = b, gone + b - a, b == n
    out.append(text[starts[at] :])
    kept = "".join(out)
    return (kept.rstrip(" \t\n") if last else kept), gone


def cut_texts(texts: list[str], runs: list[list[tuple[int, int]]]) -> list[tuple[str, int]]:
    """cut_runs() of many texts, whose lines are found together."""
    points = _points("\n".join(texts))
    ends = np.append(_cuts(points), len(points))
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_ends = np.cumsum(sizes + 1) - 1
    begin = np.concatenate([[0], np.searchsorted(ends, text_ends) + 1]).tolist()
    out = []
    for i, (text, own) in enumerate(zip(texts, runs, strict=True)):
        at = text_ends[i] - sizes[i]
        out.append(cut_runs(text, own, np.append(starts[begin[i] : begin[i + 1]] - at, sizes[i] + 1)))
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with `text_col` cut, and `_deleted`: the number of lines deleted from it.

    Null texts stay null, texts without repeated runs stay as they are, a text whose every line occurred earlier becomes empty; no
    row is dropped. Rows with equal id and text are one document and get the same text. Common lines shorter than LINE_CHARS
    characters stay, unless they are part of a repeated run. Of equal texts that of the smallest id stays, null before all; ties of rows with one
    id go by a hash of the text. Texts are cut whole, up to 2^PLACE_BITS lines; more raise an error. Other columns stay as they are,
    an empty table gives an empty result.
    """
    schema = docs.schema
    names = docs.columns
    at = names.index(text_col)
    runs = repeated_runs(docs, id_col, text_col).select("key", F.flatten(F.transform("runs", lambda r: F.array(r["begin"], r["end"]))).alias("runs"))
    joined = packed(docs, _key=row_key(id_col, text_col)).join(runs.withColumnRenamed("key", "_key"), "_key", "left")

    @F.pandas_udf("text string, n int")
    def cut(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out: list[tuple[str | None, int]] = [(None, 0)] * len(text)
        some = [i for i, (t, r) in enumerate(zip(text, runs, strict=True)) if r is not None and t is not None]
        for k in range(0, len(some), 500):
            part = some[k : k + 500]
            for i, x in zip(part, cut_texts([text.iat[i] for i in part], [runs.iat[i].reshape(-1, 2).tolist() for i in part]), strict=True):
                out[i] = x
        return pd.DataFrame(out, columns=["text", "n"])

    text = F.col("_row").getField(text_col)
    # the texts of rows without repeated runs stay in the JVM
    done = joined.withColumn("_new", cut(F.when(F.col("runs").isNotNull(), text), F.col("runs"))).select("_row", F.struct(F.coalesce("_new.text", text).alias("text"), F.col("_new.n").alias("n")).alias("_cut"))
    columns = [F.col("_cut.text").cast(schema[n].dataType).alias(n) if i == at else F.col("_row").getField(n).alias(n) for i, n in enumerate(names)]
    return done.select(*columns, F.col("_cut.n").alias("_deleted"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Documents with repeated runs cut from their texts; columns of documents, n_chars that of the new text (null for null)."""
    return deduplicated(docs).withColumn("n_chars", F.when(F.col("_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its repeated runs deleted: doc_id, text, n_deleted lines, n_chars left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "text", F.col("_deleted").cast("long").alias("n_deleted"), F.length("text").cast("long").alias("n_chars"))
