"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text answers "how far does the longest match go?"
in one step a character. A text is parsed greedily into the longest phrases that occur in the sample (a symbol that the sample lacks is a phrase of
its own); the language that needs the fewest phrases a character wins.

Whole texts are parsed, in segments of SEGMENT characters that advance together. Each segment is parsed on its own first; then the
phrase that its predecessor left open runs on into it until it ends where one of the segment's own phrases begins, from where both parses are the same. So the
counts are those of a parse from the first character to the last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed

SEGMENT = 256
#: Up to how many segments are followed one by one: array steps cost more for them.
FEW = 24
#: Bounds of the training sample: documents a language, characters of each, characters a language.
SAMPLE_DOCS, SAMPLE_DOC_CHARS, SAMPLE_CHARS = 48, 4000, 40_000
#: Bytes up to which a task keeps the automata as tables of all symbols; beyond that transitions are looked up in sorted lists.
TABLE_BYTES = 1 << 28
#: What counts as alphanumeric but is neither a letter nor a plain digit: letter-like and other numbers.
_NUMBERS = {chr(c) for c in range(128, 0x110000) if chr(c).isalnum() and not chr(c).isalpha()}
_NOT_LETTER = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    """Lower-cased letters, anything else one space; empty for a text without letters."""
    out = _NOT_LETTER.sub(" ", text.lower())
    if not out.isascii() and not _NUMBERS.isdisjoint(out):
        out = " ".join("".join(" " if c in _NUMBERS else c for c in out).split())
    return out.strip()


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; state 1 is the root, 0 stands for none."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


class Automaton:
    """Steps of one language: a table of (state, symbol) if it fits, else sorted keys. A state is given as the place of its first transition.

    Symbol 0 is any that the sample lacks, the last one is padding, which changes no state.
    """

    def __init__(self, points: np.ndarray, room: int):
        self.symbols = np.unique(points)
        rows = suffix_automaton((np.searchsorted(self.symbols, points) + 1).tolist())
        self.width = len(self.symbols) + 2
        self.states = len(rows)
        self.in_table = self.states * self.width * 4 <= room
        edges = [(s * self.width + c, to * self.width) for s, row in enumerate(rows) for c, to in sorted(row.items())]
        self.keys, self.to = np.array([k for k, _ in edges], np.int64), np.array([t for _, t in edges], np.int32)
        self.table: np.ndarray | None = None
        self.root = np.zeros(self.width, np.int32)  # the state after a phrase's first symbol
        for c, to in rows[1].items():
            self.root[c] = to * self.width

    @property
    def padding(self) -> int:
        return self.width - 1

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.symbols, points), max(0, len(self.symbols) - 1))
        return np.where(self.symbols[at] == points, at + 1, 0).astype(np.int32) if len(self.symbols) else np.zeros(len(points), np.int32)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one more symbol, 0 where no match goes on."""
        at = np.add(state, code, dtype=np.int64)
        if self.in_table:
            if self.table is None:  # made by each task from what was sent
                self.table = np.zeros((self.states, self.width), np.int32)
                self.table.ravel()[self.keys] = self.to
                self.table[:, -1] = np.arange(self.states) * self.width
                self.table = self.table.ravel()
            return self.table.take(at)
        found = np.minimum(np.searchsorted(self.keys, at), max(0, len(self.keys) - 1))
        to = np.where(self.keys[found] == at, self.to[found], 0) if len(self.keys) else np.zeros(len(at), np.int32)
        return np.where(code == self.padding, state, to).astype(np.int32)


class CrossParser:
    """Automata of all languages of a sample {language: text}."""

    def __init__(self, sample: dict[str, str], table_bytes: int = TABLE_BYTES):
        self.langs = sorted(sample)
        self.automata = [Automaton(self._points(sample[x]), table_bytes // max(1, len(sample))) for x in self.langs]
        self.symbols = np.unique(np.concatenate([np.zeros(0, np.uint32), *(a.symbols for a in self.automata)]))
        self.local = [np.concatenate([[0], a.codes(self.symbols), [a.padding]]).astype(np.int32) for a in self.automata]
        self.known: np.ndarray | None = None

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def phrases(self, texts: list[str], segment: int = SEGMENT) -> np.ndarray:
        """[text, language]: phrases that each text is parsed into."""
        if self.known is None:  # number of every code point among all samples' symbols, 0 for others
            self.known = np.zeros(0x110000, np.int32)
            self.known[self.symbols] = np.arange(1, len(self.symbols) + 1)
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        at, limit = 0, 4_000_000
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= limit):
                chars += len(texts[to])
                to += 1
            self._parse(texts[at:to], counts[at:to], segment)
            at = to
        return counts

    def _parse(self, texts: list[str], counts: np.ndarray, segment: int) -> None:
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        pieces = -(-lens // segment)
        n = int(pieces.sum())
        if not n:
            return
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(n) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(lens) - lens, pieces) + nth * segment
        size = np.minimum(segment, np.repeat(lens, pieces) - nth * segment)
        flat = np.concatenate([self.known[self._points("".join(texts))], np.zeros(segment, np.int32)])
        padded = np.arange(int(size.max()))[:, None] >= size
        grid = flat[begin[:, None] + np.arange(len(padded))].T.copy()
        grid[padded] = len(self.symbols) + 1
        for k, automaton in enumerate(self.automata):
            codes = self.local[k][grid]
            own, state, begins = self._alone(automaton, codes, padded)
            total, end = own.copy(), state.copy()
            todo, bad = np.flatnonzero(nth > 0), np.zeros(n + 1, bool)
            while len(todo):
                # from the state in which the text's parse leaves the segment before
                follow = self._continued if len(todo) > FEW else self._one_by_one
                total[todo], end[todo], met = follow(automaton, codes, todo, end[todo - 1], own[todo], state[todo], begins)
                bad[todo] = False
                bad[todo + 1] = ~met
                bad[np.append(nth == 0, True)] = False
                wrong = np.flatnonzero(bad)  # entered from the segment's own parse, but a phrase was still open
                todo = wrong[np.diff(owner[wrong], prepend=-1) > 0]  # the first of each text
            counts[:, k] += np.bincount(owner, total, len(texts)).astype(np.int64)

    @staticmethod
    def _alone(automaton: Automaton, codes: np.ndarray, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each segment parsed on its own, the state at its end, and [character, segment]: where phrases begin."""
        state, begins = np.zeros(codes.shape[1], np.int32), np.zeros(codes.shape, bool)
        for i, code in enumerate(codes):
            to = automaton.step(state, code)
            np.equal(to, 0, out=begins[i])
            np.copyto(to, automaton.root.take(code), where=begins[i])
            state = to
        begins &= ~padded
        return begins.sum(0, dtype=np.int64), state, begins

    @staticmethod
    def _continued(automaton: Automaton, codes: np.ndarray, todo: np.ndarray, entry: np.ndarray, own: np.ndarray, own_end: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that begin in each segment of `todo` entered in state `entry`, the state at its end, and whether the parse met the segment's own."""
        total, end, met = np.zeros(len(todo), np.int64), own_end.copy(), np.zeros(len(todo), bool)
        lane, column, state, more, left = np.arange(len(todo)), todo, entry, total.copy(), own.copy()
        for code, own_begins in zip(codes, begins, strict=True):
            if not len(lane):
                break
            code, here = code[column], own_begins[column]
            to = automaton.step(state, code)
            new = (to == 0) & (code != automaton.padding)
            state = np.where(new, automaton.root.take(code), to)
            same = new & here
            if same.any():
                done = lane[same]
                met[done] = True
                total[done] = more[same] + left[same]
                keep = ~same
                lane, column, state, more, left, new, here = (x[keep] for x in (lane, column, state, more, left, new, here))
            more += new
            left -= here
        total[lane], end[lane] = more, state
        return total, end, met

    @staticmethod
    def _one_by_one(automaton: Automaton, codes: np.ndarray, todo: np.ndarray, entry: np.ndarray, own: np.ndarray, own_end: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_continued() for a few segments, in plain steps."""
        total, end, met = np.zeros(len(todo), np.int64), own_end.copy(), np.zeros(len(todo), bool)
        one, padding, root = np.zeros(1, np.int32), automaton.padding, automaton.root
        table = automaton.table
        for k, column in enumerate(todo.tolist()):
            state, more, left = int(entry[k]), 0, int(own[k])
            for code, here in zip(codes[:, column].tolist(), begins[:, column].tolist(), strict=True):
                if code == padding:
                    break
                if table is not None:
                    to = table.item(state + code)
                else:
                    one[0] = code
                    to = int(automaton.step(np.array([state], np.int32), one)[0])
                if not to:
                    if here:
                        met[k] = True
                        break
                    more += 1
                    to = int(root[code])
                state = to
                left -= here
            total[k] = more + left if met[k] else more
            if not met[k]:
                end[k] = state
        return total, end, met


def training_sample(docs: DataFrame, lang_col: str = "lang") -> dict[str, str]:
    """At most SAMPLE_CHARS normalised characters for each label, from the documents with the smallest hash of their id.

    `docs` must hold nothing but rows that may be learned from. What reaches the driver is bounded by the constants and
    the number of languages.
    """
    best = Window.partitionBy("lang").orderBy("_h", "text")
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col("text").isNotNull()).select(F.col(f"`{lang_col}`").alias("lang"), F.substring("text", 1, SAMPLE_DOC_CHARS).alias("text"), F.xxhash64("doc_id", F.lit("sample")).alias("_h"))
    picked = rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= SAMPLE_DOCS).orderBy("lang", "_n").select("lang", "text").collect()
    out: dict[str, str] = {}
    for r in picked:
        out[r.lang] = (out.get(r.lang, "") + " " + normalise(r.text))[:SAMPLE_CHARS].strip()
    return {k: v for k, v in out.items() if v}


def predictions(texts: list[str | None], parser: CrossParser) -> tuple[list[str], np.ndarray]:
    """The language and the score of every text."""
    plain = [normalise(t) if t else "" for t in texts]
    langs, scores = ["und"] * len(plain), np.zeros(len(plain))
    if parser.langs:
        n = parser.phrases(plain)
        order = np.argsort(n, axis=1, kind="stable")
        for i, t in enumerate(plain):
            if t:
                best = order[i, 0]
                langs[i] = parser.langs[best]
                scores[i] = 1 - n[i, best] / n[i, order[i, 1]] if len(parser.langs) > 1 else 1.0
    return langs, scores


def identify(docs: DataFrame, sample: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language whose sample parses the text into the fewest phrases.

    score: 1 - phrases / phrases of the next language, between 0 and 1. `und` with score 0 if the text is null or has no letter,
    or nothing was learned. Ties go to the smaller name. held_out: crc32 of the id as text leaves 2 modulo 4 (false for a
    null id). Very long texts are parsed whole, repeated rows give repeated rows, an empty table gives an empty result. The automata are made once
    in the driver and broadcast: at most three edges a character of the sample, SAMPLE_CHARS a language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(CrossParser(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                langs, scores = predictions(b.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    i = F.col(f"`{id_col}`").cast("long")
    return docs.select(i.alias("doc_id"), held_out(i).alias("held_out"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """identify() with a sample of the labelled documents outside the held-out quarter."""
    return identify(docs, training_sample(docs.where(~held_out(F.col("doc_id")))))


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The documents in which a language is found, with the language found as `lang`; other columns as given.

    Texts that are null or have no letter go. Each row is judged on its own, whatever its id, and passes through the tasks
    that judge it: nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(CrossParser(training_sample(docs.where(~held_out(F.col("doc_id"))))))
    place, schema = docs.columns.index("lang"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                langs, _ = predictions(b.column("text").to_pylist(), shared.value)
                columns = [pa.array(langs, pa.string()) if i == place else b.column(i) for i in range(b.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array([x != "und" for x in langs]))

    return docs.mapInArrow(run, schema)


def op7_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
