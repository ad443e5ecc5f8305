"""Packing token sequences by vector best-fit."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Tokens of a sequence, documents in it, and attention cost (sum of squared lengths).
CAPACITY = (2048, 2048, 2048 * 2048)
#: How much a residual of each kind counts when a sequence is chosen.
PREFERENCE = (1.0, 0.01, 0.01)
#: Pieces that are packed together in one task call.
GROUP = 8192
END_ID = 0
_known: dict[str, dict] = {}


#: What needs the vocabulary's own tokenizer: characters whose lower case or composition may depend on others, special tokens.
#: Then the splitter's units in lower-cased plain words.
_OTHER = re.compile(r"[^\n\x21-\x7eÀ-ÖØ-öø-ÿ]|<\|")
_UNITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the rest for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class WordEncoder:
    """Token ids of texts, each distinct word of a batch encoded once.

    The vocabulary's splitter never joins characters across white space, so the ids of a text are those of its words one after
    another. Words of plain characters go through a ranked encoder of the same vocabulary: NUL, which marks the end of a unit, is joined to the
    last byte first, then pairs in the order of the vocabulary's merges. Every token is what its own bytes merge
    into, so both give the same ids. Other words go through the vocabulary's tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbols, vocab, end = _byte_symbols(), model["vocab"], model["end_of_word_suffix"]
        raw = lambda t: bytes(symbols[c] for c in (t.removesuffix(end))) + (b"\0" if t.endswith(end) else b"")
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(256)}
        self.id_of = np.zeros(512 + len(model["merges"]), np.uint32)
        for symbol, b in symbols.items():
            self.id_of[b], self.id_of[256 + b] = vocab.get(symbol, 0), vocab.get(symbol + end, 0)
        for n, pair in enumerate(model["merges"]):
            token = "".join(pair.split(" ") if isinstance(pair, str) else pair)
            self.id_of[ranks.setdefault(raw(token), 512 + n)] = vocab[token]
        self.ranked = tiktoken.Encoding("words", pat_str=r"[^\x00\n]*\x00|\n", mergeable_ranks=ranks, special_tokens={})
        self.newline = ranks[b"\n"]

    def _plain(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each line of `joined`."""
        marked = _UNITS.sub("\\g<0>\0", joined.lower()) + "\n"
        found = np.asarray(self.ranked.encode_ordinary(marked), np.int64)
        ends = np.flatnonzero(found == self.newline)
        return self.id_of[found[found != self.newline]], np.diff(ends - np.arange(len(ends)), prepend=0)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after another, and how many each has."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        joined = pc.binary_join(whole, "\n")[0].as_py()
        if not _OTHER.search(joined):
            return self._plain(joined)
        each = words.to_pylist()
        odd = [i for i, w in enumerate(each) if _OTHER.search(w)]
        spare = set(odd)
        flat, size = self._plain("\n".join("" if i in spare else w for i, w in enumerate(each)))
        ids = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([each[i] for i in odd], add_special_tokens=False)]
        at = np.cumsum(size)[odd]
        flat = np.insert(flat, np.repeat(at, [len(x) for x in ids]), np.concatenate(ids))
        size[odd] = [len(x) for x in ids]
        return flat, size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by END_ID, and where each text's begin (one more entry for the end)."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        flat, size = self.words(coded.dictionary)
        flat, size = np.append(flat, np.uint32(END_ID)), np.append(size, 1)
        begin = np.cumsum(size) - size
        offsets = lists.offsets.to_numpy()
        index = np.insert(coded.indices.to_numpy(zero_copy_only=False), offsets[1:] - offsets[0], len(size) - 1)
        lens = size[index]
        ends = np.cumsum(lens)
        ids = flat[np.arange(int(lens.sum())) + np.repeat(begin[index] - (ends - lens), lens)]
        last = offsets[1:] - offsets[0] + np.arange(len(texts))
        return ids, np.concatenate([[0], ends[last]]) if len(texts) else np.zeros(1, np.int64)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY[0], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and END_ID, cut only if longer than `capacity`. Null text is empty: one piece of one id."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _known.setdefault("encoder", {}).get(path) or _known["encoder"].setdefault(path, WordEncoder(path))
        for whole in batches:
            sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False))])
            at = 0
            while at < len(whole):
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + 6_000_000, "right")) - 1)
                b = whole.slice(at, to - at)
                at = to
                texts = pc.fill_null(b.column(1), "")
                ids, begin = encode(texts)
                size = np.diff(begin)
                n = -(-size // capacity)
                owner = np.repeat(np.arange(len(b)), n)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = nth * capacity
                length = np.minimum(capacity, size[owner] - start)
                first = begin[owner] + start
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(first.tolist(), (first + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def vector_best_fit(lengths: np.ndarray, capacity: tuple[int, int, int] = CAPACITY, preference: tuple[float, float, float] = PREFERENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, longest first: of the open bins whose residual tokens, documents and attention cost
    all suffice, the one whose residual vector after the piece has the smallest weighted norm; a new bin if there is none."""
    cap = np.asarray(capacity, float)
    weight = np.asarray(preference) / cap**2
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.zeros((0, 3))
    numbers = np.zeros(0, np.int64)
    room, n, made = 0, 0, 0
    smallest = int(lengths.min(initial=0))
    for i in order.tolist():
        size = int(lengths[i])
        need = np.array([size, 1.0, float(size) * size])
        after = left[:n] - need
        fits = (after >= 0).all(1)
        if fits.any():
            norm = np.where(fits, (after * after) @ weight, np.inf)
            at = int(norm.argmin())
            left[at] = after[at]
        else:
            if n == room:
                room = max(256, 2 * room)
                left, numbers = np.resize(left, (room, 3)), np.resize(numbers, room)
            at, n = n, n + 1
            left[at], numbers[at] = cap - need, made
            made += 1
        bins[i], offsets[i] = numbers[at], int(cap[0] - left[at, 0]) - size
        if left[at, 0] < smallest:  # full: the last open bin takes its place
            n -= 1
            left[at], numbers[at] = left[n], numbers[n]
    return bins, offsets


def packed_sequences(docs: DataFrame, tokenizer: str | None = None, capacity: tuple[int, int, int] = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row of `docs` in a sequence.

    Full pieces are sequences of their own. The others are dealt by hash into groups of about `group` pieces, whatever their
    source or id, and each group is packed in one call, so a task's memory is bounded and each group wastes about one
    sequence. Repeated rows are packed as often as they stand; an empty table gives an empty result.
    """
    cut = materialize(pieces(docs, tokenizer, capacity[0]), "pieces").withColumn("_row", F.monotonically_increasing_id())
    full = F.col("length") == capacity[0]
    groups = max(1, math.ceil(cut.where(~full).count() / group))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = cut.where(full).select(*names[:5], (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(~full).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_row", ignore_index=True)  # arrival order depends on the shuffle
        bins, offsets = vector_best_fit(t["length"].to_numpy(), capacity)
        return t.assign(sequence_id=(int(t["_group"].iloc[0]) << 32) + bins, offset=offsets)[names]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return alone.union(rest.groupBy("_group").applyInPandas(pack, schema))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's token pieces in sequences of at most 2048."""
    return packed_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
