"""Importance resampling towards a target corpus by external sorting of packed bucket streams.

Texts become streams of uint16 bucket numbers, packed with their documents' offsets into written rows of bounded size. Every row is
sorted and run-length encoded on its own, and the runs' lengths are summed by bucket; the streams are then read again and each
document's gains are gathered by their offsets. Documents get Gumbel noise of their id, and the highest scores are the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_totals

BUCKETS = 10_000
#: Features of a packed row, unless one document has more, and its documents.
ROW_FEATURES, ROW_DOCUMENTS = 1 << 20, 4096
#: Percent drawn, of the documents with so many words.
PERCENT, LEAST_WORDS = 10, 20
SEED = 2024
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_STREAMS = "ids array<long>, words array<long>, sizes array<long>, stream binary"


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_WORD_BYTES).split()


def bucket_stream(words: list[bytes], longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to `longest` words, joined by one space, as uint16."""
    runs = [words] + [[b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, longest + 1)]
    hashed = [np.fromiter(map(crc32, x), np.uint32, len(x)) for x in runs]
    return (np.concatenate(hashed) % np.uint32(buckets)).astype("<u2")


def bucket_streams(docs: DataFrame, id_col: str | None, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(ids, words, sizes, stream): packed rows of many documents; sizes are their features, in the order of the stream.

    Null and empty texts have no features and stay; without an id column the ids are null.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("bucket numbers are 16 bits wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        words: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def row() -> pa.RecordBatch:
            sizes = [len(p) for p in parts]
            cells = [pa.array([x], pa.list_(pa.int64())) for x in (ids, words, sizes)]
            return pa.RecordBatch.from_arrays([*cells, pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["ids", "words", "sizes", "stream"])

        for b in batches:
            texts = b.column("text")
            for i, doc_id in enumerate(b.column("id").to_pylist()):
                own = words_of(texts[i].as_py())
                ids.append(doc_id)
                words.append(len(own))
                parts.append(bucket_stream(own, longest, buckets))
                held += len(parts[-1])
                if held >= ROW_FEATURES or len(ids) >= ROW_DOCUMENTS:
                    yield row()
                    ids, words, parts, held = [], [], [], 0
        if ids:
            yield row()

    own_id = F.col(f"`{id_col}`") if id_col else F.lit(None)
    return docs.select(own_id.cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, _STREAMS)


def bucket_counts(streams: DataFrame) -> DataFrame:
    """(bucket, n): how often each bucket stands in all streams. Each packed row is one sorted run; only run lengths are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b.column(0):
                s = np.sort(np.frombuffer(packed.as_buffer(), "<u2"))
                first = np.flatnonzero(np.diff(s, prepend=-1 if len(s) else 0))
                yield pa.RecordBatch.from_arrays([pa.array(s[first].astype(np.int32)), pa.array(np.diff(np.append(first, len(s))))], names=["bucket", "n"])

    return streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln) of its smoothed share in `target` over that in `raw`, both (bucket, n)."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    per = materialize(both.union(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")), "buckets")
    whole_s, whole_t = per.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1) * F.lit(whole_s + buckets) / ((F.col("s") + 1) * F.lit(whole_t + buckets))
    return per.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def document_weights(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, words, n_features, weight): the sum of the gains of each document's features; 0 without features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                sizes = b.column("sizes")[i].values.to_numpy()
                own = gains[np.frombuffer(b.column("stream")[i].as_buffer(), "<u2")]
                weight = np.zeros(len(sizes), np.int64)
                some = sizes > 0  # an empty segment would take its neighbour's first gain
                if some.any():
                    weight[some] = np.add.reduceat(own, (np.cumsum(sizes) - sizes)[some])
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("words")[i].values, pa.array(sizes), pa.array(weight)], names=["doc_id", "words", "n_features", "weight"])

    return streams.mapInArrow(run, "doc_id long, words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 32 bits of sha256 of `seed:id`; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): one row a row of `docs` (doc_id, text), the sample's rows ranked from 1.

    `target` (text) is the corpus to come close to. Of the N documents with at least `least_words` words the
    floor(N * percent / 100) highest scores are drawn, ties to the smaller doc_id (null last), equal rows in any order; the others'
    rank is null. Null and empty texts have no features and weight 0; an empty target only smooths; an empty table gives an empty
    result; other columns take no part. Only the gains, a number a bucket (65,536 at most), pass the driver.
    """
    streams = materialize(bucket_streams(docs, "doc_id", "text", longest, buckets), "streams")
    wanted = bucket_counts(bucket_streams(target, None, "text", longest, buckets))
    table = np.zeros(buckets, np.int64)
    for r in bucket_gains(bucket_counts(streams), wanted, buckets).collect():
        table[r["bucket"]] = r["gain"]
    weighed = document_weights(streams, table).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    eligible = (F.col("words") >= least_words).cast("long")
    keyed = weighed.select("doc_id", "n_features", "weight", "score", eligible.alias("_in"), (1 - eligible).alias("_out"), (-F.col("score")).alias("_down"), F.col("doc_id").isNull().alias("_none"))
    ranked = running_totals(keyed, ["_out", "_down", "_none", "doc_id", "n_features", "weight"], {"_nth": "_in"})
    drawn = ranked.agg(F.expr(f"coalesce(sum(_in), 0) * {percent} div 100")).first()[0]
    rank = F.when((F.col("_in") == 1) & (F.col("_nth") <= F.lit(drawn)), F.col("_nth"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op13_importance(spark, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of all documents, drawn towards the benchmark's texts."""
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH crc0 AS (
  SELECT list(list_reduce([CAST(i AS BIGINT)] || range(0, 8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS crc FROM range(0, 256) r(i)
), texts AS (
  SELECT 0 AS side, row_number() OVER () AS k, doc_id, text FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT side, k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
), hexed AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words)
), hashed AS (
  SELECT w, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, b: xor(c // 256, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, crc0
), features AS (
  SELECT side, k, bucket FROM words JOIN hashed USING (w)
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM features GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM counts
), weights AS (
  SELECT k, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM features JOIN gains USING (bucket) WHERE side = 0 GROUP BY k
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score
  FROM texts d LEFT JOIN weights USING (k) WHERE d.side = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS nth, count(*) FILTER (WHERE n_features >= 20) OVER () * 10 // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND nth <= drawn THEN nth END AS rank FROM ranked
"""
