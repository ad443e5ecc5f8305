"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, materialize, packed, running_totals

#: A document is taken at most so many times, a source at most to so many times its size.
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)


def words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffled(doc_id: Column, seed: int) -> Column:
    """A place in an order that looks random and that every run repeats: 60 bits of a hash of the id."""
    text = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, before, target) from (source, size): the total shared by weight, none above max_repeats times its size.

    Sources by code point, null last, take the weights in turn. before: the sizes of the sources ahead. With caps c and
    weights w the targets are min(c, level * w); each pass over the table of sources raises the level by what the sources at their
    cap leave over, until no other is above its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull()).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals(per, ["_null", "source"], {"_nth": "_one", "_upto": "source_size"})
    turn = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", (F.col("_upto") - F.col("source_size")).alias("before"), turn.alias("w"), (F.col("source_size") * float(max_repeats)).alias("cap")), "sources")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, F.lit(False)
    while True:  # every pass but the last caps at least one more source
        spent, free = ranked.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        raised = (total - spent) / free if free else level
        if raised <= level:
            break
        level = raised
        capped = F.col("cap") <= F.col("w") * F.lit(level)
    target = F.when(capped, F.col("cap")).otherwise(F.col("w") * F.lit(level))
    return ranked.select("source", "source_size", "before", F.round(target, 6).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 8, **keys: Column) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) and the given `keys`: one row a row of (doc_id, text, source).

    Within its source every document gets a place in a shuffled order (a hash of its id). Its n-th copy finishes at
    (n * source size + words of the source up to it) / target of the source; all copies in the order of their finish
    are taken until the total is reached, so each source advances at its target's rate and a copy more or less is the only
    error. Null texts and texts without words have size 0 and are taken 0 words; a null source is a source; repeated rows
    count as often as they stand; an empty table gives an empty result. Reruns agree, up to the order of equal rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), shuffled(F.col("doc_id"), seed).alias("_h"), *[v.alias(k) for k, v in keys.items()])
    rows = materialize(rows, "sizes")
    targets = materialize(source_targets(rows, weights, max_repeats), "targets")
    order = ["_null", "source", "_h", "doc_id", "size", "_row"]
    keyed = rows.withColumn("_null", F.col("source").isNull()).withColumn("_row", F.monotonically_increasing_id())
    placed = running_totals(keyed, order, {"_upto": "size"}).join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    own = F.col("_upto") - F.col("before")
    nth = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    copies = placed.where("size > 0 and target > 0").select("doc_id", "_row", "_h", "size", "target", "source_size", own.alias("_own"), nth.alias("_nth"))
    copies = copies.withColumn("_finish", (F.col("_nth") * F.col("source_size") + F.col("_own")) / F.col("target")).select("_finish", "_h", "doc_id", "_nth", "_row", "size")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    queue = running_totals(copies, ["_finish", "_h", "doc_id", "_nth", "_row"], {"_total": "size"}).where(F.col("_total") <= F.lit(total))
    taken = queue.groupBy("_row").agg(F.count("*").alias("copies"))
    back = placed.select("doc_id", "_row", "size", "source_size", "target", *keys).join(taken, "_row", "left")
    n = F.coalesce("copies", F.lit(0)).cast("long")
    return back.select("doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"), *keys)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as mixed() takes it, so the words written are the words taken; columns of documents.

    Rows are known by their id and two hashes of all columns. Rows that share an id but not their columns are taken as often as
    each of them says; equal rows as often as all of them say. Null ids are ids of their own rows only.
    """
    columns = [F.col(f"`{c}`") for c in DOCUMENT_COLUMNS]
    keys = {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "_h1": F.xxhash64(*columns), "_h2": F.hash(*columns)}
    taken = mixed(docs, **keys).groupBy(*keys).agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")
    # of equal rows one stands for all, and each task hands on one, so that very many don't meet
    rows = packed(docs.select(*columns), **keys).dropDuplicates([*keys]).join(taken, [*keys])
    again = rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_nth"))
    return again.select(*[F.col("_row").getField(c).alias(c) for c in DOCUMENT_COLUMNS])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, CAST('0x' || substr(md5(doc_id || ':8'), 1, 15) AS BIGINT) AS h FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM s GROUP BY source
), w AS (
  SELECT *, CAST((nth - 1) % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM src
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, nth) AS k, sum(cap) OVER (ORDER BY cap / w, nth) - cap AS spent, sum(w) OVER () - (sum(w) OVER (ORDER BY cap / w, nth) - w) AS free,
    CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w
), l AS (
  SELECT arg_min((total - spent) / free, k) AS level FROM o WHERE cap / w > (total - spent) / free
), t AS (
  SELECT source, source_size, round(least(cap, w * coalesce(level, 1e300)), 6) AS target FROM w, l
), p AS (
  SELECT s.*, t.source_size, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS own FROM s JOIN t ON t.source IS NOT DISTINCT FROM s.source
), c AS (
  SELECT doc_id, size, h, n, CAST(n * source_size + own AS DOUBLE) / target AS f FROM p, range(0, 3) r(n) WHERE size > 0 AND target > 0
), q AS (
  SELECT *, sum(size) OVER (ORDER BY f, h, doc_id, n ROWS UNBOUNDED PRECEDING) AS so_far FROM c
), k AS (
  SELECT doc_id, count(*) AS copies FROM q WHERE so_far <= (SELECT sum(size) FROM s) GROUP BY doc_id
)
SELECT p.doc_id, size, source_size, target, coalesce(copies, 0) * size AS taken, coalesce(copies, 0) AS copies FROM p LEFT JOIN k USING (doc_id)
"""
