"""A Merkle tree over the documents of every source, and one over the sources; DataFrame functions only.

A level is one window: nodes are partitioned by group and parent index, and an ordered, full-frame collect_list gives every node of
a run its brothers and the parent's preimage at once. One row of each run goes on as the parent. The proofs go the other way: each
level joins its parents' paths by group and index, so a level costs a third of the one below and no key holds more than three rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running_totals

#: Nodes of a run, which become one parent.
FAN = 3
#: Levels whose paths are made in one plan.
CUT = 4
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<before:string,after:string>>"


def joined_digest(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs one after another, digests as their hex text."""
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """`-` for null, else the bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: tuple[str, ...] = LEAF_COLUMNS, **changed: Column) -> Column:
    """Digest of a row's columns in order; `changed` replaces some of them."""
    return joined_digest(*[field(changed.get(c, F.col(f"`{c}`"))) for c in columns])


def tree_levels(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The levels from `nodes` (g, n, pos, d) up: (g, n, pos, d, up, before, after, parent), written tables.

    g: the tree, n: its nodes on this level, pos: 0 to n - 1, d: the digest. Every FAN consecutive nodes are a run, the last may be
    shorter; before and after: the digests of a node's run on its left and right, joined; up: the parent's place. The tree's only
    node has no run: up and parent are null. `height` is the number of times the largest tree shrinks.
    """
    out, now = [], nodes.select("g", "n", "pos", "d")
    run = Window.partitionBy("g", "up").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = (F.col("pos") % FAN).cast("int")
    for _ in range(height):
        kids = now.where("n > 1").withColumn("up", F.expr(f"pos div {FAN}")).withColumn("kids", F.collect_list("d").over(run))
        part = lambda a, n: F.array_join(F.slice("kids", a, n), "")
        inner = kids.select("g", "n", "pos", "d", "up", part(F.lit(1), at).alias("before"), part(at + 2, F.lit(FAN)).alias("after"), F.sha2(F.array_join("kids", ""), 256).alias("parent"))
        roots = now.where("n = 1").select("g", "n", "pos", "d", *[F.lit(None).cast(t).alias(c) for c, t in (("up", "long"), ("before", "string"), ("after", "string"), ("parent", "string"))])
        level = materialize(inner.unionByName(roots), "level")
        out.append(level)
        now = level.where(f"n > 1 and pos % {FAN} = 0").select("g", F.ceil(F.col("n") / FAN).alias("n"), F.col("up").alias("pos"), F.col("parent").alias("d"))
    return [*out, now.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("up", "long"), ("before", "string"), ("after", "string"), ("parent", "string"))])]


def height_of(n: int) -> int:
    """How often n nodes shrink until one remains."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def tree_roots(levels: list[DataFrame]) -> DataFrame:
    """(g, d): the root of every tree of tree_levels()."""
    out = levels[0].where("n = 1").select("g", "d")
    for level in levels[1:]:
        out = out.union(level.where("n = 1").select("g", "d"))
    return out


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, pos, d, path, ...) of the lowest level: what stands beside a node on every step to its tree's root, and then `above` it.

    above: (g, path, ...), a row a tree, with further columns that its nodes get too. A step is (before, after).
    """
    more = [c for c in above.columns if c not in ("g", "path")]
    down = None
    for k, level in enumerate(reversed(levels)):
        tops = level.where("n = 1").select("g", "pos", "d").join(above, "g").select("g", "pos", "d", "path", *more)
        if down is not None:
            step = F.array(F.struct("before", "after"))
            parents = down.select("g", F.col("pos").alias("up"), F.col("path").alias("_path"), *more)
            inner = level.where("n > 1").select("g", "up", "pos", "d", "before", "after").join(parents, ["g", "up"])
            tops = inner.select("g", "pos", "d", F.concat(step, "_path").alias("path"), *more).union(tops)
        # the plan is cut now and then, but not where many rows have long paths already
        down = materialize(tops, "paths") if k % CUT == CUT - 1 and k + 2 < len(levels) else tops
    return down


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row a row of documents.

    Leaves of a source ascend by doc_id (null first; of equal ids the smaller digest first), sources by their UTF-8 bytes (null first).
    proof_sha256 is the digest of all brothers from the leaf to the root. Rows in which 2 divides the CRC of the id are checked against
    a text without its newlines: they verify only if there was none. A null id or text isn't tampered with. Empty and very long texts
    are ordinary; equal rows are leaves of their own; an empty table gives an empty result; other columns take no part.
    """
    tamper = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").isNotNull()
    altered = F.when(tamper, leaf_digest(text=F.translate("text", "\n", "")))
    rows = docs.select("doc_id", "source", leaf_digest().alias("d"), altered.alias("altered"), F.col("source").isNotNull().alias("_named"), F.lit(1).cast("long").alias("_one"))
    placed = materialize(running_totals(rows, ["_named", "source", "doc_id", "d"], {"_upto": "_one"}), "placed")
    sources = placed.groupBy("source").agg(F.min("_upto").alias("g"), F.count("*").alias("n")).withColumnRenamed("source", "_source")
    of = F.col("source").eqNullSafe(F.col("_source"))
    leaves = materialize(placed.join(sources, of).select("g", "n", (F.col("_upto") - F.col("g")).alias("pos"), "d", "doc_id", "altered"), "leaves")
    largest, trees = sources.agg(F.max("n"), F.count("*")).first()
    levels = tree_levels(leaves, height_of(largest or 0))

    subroots = tree_roots(levels).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals(subroots, ["g"], {"_nth": "_one"}).select(F.lit(0).cast("long").alias("g"), F.lit(trees).alias("n"), (F.col("_nth") - 1).alias("pos"), "d", F.col("g").alias("tree"))
    ranked = materialize(ranked, "subroots")
    upper = tree_levels(ranked, height_of(trees))
    root = tree_roots(upper).select("g", F.array().cast(_STEP).alias("path"), F.col("d").alias("root"))
    over = paths(upper, root).join(ranked.select("pos", "tree"), "pos")
    above = materialize(over.select(F.col("tree").alias("g"), "path", F.col("d").alias("subroot"), "root"), "above")

    ways = paths(levels, above).join(leaves.select("g", "pos", "doc_id", "altered"), ["g", "pos"])
    brothers = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    folded = F.aggregate("path", F.coalesce("altered", "d"), lambda d, s: joined_digest(s["before"], d, s["after"]))
    out = ways.select("doc_id", F.col("d").alias("leaf"), "subroot", "root", F.sha2(brothers, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents: leaf, roots, proof, and whether a tampered copy is found out."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = """
WITH RECURSIVE t0 AS (
  SELECT list(list_reduce([CAST(i AS BIGINT)] || range(0, 8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS crc FROM range(0, 256) r(i)
), docs AS (
  SELECT *, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c // 256, crc[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS hit,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents, t0
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit AND text IS NOT NULL THEN sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) END AS altered FROM docs
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), tree(g, k, n, pos, d) AS (
  SELECT g, CAST(0 AS BIGINT), n, pos, leaf FROM placed
  UNION ALL
  SELECT g, k + 1, (n + 2) // 3, pos // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, k, n, pos // 3
), sub AS (
  SELECT g, k AS height, d FROM tree WHERE n = 1
), upper(k, n, pos, d) AS (
  SELECT CAST(0 AS BIGINT), count(*) OVER (), g - 1, d FROM sub
  UNION ALL
  SELECT k + 1, (n + 2) // 3, pos // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY k, n, pos // 3
), nodes AS (
  SELECT g, k, n, pos, d FROM tree WHERE n > 1
  UNION ALL
  SELECT -1, k, n, pos, d FROM upper WHERE n > 1
), runs AS (
  SELECT g, k, pos, list(d) OVER r AS kids, CAST(pos % 3 AS INTEGER) AS nth FROM nodes WINDOW r AS (PARTITION BY g, k, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), steps AS (
  SELECT g, k, pos, array_to_string(kids[:nth], '') AS before, array_to_string(kids[nth + 2:], '') AS after FROM runs
), ways AS (
  SELECT p.g, p.pos, s.k, s.before, s.after FROM placed p JOIN steps s ON s.g = p.g AND s.pos = p.pos // CAST(pow(3, s.k) AS BIGINT)
  UNION ALL
  SELECT p.g, p.pos, sub.height + s.k, s.before, s.after FROM placed p JOIN sub ON sub.g = p.g JOIN steps s ON s.g = -1 AND s.pos = (p.g - 1) // CAST(pow(3, s.k) AS BIGINT)
), proofs AS (
  SELECT g, pos, sha256(string_agg(before || after, '' ORDER BY k)) AS proof, count(*) AS steps FROM ways GROUP BY g, pos
), fold(g, pos, k, d) AS (
  SELECT g, pos, CAST(0 AS BIGINT), coalesce(altered, leaf) FROM placed
  UNION ALL
  SELECT f.g, f.pos, f.k + 1, sha256(w.before || f.d || w.after) FROM fold f JOIN ways w ON w.g = f.g AND w.pos = f.pos AND w.k = f.k
), top AS (
  SELECT d AS root FROM upper WHERE n = 1
)
SELECT p.doc_id, p.leaf, s.d AS subroot, t.root, coalesce(q.proof, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = t.root AS verified
FROM placed p CROSS JOIN top t JOIN sub s ON s.g = p.g LEFT JOIN proofs q ON q.g = p.g AND q.pos = p.pos JOIN fold f ON f.g = p.g AND f.pos = p.pos AND f.k = coalesce(q.steps, 0)
"""
