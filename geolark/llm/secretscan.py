"""Secret scans with an incremental blob ledger; DataFrame functions only.

Every version of a text is addressed by its content. The ledger holds, for each blob, the rule versions it has been scanned
with and, under each one's name, what it found; a scan looks only at blobs and rule versions that the ledger lacks, appends, and joins the
findings of the versions asked for back to every path that has the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_folder
from .spans import find_all, joined, number_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `least` characters at least in the given group of the match."""

    kind: str
    regex: str
    least: int = 1
    group: int = 0
    needs: str = ""
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


# The formats of the secrets.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 18, needs="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}+", 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="PRIVATE KEY"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}+", needs="gh"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}+", needs="xox"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}", needs="AIza"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", needs="eyJ"),
    Rule("url_login", r"://[A-Za-z0-9._~-]{1,64}:[^\s/@:]{6,128}@", needs="://"),
)
RULES = BASE_RULES + MORE_RULES
_SPANS = "array<struct<start:bigint,end:bigint,rule:string>>"
_LEDGER = f"blob string, rules array<string>, spans {_SPANS}"


def blob_id(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _found(text: Column, rule: Rule) -> Column:
    hits = F.filter(find_all(text, rule.regex, rule.group), lambda h: F.length(h["value"]) >= rule.least)
    spans = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit(rule.name).alias("rule")))
    return F.when(F.contains(text, F.lit(rule.needs)), spans).otherwise(F.array().cast(_SPANS)) if rule.needs else spans


def read_ledger(spark, path: str) -> DataFrame | None:
    """(blob, rules, spans) of all scans recorded at `path`, a row for each scan of a blob; None if there is none yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(_LEDGER).parquet(path).select("blob", "rules", "spans")


def scan_unseen(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scan what the ledger lacks of `versions` (any rows with a text), append it, and return (blob, rules, spans) of their blobs.

    Each unseen blob is scanned once however many rows have it, with just the rule versions that are new to it. Each span
    names the rule version that found it. Of the history only rows of these blobs are read on; a scan that
    two runs made at once is recorded twice and counts once.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blobs = versions.select(blob_id(text).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    names = F.array(*[F.lit(r.name) for r in rules])
    history = read_ledger(spark, ledger)
    known = None
    if history is None:
        todo = blobs.withColumn("rules", names)
    else:
        here = versions.select(blob_id(text).alias("blob")).distinct()
        known = materialize(history.join(here, "blob", "left_semi"), "known")
        seen = known.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    each = [F.when(F.array_contains("rules", r.name), _found(F.col("text"), r)).otherwise(F.array().cast(_SPANS)) for r in rules]
    batch = f"{ledger}/batch={uuid.uuid4().hex}"
    todo.select("blob", "rules", F.concat(*each).alias("spans")).write.parquet(batch)
    new = spark.read.schema(_LEDGER).parquet(batch)
    if known is None:
        return new
    every = known.union(new).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("rules"), F.flatten(F.collect_list("spans")).alias("spans"))
    return every.select("blob", F.array_distinct("rules").alias("rules"), F.array_distinct("spans").alias("spans"))


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): one row a row of documents.

    Just the findings of `rules`, in their given versions, count, whatever else the ledger holds. Kinds are listed in the order of RULES, others
    after them. Null and empty texts have no secrets; repeated rows and texts share one scan and all get its findings; texts are scanned whole; of
    spans with one start the kind listed first comes first; an empty table gives an empty result. Without a ledger a new one in the shared folder is used.
    """
    order = {kind: n for n, kind in enumerate(dict.fromkeys(r.kind for r in RULES + rules))}
    asked = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.struct(F.lit(order[r.kind]).alias("ord"), F.lit(r.kind).alias("kind")))])
    found = scan_unseen(docs, ledger or new_folder(docs.sparkSession, "ledger"), rules)
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob_id(F.col("text")).alias("blob"))
    current = F.filter("spans", lambda s: s["rule"].isin([r.name for r in rules]))
    named = F.transform(current, lambda s: F.struct(s["start"].alias("start"), asked[s["rule"]]["ord"].alias("ord"), asked[s["rule"]]["kind"].alias("kind"), s["end"].alias("end")))
    # written, so that the join has plain shuffles on both sides and the paths of a popular blob can be split
    rows = paths.join(materialize(found.select("blob", named.alias("all")), "findings"), "blob")
    base = F.filter("all", lambda s: s["ord"] < len(BASE_RULES))
    counts = [number_of("all", r.kind) for r in BASE_RULES]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document, over a ledger that starts empty."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same spans in DuckDB: lengths of the pieces between matches and of the matches before one add up to its start."""
    plain = {"assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""}
    parts = ["d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"]
    for n, r in enumerate(RULES):
        regex = plain.get(r.kind, r.regex.replace("}+", "}")).replace("'", "''")
        group = 2 if r.kind == "assign" else r.group
        parts.append(f"r{n} AS (SELECT doc_id, unnest(range(1, len(h) + 1)) AS i, h, v, p FROM (SELECT doc_id, regexp_extract_all(t, '{regex}') AS h, regexp_extract_all(t, '{regex}', {group}) AS v, string_split_regex(t, '{regex}') AS p FROM d WHERE regexp_matches(t, '{regex}')))")
        parts.append(f"x{n} AS (SELECT doc_id, {n} AS ord, '{r.kind}' AS kind, CAST(list_sum(list_transform(p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS start, length(h[i]) AS n FROM r{n} WHERE length(v[i]) >= {r.least})")
    parts.append("x AS (" + " UNION ALL ".join(f"SELECT * FROM x{n}" for n in range(len(RULES))) + ")")
    parts.append("y AS (SELECT *, kind || ':' || start || ':' || (start + n) AS span FROM x)")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    every = "coalesce(string_agg(span, ',' ORDER BY start, ord){}, '')"
    base = every.format(f" FILTER (WHERE ord < {len(BASE_RULES)})")
    return f"WITH {', '.join(parts)} SELECT d.doc_id, {counts}, sha256({base}) AS base_sha256, {every.format('')} AS spans FROM d LEFT JOIN y ON y.doc_id = d.doc_id GROUP BY d.doc_id"


OP4_SQL = _sql()
