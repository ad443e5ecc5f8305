"""Personal data by weak supervision; DataFrame functions only.

Candidates are the matches of strict and of loose patterns. Labelers - format, gazetteer, context and shape - vote on each or
abstain. Expectation-maximisation estimates how reliable each labeler is for each kind from the table of vote patterns, which has
at most 3^4 rows a kind whatever the corpus. With its posteriors as soft labels a span classifier is trained on all candidates: naive Bayes over
what a span and its surroundings look like (neighbouring words and characters, length, digits, outline, gazetteer key), not over the votes.
Loose candidates that it accepts, and that no strict span overlaps, join the strict ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .spans import find_all, joined, number_of

KINDS = ("email", "ip", "card", "phone")
#: Probability from which a loose candidate is taken.
ACCEPT = 0.9
CONTEXT = 32
#: What is believed of the labelers - format, gazetteer, context, shape - before any count: yes to right candidates, yes to wrong ones; and for how many
#: votes that stands, whatever the number of candidates.
BELIEFS = ((0.95, 0.1), (0.9, 0.5), (0.9, 0.1), (0.9, 0.5))
BELIEF_VOTES = 20.0
#: The labeler that looks around the span; the others look at the span itself and agree by habit. Weight of each of their votes where it votes
#: too, so that they don't outvote it, and where it abstains.
AROUND, SHARES = 2, (0.3, 1.0)
#: Buckets of a kind's features, what a feature is smoothed with, and how much features count that are not independent.
BUCKETS, SMOOTH, TEMPER = 4096, 2.0, 0.6

# The strict formats (possessive, so that long runs cost linear time), loose ones, and the word lists.
_LOCAL = "A-Za-z0-9._%+-"
STRICT = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?(?:\(at\)|\[at\]|\(AT\)|\[AT\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\(DOT\)|\[DOT\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}([._/]|\x20-\x20|\x20{2})[0-9]{4}\1[0-9]{4}\1[0-9]{3,4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(./-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}
NEEDS = {("email", True): "@", ("phone", True): "+", ("email", False): "at", ("ip", False): ":"}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|courriel|correo|kontakt)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|address|server|host|client)\b",
    "card": r"(?i)\b(?:card|credit|visa|mastercard|amex|payment|carte|tarjeta|karte)\b",
    "phone": r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|telefon|t.l.phone|tel.fono)\b",
}
AGAINST = r"(?i)\b(?:order|invoice|version|release|id|ref|reference|isbn|issn|part|sku|serial|model|case|ticket|section|chapter|page|tracking)\b"
TOP_DOMAINS = "com org net edu gov mil int info biz io dev app co ai me tv eu de fr es it nl be ch at pt pl se no fi dk ie uk us ca mx br ar au nz jp cn kr in za ru".split()
CALLING_CODE = r"^\+[\x20(]*(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
CARD_PREFIXES = [*range(22, 28), 34, 37, *range(40, 50), *range(51, 56), *range(60, 66)]
_CANDIDATES = "array<struct<start:bigint,ord:int,kind:string,end:bigint,strict:boolean,base:boolean,match:string,before:string,after:string>>"


def gazetteer(spark) -> DataFrame:
    """(kind, key): known top-level domains, public first parts of addresses, card prefixes, and calling codes or area digits; under 400 rows."""
    keys = [("email", x) for x in TOP_DOMAINS] + [("ip", str(x)) for x in range(1, 224) if x not in (10, 127)] + [("ip", ":")]
    keys += [("card", str(x)) for x in CARD_PREFIXES] + [("phone", f"+{x}") for x in (1, 7, 20, 27, 30, 31, 32, 33, 34, 36, 39, *range(40, 50), *range(51, 59), 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 94, 351, 352, 353, 358, 420, 421)]
    keys += [("phone", str(x)) for x in range(2, 10)]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in keys) + " AS t(kind, key)")


def gazetteer_key(kind: Column, match: Column) -> Column:
    """What a candidate is looked up by."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    code = F.regexp_extract(match, CALLING_CODE, 1)
    return (
        F.when(kind == "email", F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1)))
        .when(kind == "ip", F.when(F.contains(match, F.lit(":")), ":").otherwise(F.regexp_replace(F.regexp_extract(match, r"^([0-9]+)", 1), "^0+", "")))
        .when(kind == "card", F.substring(digits, 1, 2))
        .otherwise(F.when(F.startswith(match, F.lit("+")), F.concat(F.lit("+"), code)).otherwise(F.substring(digits, 1, 1)))
    )


def _valid(kind: str, match: Column) -> Column:
    """Whether a strict match passes its kind's check."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int") <= 255, F.regexp_replace(p, "^0+", "") == ""))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _candidates(text: Column, kind: str, strict: bool) -> Column:
    """All matches of one pattern."""

    def one(h: Column) -> Column:
        valid = _valid(kind, h["match"]) if strict else F.lit(False)
        place = [h["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), h["end"].alias("end")]
        return F.struct(*place, F.lit(strict).alias("strict"), valid.alias("base"), h["match"].alias("match"), h["before"].alias("before"), h["after"].alias("after"))

    found = F.transform(find_all(text, (STRICT if strict else LOOSE)[kind], 0, CONTEXT), one)
    if kind == "card" and not strict:
        found = F.filter(found, lambda h: _valid(kind, h["match"]))
    need = NEEDS.get((kind, strict))
    return F.when(F.contains(text, F.lit(need)), found).otherwise(F.array().cast(_CANDIDATES)) if need else found


def plausible(kind: Column, match: Column) -> Column:
    """Whether a loose match is well formed beyond its pattern: a domain and a name of two letters, an area and exchange that are given out, a card's length for its
    network, an address whose groups are not all alike."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    number = F.regexp_like(digits, F.lit(r"^[2-9](?!11)[0-9]{2}[2-9](?!11)[0-9]{6}$")) & ~F.regexp_like(digits, F.lit(r"(\d)\1{6}"))
    card = F.when(F.substring(digits, 1, 2).isin("34", "37"), F.length(digits) == 15).otherwise(F.length(digits) == 16)
    mail = F.regexp_like(match, F.lit(r"^[A-Za-z0-9._%+-]{2,}.*[^A-Za-z0-9][A-Za-z]{2,}$"))
    return F.when(kind == "phone", number).when(kind == "card", card).when(kind == "email", mail).otherwise(~F.regexp_like(F.lower(match), F.lit(r"^([0-9a-f]{1,4})(:\1){7}$")))


def votes(rows: DataFrame) -> DataFrame:
    """Candidates (a row each) with `key` and `votes`, one letter a labeler - format, gazetteer, context, shape: y for, n against, - abstains."""
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    known = gazetteer(rows.sparkSession).withColumn("known", F.lit("y"))
    keyed = rows.withColumn("key", gazetteer_key(F.col("kind"), F.col("match"))).join(F.broadcast(known), ["kind", "key"], "left")  # a table of fixed size
    form = F.when(F.when(F.col("strict"), F.col("base")).otherwise(plausible(F.col("kind"), F.col("match"))), "y").otherwise("n")
    cue = F.lit("-")
    for kind, regex in CUES.items():
        cue = F.when((F.col("kind") == kind) & F.regexp_like("before", F.lit(regex)), "y").otherwise(cue)
    cue = F.when((cue == "-") & F.regexp_like("before", F.lit(AGAINST)), "n").otherwise(cue)
    glued = F.regexp_like(F.substring("before", -1, 1), F.lit(r"[\p{L}\p{N}]")) | F.regexp_like(F.substring("after", 1, 1), F.lit(r"[\p{L}\p{N}]"))
    usual = F.when(F.col("kind") == "card", digits.isin(13, 15, 16)).when(F.col("kind") == "phone", digits.between(10, 13)).otherwise(True)
    shape = F.when(~glued & usual, "y").otherwise("n")
    return keyed.withColumn("votes", F.concat(form, F.coalesce("known", F.lit("n")), cue, shape)).drop("known")


def reliabilities(patterns: dict[tuple[int, ...], int], beliefs: tuple[tuple[float, float], ...] | None = None, rounds: int = 50, around: int | None = None) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern of one kind by expectation-maximisation; abstentions say nothing.

    beliefs: for every labeler how often it says yes to what is personal data and to what is not. They start the estimate and count as BELIEF_VOTES
    votes, so that any larger number of candidates outweighs them. Without beliefs all are alike and weigh three votes. around: the
    labeler beside which the others count with SHARES; by default all count in full.
    """
    n = len(next(iter(patterns), ()))
    total = sum(patterns.values())
    held = BELIEF_VOTES if beliefs else 3.0
    start = beliefs or ((2 / 3, 1 / 3),) * n
    hit, false, prior = [h for h, _ in start], [f for _, f in start], 0.5
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for v in patterns:
            odds = math.log(prior / (1 - prior))
            for j, x in enumerate(v):
                if x >= 0:
                    share = 1.0 if around is None or j == around else SHARES[v[around] < 0]
                    odds += share * (math.log(hit[j] / false[j]) if x else math.log((1 - hit[j]) / (1 - false[j])))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        prior = (sum(c * post[v] for v, c in patterns.items()) + held / 2) / (total + held)
        for j, (h, f) in enumerate(start):
            seen = {v: c for v, c in patterns.items() if v[j] >= 0}
            hit[j] = (sum(c * post[v] for v, c in seen.items() if v[j]) + held * h) / (sum(c * post[v] for v, c in seen.items()) + held)
            false[j] = (sum(c * (1 - post[v]) for v, c in seen.items() if v[j]) + held * f) / (sum(c * (1 - post[v]) for v, c in seen.items()) + held)
    return post


def features() -> Column:
    """Buckets of what a candidate and its surroundings look like: an array of ints below BUCKETS."""
    word = lambda side, n: F.lower(F.regexp_extract(side, r"(\p{L}+)\P{L}*$" if n == 1 else r"(\p{L}+)\P{L}+\p{L}+\P{L}*$", 1))
    outline = F.regexp_replace(F.regexp_replace("match", "[A-Za-z]+", "a"), "[0-9]+", "0")
    kind_of = lambda c: F.regexp_replace(F.regexp_replace(c, r"[\p{L}]", "a"), r"\p{N}", "0")
    seen = {
        "w1": word("before", 1), "w2": word("before", 2), "n1": F.lower(F.regexp_extract("after", r"^\P{L}*(\p{L}+)", 1)),
        "c0": kind_of(F.substring("before", -1, 1)), "c1": kind_of(F.substring("after", 1, 1)),
        "len": F.least(F.length("match"), F.lit(64)).cast("string"), "dig": F.length(F.regexp_replace("match", "[^0-9]", "")).cast("string"),
        "out": F.substring(outline, 1, 24), "key": F.col("key"),
    }
    return F.array(*[F.pmod(F.xxhash64("kind", F.lit(n), v), F.lit(BUCKETS)).cast("int") for n, v in seen.items()])


def posteriors(cands: DataFrame) -> DataFrame:
    """(kind, votes, post): how probable each vote pattern makes personal data; at most 81 rows a kind, so the estimate is made in the driver."""
    counts = cands.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    rows = []
    for kind in KINDS:
        patterns = {tuple(-1 if x == "-" else int(x == "y") for x in r["votes"]): (r["n"], r["votes"]) for r in counts if r["kind"] == kind}
        post = reliabilities({v: n for v, (n, _) in patterns.items()}, BELIEFS, around=AROUND)
        rows += [f"('{kind}', '{patterns[v][1]}', {p!r}D)" for v, p in post.items()]
    return cands.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(rows or ["('', '', 0D)"]) + " AS t(kind, votes, post)")


def span_classifier(labelled: DataFrame) -> DataFrame:
    """(kind, bucket, weight, prior) of a naive Bayes model of `labelled` (kind, features, post): log odds of each bucket and of the kind.

    Every candidate is learned from, with its posterior as a soft label; one aggregation, at most BUCKETS rows a kind.
    """
    each = labelled.select("kind", F.explode("features").alias("bucket"), "post")
    seen = each.groupBy("kind", "bucket").agg(F.sum("post").alias("yes"), F.sum(1 - F.col("post")).alias("no"))
    whole = labelled.groupBy("kind").agg((F.sum("post") + 0.5).alias("all_yes"), (F.sum(1 - F.col("post")) + 0.5).alias("all_no"))
    share = F.col("all_yes") / (F.col("all_yes") + F.col("all_no"))
    weight = F.log((F.col("yes") + SMOOTH * share) / F.col("all_yes")) - F.log((F.col("no") + SMOOTH * (1 - share)) / F.col("all_no"))
    return seen.join(whole, "kind").select("kind", "bucket", (weight * TEMPER).alias("weight"), F.log(F.col("all_yes") / F.col("all_no")).alias("prior"))


def probabilities(cands: DataFrame, weights: DataFrame, *ids: str) -> DataFrame:
    """(ids, p) of candidates (ids, kind, features) under the classifier."""
    each = cands.select(*ids, "kind", F.explode("features").alias("bucket"))
    score = each.join(F.broadcast(weights), ["kind", "bucket"]).groupBy(*ids).agg((F.sum("weight") + F.first("prior")).alias("s"))  # at most BUCKETS rows a kind
    return score.select(*ids, (1 / (1 + F.exp(-F.col("s")))).alias("p"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row a row of documents.

    Counts and hash are of the strict spans; spans also has the loose ones that the classifier takes and that no strict span overlaps.
    Null and empty texts have none; texts are scanned whole, in time near-linear in their length and matches; of spans with one start the kind
    listed first comes first; repeated rows stay; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    every = [_candidates(F.col("text"), k, True) for k in KINDS] + [_candidates(F.col("text"), k, False) for k in LOOSE]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.concat(*every).cast(_CANDIDATES).alias("found"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")
    cands = votes(rows.select("row", F.inline("found"))).withColumn("features", features()).select("row", "start", "ord", "kind", "end", "strict", "base", "votes", "features")
    cands = materialize(cands, "votes")
    labelled = cands.join(F.broadcast(posteriors(cands)), ["kind", "votes"])  # 81 rows a kind at most
    weights = materialize(span_classifier(labelled), "weights")
    loose = cands.where("not strict")
    ids = ["row", "start", "ord", "kind", "end"]
    taken = materialize(probabilities(loose, weights, *ids).where(F.col("p") >= ACCEPT).select(*ids, F.lit(False).alias("base")), "taken")
    beside = cands.where("base").join(taken.select("row").distinct(), "row", "left_semi").select(*ids, "base").union(taken)
    order = Window.partitionBy("row").orderBy("start", F.col("base").desc())
    ends = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = beside.withColumn("ends", ends).withColumn("starts", starts).where(~F.col("base") & (F.coalesce("ends", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("starts") >= F.col("end"), F.lit(True)))
    more = clear.groupBy("row").agg(F.collect_set(F.struct("start", "ord", "kind", "end")).alias("more"))
    base = F.transform(F.filter("found", lambda c: c["base"]), lambda c: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["kind"].alias("kind"), c["end"].alias("end")))
    rows = rows.select("row", "doc_id", base.alias("base")).join(more, "row", "left")
    n = [number_of("base", k) for k in KINDS]
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))
    return rows.select("doc_id", *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
