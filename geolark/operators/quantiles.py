"""Exact quantiles in bounded memory, of a column or of each group of one."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Ranges into which a pass cuts what is left of a quantile's range.
BINS = 1024
LARGEST = sys.float_info.max


def exact_quantiles(rows: DataFrame, value: str, probabilities: list[float], group: str | None = None, bins: int = BINS) -> DataFrame:
    """(group, n, q0, q1, ...): the interpolated quantiles of `value` as doubles, a column for each of `probabilities`; without a group one row.

    The values at the two ranks around a quantile are found by narrowing: a pass counts the values of a range in `bins` parts by one
    aggregation, and the part that holds the rank, cut down to its smallest and largest value, is the next range, until it is a single
    value. No task keeps more than a row a part; a group may hold most rows. Nulls, NaN and infinite values take no part; groups
    without values have no row; no rows at all give none.
    """
    base = rows.select((F.col(group) if group else F.lit(None).cast("int")).alias("g"), F.col(value).cast("double").alias("v"))
    base = written(base.where(F.col("v").isNotNull() & (F.abs("v") <= LARGEST)), "values")
    sizes = written(base.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    at = F.col("p") * (F.col("n") - 1)
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)]))
    wanted = sizes.select("g", "n", "lo", "hi", asked.alias("a")).select("g", "n", "lo", "hi", "a.i", "a.p").withColumn("exact", at)
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    state = wanted.withColumn("side", both).withColumn("rank", F.when(F.col("side") == 0, F.floor("exact")).otherwise(F.ceil("exact"))).select("g", "i", "side", "rank", "lo", "hi")
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    share = F.when(hi - lo <= LARGEST, (v - lo) / (hi - lo)).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))  # the ends fall into different parts
    part = F.least(F.floor(share * bins), F.lit(bins - 1))
    upto = F.sum("c").over(Window.partitionBy("g", "i", "side").orderBy("part"))  # at most `bins` rows
    while True:
        state = written(state, "ranges")
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        met = base.join(open_, base["g"].eqNullSafe(open_["g"]) & F.col("v").between(F.col("lo"), F.col("hi"))).select(open_["g"], "i", "side", "rank", "v", part.alias("part"))
        counted = met.groupBy("g", "i", "side", "rank", "part").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        found = counted.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        state = state.where("lo >= hi").union(found.select("g", "i", "side", F.col("rank") - (F.col("upto") - F.col("c")), "lo", "hi"))
    ends = state.groupBy("g", "i").agg(F.max(F.when(F.col("side") == 0, F.col("lo"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("lo"))).alias("b"))
    joined = wanted.withColumnRenamed("g", "_g").withColumnRenamed("i", "_i").join(ends, F.col("g").eqNullSafe(F.col("_g")) & (F.col("i") == F.col("_i")))
    above = F.col("exact") - F.floor("exact")
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - above) * F.col("a") + above * F.col("b"))
    out = joined.groupBy("g").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == k, between)).alias(f"q{k}") for k in range(len(probabilities))])
    return out.withColumnRenamed("g", group) if group else out.drop("g")
