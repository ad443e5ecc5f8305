"""Rule-based classifiers: thresholds on columns, given as tables and folded into CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(value: Column, table: list[tuple[float, str]], last: str, above: bool = True) -> Column:
    """The name of the first row whose bound is reached (value >= bound), or undercut (value < bound) if not `above`; else `last`."""
    out: Column | None = None
    for bound, name in table:
        hit = value >= bound if above else value < bound
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(last)


def pair_stability(similarity: Column) -> Column:
    return steps(similarity, [(0.95, "minimal"), (0.90, "slight"), (0.80, "moderate")], "significant")


def overall_stability(score: Column) -> Column:
    return steps(score, [(0.95, "highly_stable"), (0.90, "stable"), (0.80, "moderate_change")], "significant_change")


def wetness_index(area: Column, slope_deg: Column) -> Column:
    """ln(area + 1) - ln(tan(slope) + 0.001), with pi as 3.14159 as the source has it."""
    return F.ln(area + 1) - F.ln(F.tan(slope_deg * F.lit(3.14159 / 180)) + 0.001)


def pooling_risk(twi: Column) -> Column:
    return steps(twi, [(5, "LOW"), (7, "MODERATE"), (9, "HIGH")], "SEVERE", above=False)


def high_risk_percent(twi: Column) -> Column:
    return F.when(twi < 5, 5.0).when(twi < 7, 15.0).when(twi < 9, 35.0).otherwise(60.0)


def water_assessment(balance: Column) -> Column:
    """surplus, marginal, slight, moderate or severe."""
    return F.when(balance > 300, "surplus").when(balance > 0, "marginal").when(balance > -200, "slight").when(balance > -500, "moderate").otherwise("severe")


def irrigation_needed(balance: Column) -> Column:
    return ~(balance > 0)


def moisture_index(vv_db: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (vv_db + 20) / 15))


def moisture_status(index: Column) -> Column:
    return steps(index, [(0.2, "DRY"), (0.4, "MODERATELY_DRY"), (0.6, "OPTIMAL"), (0.8, "WET")], "SATURATED", above=False)


def compass(aspect: Column) -> Column:
    """Eight directions in sectors of 45 degrees around them."""
    return F.when((aspect < 22.5) | (aspect >= 337.5), "N").otherwise(steps(aspect, [(67.5, "NE"), (112.5, "E"), (157.5, "SE"), (202.5, "S"), (247.5, "SW"), (292.5, "W")], "NW", above=False))


def heat_stress_index(aspect: Column, lat: Column) -> Column:
    north = lat > 0
    base = (
        F.when((aspect >= 225) & (aspect < 315), 1.0)
        .when((aspect >= 202.5) & (aspect < 337.5), 0.7)
        .when((aspect >= 157.5) & (aspect < 202.5), F.when(north, 0.5).otherwise(0.3))
        .when((aspect >= 45) & (aspect < 135), 0.2)
        .otherwise(F.when(north, 0.3).otherwise(0.5))
    )
    return F.least(F.lit(1.0), base * F.when(F.abs(lat) < 15, 1.2).when(F.abs(lat) < 25, 1.0).otherwise(0.8))


def heat_stress_level(index: Column) -> Column:
    return steps(index, [(0.3, "LOW"), (0.5, "MODERATE"), (0.7, "HIGH")], "SEVERE", above=False)


def soil(phh2o: Column, soc: Column, nitrogen: Column, sand: Column, clay: Column, silt: Column) -> Column:
    """struct of scaled soil values, type and drainage; null and zero inputs take the defaults."""
    value = lambda c, default, scale: F.coalesce(F.nullif(c, F.lit(0)), F.lit(default)) / scale
    ph, organic, n = value(phh2o, 65, 10), value(soc, 20, 10), value(nitrogen, 2, 100)
    s, c, t = value(sand, 40, 10), value(clay, 30, 10), value(silt, 30, 10)
    kind = F.when(s > 70, "Sandy").when(c > 40, "Clay").when(organic > 3, "Organic-rich Loam").otherwise("Loam")
    drainage = F.when(s > 70, "Excessive").when(c > 40, "Poor").when(organic > 3, "Good").otherwise("Moderate")
    return F.struct(F.round(ph, 1).alias("ph"), F.round(organic, 1).alias("organic_carbon"), F.round(n, 2).alias("nitrogen"), F.round(s, 1).alias("sand"), F.round(c, 1).alias("clay"), F.round(t, 1).alias("silt"), kind.alias("soil_type"), drainage.alias("drainage"))


def _penalty(hit: Column, points: float) -> Column:
    return F.when(hit, F.lit(points)).otherwise(F.lit(0.0))


def suitability_level(score: Column) -> Column:
    return steps(score, [(3.5, "EXCELLENT"), (2.5, "GOOD"), (1.5, "MODERATE")], "POOR")


def biophysical(risk: Column, balance: Column, moisture: Column, heat: Column, direction: Column) -> Column:
    """struct(score, level, concerns): starts at 4 and loses points for water, moisture and heat."""
    wet, dry = risk.isin("HIGH", "SEVERE"), irrigation_needed(balance) & (balance < -200)
    soil_hit, hot = moisture.isin("DRY", "SATURATED"), heat.isin("HIGH", "SEVERE")
    score = F.lit(4.0) - _penalty(wet, 1.0) - _penalty(dry, 1.0) - _penalty(soil_hit, 0.5) - _penalty(hot, 0.5)
    said = [
        F.when(wet, F.concat(F.lit("High waterlogging risk (TWI: "), risk, F.lit(")"))),
        F.when(dry, F.concat(F.lit("Significant water deficit ("), F.rint(balance).cast("long").cast("string"), F.lit("mm)"))),
        F.when(soil_hit, F.concat(F.lit("Current soil moisture: "), moisture)),
        F.when(hot, F.concat(F.lit("High heat stress ("), direction, F.lit("-facing slope)"))),
    ]
    return _verdict(score, said, "No significant biophysical concerns identified")


def land_suitability(risk: Column, balance: Column, moisture: Column, heat: Column, rain: Column, temp_max: Column, ph: Column, drainage: Column) -> Column:
    """struct(score, level, concerns): as biophysical(), and half a point each for low rain, heat, pH and drainage."""
    wet, dry = risk.isin("HIGH", "SEVERE"), irrigation_needed(balance) & (balance < -200)
    soil_hit, hot = moisture.isin("DRY", "SATURATED"), heat.isin("HIGH", "SEVERE")
    low_rain, high_temp, bad_ph, poor = rain < 800, temp_max > 35, (ph < 5.0) | (ph > 7.5), drainage == "Poor"
    score = F.lit(4.0) - _penalty(wet, 1.0) - _penalty(dry, 1.0) - sum((_penalty(x, 0.5) for x in (soil_hit, hot, low_rain, high_temp, bad_ph, poor)), F.lit(0.0))
    whole = lambda v: F.rint(v).cast("long").cast("string")
    said = [
        F.when(wet, F.concat(F.lit("Waterlogging risk: "), risk)),
        F.when(dry, F.concat(F.lit("Water deficit: "), whole(balance), F.lit("mm"))),
        F.when(soil_hit, F.concat(F.lit("Soil moisture: "), moisture)),
        F.when(hot, F.concat(F.lit("Heat stress: "), heat)),
        F.when(low_rain, F.concat(F.lit("Low rainfall: "), whole(rain), F.lit("mm/year"))),
        F.when(high_temp, F.concat(F.lit("High temps: "), whole(temp_max), F.lit("°C max"))),
        F.when(bad_ph, F.concat(F.lit("Soil pH: "), ph.cast("string"))),
        F.when(poor, F.lit("Poor drainage")),
    ]
    return _verdict(score, said, "No significant concerns")


def _verdict(score: Column, said: list[Column], nothing: str) -> Column:
    concerns = F.array_compact(F.array(*said))
    return F.struct(score.alias("score"), suitability_level(score).alias("level"), F.when(F.size(concerns) > 0, concerns).otherwise(F.array(F.lit(nothing))).alias("concerns"))


def match_quality(similarity: Column) -> Column:
    return steps(similarity, [(0.90, "EXCELLENT"), (0.80, "GOOD"), (0.70, "MODERATE")], "LOW")


def match_confidence(similarity: Column) -> Column:
    return steps(similarity, [(0.90, "HIGH"), (0.80, "MEDIUM"), (0.70, "LOW")], "VERY LOW")


def signal_verdict(ratio: Column) -> Column:
    return F.when(ratio > 1.5, "GOOD").when(ratio > 1.1, "MODERATE").otherwise("WEAK")


def rank_verdict(percentile: Column) -> Column:
    return F.when(percentile > 90, "EXCELLENT").when(percentile > 75, "GOOD").when(percentile > 50, "MODERATE").otherwise("POOR")
