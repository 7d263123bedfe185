"""Open-set decision: distances to known classes over their calibrated thresholds. Above 1 (not at 1) is unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phmspark.operators.quantiles import exact_quantiles


def thresholds(cal: DataFrame, cls: str, d: str, confidence: float = 0.95) -> DataFrame:
    """cls, threshold: quantile of the calibration rows' distance to their own class."""
    return exact_quantiles(cal, [cls], d, [confidence]).select(cls, F.col("x").alias("threshold"))


def decide(long: DataFrame, thresholds_: DataFrame, row: str, cls: str, d: str) -> DataFrame:
    """row, score, nearest, verdict of rows' distances to every class (row, cls, d). Ties go to the smaller class."""
    ratio = F.col(d) / F.greatest(F.col("threshold"), F.lit(1e-12))
    best = long.join(thresholds_, cls).groupBy(row).agg(F.min(F.struct(ratio.alias("score"), F.col(cls).alias("nearest"))).alias("b"))
    return best.select(row, "b.score", "b.nearest", F.when(F.col("b.score") > 1, "unknown").otherwise("known").alias("verdict"))


def calibrated(rows: DataFrame, keys: list[str], raw: str, is_cal, confidence: float = 0.95) -> DataFrame:
    """``rows`` with score: raw over the calibration quantile; where that is not positive, all are shifted above 0 first."""
    cal = rows.filter(is_cal)
    t = exact_quantiles(cal, keys, raw, [confidence]).select(*keys, F.col("x").alias("_t"))
    low = cal.groupBy(*keys).agg(F.min(raw).alias("_low"))
    fit = (t.join(low, keys) if keys else t.crossJoin(F.broadcast(low))).withColumn("_shift", F.when(F.col("_t") > 0, 0.0).otherwise(1e-9 - F.col("_low")))
    held = rows.join(fit, keys) if keys else rows.crossJoin(F.broadcast(fit))
    return held.withColumn("score", (F.col(raw) + F.col("_shift")) / (F.col("_t") + F.col("_shift"))).drop("_t", "_low", "_shift")
