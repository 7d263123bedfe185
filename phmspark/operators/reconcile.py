"""Reconciliation: full outer joins that say how two tables differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivoted(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot(keys, fields, "field", "x")


def reconcile(old: DataFrame, new: DataFrame, keys: list[str], tolerance: dict[str, tuple[float, float]]) -> DataFrame:
    """keys, field, old, new, status (same, changed, added, removed): same is within atol + rtol * |old|."""
    fields = list(tolerance)
    a = unpivoted(old, keys, fields).withColumnRenamed("x", "old").withColumn("_a", F.lit(True))
    b = unpivoted(new, keys, fields).withColumnRenamed("x", "new").withColumn("_b", F.lit(True))
    bound = F.lit(0.0)
    for f, (at, rt) in tolerance.items():
        bound = F.when(F.col("field") == f, F.lit(at) + F.lit(rt) * F.abs("old")).otherwise(bound)
    near = F.col("old").eqNullSafe(F.col("new")) | F.coalesce(F.abs(F.col("old") - F.col("new")) <= bound, F.lit(False))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(near, "same").otherwise("changed")
    return a.join(b, [*keys, "field"], "full_outer").select(*keys, "field", "old", "new", status.alias("status"))


def compare_ids(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, left, right and status (same, changed, left_only, right_only) by null-safe equality."""
    x = a.select(*keys, F.col(value).alias("left"), F.lit(True).alias("_a"))
    y = b.select(*keys, F.col(value).alias("right"), F.lit(True).alias("_b"))
    status = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").when(F.col("left").eqNullSafe(F.col("right")), "same").otherwise("changed")
    return x.join(y, keys, "full_outer").select(*keys, "left", "right", status.alias("status"))


def range_origins(rows: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, stop: str, width: int = 1000) -> DataFrame:
    """Each row with the range [start, stop) of its keys that holds it. Ranges are cut at multiples of ``width`` and meet
    rows by an equi-join on the cut, so no row meets every range."""
    cut = ranges.filter(F.col(stop) > F.col(start)).withColumn("_cut", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))))
    return rows.withColumn("_cut", F.floor(F.col(at) / width)).join(cut, [*keys, "_cut"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("_cut")
