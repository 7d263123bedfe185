"""Ranks by hash, splits and draws: alike for every partitioning and row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_of(seed, *ids) -> Column:
    """md5 of the seed and ids; text in either engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids)))


def hash_rank(df: DataFrame, keys: list[str], id_col: str, seed=42, out: str = "r", count: str | None = "n", digits: int = 3) -> DataFrame:
    """``df`` with each row's rank from 0 by hash within ``keys``, and the number of rows of its group.

    The order of the hashes' first ``digits`` hex digits deals every group into up to 16**digits parts; ranks inside the
    parts are shifted by the rows of the parts before. So no task sorts a whole group, however few groups there are.
    """
    hashed = df.withColumn("_h", hash_of(seed, id_col)).withColumn("_part", F.substring("_h", 1, digits))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sizes = hashed.groupBy(*keys, "_part").agg(F.count("*").alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).withColumn("_rows", F.sum("_k").over(whole)).drop("_k")
    inner = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h", id_col)) - 1
    ranked = hashed.withColumn("_rank", inner).join(sizes, [*keys, "_part"])
    ranked = ranked.withColumn(out, (F.col("_rank") + F.col("_before")).cast("long"))
    return (ranked.withColumn(count, F.col("_rows").cast("long")) if count else ranked).drop("_h", "_part", "_rank", "_before", "_rows")


def first_by_hash(df: DataFrame, keys: list[str], id_col: str, n: int, seed=42, digits: int = 3) -> DataFrame:
    """``df`` with r, each row's rank from 0 by hash within ``keys``, of the first ``n`` rows of each group: as ``hash_rank``,
    but only the parts of a group that hold these are moved."""
    from phmspark.operators import quantiles
    from phmspark.sources.scratch import written

    hashed = df.withColumn("_part", F.substring(hash_of(seed, id_col), 1, digits))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy(*keys, "_part").agg(F.count("*").alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    last = written(sizes.filter(F.col("_before") < n).groupBy(*keys).agg(F.max("_part").alias("_last")), "parts")
    some = quantiles.beside(hashed, last, keys, 1).filter(F.col("_part") <= F.col("_last")).drop("_part", "_last")
    return hash_rank(some, keys, id_col, seed, count=None, digits=digits).filter(F.col("r") < n)


def placed(df: DataFrame, by: list[str], out: str = "n") -> DataFrame:
    """``df`` with each row's number from 1 in the order of ``by``: ranges are numbered each by itself, and the counts of
    those before are added, so that no task sorts all rows."""
    from phmspark.sources.scratch import written

    spread = written(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()), "ordered")
    counts = spread.groupBy("_p").agg(F.count("*").alias("_k"))
    before = counts.select("_p", (F.sum("_k").over(Window.orderBy("_p")) - F.col("_k")).alias("_from"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*by))
    return spread.withColumn("_own", own).join(F.broadcast(before), "_p").withColumn(out, (F.col("_from") + F.col("_own")).cast("long")).drop("_p", "_own", "_from")


def with_role(df: DataFrame, keys: list[str], id_col: str, seed=42, train: float = 0.6, cal: float = 0.2) -> DataFrame:
    """role: train (floor(train * n)), cal (floor(cal * n), 1 at least) or holdout (the rest), by hash within ``keys``."""
    n_train, n_cal = F.floor(F.lit(train) * F.col("n")), F.greatest(F.lit(1), F.floor(F.lit(cal) * F.col("n")))
    role = F.when(F.col("r") < n_train, "train").when(F.col("r") < n_train + n_cal, "cal").otherwise("holdout")
    return hash_rank(df, keys, id_col, seed).withColumn("role", role)


def stream_eval(df: DataFrame, keys: list[str], id_col: str, seed=7, share: float = 0.2) -> DataFrame:
    """part: eval for ceil(share * n) rows of each group, stream for the others."""
    return hash_rank(df, keys, id_col, seed).withColumn("part", F.when(F.col("r") < F.ceil(F.lit(share) * F.col("n")), "eval").otherwise("stream"))


def support_eval(df: DataFrame, keys: list[str], id_col: str, n: int, seed=11, least: int = 5) -> DataFrame:
    """part: support for ``n`` rows of each group, eval for the others; groups need more than ``n`` rows, ``n`` at least 5."""
    if n < least:
        raise ValueError(f"a support of {n} rows is too small; {least} are needed")
    return hash_rank(df, keys, id_col, seed).filter(F.col("n") > n).withColumn("part", F.when(F.col("r") < n, "support").otherwise("eval"))


def uniform(seed, *ids) -> Column:
    """A number in [0, 1) from the first seven hex digits of the hash."""
    return F.conv(F.substring(hash_of(seed, *ids), 1, 7), 16, 10).cast("double") / F.lit(float(16**7))


def replay(df: DataFrame, keys: list[str], id_col: str, laps: int, seed=3) -> DataFrame:
    """Every row once in each lap, in a new order each lap: lap and t (from 1, over all laps)."""
    dealt = df.withColumn("lap", F.explode(F.sequence(F.lit(1), F.lit(laps)))).withColumn("_lap_id", F.concat_ws(":", "lap", id_col))
    ranked = hash_rank(dealt, [*keys, "lap"], "_lap_id", seed, out="_r", count="_n")
    return ranked.withColumn("t", ((F.col("lap") - 1) * F.col("_n") + F.col("_r") + 1).cast("long")).drop("_lap_id", "_r", "_n")
