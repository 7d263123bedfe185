"""Exact quantiles that no task needs a whole group for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phmspark.sources.scratch import written

BESIDE_CELLS = 100_000  # numbers of a table of groups that travels to the rows


def beside(rows: DataFrame, few: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """``rows`` with the columns of ``few``, a written table of a row of about ``cells`` numbers for each group. As long as it
    is small it travels to the rows, so that no task gets all rows of a group; beyond that, groups are many."""
    if not keys:
        return rows.crossJoin(F.broadcast(few))  # one row
    return rows.join(F.broadcast(few) if few.count() * cells <= BESIDE_CELLS else few, keys)


def exact_quantiles(df: DataFrame, keys: list[str], value: str | list[str], qs: list[float], accuracy: int = 2000) -> DataFrame:
    """keys, q and x (and col, where ``value`` is a list of columns): linearly interpolated quantiles of the non-null
    values. Rows with a null key are left out, and columns without a value.

    Approximate quantiles give each wanted one a window of about ``4 / accuracy`` of its group; the rows below the
    windows are counted, and only the distinct values inside are put in order, so neither a large group nor a value that
    many rows have meets in a task. Where a window should miss its ranks it is the whole group: the result is exact
    whatever the approximation is worth.
    """
    cols = [value] if isinstance(value, str) else value
    df = df.select(*keys, *(F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(cols)))
    if len(cols) == 1:
        df = df.filter("_x0 IS NOT NULL")
    qs = sorted(set(float(q) for q in qs))
    every = [(j, k) for j in range(len(cols)) for k in range(len(qs))]
    around = [min(1.0, max(0.0, q + side * 2 / accuracy)) for q in qs for side in (-1, 1)]
    grid = written(df.groupBy(*keys).agg(*(F.percentile_approx(f"_x{j}", around, accuracy).alias(f"_g{j}") for j in range(len(cols)))), "grid")
    held = beside(df, grid, keys, 2 * len(every))
    x, low, high = lambda j: F.col(f"_x{j}"), lambda j, k: F.col(f"_g{j}")[2 * k], lambda j, k: F.col(f"_g{j}")[2 * k + 1]
    counts = held.groupBy(*keys).agg(
        *(F.count(x(j)).alias(f"_n{j}") for j in range(len(cols))),
        *(c for j, k in every for c in (F.count_if(x(j) < low(j, k)).alias(f"_b{j}_{k}"), F.count_if(x(j) <= high(j, k)).alias(f"_u{j}_{k}"))),
    )
    counts = beside(counts, grid, keys, 2 * len(every))  # carried through the aggregate, arrays would have it sort all rows
    asked = []
    for j, k in every:
        last = F.col(f"_n{j}") - 1
        at = F.lit(qs[k]) * last
        upper = F.least(F.floor(at) + 1, last)
        fits = (F.col(f"_b{j}_{k}") <= F.floor(at)) & (F.col(f"_u{j}_{k}") > upper)
        window = (F.when(fits, low(j, k)).otherwise(float("-inf")).alias("a"), F.when(fits, high(j, k)).otherwise(float("nan")).alias("b"))  # NaN is above all
        asked.append(F.struct(F.lit(cols[j]).alias("col"), F.lit(qs[k]).alias("q"), at.alias("at"), F.floor(at).alias("low"), upper.alias("high"), *window, F.when(fits, F.col(f"_b{j}_{k}")).otherwise(0).alias("below")))
    windows = written(counts.select(*keys, F.array(*asked).alias("_w")), "windows")
    met = beside(df, windows, keys, 8 * len(every))
    within = [(x(j) >= F.col("_w")[i]["a"]) & (x(j) <= F.col("_w")[i]["b"]) for i, (j, _) in enumerate(every)]
    some = within[0]
    for w in within[1:]:
        some |= w
    found = F.array(*(F.when(w, F.struct(F.col("_w")[i].alias("k"), x(j).alias("x"))) for (i, (j, _)), w in zip(enumerate(every), within, strict=True)))
    inside = met.filter(some).select(*keys, F.explode(found).alias("_f")).filter("_f IS NOT NULL").select(*keys, F.col("_f.k").alias("_k"), F.col("_f.x").alias("_x"))
    distinct = inside.groupBy(*keys, "_k", "_x").agg(F.count("*").alias("_c"))
    upto = F.col("_k.below") + F.sum("_c").over(Window.partitionBy(*keys, "_k").orderBy("_x"))
    ranked = distinct.withColumn("_to", upto).withColumn("_from", upto - F.col("_c"))
    at_rank = lambda name: F.when((F.col("_from") <= F.col(f"_k.{name}")) & (F.col(f"_k.{name}") < F.col("_to")), F.col("_x"))
    ends = ranked.groupBy(*keys, "_k").agg(F.max(at_rank("low")).alias("_low"), F.max(at_rank("high")).alias("_high"))
    share = F.col("_k.at") - F.col("_k.low")
    col = [] if isinstance(value, str) else [F.col("_k.col").alias("col")]
    return ends.select(*keys, *col, F.col("_k.q").alias("q"), F.when(share == 0, F.col("_low")).otherwise(F.col("_low") * (1 - share) + F.col("_high") * share).alias("x"))


def bounds(df: DataFrame, keys: list[str], cols: list[str], scale: float) -> DataFrame:
    """keys, col, low, high: quartiles less and plus ``scale`` times their distance, of every column."""
    q = exact_quantiles(df, keys, cols, [0.25, 0.75]).groupBy(*keys, "col").agg(F.min("x").alias("q1"), F.max("x").alias("q3"))
    return q.select(*keys, "col", (F.col("q1") - scale * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + scale * (F.col("q3") - F.col("q1"))).alias("high"))


def iqr_filter(df: DataFrame, cols: list[str], keys: list[str], scale: float = 1.5) -> DataFrame:
    """Rows whose every column is within its group's bounds; bounds come from the unfiltered columns; edges stay."""
    wide = written(bounds(df, keys, cols, scale).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("low", "high")))).alias("_b")), "bounds")
    held = beside(df, wide, keys, 3 * len(cols))
    inside = F.lit(True)
    for c in cols:
        inside &= F.col(c).between(F.col("_b")[c]["low"], F.col("_b")[c]["high"])
    return held.filter(inside).drop("_b")
