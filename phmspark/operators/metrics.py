"""Evaluation metrics over histograms of distinct scores: windows never run over rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _beside(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """``a`` joined to ``b``; null keys meet."""
    b = b.withColumnsRenamed({c: f"_b_{c}" for c in on})
    met = F.lit(True)
    for c in on:
        met &= a[c].eqNullSafe(b[f"_b_{c}"])
    return a.join(b, met).drop(*(f"_b_{c}" for c in on))


def histogram(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """keys, score, p, q (positives and negatives at the score), tp, fp (at it or above), np, nq (in all). Distinct scores
    are dealt to ranges; a task sorts one range, to which the sums of those above are added."""
    h = df.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    grid = h.groupBy(*keys).agg(F.percentile_approx(score, [k / 64 for k in range(1, 64)], 1000).alias("_grid"))
    part = F.coalesce(F.size(F.filter("_grid", lambda g: g < F.col(score))), F.lit(0))
    dealt = _beside(h, grid, keys).withColumn("_part", part).drop("_grid")
    whole = Window.partitionBy(*keys)
    above = whole.orderBy(F.desc("_part"))  # 64 rows of a key at most
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    sums = parts.select(*keys, "_part", (F.sum("_p").over(above) - F.col("_p")).alias("_tp"), (F.sum("_q").over(above) - F.col("_q")).alias("_fp"), F.sum("_p").over(whole).alias("np"), F.sum("_q").over(whole).alias("nq"))
    own = Window.partitionBy(*keys, "_part").orderBy(F.desc(score))
    met = _beside(dealt, sums, [*keys, "_part"])
    return met.select(*keys, score, "p", "q", (F.sum("p").over(own) + F.col("_tp")).alias("tp"), (F.sum("q").over(own) + F.col("_fp")).alias("fp"), "np", "nq")


def auroc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """keys, auroc: ties count half; null where a class is missing."""
    h = histogram(df, keys, score, positive)
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p")) + F.col("q") * F.col("p") / 2)
    return h.groupBy(*keys).agg((area / F.nullif(F.max(F.col("np") * F.col("nq")).cast("double"), F.lit(0.0))).alias("auroc"))


def openset_metrics(df: DataFrame, keys: list[str], score: str, positive: str, threshold: float = 1.0, tpr: float = 0.95) -> DataFrame:
    """auroc, aupr, fpr95, known_accuracy, accuracy, precision, recall, f1; positives are unknown rows, flagged where
    the score is above (not at) the threshold. Ratios over nothing are 0; fpr95 is 1 where the rate is never reached."""
    h = histogram(df, keys, score, positive)
    ranked = h.groupBy(*keys).agg(
        (F.sum(F.col("q") * (F.col("tp") - F.col("p")) + F.col("q") * F.col("p") / 2) / F.nullif(F.max(F.col("np") * F.col("nq")).cast("double"), F.lit(0.0))).alias("auroc"),
        F.sum(F.col("p") / F.nullif(F.col("np").cast("double"), F.lit(0.0)) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("aupr"),
        F.coalesce(F.min(F.when(F.col("tp") / F.nullif(F.col("np").cast("double"), F.lit(0.0)) >= tpr, F.col("fp") / F.nullif(F.col("nq").cast("double"), F.lit(0.0)))), F.lit(1.0)).alias("fpr95"),
    )
    flagged, pos = F.col(score) > threshold, F.col(positive)
    n = df.groupBy(*keys).agg(F.count_if(~pos & ~flagged).alias("tn"), F.count_if(~pos & flagged).alias("fp"), F.count_if(pos & flagged).alias("tp"), F.count_if(pos & ~flagged).alias("fn"))
    part = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    tn, fp, tp, fn = (F.col(c) for c in ("tn", "fp", "tp", "fn"))
    told = n.select(*keys, part(tn, tn + fp).alias("known_accuracy"), part(tn + tp, tn + fp + tp + fn).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))
    return ranked.join(told, keys)


def confusion(df: DataFrame, keys: list[str], truth: str, pred: str, labels: list) -> DataFrame:
    """keys, truth, pred, n over the whole grid of the labels; outcomes outside it are not counted."""
    grid = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    one = lambda c: F.explode(F.array(*map(F.lit, labels))).alias(c)
    grid = grid.select(*keys, one(truth)).select("*", one(pred))
    n = df.groupBy(*keys, truth, pred).agg(F.count("*").alias("n"))
    return grid.join(n, [*keys, truth, pred], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def per_class(counts: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """keys, accuracy, balanced_accuracy (mean recall of the classes there are), macro_f1 (of all labels met)."""
    t = counts.groupBy(*keys, F.col(truth).alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)).alias("hit"))
    p = counts.groupBy(*keys, F.col(pred).alias("c")).agg(F.sum("n").alias("p"))
    both = t.join(p, [*keys, "c"], "full_outer").fillna(0, ["t", "hit", "p"]).filter("t + p > 0")
    recall, f1 = F.when(F.col("t") > 0, F.col("hit") / F.nullif(F.col("t").cast("double"), F.lit(0.0))), 2 * F.col("hit") / (F.col("t") + F.col("p"))
    return both.groupBy(*keys).agg((F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


def label_f1(counts: DataFrame, keys: list[str], truth: str, pred: str, label) -> DataFrame:
    """keys, f1 of one label (0 where neither truth nor prediction has it)."""
    t, p = F.col(truth) == F.lit(label), F.col(pred) == F.lit(label)
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    return counts.groupBy(*keys).agg(F.coalesce(2 * part(t & p) / F.nullif(part(t) + part(p), F.lit(0.0)), F.lit(0.0)).alias("f1"))


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank from 1 within ``keys``; equal values share the mean of their ranks."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def histogram_ranks(df: DataFrame, x: str) -> DataFrame:
    """x and its average rank: over distinct values, in ranges, so that no task sorts all of them."""
    h = df.groupBy(x).agg(F.count("*").alias("n"))
    grid = h.agg(F.percentile_approx(x, [k / 64 for k in range(1, 64)], 1000).alias("_grid"))
    dealt = h.crossJoin(F.broadcast(grid)).withColumn("_part", F.size(F.filter("_grid", lambda g: g < F.col(x)))).drop("_grid")
    parts = dealt.groupBy("_part").agg(F.sum("n").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    dealt = dealt.join(F.broadcast(parts), "_part")  # 64 rows at most
    before = F.col("_from") + F.sum("n").over(Window.partitionBy("_part").orderBy(x)) - F.col("n")
    return dealt.select(x, (before + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: correlation of the average ranks."""
    ra, rb = histogram_ranks(df, a).withColumnRenamed("rank", "_ra"), histogram_ranks(df, b).withColumnRenamed("rank", "_rb")
    return df.join(ra, a).join(rb, b).agg(F.corr("_ra", "_rb").alias("spearman"))


def signed_rank(pairs: DataFrame, diff: str, exact: int = 50) -> DataFrame:
    """One row n, statistic, mean, p of paired differences (null: no pair): the smaller sum of the average ranks of either
    sign over the differences that are not 0, and its two-sided p. Up to ``exact`` of those p counts all signs, ties
    included, over doubled ranks; beyond it is normal with the ties' correction. Without pairs all but n is null; with
    zeros only the statistic is 0 and p is 1. mean is over all pairs, n counts them."""
    there = pairs.select(F.col(diff).cast("double").alias("x")).filter("x IS NOT NULL")
    moved = there.filter("x <> 0").withColumn("size", F.abs("x"))
    ranks = histogram_ranks(moved, "size")
    r = moved.join(ranks, "size")
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("rank"))), F.lit(0.0))
    whole = there.agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    told = r.agg(F.count("*").alias("m"), F.least(side(F.col("x") > 0), side(F.col("x") < 0)).alias("w"))
    ties = moved.groupBy("size").agg(F.count("*").cast("double").alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0.0)).alias("ties"))
    row = whole.crossJoin(F.broadcast(told)).crossJoin(F.broadcast(ties)).first()  # one row each
    n, mean, m, w = row["n"], row["mean"], row["m"], row["w"]
    if n == 0:
        statistic = p = None
    elif m == 0:
        statistic, p = 0.0, 1.0
    elif m <= exact:
        statistic, p = w, exact_signed_rank_p([x["rank"] for x in r.select("rank").collect()], w)  # at most ``exact`` ranks
    else:
        sd = math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - row["ties"] / 48)
        statistic, p = w, min(1.0, math.erfc((m * (m + 1) / 4 - w) / sd / math.sqrt(2)))
    return pairs.sparkSession.createDataFrame([(n, statistic, mean, p)], "n long, statistic double, mean double, p double")


def exact_signed_rank_p(ranks: list[float], statistic: float) -> float:
    """Share of all signs of the ranks whose smaller sum is at most the statistic."""
    double = [round(2 * x) for x in ranks]
    ways = [1] + [0] * sum(double)
    for x in double:
        for s in range(len(ways) - 1, x - 1, -1):
            ways[s] += ways[s - x]
    return min(1.0, 2 * sum(ways[: round(2 * statistic) + 1]) / 2 ** len(ranks))
