"""Means, covariances and Mahalanobis models by group, at any width, without gathering a group's rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def means(df: DataFrame, keys: list[str], f: str = "f") -> DataFrame:
    """keys, n, mu: componentwise means."""
    long = df.select(*keys, F.posexplode(f).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("_m"), F.count("*").alias("_n"))
    return long.groupBy(*keys).agg(F.max("_n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "_m"))), lambda r: r["_m"]).alias("mu"))


def moments(df: DataFrame, keys: list[str], f: str = "f") -> DataFrame:
    """keys, n, mu, gram (flat, of centred rows), fourth (sum of the centred rows' squared square lengths).

    Two passes, so that large means cost no digits: means, then sums of products, formed for each batch of rows in
    NumPy and added up cell by cell over the cluster. The means travel to the rows while they are few."""
    from phmspark.operators.quantiles import beside
    from phmspark.sources.scratch import written

    mu = written(means(df, keys, f), "means")
    wide = mu.select(F.size("mu")).first()
    centred = beside(df, mu, keys, wide[0] if wide else 1)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(keys, sort=False, dropna=False) if keys else [((), batch)]:
                x = np.stack(part[f].to_numpy()) - part["mu"].iloc[0]
                row = dict(zip(keys, key if isinstance(key, tuple) else (key,), strict=True))
                yield pd.DataFrame([row | {"gram": (x.T @ x).ravel(), "fourth": float(((x * x).sum(axis=1) ** 2).sum())}])

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    parts = centred.select(*keys, f, "mu").mapInPandas(products, kinds + "gram array<double>, fourth double")
    cells = parts.select(*keys, F.posexplode("gram").alias("i", "x"), F.lit(0.0).alias("fourth")).unionByName(parts.select(*keys, F.lit(-1).alias("i"), F.lit(0.0).alias("x"), "fourth"))
    added = cells.groupBy(*keys, "i").agg(F.sum("x").alias("x"), F.sum("fourth").alias("fourth"))
    gram = added.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "x")))), lambda r: r["x"]).alias("gram"), F.sum("fourth").alias("fourth"))
    return mu.join(gram, keys) if keys else mu.crossJoin(F.broadcast(gram))


def shrunk(n: int, gram: np.ndarray, fourth: float, estimator: str) -> tuple[np.ndarray, float]:
    """Covariance and shrinkage: ledoit_wolf, oas, or pooled (unbiased, with a small ridge)."""
    p = len(gram)
    s = gram / n
    if estimator == "pooled":
        return gram / max(1, n - 1) + 1e-6 * np.eye(p), 0.0
    mu, square = np.trace(s) / p, float((s * s).sum())
    if estimator == "ledoit_wolf":
        delta = (square - 2 * mu * np.trace(s) + p * mu * mu) / p
        beta = min((fourth / n - square) / (p * n), delta)
        a = 0.0 if beta <= 0 or delta == 0 else beta / delta
    else:
        alpha = square / (p * p)
        below = (n + 1) * (alpha - mu * mu / p)
        a = 1.0 if below == 0 else min((alpha + mu * mu) / below, 1.0)
    return (1 - a) * s + a * mu * np.eye(p), a


def fit_mahalanobis(df: DataFrame, keys: list[str], f: str = "f", estimator: str = "ledoit_wolf") -> DataFrame:
    """keys, n, mu, precision (flat), shrinkage of each group; the matrices are inverted where their group's row is."""
    held = moments(df, keys, f)

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for n, gram, fourth in zip(batch["n"], batch["gram"], batch["fourth"], strict=True):
                p = int(round(len(gram) ** 0.5))
                c, a = shrunk(int(n), np.asarray(gram).reshape(p, p), fourth, estimator)
                rows.append((np.linalg.pinv(c, hermitian=True).ravel(), a))
            yield batch[[*keys, "n", "mu"]].assign(precision=[r[0] for r in rows], shrinkage=[r[1] for r in rows])

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return held.mapInPandas(invert, kinds + "n long, mu array<double>, precision array<double>, shrinkage double")


def whiten(rows: DataFrame, model: DataFrame, f: str = "f") -> DataFrame:
    """``rows`` with z = W (f - mu), W the transposed Cholesky factor of the precision of ``model`` (one row)."""
    m = model.select("mu", "precision").first()
    if m is None:
        raise ValueError("no model to whiten by")
    p = len(m["mu"])
    shared = rows.sparkSession.sparkContext.broadcast((np.array(m["mu"]), np.linalg.cholesky(np.array(m["precision"]).reshape(p, p))))
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mu, lower = shared.value
        for batch in batches:
            if len(batch):
                yield batch.assign(z=list((np.stack(batch[f].to_numpy()) - mu) @ lower))

    return rows.mapInPandas(run, kinds + ", z array<double>")


def distances(rows: DataFrame, models: DataFrame, cls: str, f: str = "f", key: str | None = None, at_once: int = 2000) -> DataFrame:
    """``rows`` with ds: map of class to Mahalanobis distance, for every model; ``key``: for those of the row's key only.

    Models are broadcast ``at_once`` at a time, in slices by hash: with more, rows are scored once for each slice and
    their maps are put together in a written table."""
    names = [cls] + ([key] if key else [])
    slices = max(1, -(-models.count() // at_once))
    out = rows
    for s in range(slices):
        some = models if slices == 1 else models.filter(F.pmod(F.xxhash64(*names), F.lit(slices)) == s)
        own = [((r[key] if key else None), str(r[cls]), np.array(r["mu"]), np.array(r["precision"]).reshape(len(r["mu"]), -1)) for r in some.select(*names, "mu", "precision").collect()]
        out = _to_models(out, rows.sparkSession.sparkContext.broadcast(own), f, key, f"ds{s}")
        if slices > 1:
            from phmspark.sources.scratch import written

            out = written(out, "distances")
    maps = [f"ds{s}" for s in range(slices)]
    return out.withColumn("ds", F.map_concat(*maps) if slices > 1 else F.col(maps[0])).drop(*maps)


def _to_models(rows: DataFrame, shared, f: str, key: str | None, new: str) -> DataFrame:
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [{} for _ in range(len(batch))]
            for k, at in batch.reset_index(drop=True).groupby(key).indices.items() if key else [(None, np.arange(len(batch)))]:
                x = np.stack(batch[f].to_numpy()[at]) if len(at) else None
                for own, name, mu, p in shared.value:
                    if own == k and x is not None:
                        z = x - mu
                        for i, v in zip(at, np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", z @ p, z))), strict=True):
                            out[i][name] = float(v)
            yield batch.assign(**{new: out})

    return rows.mapInPandas(run, f"{kinds}, {new} map<string,double>")


def scaling(train: DataFrame, keys: list[str], f: str = "f") -> DataFrame:
    """keys, centre, spread: median and quartile distance of each component (1 where that is 0)."""
    from phmspark.operators.quantiles import exact_quantiles

    q = exact_quantiles(train.select(*keys, F.posexplode(f).alias("i", "x")), [*keys, "i"], "x", [0.25, 0.5, 0.75])
    wide = q.groupBy(*keys, "i").agg(F.max(F.when(F.col("q") == 0.5, F.col("x"))).alias("c"), (F.max(F.when(F.col("q") == 0.75, F.col("x"))) - F.max(F.when(F.col("q") == 0.25, F.col("x")))).alias("s"))
    rows = F.array_sort(F.collect_list(F.struct("i", "c", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s"))))
    return wide.groupBy(*keys).agg(rows.alias("r")).select(*keys, F.transform("r", lambda x: x["c"]).alias("centre"), F.transform("r", lambda x: x["s"]).alias("spread"))


def scaled(df: DataFrame, fit: DataFrame, keys: list[str], f: str = "f") -> DataFrame:
    held = df.join(fit, keys) if keys else df.crossJoin(F.broadcast(fit))
    return held.withColumn(f, F.zip_with(F.zip_with(f, "centre", lambda x, c: x - c), "spread", lambda x, s: x / s)).drop("centre", "spread")
