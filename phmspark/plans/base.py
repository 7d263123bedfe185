"""How queries are registered, and the views of the given tables that they share.

``embeddings`` play feature rows: label 0 is the healthy class, the others are fault classes. ``events`` play asset
sessions: a user is an asset, ``value / 50`` its score, rows in the order of time and id. ``lineitem`` plays wide numeric
rows of the conditions (l_returnflag, l_linestatus); ``orders`` the run results of a condition hierarchy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        REGISTRY[name] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    """vec_id, label, f: the embedding (its first ``dims`` components) as doubles."""
    f = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.slice(f, 1, dims) if dims else f).alias("f"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, ts, event_id, score, kind of the event stream."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") / 50).alias("score"), F.col("event_type").alias("kind"))


# The same views in SQL
FEATURES = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings"
SCORES = "SELECT user_id AS asset, ts, event_id, value / 50 AS score, event_type AS kind FROM events"
ROLES = """SELECT *, CASE WHEN r < floor(0.6 * n) THEN 'train' WHEN r < floor(0.6 * n) + greatest(1, floor(0.2 * n)) THEN 'cal' ELSE 'holdout' END AS role
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM v)"""
# Robust-scaled features: centre and spread of the training rows of label 0
SCALED = f"""v AS ({FEATURES}), role AS ({ROLES}),
  dims AS (SELECT *, generate_subscripts(f, 1) AS d, unnest(f) AS x FROM role),
  fit AS (SELECT d, quantile_cont(x, 0.5) AS centre, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS spread FROM dims WHERE label = 0 AND role = 'train' GROUP BY d),
  z AS (SELECT vec_id, label, role, d, (x - centre) / CASE WHEN spread = 0 THEN 1 ELSE spread END AS z FROM dims JOIN fit USING (d))"""
