"""Polar geometry: M13-M18, A31, A32, P11's view of rays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phmspark.functions import scalars as S
from phmspark.operators import metrics, moments, quantiles, ranking
from phmspark.plans.base import ROLES, features, query
from phmspark.sources.scratch import written
from phmspark.plans.models import _LW

# Whitened by the healthy model: z = W (x - mu) with W the transposed Cholesky factor of its precision, a row of W a step
_Z = f"""{_LW}, chol AS (SELECT 1 AS t, p AS m, CAST([] AS DOUBLE[][]) AS w FROM p WHERE label = 0
    UNION ALL SELECT t + 1, list_transform(m, lambda r: list_transform(r, lambda x, j: x - r[t] * m[t][j] / m[t][t])), list_append(w, list_transform(m[t], lambda x: x / sqrt(m[t][t]))) FROM chol WHERE t <= len(m)),
  z AS (SELECT vec_id, label, role, list_transform(w, lambda r: list_inner_product(r, y)) AS z FROM (SELECT vec_id, r.label, role, w, list_transform(f, lambda a, i: a - mu[i]) AS y FROM role r, chol, p WHERE p.label = 0 AND t = len(m) + 1)),
  polar AS (SELECT *, sqrt(list_inner_product(z, z)) AS radius FROM z),
  ray AS (SELECT ray, list_transform(mu, lambda x: x / sqrt(list_inner_product(mu, mu))) AS u, sqrt(list_inner_product(mu, mu)) AS ray_radius FROM (
    SELECT label AS ray, list(a ORDER BY i) AS mu FROM (SELECT label, i, avg(x) AS a FROM (SELECT label, generate_subscripts(z, 1) AS i, unnest(z) AS x FROM z WHERE role = 'train' AND label BETWEEN 1 AND 5) GROUP BY ALL) GROUP BY label)),
  cosines AS (SELECT vec_id, label, role, radius, ray, ray_radius, list_inner_product(z, u) / radius AS c FROM polar, ray WHERE radius > 0),
  tau AS (SELECT ray, quantile_cont(c, 0.05) AS tau FROM cosines WHERE label = ray AND role = 'holdout' GROUP BY ray)"""


def whitened(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, role, z, radius: rows in the healthy model's whitened space."""
    rows = ranking.with_role(features(spark, d), ["label"], "vec_id").select("vec_id", "label", "role", "f")
    m = moments.fit_mahalanobis(rows.filter("role = 'train' AND label = 0").select("f"), [])
    return written(moments.whiten(rows, m).withColumn("radius", S.norm(F.col("z"))).select("vec_id", "label", "role", "z", "radius"), "whitened")


def rays(z: DataFrame) -> DataFrame:
    """ray, u (unit direction of the class mean), ray_radius; classes at the origin have none."""
    m = moments.means(z.filter("role = 'train' AND label BETWEEN 1 AND 5").select("label", "z"), ["label"], "z")
    r = m.select(F.col("label").alias("ray"), "mu", S.norm(F.col("mu")).alias("ray_radius")).filter("ray_radius > 0")
    return r.select("ray", F.transform("mu", lambda x: x / F.col("ray_radius")).alias("u"), "ray_radius")


def cosines(z: DataFrame, r: DataFrame) -> DataFrame:
    """Rows against every ray; rays are as few as classes."""
    return z.filter("radius > 0").crossJoin(F.broadcast(r)).withColumn("c", S.dot(F.col("z"), F.col("u")) / F.col("radius"))


@query("m13_whitening", f"WITH RECURSIVE {_Z} SELECT vec_id, round(z[1], 5) AS z1, round(z[-1], 5) AS z_last, round(list_sum(z), 5) AS total, round(radius, 5) AS radius FROM polar")
def m13_whitening(spark, d):
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + x)
    return whitened(spark, d).select("vec_id", F.round(F.col("z")[0], 5).alias("z1"), F.round(F.element_at("z", -1), 5).alias("z_last"), F.round(total, 5).alias("total"), F.round("radius", 5).alias("radius"))


@query("m15_rays", f"WITH RECURSIVE {_Z} SELECT ray, round(u[1], 5) AS u1, round(u[-1], 5) AS u_last, round(ray_radius, 5) AS radius, round(tau, 5) AS tau FROM ray JOIN tau USING (ray)")
def m15_rays(spark, d):
    z = whitened(spark, d)
    r = rays(z)
    tau = quantiles.exact_quantiles(cosines(z, r).filter("label = ray AND role = 'holdout'"), ["ray"], "c", [0.05]).select("ray", F.round("x", 5).alias("tau"))
    return r.join(tau, "ray").select("ray", F.round(F.col("u")[0], 5).alias("u1"), F.round(F.element_at("u", -1), 5).alias("u_last"), F.round("ray_radius", 5).alias("radius"), "tau")


@query(
    "m14_polar",
    f"WITH RECURSIVE {_Z}, b AS (SELECT vec_id, radius, c, ray, ray_radius, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, ray) AS k FROM cosines) SELECT vec_id, round(radius, 5) AS radius, round(c, 5) AS cos, ray, CASE WHEN c >= tau THEN 'same_ray' ELSE 'new_direction' END AS verdict, round(radius * c / ray_radius, 5) AS severity FROM b JOIN tau USING (ray) WHERE k = 1",
)
def m14_polar(spark, d):
    """Best ray of each row, whether it lies on it, and how far along."""
    z = whitened(spark, d)
    c = cosines(z, rays(z))
    tau = quantiles.exact_quantiles(c.filter("label = ray AND role = 'holdout'"), ["ray"], "c", [0.05]).select("ray", F.col("x").alias("tau"))
    best = c.groupBy("vec_id").agg(F.max("radius").alias("radius"), F.min(F.struct((-F.col("c")).alias("m"), "ray", "ray_radius")).alias("b")).select("vec_id", "radius", (-F.col("b.m")).alias("cos"), "b.ray", "b.ray_radius")
    met = best.join(tau, "ray")
    return met.select("vec_id", F.round("radius", 5).alias("radius"), F.round("cos", 5).alias("cos"), "ray", F.when(F.col("cos") >= F.col("tau"), "same_ray").otherwise("new_direction").alias("verdict"), F.round(F.col("radius") * F.col("cos") / F.col("ray_radius"), 5).alias("severity"))


@query("m16_ray_cosines", f"WITH RECURSIVE {_Z} SELECT a.ray AS a, b.ray AS b, round(list_inner_product(a.u, b.u), 5) AS cos, round(avg(list_inner_product(a.u, b.u)) FILTER (a.ray <> b.ray) OVER (PARTITION BY a.ray), 5) AS mean_other, round(avg(list_inner_product(a.u, b.u)) FILTER (a.ray <> b.ray AND a.ray % 2 = b.ray % 2) OVER (PARTITION BY a.ray), 5) AS mean_family FROM ray a, ray b")
def m16_ray_cosines(spark, d):
    """Cosines between rays; each ray's mean with the others, and with the others of its family (here label % 2)."""
    from pyspark.sql import Window

    r = rays(whitened(spark, d)).select("ray", "u")
    both = r.select(F.col("ray").alias("a"), F.col("u").alias("ua")).crossJoin(F.broadcast(r.select(F.col("ray").alias("b"), F.col("u").alias("ub")))).withColumn("c", S.dot(F.col("ua"), F.col("ub")))  # rays: a few rows
    return both.select("a", "b", F.round("c", 5).alias("cos"), F.round(F.avg(F.when(F.col("a") != F.col("b"), F.col("c"))).over(Window.partitionBy("a")), 5).alias("mean_other"), F.round(F.avg(F.when((F.col("a") != F.col("b")) & (F.col("a") % 2 == F.col("b") % 2), F.col("c"))).over(Window.partitionBy("a")), 5).alias("mean_family"))


@query(
    "m17_familiarity",
    f"WITH RECURSIVE {_Z}, f AS (SELECT k, vec_id, label, max(c) AS score FROM cosines, (SELECT unnest([{{'k': 'all', 'rays': [1, 2, 3, 4, 5]}}, {{'k': 'odd', 'rays': [1, 3, 5]}}, {{'k': 'one', 'rays': [1]}}], recursive := true)) WHERE label > 0 AND list_contains(rays, ray) GROUP BY ALL), labelled AS (SELECT k, score, label <= 5 AS pos FROM f), hh AS (SELECT k, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM labelled GROUP BY ALL), cc AS (SELECT *, sum(p) OVER w AS tp, sum(p) OVER (PARTITION BY k) AS np, sum(q) OVER (PARTITION BY k) AS nq FROM hh WINDOW w AS (PARTITION BY k ORDER BY score DESC)) SELECT k AS known, round(sum(q * (tp - p) + q * p / 2) / max(np * nq), 5) AS auroc FROM cc GROUP BY k",
)
def m17_familiarity(spark, d):
    """How well the best cosine tells families with a ray from new directions, for three sets of known rays."""
    z = whitened(spark, d)
    ray = F.col("ray")
    sets = F.array_compact(F.array(F.lit("all"), F.when(ray.isin(1, 3, 5), "odd"), F.when(ray == 1, "one")))
    f = cosines(z, rays(z)).filter("label > 0").withColumn("known", F.explode(sets)).groupBy("known", "vec_id", "label").agg(F.max("c").alias("score"))
    return metrics.auroc(f.select("known", "score", (F.col("label") <= 5).alias("pos")), ["known"], "score", "pos").select("known", F.round("auroc", 5).alias("auroc"))


@query(
    "m18_severity_ranks",
    f"WITH RECURSIVE {_Z}, bundle AS (SELECT list(s ORDER BY i) AS b FROM (SELECT i, sum(x) AS s FROM (SELECT generate_subscripts(u, 1) AS i, unnest(u) AS x FROM ray) GROUP BY i)), sev AS (SELECT 'radius' AS definition, label, radius AS v FROM polar UNION ALL SELECT 'best_ray', label, radius * c / ray_radius FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, ray) AS k FROM cosines) WHERE k = 1 UNION ALL SELECT 'bundle', label, list_inner_product(z, b) FROM polar, bundle), r AS (SELECT definition, rank() OVER (PARTITION BY definition ORDER BY v) + (count(*) OVER (PARTITION BY definition, v) - 1) / 2 AS a, rank() OVER (PARTITION BY definition ORDER BY label) + (count(*) OVER (PARTITION BY definition, label) - 1) / 2 AS b FROM sev WHERE label > 0) SELECT definition, round(corr(a, b), 5) AS spearman FROM r GROUP BY definition",
)
def m18_severity_ranks(spark, d):
    """Rank correlation with the grade of three severities: radius, place on the best ray, and projection on the rays'
    bundle (the sum of their directions); from histograms of either."""
    whole = whitened(spark, d)
    z, r = whole.filter("label > 0"), written(rays(whole), "rays")
    best = cosines(z, r).groupBy("vec_id", "label").agg(F.min(F.struct((-F.col("c")).alias("m"), "ray", (F.col("radius") * F.col("c") / F.col("ray_radius")).alias("v"))).alias("b")).select("label", F.col("b.v").alias("v"))
    summed = r.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("bundle"))
    along = z.crossJoin(F.broadcast(summed)).select("label", S.dot(F.col("z"), F.col("bundle")).alias("v"))  # one row
    out = None
    for name, rows in (("radius", z.select("label", F.col("radius").alias("v"))), ("best_ray", best), ("bundle", along)):
        one = metrics.spearman(rows, "v", "label").select(F.lit(name).alias("definition"), F.round("spearman", 5).alias("spearman"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a31_cosine_spread", f"WITH RECURSIVE {_Z}, mx AS (SELECT vec_id, label, max(c) AS c FROM cosines GROUP BY ALL) SELECT label, round(quantile_cont(c, 0.5), 5) AS median, round(quantile_cont(c, 0.1), 5) AS p10, round(quantile_cont(c, 0.9), 5) AS p90 FROM mx GROUP BY label")
def a31_cosine_spread(spark, d):
    z = whitened(spark, d)
    m = cosines(z, rays(z)).groupBy("vec_id", "label").agg(F.max("c").alias("c"))
    q = quantiles.exact_quantiles(m, ["label"], "c", [0.1, 0.5, 0.9])
    at = lambda v, n: F.round(F.max(F.when(F.col("q") == v, F.col("x"))), 5).alias(n)
    return q.groupBy("label").agg(at(0.5, "median"), at(0.1, "p10"), at(0.9, "p90"))


@query(
    "a32_median_shift",
    f"WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings), role AS ({ROLES}), x AS (SELECT label, role, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM role) SELECT i, round(quantile_cont(x, 0.5) FILTER (label = 1) - quantile_cont(x, 0.5) FILTER (label = 0 AND role = 'train'), 5) AS shift FROM x GROUP BY i",
)
def a32_median_shift(spark, d):
    """Median of a target's rows less that of the source's training rows, by component."""
    rows = ranking.with_role(features(spark, d), ["label"], "vec_id").filter("label = 1 OR label = 0 AND role = 'train'")
    q = quantiles.exact_quantiles(rows.select("label", F.posexplode("f").alias("i", "x")), ["label", "i"], "x", [0.5])
    return q.groupBy((F.col("i") + 1).cast("long").alias("i")).agg(F.round(F.max(F.when(F.col("label") == 1, F.col("x"))) - F.max(F.when(F.col("label") == 0, F.col("x"))), 5).alias("shift"))
