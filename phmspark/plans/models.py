"""Open-set models: P6-P11, A5-A10, A12, J2, J3, M1-M11, M24, M27-M29, T2, E1-E4 on scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phmspark.functions import scalars as S
from phmspark.operators import detectors, metrics, moments, neighbours, openset, ranking, registered
from phmspark.sources.scratch import written
from phmspark.plans.base import FEATURES, ROLES, SCALED, features, query, table


def scaled_rows(spark: SparkSession, d: str, dims: int | None = None) -> DataFrame:
    """vec_id, label, role, f scaled by the training rows of label 0."""
    rows = ranking.with_role(features(spark, d, dims), ["label"], "vec_id").select("vec_id", "label", "role", "f")
    fit = moments.scaling(rows.filter("label = 0 AND role = 'train'"), [])
    return written(moments.scaled(rows, fit, []), "scaled")


# k-NN distance of every row to the healthy training rows, and its calibrated score
_KNN = f"""WITH {SCALED},
  rows_ AS (SELECT vec_id, label, role, list(z ORDER BY d) AS f FROM z GROUP BY ALL),
  near AS (SELECT q.vec_id, q.label, q.role, list_distance(q.f, b.f) AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.f, b.f), b.vec_id) AS r
           FROM rows_ q JOIN rows_ b ON b.label = 0 AND b.role = 'train' AND q.vec_id <> b.vec_id),
  raw AS (SELECT vec_id, label, role, avg(dist) AS raw FROM near WHERE r <= 5 GROUP BY ALL),
  score AS (SELECT vec_id, label, role, raw / (SELECT quantile_cont(raw, 0.95) FROM raw WHERE label = 0 AND role = 'cal') AS score FROM raw)"""


def knn_scores(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, role, score of the k-NN detector fitted on label 0 (mean distance of 5)."""
    rows = scaled_rows(spark, d)
    raw = neighbours.mean_distance(rows, rows.filter("label = 0 AND role = 'train'"), 5, "vec_id", not_self=True)
    held = written(rows.select("vec_id", "label", "role").join(raw.select(F.col("query").alias("vec_id"), F.col("d").alias("raw")), "vec_id"), "raw-scores")
    return openset.calibrated(held, [], "raw", (F.col("label") == 0) & (F.col("role") == "cal")).select("vec_id", "label", "role", "score")


@query("p6_robust_scale", f"WITH {SCALED} SELECT vec_id, round(sum(z), 4) AS total, round(max(z), 4) AS high FROM z GROUP BY vec_id")
def p6_robust_scale(spark, d):
    rows = scaled_rows(spark, d)
    return rows.select("vec_id", F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max("f"), 4).alias("high"))


@query("p7_roles", f"WITH v AS (SELECT vec_id, label FROM embeddings) SELECT vec_id, label, role FROM ({ROLES})")
def p7_roles(spark, d):
    return ranking.with_role(table(spark, d, "embeddings").select("vec_id", "label"), ["label"], "vec_id").select("vec_id", "label", "role")


@query("p8_stream_eval", "SELECT vec_id, label, CASE WHEN r < ceil(0.2 * n) THEN 'eval' ELSE 'stream' END AS part FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label > 0)")
def p8_stream_eval(spark, d):
    return ranking.stream_eval(table(spark, d, "embeddings").filter("label > 0").select("vec_id", "label"), ["label"], "vec_id").select("vec_id", "label", "part")


@query("p9_support_eval", "SELECT vec_id, label, CASE WHEN r < 10 THEN 'support' ELSE 'eval' END AS part FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('11:' || vec_id), vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE n > 10")
def p9_support_eval(spark, d):
    return ranking.support_eval(table(spark, d, "embeddings").select("vec_id", "label"), ["label"], "vec_id", 10).select("vec_id", "label", "part")


@query(
    "p10_exclude_fitted",
    """WITH f AS (SELECT vec_id FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('11:' || vec_id), vec_id) AS r FROM embeddings WHERE label IN (1, 2)) WHERE r <= 10),
       left_ AS (SELECT label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM f) GROUP BY 1) SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM f) OR label NOT IN (SELECT label FROM left_)""",
)
def p10_exclude_fitted(spark, d):
    """Rows that learned classes were fitted on are not drawn again, but where a class has no others."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    fitted = ranking.hash_rank(e.filter("label IN (1, 2)"), ["label"], "vec_id", seed=11, count=None).filter("r < 10").select("vec_id")
    rest = e.join(fitted, "vec_id", "left_anti")
    return rest.unionByName(e.join(rest.select("label").distinct(), "label", "left_anti"))


@query("p11_pca_view")
def p11_pca_view(spark, d):
    """Two principal axes of the healthy training rows; all rows placed on them, signs made definite."""
    rows = scaled_rows(spark, d)
    return detectors.pca_project(rows, rows.filter("label = 0 AND role = 'train'"), 2).select("vec_id", "label", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("a5_class_means", f"WITH v AS ({FEATURES}), x AS (SELECT label, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM v) SELECT label, i, count(*) AS n, round(avg(x), 6) AS mean FROM x GROUP BY ALL")
def a5_class_means(spark, d):
    m = moments.means(features(spark, d), ["label"])
    return m.select("label", "n", F.posexplode("mu").alias("i", "m")).select("label", (F.col("i") + 1).cast("long").alias("i"), "n", F.round("m", 6).alias("mean"))


# An inverse in SQL: one pivot a step, in place; "c" is a list of rows
SWEEP = "list_transform(c, lambda r, i: CASE WHEN i = t THEN list_transform(r, lambda x, j: CASE WHEN j = t THEN 1 / x ELSE x / c[t][t] END) ELSE list_transform(r, lambda x, j: CASE WHEN j = t THEN -x / c[t][t] ELSE x - r[t] * c[t][j] / c[t][t] END) END)"
_QUADRATIC = "sqrt(greatest(0, list_inner_product(z, list_transform(p, lambda r: list_inner_product(r, z)))))"
# Shrunk covariances of each label's training rows, their inverses, distances of all rows to all labels, thresholds
_LW = f"""v AS ({FEATURES}), role AS ({ROLES}),
  mean AS (SELECT label, max(k) AS k, list(a ORDER BY i) AS mu FROM (SELECT label, i, count(*) AS k, avg(x) AS a FROM (SELECT label, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM role WHERE role = 'train') GROUP BY label, i) GROUP BY label),
  away AS (SELECT vec_id, label, k, list_transform(f, lambda a, i: a - mu[i]) AS z FROM role JOIN mean USING (label) WHERE role = 'train'),
  cell AS (SELECT vec_id, label, k, generate_subscripts(z, 1) AS i, unnest(z) AS x FROM away),
  prod AS (SELECT a.label, a.i, b.i AS j, sum(a.x * b.x) / any_value(a.k) AS s FROM cell a JOIN cell b USING (vec_id, label) GROUP BY ALL),
  four AS (SELECT label, any_value(k) AS k, sum(list_inner_product(z, z) ** 2) AS f4 FROM away GROUP BY label),
  whole AS (SELECT label, k, f4, count(*) FILTER (i = j) AS p, sum(s) FILTER (i = j) AS tr, sum(s * s) AS sq FROM prod JOIN four USING (label) GROUP BY ALL),
  part AS (SELECT label, tr / p AS m, (sq - tr * tr / p) / p AS delta, (f4 / k - sq) / (p * k) AS beta FROM whole),
  shrink AS (SELECT label, m, CASE WHEN beta <= 0 OR delta = 0 THEN 0 ELSE least(beta, delta) / delta END AS sh FROM part),
  cov AS (SELECT label, list(r ORDER BY i) AS c FROM (SELECT label, i, list((1 - sh) * s + CASE WHEN i = j THEN sh * m ELSE 0 END ORDER BY j) AS r FROM prod JOIN shrink USING (label) GROUP BY ALL) GROUP BY ALL),
  sweep AS (SELECT label, 1 AS t, c FROM cov UNION ALL SELECT label, t + 1, {SWEEP} FROM sweep WHERE t <= len(c)),
  p AS (SELECT label, k, mu, sh, c AS p FROM sweep JOIN mean USING (label) JOIN shrink USING (label) WHERE t = len(c) + 1),
  dist AS (SELECT vec_id, truth, role, cls, {_QUADRATIC} AS d FROM (SELECT r.vec_id, r.label AS truth, r.role, p.label AS cls, p.p, list_transform(f, lambda a, i: a - mu[i]) AS z FROM role r, p)),
  thr AS (SELECT cls, quantile_cont(d, 0.95) AS threshold FROM dist WHERE truth = cls AND role = 'cal' GROUP BY cls)"""


def lw_models(spark: SparkSession, d: str, dims: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with roles, and Ledoit-Wolf models of every label's training rows."""
    rows = written(ranking.with_role(features(spark, d, dims), ["label"], "vec_id").select("vec_id", "label", "role", "f"), "roles")
    return rows, moments.fit_mahalanobis(rows.filter("role = 'train'"), ["label"])


def class_distances(spark: SparkSession, d: str, dims: int | None = None) -> DataFrame:
    """vec_id, truth, role, cls, d: of each row to each class."""
    rows, models = lw_models(spark, d, dims)
    wide = moments.distances(rows, models, "label")
    return written(wide.select("vec_id", F.col("label").alias("truth"), "role", F.explode("ds").alias("cls", "d")).withColumn("cls", F.col("cls").cast("int")), "distances")


@query("a6_ledoit_wolf", f"WITH RECURSIVE {_LW} SELECT label, k AS n, round(sh, 6) AS shrinkage, round(p[1][1], 4) AS p11, round(p[1][2], 4) AS p12, round(p[-1][-1], 4) AS p_last, round(list_sum(list_transform(p, lambda r, i: r[i])), 3) AS trace FROM p")
def a6_ledoit_wolf(spark, d):
    """Shrunk precision of each label's training rows."""
    _, m = lw_models(spark, d)
    p, width = F.col("precision"), F.size("mu")
    trace = F.aggregate(F.transform("mu", lambda _, k: F.element_at("precision", (k * (width + 1) + 1).cast("int"))), F.lit(0.0), lambda a, x: a + x)
    return m.select("label", "n", F.round("shrinkage", 6).alias("shrinkage"), F.round(p[0], 4).alias("p11"), F.round(p[1], 4).alias("p12"), F.round(F.element_at("precision", -1), 4).alias("p_last"), F.round(trace, 3).alias("trace"))


@query("a6_ledoit_wolf_wide")
def a6_ledoit_wolf_wide(spark, d):
    """The same of all rows of each label."""
    m = moments.fit_mahalanobis(features(spark, d), ["label"])
    trace = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.element_at("precision", k * 65 + 1)), F.lit(0.0), lambda a, x: a + x)
    return m.select("label", "n", F.round("shrinkage", 6).alias("shrinkage"), F.round(trace, 3).alias("trace"))


@query("a7_oas_wide")
def a7_oas_wide(spark, d):
    m = moments.fit_mahalanobis(features(spark, d), ["label"], estimator="oas")
    return m.select("label", "n", F.round("shrinkage", 6).alias("shrinkage"), F.round(F.element_at("precision", 1), 4).alias("p11"))


# Mean and unbiased covariance, with a small ridge, of the known rows (labels 0 to 2)
_POOLED = f"""v AS ({FEATURES}), known AS (SELECT vec_id, f FROM v WHERE label < 3),
  cell AS (SELECT vec_id, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM known), mean AS (SELECT list(a ORDER BY i) AS mu FROM (SELECT i, avg(x) AS a FROM cell GROUP BY i)),
  prod AS (SELECT i, j, s + CASE WHEN i = j THEN 1e-6 ELSE 0 END AS s FROM (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS s FROM cell a JOIN cell b USING (vec_id) GROUP BY ALL))"""


@query("a9_pooled", f"WITH {_POOLED} SELECT (SELECT count(*) FROM known) AS n, round(max(s) FILTER (i = 1 AND j = 1), 6) AS c11, round(max(s) FILTER (i = 1 AND j = 2), 6) AS c12, round(sum(s) FILTER (i = j), 6) AS trace, round(sum(s * s), 6) AS square FROM prod")
def a9_pooled(spark, d):
    """One unbiased covariance of all known rows, with a small ridge, as the legacy estimator has it."""
    m = moments.moments(features(spark, d).filter("label < 3").select("f"), [])
    width = F.size("mu")
    ridge = lambda x, k: x / (F.col("n") - 1) + F.when(k % (width + 1) == 0, 1e-6).otherwise(0.0)
    c = m.withColumn("c", F.transform("gram", ridge))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    trace = total(F.transform("mu", lambda _, k: F.element_at("c", (k * (width + 1) + 1).cast("int"))))
    return c.select("n", F.round(F.col("c")[0], 6).alias("c11"), F.round(F.col("c")[1], 6).alias("c12"), F.round(trace, 6).alias("trace"), F.round(total(F.transform("c", lambda x: x * x)), 6).alias("square"))


@query("a8_robust_covariance")
def a8_robust_covariance(spark, d):
    """Minimum covariance determinant of every label, after a projection that holds 95 % of the variance."""
    rows = features(spark, d)
    smallest = rows.groupBy("label").count().agg(F.min("count")).first()[0]
    m = detectors.minimum_determinant(detectors.capped_projection(rows, rows, smallest), ["label"], "vec_id")
    return m.select("label", "n", F.size("mu").alias("width"), F.round("logdet", 5).alias("logdet"), F.round("support_logdet", 5).alias("support_logdet"), F.round(F.element_at("mu", 1), 6).alias("m1"))


@query("m1_mahalanobis", f"WITH RECURSIVE {_LW} SELECT vec_id, cls, round(d, 5) AS d FROM dist")
def m1_mahalanobis(spark, d):
    return class_distances(spark, d).select("vec_id", "cls", F.round("d", 5).alias("d"))


@query("m1_mahalanobis_wide")
def m1_mahalanobis_wide(spark, d):
    rows, models = lw_models(spark, d)
    return moments.distances(rows, models, "label").select("vec_id", F.explode("ds").alias("cls", "d")).withColumn("d", F.round("d", 5))


@query("m2_thresholds", f"WITH RECURSIVE {_LW} SELECT cls, round(threshold, 5) AS threshold FROM thr")
def m2_thresholds(spark, d):
    own = class_distances(spark, d).filter("truth = cls AND role = 'cal'")
    return openset.thresholds(own, "cls", "d").select("cls", F.round("threshold", 5).alias("threshold"))


@query(
    "m3_openset",
    f"WITH RECURSIVE {_LW}, b AS (SELECT vec_id, truth, role, d / greatest(threshold, 1e-12) AS s, cls FROM dist JOIN thr USING (cls)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s, cls) AS r FROM b) SELECT vec_id, round(s, 5) AS score, cls AS nearest, CASE WHEN s > 1 THEN 'unknown' ELSE 'known' END AS verdict FROM r WHERE r = 1",
)
def m3_openset(spark, d):
    """Least calibrated distance over the classes; above 1 is unknown."""
    long = class_distances(spark, d)
    fit = openset.thresholds(long.filter("truth = cls AND role = 'cal'"), "cls", "d")
    return openset.decide(long, fit, "vec_id", "cls", "d").withColumn("score", F.round("score", 5))


@query("m28_known_boundary", f"WITH RECURSIVE {_LW} SELECT round(max(d / greatest(threshold, 1e-12)), 5) AS boundary FROM dist JOIN thr USING (cls) WHERE truth = cls AND role = 'cal'")
def m28_known_boundary(spark, d):
    """The largest calibrated score of any known class's calibration rows."""
    own = class_distances(spark, d).filter("truth = cls AND role = 'cal'")
    fit = openset.thresholds(own, "cls", "d")
    return own.join(fit, "cls").agg(F.round(F.max(F.col("d") / F.greatest("threshold", F.lit(1e-12))), 5).alias("boundary"))


@query(
    "m4_legacy_rule",
    f"""WITH RECURSIVE {_POOLED}, start AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(s ORDER BY j) AS r FROM prod GROUP BY i)),
       sweep AS (SELECT 1 AS t, c FROM start UNION ALL SELECT t + 1, {SWEEP} FROM sweep WHERE t <= len(c)),
       c AS (SELECT cls, list(a ORDER BY i) AS centre FROM (SELECT label AS cls, i, avg(x) AS a FROM cell JOIN v USING (vec_id) GROUP BY ALL) GROUP BY cls),
       s AS (SELECT vec_id, label, {_QUADRATIC} AS d FROM (SELECT vec_id, label, c AS p, list_transform(f, lambda a, i: a - mu[i]) AS z FROM v, sweep, mean WHERE t = len(c) + 1)),
       t AS (SELECT quantile_cont(d, 0.95) AS t FROM s WHERE label < 3),
       n AS (SELECT vec_id, cls, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(f, centre), cls) AS r FROM v, c)
       SELECT vec_id, round(d / t, 5) AS score, CASE WHEN d / t > 1 THEN NULL ELSE cls END AS label_pred FROM s JOIN n USING (vec_id), t WHERE r = 1""",
)
def m4_legacy_rule(spark, d):
    """One pooled Gaussian decides known or unknown; a known row takes the nearest class mean."""
    rows = features(spark, d)
    known = rows.filter("label < 3")
    model = moments.fit_mahalanobis(known.select("f"), [], estimator="pooled").withColumn("all", F.lit("all"))
    dist = moments.distances(rows, model, "all").withColumn("d", F.col("ds")["all"])
    from phmspark.operators.quantiles import exact_quantiles

    t = exact_quantiles(dist.filter("label < 3"), [], "d", [0.95]).select(F.col("x").alias("t"))
    centres = moments.means(known, ["label"]).select(F.col("label").alias("cls"), "mu")
    near = rows.crossJoin(F.broadcast(centres)).groupBy("vec_id").agg(F.min(F.struct(S.distance(F.col("f"), F.col("mu")), F.col("cls"))).alias("b"))  # classes: a few rows
    scored = dist.join(near, "vec_id").crossJoin(F.broadcast(t)).withColumn("s", F.col("d") / F.col("t"))
    return scored.select("vec_id", F.round("s", 5).alias("score"), F.when(F.col("s") <= 1, F.col("b.cls")).alias("label_pred"))


@query(
    "j3_nearest",
    f"WITH v AS ({FEATURES}), n AS (SELECT q.vec_id AS query, b.label::VARCHAR AS cls, b.vec_id AS neighbour, list_distance(q.f, b.f) AS dd FROM v q JOIN v b ON q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query, cls ORDER BY dd, neighbour) AS rank FROM n) SELECT query, cls, rank::INTEGER AS rank, neighbour, round(dd, 6) AS distance FROM r WHERE rank <= 3",
)
def j3_nearest(spark, d):
    """The three nearest rows of each class, of every hundredth row as a query, against all rows."""
    rows = features(spark, d)
    return neighbours.nearest(rows.filter("vec_id % 100 = 0"), rows, 3, "vec_id", cls="label", not_self=True).withColumn("distance", F.round("distance", 6))


@query(
    "m5_knn_openset",
    f"""WITH v AS ({FEATURES}), r AS ({ROLES}), n AS (SELECT q.vec_id, q.label AS truth, q.role, b.label AS cls, list_distance(q.f, b.f) AS dist, row_number() OVER (PARTITION BY q.vec_id, b.label ORDER BY list_distance(q.f, b.f), b.vec_id) AS k
        FROM r q JOIN r b ON b.role = 'train' AND b.label < 3 AND q.vec_id <> b.vec_id), m AS (SELECT vec_id, truth, role, cls, avg(dist) AS d FROM n WHERE k <= 5 GROUP BY ALL),
        t AS (SELECT cls, quantile_cont(d, 0.95) AS t FROM m WHERE truth = cls AND role = 'cal' GROUP BY cls), s AS (SELECT vec_id, d / greatest(t, 1e-12) AS s, cls, row_number() OVER (PARTITION BY vec_id ORDER BY d / greatest(t, 1e-12), cls) AS k FROM m JOIN t USING (cls))
        SELECT vec_id, round(s, 5) AS score, cls AS nearest, CASE WHEN s > 1 THEN 'unknown' ELSE 'known' END AS verdict FROM s WHERE k = 1""",
)
def m5_knn_openset(spark, d):
    """Mean distance of 5 to each known class (labels 0 to 2), calibrated by class."""
    rows = written(ranking.with_role(features(spark, d), ["label"], "vec_id").select("vec_id", "label", "role", "f"), "roles")
    dist = neighbours.mean_distance(rows, rows.filter("role = 'train' AND label < 3"), 5, "vec_id", cls="label", not_self=True)
    long = written(rows.select("vec_id", F.col("label").alias("truth"), "role").join(dist.select(F.col("query").alias("vec_id"), F.col("cls").cast("int").alias("cls"), "d"), "vec_id"), "distances")
    fit = openset.thresholds(long.filter("truth = cls AND role = 'cal'"), "cls", "d")
    return openset.decide(long, fit, "vec_id", "cls", "d").withColumn("score", F.round("score", 5))


@query("m10_knn_detector", f"{_KNN} SELECT vec_id, role, round(score, 5) AS score FROM score")
def m10_knn_detector(spark, d):
    return knn_scores(spark, d).select("vec_id", "role", F.round("score", 5).alias("score"))


_HISTOGRAM = """h AS (SELECT k, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM labelled GROUP BY ALL),
  c AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY k) AS np, sum(q) OVER (PARTITION BY k) AS nq FROM h WINDOW w AS (PARTITION BY k ORDER BY score DESC))"""


@query(
    "a10_detection_rates",
    f"""{_KNN}, used AS (SELECT * FROM score WHERE label > 0 OR role = 'holdout'),
        labelled AS (SELECT l.label AS k, s.score, s.label = l.label AS pos FROM (SELECT DISTINCT label FROM used WHERE label > 0) l JOIN used s ON s.label = l.label OR s.label = 0), {_HISTOGRAM},
        a AS (SELECT k, sum(q * (tp - p) + q * p / 2) / max(np * nq) AS auroc FROM c GROUP BY k)
        SELECT label, count(*) AS n, count(*) FILTER (score > 1) AS flagged, round(count(*) FILTER (score > 1) / count(*), 6) AS rate, round(quantile_cont(score, 0.5), 5) AS median, round(any_value(auroc), 6) AS auroc
        FROM used LEFT JOIN a ON a.k = used.label GROUP BY label""",
)
def a10_detection_rates(spark, d):
    """Fitted on label 0, every other label scored: rows, flagged, rate, median score, AUROC against the healthy holdout."""
    used = knn_scores(spark, d).filter("label > 0 OR role = 'holdout'")
    from phmspark.operators.quantiles import exact_quantiles

    rates = used.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 1).alias("flagged"))
    median = exact_quantiles(used, ["label"], "score", [0.5]).select("label", F.round("x", 5).alias("median"))
    others = used.filter("label > 0").select("label").distinct()
    healthy = used.filter("label = 0").select("score").crossJoin(F.broadcast(others)).select("label", "score", F.lit(False).alias("pos"))  # each label is held against the healthy rows
    both = healthy.unionByName(used.filter("label > 0").select("label", "score", F.lit(True).alias("pos")))
    auroc = metrics.auroc(both, ["label"], "score", "pos").withColumn("auroc", F.round("auroc", 6))
    return rates.withColumn("rate", F.round(F.col("flagged") / F.col("n"), 6)).join(median, "label").join(auroc, "label", "left").select("label", "n", "flagged", "rate", "median", "auroc")


@query(
    "e1_e4_openset_metrics",
    f"""{_KNN}, labelled AS (SELECT 'all' AS k, score, label > 0 AS pos FROM score WHERE label > 0 OR role = 'holdout'), {_HISTOGRAM},
        m AS (SELECT sum(q * (tp - p) + q * p / 2) / max(np * nq) AS auroc, sum(p / np * tp / (tp + fp)) AS aupr, min(fp / nq) FILTER (tp / np >= 0.95) AS fpr95 FROM c),
        t AS (SELECT count(*) FILTER (NOT pos AND score <= 1) AS tn, count(*) FILTER (NOT pos AND score > 1) AS fp, count(*) FILTER (pos AND score > 1) AS tp, count(*) FILTER (pos AND score <= 1) AS fn FROM labelled)
        SELECT round(auroc, 6) AS auroc, round(aupr, 6) AS aupr, round(coalesce(fpr95, 1), 6) AS fpr95, round(tn / (tn + fp), 6) AS known_accuracy, round((tn + tp) / (tn + fp + tp + fn), 6) AS accuracy,
        round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM m, t""",
)
def e1_e4_openset_metrics(spark, d):
    rows = knn_scores(spark, d).filter("label > 0 OR role = 'holdout'").select(F.lit("all").alias("k"), "score", (F.col("label") > 0).alias("pos"))
    m = metrics.openset_metrics(rows, ["k"], "score", "pos").drop("k")
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query(
    "m9_local_outlier",
    f"""WITH v AS ({FEATURES}), r AS ({ROLES}), b AS (SELECT vec_id, f FROM r WHERE label = 0 AND role = 'train'),
        nn AS (SELECT q.vec_id AS q, b.vec_id AS o, list_distance(q.f, b.f) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.f, b.f), b.vec_id) AS k FROM r q JOIN b ON q.vec_id <> b.vec_id),
        n AS (SELECT * FROM nn WHERE k <= 20), kd AS (SELECT q AS o, max(d) AS kd FROM n WHERE q IN (SELECT vec_id FROM b) GROUP BY q),
        lrd AS (SELECT q, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN kd USING (o) GROUP BY q)
        SELECT n.q AS vec_id, round(avg(l.lrd) / any_value(m.lrd), 5) AS lof FROM n JOIN lrd l ON l.q = n.o JOIN lrd m ON m.q = n.q GROUP BY n.q""",
)
def m9_local_outlier(spark, d):
    """Local outlier factor against the healthy training rows, 20 neighbours, a row never its own."""
    rows = written(ranking.with_role(features(spark, d), ["label"], "vec_id").select("vec_id", "label", "role", "f"), "roles")
    return detectors.local_outlier(rows, rows.filter("label = 0 AND role = 'train'"), 20, "vec_id").withColumn("lof", F.round("lof", 5))


@query("m8_isolation_forest")
def m8_isolation_forest(spark, d):
    """Trees grown on hashed samples of the healthy training rows; the anomaly score of every row."""
    rows = scaled_rows(spark, d)
    return detectors.isolation_scores(rows, rows.filter("label = 0 AND role = 'train'"), "vec_id", trees=200).select("vec_id", "label", F.round("iso", 6).alias("iso"))


@query("m11_reconstruction_error")
def m11_reconstruction_error(spark, d):
    """Length of what principal axes holding 95 % of the variance leave over."""
    rows = scaled_rows(spark, d)
    return detectors.pca_residual(rows, rows.filter("label = 0 AND role = 'train'"), 0.95).select("vec_id", "label", F.round("residual", 6).alias("residual"))


@query("m12_one_class_boundary")
def m12_one_class_boundary(spark, d):
    """One-class boundary in random Fourier features, by distributed sub-gradient steps (an approximation of the kernel machine)."""
    rows = scaled_rows(spark, d)
    return detectors.one_class(rows, rows.filter("label = 0 AND role = 'train'"), nu=0.05, steps=10).select("vec_id", "label", F.round("margin", 6).alias("margin"))


@query("m7_shared_calibration", "WITH v AS (SELECT vec_id, label, list_sum(list_transform(embedding, lambda x: x::DOUBLE ** 3)) AS x FROM embeddings), r AS (" + ROLES + "), c AS (SELECT quantile_cont(x, 0.95) AS t, min(x) AS low FROM r WHERE label = 0 AND role = 'cal') SELECT vec_id, round((x + CASE WHEN t > 0 THEN 0 ELSE 1e-9 - low END) / (t + CASE WHEN t > 0 THEN 0 ELSE 1e-9 - low END), 5) AS score FROM r, c")
def m7_shared_calibration(spark, d):
    """Any raw score (here the components' sum of cubes) over its calibration quantile, shifted first where that is not
    positive."""
    raw = F.aggregate("f", F.lit(0.0), lambda a, x: a + F.pow(x, F.lit(3.0)))
    rows = ranking.with_role(features(spark, d), ["label"], "vec_id").select("vec_id", "label", "role", raw.alias("x"))
    return openset.calibrated(rows, [], "x", (F.col("label") == 0) & (F.col("role") == "cal")).select("vec_id", F.round("score", 5).alias("score"))


# Models of versions: version ver knows the labels up to ver, scales by their training rows and fits each of them; the
# models' label is 100 * ver + label. "v" is the relation of rows, "upto" the last version
def versions_sql(v: str, upto: int) -> str:
    models = _LW[_LW.index("mean AS (") : _LW.index("dist AS (")]
    return f"""v AS ({v}), role_ AS ({ROLES}), ver AS (SELECT unnest(range(0, {upto + 1}))::INT AS ver),
  dims AS (SELECT vec_id, label, role, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM role_),
  scaler AS (SELECT ver, i, quantile_cont(x, 0.5) AS centre, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS spread FROM dims JOIN ver ON label <= ver WHERE role = 'train' GROUP BY ver, i),
  every AS (SELECT ver, vec_id, label, role, list((x - centre) / CASE WHEN spread = 0 THEN 1 ELSE spread END ORDER BY i) AS f FROM dims JOIN scaler USING (i) GROUP BY ver, vec_id, label, role),
  role AS (SELECT 100 * ver + label AS label, vec_id, role, f FROM every WHERE label <= ver),
  {models} dist AS (SELECT ver, vec_id, truth, role, cls, {_QUADRATIC} AS d FROM (SELECT e.ver, e.vec_id, e.label AS truth, e.role, p.label % 100 AS cls, p.p, list_transform(f, lambda a, i: a - mu[i]) AS z FROM every e JOIN p ON p.label // 100 = e.ver)),
  thr AS (SELECT ver, cls, quantile_cont(d, 0.95) AS threshold FROM dist WHERE truth = cls AND role = 'cal' GROUP BY ver, cls),
  best AS (SELECT *, row_number() OVER (PARTITION BY ver, vec_id ORDER BY s, cls) AS k FROM (SELECT ver, vec_id, truth, role, cls, d / greatest(threshold, 1e-12) AS s FROM dist JOIN thr USING (ver, cls)))"""


@query(
    "m24_registration",
    f"""WITH RECURSIVE {versions_sql(FEATURES, 9)} SELECT ver::INTEGER AS model_version, count(*) AS n_rows, count(*) FILTER (s > 1) AS n_unknown, count(*) FILTER (s > 1 AND truth > ver) AS n_novel,
        count(*) FILTER (truth <= ver AND role = 'holdout') AS n_holdout, count(*) FILTER (truth <= ver AND role = 'holdout' AND s <= 1 AND cls = truth) AS n_right, round(avg(s), 5) AS mean_score FROM best WHERE k = 1 GROUP BY ver""",
)
def m24_registration(spark, d):
    """Classes registered one after another: version v knows the labels up to v. Every version scales anew by all rows it
    is fitted on and fits all its classes; versions are keys of one job, and each scores all rows."""
    rows = written(ranking.with_role(features(spark, d), ["label"], "vec_id").select("vec_id", "label", "role", "f"), "roles")
    every = rows.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(9))))
    models, scalers = registered.fit(every.filter("label <= version").select("version", F.col("label").alias("cls"), "role", "f"))
    told = registered.scores(every, models, scalers)
    unknown, later = F.col("score") > 1, F.col("label") > F.col("version")
    held = ~later & (F.col("role") == "holdout")
    counts = (F.count("*").alias("n_rows"), F.count_if(unknown).alias("n_unknown"), F.count_if(unknown & later).alias("n_novel"), F.count_if(held).alias("n_holdout"), F.count_if(held & ~unknown & (F.col("cls") == F.col("label"))).alias("n_right"))
    return told.groupBy(F.col("version").alias("model_version")).agg(*counts, F.round(F.avg("score"), 5).alias("mean_score"))


@query(
    "m27_model_summary",
    f"""WITH RECURSIVE {versions_sql(FEATURES, 9)}, n AS (SELECT label, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'cal') AS n_cal, count(*) FILTER (role = 'holdout') AS n_holdout FROM role_ GROUP BY label)
        SELECT ver::INTEGER AS model_version, cls::INTEGER AS label, n_train, n_cal, n_holdout, round(threshold, 5) AS threshold, round(sh, 6) AS shrinkage, round(mu[1], 6) AS centre1, round(sqrt(list_inner_product(mu, mu)), 6) AS centre_norm, 'mahalanobis' AS score_type, 'own_p95' AS strategy
        FROM thr JOIN p ON p.label = 100 * ver + cls JOIN n ON n.label = cls""",
)
def m27_model_summary(spark, d):
    """Each class of each version: its rows by role, threshold, shrinkage and scaled centre."""
    rows = written(ranking.with_role(features(spark, d), ["label"], "vec_id").select("vec_id", "label", "role", "f"), "roles")
    every = rows.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(9)))).filter("label <= version")
    models, _ = registered.fit(every.select("version", F.col("label").alias("cls"), "role", "f"))
    counts = rows.groupBy("label").agg(*(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("train", "cal", "holdout")))
    return models.withColumnRenamed("cls", "label").join(counts, "label").select(
        *(F.col("version").alias("model_version"), "label", "n_train", "n_cal", "n_holdout", F.round("threshold", 5).alias("threshold"), F.round("shrinkage", 6).alias("shrinkage")),
        *(F.round(F.col("mu")[0], 6).alias("centre1"), F.round(S.norm(F.col("mu")), 6).alias("centre_norm"), F.lit("mahalanobis").alias("score_type"), F.lit("own_p95").alias("strategy")),
    )


@query(
    "m29_group_verdict",
    f"""WITH v AS ({FEATURES}), m AS (SELECT label, i, avg(x) AS a FROM (SELECT label, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM v) GROUP BY ALL), c AS (SELECT label, list(a ORDER BY i) AS centre FROM m GROUP BY label),
       g AS (SELECT list(a ORDER BY i) AS middle FROM (SELECT i, avg(a) AS a FROM m WHERE label < 6 GROUP BY i)), s AS (SELECT label, list_distance(centre, middle) AS dist FROM c, g), t AS (SELECT quantile_cont(dist, 0.95) AS t FROM s WHERE label < 6) SELECT label, round(dist, 6) AS distance, dist > t AS unknown FROM s, t""",
)
def m29_group_verdict(spark, d):
    """Centres of groups against the 95th percentile of the known centres' distances to their mean."""
    c = moments.means(features(spark, d), ["label"]).select("label", "mu")
    g = moments.means(c.filter("label < 6").select(F.col("mu").alias("f")), []).select(F.col("mu").alias("g"))
    s = c.crossJoin(F.broadcast(g)).withColumn("dist", S.distance(F.col("mu"), F.col("g")))
    t = s.filter("label < 6").agg(F.percentile("dist", 0.95).alias("t"))
    return s.crossJoin(F.broadcast(t)).select("label", F.round("dist", 6).alias("distance"), (F.col("dist") > F.col("t")).alias("unknown"))


@query(
    "t2_top_scores",
    "SELECT label, vec_id, round(x, 6) AS x FROM (SELECT label, vec_id, x, row_number() OVER (PARTITION BY label ORDER BY round(x, 6) DESC, vec_id) AS r FROM (SELECT label, vec_id, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS x FROM embeddings)) WHERE r <= 5",
)
def t2_top_scores(spark, d):
    """The five highest of each class: top-k is the operator."""
    high = F.aggregate("f", F.lit(0.0), lambda a, x: a + F.abs(x))  # the score: the components' sum of sizes
    e = features(spark, d).select("label", "vec_id", F.round(high, 6).alias("x"))
    return e.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("x"), "vec_id"))).filter("r <= 5").select("label", "vec_id", "x")


