"""Many keys in one job: J4, A17-A19, A27, M25, M26. Labels' rows are dealt to three conditions by vec_id % 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phmspark.functions import scalars as S
from phmspark.operators import metrics, moments, quantiles, ranking
from phmspark.plans.base import query, table
from phmspark.sources.scratch import written

# Conditions' healthy (label < 5) and other rows; a condition's model is its training mean and the 95th percentile of
# its calibration rows' distances from it.
_ROWS = """v AS (SELECT vec_id, vec_id % 3 AS cond, label < 5 AS healthy, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings),
  r AS (SELECT *, CASE WHEN NOT healthy THEN 'fault' WHEN k < floor(0.6 * n) THEN 'train' WHEN k < floor(0.6 * n) + greatest(1, floor(0.2 * n)) THEN 'cal' ELSE 'holdout' END AS role FROM (
    SELECT *, row_number() OVER (PARTITION BY cond, healthy ORDER BY md5('42:' || vec_id), vec_id) - 1 AS k, count(*) OVER (PARTITION BY cond, healthy) AS n FROM v))"""
_FIT = f"""{_ROWS},
  m AS (SELECT src, list(a ORDER BY i) AS mu, list(b ORDER BY i) AS med FROM (SELECT src, i, avg(x) AS a, quantile_cont(x, 0.5) AS b FROM (SELECT cond AS src, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM r WHERE role = 'train') GROUP BY ALL) GROUP BY src),
  t AS (SELECT src, quantile_cont(list_distance(f, mu), 0.95) AS t FROM r JOIN m ON src = cond WHERE role = 'cal' GROUP BY src),
  pairs AS (SELECT src, cond AS dst, role, healthy, list_distance(f, mu) / t AS score FROM r, m JOIN t USING (src) WHERE src <> cond OR role IN ('holdout', 'fault')),
  labelled AS (SELECT src || ':' || dst AS k, src, dst, score, NOT healthy AS pos FROM pairs),
  h AS (SELECT k, src, dst, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM labelled GROUP BY ALL),
  c AS (SELECT *, sum(p) OVER w AS tp, sum(p) OVER (PARTITION BY k) AS np, sum(q) OVER (PARTITION BY k) AS nq FROM h WINDOW w AS (PARTITION BY k ORDER BY score DESC)),
  cell AS (SELECT src, dst, sum(q * (tp - p) + q * p / 2) / max(np * nq) AS auroc FROM c GROUP BY src, dst)"""


def conditioned(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    rows = ranking.with_role(e.select("vec_id", (F.col("vec_id") % 3).alias("cond"), (F.col("label") < 5).alias("healthy"), F.col("embedding").cast("array<double>").alias("f")), ["cond", "healthy"], "vec_id")
    return written(rows.withColumn("role", F.when(F.col("healthy"), F.col("role")).otherwise("fault")), "conditions")


def baselines(rows: DataFrame, key: str) -> DataFrame:
    """key, mu, t of every value of ``key``: one grouped job, however many there are."""
    m = moments.means(rows.filter("role = 'train'"), [key]).select(key, "mu")
    cal = rows.filter("role = 'cal'").join(m, key).withColumn("d", S.distance(F.col("f"), F.col("mu")))
    return m.join(quantiles.exact_quantiles(cal, [key], "d", [0.95]).select(key, F.col("x").alias("t")), key)


def crossed(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, role, healthy, score of every row under every condition's model; at home only rows it was not fitted on."""
    rows = conditioned(spark, d)
    models = baselines(rows, "cond").withColumnRenamed("cond", "src")
    met = rows.withColumnRenamed("cond", "dst").crossJoin(F.broadcast(models))  # models: a row for each condition
    return met.filter("src <> dst OR role IN ('holdout', 'fault')").select("src", "dst", "role", "healthy", (S.distance(F.col("f"), F.col("mu")) / F.col("t")).alias("score"))


def cell_aurocs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auroc(crossed(spark, d).select("src", "dst", "score", (~F.col("healthy")).alias("pos")), ["src", "dst"], "score", "pos")


@query("j4_cross_condition", f"WITH {_FIT} SELECT src, dst, round(auroc, 5) AS auroc FROM cell")
def j4_cross_condition(spark, d):
    return cell_aurocs(spark, d).withColumn("auroc", F.round("auroc", 5))


@query("a19_matrix_summary", f"WITH {_FIT} SELECT round(avg(auroc) FILTER (src = dst), 5) AS diag, round(avg(auroc) FILTER (src <> dst), 5) AS off_diag, round(min(auroc), 5) AS least FROM cell")
def a19_matrix_summary(spark, d):
    same, a = F.col("src") == F.col("dst"), F.col("auroc")
    return cell_aurocs(spark, d).agg(F.round(F.avg(F.when(same, a)), 5).alias("diag"), F.round(F.avg(F.when(~same, a)), 5).alias("off_diag"), F.round(F.min(a), 5).alias("least"))


@query("a17_drift", f"WITH {_FIT} SELECT dst, round(quantile_cont(score, 0.5), 5) AS median, round(quantile_cont(score, 0.9), 5) AS p90, round(avg((score > 1)::INT), 5) AS flagged FROM pairs WHERE src = 0 AND healthy GROUP BY dst")
def a17_drift(spark, d):
    """Every condition's healthy rows under condition 0's baseline."""
    rows = crossed(spark, d).filter("src = 0 AND healthy").select("dst", "score")
    q = quantiles.exact_quantiles(rows, ["dst"], "score", [0.5, 0.9]).groupBy("dst").agg(F.round(F.min("x"), 5).alias("median"), F.round(F.max("x"), 5).alias("p90"))
    return rows.groupBy("dst").agg(F.round(F.avg((F.col("score") > 1).cast("int")), 5).alias("flagged")).join(q, "dst")


@query(
    "a18_strategies",
    f"""WITH {_ROWS},
       z AS (SELECT r.*, s.strategy, CASE s.strategy WHEN 'per_condition' THEN 'c' || cond WHEN 'all_mixed' THEN 'all' ELSE 'p' || cond % 2 END AS g FROM r, (SELECT unnest(['per_condition', 'all_mixed', 'per_rpm']) AS strategy) s),
       m AS (SELECT g, list(a ORDER BY i) AS mu FROM (SELECT g, i, avg(x) AS a FROM (SELECT g, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM z WHERE role = 'train') GROUP BY ALL) GROUP BY g),
       t AS (SELECT g, quantile_cont(list_distance(f, mu), 0.95) AS t FROM z JOIN m USING (g) WHERE role = 'cal' GROUP BY g)
       SELECT strategy, round(avg((s <= 1)::INT) FILTER (healthy), 5) AS accept, round(avg((s > 1)::INT) FILTER (NOT healthy), 5) AS detect FROM (SELECT strategy, healthy, list_distance(f, mu) / t AS s FROM z JOIN m USING (g) JOIN t USING (g) WHERE role IN ('holdout', 'fault')) GROUP BY strategy""",
)
def a18_strategies(spark, d):
    """A baseline for each condition, for all, or for each speed: rows bear all three keys, one job fits every baseline."""
    c = F.col("cond")
    keys = F.array(F.struct(F.lit("per_condition").alias("strategy"), F.concat(F.lit("c"), c.cast("string")).alias("g")), F.struct(F.lit("all_mixed").alias("strategy"), F.lit("all").alias("g")), F.struct(F.lit("per_rpm").alias("strategy"), F.concat(F.lit("p"), (c % 2).cast("string")).alias("g")))
    z = conditioned(spark, d).withColumn("k", F.explode(keys)).select("*", "k.strategy", "k.g").drop("k")
    s = z.filter("role IN ('holdout', 'fault')").join(baselines(z, "g"), "g").withColumn("s", S.distance(F.col("f"), F.col("mu")) / F.col("t"))
    h = F.col("healthy")
    return s.groupBy("strategy").agg(F.round(F.avg(F.when(h, (F.col("s") <= 1).cast("int"))), 5).alias("accept"), F.round(F.avg(F.when(~h, (F.col("s") > 1).cast("int"))), 5).alias("detect"))


# Scores of the strategies: the source's model as it is (all rows of the target), moved by the difference of medians
# that ``size`` support rows tell, and a model of these support rows alone (rows that are no support)
_TRANSFER = f"""{_FIT}, sup AS (SELECT r.* EXCLUDE (k, n), nn.n AS size, row_number() OVER (PARTITION BY cond, nn.n ORDER BY md5('13:' || vec_id), vec_id) - 1 AS k FROM r, (SELECT unnest([10, 20]) AS n) nn WHERE healthy),
  med AS (SELECT cond AS dst, size, list(b ORDER BY i) AS med FROM (SELECT cond, size, i, quantile_cont(x, 0.5) AS b FROM (SELECT cond, size, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM sup WHERE k < size) GROUP BY ALL) GROUP BY ALL),
  own AS (SELECT cond AS dst, size, list(a ORDER BY i) AS mu FROM (SELECT cond, size, i, avg(x) AS a FROM (SELECT cond, size, generate_subscripts(f, 1) AS i, unnest(f) AS x FROM sup WHERE k < floor(0.6 * size)) GROUP BY ALL) GROUP BY ALL),
  lim AS (SELECT dst, own.size, quantile_cont(list_distance(f, mu), 0.95) AS t FROM sup JOIN own ON dst = cond AND own.size = sup.size WHERE k >= floor(0.6 * sup.size) AND k < floor(0.6 * sup.size) + greatest(1, floor(0.2 * sup.size)) GROUP BY ALL),
  ev AS (SELECT cond AS dst, size, healthy, f FROM sup WHERE k >= size UNION ALL SELECT cond, nn.n, healthy, f FROM r, (SELECT unnest([10, 20]) AS n) nn WHERE NOT healthy),
  said AS (SELECT 'direct' AS strategy, 0 AS size, src, dst, healthy, score FROM (SELECT src, cond AS dst, healthy, list_distance(f, mu) / t AS score FROM r, m JOIN t USING (src) WHERE src <> cond)
    UNION ALL SELECT 'adapted', size, src, dst, healthy, list_distance(list_transform(f, lambda x, i: x - (tm[i] - m.med[i])), m.mu) / t FROM (SELECT ev.*, med.med AS tm FROM ev JOIN med USING (dst, size)), m JOIN t USING (src) WHERE src <> dst
    UNION ALL SELECT 'scratch', ev.size, -1, ev.dst, healthy, list_distance(f, own.mu) / greatest(lim.t, 1e-12) FROM ev JOIN own USING (dst, size) JOIN lim USING (dst, size)),
  th AS (SELECT strategy, size, src, dst, score, count(*) FILTER (NOT healthy) AS p, count(*) FILTER (healthy) AS q FROM said GROUP BY ALL),
  tc AS (SELECT *, sum(p) OVER w AS tp, sum(p) OVER (PARTITION BY strategy, size, src, dst) AS np, sum(q) OVER (PARTITION BY strategy, size, src, dst) AS nq FROM th WINDOW w AS (PARTITION BY strategy, size, src, dst ORDER BY score DESC)),
  au AS (SELECT strategy, size, src, dst, sum(q * (tp - p) + q * p / 2) / max(np * nq) AS auroc FROM tc GROUP BY ALL),
  ra AS (SELECT strategy, size, src, dst, avg((score <= 1)::INT) FILTER (healthy) AS accept, avg((score > 1)::INT) FILTER (NOT healthy) AS detect FROM said GROUP BY ALL)"""


def transfer_scores(spark: SparkSession, d: str) -> DataFrame:
    """strategy, size, src, dst, healthy, score: one grouped fit for the conditions' models, one for all scratch models."""
    rows = conditioned(spark, d)
    models = baselines(rows, "cond").withColumnRenamed("cond", "src")
    sized = rows.withColumn("size", F.explode(F.array(F.lit(10), F.lit(20)))).drop("r", "n")
    ranked = written(ranking.hash_rank(sized.filter("healthy"), ["cond", "size"], "vec_id", seed=13, count=None), "ranked")
    median = lambda df, keys: quantiles.exact_quantiles(df.select(*keys, F.posexplode("f").alias("i", "x")), [*keys, "i"], "x", [0.5]).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("med"))
    target = median(ranked.filter("r < size"), ["cond", "size"]).withColumnRenamed("med", "tmed")
    source = median(rows.filter("role = 'train'"), ["cond"]).select(F.col("cond").alias("src"), F.col("med").alias("smed"))
    train, cal = F.floor(0.6 * F.col("size")), F.greatest(F.lit(1), F.floor(0.2 * F.col("size")))
    part = F.when(F.col("r") < train, "train").when(F.col("r") < train + cal, "cal").otherwise("rest")
    own = baselines(ranked.filter("r < size").withColumn("role", part).withColumn("g", F.struct("cond", "size")), "g").select("g.cond", "g.size", F.col("mu").alias("own"), F.greatest("t", F.lit(1e-12)).alias("own_t"))
    held = ranked.filter("r >= size").drop("r").unionByName(sized.filter("NOT healthy"))
    near = F.broadcast(models.join(source, "src"))  # models: a row for each condition
    moved = F.zip_with("f", F.zip_with("tmed", "smed", lambda a, b: a - b), lambda x, s: x - s)
    kept = lambda df, strategy, size, src, score: df.select(F.lit(strategy).alias("strategy"), size.alias("size"), src.alias("src"), F.col("cond").alias("dst"), "healthy", score.alias("score"))
    direct = kept(rows.crossJoin(F.broadcast(models)).filter("src <> cond"), "direct", F.lit(0), F.col("src"), S.distance(F.col("f"), F.col("mu")) / F.col("t"))
    adapted = kept(held.join(target, ["cond", "size"]).crossJoin(near).filter("src <> cond"), "adapted", F.col("size"), F.col("src"), S.distance(moved, F.col("mu")) / F.col("t"))
    scratch = kept(held.join(own, ["cond", "size"]), "scratch", F.col("size"), F.lit(-1).cast("long"), S.distance(F.col("f"), F.col("own")) / F.col("own_t"))
    return written(direct.unionByName(adapted).unionByName(scratch), "transfer")


@query("m25_a27_transfer", f"WITH {_TRANSFER} SELECT strategy, size AS n_support, round(avg(auroc), 5) AS auroc, round(avg(accept), 5) AS accept, round(avg(detect), 5) AS detect FROM au JOIN ra USING (strategy, size, src, dst) GROUP BY ALL")
def m25_a27_transfer(spark, d):
    """Each ordered pair of conditions under every strategy; AUROC, acceptance and detection averaged over pairs."""
    s, keys = transfer_scores(spark, d), ["strategy", "size", "src", "dst"]
    h = F.col("healthy")
    rates = s.groupBy(*keys).agg(F.avg(F.when(h, (F.col("score") <= 1).cast("int"))).alias("accept"), F.avg(F.when(~h, (F.col("score") > 1).cast("int"))).alias("detect"))
    auroc = metrics.auroc(s.withColumn("pos", ~h), keys, "score", "pos")
    return auroc.join(rates, keys).groupBy("strategy", F.col("size").alias("n_support")).agg(*(F.round(F.avg(c), 5).alias(c) for c in ("auroc", "accept", "detect")))


@query("m26_protocols")
def m26_protocols(spark, d):
    """Protocols (A: labels below 6 known; B: the healthy label alone), seeds and estimators as keys of grouped jobs: known
    holdouts and all unknown rows to classes; accuracies, macro F1 and the F1 of unknown rows."""
    from phmspark.operators import openset

    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("f"))
    parts = None
    for seed in (42, 123, 7):  # splits differ by seed; each adds its rows to one keyed table
        rows = ranking.with_role(e, ["label"], "vec_id", seed=seed).withColumn("seed", F.lit(seed))
        parts = rows if parts is None else parts.unionByName(rows)
    parts = written(parts, "protocol-rows")
    known = (F.col("protocol") == "A") & (F.col("label") < 6) | (F.col("label") == 0)
    out = None
    for estimator in ("ledoit_wolf", "pooled"):
        models = moments.fit_mahalanobis(parts.filter("role = 'train' AND label < 6"), ["seed", "label"], estimator=estimator)
        dist = moments.distances(parts, models, "label", key="seed").select("vec_id", "seed", "label", "role", F.explode("ds").alias("cls", "d")).withColumn("cls", F.col("cls").cast("int"))
        long = dist.withColumn("m", F.concat_ws(":", "seed", "cls")).withColumn("protocol", F.explode(F.array(F.lit("A"), F.lit("B")))).filter("protocol = 'A' OR cls = 0")
        long = written(long.withColumn("row", F.concat_ws(":", "protocol", "seed", "vec_id")), "distances")
        fit = openset.thresholds(long.filter("protocol = 'A' AND label = cls AND role = 'cal'"), "m", "d")
        told = openset.decide(long, fit, "row", "m", "d").withColumn("pred", F.when(F.col("verdict") == "unknown", -1).otherwise(F.split("nearest", ":")[1].cast("int")))
        truth = long.select("row", "protocol", "seed", "label", "role").distinct().filter(~known | (F.col("role") == "holdout")).select("row", "protocol", "seed", F.when(known, F.col("label")).otherwise(-1).alias("truth"))
        met = told.join(truth, "row").withColumn("estimator", F.lit(estimator)).select("protocol", "estimator", "seed", "truth", "pred")
        out = met if out is None else out.unionByName(met)
    keys = ["protocol", "estimator", "seed"]
    counts = written(out.groupBy(*keys, "truth", "pred").agg(F.count("*").alias("n")), "counts")
    m = metrics.per_class(counts, keys, "truth", "pred").join(metrics.label_f1(counts, keys, "truth", "pred", -1).withColumnRenamed("f1", "unknown_f1"), keys)
    return m.select(*keys, *(F.round(c, 5).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "unknown_f1")))
