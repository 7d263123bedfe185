"""Streams run to their end over the given events: R1-R3, R9, R10, S9; discovery: R4-R7."""

from __future__ import annotations

from pyspark.sql import functions as F

from phmspark.operators import quantiles
from phmspark.operators.registered import ModelTable
from phmspark.plans.base import SCORES, features, query, scores
from phmspark.plans.models import _KNN, knn_scores, scaled_rows, versions_sql
from phmspark.plans.series import _ALARM, _EWMA
from phmspark.sources.scratch import new_path, written
from phmspark.streaming import discovery, monitor, replay


@query("r1_score_stream", f"WITH s AS ({SCORES}), m AS (SELECT kind, quantile_cont(score, 0.9) AS t FROM s GROUP BY kind) SELECT event_id, round(score / t, 5) AS ratio, CASE WHEN score / t > 1 THEN 'unknown' ELSE 'known' END AS verdict FROM s JOIN m USING (kind)")
def r1_score_stream(spark, d):
    """The stream joined to a static table of thresholds."""
    models = quantiles.exact_quantiles(scores(spark, d), ["kind"], "score", [0.9]).select("kind", F.col("x").alias("threshold"))
    s = monitor.score_stream(monitor.read_events(spark, f"{d}/events.parquet"), models, "kind")
    return monitor.drain(s.select("event_id", F.round("ratio", 5).alias("ratio"), "verdict"), "scored")


@query("r2_trend_stream", f"WITH RECURSIVE {_EWMA} SELECT event_id, round(ewma, 6) AS ewma, round(cusum, 6) AS cusum FROM e")
def r2_trend_stream(spark, d):
    """Trend state by asset: the stream gives what the batch fold gives."""
    s = monitor.trend_stream(monitor.read_events(spark, f"{d}/events.parquet"))
    return monitor.drain(s.select("event_id", F.round("ewma", 6).alias("ewma"), F.round("cusum", 6).alias("cusum")), "trend")


@query(
    "r3_trajectory_stream",
    f"""WITH RECURSIVE {_ALARM}, sl AS (SELECT asset, rn, CASE WHEN rn >= 5 THEN -regr_slope(smoothed, rn) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) END AS rate FROM sm)
        SELECT s.event_id, round(a.smoothed, 6) AS smoothed, ['normal', 'warning', 'critical'][level + 1] AS alarm_state, round(rate, 5) AS rate, CASE WHEN rate IS NULL THEN 'insufficient_history' WHEN rate > 0.005 THEN 'worsening' WHEN rate < -0.005 THEN 'recovering' ELSE 'stable' END AS trend FROM al a JOIN sm s USING (asset, rn) JOIN sl USING (asset, rn)""",
)
def r3_trajectory_stream(spark, d):
    """Health trajectory state by asset."""
    from phmspark.operators import series

    e = scores(spark, d)
    q = quantiles.exact_quantiles(e, [], "score", [0.1, 0.95]).agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    h = monitor.read_events(spark, f"{d}/events.parquet").withColumn("health", series.health_index(F.col("score"), F.lit(q["low"]), F.lit(q["high"])))
    s = monitor.trajectory_stream(h)
    return monitor.drain(s.select("event_id", F.round("smoothed", 6).alias("smoothed"), "alarm_state", F.round("rate", 5).alias("rate"), "trend"), "trajectory")


@query("r9_live_metrics", f"SELECT kind, count(*) AS streamed, count(*) FILTER (score > 1) AS \"unknown\", round(avg(score), 5) AS mean FROM ({SCORES}) GROUP BY kind")
def r9_live_metrics(spark, d):
    """Counters of each source, as a complete result of the stream."""
    g = monitor.read_events(spark, f"{d}/events.parquet").groupBy("kind").agg(F.count("*").alias("streamed"), F.count_if(F.col("score") > 1).alias("unknown"), F.round(F.avg("score"), 5).alias("mean"))
    return monitor.drain(g, "live", "complete")


@query(
    "r10_sessions",
    f"WITH s AS (SELECT asset, ts, score, coalesce(ts - lag(ts) OVER (PARTITION BY asset ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS fresh FROM ({SCORES})), g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT asset, epoch_us(min(ts)) AS start, count(*) AS n, round(avg(score), 5) AS mean FROM g GROUP BY asset, k",
)
def r10_sessions(spark, d):
    """Sessions of an asset, cut at gaps of six hours."""
    s = monitor.sessions(monitor.read_events(spark, f"{d}/events.parquet"), "6 hours", "365 days")
    return monitor.drain(s.select("asset", F.unix_micros("start").alias("start"), "n", F.round("mean", 5).alias("mean")), "sessions", "complete")


@query("r4_quarantine", f"{_KNN} SELECT label, count(*) AS held, round(min(score), 5) AS least FROM score WHERE score > 0.9 GROUP BY label")
def r4_quarantine(spark, d):
    """Rows beyond the margin (here 0.9), equal vectors once, by true label."""
    rows = knn_scores(spark, d).join(features(spark, d).select("vec_id", "f"), "vec_id")
    return discovery.quarantine(rows, margin=0.9).groupBy("label").agg(F.count("*").alias("held"), F.round(F.min("score"), 5).alias("least"))


@query("r4_attempts", f"{_KNN} SELECT vec_id, n, n >= 25 AND (n - 25) % 10 = 0 AS attempt FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM score WHERE score > 0.9)")
def r4_attempts(spark, d):
    """Quarantined rows (margin here 0.9) as they arrive, and at which of them clustering is tried."""
    rows = knn_scores(spark, d).join(features(spark, d).select("vec_id", "f"), "vec_id")
    return discovery.attempts(discovery.quarantine(rows, margin=0.9).select("vec_id"), "vec_id")


@query("r5_r7_discovery")
def r5_r7_discovery(spark, d):
    """Rows quarantined (margin 1.0) in one batch, clustered by the density ladder; for each true label how many are
    held, clustered, rejected, adopted and pruned. The largest cluster of 25 rows or more is adopted if its median score
    is above the largest calibration score of the known rows, else it leaves the quarantine and the ladder starts again.
    After the first adoption the detector is refitted and what it then knows is pruned."""
    scored = knn_scores(spark, d)
    boundary = scored.filter("label = 0 AND role = 'cal'").agg(F.max("score")).first()[0]
    held = written(discovery.quarantine(scored.join(features(spark, d).select("vec_id", "f"), "vec_id"), margin=1.0), "quarantine")
    left, said, verdict = held, held.select("vec_id", F.lit("").alias("fate")).limit(0), "rejected"
    while verdict == "rejected":
        clusters, top = discovery.candidate(left)
        said = said.unionByName(clusters.select("vec_id", F.lit("clustered").alias("fate")))
        if top.isEmpty():
            break
        verdict = discovery.adopt(top.join(held, "vec_id"), boundary)[0]
        said = said.unionByName(top.select("vec_id", F.lit(verdict).alias("fate")))
        left = written(left.join(top, "vec_id", "left_anti"), "quarantine")
        if verdict == "adopted":
            rows = scaled_rows(spark, d).select("vec_id", "f")
            again = discovery.refit(rows.join(top, "vec_id", "left_semi"), left.select("vec_id", "score").join(rows, "vec_id"))
            gone = left.join(discovery.pruned(left, again, 1.0), "vec_id", "left_anti")
            said = said.unionByName(gone.select("vec_id", F.lit("pruned").alias("fate")))
    fates = said.groupBy("vec_id").agg(F.collect_set("fate").alias("fates"))
    met = held.join(fates, "vec_id", "left")
    return met.groupBy("label").agg(F.count("*").alias("held"), *(F.count_if(F.array_contains("fates", x)).alias(x) for x in ("clustered", "rejected", "adopted", "pruned")))


# Configurations far from healthy: component k of the rows of label k is moved by 10
_MOVED = "SELECT vec_id, label, list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN label > 0 AND i = label + 1 THEN 10 ELSE 0 END) AS f FROM embeddings"


def moved(spark, d):
    """vec_id, label, config, f: the given vectors, those of each fault label moved along an axis of its own."""
    f = F.transform("f", lambda x, i: x + F.when((F.col("label") > 0) & (i == F.col("label")), 10.0).otherwise(0.0))
    return features(spark, d).select("vec_id", "label", F.concat(F.lit("c"), F.col("label").cast("string")).alias("config"), f.alias("f"))


def _streamed(spark, rows, order: str):
    """Rows as a stream of one file for each parity of ``order``, the even first."""
    path = new_path(spark, "rows")
    for k in (0, 1):
        rows.filter(F.col(order) % 2 == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("r1_latest_version", f"WITH RECURSIVE {versions_sql(_MOVED, 1)} SELECT vec_id, ver AS version, round(s, 5) AS score, CASE WHEN s > 1 THEN 'unknown' WHEN cls = 0 THEN 'healthy' ELSE 'known' END AS verdict FROM best WHERE k = 1")
def r1_latest_version(spark, d):
    """All rows streamed under version 0, then, by a second stream, under version 1 that is published in between."""
    rows = moved(spark, d)
    table = ModelTable(spark, new_path(spark, "models"))
    out = None
    for label in (0, 1):
        table.register(rows.filter(F.col("label") == label))
        path = new_path(spark, "scored")
        replay.score_latest(_streamed(spark, rows.select("vec_id", "f"), "vec_id"), table, path, new_path(spark, "state")).awaitTermination()
        told = spark.read.parquet(path).select("vec_id", "version", F.round("score", 5).alias("score"), "verdict")
        out = told if out is None else out.unionByName(told)
    return out


@query("r4_quarantine_stream", f"WITH RECURSIVE {versions_sql(_MOVED, 0)}, q AS (SELECT vec_id, s, row_number() OVER (ORDER BY vec_id % 2, vec_id) AS n FROM best WHERE k = 1 AND s > 2) SELECT vec_id, n, round(s, 5) AS score, n >= 25 AND (n - 25) % 10 = 0 AS attempt FROM q")
def r4_quarantine_stream(spark, d):
    """Rows beyond the margin of 2, held batch by batch, and at which of them clustering is tried."""
    rows = moved(spark, d)
    table = ModelTable(spark, new_path(spark, "models"))
    table.register(rows.filter("label = 0"))
    held = replay.Quarantine(spark, new_path(spark, "quarantine"))
    stream = _streamed(spark, rows.select("vec_id", "f"), "vec_id")
    replay.quarantine_stream(stream, table, held, new_path(spark, "state")).awaitTermination()
    return held.rows().select("vec_id", "n", F.round("score", 5).alias("score"), "attempt")


@query("r7_replay")
def r7_replay(spark, d):
    """The fault labels injected one after another: what each stage found (matched: the majority of its class), and what the
    last version makes of each configuration's external rows (n, shares; matched_rate: in a class of that majority)."""
    rows = moved(spark, d)
    labels = [r["label"] for r in rows.filter("label > 0").select("label").distinct().orderBy("label").collect()]  # configurations: a stage each
    run = replay.Replay(rows.select("vec_id", "config", "f"), "c0", [f"c{x}" for x in labels], new_path(spark, "replay"))
    stages = spark.createDataFrame([(s.config, s.ticks, s.discovered, s.matched, s.cluster_size, s.purity, s.pruned, s.held, s.version, s.duplicates, s.own_holdout, s.healthy_holdout) for s in run.run()], "config string, ticks long, discovered boolean, matched string, cluster_size long, purity double, pruned long, held long, version long, duplicates long, own_holdout double, healthy_holdout double")
    rejected = run.rejections.groupBy("config").agg(F.count("*").alias("rejections"))
    return stages.join(run.external().withColumnRenamed("matched", "matched_rate"), "config", "left").join(rejected, "config", "left").na.fill(0, ["rejections"])
