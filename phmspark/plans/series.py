"""Series of assets: W1-W12, S10-S12, S14, P12-P14, M19-M23, A24-A26, R8's batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phmspark.functions import scalars as S
from phmspark.operators import quantiles, ranking, series
from phmspark.plans.base import SCORES, query, scores, table

ORDER = ["ts", "event_id"]
_N = f"n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts, event_id) AS rn FROM ({SCORES}))"
_EWMA = f"""{_N}, e AS (SELECT asset, event_id, rn, score, 0.08 * (CASE WHEN score > 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS ewma, greatest(0, score - 1)::DOUBLE AS cusum FROM n WHERE rn = 1
  UNION ALL SELECT n.asset, n.event_id, n.rn, n.score, e.ewma + 0.08 * (CASE WHEN n.score > 1 THEN 1.0 ELSE 0.0 END - e.ewma), greatest(0, e.cusum + n.score - 1) FROM e JOIN n ON n.asset = e.asset AND n.rn = e.rn + 1)"""
_HEALTH = f"""{_N}, q AS (SELECT quantile_cont(score, 0.1) AS a, quantile_cont(score, 0.95) AS b FROM n),
  hl AS (SELECT asset, event_id, ts, rn, greatest(0, least(1, CASE WHEN score <= b THEN 1 - 0.5 * (score - a) / (b - a) ELSE 0.5 - 0.5 * (score - b) / b END)) AS h FROM n, q),
  rb AS (SELECT *, quantile_cont(h, 0.5) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS robust FROM hl),
  sm AS (SELECT asset, event_id, rn, robust, robust AS smoothed FROM rb WHERE rn = 1 UNION ALL SELECT r.asset, r.event_id, r.rn, r.robust, 0.2 * r.robust + (1 - 0.2) * s.smoothed FROM sm s JOIN rb r ON r.asset = s.asset AND r.rn = s.rn + 1)"""
_ALARM = _HEALTH + """, al AS (SELECT asset, rn, smoothed, 0 AS level, CASE WHEN smoothed < 0.5 THEN 1 ELSE 0 END AS way, CASE WHEN smoothed < 0.5 THEN 1 ELSE 0 END AS streak FROM sm WHERE rn = 1
  UNION ALL SELECT asset, rn, smoothed, CASE WHEN st >= 3 THEN tgt ELSE level END, CASE WHEN st >= 3 THEN 0 ELSE w END, CASE WHEN st >= 3 THEN 0 ELSE st END FROM (
    SELECT *, CASE WHEN w = 0 THEN 0 WHEN w = way THEN streak + 1 ELSE 1 END AS st FROM (SELECT *, sign(tgt - level)::INTEGER AS w FROM (
      SELECT s.asset, s.rn, s.smoothed, a.level, a.way, a.streak, CASE WHEN a.level = 0 THEN CASE WHEN s.smoothed < 0.2 THEN 2 WHEN s.smoothed < 0.5 THEN 1 ELSE 0 END
        WHEN a.level = 1 THEN CASE WHEN s.smoothed < 0.2 THEN 2 WHEN s.smoothed >= 0.6 THEN 0 ELSE 1 END ELSE CASE WHEN s.smoothed >= 0.6 THEN 0 WHEN s.smoothed >= 0.3 THEN 1 ELSE 2 END END AS tgt
      FROM al a JOIN sm s ON s.asset = a.asset AND s.rn = a.rn + 1))))"""


def trends(spark: SparkSession, d: str) -> DataFrame:
    return series.trend(scores(spark, d), ["asset"], ORDER, "score")


def healths(spark: SparkSession, d: str) -> DataFrame:
    """asset, ts, event_id, score and health, anchored on all scores."""
    e = scores(spark, d)
    q = quantiles.exact_quantiles(e, [], "score", [0.1, 0.95])
    anchors = q.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return e.crossJoin(F.broadcast(anchors)).withColumn("health", series.health_index(F.col("score"), F.col("low"), F.col("high"))).drop("low", "high")


def paths(spark: SparkSession, d: str) -> DataFrame:
    return series.trajectory(healths(spark, d), ["asset"], ORDER, "health")


@query("w1_rolling_median", f"WITH {_N} SELECT event_id, round(quantile_cont(score, 0.5) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS median FROM n")
def w1_rolling_median(spark, d):
    w = Window.partitionBy("asset").orderBy(*ORDER).rowsBetween(-2, 0)
    return scores(spark, d).select("event_id", F.round(F.percentile("score", 0.5).over(w), 6).alias("median"))


@query("w2_w3_ewma_cusum", f"WITH RECURSIVE {_EWMA} SELECT event_id, round(ewma, 6) AS ewma, round(cusum, 6) AS cusum FROM e")
def w2_w3_ewma_cusum(spark, d):
    return trends(spark, d).select("event_id", F.round("ewma", 6).alias("ewma"), F.round("cusum", 6).alias("cusum"))


@query(
    "w4_w5_alarms",
    f"""WITH RECURSIVE {_EWMA}, w AS (SELECT *, count(*) FILTER (ewma >= 0.2 AND ewma < 0.5) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS dwell FROM e),
        f AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY rn) AS k FROM w WHERE rn > 10 AND ewma >= 0.5) SELECT asset, event_id, rn AS t, dwell::INTEGER AS dwell, CASE WHEN dwell <= 12 THEN 'sudden' ELSE 'gradual' END AS kind FROM f WHERE k = 1""",
)
def w4_w5_alarms(spark, d):
    """First alarm of each asset after the warm-up, its dwell in the middle band and verdict."""
    t = trends(spark, d).withColumn("t", F.row_number().over(Window.partitionBy("asset").orderBy(*ORDER)).cast("long"))
    return t.filter("alarm_now").select("asset", "event_id", "t", "dwell", F.col("verdict").alias("kind"))


@query(
    "w6_slopes",
    f"WITH {_N} SELECT event_id, round(regr_slope(score, rn) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 119 PRECEDING AND CURRENT ROW), 9) AS slope FROM n QUALIFY rn >= 5",
)
def w6_slopes(spark, d):
    w = Window.partitionBy("asset").orderBy(*ORDER)
    n = scores(spark, d).withColumn("rn", F.row_number().over(w))
    return n.withColumn("slope", F.round(F.regr_slope("score", F.col("rn").cast("double")).over(w.rowsBetween(-119, 0)), 9)).filter("rn >= 5").select("event_id", "slope")


@query(
    "w7_change_points",
    f"WITH RECURSIVE {_HEALTH}, fl AS (SELECT *, coalesce(lag(smoothed) OVER (PARTITION BY asset ORDER BY rn) - robust >= 0.15, false) AS fell FROM sm), g AS (SELECT *, sum(CASE WHEN fell THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY rn) AS isle FROM fl), st AS (SELECT *, sum(fell::INT) OVER (PARTITION BY asset, isle ORDER BY rn) AS streak FROM g) SELECT event_id, CASE WHEN NOT fell THEN 'none' WHEN streak >= 2 THEN 'confirmed' ELSE 'candidate' END AS change FROM st",
)
def w7_change_points(spark, d):
    return paths(spark, d).select("event_id", "change")


@query("w8_alarm_levels", f"WITH RECURSIVE {_ALARM} SELECT s.event_id, round(a.smoothed, 6) AS smoothed, ['normal', 'warning', 'critical'][level + 1] AS alarm_state FROM al a JOIN sm s USING (asset, rn)")
def w8_alarm_levels(spark, d):
    return paths(spark, d).select("event_id", F.round("smoothed", 6).alias("smoothed"), "alarm_state")


@query("w9_transitions", f"WITH RECURSIVE {_ALARM}, c AS (SELECT asset, rn, level, lag(level) OVER (PARTITION BY asset ORDER BY rn) AS before FROM al) SELECT asset, count(*) FILTER (level <> before) AS transitions FROM c GROUP BY asset")
def w9_transitions(spark, d):
    before = F.lag("alarm_state").over(Window.partitionBy("asset").orderBy(*ORDER))
    return paths(spark, d).withColumn("before", before).groupBy("asset").agg(F.count_if(F.col("alarm_state") != F.col("before")).alias("transitions"))


@query("w11_latest", f"SELECT asset, max_by(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM ({SCORES}) GROUP BY asset")
def w11_latest(spark, d):
    return scores(spark, d).groupBy("asset").agg(F.max_by("event_id", F.struct(*ORDER)).alias("event_id"), F.count("*").alias("n"))


@query("w12_last_events", f"SELECT asset, event_id FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC, event_id DESC) AS r FROM ({SCORES})) WHERE r <= 5")
def w12_last_events(spark, d):
    """The last five of each asset: a bounded history is the operator."""
    w = Window.partitionBy("asset").orderBy(F.desc("ts"), F.desc("event_id"))
    return scores(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 5").select("asset", "event_id")


@query("s10_replay", "SELECT label, lap, vec_id, ((lap - 1) * n + r)::BIGINT AS t FROM (SELECT label, lap, vec_id, count(*) OVER (PARTITION BY label, lap) AS n, row_number() OVER (PARTITION BY label, lap ORDER BY md5('3:' || lap || ':' || vec_id), lap || ':' || vec_id) AS r FROM embeddings, (SELECT unnest([1, 2, 3]) AS lap))")
def s10_replay(spark, d):
    """Every row once a lap, in a new order each lap, three laps."""
    return ranking.replay(table(spark, d, "embeddings").select("label", "vec_id"), ["label"], "vec_id", 3).select("label", "lap", "vec_id", "t")


_UNIFORM = "('0x' || substr(md5('{s}:' || vec_id), 1, 7))::BIGINT / 268435456.0"


@query(
    "s11_scenario",
    f"WITH e AS (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 0.2 WHEN vec_id % 3 = 1 THEN 0.6 ELSE 1.0 END AS ratio, {_UNIFORM.format(s=9)} AS u FROM embeddings WHERE label > 0), k AS (SELECT count(*) AS k FROM embeddings WHERE label = 0), hl AS (SELECT vec_id, row_number() OVER (ORDER BY md5('4:' || vec_id), vec_id) - 1 AS r FROM embeddings WHERE label = 0) SELECT e.vec_id AS tick, u < ratio AS is_fault, CASE WHEN u < ratio THEN e.vec_id ELSE hl.vec_id END AS drawn FROM e, k JOIN hl ON hl.r = e.vec_id % k.k",
)
def s11_scenario(spark, d):
    """Each tick draws its fault row with the phase's mixing ratio, else a healthy row."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    i = F.col("vec_id")
    ratio = F.when(i % 3 == 0, 0.2).when(i % 3 == 1, 0.6).otherwise(1.0)
    ticks = e.filter("label > 0").select("vec_id", (ranking.uniform(9, "vec_id") < ratio).alias("is_fault"))
    healthy = ranking.hash_rank(e.filter("label = 0"), ["label"], "vec_id", seed=4)
    k = healthy.agg(F.count("*").alias("k"))
    asked = ticks.crossJoin(F.broadcast(k)).withColumn("r", i % F.col("k")).drop("k")
    met = asked.join(healthy.select("r", F.col("vec_id").alias("h")), "r")
    return met.select(i.alias("tick"), "is_fault", F.when(F.col("is_fault"), i).otherwise(F.col("h")).alias("drawn"))


@query("s12_health_mix", f"SELECT vec_id, label, {_UNIFORM.format(s=6)} < 0.3 AS sends_healthy FROM embeddings WHERE label > 0")
def s12_health_mix(spark, d):
    return table(spark, d, "embeddings").filter("label > 0").select("vec_id", "label", (ranking.uniform(6, "vec_id") < 0.3).alias("sends_healthy"))


@query(
    "s14_unknown_mix",
    "WITH t AS (SELECT unnest(range(1, 6)) AS trial), c AS (SELECT trial, label, row_number() OVER (PARTITION BY trial ORDER BY md5('8:' || trial || ':' || label), trial || ':' || label) AS k FROM t, (SELECT DISTINCT label FROM embeddings WHERE label > 0)) SELECT trial, 'New Faulty ' || k AS name, vec_id FROM c JOIN embeddings USING (label) WHERE k <= trial",
)
def s14_unknown_mix(spark, d):
    """Five trials; trial n mixes all rows of n fault classes chosen by hash, under new names."""
    e = table(spark, d, "embeddings").filter("label > 0").select("label", "vec_id")
    trials = e.select("label").distinct().withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("_k", F.concat_ws(":", "trial", "label"))
    chosen = ranking.hash_rank(trials, ["trial"], "_k", seed=8, count=None).withColumn("k", F.col("r") + 1).filter("k <= trial")
    return chosen.join(e, "label").select(F.col("trial").cast("long").alias("trial"), F.concat(F.lit("New Faulty "), F.col("k").cast("string")).alias("name"), "vec_id")


@query("p12_gauge", f"SELECT event_id, round(least(1, 1 / greatest(score, 1e-9)) * 100, 6) AS gauge FROM ({SCORES})")
def p12_gauge(spark, d):
    return scores(spark, d).select("event_id", F.round(S.gauge(F.col("score")), 6).alias("gauge"))


@query(
    "m23_health_rows",
    f"WITH {_N}, q AS (SELECT quantile_cont(score, 0.1) AS a, quantile_cont(score, 0.95) AS b FROM n), x AS (SELECT event_id, score, greatest(0, least(1, CASE WHEN score <= b THEN 1 - 0.5 * (score - a) / (b - a) ELSE 0.5 - 0.5 * (score - b) / b END)) AS h FROM n, q) SELECT event_id, round(h, 6) AS health, CASE WHEN h >= 0.5 THEN 'healthy' WHEN h >= 0.35 THEN 'early_warning' WHEN h >= 0.2 THEN 'degraded' ELSE 'critical' END AS severity, round(abs(score - 1) / (1 + abs(score - 1)), 6) AS confidence FROM x",
)
def m23_health_rows(spark, d):
    """Health index, severity stage and margin confidence of each row (M19 to M21 and M23)."""
    h = healths(spark, d)
    return h.select("event_id", F.round("health", 6).alias("health"), series.severity(F.col("health")).alias("severity"), F.round(series.confidence(F.col("score")), 6).alias("confidence"))


@query("m22_diagnosis", f"SELECT event_id, CASE WHEN score > 1 THEN 'unknown' WHEN kind = 'click' THEN 'loose screw' WHEN kind = 'view' THEN 'healthy' ELSE 'uncertain' END AS diagnosis FROM ({SCORES})")
def m22_diagnosis(spark, d):
    names = spark.createDataFrame([("click", "loose screw"), ("view", "healthy")], "kind string, name string")
    e = scores(spark, d).join(F.broadcast(names), "kind", "left")  # the taxonomy: two rows
    return e.select("event_id", F.when(F.col("score") > 1, "unknown").otherwise(F.coalesce("name", F.lit("uncertain"))).alias("diagnosis"))


# Columns of the result modes
MODES = {"binary": ["event_id", "unknown"], "health": ["event_id", "score", "margin"], "full": ["event_id", "score", "margin", "unknown"]}


def projection(rows: DataFrame, mode: str) -> DataFrame:
    """The columns of a result mode; an unknown mode raises."""
    if mode not in MODES:
        raise ValueError(f"no result mode {mode}: one of {', '.join(MODES)}")
    return rows.select(*MODES[mode])


@query(
    "p13_projections",
    f"""WITH e AS (SELECT event_id::DOUBLE AS event_id, score, score - 1 AS margin, (score > 1)::INT::DOUBLE AS "unknown" FROM ({SCORES})),
        c AS (SELECT unnest(['event_id', 'score', 'margin', 'unknown']) AS field, unnest([event_id, score, margin, "unknown"]) AS x FROM e), m AS (SELECT * FROM (VALUES ('binary', ['event_id', 'unknown']), ('health', ['event_id', 'score', 'margin']), ('full', ['event_id', 'score', 'margin', 'unknown'])) t(mode, fields))
        SELECT mode, field, count(*) AS n, round(sum(x), 3) AS total FROM c JOIN m ON list_contains(fields, field) GROUP BY ALL""",
)
def p13_projections(spark, d):
    """The column sets of the three result modes, each column with its rows and sum."""
    e = scores(spark, d).select(F.col("event_id").cast("double").alias("event_id"), "score", (F.col("score") - 1).alias("margin"), (F.col("score") > 1).cast("int").cast("double").alias("unknown"))
    out = None
    for mode, fields in MODES.items():
        one = projection(e, mode).unpivot([], fields, "field", "x").groupBy("field").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("total")).select(F.lit(mode).alias("mode"), "field", "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("p14_blinded", "SELECT vec_id, 'S' || lpad((dense_rank() OVER (ORDER BY label) - 1)::VARCHAR, 2, '0') AS blind FROM embeddings")
def p14_blinded(spark, d):
    """Configurations under blind names by their order, the truth dropped."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    names = e.select("label").distinct().withColumn("blind", F.format_string("S%02d", F.dense_rank().over(Window.orderBy("label")) - 1))
    return e.join(names, "label").select("vec_id", "blind")


@query(
    "a24_session_summary",
    f"""WITH RECURSIVE {_ALARM}, sl AS (SELECT asset, rn, CASE WHEN rn >= 5 THEN -regr_slope(smoothed, rn) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) END AS rate FROM sm),
        c AS (SELECT asset, rn, rate, level, lag(level) OVER (PARTITION BY asset ORDER BY rn) AS before FROM al JOIN sl USING (asset, rn))
        SELECT asset, count(*) AS n, round(count(rate) / count(*), 6) AS coverage, round(count(*) FILTER (level > 0) / count(*), 6) AS alarm_fraction, count(*) FILTER (level <> before) AS transitions,
        round(count(*) FILTER (level <> before) / greatest(1, count(*) - 1), 6) AS flapping, round(avg(rate), 5) AS mean_rate FROM c GROUP BY asset""",
)
def a24_session_summary(spark, d):
    p = paths(spark, d).withColumn("before", F.lag("alarm_state").over(Window.partitionBy("asset").orderBy(*ORDER)))
    n, moved = F.count("*"), F.count_if(F.col("alarm_state") != F.col("before"))
    return p.groupBy("asset").agg(
        n.alias("n"),
        F.round(F.count("rate") / n, 6).alias("coverage"),
        F.round(F.count_if(F.col("alarm_state") != "normal") / n, 6).alias("alarm_fraction"),
        moved.alias("transitions"),
        F.round(moved / F.greatest(F.lit(1), n - 1), 6).alias("flapping"),
        F.round(F.avg("rate"), 5).alias("mean_rate"),
    )


@query(
    "a25_event_metrics",
    f"WITH RECURSIVE {_ALARM}, x AS (SELECT a.asset, a.level > 0 AS alarm, n.kind = 'purchase' AS event, n.ts FROM al a JOIN n USING (asset, rn)) SELECT asset, round(count(*) FILTER (alarm AND event) / nullif(count(*) FILTER (event), 0), 6) AS event_recall, count(*) FILTER (alarm AND NOT event) AS false_alarms, round(count(*) FILTER (alarm AND NOT event) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 0), 6) AS false_alarms_per_hour FROM x GROUP BY asset",
)
def a25_event_metrics(spark, d):
    """Recall of labelled events and false alarms an hour of observed time; null without events or span."""
    p = paths(spark, d).select("asset", "ts", (F.col("alarm_state") != "normal").alias("alarm"), (F.col("kind") == "purchase").alias("event"))
    false = F.count_if(F.col("alarm") & ~F.col("event"))
    hours = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9
    return p.groupBy("asset").agg(F.round(S.ratio(F.count_if(F.col("alarm") & F.col("event")), F.count_if(F.col("event"))), 6).alias("event_recall"), false.alias("false_alarms"), F.round(S.ratio(false, hours), 6).alias("false_alarms_per_hour"))


@query(
    "a26_trial_summary",
    f"""WITH RECURSIVE {_EWMA}, w AS (SELECT *, count(*) FILTER (ewma >= 0.2 AND ewma < 0.5) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS dwell FROM e),
        f AS (SELECT asset, min(rn) AS t, min_by(dwell, rn) AS dwell FROM w WHERE rn > 10 AND ewma >= 0.5 GROUP BY asset), a AS (SELECT DISTINCT asset, asset % 2 AS scenario FROM e)
        SELECT scenario, count(*) AS trials, round(count(t) / count(*), 6) AS alarm_rate, round(count(*) FILTER (t IS NOT NULL AND (dwell <= 12) = (scenario = 0)) / count(*), 6) AS correct_rate, round(avg(t), 4) AS mean_latency, round(avg(dwell), 4) AS mean_dwell FROM a LEFT JOIN f USING (asset) GROUP BY scenario""",
)
def a26_trial_summary(spark, d):
    """Every asset a trial, all in one job: alarm rate, right verdicts (even assets should be sudden), latency, dwell."""
    t = trends(spark, d).withColumn("t", F.row_number().over(Window.partitionBy("asset").orderBy(*ORDER)))
    trial = t.groupBy("asset").agg(F.max(F.when(F.col("alarm_now"), F.col("t"))).alias("t"), F.max("dwell").alias("dwell"), F.max("verdict").alias("kind")).withColumn("scenario", F.col("asset") % 2)
    right = F.col("kind") == F.when(F.col("scenario") == 0, "sudden").otherwise("gradual")
    return trial.groupBy("scenario").agg(F.count("*").alias("trials"), F.round(F.count("t") / F.count("*"), 6).alias("alarm_rate"), F.round(F.count_if(right) / F.count("*"), 6).alias("correct_rate"), F.round(F.avg("t"), 4).alias("mean_latency"), F.round(F.avg("dwell"), 4).alias("mean_dwell"))


# Share of fault rows and ticks of the phases of each scenario, and the verdict it should give. The onset is
# the length of the first phase.
PHASES = {"A": ((0.0, 40), (0.25, 50), (0.7, 50), (1.0, 60), (1.0, 60)), "B": ((0.0, 40), (1.0, 120))}
EXPECTED = {"A": "gradual", "B": "sudden"}
TRIALS = 20
_TICK = "('0x' || substr(md5('{s}:' || scenario || ':' || trial || ':' || t), 1, 7))::BIGINT"


@query(
    "r8_scenarios",
    f"""WITH RECURSIVE ph AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {k}, {r}::DOUBLE, {n}, {sum(m for _, m in ps[:k])})" for s, ps in PHASES.items() for k, (r, n) in enumerate(ps))}) AS x(scenario, k, ratio, len, start)),
       tick AS (SELECT scenario, trial, start + i AS t, ratio FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM ph), (SELECT unnest(range(0, {TRIALS})) AS trial)),
       pool AS (SELECT score > 1 AS fault, score, row_number() OVER (PARTITION BY score > 1 ORDER BY md5('4:' || event_id), event_id) - 1 AS r, count(*) OVER (PARTITION BY score > 1) AS size FROM ({SCORES})),
       sizes AS (SELECT DISTINCT fault, size FROM pool),
       drawn AS (SELECT scenario, trial, t, {_TICK.format(s=9)} / 268435456.0 < ratio AS fault, {_TICK.format(s=5)} AS h FROM tick),
       n AS (SELECT scenario || trial AS asset, scenario, trial, t AS event_id, t AS rn, score FROM drawn JOIN sizes USING (fault) JOIN pool ON pool.fault = drawn.fault AND pool.r = h % sizes.size){_EWMA[len(_N):]},
       w AS (SELECT *, count(*) FILTER (ewma >= 0.2 AND ewma < 0.5) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS dwell FROM e),
       f AS (SELECT asset, min(rn) AS alarm_t, min_by(dwell, rn) AS dwell FROM w WHERE rn > 10 AND ewma >= 0.5 GROUP BY asset),
       v AS (SELECT DISTINCT scenario, trial, alarm_t, dwell, CASE WHEN dwell <= 12 THEN 'sudden' WHEN dwell > 12 THEN 'gradual' END AS verdict FROM n LEFT JOIN f USING (asset))
       SELECT scenario, trial::INTEGER AS trial, verdict, alarm_t::BIGINT AS alarm_t, (alarm_t - 40)::BIGINT AS latency, dwell::INTEGER AS transition, coalesce(verdict = CASE scenario WHEN 'A' THEN 'gradual' ELSE 'sudden' END, false) AS correct FROM v""",
)
def r8_scenarios(spark, d):
    """Trials of two scenarios, all in one job: every tick draws a row beyond 1 with its phase's share, else one not beyond
    it; the alarm's latency is counted from the onset."""
    rows = [(s, r, n, sum(m for _, m in ps[:k])) for s, ps in PHASES.items() for k, (r, n) in enumerate(ps)]
    phases = spark.createDataFrame(rows, "scenario string, ratio double, len long, start long")
    ticks = phases.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(TRIALS - 1)))).withColumn("t", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("len"))))
    key = ("scenario", "trial", "t")
    pool = ranking.hash_rank(scores(spark, d).select("event_id", "score", (F.col("score") > 1).alias("fault")), ["fault"], "event_id", seed=4, count="size")
    sizes = F.broadcast(pool.groupBy("fault").agg(F.first("size").alias("size")))  # two rows
    h = F.conv(F.substring(ranking.hash_of(5, *key), 1, 7), 16, 10).cast("long")
    drawn = ticks.select(*key, (ranking.uniform(9, *key) < F.col("ratio")).alias("fault"), h.alias("h")).join(sizes, "fault").withColumn("r", F.col("h") % F.col("size"))
    met = drawn.join(pool.select("fault", "r", "score"), ["fault", "r"]).select(*key, "score")
    onsets = spark.createDataFrame([(s, ps[0][1], EXPECTED[s]) for s, ps in PHASES.items()], "scenario string, onset long, expected string")
    return series.scenario_verdicts(met, onsets, ["scenario", "trial"], "scenario", "t", "score")
