"""Ingest and features: S1, S3-S6, P1-P6, A1-A4, X1-X5."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from phmspark.functions import scalars as S
from phmspark.operators import quantiles, windows
from phmspark.plans.base import features, query, table

_STATS_SQL = """sqrt(avg(x * x)) AS rms, avg(x) AS mean, kurtosis_pop(x) + 3 AS kurtosis, stddev_pop(x) AS std,
  CASE WHEN stddev_pop(x) > 0 THEN (avg(x*x*x) - 3 * avg(x) * avg(x*x) + 2 * avg(x) ** 3) / stddev_pop(x) ** 3 END AS skewness,
  max(x) - min(x) AS peak_to_peak, abs(max(x) / nullif(sqrt(avg(x * x)), 0)) AS crest, abs(max(x)) / nullif(avg(sqrt(abs(x))) ** 2, 0) AS clearance,
  sqrt(avg(x * x)) / nullif(avg(abs(x)), 0) AS shape, abs(max(x) / nullif(avg(abs(x)), 0)) AS impulse, max(x) AS "max", min(x) AS "min",
  avg(x * x) AS mean_square, var_pop(x) AS variance, avg(abs(x)) AS mean_abs"""
_NAMES = windows.STATISTICS


MOST_CHANNELS = 1000  # more than that is an error, not a cut


@query("s1_datasets", "SELECT l_returnflag AS motor, l_linestatus AS rpm, l_returnflag || '/' || l_linestatus AS dataset, count(*) AS n FROM lineitem GROUP BY ALL")
def s1_datasets(spark, d):
    """Conditions that have rows, with their key."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("motor"), F.col("l_linestatus").alias("rpm")).agg(F.count("*").alias("n"))
    return rows.select("motor", "rpm", S.dataset_key(F.col("motor"), F.concat("rpm", F.lit("rpm"))).alias("dataset"), "n")


@query("s3_pool_rows", "SELECT event_type AS file, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS row_idx, user_id AS config FROM events")
def s3_pool_rows(spark, d):
    """Rows of a file and configuration numbered in their order."""
    w = Window.partitionBy("event_type", "user_id").orderBy("event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("file"), "event_id", (F.row_number().over(w) - 1).cast("long").alias("row_idx"), F.col("user_id").alias("config"))


@query("s4_windows", "SELECT user_id AS win, event_type AS channel, count(*) AS n, md5(string_agg(round(value, 4)::DECIMAL(18, 4)::VARCHAR, ',' ORDER BY event_id)) AS samples FROM events GROUP BY ALL")
def s4_windows(spark, d):
    """Long samples gathered to one array for each window and channel, in order."""
    grouped = table(spark, d, "events").groupBy(F.col("user_id").alias("win"), F.col("event_type").alias("channel"))
    wide = grouped.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.round(x["value"], 4).cast("decimal(18,4)").cast("string")), ",")
    return wide.select("win", "channel", "n", F.md5(text).alias("samples"))


@query(
    "s5_channels",
    """SELECT event_type, name, CASE WHEN regexp_matches(name, '_(Current|Delta_T|(Acceleration_)?[XYZ])_data$')
       THEN lower(regexp_replace(regexp_extract(name, '_(Current|Delta_T|(Acceleration_)?[XYZ])_data$', 1), '^Acceleration_', '')) END AS channel, n
       FROM (SELECT event_type, CASE event_type WHEN 'click' THEN 'T1_Current_data' WHEN 'view' THEN 'T1_Acceleration_X_data' WHEN 'purchase' THEN 'T2_Y_data'
             WHEN 'signup' THEN 'T2_Delta_T_data' ELSE 'T3_' || event_type END AS name, count(*) AS n FROM events GROUP BY ALL)""",
)
def s5_channels(spark, d):
    kinds = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    e = F.col("event_type")
    name = F.when(e == "click", "T1_Current_data").when(e == "view", "T1_Acceleration_X_data").when(e == "purchase", "T2_Y_data").when(e == "signup", "T2_Delta_T_data").otherwise(F.concat(F.lit("T3_"), e))
    return kinds.select("event_type", name.alias("name"), S.channel_of(name).alias("channel"), "n")


@query(
    "s6_recorder",
    """WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
       k AS (SELECT l.*, l_extendedprice - l_quantity AS delta_t FROM lineitem l JOIN b USING (l_returnflag) WHERE l_extendedprice BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)),
       n AS (SELECT *, (row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 50 AS win FROM k)
       SELECT l_returnflag, l_suppkey, win::BIGINT AS win, round(avg(delta_t), 4) AS delta_t FROM n GROUP BY ALL HAVING count(*) = 50""",
)
def s6_recorder(spark, d):
    """Temperature difference derived, outliers beyond three quartile distances out, full windows of 50 rows of each recorder."""
    kept = quantiles.iqr_filter(table(spark, d, "lineitem").select("l_returnflag", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), ["l_extendedprice"], ["l_returnflag"], 3.0)
    cut = windows.cut_windows(kept, ["l_returnflag", "l_suppkey"], ["l_orderkey", "l_linenumber"], 50)
    return cut.groupBy("l_returnflag", "l_suppkey", "win").agg(F.round(F.avg(F.col("l_extendedprice") - F.col("l_quantity")), 4).alias("delta_t"))


@query(
    "p1_canonical_config",
    """SELECT canon, count(DISTINCT dir) AS dirs, count(DISTINCT dir) > 1 AS ambiguous, sum(n) AS n FROM (
       SELECT (label - 1) || CASE WHEN label = 2 AND vec_id % 2 = 0 THEN 'screw' ELSE 'screws' END AS dir, (label - 1) || 'screws' AS canon, count(*) AS n FROM embeddings WHERE label > 0 GROUP BY ALL) GROUP BY canon""",
)
def p1_canonical_config(spark, d):
    """Directories of one canonical configuration; more than one is ambiguous."""
    e = table(spark, d, "embeddings").filter("label > 0")
    name = F.concat((F.col("label") - 1).cast("string"), F.when((F.col("label") == 2) & (F.col("vec_id") % 2 == 0), "screw").otherwise("screws"))
    dirs = e.groupBy(name.alias("dir")).agg(F.count("*").alias("n")).withColumn("canon", S.canonical_config(F.col("dir")))
    return dirs.groupBy("canon").agg(F.count("dir").alias("dirs"), (F.count("dir") > 1).alias("ambiguous"), F.sum("n").alias("n"))


@query(
    "p2_config_order",
    """SELECT config, row_number() OVER (ORDER BY CASE WHEN label <= 8 THEN 8 - label ELSE 999 END, config) AS place, n
       FROM (SELECT label, label || 'screws' AS config, count(*) AS n FROM embeddings GROUP BY ALL)""",
)
def p2_config_order(spark, d):
    """Configurations by severity, unknown names last."""
    c = table(spark, d, "embeddings").groupBy(F.concat(F.col("label").cast("string"), F.lit("screws")).alias("config")).agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(S.config_rank(F.col("config")), "config")).cast("long")).select("config", "place", "n")


@query(
    "p3_finite_rows",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS unit FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0",
)
def p3_finite_rows(spark, d):
    """Rows whose every derived feature is finite; a division by zero is not."""
    f = F.array(S.ratio(F.col("l_extendedprice"), F.col("l_discount")), S.ratio(F.col("l_extendedprice"), F.col("l_tax")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", f.alias("f")).filter(windows.finite(F.col("f")))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("f")[0], 4).alias("unit"))


_IQR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "p4_iqr_filter",
    "WITH b AS (SELECT l_returnflag, "
    + ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS z_{c}" for c in _IQR_COLS)
    + " FROM lineitem GROUP BY 1) SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem JOIN b USING (l_returnflag) WHERE "
    + " AND ".join(f"{c} BETWEEN a_{c} - 1.5 * (z_{c} - a_{c}) AND z_{c} + 1.5 * (z_{c} - a_{c})" for c in _IQR_COLS),
)
def p4_iqr_filter(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", *_IQR_COLS)
    return quantiles.iqr_filter(rows, _IQR_COLS, ["l_returnflag"]).select("l_returnflag", "l_orderkey", "l_linenumber")


@query(
    "p5_first_windows",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type IN ('click', 'view')) WHERE r <= 20",
)
def p5_first_windows(spark, d):
    """The first 20 windows of each asset under selected conditions: the limit is the operator."""
    chosen = table(spark, d, "events").filter(F.col("event_type").isin("click", "view")).select("user_id", "event_id")
    return chosen.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).filter("r <= 20").drop("r")


@query("a1_window_stats", f"SELECT user_id AS win, event_type AS channel, {', '.join(f'round({n}, 6) AS {n}' for n in ('rms', 'mean', 'kurtosis', 'std', 'skewness', 'peak_to_peak', 'crest', 'clearance', 'shape', 'impulse', 'mean_square', 'variance', 'mean_abs'))}, round(\"max\", 6) AS high, round(\"min\", 6) AS low FROM (SELECT user_id, event_type, {_STATS_SQL} FROM (SELECT user_id, event_type, value AS x FROM events) GROUP BY ALL HAVING count(*) > 1)")
def a1_window_stats(spark, d):
    """The fifteen statistics of each window and channel of two samples or more."""
    e = table(spark, d, "events").select(F.col("user_id").alias("win"), F.col("event_type").alias("channel"), "value")
    many = e.groupBy("win", "channel").agg(F.count("*").alias("n"), *(c.alias(n) for n, c in windows.statistics(F.col("value")).items())).filter("n > 1")
    return many.select("win", "channel", *(F.round(n, 6).alias({"max": "high", "min": "low"}.get(n, n)) for n in _NAMES))


_FS, _BASE = 64.0, 4.0


@query(
    "a2_harmonic_bands",
    f"""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings),
        bins AS (SELECT unnest({[k for _, k in windows.band_bins(64, _FS, _BASE)]}) AS k, unnest({[h for h, _ in windows.band_bins(64, _FS, _BASE)]}) AS h),
        dft AS (SELECT vec_id, k, 2 * sqrt(sum(x * cos(2 * pi() * k * t / 64)) ** 2 + sum(x * sin(2 * pi() * k * t / 64)) ** 2) / 64 AS amp FROM v, (SELECT DISTINCT k FROM bins) GROUP BY 1, 2)
        SELECT vec_id, h AS harmonic, round(max(amp), 4) AS amplitude FROM dft JOIN bins USING (k) GROUP BY 1, 2""",
)
def a2_harmonic_bands(spark, d):
    """Embeddings as windows of 64 samples at 64 Hz, harmonics of 4 Hz; bands without a bin are left out."""
    w = features(spark, d).select("vec_id", "f", F.lit(_BASE).alias("base"))
    banded = windows.harmonic_bands(w, "f", _FS, "base").select("vec_id", F.posexplode("bands").alias("h", "a"))
    there = sorted({h for h, _ in windows.band_bins(64, _FS, _BASE)})
    return banded.filter((F.col("h") + 1).isin(there)).select("vec_id", (F.col("h") + 1).alias("harmonic"), F.round("a", 4).alias("amplitude"))


@query(
    "a3_feature_rows",
    """WITH s AS (SELECT user_id AS win, event_type AS channel, sqrt(avg(value * value)) AS rms, avg(abs(value)) AS mean_abs FROM events GROUP BY ALL),
       c AS (SELECT DISTINCT event_type AS channel FROM events), full_ AS (SELECT win FROM s GROUP BY win HAVING count(*) = (SELECT count(*) FROM c))
       SELECT win, 15 * count(*) AS n_features, round(list(rms ORDER BY channel)[1], 9) AS first_rms, round(list(mean_abs ORDER BY channel)[-1], 9) AS last_mean_abs FROM s JOIN full_ USING (win) GROUP BY win""",
)
def a3_feature_rows(spark, d):
    """Windows that have every channel, assembled to one feature array in registry order."""
    e = table(spark, d, "events").select(F.col("user_id").alias("win"), F.col("event_type").alias("channel"), "value")
    kinds = sorted(r[0] for r in e.select("channel").distinct().limit(MOST_CHANNELS + 1).collect())  # each is a column of the registry
    if len(kinds) > MOST_CHANNELS:
        raise ValueError(f"more than {MOST_CHANNELS} channels")
    wide = windows.assemble(windows.window_stats(e, ["win", "channel"]), ["win"], "channel", kinds)
    return wide.select("win", F.size("f").cast("long").alias("n_features"), F.round(F.col("f")[0], 9).alias("first_rms"), F.round(F.element_at("f", -1), 9).alias("last_mean_abs"))


@query(
    "a4_quantiles",
    "SELECT l_returnflag, l_linestatus, unnest([0.05::DOUBLE, 0.5, 0.95]) AS q, round(unnest(quantile_cont(l_extendedprice, [0.05, 0.5, 0.95])), 4) AS x FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def a4_quantiles(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    return quantiles.exact_quantiles(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.05, 0.5, 0.95]).withColumn("x", F.round("x", 4))


@query(
    "x3_run_keys",
    """SELECT o_orderkey, format('{}_{}rpm_seed{}_{}', o_orderstatus, 6000 + 1000 * (o_orderkey % 3), o_custkey % 5, CASE o_orderkey % 3 WHEN 0 THEN 'mahalanobis' WHEN 1 THEN 'knn' END) AS run_key,
       CASE o_orderkey % 3 WHEN 0 THEN 'mahalanobis' WHEN 1 THEN 'knn' END AS method FROM orders WHERE o_orderkey % 3 < 2""",
)
def x3_run_keys(spark, d):
    """Run keys; method names are trimmed, lower-cased and mapped first, rows of unknown methods have none and are out."""
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, " Ledoit-Wolf ").when(F.col("o_orderkey") % 3 == 1, "K-NN").otherwise("other")
    named = o.withColumn("method", S.canonical_method(raw)).filter("method IS NOT NULL")
    key = S.run_key(F.col("o_orderstatus"), (6000 + 1000 * (F.col("o_orderkey") % 3)).cast("string"), F.col("o_custkey") % 5, F.col("method"))
    return named.select("o_orderkey", key.alias("run_key"), "method")


@query(
    "m6_resolved",
    """WITH r AS (SELECT o_orderkey, [' Maha ', 'K_NN', 'knn', 'mahalanobis', 'svm', NULL][(o_orderkey % 6 + 1)::INT] AS kind, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE (o_custkey % 7) / 5 END AS confidence,
         ['legacy', 'ledoit_wolf', 'oas', 'mcd', 'shrunk'][(o_custkey % 5 + 1)::INT] AS estimator, (o_orderkey // 7) % 5 AS k FROM orders),
       c AS (SELECT *, CASE lower(trim(kind)) WHEN 'maha' THEN 'mahalanobis' WHEN 'mahalanobis' THEN 'mahalanobis' WHEN 'knn' THEN 'knn' WHEN 'k_nn' THEN 'knn' END AS m FROM r),
       e AS (SELECT *, CASE WHEN m IS NULL THEN 'openset_method' WHEN confidence IS NULL OR confidence <= 0 OR confidence >= 1 THEN 'confidence' WHEN k < 1 THEN 'knn_neighbors' WHEN estimator = 'shrunk' THEN 'mahalanobis_method' END AS error FROM c)
       SELECT o_orderkey, error, CASE WHEN error IS NULL THEN CASE WHEN m = 'knn' THEN 'knn/k' || k ELSE 'mahalanobis/' || estimator END END AS method_id,
         CASE WHEN error IS NULL THEN CASE WHEN m = 'knn' THEN k::VARCHAR ELSE estimator END END AS used, CASE WHEN error IS NULL THEN CASE WHEN m = 'knn' THEN 'mahalanobis_method=' || estimator ELSE 'knn_neighbors=' || k END END AS ignored FROM e""",
)
def m6_resolved(spark, d):
    """Requested configurations, one for each order: the first parameter that is not allowed, or what takes effect and what
    is ignored."""
    o = table(spark, d, "orders")
    kind = F.element_at(F.array(*(F.lit(x) for x in (" Maha ", "K_NN", "knn", "mahalanobis", "svm", None))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    confidence = F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 7) / 5)
    estimator = F.element_at(F.array(*map(F.lit, (*S.ESTIMATORS, "shrunk"))), (F.col("o_custkey") % 5 + 1).cast("int"))
    k = F.floor(F.col("o_orderkey") / 7) % 5
    r = o.select("o_orderkey", S.resolved(kind, confidence, estimator, k).alias("r"))
    first = F.col("r.ignored")[0]
    used = F.coalesce(F.col("r.effective")["knn_neighbors"], F.col("r.effective")["mahalanobis_method"])
    return r.select("o_orderkey", "r.error", "r.method_id", used.alias("used"), F.concat(first["parameter"], F.lit("="), first["value"]).alias("ignored"))


@query(
    "x5_sections",
    "SELECT doc_id, i - 1 AS place, len(line) AS n_chars, md5(line) AS line FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(line) <> ''",
)
def x5_sections(spark, d):
    """Texts cut at line ends to numbered sections, blank ones out."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.filter(F.trim("line") != "").select("doc_id", F.col("place").cast("long").alias("place"), F.char_length("line").cast("long").alias("n_chars"), F.md5("line").alias("line"))
