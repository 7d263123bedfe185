"""Registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
NAMES = (
    "s1_datasets s3_pool_rows s4_windows s5_channels s6_recorder p1_canonical_config p4_iqr_filter p7_roles p8_stream_eval a1_window_stats a2_harmonic_bands a3_feature_rows a4_quantiles "
    "q1_schema_audit q4_record_rules q6_leakage j8_paired_streams j9_manifest j10_row_origins a13_a14_summaries a23_confusion e6_multiclass e7_signed_rank j7_reconcile "
    "a6_ledoit_wolf a9_pooled m1_mahalanobis m4_legacy_rule m7_shared_calibration m24_registration m29_group_verdict t2_top_scores m13_whitening m15_rays m16_ray_cosines m17_familiarity m18_severity_ranks "
    "a31_cosine_spread a32_median_shift a17_drift a18_strategies m25_a27_transfer a10_detection_rates e1_e4_openset_metrics m5_knn_openset m9_local_outlier r4_attempts x11_half_even x14_canonical_hash q10_result_matrix "
    "m3_openset m14_polar w2_w3_ewma_cusum w4_w5_alarms w8_alarm_levels a24_session_summary j4_cross_condition r2_trend_stream r10_sessions r1_latest_version r4_quarantine_stream r8_scenarios m6_resolved q1_file_audit m27_model_summary t5_set_difference j3_nearest"
).split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 4) if isinstance(x, (float,)) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(cell(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, str(DATA))
    got = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
