"""Hand-computed cases and invariances of single operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phmspark.functions import scalars as S
from phmspark.operators import audits, metrics, moments, neighbours, quantiles, ranking, reconcile, series, windows
from phmspark.sources import files
from phmspark.streaming import discovery


def test_clearance_and_impulse_use_the_largest_value(spark):
    df = spark.createDataFrame([("w", x) for x in (1.0, -4.0, 9.0, 0.25)], "win string, value double")
    r = windows.window_stats(df, ["win"]).first()
    assert r["clearance"] == pytest.approx(9 / np.mean(np.sqrt([1, 4, 9, 0.25])) ** 2)
    assert r["impulse"] == pytest.approx(9 / np.mean([1, 4, 9, 0.25]))


def test_iqr_filter_keeps_edges(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip((0, 1, 2, 3, 100), range(10, 15))], "a double, b double")
    assert sorted(r["a"] for r in quantiles.iqr_filter(df, ["a", "b"], []).collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("n", [1, 2, 5, 400])
def test_exact_quantiles_equal_numpy(spark, n):
    rng = random.Random(n)
    xs = [(k % 2, rng.choice([rng.random(), 0.5])) for k in range(n)]
    got = quantiles.exact_quantiles(spark.createDataFrame(xs, "k int, x double").repartition(3), ["k"], "x", [0.0, 0.25, 0.5, 0.95, 1.0]).collect()
    for r in got:
        assert r["x"] == pytest.approx(np.quantile([x for k, x in xs if k == r["k"]], r["q"]))
    assert len(got) == 5 * len({k for k, _ in xs})


def test_roles_do_not_depend_on_partitions(spark):
    df = spark.range(101).withColumn("k", F.lit("a"))
    a, b = (sorted(tuple(r) for r in ranking.with_role(df.repartition(p), ["k"], "id").select("id", "role", "r").collect()) for p in (1, 7))
    assert a == b and sorted(r[2] for r in a) == list(range(101))
    assert [sum(r[1] == x for r in a) for x in ("train", "cal", "holdout")] == [60, 20, 21]


def test_ledoit_wolf_equals_dense(spark):
    x = np.random.default_rng(0).normal(size=(40, 5)) @ np.diag([1, 2, 3, 4, 5]) + 100
    df = spark.createDataFrame([("c", r.tolist()) for r in x], "k string, f array<double>").repartition(5)
    m = moments.fit_mahalanobis(df, ["k"]).first()
    z = x - x.mean(axis=0)
    s = z.T @ z / 40
    mu = np.trace(s) / 5
    delta = ((s - mu * np.eye(5)) ** 2).sum() / 5
    beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / 40**2 / 5, delta)
    a = beta / delta
    assert m["shrinkage"] == pytest.approx(a)
    assert np.array(m["precision"]).reshape(5, 5) == pytest.approx(np.linalg.inv((1 - a) * s + a * mu * np.eye(5)))


def test_nearest_equals_brute_force(spark):
    x = np.random.default_rng(1).integers(0, 4, size=(60, 3)).astype(float)  # with ties
    df = spark.createDataFrame([(k, str(k % 2), r.tolist()) for k, r in enumerate(x)], "id long, c string, f array<double>").repartition(3)
    got = {(r["query"], r["cls"], r["rank"]): r["neighbour"] for r in neighbours.nearest(df.filter("id < 10"), df, 3, "id", cls="c", not_self=True, block_rows=16).collect()}
    for q, c in itertools.product(range(10), "01"):
        best = sorted((np.linalg.norm(x[k] - x[q]), k) for k in range(60) if k != q and str(k % 2) == c)[:3]
        assert [got[q, c, r] for r in (1, 2, 3)] == [k for _, k in best]


def test_openset_metrics_of_the_fixture(spark):
    df = spark.createDataFrame([("a", x, False) for x in (0.5, 1.0, 1.5)] + [("a", x, True) for x in (0.8, 2.0, 3.0)], "k string, score double, pos boolean")
    r = metrics.openset_metrics(df, ["k"], "score", "pos").first()
    assert (r["known_accuracy"], r["recall"], r["precision"], r["f1"]) == pytest.approx((2 / 3,) * 4)
    assert (r["accuracy"], r["auroc"], r["fpr95"]) == pytest.approx((4 / 6, 7 / 9, 2 / 3))


def test_trend_cases():
    def run(xs, **p):
        t = series.Trend(**p)
        return [t.step(x) for x in xs]

    assert all(r[:2] == (0, 0) for r in run([0.3, 0.9, 1.0] * 20))
    assert [r[1] for r in run([3.0, 0.5, 0, 0, 0, 0, 0])][:3] == [2.0, 1.5, 0.5]
    assert [k + 1 for k, r in enumerate(run([5.0] * 11, alpha=0.5)) if r[2]] == [11]
    assert [r[3] for r in run([0.5] * 30 + [10] * 30)][-1] == "sudden"
    assert [r[3] for r in run([1.5, 0.5, 0.5] * 40 + [2.0] * 30)][-1] == "gradual"
    t = series.Trend(alpha=0.9, warmup=3)
    fired = [k for k in range(1, 11) if t.step(10)[2]]
    t.rearm()
    assert fired == [4] and [k for k in range(1, 9) if t.step(10)[2]] == [4]
    t = series.Trend()
    for _ in range(60):
        t.step(10)
    t.rearm()
    assert (t.state.ewma, t.state.cusum, t.state.rows) == (0.0, 0.0, 60)
    share, fired = 0.0, None
    for k in range(1, 200):  # high two rows of three, from nothing
        share += 0.08 * ((k % 3 != 0) - share)
        if t.step(10 if k % 3 else 0.5)[2]:
            fired = k
            break
    assert fired is not None and fired > 10 and share >= 0.5


def test_quantiles_of_a_hot_value_and_of_few(spark):
    xs = [("a", 7.0)] * 5000 + [("a", float(k)) for k in range(100)] + [("b", 1.0)] + [("c", float("nan")), ("c", 2.0), ("c", -1.0)]
    got = {(r["k"], r["q"]): r["x"] for r in quantiles.exact_quantiles(spark.createDataFrame(xs, "k string, x double").repartition(3), ["k"], "x", [0.001, 0.5, 0.999]).collect()}
    a = np.array([x for k, x in xs if k == "a"])
    assert [got["a", q] for q in (0.001, 0.5, 0.999)] == pytest.approx(np.quantile(a, [0.001, 0.5, 0.999]).tolist())
    assert got["b", 0.5] == 1.0 and got["c", 0.5] == 2.0


def test_hysteresis_needs_rows_in_a_row():
    h = series.Hysteresis()
    assert [h.step(x)[0] for x in (0.4, 0.4, 0.7, 0.4, 0.4, 0.4)] == ["normal"] * 5 + ["warning"]
    assert [h.step(x)[0] for x in (0.1, 0.1, 0.1)] == ["warning", "warning", "critical"]
    assert [h.step(x)[0] for x in (0.4, 0.9, 0.4, 0.9, 0.9, 0.9)] == ["critical", "critical", "warning", "warning", "warning", "normal"]


def test_health_anchors(spark):
    probes = [0.0, 0.1, 0.525, 0.95, 1.425, 1.9, 3.0]
    df = spark.createDataFrame([(x,) for x in probes], "s double").select(series.health_index(F.col("s"), F.lit(0.1), F.lit(0.95)).alias("h"))
    assert [r["h"] for r in df.collect()] == pytest.approx([1, 1, 0.75, 0.5, 0.25, 0, 0])


def test_reconcile_statuses(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, x double")
    b = spark.createDataFrame([(1, 1.0 + 1e-9), (3, None), (4, 4.0)], "k int, x double")
    assert {r["k"]: r["status"] for r in reconcile.reconcile(a, b, ["k"], {"x": (1e-6, 0.0)}).collect()} == {1: "same", 2: "removed", 3: "same", 4: "added"}


def test_channels_and_paths(spark):
    names = ["T1_Current_data", "T1_Acceleration_X_data", "T2_X_data", "T3_Y_data", "T3_Acceleration_Z_data", "T2_Delta_T_data", "other"]
    got = spark.createDataFrame([(x,) for x in names], "n string").select(S.channel_of(F.col("n")).alias("c")).collect()
    assert [r["c"] for r in got] == ["current", "x", "x", "y", "z", "delta_t", None]
    paths = {"a/b.csv": True, "/a": False, "a//b": False, "../a": False, "a/./b": False, "C:x": False, "a\\b": False, "": False, "a/": False}
    got = spark.createDataFrame([(x,) for x in paths], "p string").select("p", S.portable_path(F.col("p")).alias("ok")).collect()
    assert {r["p"]: r["ok"] for r in got} == paths


def test_schema_audit_of_files(spark, tmp_path):
    for name, text in {"good": "a,b\n1,2\n", "empty": "a,b\n", "twice": "a,a\n1,2\n", "other": "b,a\n1,2\n", "ragged": "a,b\n1\n1,2\n", "text": "a,b\n1,x\n", "nan": "a,b\n1,NaN\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    found = audits.audit_lines(files.text_lines(spark, str(tmp_path)), ["a", "b"], ["file"], "pos", "line").collect()
    assert {r["file"].split("/")[-1][:-4]: r["reason"] for r in found} == {"good": None, "empty": "empty file", "twice": "duplicate header", "other": "header mismatch", "ragged": "row width", "text": "non-numeric", "nan": "non-finite"}


def test_feature_files_and_sinks(spark, tmp_path):
    folder = tmp_path / "in" / "T1" / "8000rpm" / "1screw"
    folder.mkdir(parents=True)
    (folder / "x.csv").write_text("f1,f2\n1,2\n3,4\n")
    df = files.read_features(spark, str(tmp_path / "in"), ["f1", "f2"])
    assert [(r["dataset"], r["config"], r["f"]) for r in df.orderBy("f").collect()] == [("T1/8000", "1screws", [1, 2]), ("T1/8000", "1screws", [3, 4])]
    files.write_features(df.select("motor", "rpm", "config", "f"), str(tmp_path / "out"))
    with pytest.raises(Exception):
        files.write_features(df.select("motor", "rpm", "config", "f"), str(tmp_path / "out"))
    files.write_features(df.select("motor", "rpm", "config", "f"), str(tmp_path / "out"), force=True)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception):
        files.write_results(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "bad"))


def test_clusters_of_a_hierarchy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.2, size=(30, 2)) for c in (0, 6)] + [rng.uniform(-20, 20, size=(4, 2))])
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, f array<double>").repartition(2)
    got = {r["vec_id"]: r["cluster"] for r in discovery.density_clusters(df, "vec_id", 10, 3).collect()}
    first, second = {got.get(k) for k in range(30)} - {None}, {got.get(k) for k in range(30, 60)} - {None}
    assert len(first) == len(second) == 1 and first != second and len(got) >= 50


@pytest.mark.parametrize("diffs", [[1.0, -2.0, 3.0, 4.0, -5.0], [1.0, 1.0, -1.0, 2.0, 2.0, -3.0, 0.0], [0.5] * 7 + [-0.5] * 3, [3.0]])
def test_signed_rank_p_equals_all_signs(spark, diffs):
    from itertools import product

    moved = [x for x in diffs if x]
    ranks = [sum(abs(y) < abs(x) for y in moved) + (sum(abs(y) == abs(x) for y in moved) + 1) / 2 for x in moved]
    w = min(sum(r for r, x in zip(ranks, moved) if x > 0), sum(r for r, x in zip(ranks, moved) if x < 0))
    low = sum(sum(r for r, s in zip(ranks, signs) if s) <= w for signs in product((0, 1), repeat=len(ranks))) / 2 ** len(ranks)
    got = metrics.signed_rank(spark.createDataFrame([(x,) for x in [*diffs, None]], "d double"), "d").first()
    assert (got["n"], got["statistic"], got["p"]) == (len(diffs), w, pytest.approx(min(1.0, 2 * low)))


def test_signed_rank_of_nothing(spark):
    none = spark.createDataFrame([], "d double")
    assert tuple(metrics.signed_rank(none, "d").first()) == (0, None, None, None)
    assert tuple(metrics.signed_rank(spark.createDataFrame([(0.0,), (0.0,)], "d double"), "d").first()) == (2, 0.0, 0.0, 1.0)
    many = metrics.signed_rank(spark.createDataFrame([(float(k % 7) - 2.5,) for k in range(200)], "d double"), "d").first()
    assert 0 < many["p"] < 1


@pytest.mark.parametrize(
    "request_, error, method_id",
    [
        (("svm", 0.95, "oas", 5), "openset_method", None),
        ((None, 0.95, "oas", 5), "openset_method", None),
        (("knn", 1.0, "oas", 5), "confidence", None),
        (("knn", float("nan"), "oas", 5), "confidence", None),
        (("knn", 0.9, "oas", 0), "knn_neighbors", None),
        (("knn", 0.9, "shrunk", 3), "mahalanobis_method", None),
        ((" K-NN ", 0.9, "oas", 3), None, "knn/k3"),
        (("Maha", 0.9, "mcd", 3), None, "mahalanobis/mcd"),
    ],
)
def test_requested_configurations(spark, request_, error, method_id):
    from phmspark.functions import scalars

    df = spark.createDataFrame([request_], "m string, c double, e string, k int")
    r = df.select(scalars.resolved(*(F.col(x) for x in ("m", "c", "e", "k"))).alias("r")).first()["r"]
    assert (r["error"], r["method_id"]) == (error, method_id)
    if not error:
        (ignored,) = r["ignored"]
        assert ignored["parameter"] == ("mahalanobis_method" if "knn" in method_id else "knn_neighbors") and ignored["value"] == ("oas" if "knn" in method_id else "3")
        assert r["effective"]["confidence"] == "0.9" and ("knn_neighbors" in r["effective"]) == ("knn" in method_id)


HEAD = b"a,b\n"


@pytest.mark.parametrize(
    "payload, reason, rows, bad, at",
    [
        (b"\xff\xfea,b\n", "unreadable_csv", 0, 0, []),
        (b'a,b\n1,"2\n', "unreadable_csv", 0, 0, []),
        (b"", "empty_file", 0, 0, []),
        (b"a,a\n1,2\n", "duplicate_header", 1, 1, []),
        (b"b,a\n1,2\n", "ordered_header_mismatch", 1, 1, []),
        (HEAD, "empty_configuration", 0, 0, []),
        (HEAD + b"1,2\n3\n4,5\n6,7,8\n", "row_width_mismatch", 4, 2, [1, 3]),
        (HEAD + b"1,2\nx,3\n4,\n", "non_numeric", 3, 2, [1, 2]),
        (b"a\n1\n \n2\n", "parsed_shape_mismatch", 3, 3, []),
        (HEAD + b"1,2\n4,\ninf,3\n4,5\n", "non_finite", 4, 2, [1, 2]),
        (b"\xef\xbb\xbfa,b\r\n1,\"2\"\r\n3e5,-4\r\n", None, 2, 0, []),
        (HEAD + b"1,x\n" * 50, "non_numeric", 50, 50, list(range(20))),
    ],
)
def test_files_are_audited_as_bytes(payload, reason, rows, bad, at):
    from phmspark.sources import audit

    got = audit.audited(payload, {"v1": ("a", "b"), "one": ("a",)})
    assert got[1:2] + got[3:6] == (reason, rows, bad, at)
    assert (got[0] == "VERIFIED") == (reason is None) == (got[6] is not None)



def test_replay_has_every_row_each_lap(spark):
    rows = ranking.replay(spark.range(9).withColumn("k", F.lit(1)), ["k"], "id", 2).collect()
    assert sorted(r["t"] for r in rows) == list(range(1, 19))
    assert all(sorted(r["id"] for r in rows if r["lap"] == n) == list(range(9)) for n in (1, 2))


def test_trajectory_stream_marks_rows_without_identity(spark, tmp_path):
    from phmspark.streaming import monitor

    rows = [(k, "a" if k % 7 else None, float(k), 0.9 - 0.02 * k if k % 5 else None) for k in range(30)]
    spark.createDataFrame(rows, "event_id long, asset string, ts double, health double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, asset string, ts double, health double").parquet(str(tmp_path / "in"))
    got = {r["event_id"]: r for r in monitor.drain(monitor.trajectory_stream(stream), "trajectory").collect()}
    assert len(got) == 30
    assert all((got[k]["trend"] == "insufficient") == (k % 7 == 0 or k % 5 == 0) for k in got)
    own = [got[k] for k in sorted(got) if k % 7 and k % 5]
    batch = series.trajectory(spark.createDataFrame(rows, "event_id long, asset string, ts double, health double"), ["asset"], ["ts"], "health").orderBy("ts").collect()
    assert [(r["alarm_state"], r["trend"]) for r in own] == [(r["alarm_state"], r["trend"]) for r in batch]
    assert [r["rate"] for r in own[5:]] == pytest.approx([r["rate"] for r in batch[5:]])


def test_section_search_by_index_and_by_term(spark):
    from phmspark.operators import search

    rng = np.random.default_rng(5)
    words = [f"t{k}" for k in range(30)]
    pick = lambda n: list(dict.fromkeys(rng.choice(words, n).tolist()))
    asked = [(f"q{k}", pick(4)) for k in range(9)] + [("none", [])]
    told = [(k, pick(3), pick(6)) for k in range(60)] + [(90, [], None)]
    a, t = spark.createDataFrame(asked, "query string, terms array<string>"), spark.createDataFrame(told, "section long, title array<string>, body array<string>").repartition(3)
    want = []
    for q, terms in asked:
        scores = sorted((-sum(3 * (x in title) + (x in (body or [])) for x in terms), k) for k, title, body in told)
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(scores[:3]) if s]
    for most in (10**6, 0):
        got = search.best_sections(a, t, {"title": 3, "body": 1}, 3, most_terms=most).collect()
        assert sorted((r["query"], r["rank"], r["section"], r["score"]) for r in got) == sorted(want)
    assert search.best_sections(a.limit(0), t, {"title": 3, "body": 1}, 3).count() == 0


def test_quantiles_put_no_group_in_one_task(spark):
    """Neither a shuffle by group nor a sort of all rows, however few groups there are."""
    from phmspark.operators import quantiles

    df = spark.range(20_000).selectExpr("id % 2 AS g", "cast(id AS double) AS x")
    kept = quantiles.iqr_filter(df, ["x"], ["g"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    found = quantiles.exact_quantiles(df, ["g"], "x", [0.25, 0.5])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert kept.count() == 20_000
    assert sorted((r["g"], r["q"], r["x"]) for r in found.collect()) == [(0, 0.25, 4999.5), (0, 0.5, 9999.0), (1, 0.25, 5000.5), (1, 0.5, 10000.0)]
