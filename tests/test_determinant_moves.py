"""The minimum covariance determinant leaves its rows where they are."""

import numpy as np
from pyspark.sql import functions as F

from phmspark.operators import detectors, moments, ranking


def _rows(spark):
    rng = np.random.default_rng(8)
    rows = [(k, k % 3 if k % 41 else None, x.tolist()) for k, x in enumerate(rng.normal(size=(600, 3)) + np.arange(600)[:, None] % 3)]
    return spark.createDataFrame(rows, "vec_id long, label int, f array<double>").repartition(4)


def test_vectors_are_written_once(spark, monkeypatch):
    """After the table of rows, no step writes vectors of rows: only numbers, and models by group and start."""
    kept, write = [], detectors.written

    def watched(df, name):
        out = write(df, name)
        kept.append((name, "f" in out.columns, out.count()))
        return out

    monkeypatch.setattr(detectors, "written", watched)
    got = detectors.minimum_determinant(_rows(spark), ["label"], "vec_id", starts=4, keep=2, sample=60, most_steps=2).collect()
    assert sorted(r["label"] for r in got) == [0, 1, 2]
    assert [name for name, vectors, _ in kept if vectors] == ["rows"]


def test_models_in_slices(spark):
    told = lambda at_once: sorted((r["label"], r["n"], round(r["logdet"], 9), round(r["mu"][0], 9)) for r in detectors.minimum_determinant(_rows(spark), ["label"], "vec_id", starts=4, keep=2, sample=60, most_steps=2, at_once=at_once).collect())
    assert told(2) == told(2000)


def test_first_by_hash_is_the_rank_by_hash(spark):
    df = _rows(spark).select("vec_id", "label")
    want = ranking.hash_rank(df, ["label"], "vec_id", seed=5, count=None).filter("r < 7")
    got = ranking.first_by_hash(df, ["label"], "vec_id", 7, seed=5, digits=1)
    assert sorted(map(tuple, got.select("vec_id", "label", "r").collect())) == sorted(map(tuple, want.select("vec_id", "label", "r").collect()))


def test_means_travel_to_the_rows(spark):
    """Few means are no reason to move the rows of a group together."""
    plan = moments.moments(_rows(spark).filter(F.col("label").isNotNull()), ["label"])._jdf.queryExecution().executedPlan().toString()
    rows = plan[plan.index("MapInPandas") :]
    assert "BroadcastHashJoin" in rows and "SortMergeJoin" not in rows
