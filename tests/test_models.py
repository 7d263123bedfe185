"""Queries without SQL against NumPy, on the smallest table."""

import hashlib

import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """id, label, role and vector: roles by the rank of the seeded hash within a label."""
    e = [(r["vec_id"], r["label"], np.array(r["embedding"], dtype=float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = []
    for label in sorted({x[1] for x in e}):
        own = sorted((x for x in e if x[1] == label), key=lambda x: (hashlib.md5(f"42:{x[0]}".encode()).hexdigest(), x[0]))
        n_train, n_cal = int(0.6 * len(own)), max(1, int(0.2 * len(own)))
        out += [(i, label, "train" if k < n_train else "cal" if k < n_train + n_cal else "holdout", v) for k, (i, _, v) in enumerate(own)]
    return out


def result(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, SF).collect()]


def scaled(rows):
    train = np.stack([v for _, label, role, v in rows if label == 0 and role == "train"])
    low, centre, high = np.quantile(train, [0.25, 0.5, 0.75], axis=0)
    spread = np.where(high > low, high - low, 1.0)
    return {i: (v - centre) / spread for i, _, _, v in rows}


def axes(rows):
    z = scaled(rows)
    train = np.stack([z[i] for i, label, role, _ in rows if label == 0 and role == "train"])
    mu = train.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(train.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    return z, mu, np.maximum(values, 0), vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(mu))])


@pytest.mark.parametrize("name, oas", [("a6_ledoit_wolf_wide", False), ("a7_oas_wide", True)])
def test_shrunk_covariances(spark, rows, name, oas):
    got = {r["label"]: r for r in result(spark, name)}
    for label in {x[1] for x in rows}:
        x = np.stack([v for _, y, _, v in rows if y == label])
        n, p = x.shape
        z = x - x.mean(axis=0)
        s = z.T @ z / n
        mu, square = np.trace(s) / p, (s**2).sum()
        if oas:
            a = min(1.0, (square / p**2 + mu**2) / ((n + 1) * (square / p**2 - mu**2 / p)))
        else:
            spread = sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / n**2
            a = min(1.0, spread / ((s - mu * np.eye(p)) ** 2).sum())
        precision = np.linalg.inv((1 - a) * s + a * mu * np.eye(p))
        assert got[label]["shrinkage"] == pytest.approx(a, abs=2e-6)
        if oas:
            assert got[label]["p11"] == pytest.approx(precision[0, 0], rel=1e-5)
        else:
            assert got[label]["trace"] == pytest.approx(np.trace(precision), rel=1e-6)


def test_principal_view_and_residual(spark, rows):
    z, mu, values, vectors = axes(rows)
    for r in result(spark, "p11_pca_view"):
        assert [r["pc1"], r["pc2"]] == pytest.approx(((z[r["vec_id"]] - mu) @ vectors[:, :2]).tolist(), abs=2e-5)
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95) + 1)
    for r in result(spark, "m11_reconstruction_error"):
        x = z[r["vec_id"]] - mu
        assert r["residual"] == pytest.approx(np.linalg.norm(x - x @ vectors[:, :k] @ vectors[:, :k].T), abs=2e-5)


def test_protocols(spark, rows):
    """Protocol B under seed 42: the healthy class alone is known."""
    x = np.stack([v for _, label, role, v in rows if label == 0 and role == "train"])
    n, p = x.shape
    z = x - x.mean(axis=0)
    s = z.T @ z / n
    mu = np.trace(s) / p
    a = min(1.0, sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / n**2 / ((s - mu * np.eye(p)) ** 2).sum())
    precision = np.linalg.inv((1 - a) * s + a * mu * np.eye(p))
    d = {i: float(np.sqrt((v - x.mean(axis=0)) @ precision @ (v - x.mean(axis=0)))) for i, _, _, v in rows}
    limit = np.quantile([d[i] for i, label, role, _ in rows if label == 0 and role == "cal"], 0.95)
    judged = [(label == 0, d[i] / limit <= 1) for i, label, role, _ in rows if label > 0 or role == "holdout"]
    hit = sum(not known and not told for known, told in judged)
    f1 = 2 * hit / (sum(not known for known, _ in judged) + sum(not told for _, told in judged))
    got = {(r["protocol"], r["estimator"], r["seed"]): r for r in result(spark, "m26_protocols")}
    assert len(got) == 12
    r = got["B", "ledoit_wolf", 42]
    assert r["accuracy"] == pytest.approx(sum(k == t for k, t in judged) / len(judged), abs=1e-5) and r["unknown_f1"] == pytest.approx(f1, abs=1e-5)


def test_models_in_slices(spark):
    from phmspark.operators import moments

    models = spark.createDataFrame([(k, [float(k), 0.0], [1.0, 0.0, 0.0, 1.0]) for k in range(7)], "cls int, mu array<double>, precision array<double>")
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id int, f array<double>")
    for at_once in (2, 100):
        got = {r["id"]: r["ds"] for r in moments.distances(rows, models, "cls", at_once=at_once).collect()}
        assert got[1] == pytest.approx({str(k): float(k) for k in range(7)})
        assert got[2] == pytest.approx({str(k): float(np.hypot(3 - k, 4)) for k in range(7)})
