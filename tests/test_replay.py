"""Versions of models, streams under the newest of them, quarantine by batch, and the staged replay."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_discovery import select_clusters

from phmspark.operators import registered
from phmspark.operators.registered import ModelTable
from phmspark.streaming import discovery
from phmspark.streaming.replay import EVERY, LEAST, Quarantine, Replay, quarantine_stream, score_latest

WIDTH = 6


def ranked(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def roles(ids):
    order, n = ranked(ids, 42), len(ids)
    train, cal = int(0.6 * n), max(1, int(0.2 * n))
    return order[:train], order[train : train + cal], order[train + cal :]


class Plain:
    """A monitor of (id, vector) classes in NumPy."""

    def __init__(self):
        self.classes: list[dict[int, np.ndarray]] = []

    def add(self, rows):
        self.classes.append(rows)
        self.split = [roles(list(c)) for c in self.classes]
        train = np.concatenate([np.stack([c[i] for i in s[0]]) for c, s in zip(self.classes, self.split)])
        low, self.centre, high = np.quantile(train, [0.25, 0.5, 0.75], axis=0)
        self.spread = np.where(high > low, high - low, 1.0)
        self.models = []
        for c, (train, cal, _) in zip(self.classes, self.split):
            x = self.z(np.stack([c[i] for i in train]))
            n, p, mu = *x.shape, x.mean(axis=0)
            away = x - mu
            s = away.T @ away / n
            m, d2 = np.trace(s) / p, ((s - np.trace(s) / p * np.eye(p)) ** 2).sum()
            b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in away) / n**2, d2)
            a = b2 / d2 if d2 else 0.0
            precision = np.linalg.pinv((1 - a) * s + a * m * np.eye(p), hermitian=True)
            own = self.away(self.z(np.stack([c[i] for i in cal])), mu, precision)
            self.models.append((mu, precision, np.quantile(own, 0.95)))

    def z(self, x):
        return (x - self.centre) / self.spread

    @staticmethod
    def away(z, mu, precision):
        return np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", z - mu, precision, z - mu)))

    def score(self, x):
        over = np.stack([self.away(self.z(x), mu, p) / max(t, 1e-12) for mu, p, t in self.models])
        return over.min(axis=0), over.argmin(axis=0)

    def boundary(self):
        return max(self.score(np.stack([c[i] for i in s[1]]))[0].max() for c, s in zip(self.classes, self.split))


def dense_clusters(x, least, min_samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(min_samples - 1, len(x) - 1)]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    near, to, out, edges = w[0].copy(), np.zeros(len(x), int), np.ones(len(x), bool), []
    out[0] = False
    for _ in range(len(x) - 1):
        k = int(np.where(out, near, np.inf).argmin())
        edges.append((float(near[k]), min(k, int(to[k])), max(k, int(to[k]))))
        out[k] = False
        closer = out & (w[k] < near)
        near[closer], to[closer] = w[k][closer], k
    return select_clusters(len(x), edges, least)


def plain_replay(pools, healthy, sequence, max_ticks, margin, seed=42):
    """Row by row, as a monitor on one machine would."""
    monitor = Plain()
    monitor.add(pools[healthy])
    held, since, stages, rejections, names = [], 0, [], [], {}
    for config in sequence:
        order = ranked(list(pools[config]), seed + 2)
        cut = int(np.ceil(0.2 * len(order)))
        evals, ids = order[:cut], order[cut:]
        draws, lap = [], 0
        while len(draws) < max_ticks:
            lap += 1
            draws += [int(i.split(":")[1]) for i in sorted((f"{lap}:{i}" for i in ids), key=lambda i: (hashlib.md5(f"{seed + 1}:{i}".encode()).hexdigest(), i))]
        row = {"config": config, "ticks": max_ticks, "discovered": False}
        for t, i in enumerate(draws[:max_ticks], 1):
            x = pools[config][i]
            score = monitor.score(x[None])[0][0]
            if score <= 1 or score <= margin or any(np.array_equal(x, h[1]) for h in held):
                continue
            held.append((i, x, config))
            since += 1
            if len(held) < LEAST or since < EVERY:
                continue
            since, best = 0, None
            z = monitor.z(np.stack([h[1] for h in held]))
            for needed, least, samples in discovery.LADDER:
                if len(held) < needed:
                    break
                labels = dense_clusters(z, least, samples)
                sizes = Counter(labels[labels >= 0].tolist())
                if sizes and max(sizes.values()) >= LEAST:
                    best = np.flatnonzero(labels == min(sizes, key=lambda c: (-sizes[c], c)))
                    break
            if best is None:
                continue
            since = EVERY
            own = [held[k] for k in best]
            held = [h for k, h in enumerate(held) if k not in set(best.tolist())]
            truths = Counter(h[2] for h in own)
            matched = min(truths, key=lambda c: (-truths[c], c))
            median, boundary = float(np.median(monitor.score(np.stack([h[1] for h in own]))[0])), monitor.boundary()
            if median <= boundary:
                rejections.append((config, t, "rejected", len(own), matched))
                continue
            monitor.add({h[0]: h[1] for h in own})
            names[len(monitor.classes) - 1] = matched
            before = len(held)
            if held:
                again = monitor.score(np.stack([h[1] for h in held]))[0]
                held = [h for h, s in zip(held, again) if s > 1 and s > margin]
            s, c = monitor.score(np.stack([pools[config][i] for i in evals]))
            row |= {"ticks": t, "discovered": True, "matched": matched, "cluster_size": len(own), "purity": truths[matched] / len(own), "pruned": before - len(held)}
            row |= {"eval_known": float(np.mean((s <= 1) & (c > 0))), "eval_matched": float(np.mean([a <= 1 and names.get(int(b)) == config for a, b in zip(s, c)])), "held": len(held)}
            break
        stages.append(row | {"held": len(held), "since": since})
    return stages, rejections


@pytest.fixture(scope="module")
def pools():
    rng = np.random.default_rng(11)
    make = lambda first, n, centre, spread=0.3: {first + k: rng.normal(centre, spread, WIDTH) for k in range(n)}
    far = np.zeros(WIDTH)
    far[0] = 6.0
    return {"ok": make(0, 120, 0.0), "a": make(1000, 60, far), "b": make(2000, 70, -far), "c": make(3000, 30, far[::-1], 0.25)}


def frame(spark, pools):
    return spark.createDataFrame([(i, c, x.tolist()) for c, rows in pools.items() for i, x in rows.items()], "vec_id long, config string, f array<double>").repartition(3)


def test_replay_equals_row_by_row(spark, pools, tmp_path):
    want, rejected = plain_replay(pools, "ok", ["a", "b", "c"], 90, 2.0)
    replay = Replay(frame(spark, pools), "ok", ["a", "b", "c"], str(tmp_path), max_ticks=90)
    got = replay.run()
    assert any(s["discovered"] for s in want)
    for s, w in zip(got, want, strict=True):
        for name, value in w.items():
            mine = getattr(s, name)
            assert mine == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (s.config, name)
    assert [(r["config"], r["t"], r["action"], r["size"], r["matched"]) for r in replay.rejections.collect()] == rejected
    assert replay.table.latest() == sum(s["discovered"] for s in want)
    external = {r["config"]: r for r in replay.external().collect()}
    assert set(external) == {"a", "b", "c"} and all(abs(r["unknown"] + r["healthy"] + r["known"] - 1) < 1e-9 for r in external.values())
    assert all(r["matched"] <= r["known"] for r in external.values()) and set(replay.delays()) == {s["matched"] for s in want if s["discovered"]}
    # a run that finds its stages does nothing; one that lost its last stage does that alone, with the same result
    again = Replay(frame(spark, pools), "ok", ["a", "b", "c"], str(tmp_path), max_ticks=90)
    assert again.run() == got


def test_a_stage_that_broke_off_is_run_again(spark, pools, tmp_path, monkeypatch):
    few = {k: pools[k] for k in ("ok", "a", "b")}
    replay = Replay(frame(spark, few), "ok", ["a", "b"], str(tmp_path), max_ticks=60)
    whole = Replay._learn

    def broken(self, *args):
        whole(self, *args)
        raise KeyboardInterrupt

    monkeypatch.setattr(Replay, "_learn", broken)
    with pytest.raises(KeyboardInterrupt):
        replay.run()
    monkeypatch.setattr(Replay, "_learn", whole)
    again = Replay(frame(spark, few), "ok", ["a", "b"], str(tmp_path), max_ticks=60)
    known = len(again.stages())
    got = again.run()
    want, _ = plain_replay(few, "ok", ["a", "b"], 60, 2.0)
    assert known < 2 and [(s.config, s.ticks, s.discovered, s.held) for s in got] == [(w["config"], w["ticks"], w["discovered"], w["held"]) for w in want]


def test_healthy_rows_between(spark, pools, tmp_path):
    replay = Replay(frame(spark, pools), "ok", ["a"], str(tmp_path), max_ticks=40, healthy_mix=0.3)
    drawn = replay._drawn("a", 5).collect()
    assert sorted(r["t"] for r in drawn) == list(range(1, 41)) and 3 < sum(r["truth"] == "ok" for r in drawn) < 25
    holdout = {r["vec_id"] for r in replay.table.members(0).filter("role = 'holdout'").collect()}
    assert {r["vec_id"] for r in drawn if r["truth"] == "ok"} <= holdout
    with pytest.raises(ValueError):
        Replay(frame(spark, pools), "ok", ["ok"], str(tmp_path))


def test_versions_refit_the_scaler(spark, pools, tmp_path):
    """Three versions: batch equals one after another equals NumPy; few rows are refused."""
    table, plain = ModelTable(spark, str(tmp_path)), Plain()
    assert table.latest() is None
    df, names = frame(spark, pools), ["ok", "a", "b"]
    grown = None
    for version, name in enumerate(names):
        assert table.register(df.filter(F.col("config") == name)) == version == table.latest()
        plain.add(pools[name])
        ids = [i for rows in pools.values() for i in rows]
        score, cls = plain.score(np.stack([x for rows in pools.values() for x in rows.values()]))
        got = {r["vec_id"]: r for r in table.score(df).collect()}
        assert all(got[i]["score"] == pytest.approx(s, rel=1e-6) and got[i]["cls"] == c for i, s, c in zip(ids, score, cls))
        assert table.boundary(version) == pytest.approx(plain.boundary(), rel=1e-6)
        some = table.members(version).withColumn("version", F.lit(version))
        grown = some if grown is None else grown.unionByName(some)
    models, _ = registered.fit(grown)
    assert {(r["version"], r["cls"]): round(r["threshold"], 9) for r in models.collect()} == {(v, r["cls"]): round(r["threshold"], 9) for v in range(3) for r in table.models(v).collect()}
    with pytest.raises(ValueError):
        table.register(df.filter("config = 'a'").limit(4))
    assert table.latest() == 2


def test_a_new_version_judges_later_batches_only(spark, pools, tmp_path):
    df = frame(spark, pools)
    table = ModelTable(spark, f"{tmp_path}/models")
    table.register(df.filter("config = 'ok'"))
    rows, out, state = f"{tmp_path}/rows", f"{tmp_path}/out", f"{tmp_path}/state"
    a = df.filter("config = 'a'")
    a.filter("vec_id % 2 = 0").coalesce(1).write.parquet(rows)
    stream = spark.readStream.schema(df.schema).parquet(rows)
    score_latest(stream, table, out, state).awaitTermination()
    table.register(a)
    a.filter("vec_id % 2 = 1").coalesce(1).write.mode("append").parquet(rows)
    score_latest(stream, table, out, state).awaitTermination()
    got = spark.read.parquet(out).groupBy("batch").agg(F.max("version").alias("v"), F.count("*").alias("n"), F.count_if(F.col("verdict") == "unknown").alias("u")).orderBy("batch").collect()
    assert [(r["batch"], r["v"], r["n"]) for r in got] == [(0, 0, 30), (1, 1, 30)] and got[0]["u"] == 30 and got[1]["u"] < 10


def test_quarantine_by_batch(spark, pools, tmp_path):
    df = frame(spark, pools)
    table = ModelTable(spark, f"{tmp_path}/models")
    table.register(df.filter("config = 'ok'"))
    rows = df.unionByName(df.filter("vec_id = 1000").withColumn("vec_id", F.lit(9000).cast("long")))
    scored = table.score(rows)
    one, two = Quarantine(spark, f"{tmp_path}/one"), Quarantine(spark, f"{tmp_path}/two")
    assert one.add(scored, 0)
    early = F.col("vec_id") < 2010
    assert two.add(scored.filter(early), 0) and two.add(scored.filter(~early), 1)
    key = lambda q: sorted((r["n"], r["vec_id"], r["attempt"]) for r in q.rows().collect())
    want = sorted(i for c in ("a", "b", "c") for i in pools[c])
    assert key(one) == key(two) == [(k + 1, i, k + 1 >= 25 and (k - 24) % 10 == 0) for k, i in enumerate(want)]
    held = key(two)
    two.add(scored.filter(early), 0)  # repeated batches change nothing
    two.add(scored.filter(~early), 1)
    assert key(two) == held
    three, tried = Quarantine(spark, f"{tmp_path}/three"), []
    df.coalesce(1).write.parquet(f"{tmp_path}/rows")
    quarantine_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/rows"), table, three, f"{tmp_path}/state", tried=tried.append).awaitTermination()
    assert key(three) == key(one) and tried == [0]
