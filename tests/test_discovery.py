"""Density clusters in runs of edges against the hierarchy cut in one piece."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phmspark.sources.scratch import written
from phmspark.streaming import discovery


def select_clusters(nodes: int, edges: list[tuple[float, int, int]], least: int) -> np.ndarray:
    """Labels (-1: none) by excess of mass over the hierarchy of a forest's edges; the whole is never a cluster.
    Trees of the forest that nothing joins are joined last, at no density."""
    up, size = list(range(nodes)), [1] * nodes
    kids: dict[int, tuple[int, int, float]] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    joins = sorted(edges)
    roots = None
    for w, a, b in [*joins, *((np.inf, 0, k) for k in range(1, nodes))]:
        a, b = root(a), root(b)
        if a == b:
            continue
        k = len(up)
        up.append(k)
        size.append(size[a] + size[b])
        up[a] = up[b] = k
        kids[k] = (a, b, w)
        roots = k
    labels = np.full(nodes, -1)
    if roots is None:
        return labels

    def points(x: int) -> list[int]:
        found, todo = [], [x]
        while todo:
            x = todo.pop()
            if x in kids:
                todo += kids[x][:2]
            else:
                found.append(x)
        return found

    born, mass, inner, held = [0.0], [0.0], [[]], [roots]
    todo = [(roots, 0)]
    while todo:
        x, c = todo.pop()
        if x not in kids:
            continue
        a, b, w = kids[x]
        density = 1 / w if w > 0 else np.inf
        big = [k for k in (a, b) if size[k] >= least]
        lost = size[x] if len(big) != 1 else size[x] - size[big[0]]
        mass[c] += lost * (min(density, 1e12) - born[c])
        if len(big) == 2:
            for k in big:
                born.append(min(density, 1e12))
                mass.append(0.0)
                inner.append([])
                held.append(k)
                inner[c].append(len(held) - 1)
                todo.append((k, len(held) - 1))
        elif big:
            todo.append((big[0], c))
    chosen, best = [False] * len(held), list(mass)
    for c in range(len(held) - 1, 0, -1):
        below = sum(best[k] for k in inner[c])
        chosen[c] = not inner[c] or mass[c] >= below
        best[c] = max(mass[c], below)
    number, todo = 0, list(inner[0])
    while todo:
        c = todo.pop(0)
        if chosen[c]:
            labels[points(held[c])] = number
            number += 1
        else:
            todo += inner[c]
    return labels


@pytest.mark.parametrize("ties", [False, True])
def test_clusters_do_not_depend_on_the_runs(spark, ties):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, s, size=(n, 2)) for c, s, n in ((0, 0.3, 40), (3, 0.2, 30), (4, 0.2, 25), (40, 0.5, 30))] + [rng.uniform(-9, 9, size=(20, 2))])
    x = np.unique(np.round(x * 2), axis=0) if ties else x
    df = spark.createDataFrame([(3 * k, r.tolist()) for k, r in enumerate(x)], "vec_id long, f array<double>").repartition(2)
    tree = written(discovery.spanning_edges(df, "vec_id", 3), "tree")
    want = select_clusters(len(x), [(r["w"], r["a"] // 3, r["b"] // 3) for r in tree.collect() if r["w"] < np.inf], 8)
    assert ties or want.max() >= 2
    for segment in (1000, -(-(len(x) - 1) // 4)):
        got = {r["node"] // 3: r["cluster"] for r in discovery.clusters_of(tree, 8, segment).collect()}
        assert got == {k: int(c) for k, c in enumerate(want) if c >= 0}
    runs = Counter(r["seg"] for r in discovery.segmented(tree, segment).collect())
    assert len(runs) == 4 and max(runs.values()) <= segment and sum(runs.values()) == len(x) - 1


def test_the_ladder_stops_at_its_first_success(spark, monkeypatch):
    held = spark.range(80).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("f"))
    tried = []

    def clusters(rows, id_col, least, min_samples):
        tried.append((least, min_samples))
        return rows.filter(f"vec_id < {24 if least == 25 else 30}").select("vec_id", F.lit(0).alias("cluster"))

    monkeypatch.setattr(discovery, "density_clusters", clusters)
    assert discovery.candidate(held)[1].count() == 30 and tried == [(25, 3), (15, 3)]
    tried.clear()
    assert discovery.candidate(held.filter("vec_id < 70"))[1].isEmpty() and tried == [(25, 3)]
    tried.clear()
    assert discovery.candidate(held.filter("vec_id < 24"))[1].isEmpty() and tried == []


def test_adoption_and_what_a_refit_explains(spark):
    score = lambda xs: spark.createDataFrame([(k, float(x)) for k, x in enumerate(xs)], "vec_id long, score double")
    assert discovery.adopt(score([1, 2, 3, 4, 9]), 3.0) == ("rejected", 5)
    assert discovery.adopt(score([1, 2, 3.1, 4, 9]), 3.0) == ("adopted", 5)
    assert discovery.adopt(score([4, 5]), 3.0) == ("insufficient", 2)
    x = np.random.default_rng(0).normal(size=(40, 2))
    adopted = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, f array<double>")
    rest = spark.createDataFrame([(100, [0.0, 0.0], 3.0), (101, [50.0, 50.0], 3.0), (102, [50.0, 0.0], 1.5)], "vec_id long, f array<double>, score double")
    again = discovery.refit(adopted, rest)
    assert {r["vec_id"]: (r["nearest"], r["verdict"]) for r in again.collect()} == {100: ("discovered-1", "known"), 101: (None, "unknown"), 102: (None, "unknown")}
    assert {r["vec_id"] for r in discovery.pruned(rest, again).collect()} == {101}


def dense_weight(x: np.ndarray, min_samples: int) -> float:
    """Weight of the minimum spanning tree under mutual reachability, of the whole matrix of distances."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min_samples - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    least, out, total = w[0].copy(), np.ones(len(x), dtype=bool), 0.0
    out[0] = False
    for _ in range(len(x) - 1):
        k = int(np.where(out, least, np.inf).argmin())
        total += least[k]
        out[k] = False
        least = np.minimum(least, w[k])
    return total


@pytest.mark.parametrize("block_rows", [2048, 100])
def test_the_tree_is_that_of_all_distances(spark, block_rows):
    """Two thousand rows, groups of over 16 rows far apart, copies; far blocks do not meet."""
    rng = np.random.default_rng(3)
    groups = [rng.normal(c, 1, size=(n, 4)) for c, n in ((0, 700), (1000, 600), (1e4, 20), (-500, 400), (3, 200))]
    x = np.concatenate([*groups, np.repeat(groups[0][:1], 80, axis=0)])
    df = spark.createDataFrame([(7 * k, r.tolist()) for k, r in enumerate(x)], "vec_id long, f array<double>").repartition(4)
    meter = spark.sparkContext.accumulator(0)
    tree = discovery.spanning_edges(df, "vec_id", 3, block_rows=block_rows, meter=meter).collect()
    assert len(tree) == len(x) - 1 and len({v for r in tree for v in (r["a"], r["b"])}) == len(x)
    assert sum(r["w"] for r in tree) == pytest.approx(dense_weight(x, 3), rel=1e-9)
    assert block_rows > 2000 or 0 < meter.value < len(x) ** 2 / 3


def test_tree_of_few_rows(spark):
    one = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, f array<double>")
    assert discovery.spanning_edges(one, "vec_id", 3).count() == 0
    assert discovery.spanning_edges(one.filter("vec_id < 0"), "vec_id", 3).count() == 0
    two = spark.createDataFrame([(5, [0.0]), (6, [3.0])], "vec_id long, f array<double>")
    assert [tuple(r) for r in discovery.spanning_edges(two, "vec_id", 3).collect()] == [(5, 6, 3.0)]
