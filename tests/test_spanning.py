"""The minimum spanning forest of few nodes, without rounds over components."""

import numpy as np
import pytest

from phmspark.sources.scratch import written
from phmspark.streaming import discovery


def test_forest_in_runs_is_that_of_the_rounds(spark):
    """Many edges between few nodes, with equal weights and edges that come twice: runs of 64 edges give what rounds give."""
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 30, 400), rng.integers(0, 30, 400)
    rows = [(int(min(x, y)), int(max(x, y)), float(w)) for x, y, w in zip(a, b, rng.integers(0, 9, 400), strict=True) if x != y]
    edges = written(spark.createDataFrame(rows, "a long, b long, w double"), "edges")
    got = sorted(map(tuple, discovery.lightest(edges, 64).collect()))
    nodes = spark.range(30).withColumnRenamed("id", "node")
    assert len(got) == 29 and got == sorted(map(tuple, discovery.grown(edges.groupBy("a", "b").min("w").withColumnRenamed("min(w)", "w"), nodes)[0].collect()))
    assert discovery.lightest(written(edges.filter("a < 0"), "edges"), 64).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 90])
def test_tree_of_rows(n):
    rng = np.random.default_rng(n)
    m = np.column_stack((rng.integers(0, 4, (n, 3)).astype(float), rng.integers(0, 2, n)))
    ids = rng.permutation(1000)[:n].astype(np.int64)
    d = np.maximum(np.maximum(m[:, -1][:, None], m[:, -1]), np.sqrt(((m[:, None, :-1] - m[None, :, :-1]) ** 2).sum(axis=2)))
    i, j = np.triu_indices(n, 1)
    want = discovery._forest(ids[i], ids[j], d[i, j])
    a, b, w = discovery._tree_of(ids, m)
    assert len(discovery._forest(a, b, w)) == n - 1 and sorted(w.tolist()) == sorted(d[i, j][want].tolist())
