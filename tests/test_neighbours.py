"""The nearest-neighbour join: broadcast and indexed, against all distances."""

import numpy as np
import pytest

from phmspark.operators import neighbours


def plain(q, bank, k, not_self=True):
    out = set()
    for i, x in q:
        for c in sorted({b[1] for b in bank}):
            near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, b, y in bank if b == c and not (not_self and i == j))[:k]
            out |= {(i, c, r + 1, j, round(d, 9)) for r, (d, j) in enumerate(near)}
    return out


def rows_of(df):
    return {(r["query"], r["cls"], r["rank"], r["neighbour"], round(r["distance"], 9)) for r in df.collect()}


def clustered(n, groups, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 6)) * 100
    return [(k, f"c{k % groups % 3}", (centres[k % groups] + rng.normal(size=6)).tolist()) for k in range(n)]


@pytest.mark.parametrize("broadcast_values", [1_000_000, 0])
def test_same_rows_either_way(spark, broadcast_values):
    bank = clustered(300, 6)
    bank += [(1000 + k, "c0", bank[0][2]) for k in range(40)]  # copies: a crowded point, ties to smaller ids
    bank += [(2000, "few", bank[5][2])]
    df = spark.createDataFrame(bank, "id long, c string, f array<double>").repartition(3)
    q = df.filter("id % 7 = 0")
    got = neighbours.nearest(q, df, 4, "id", cls="c", not_self=True, block_rows=16, broadcast_values=broadcast_values)
    assert rows_of(got) == plain([(i, x) for i, _, x in bank if i % 7 == 0], bank, 4)


def test_far_blocks_are_not_met(spark):
    """On clustered rows most pairs of a query and a bank row are never compared."""
    bank = clustered(1200, 12)
    df = spark.createDataFrame(bank, "id long, c string, f array<double>")
    meter = spark.sparkContext.accumulator(0)
    got = rows_of(neighbours.nearest(df.filter("id < 60"), df, 3, "id", cls="c", block_rows=20, broadcast_values=0, meter=meter))
    assert got == plain([(i, x) for i, _, x in bank[:60]], bank, 3, not_self=False)
    assert meter.value < 60 * len(bank) / 2


def test_empty_sides(spark):
    df = spark.createDataFrame(clustered(20, 2), "id long, c string, f array<double>")
    none = df.filter("id < 0")
    assert neighbours.nearest(df, none, 2, "id").count() == 0
    for values in (0, 1000):
        assert neighbours.nearest(none, df, 2, "id", broadcast_values=values).count() == 0
