"""Cumulative counts over ranges of scores."""

import random

from pyspark.sql import functions as F

from phmspark.operators import metrics


def test_ranges_add_up_and_no_window_spans_a_key(spark, capsys):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.random(), 0.5, None]), rng.random() < 0.4) for k in ("a", "b", None) for _ in range(300)]
    h = metrics.histogram(spark.createDataFrame(rows, "k string, score double, pos boolean"), ["k"], "score", "pos")
    low = lambda x: float("-inf") if x is None else x
    for r in h.collect():
        mine = [(low(s), pos) for k, s, pos in rows if k == r["k"]]
        at = low(r["score"])
        assert (r["tp"], r["fp"]) == tuple(sum(s >= at and pos == side for s, pos in mine) for side in (True, False))
        assert (r["np"], r["nq"]) == tuple(sum(pos == side for _, pos in mine) for side in (True, False))
    h.explain()
    sorts = [x for x in capsys.readouterr().out.splitlines() if "windowspecdefinition" in x and "score" in x]
    assert sorts and all("_part" in x.split("score")[0] for x in sorts)
