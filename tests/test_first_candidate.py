"""Attempts to cluster as the keys of one job, against the same attempts one by one."""

import numpy as np

from phmspark.streaming import discovery


def test_attempts_of_one_job_equal_attempts_one_by_one(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(0, 3, (30, 4)), rng.normal(20, 0.3, (40, 4)), rng.normal(-20, 0.3, (35, 4))))[rng.permutation(105)]
    held = spark.createDataFrame([(1000 - k, [float(v) for v in r], k) for k, r in enumerate(x, 1)], "vec_id long, f array<double>, k long")
    for n, least, samples in ((105, 10, 2), (80, 15, 3)):
        some = held.filter(f"k <= {n}")
        want = {frozenset(r["ids"]) for r in discovery.density_clusters(some, "vec_id", least, samples).selectExpr("vec_id", "cluster").groupBy("cluster").agg({"vec_id": "collect_list"}).toDF("cluster", "ids").collect()}
        ids, cluster = discovery.clusters_beside(np.arange(999, 999 - n, -1), x[:n], least, samples)
        assert want and {frozenset(ids[cluster == c].tolist()) for c in set(cluster.tolist())} == want
    end, top = discovery.first_candidate(held, [25, 55, 105], "k")
    assert end == 105 or end == 55
    alone = discovery.candidate(held.filter(f"k <= {end}").select("vec_id", "f"))[1]
    assert {r["vec_id"] for r in top.collect()} == {r["vec_id"] for r in alone.collect()}
    assert discovery.first_candidate(held, [25], "k") is None
