"""Few labels: how well held-out toxic texts are found."""

import numpy as np
import pytest

from phmspark.llm import toxicity


@pytest.mark.parametrize("sf, least_auc, least_recall", [("sf0.01", 0.85, 0.7), ("sf0.1", 0.96, 0.9)])
def test_held_out_texts(spark, sf, least_auc, least_recall):
    folder = f"/root/testdata/{sf}"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in toxicity.op4_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    y, x = np.array([labels[r["doc_id"]] for r in got]), np.array([r["score"] for r in got])
    over = x[y == 1][:, None] - x[y == 0][None]
    assert ((over > 0) + 0.5 * (over == 0)).mean() >= least_auc
    told = np.array([r["predicted"] for r in got])
    assert told[y == 1].mean() >= least_recall and y[told == 1].mean() >= 0.95
