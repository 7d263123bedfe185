"""Queries without SQL read all components of a vector."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from phmspark.operators import moments


class Seen(Exception):
    pass


@pytest.mark.parametrize("name, fit", [("m26_protocols", "fit_mahalanobis"), ("m24_registration", "means")])
def test_all_components_reach_the_fit(spark, tmp_path, monkeypatch, name, fit):
    rows = spark.range(60).select(F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label"), F.array_repeat(F.lit(1.0), 64).cast("array<float>").alias("embedding"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))

    def seen(df, *a, **k):
        raise Seen(df.select(F.size("f")).first()[0])

    monkeypatch.setattr(moments, fit, seen)
    with pytest.raises(Seen, match="^64$"):
        entry.queries()[name](spark, str(tmp_path))
