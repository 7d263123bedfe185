"""Streams: scoring against a model table, trend and trajectory state by key, session windows, sinks.

Each function maps a streaming DataFrame to one; ``drain`` runs a stream over all there is and gives its result as a
table. Rows of a key are put in order inside each micro-batch; states are those of the batch folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from phmspark.operators import series
from phmspark.sources.scratch import new_path


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream: asset, ts (event time), event_id, score, kind."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, so that one file will do as well as a folder
    return rows.select(F.col("user_id").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") / 50).alias("score"), F.col("event_type").alias("kind"))


def folded(stream: DataFrame, key: str, order: list[str], make: type, value: str, **rule) -> DataFrame:
    """``stream`` with the columns of ``new`` from a state by key that ``step(value)`` moves; ``make`` is its class, with
    STATE, the state's columns, and ``held()``, their values. Rows without a key have no state and are left out."""
    rows = stream.filter(F.col(key).isNotNull())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    new = make.NEW
    names = [c.split()[0] for c in new.split(", ")]

    def run(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = make(state.get, **rule) if state.exists else make(**rule)
        batch = pd.concat(list(frames)).sort_values(order)
        out = [held.step(x) for x in batch[value]]
        state.update(held.held())
        yield batch.assign(**{n: [r[k] for r in out] for k, n in enumerate(names)})

    return rows.groupBy(key).applyInPandasWithState(run, f"{kinds}, {new}", make.STATE, "append", GroupStateTimeout.NoTimeout)


def trend_stream(stream: DataFrame, key: str = "asset", order: list[str] | None = None, score: str = "score", **params) -> DataFrame:
    return folded(stream, key, order or ["ts", "event_id"], series.Trend, score, **params)


def trajectory_stream(stream: DataFrame, key: str = "asset", order: list[str] | None = None, health: str = "health") -> DataFrame:
    """Rows without a key or health have no state; their trend is ``insufficient`` and the other new columns are null."""
    there = F.col(key).isNotNull() & F.col(health).isNotNull()
    rows = folded(stream.filter(there), key, order or ["ts", "event_id"], series.LiveTrajectory, health)
    empty = [F.lit("insufficient" if c == "trend" else None).cast(t).alias(c) for c, t in (x.split() for x in series.LiveTrajectory.NEW.split(", "))]
    return rows.unionByName(stream.filter(~there).select("*", *empty))


def score_stream(stream: DataFrame, models: DataFrame, cls: str) -> DataFrame:
    """Rows joined to a static model table (cls, threshold); above 1 is unknown."""
    met = stream.join(models, cls).withColumn("ratio", F.col("score") / F.greatest("threshold", F.lit(1e-12)))
    return met.withColumn("verdict", F.when(F.col("ratio") > 1, "unknown").otherwise("known")).drop("threshold")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Gap-based sessions by asset; rows later than the watermark are dropped."""
    w = stream.withWatermark("ts", late).groupBy("asset", F.session_window("ts", gap))
    return w.agg(F.count("*").alias("n"), F.avg("score").alias("mean")).select("asset", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "mean")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there. Appended rows go to one table; a complete result replaces the last, each
    batch under its own number, so that a repeated batch changes nothing."""
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    last: list[int] = []
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/{number}")
            last.append(number)

        q = stream.writeStream.foreachBatch(put).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    return spark.read.parquet(f"{out}/{last[-1]}") if last else spark.createDataFrame([], stream.schema)
