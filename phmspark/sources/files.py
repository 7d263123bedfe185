"""Feature files, recorder files and result sinks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phmspark.functions.scalars import canonical_config, dataset_key


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line of text files, whole lines in order; for audits of headers and cells."""
    rows = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value"))
    return rows.select("file", F.posexplode(F.split(F.regexp_replace("value", "\\r?\\n$", ""), "\\r?\\n")).alias("pos", "line"))


def read_features(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """motor, rpm, config, dataset, file, f of feature files under .../motor/rpm/config/file.csv.

    The schema is fixed and a cell that is no number fails the read; nothing is inferred, dropped or mended."""
    schema = ", ".join(f"`{h}` double" for h in header)
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    file = F.input_file_name()
    part = lambda k: F.element_at(F.split(file, "/"), -k)
    return rows.select(part(4).alias("motor"), part(3).alias("rpm"), canonical_config(part(2)).alias("config"), dataset_key(part(4), part(3)).alias("dataset"), file.alias("file"), F.array(*(F.col(f"`{h}`") for h in header)).alias("f"))


def melt_windows(wide: DataFrame, order: str) -> DataFrame:
    """win, samples: a file of one column for each window and one row for each sample, as one array for each window."""
    names = [c for c in wide.columns if c != order]
    long = wide.unpivot([order], names, "win", "value")
    return long.groupBy("win").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda x: x["value"]).alias("samples"))


def read_recorder(spark: SparkSession, path: str, columns: list[str], skip: int = 23) -> DataFrame:
    """Recorder files: tab-separated, the header on line ``skip``; doubles, and Delta_T from the two temperatures."""
    lines = text_lines(spark, path).filter(F.col("pos") >= skip)
    cells = lines.withColumn("c", F.split("line", "\t"))
    rows = cells.select("file", "pos", *(F.get("c", F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(columns)))
    return rows.withColumn("Delta_T", F.col("Temp_C") - F.col("Temp_room")) if {"Temp_C", "Temp_room"} <= set(columns) else rows


def write_features(df: DataFrame, path: str, force: bool = False) -> None:
    """Partitioned by motor, rpm and config. An existing path is refused, or with ``force`` only the partitions there are
    rows for are replaced."""
    writer = df.write.partitionBy("motor", "rpm", "config")
    (writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if force else writer.mode("errorifexists")).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """JSON lines; a number that JSON has no form for stops the write."""
    doubles = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    bad = None
    for c in doubles:
        test = F.isnan(c) | (F.abs(c) == math.inf)
        bad = test if bad is None else bad | test
    checked = df if bad is None else df.withColumn("_ok", F.when(bad, F.raise_error(F.lit("not a finite number"))).otherwise(F.lit(True))).filter("_ok").drop("_ok")
    checked.write.json(path)
