"""Audits: each gives rows that say what is wrong, never drops or mends data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Reasons a feature file is rejected for, in the order they are tested.
REASONS = ("empty file", "duplicate header", "header mismatch", "row width", "non-numeric", "non-finite")


def audit_lines(lines: DataFrame, header: list[str], keys: list[str], order: str, line: str) -> DataFrame:
    """keys, reason (null: accepted), rows, bad and first_bad (how many rows the reason holds for, and the number, from 1,
    of the first; null for none) of text files.

    ``lines`` has every line of every file, the header first by ``order``. A file is rejected whole, for the first reason
    that holds. Lines are tested one by one and only counted.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    n = len(header)
    cells = lines.withColumn("_n", F.row_number().over(w) - 1).withColumn("_c", F.split(F.regexp_replace(line, "^﻿", ""), ","))
    number = F.transform("_c", lambda x: F.trim(x).try_cast("double"))
    first = F.col("_n") == 0
    reason = (
        F.when(first & (F.size("_c") != F.size(F.array_distinct("_c"))), 1)
        .when(first & (F.col("_c") != F.array(*map(F.lit, header))), 2)
        .when(~first & (F.size("_c") != n), 3)
        .when(~first & F.exists(number, lambda x: x.isNull()), 4)
        .when(~first & F.exists(number, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), 5)
    )
    told = cells.withColumn("_r", reason).groupBy(*keys).agg(F.count("*").alias("_lines"), F.min("_r").alias("_first"), *(x for r in (3, 4, 5) for x in (F.count_if(F.col("_r") == r).alias(f"_k{r}"), F.min(F.when(F.col("_r") == r, F.col("_n"))).alias(f"_n{r}"))))
    code = F.when(F.col("_lines") <= 1, F.lit(0)).otherwise(F.col("_first"))
    of = lambda c: F.coalesce(*(F.when(F.col("_code") == r, F.col(f"_{c}{r}")) for r in (3, 4, 5)))
    return told.withColumn("_code", code).select(*keys, F.when(F.col("_code").isNotNull(), F.get(F.array(*map(F.lit, REASONS)), F.col("_code"))).alias("reason"), (F.col("_lines") - 1).alias("rows"), F.coalesce(of("k"), F.lit(0)).alias("bad"), of("n").alias("first_bad"))


def audit_coverage(df: DataFrame, keys: list[str], item: str, expected: list, needed) -> DataFrame:
    """keys, missing (sorted), extra (sorted), usable (``needed`` is there) of the distinct items of each group."""
    there = df.groupBy(*keys).agg(F.collect_set(item).alias("_s"))  # items are class names: few
    want = F.array(*map(F.lit, expected))
    return there.select(*keys, F.array_sort(F.array_except(want, "_s")).alias("missing"), F.array_sort(F.array_except("_s", want)).alias("extra"), F.array_contains("_s", needed).alias("usable"))


def unseen(df: DataFrame, manifest: DataFrame, content: str) -> DataFrame:
    """Rows whose content's SHA-256 the manifest (sha) does not have."""
    return df.withColumn("sha", F.sha2(F.col(content).cast("binary"), 256)).join(manifest.select("sha").distinct(), "sha", "left_anti")
