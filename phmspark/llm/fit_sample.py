"""Bounded samples of labelled texts to fit classifiers on."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phmspark.llm.common import written

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def sketch(text: str, words: int = 5) -> list[int]:
    """Four minimum hashes of the text's word shingles: equal for copies, mostly equal for near copies."""
    ws = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in text.split()]
    h = np.array(ws, dtype=np.uint64)
    if len(h) >= words:
        h = sum(h[k : len(h) - words + 1 + k] * np.uint64(0x100000001B3) ** np.uint64(k + 1) for k in range(words))
    if not len(h):
        return [0, 0, 0, 0]
    mixed = h[None, :] * _MIX[:, None]
    mixed ^= mixed >> np.uint64(29)
    return [int(x) & 0x7FFFFFFFFFFFFFFF for x in (mixed * _MIX[::-1, None]).min(axis=1)]


def class_counts(labels: DataFrame, label_col: str) -> dict:
    """Rows of each label; labels are few."""
    return {r["y"]: r["n"] for r in labels.groupBy(F.col(label_col).alias("y")).agg(F.count("*").alias("n")).collect()}


def share(key, counts: dict, per_class: int, label):
    """True for about ``per_class`` rows of each label, chosen by the key's hash: no sort, and alike in any order."""
    test = F.lit(False)
    for y, n in sorted(counts.items(), key=str):
        test = F.when(label == F.lit(y), F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, per_class / n))).otherwise(test)
    return test


def one_label(labels: DataFrame, label_col: str) -> DataFrame:
    """doc_id and y of documents whose labels (0 or 1) agree; null ids and labels, and documents labelled both ways, are
    left out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
    said = usable.groupBy("doc_id").agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("most"))
    return said.filter("y = most").select("doc_id", "y")


def distinct_texts(chosen: DataFrame, name: str) -> DataFrame:
    """text and y of ``chosen`` (doc_id, text, y), written, with copies and near copies left out: of texts that share a
    minimum hash one stays, so that a group of copies counts once. Of several texts under one id and label the least
    counts. Empty and null texts are left out."""
    one = chosen.filter(F.length(F.trim("text")) > 0).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    one = one.groupBy("text").agg(F.max("y").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sketch=[sketch(t) for t in batch["text"]])

    kind = chosen.schema["y"].dataType.simpleString()
    rows = written(one.mapInPandas(run, f"text string, y {kind}, sketch array<long>").withColumn("key", F.xxhash64("text")), f"{name}-rows")
    keys = rows.select("key", F.posexplode("sketch").alias("k", "h"))
    first = keys.groupBy("k", "h").agg(F.min("key").alias("first"))
    later = keys.join(first, ["k", "h"]).filter("key > first").select("key").distinct()
    return written(rows.join(later, "key", "left_anti").select("text", "y", "key"), name)
