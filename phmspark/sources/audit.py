"""Feature files as bytes: each is accepted whole or rejected whole, for the first reason that holds."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Reasons for which a file is rejected, in the order in which they are tested.
REASONS = ("unreadable_csv", "empty_file", "duplicate_header", "ordered_header_mismatch", "empty_configuration", "row_width_mismatch", "non_numeric", "parsed_shape_mismatch", "non_finite")
# Cells that a table reader takes for missing numbers.
MISSING = frozenset(" #N/A #N/A N/A #NA -1.#IND -1.#QNAN -NaN -nan 1.#IND 1.#QNAN <NA> N/A NA NULL NaN None n/a nan null".split(" "))
SHOWN_ROWS = 20  # numbers of rejected rows that are told; all are counted

AUDIT = "file string, status string, reason string, schema_version string, rows long, rejected_rows long, row_indices array<long>, sha256 string, header_sha256 string"


def _number(cell: str) -> float | None:
    """The cell's number, NaN for a missing one; None if it has none."""
    if cell.strip() in MISSING:
        return math.nan
    try:
        return float(cell)
    except ValueError:
        return None


def audited(payload: bytes, registry: dict[str, tuple[str, ...]]) -> tuple:
    """status, reason, schema_version, rows, rejected_rows, row_indices (from 0, the first ``SHOWN_ROWS``), sha256 and
    header_sha256 of a file's bytes. A byte order mark is no part of the header; quoting is strict."""

    def no(reason: str, rows: int = 0, bad: list[int] | None = None) -> tuple:
        return "REJECTED", reason, None, rows, rows if bad is None else len(bad), (bad or [])[:SHOWN_ROWS], None, None

    try:
        records = list(csv.reader(io.StringIO(payload.decode("utf-8-sig"), newline=""), strict=True))
    except (UnicodeError, csv.Error):
        return no("unreadable_csv")
    if not records:
        return no("empty_file")
    header, rows = records[0], records[1:]
    if len(header) != len(set(header)):
        return no("duplicate_header", len(rows))
    version = next((v for v, names in registry.items() if tuple(header) == names), None)
    if version is None:
        return no("ordered_header_mismatch", len(rows))
    if not rows:
        return no("empty_configuration")
    bad = [k for k, row in enumerate(rows) if len(row) != len(header)]
    if bad:
        return no("row_width_mismatch", len(rows), bad)
    values = [[_number(c) for c in row] for row in rows]
    if any(v is None for row in values for v in row):  # then a missing number is none either
        return no("non_numeric", len(rows), [k for k, row in enumerate(rows) if any(_number(c) is None or not c.strip() or (c.strip() in MISSING and c.strip().lower() not in ("nan", "-nan")) for c in row)])
    if len(header) == 1 and any(not row[0].strip() for row in rows):  # a table reader passes over blank lines
        return no("parsed_shape_mismatch", len(rows))
    bad = [k for k, row in enumerate(values) if not all(map(math.isfinite, row))]
    if bad:
        return no("non_finite", len(rows), bad)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return "VERIFIED", None, version, len(rows), 0, [], digest(payload), digest(json.dumps(header, ensure_ascii=False, separators=(",", ":")).encode())


def audit_files(spark: SparkSession, path: str, registry: dict[str, list[str]]) -> DataFrame:
    """The audit of every file under ``path``: file (its path), status, reason (null: verified), schema_version, rows,
    rejected_rows, row_indices, sha256, header_sha256. ``registry``: version -> exact header. A task holds one file."""
    known = {v: tuple(names) for v, names in registry.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, payload in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(file, *audited(bytes(payload), known))], columns=[c.split()[0] for c in AUDIT.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, AUDIT)
