"""WARC archives and their fixity audit by Merkle trees.

Each record's SHA-256 is a leaf, in the order of the records' offsets. Up to ``FANOUT`` neighbours make a node whose
digest covers their digests and offset ranges; trees of segments are joined by a tree over the segments. Two replicas
with equal roots are equal. Else only children of mismatching nodes are compared, level by level, down to the records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phmspark.llm.common import table, written

FANOUT = 16
SEGMENT_IDS = 1024  # page ids of a segment
NO_ID_SEGMENTS = 4096
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.I)


def record_text(url: Column, payload: Column, date: str) -> Column:
    """A WARC resource record of the payload."""
    n = F.octet_length(payload).cast("string")
    head = ["WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: ", url, f"\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: ", n, "\r\n\r\n"]
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in head), payload, F.lit("\r\n\r\n"))


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, segment, ordinal, start, length and record (text) for every page.

    Pages of neighbouring ids make a segment, in the order of id, url and content; pages without an id, and those of an
    id that more than ``SEGMENT_IDS`` pages have, are dealt by content over ``NO_ID_SEGMENTS`` segments below 0. A null
    url or html is empty. Repeated rows each give a record. Other columns are not read.
    """
    url, html = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), record_text(url, html, date).alias("record"))
    crowded = pages.groupBy(F.col(id_col).alias("page_id")).agg(F.count("*").alias("n")).filter((F.col("n") > SEGMENT_IDS) & F.col("page_id").isNotNull()).select("page_id", F.lit(True).alias("crowded"))
    rows = rows.withColumn("crowded", F.lit(None).cast("boolean")) if crowded.isEmpty() else rows.join(crowded, "page_id", "left")
    rows = rows.withColumn("segment", F.coalesce(F.when(F.col("crowded").isNull(), F.floor(F.col("page_id") / SEGMENT_IDS)), -1 - F.pmod(F.xxhash64("record"), F.lit(NO_ID_SEGMENTS))).cast("long")).withColumn("length", F.octet_length("record").cast("long"))
    rows = rows.drop("crowded")
    order = Window.partitionBy("segment").orderBy("page_id", "record")
    rows = rows.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
    before = Window.partitionBy("segment").orderBy("page_id", "record").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def write_warc(rows: DataFrame, path: str) -> None:
    """WARC files of whole segments, records in order. A record ends with a line end, which Spark's text writer adds."""
    laid = rows.repartition("segment").sortWithinPartitions("segment", "ordinal")
    laid.select(F.expr("substring(record, 1, char_length(record) - 1)").alias("value")).write.option("lineSep", "\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, start, length, uri and payload (binary) of every record of WARC files; a task holds one file.

    What is no whole record (no length, or a length beyond the file) is one row up to the next record's beginning, with
    a null payload."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, rows = 0, []
                while at < len(content):
                    body = content.find(b"\r\n\r\n", at) + 4
                    size = _LENGTH.search(content, at, body) if body > 3 and content.startswith(b"WARC/", at) else None
                    if not size or body + int(size[1]) > len(content):
                        end = content.find(b"WARC/1.", at + 1)
                        end = len(content) if end < 0 else end
                        rows.append((name, len(rows), at, end - at, None, None))
                        at = end
                        continue
                    size = int(size[1])
                    uri = re.search(rb"\r\nWARC-Target-URI:[ \t]*([^\r]*)", content[at:body], re.I)
                    end = body + size + 4
                    rows.append((name, len(rows), at, end - at, uri[1].decode("utf-8", "replace") if uri else None, content[body : body + size]))
                    at = end
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["file", "ordinal", "start", "length", "uri", "payload"])

    return files.mapInArrow(run, "file string, ordinal long, start long, length long, uri string, payload binary")


def leaves(rows: DataFrame) -> DataFrame:
    """segment, place, start, stop, digest of records (a record or payload column named record)."""
    return rows.select("segment", F.col("ordinal").alias("place"), "start", (F.col("start") + F.col("length")).alias("stop"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))


def _parents(nodes: DataFrame, segment: Column, place: Column) -> DataFrame:
    """At most FANOUT nodes of a parent are gathered, in order."""
    child = F.struct("segment", "place", "start", "stop", "digest")
    up = nodes.select(segment.alias("s"), place.alias("p"), child.alias("c")).groupBy("s", "p").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    said = F.array_join(F.transform("cs", lambda c: F.concat_ws(":", c["segment"], c["place"], c["start"], c["stop"], c["digest"])), ",")
    return up.select(F.col("s").alias("segment"), F.col("p").alias("place"), F.array_min(F.col("cs.start")).alias("start"), F.array_max(F.col("cs.stop")).alias("stop"), F.sha2(said, 256).alias("digest"))


def tree(rows: DataFrame, depth: tuple[int, int]) -> list[DataFrame]:
    """Levels of nodes from the leaves to the root. ``depth``: levels inside the segments, and above them."""
    levels = [written(leaves(rows), "leaves")]
    for _ in range(depth[0]):
        levels.append(written(_parents(levels[-1], F.col("segment"), F.floor(F.col("place") / FANOUT).cast("long")), "nodes"))
    for _ in range(depth[1]):
        levels.append(written(_parents(levels[-1], F.floor(F.col("segment") / FANOUT).cast("long"), F.lit(0).cast("long")), "nodes"))
    return levels


def depth_of(*replicas: DataFrame) -> tuple[int, int]:
    """Levels that bring every replica to one root (and segments below 0, of null ids, to their own)."""
    most = [r.agg(F.max("ordinal").alias("o"), F.max(F.abs("segment")).alias("s")).first() for r in replicas]

    def levels(n: int) -> int:
        k = 0
        while n > 0:
            n, k = n // FANOUT, k + 1
        return k

    return levels(max((m["o"] or 0 for m in most), default=0)), levels(max((m["s"] or 0 for m in most), default=0))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """segment, ordinal, start, length, status (changed, missing, extra: of ``b``), digest and found of every record in
    which ``b`` (segment, ordinal, start, length, record) differs from ``a``. Two empty or equal replicas give no rows;
    a replica that is empty lacks every record."""
    depth = depth_of(a, b)
    ta, tb = tree(a, depth), tree(b, depth)
    n = sum(depth)
    wrong = None
    for level in range(n, -1, -1):
        x, y = ta[level], tb[level]
        if wrong is not None:  # only children of mismatching parents
            inside = level < depth[0]
            up = [F.col("segment") if inside else F.floor(F.col("segment") / FANOUT).cast("long"), F.floor(F.col("place") / FANOUT).cast("long") if inside else F.lit(0).cast("long")]
            x, y = (t.withColumns({"us": up[0], "up": up[1]}).join(wrong, ["us", "up"], "left_semi").drop("us", "up") for t in (x, y))
        theirs = y.select("segment", "place", *(F.col(c).alias(f"b_{c}") for c in ("start", "stop", "digest")))
        both = x.join(theirs, ["segment", "place"], "full_outer")
        same = reduce(lambda p, c: p & F.col(c).eqNullSafe(F.col(f"b_{c}")), ("start", "stop", "digest"), F.lit(True))
        apart = both.filter(~same)
        if level:
            wrong = written(apart.select(F.col("segment").alias("us"), F.col("place").alias("up")), "mismatches")
    status = F.when(F.col("b_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    start, stop = F.coalesce("start", "b_start"), F.coalesce("stop", "b_stop")
    return apart.select("segment", F.col("place").alias("ordinal"), start.alias("start"), (stop - start).alias("length"), status.alias("status"), "digest", F.col("b_digest").alias("found"))


def damaged(rows: DataFrame) -> DataFrame:
    """A replica to audit: one character of some records is another, and some segments lost their last record."""
    body = F.locate("\r\n\r\n<", F.col("record")) + 4
    hurt = F.when((F.col("page_id") % 97 == 5) & F.col("record").contains("\r\n\r\n<"), F.overlay("record", F.lit("#"), body, F.lit(1))).otherwise(F.col("record"))
    last = F.max("ordinal").over(Window.partitionBy("segment"))
    return rows.withColumn("record", hurt).withColumn("last", last).filter((F.col("segment") % 3 != 1) | (F.col("ordinal") < F.col("last"))).drop("last")


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a damaged replica of all pages."""
    rows = written(records(table(spark, sf_dir, "pages")), "records")
    found = audit(rows, damaged(rows))
    return found.join(rows.select("segment", "ordinal", "page_id"), ["segment", "ordinal"], "left").select("page_id", "segment", "ordinal", "start", "length", "status", "digest", "found")


OP10_SQL = """
WITH rec AS (
  SELECT page_id, floor(page_id / 1024)::BIGINT AS segment,
         concat('WARC/1.0', e, 'WARC-Type: resource', e, 'WARC-Target-URI: ', coalesce(url, ''), e, 'WARC-Date: 2024-01-01T00:00:00Z', e,
                'Content-Type: text/html', e, 'Content-Length: ', strlen(coalesce(html, '')), e, e, coalesce(html, ''), e, e) AS record
  FROM pages, (SELECT chr(13) || chr(10) AS e)),
laid AS (
  SELECT *, row_number() OVER w - 1 AS ordinal, strlen(record) AS length, sum(strlen(record)) OVER w - strlen(record) AS start,
         count(*) OVER (PARTITION BY segment) - 1 AS last, strpos(record, chr(13) || chr(10) || chr(13) || chr(10) || '<') AS body
  FROM rec WINDOW w AS (PARTITION BY segment ORDER BY page_id, record)),
twin AS (
  SELECT *, CASE WHEN page_id % 97 = 5 AND body > 0 THEN substr(record, 1, body + 3) || '#' || substr(record, body + 5) ELSE record END AS other,
         segment % 3 = 1 AND ordinal = last AS lost FROM laid)
SELECT page_id, segment, ordinal::BIGINT AS ordinal, start::BIGINT AS start, length::BIGINT AS length, CASE WHEN lost THEN 'missing' ELSE 'changed' END AS status,
       sha256(record) AS digest, CASE WHEN NOT lost THEN sha256(other) END AS found
FROM twin WHERE lost OR other <> record
"""
