"""Token counts through a digest cache.

Content (null: the empty text) is named by its SHA-256, a tokenizer by the SHA-256 of its file. Counts that the cache
table holds for (content, tokenizer) are joined; of all other contents one copy each is encoded, and the counts are
appended to the cache. The only normalisation that keeps every tokenizer's counts is null -> empty, so that is the one used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from phmspark.llm.batches import cuts
from phmspark.llm.bits import flagged
from phmspark.llm.common import new_path, spread, table, written

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another file is another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; a cache that was never written is empty."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(df: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens and digest per row of ``df``.

    Null and empty texts have 0 bytes and the tokenizer's count of the empty text (0). Repeated rows and null ids each
    give a row. Other columns are not read. Copies, however many, are encoded once: the copy with the smallest id
    stands for its digest (found by map-side-combined counts and minimum); where several rows have that id and text, one
    of them does. The bits of cached and of repeated digests travel to the rows: a text without its bit is encoded where
    it is read, and only texts that have it move. Both joins on the digest are plain joins, so a digest held by a third of
    all rows is split by AQE.
    Appending is by whole Parquet files; two runs that append the same digest give it twice with the same count, and
    reading takes one of them.
    """
    spark = df.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("digest", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    known = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # _key: an id that joins even where it is null
    keyed = docs.withColumn("_key", F.coalesce(F.col("_id").cast("string"), F.lit("")))
    least = written(keyed.groupBy("digest", "_key").agg(F.count("*").alias("n")).groupBy("digest").agg(F.min("_key").alias("_key"), F.sum("n").alias("n")), "digests")
    may = flagged(keyed, F.col("digest"), known.select("digest").unionByName(least.filter("n > 1").select("digest")), "digest")
    fresh = may.filter("NOT _may").select("digest", "_text")  # surely neither cached nor repeated: encoded where it is read
    standing = least.join(known, "digest", "left_anti").select("digest", "_key")
    misses = fresh.unionByName(may.filter("_may").join(standing, ["digest", "_key"], "left_semi").select("digest", "_text").dropDuplicates(["digest"]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path)
        for batch in batches:
            where = cuts(pc.binary_length(batch.column(1)).to_numpy()) if batch.num_rows else []
            for a, b in zip(where, where[1:]):
                n = count(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([version] * (b - a)), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    sized = docs.select("_id", "digest", F.octet_length("_text").cast("long").alias("n_bytes"))
    return sized.join(counts, "digest").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", "digest")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents over a cache of its own; odd rows as said at ``count_tokens``."""
    import public_tokenizers

    counted = count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("piece_bpe_32k.model"), new_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
