"""Corpus cleaning in five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phmspark.llm import decontamination, language, ngram_join, packing, toxicity
from phmspark.llm.common import new_path, spread, table, written

_NO_ID = 1 << 61  # rows that their id does not tell apart stand under a number of their text from here on


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], new: list[str], keep) -> DataFrame:
    """Rows of ``docs`` that ``keep`` holds for among the columns that ``judge`` adds; columns of the new ones' names stay."""
    aside = {c: f"_own_{c}" for c in new if c in docs.columns}
    judged = judge(docs.withColumnsRenamed(aside)).filter(keep).drop(*new)
    return judged.withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts whose toxicity is 0.7 or more. Null and empty texts stay."""
    model = toxicity.fit_tables(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d: toxicity.score_texts(d, model), ["tox_score", "tox_passages"], F.col("tox_score") < 0.7)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that are in no known language: null, without a letter, or of letters whose languages, one or more,
    are less than half sure."""
    model = language.fit_tables(docs)
    return _kept(docs, lambda d: language.label_texts(d, model), ["lang_pred", "lang_score", "lang_sure"], (F.col("lang_pred") != "und") & (F.col("lang_sure") >= 0.5))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked texts. Repeated rows of one id and text count as
    one document (of rows that differ in other columns the least stays); different texts under one id are documents of
    their own. These, and rows without an id, stay only if no other row is in their group, one for each text."""
    text_id = F.lit(_NO_ID) + F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(_NO_ID - 1))
    named = docs.withColumn("_row_id", F.coalesce(F.col("doc_id").cast("long"), text_id))
    texts = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    shared = texts.filter("a != b").select("doc_id", F.lit(True).alias("_shared"))
    if not shared.isEmpty():
        named = named.join(shared, "doc_id", "left").withColumn("_row_id", F.when(F.col("_shared"), text_id).otherwise(F.col("_row_id"))).select(*docs.columns, "_row_id")
    found = ngram_join.components(named, id_col="_row_id").groupBy("_row_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
    marked = found.filter((F.col("c") != F.col("_row_id")) | (F.col("n") > 1)).select("_row_id", (F.col("c") == F.col("_row_id")).alias("stays"))
    marked = written(marked, "marked")
    named = ngram_join.flagged(named, F.col("_row_id"), marked, "_row_id")  # other texts stay where they are
    met = named.filter("_may").join(marked, "_row_id", "left")
    by = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    once = met.filter("stays").groupBy("_row_id").agg(F.min_by(F.struct(*docs.columns), F.struct(*by)).alias("r")).select("r.*")
    return named.filter("NOT _may").select(docs.columns).unionByName(met.filter("stays IS NULL").select(docs.columns)).unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts of which a twentieth or more is in windows of benchmark items."""
    new = ["n_words", "n_hit", "n_items", "items", "spans"]
    return _kept(docs, lambda d: decontamination.decontaminate(d, table(spark, sf_dir, "benchmark")), new, ~decontamination.contaminated())


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rest's tokens and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_rest),
]
ORACLE_SQL = None  # learned models, components and packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; null and repeated rows as each stage says. An empty table
    gives no rows."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
