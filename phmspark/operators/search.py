"""Best sections for questions by overlap of weighted terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_CELLS = 1_000_000  # scores (sections x questions) that a task holds at once


def best_sections(asked: DataFrame, told: DataFrame, weights: dict[str, int], k: int, most_terms: int = 2_000_000) -> DataFrame:
    """query, rank (from 1), section, score: the ``k`` sections of highest score for each question, ties to smaller ids.

    ``asked`` has query and terms (distinct), ``told`` section (a long) and an array of distinct terms in each column of
    ``weights``; a question's term in a column counts the column's weight. Questions of up to ``most_terms`` terms in all
    are broadcast as an index, and each task sends on only its ``k`` best sections of each; more meet sections by term.
    """
    size = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    scored = _by_index(asked, told, weights, k) if size <= most_terms else _by_term(asked, told, weights)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "section"))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query", "rank", "section", "score")


def _by_term(asked: DataFrame, told: DataFrame, weights: dict[str, int]) -> DataFrame:
    long = None
    for c, w in weights.items():
        one = told.select("section", F.explode(c).alias("term"), F.lit(w).cast("long").alias("w"))
        long = one if long is None else long.unionByName(one)
    return asked.select("query", F.explode("terms").alias("term")).join(long, "term").groupBy("query", "section").agg(F.sum("w").alias("score"))


def _by_index(asked: DataFrame, told: DataFrame, weights: dict[str, int], k: int) -> DataFrame:
    questions = sorted(((r["query"], r["terms"]) for r in asked.select("query", "terms").collect()), key=lambda q: str(q[0]))
    place: dict[str, list[int]] = {}
    for q, (_, terms) in enumerate(questions):
        for t in terms:
            place.setdefault(t, []).append(q)
    terms = sorted(place)
    starts = np.concatenate(([0], np.cumsum([len(place[t]) for t in terms]))).astype(np.int64)
    of = np.array([q for t in terms for q in place[t]], dtype=np.int64)
    shared = told.sparkSession.sparkContext.broadcast((terms, starts, of, len(questions)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, begin, items, n = shared.value
        vocabulary, step = pa.array(names, pa.string()), max(1, _CELLS // max(1, n))
        best, which = np.zeros((0, n), dtype=np.int64), np.zeros((0, n), dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows if n else 0, step):
                some = batch.slice(a, step)
                scores = np.zeros(some.num_rows * n, dtype=np.int64)
                for c, w in enumerate(weights.values(), start=1):
                    lists = some.column(c)
                    row = np.repeat(np.arange(some.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                    at = pc.index_in(lists.flatten(), value_set=vocabulary)
                    known = at.is_valid().to_numpy(zero_copy_only=False)
                    row, at = row[known], at.drop_null().to_numpy().astype(np.int64)
                    many = begin[at + 1] - begin[at]
                    first = np.repeat(begin[at] - np.concatenate(([0], np.cumsum(many)))[:-1], many)
                    scores += w * np.bincount(np.repeat(row, many) * n + items[first + np.arange(len(first))], minlength=len(scores))
                best = np.concatenate((best, scores.reshape(-1, n)))
                which = np.concatenate((which, np.repeat(some.column(0).to_numpy()[:, None], n, axis=1)))
                order = np.lexsort((which, -best), axis=0)[:k]
                best, which = np.take_along_axis(best, order, axis=0), np.take_along_axis(which, order, axis=0)
        place, question = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(question), pa.array(which[place, question]), pa.array(best[place, question])], names=["q", "section", "score"])

    found = told.select("section", *weights).mapInArrow(run, "q long, section long, score long")
    kind = asked.schema["query"].dataType.simpleString()
    numbered = asked.sparkSession.createDataFrame(list(enumerate(q for q, _ in questions)), f"q long, query {kind}")
    return found.join(F.broadcast(numbered), "q").select("query", "section", "score")  # bounded by the count above
