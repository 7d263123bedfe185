"""How the sources of each language differ in vocabulary, over run-length encoded count columns.

Each (language, source) group has a column: the count of every kept term of the language. The vocabulary is put in the
order of the terms' counts by source, so that terms with equal counts everywhere stand together and a column is a few
runs of equal counts. The vocabulary is cut into blocks; in each, every column is run-length encoded, and two columns
are compared by intersecting the boundaries of their runs: a divergence term is computed once an intersection and
multiplied by its length. Nothing is computed term by term for pairs of sources.

Probabilities are whole numbers, ``1 + floor(10^9 (count + 1) / (N + V))`` for N occurrences of V kept terms, and the
divergence of p from q is ``floor((p - q)^2 / q)``, all exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phmspark.llm.batches import cuts
from phmspark.llm.common import spread, table, written

LEAST_DOCS = 3
TOP_TERMS = 200
BROADCAST_ROWS = 100_000  # of group tables (a row for each language and source); beyond, the join is a shuffle
HELD_TERMS = 200_000  # counts that a task holds before it passes them on
TILE = 64  # columns of a block that meet in one task with as many others
UNIT = 1_000_000_000

_TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased UTF-8: letters a-z and the bytes of all characters beyond ASCII
_COUNTS = "lang string, source string, term string, n long, docs long"
_COLUMN = "lang string, block long, s int, length long, ends binary, counts binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tf: dict[tuple[str, str], Counter] = {}
    df: dict[tuple[str, str], Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in tf.items():
            terms, n = [None, *counts], [0, *counts.values()]
            docs = [0, *map(df[lang, source].__getitem__, counts)]
            columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
            yield from pa.Table.from_arrays(columns, names=["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=20_000)
        tf.clear()
        df.clear()

    for batch in batches:
        where = cuts(pc.binary_length(batch.column(2)).to_numpy()) if batch.num_rows else []
        for a, b in zip(where, where[1:]):
            langs, sources, texts = batch.slice(a, b - a).columns
            for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts.cast(pa.binary()).to_pylist()):
                if (lang, source) not in tf:
                    tf[lang, source], df[lang, source] = Counter(), Counter()
                words = _TERM.findall(text.lower())
                tf[lang, source].update(words)
                df[lang, source].update(set(words))
            if sum(map(len, tf.values())) > HELD_TERMS:
                yield from rows()
    yield from rows()
    pa.default_memory_pool().release_unused()  # the worker lives on


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it), and a row with a null term for each group.

    Nulls in any of the three columns are ''. Each row is a document, repeated rows too; other columns are not read. A
    task adds up what it has before anything is shuffled."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    return own.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def vocabulary(counts: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Of ``term_counts``: kept terms (lang, term, total, cells: array of (s, n), by s) and groups (lang, source, s:
    number of the source in its language, total, v: kept terms of the language, lang_total). A term has at most as many
    cells as its language has sources. Both are written tables."""
    counts = written(counts, "term-counts")
    order = Window.partitionBy("lang").orderBy("source")
    groups = written(counts.filter("term IS NULL").select("lang", "source", (F.row_number().over(order) - 1).alias("s")), "sources")
    cells = counts.filter("term IS NOT NULL").join(_small(groups), ["lang", "source"])
    terms = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("s", "n"))).alias("cells"))
    terms = written(terms.filter(F.col("docs") >= least_docs).drop("docs"), "terms")
    totals = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.s").alias("s")).agg(F.sum("c.n").alias("total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = groups.join(totals, ["lang", "s"], "left").join(langs, "lang", "left").select("lang", "source", "s", zero("total"), zero("v"), zero("lang_total"))
    return terms, written(groups, "groups")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length columns of the sources that occur in a block: of classes (lang, cells, k: terms) in order, those of
    one language in one batch. A run is its end and its count; zeros are runs too."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        langs = batch.column(0).to_pylist()
        edges = [0, *(k for k in range(1, len(langs)) if langs[k] != langs[k - 1]), len(langs)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            cells, k = batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a).to_numpy()
            ends = np.cumsum(k)
            row = np.repeat(np.arange(b - a), np.diff(cells.offsets.to_numpy()))
            s, n = (x.to_numpy() for x in cells.flatten().flatten())
            order = np.argsort(s, kind="stable")
            s, n, row = s[order], n[order], row[order]
            out: list[tuple] = []
            for first, last in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate(([0], np.flatnonzero(np.diff(s)) + 1, [len(s)])))):
                stop = ends[row[first:last]]
                start = stop - k[row[first:last]]
                bounds = np.empty(2 * len(stop) + 1, np.int64)  # a gap of zeros (perhaps empty) before each cell, and the rest
                values = np.zeros(2 * len(stop) + 1, np.int64)
                bounds[0:-1:2], bounds[1::2], bounds[-1] = start, stop, ends[-1]
                values[1::2] = n[first:last]
                filled = np.diff(bounds, prepend=0) > 0
                bounds, values = bounds[filled], values[filled]
                runs = np.append(values[1:] != values[:-1], True)
                out.append((int(s[first]), bounds[runs].astype("<i8").tobytes(), values[runs].astype("<i8").tobytes()))
            if out:
                m = len(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[a]] * m), pa.array([block] * m, pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([int(ends[-1])] * m, pa.int64()), pa.array([x[1] for x in out]), pa.array([x[2] for x in out])],
                    names=["lang", "block", "s", "length", "ends", "counts"],
                )
            block += 1


def columns(terms: DataFrame) -> DataFrame:
    """lang, block, s, length, ends, counts: the run-length columns of the sources in each block of the vocabulary, in
    the order of the terms' counts by source. A written table."""
    classes = terms.groupBy("lang", "cells").agg(F.count("*").alias("k"))
    return written(classes.repartitionByRange("lang", "cells").sortWithinPartitions("lang", "cells").mapInArrow(_encode, _COLUMN), "columns")


def probabilities(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + v)), exact for counts of any size."""
    if len(counts) and int(counts.max()) + 1 > (2**63 - 1) // UNIT:
        return np.array([1 + UNIT * (int(n) + 1) // (total + v) for n in counts], dtype=np.int64)
    return 1 + UNIT * (counts + 1) // (total + v)


def intersected(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Summed divergence of a from b and of b from a, for columns of runs (ends, probabilities) over the same terms."""
    ends = np.union1d(a[0], b[0])
    lengths = np.diff(ends, prepend=0)
    p, q = a[1][np.searchsorted(a[0], ends)], b[1][np.searchsorted(b[0], ends)]
    square = (p - q) ** 2
    return int((square // q * lengths).sum()), int((square // p * lengths).sum())


def _meet(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    made = []
    for r in rows:
        ends = np.array([r["length"]]) if r["ends"] is None else np.frombuffer(r["ends"], "<i8")
        counts = np.zeros(1, np.int64) if r["counts"] is None else np.frombuffer(r["counts"], "<i8")
        made.append((ends, probabilities(counts, r["total"], r["v"])))
    langs, a, b, values = [], [], [], []
    low, high = rows[0]["low"], rows[0]["high"]
    mine, others = ([k for k, r in enumerate(rows) if r["s"] // TILE == t] for t in (low, high))
    for x in mine:
        for y in others:
            if rows[x]["s"] < rows[y]["s"]:
                there, back = intersected(made[x], made[y])
                langs += [rows[0]["lang"]] * 2
                a += [rows[x]["s"], rows[y]["s"]]
                b += [rows[y]["s"], rows[x]["s"]]
                values += [there, back]
    return pa.table({"lang": pa.array(langs, pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "value": pa.array(values, pa.int64())})


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (numbers of two sources), value: the divergence of a from b, summed over all kept terms.

    The columns of a block meet in tiles of ``TILE`` sources, so a task holds at most two tiles of one block. A source
    that a block lacks has one run of zeros there."""
    cols = columns(terms)
    blocks = cols.groupBy("lang", "block").agg(F.max("length").alias("length"))
    tiles = groups.withColumn("tiles", F.ceil(F.count("*").over(Window.partitionBy("lang")) / TILE).cast("int"))
    every = blocks.join(_small(tiles.select("lang", "s", "total", "v", "tiles")), "lang").join(cols.drop("length"), ["lang", "block", "s"], "left")
    tile = (F.col("s") / TILE).cast("int")
    dealt = every.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumn("low", F.least("_t", tile)).withColumn("high", F.greatest("_t", tile)).drop("_t", "tiles")
    sums = dealt.groupBy("lang", "block", "low", "high").applyInArrow(_meet, "lang string, a int, b int, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _p(total: str) -> Column:
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST(n + 1 AS DECIMAL(20,0))) DIV CAST({total} + v AS DECIMAL(20,0))")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank for every (language, source) group of ``docs``.

    Part ``pair``: every other source of the language and the group's divergence from it, all ranks (value descending,
    item ascending). Part ``term``: the ``top_terms`` terms that the group uses more than its language does, by their
    share of its divergence from the language. Terms are those in at least ``least_docs`` rows of the language. Null
    text, language and source are ''; a group without terms diverges by what it would expect; in a language without
    kept terms all pairs have 0. Empty tables give no row. Repeated rows are documents of their own. Other columns are
    not read.
    """
    terms, groups = vocabulary(term_counts(docs, lang_col, source_col, text_col), least_docs)
    each = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    a, b = groups.select("lang", F.col("s").alias("a"), "source"), groups.select("lang", F.col("s").alias("b"), F.col("source").alias("item"))
    pairs = a.join(b, "lang").filter("a != b").join(pair_values(terms, groups), ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")).withColumn("rank", F.row_number().over(each))
    cells = terms.select("lang", F.col("term").alias("item"), F.col("total").alias("in_lang"), F.inline("cells")).join(_small(groups), ["lang", "s"])
    q = F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST(in_lang + 1 AS DECIMAL(20,0))) DIV CAST(lang_total + v AS DECIMAL(20,0))")
    over = cells.select("lang", "source", F.lit("term").alias("part"), "item", _p("total").alias("p"), q.alias("q")).filter("p > q")
    over = over.select("lang", "source", "part", "item", F.expr("((p - q) * (p - q)) DIV q").alias("value")).withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(over)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents``."""
    return divergence(spread(table(spark, sf_dir, "documents").select("text", "lang", "source")))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
t AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(t.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
p AS (SELECT c.*, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM c JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
