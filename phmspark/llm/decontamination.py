"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of ASCII letters (lower-cased A-Z), digits and non-ASCII characters. Each window of ``n`` consecutive
words of a benchmark item is a pattern over word numbers; the automaton reads a document's word numbers once. Words that
no item has are 0, which is in no pattern.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phmspark.llm.batches import with_text_columns
from phmspark.llm.common import bounded_collect, spread, table, written

# Of UTF-8 bytes: A-Z to a-z, other ASCII that is not a word character to a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD_BYTE = np.array([c != 32 for c in _NORMAL])

NEW = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>"


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(item: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    """All runs of ``n`` words; the whole item if it has fewer, nothing if it has none."""
    return [tuple(item[k : k + n]) for k in range(max(1, len(item) - n + 1))] if item else []


def build(items: list[tuple[str, str | None]], n: int):
    """(word numbers, automaton or None, lengths of windows, items of windows)"""
    import ahocorasick

    number: dict[bytes, int] = {}
    pattern: dict[tuple[int, ...], int] = {}
    owners: list[set[str]] = []
    for item_id, text in items:
        for w in windows(words(text), n):
            ids = tuple(number.setdefault(x, len(number) + 1) for x in w)
            k = pattern.setdefault(ids, len(pattern))
            if k == len(owners):
                owners.append(set())
            owners[k].add(item_id)
    if not pattern:
        return number, None, [], owners
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for ids, k in pattern.items():
        automaton.add_word(ids, k)
    automaton.make_automaton()
    return number, automaton, [len(ids) for ids in pattern], owners


_built: dict[str, tuple] = {}  # of this worker: the automaton last built


def _kept(key: str, items: list[tuple[str, str | None]], n: int) -> tuple:
    """The automaton of these items; a worker builds it once for all of its tasks."""
    if key not in _built:
        _built.clear()
        _built[key] = build(items, n)
    return _built[key]


def in_parts(items: DataFrame, n: int, most_chars: int) -> DataFrame:
    """Rows (item, text); the text of a very long item in several rows, which have all of its windows between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = [] if len(text) <= most_chars else words(text)
                step = max(n, len(ws) * most_chars // max(1, len(text)))
                for some in [ws[k : k + step + n - 1] for k in range(0, max(1, len(ws) - n + 1), step)]:
                    names.append(item)
                    parts.append(b" ".join(some).decode("utf-8", "surrogatepass") if ws else text)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string())], names=["item", "text"])

    return items.mapInArrow(run, "item string, text string")


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in ``text`` of runs (first, last + 1) of words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_NORMAL), dtype=np.uint8)
    inside = np.concatenate(([False], raw != 32, [False]))
    edge = np.diff(inside.astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(chars[begin[a]]), "end": int(chars[end[b - 1]])} for a, b in runs]


def scan(text: str | None, number, automaton, lengths, owners) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, runs (first, last + 1) of hit words, items with occurring windows."""
    ws = words(text)
    if automaton is None or not ws:
        return len(ws), [], []
    ids = tuple([number.get(w, 0) for w in ws])
    runs: list[tuple[int, int]] = []
    found: set[int] = set()
    for last, k in automaton.iter(ids):
        found.add(k)
        first = last - lengths[k] + 1
        while runs and runs[-1][1] >= first:  # windows end in order, but a longer one may begin before earlier runs
            first = min(first, runs.pop()[0])
        runs.append((first, last + 1))
    return len(ws), runs, sorted(set().union(*(owners[k] for k in found)))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, max_items_chars: int = 2_000_000, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (ids as strings, sorted) and spans (character offsets, sorted).

    The items' size is checked by an aggregate before they are gathered. Up to ``max_items_chars`` characters (about 300
    MB of automaton) they make one automaton, which each worker builds once. Beyond that they are dealt by hash into
    slices of about that size, very long items in parts that overlap by a window; the texts are scanned once for each
    slice, with a written table between, and hits are united. Null or empty texts and
    items have no words; items without an id are one item of the empty id. Repeated rows each keep a row; columns named as the new ones are replaced.
    """
    items = items.filter(F.col(item_text_col).isNotNull()).select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows")).first()
    slices = max(1, -(-(size["chars"] or 0) // max_items_chars))
    out = docs
    if slices > 1:
        items = written(in_parts(items, n, max(1, max_items_chars // 8)), "items")
        size = items.agg(F.count("*").alias("rows")).first()
    for s in range(slices):
        some = items if slices == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == s)
        shared = docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in bounded_collect(some, max(1, size["rows"]))])

        def make(shared=shared, key=uuid.uuid4().hex):
            model = _kept(key, shared.value, n)

            def run(texts: list[str | None]) -> dict[str, list]:
                found = [scan(t, *model) for t in texts]
                made = {"n_words": [x[0] for x in found], "items": [x[2] for x in found], "spans": [original_spans(t, x[1]) if x[1] else [] for t, x in zip(texts, found, strict=True)]}
                if slices > 1:
                    return {f"{k}_{s}": v for k, v in made.items()} | {f"runs_{s}": [[{"first": a, "last": b - 1} for a, b in x[1]] for x in found]}
                return made | {"n_hit": [sum(b - a for a, b in x[1]) for x in found], "n_items": [len(x[2]) for x in found]}

            return run

        if slices == 1:
            return with_text_columns(docs, text_col, make, NEW)
        out = written(with_text_columns(out, text_col, make, f"n_words_{s} long, items_{s} array<string>, spans_{s} array<struct<start:long,end:long>>, runs_{s} array<struct<first:long,last:long>>"), "decontamination")
    every = lambda c: F.concat(*(F.col(f"{c}_{s}") for s in range(slices)))
    hit = F.array_distinct(F.flatten(F.transform(every("runs"), lambda r: F.sequence(r["first"], r["last"]))))
    united = {"n_words": F.col("n_words_0"), "n_hit": F.size(hit).cast("long"), "items": F.array_sort(F.array_distinct(every("items"))), "spans": F.array_sort(F.array_distinct(every("spans")))}
    out = out.withColumns(united).withColumn("n_items", F.size("items").cast("long"))
    return out.drop(*(f"{c}_{s}" for c in ("n_words", "items", "spans", "runs") for s in range(slices)))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items; odd rows as said at ``decontaminate``."""
    found = decontaminate(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def contaminated():
    """The contract's rule: at least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


OP8_SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
item AS (
  SELECT item_id, ws, len(ws) AS n FROM (
    SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, letters WHERE text IS NOT NULL)),
win AS (
  SELECT DISTINCT item_id, len(w) AS k, array_to_string(w, ' ') AS w FROM (
    SELECT item_id, ws[i : i + 12] AS w FROM (SELECT item_id, ws, n, unnest(range(1, greatest(1, n - 12) + 1)) AS i FROM item WHERE n > 0))),
doc AS (
  SELECT doc_id, ws, len(ws) AS n FROM (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents, letters)),
place AS (
  SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, k, unnest(range(1, n - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE n >= k)),
hit AS (SELECT DISTINCT doc_id, i, k, item_id FROM place JOIN win USING (w, k)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN its USING (doc_id)
"""
