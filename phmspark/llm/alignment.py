"""Alignment of two tokenizers over a corpus, by the bytes at which their tokens end.

For each text both id lists are laid over the same bytes. A dictionary from cumulative end to index is made of each list;
the ends that both have, in order, slice the lists into groups, and the links of a group are all pairs of its ids.

A space between two other characters begins a token of both tokenizers, so a text's ids are those of its space-led words
in a row, and words are encoded once while a task remembers them. The texts of a batch are aligned one behind the other.

Counts of linked id pairs are added up over all documents. The most frequent pairs, a bounded number, travel to the tasks;
the documents' other links meet their counts over a shuffle, in which no key is frequent.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phmspark.llm.batches import cuts
from phmspark.llm.common import spread, table, written
from phmspark.llm.packing import _SPACES, WordIds, _byte_of

TOP_PAIRS = 1_000_000  # id pairs whose counts every task holds, most frequent first: 16 bytes each
_SPACE = "▁"  # stands for the space in pieces
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
LONG_GROUP = 4096  # links of a group that are expanded one by one
HELD_CODES = 1_000_000  # link codes that a task counts at once


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side end at or before each cumulative end that both sides have, in order."""
    at_a, at_b = (dict(zip(x.tolist(), range(1, len(x) + 1))) for x in (a, b))
    both = sorted(at_a.keys() & at_b.keys())
    return np.array([at_a[x] for x in both], dtype=np.int64), np.array([at_b[x] for x in both], dtype=np.int64)


def link_codes(a: list[int], b: list[int], width: int) -> dict[int, int]:
    """a * width + b -> how many links of the pair a group holds: copies of an id are multiplied, not paired."""
    some = Counter(b).items()
    return {x * width + y: n * m for x, n in Counter(a).items() for y, m in some}


@dataclass
class Aligned:
    """What a batch of texts gives."""

    sums: np.ndarray  # texts x (n_a, n_b, n_groups, n_links)
    groups: list[str]
    at: np.ndarray  # where each text's codes begin, and the last end
    codes: np.ndarray
    times: np.ndarray


class Aligner:
    """Aligns texts under a byte-level BPE file (A, of a space and the text) and a piece model (B, which adds the space).

    If no piece has a space behind another character, no token of either side crosses a space between two other
    characters, and a text gives what its words give, one behind the other. A word gives its codes, its groups' text and
    its numbers; what was met last is remembered (two generations of up to ``max_words``), and new words are aligned
    together. Otherwise, or if some of the first texts say otherwise, texts are aligned as a whole."""

    def __init__(self, path_a: str, path_b: str, max_words: int = 160_000, checked: int = 20):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = WordIds(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        tokenizer, byte = self.a.tokenizer, _byte_of()
        tokenizer.encode_special_tokens = True  # their strings are ordinary text
        added = tokenizer.get_added_tokens_decoder()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_a = [added[k].content.encode() if k in added else bytes(byte[c] for c in tokenizer.id_to_token(k) or "") for k in range(tokenizer.get_vocab_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(_SPACE, " ").encode() for p in pieces]
        self.length_a, self.length_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.width, self.to_check = len(pieces), checked
        if len(self.bytes_a) * self.width > 1 << 32:
            raise ValueError("the product of the vocabularies' sizes must be at most 2^32")
        self.by_word = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        # Ids as they stand in a group's text: followed by a comma, or by the end of their side
        self.shown = [f"{k}{c}" for k in range(len(self.bytes_a)) for c in ",|"] + [f"{k}{c}" for k in range(self.width) for c in ",;"]
        self.max_words = max_words
        self.words: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def ids(self, words: list[str]) -> tuple[list[bytes], list[list[int]]]:
        """Ids of both sides of words or texts, each as a whole."""
        self.a.learn(words)
        a = list(map(self.a.words.__getitem__, words))
        self.a.words.clear()
        return a, self.b.encode(words, num_threads=1)

    def made(self, words: list[str]) -> list[tuple | None]:
        """For each word or text (none empty): codes (uint32) and times (None: once each) as bytes, the groups' text, and
        n_a, n_b, n_groups, n_links as bytes; None if the bytes of its ids are others."""
        out: list[tuple | None] = [None] * len(words)
        raw_a, list_b = self.ids(words)
        sizes_a, sizes_b = np.array(list(map(len, raw_a)), dtype=np.int64) // 4, np.array(list(map(len, list_b)), dtype=np.int64)
        a, b = np.frombuffer(b"".join(raw_a), "<u4").astype(np.int64), np.fromiter(chain.from_iterable(list_b), np.int64, int(sizes_b.sum()))
        want = [b" " + w.encode() for w in words]
        bytes_a, bytes_b = b"".join(map(self.bytes_a.__getitem__, a.tolist())), b"".join(map(self.bytes_b.__getitem__, b.tolist()))
        upto = np.cumsum(list(map(len, want)), dtype=np.int64)
        upto_a, upto_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        last = lambda ends, at: np.concatenate(([0], ends))[at]
        whole = b"".join(want)
        if bytes_a != whole or bytes_b != whole or (last(ends_a, upto_a) != upto).any() or (last(ends_b, upto_b) != upto).any():
            if len(words) == 1:
                return out
            half = len(words) // 2  # what does not come back is found by halves
            return self.made(words[:half]) + self.made(words[half:])
        # All stand one behind the other: their ends are common ends, so no group goes over them
        end_a, end_b = common_ends(ends_a, ends_b)
        m, n = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        start_a, start_b, links = end_a - m, end_b - n, m * n
        first = np.concatenate(([0], np.searchsorted(end_a, upto_a, side="right")))  # group of each word, and the end
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[end_a - 1], last_b[end_b - 1] = 1, 1
        order[np.arange(len(a)) + np.repeat(start_b, m)] = 2 * a + last_a
        order[np.arange(len(b)) + np.repeat(end_a, n)] = 2 * (len(self.bytes_a) + b) + last_b
        shown = list(map(self.shown.__getitem__, order.tolist()))
        # Links: all pairs of a group, one by one; a long group's are counted
        each = np.where(links <= LONG_GROUP, links, 0)
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        per = np.repeat(n, each)
        codes = (a[np.repeat(start_a, each) + place // per] * self.width + b[np.repeat(start_b, each) + place % per]).astype("<u4").tobytes()
        at = (4 * np.concatenate(([0], np.cumsum(each)))[first]).tolist()
        numbers = np.stack((sizes_a, sizes_b, np.diff(first), np.diff(np.concatenate(([0], np.cumsum(links)))[first])), axis=1).astype("<i8").tobytes()
        shown_at = np.concatenate(([0], upto_a + upto_b)).tolist()
        out = [(codes[at[k] : at[k + 1]], None, "".join(shown[shown_at[k] : shown_at[k + 1]]), numbers[32 * k : 32 * k + 32]) for k in range(len(words))]
        for g in np.flatnonzero(links > LONG_GROUP).tolist():
            k = int(np.searchsorted(first, g, side="right")) - 1
            found = link_codes(a[start_a[g] : end_a[g]].tolist(), b[start_b[g] : end_b[g]].tolist(), self.width)
            codes_, times, text, numbers_ = out[k]
            times = np.ones(len(codes_) // 4, "<i8").tobytes() if times is None else times
            out[k] = codes_ + np.fromiter(found.keys(), "<u4", len(found)).tobytes(), times + np.fromiter(found.values(), "<i8", len(found)).tobytes(), text, numbers_
        return out

    def _split(self, text: str) -> list[str]:
        if not self.by_word:
            return [text]
        if text[0].isspace() or text[-1].isspace() or _SPACES.search(text):
            return _BETWEEN.split(text)
        return text.split(" ")

    def of(self, texts: list[str]) -> Aligned:
        """Texts that are empty, or whose bytes do not come back, give zeros and no groups."""
        full = [k for k, t in enumerate(texts) if t]
        if self.by_word and self.to_check > 0 and full:
            some = [texts[k] for k in full[: self.to_check]]
            self.to_check -= len(some)
            whole, parts = self.made(some), [self._made_of(self._split(t), self.made(self._split(t))) for t in some]
            if any((x is None) != (y is None) or x is not None and x[2] != y[2] for x, y in zip(whole, parts, strict=True)):
                self.by_word, self.words, self.old = False, {}, {}
        split = [self._split(texts[k]) for k in full]
        if len(self.words) > self.max_words or not self.by_word:
            self.words, self.old = {}, self.words if self.by_word else {}
        new = set().union(*split).difference(self.words)
        again = new.intersection(self.old)
        self.words.update((w, self.old[w]) for w in again)
        fresh = sorted(new - again)
        for k in range(0, len(fresh), 4000):  # dictionaries of a few thousand words stay near
            self.words.update(zip(fresh[k : k + 4000], self.made(fresh[k : k + 4000]), strict=True))
        rows, found = [], []
        for k, words in zip(full, split, strict=True):
            one = self._made_of(words, list(map(self.words.__getitem__, words)))
            if one is not None:
                rows.append(k)
                found.append(one)
        groups, sums = [""] * len(texts), np.zeros((len(texts), 4), np.int64)
        keys, times = [], []
        for k, (codes, counts, text, numbers) in zip(rows, found, strict=True):
            groups[k] = text[:-1]
            sums[k] = np.frombuffer(numbers, "<i8").reshape(-1, 4).sum(axis=0)
            code = np.frombuffer(codes, "<u4")
            keys.append(code.astype(np.int64) + (k << 32))
            times.append(None if counts is None else np.frombuffer(counts, "<i8"))
        key = np.concatenate([np.empty(0, np.int64), *keys])
        if all(t is None for t in times):
            key, count = np.unique(key, return_counts=True)
        else:
            key, where = np.unique(key, return_inverse=True)
            count = np.zeros(len(key), np.int64)
            np.add.at(count, where, np.concatenate([np.ones(len(x), np.int64) if t is None else t for x, t in zip(keys, times, strict=True)]))
        at = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) << 32)
        return Aligned(sums, groups, at, (key & 0xFFFFFFFF).astype(np.uint32), count)

    @staticmethod
    def _made_of(words: list[str], made: list[tuple | None]) -> tuple | None:
        """What a text's words give, one behind the other."""
        if None in made:
            return None
        codes, times, texts, numbers = zip(*made)
        counts = None
        if any(times):
            counts = b"".join(np.ones(len(c) // 4, "<i8").tobytes() if t is None else t for c, t in zip(codes, times, strict=True))
        return b"".join(codes), counts, "".join(texts), b"".join(numbers)


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<long>"


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """_uid (of the row), ``id_col``, n_a, n_b, n_groups, n_links, groups_sha256, codes (linked id pairs, a * size of B's
    vocabulary + b as unsigned 32-bit numbers, each once), times (links of each) and, where asked for, groups
    (``a1,a2|b1;a3|b2,b3``: ids in order)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"_uid long, `{id_col}` {id_type}, {_ALIGNED}" + (", groups string" if with_groups else "")
    names = ["_uid", id_col, *(c.split()[0] for c in _ALIGNED.split(", ")), *(["groups"] * with_groups)]
    own = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            where = cuts(pc.binary_length(batch.column(2)).to_numpy(), 1_000_000) if batch.num_rows else []
            for x, y in zip(where, where[1:]):
                some = batch.slice(x, y - x)
                found = aligner.of(some.column(2).to_pylist())
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups]
                lists = [pa.ListArray.from_arrays(pa.array(found.at, pa.int32()), pa.array(v)) for v in (found.codes.view(np.int32), found.times)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *map(pa.array, found.sums.T), pa.array(digests), *lists, *([pa.array(found.groups)] * with_groups)], names=names)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return own.mapInArrow(run, schema)


def _count_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def rows():
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

    for batch in batches:
        held.append(batch.column(0).flatten().to_numpy())
        size += len(held[-1])
        if size > HELD_CODES:
            yield rows()
            size = 0
    if size:
        yield rows()


def _links(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows whose columns from ``at`` are codes and times, some at a time, and for each code its row, itself and its times."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column(at)).to_numpy()
        where = cuts(lengths, HELD_CODES // 2) if batch.num_rows else []
        for x, y in zip(where, where[1:]):
            some = batch.slice(x, y - x)
            yield some, np.repeat(np.arange(y - x), lengths[x:y]), some.column(at).flatten().to_numpy(), some.column(at + 1).flatten().to_numpy()


def _found(codes: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``mine`` among sorted ``codes``, and which are there."""
    if not len(codes):
        return np.zeros(len(mine), np.int64), np.zeros(len(mine), dtype=bool)
    at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
    return at, codes[at] == mine


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """code, n (documents in which the id pair is linked), best (no pair of its A id has more). A written table."""
    counts = written(found.select("codes").mapInArrow(_count_codes, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.expr(f"(CAST(code AS LONG) & 4294967295L) DIV {width}")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return written(counts.withColumn("a", a).join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", top_pairs: int = TOP_PAIRS) -> DataFrame:
    """``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of ``docs``.

    A is a byte-level BPE file and reads a space and the text; B is a piece model and reads the text, to which it adds
    the space; special strings are plain text. Texts that are null, empty, or whose bytes do not come back have zeros
    and ''. A pair's count is the number of rows that hold it linked, repeated rows too; n_best counts the links whose
    pair has the highest count of its A id, ties included; count_sum adds up the counts over all links. Null and repeated
    ids each keep a row; other columns are not read.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    found = written(aligned(docs, path_a, path_b, id_col, text_col), "aligned")
    pairs = pair_counts(found, width)
    # Of pairs by the power of two of their counts, as many whole powers as the bound allows
    level = F.floor(F.log2("n")).cast("int")
    room, least = top_pairs, 63
    for r in sorted(pairs.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 63 rows
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    rest = pairs.filter(level < least)
    top = pairs.filter(level >= least).toArrow().combine_chunks()
    codes = top.column("code").to_numpy()
    order = np.argsort(codes)
    held = docs.sparkSession.sparkContext.broadcast((codes[order], top.column("n").to_numpy()[order], top.column("best").to_numpy()[order]))
    names = [c for c in found.columns if c not in ("codes", "times")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name in names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, mine, times in _links(batches, len(names)):
            at, known = _found(held.value[0], mine)
            row, times, at = row[known], times[known], at[known]
            n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, row, times * held.value[2][at])
            np.add.at(count_sum, row, times * held.value[1][at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n_best), pa.array(count_sum)], names=[*names, "n_best", "count_sum"])

    summed = found.select(*names, "codes", "times").mapInArrow(add, f"{schema}, n_best long, count_sum long")
    if rest.isEmpty():
        return summed.drop("_uid")

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, mine, times in _links(batches, 1):
            new = ~_found(held.value[0], mine)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new])), pa.array(mine[new]), pa.array(times[new])], names=["_uid", "code", "times"])

    met = found.select("_uid", "codes", "times").mapInArrow(unknown, "_uid long, code int, times long").join(rest, "code")
    more = met.groupBy("_uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    total = lambda c, extra: (F.col(c) + F.coalesce(extra, F.lit(0))).alias(c)
    return summed.join(more, "_uid", "left").select(*(n for n in names if n != "_uid"), total("n_best", "_best"), total("count_sum", "_sum"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents``."""
    import public_tokenizers as own

    found = align(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), own.path("byte_bpe_50k.json"), own.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
