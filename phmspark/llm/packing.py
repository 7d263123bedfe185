"""Best-fit packing by exact-complement hashing.

Which pieces there are matters to the plan only through their lengths, of which there are at most ``capacity``. So one
job tokenizes and counts lengths, the plan is made from that bounded histogram, and every piece finds its place from its
rank among the pieces of its length: nothing but the histogram and the plan passes through the driver.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phmspark.llm.batches import cuts
from phmspark.llm.common import spread, table, written

_BETWEEN_WORDS = re.compile(r"(?<!\s) (?!\s)")
_SPACES = re.compile(r"\s\s")


# Fixed value: how a byte-level pre-tokenizer cuts text.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _merger(tokenizer):
    """The tokenizer's own vocabulary, in the order of its merges, in a library that merges new words five times as fast."""
    import tiktoken

    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): k for token, k in tokenizer.get_vocab(with_added_tokens=True).items() if token not in added}
    return tiktoken.Encoding("vocabulary", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class WordIds:
    """Token ids (little-endian uint32 bytes), as ``tokenizers`` gives them, of texts by a byte-level BPE.

    Its pre-tokenizer always begins a token at a space between two other characters, so a text's ids are those of its
    space-led words in a row. Words are looked up among those last seen (two generations of up to ``max_words``); new
    ones are merged together from the tokenizer's vocabulary. The first new words of every instance are held against
    ``tokenizers`` itself, which does all the work if there is any difference, and any word with an added token.
    """

    def __init__(self, path: str, max_words: int = 120_000, checked: int = 2000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.led = np.array([(self.tokenizer.id_to_token(k) or "").startswith("Ġ") for k in range(self.tokenizer.get_vocab_size())])
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merger, self.to_check = _merger(self.tokenizer), checked
        self.max_words, self.words, self.old = max_words, {}, {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        easy = [w for w in new if w and " " not in w and not any(x in w for x in self.added)] if self.merger else []
        ids = np.array(self.merger.encode_ordinary(" " + " ".join(easy)), dtype="<u4") if easy else np.empty(0, "<u4")
        starts = np.flatnonzero(self.led[ids])
        if easy and len(starts) == len(easy):
            raw, ends = ids.tobytes(), [*(starts[1:] * 4).tolist(), 4 * len(ids)]
            made = {w: raw[a:b] for w, a, b in zip(easy, (starts * 4).tolist(), ends, strict=True)}
            if self.to_check > 0:
                self.to_check -= len(easy)
                if any(self.plain(" " + w) != made[w] for w in easy[:2000]):
                    self.merger, made = None, {}
            self.words.update(made)
        for w in new:
            if w not in self.words:
                self.words[w] = self.plain(" " + w)

    def of(self, texts: list[str]) -> list[bytes]:
        split = [_BETWEEN_WORDS.split(t) if _SPACES.search(t) else t.split(" ") for t in texts]
        if len(self.words) > self.max_words:
            self.words, self.old = {}, self.words
        new = set().union(*(x[1:] for x in split)).difference(self.words) if split else set()
        again = new.intersection(self.old)
        self.words.update((w, self.old[w]) for w in again)
        self.learn(sorted(new - again))
        return [(self.plain(x[0]) if x[0] else b"") + b"".join(map(self.words.__getitem__, x[1:])) for x in split]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: _id, piece, start, length, ids_crc32, part and nth (number among the part's
    pieces of this length), and ids where asked for. A document's ids end with ``end_id``; only documents longer than
    ``capacity`` are cut, and their first piece takes the remainder."""
    fields = [("_id", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    out = "_id string, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, seen = WordIds(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            where = cuts(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), 1_000_000) if batch.num_rows else []
            for a, b in zip(where, where[1:]):
                rows = []
                docs_, texts = (batch.column(c).slice(a, b - a).to_pylist() for c in range(2))
                for doc, raw in zip(docs_, ids.of([t or "" for t in texts]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    first = n % capacity or capacity
                    for k, start in enumerate([0, *range(first, n, capacity)]):
                        length = first if k == 0 else capacity
                        piece = raw[4 * start : 4 * (start + length)]
                        rows.append((doc, k, start, length, zlib.crc32(piece), part, seen[length]) + ((np.frombuffer(piece, dtype="<u4").astype(np.int32),) if with_ids else ()))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])
        pa.default_memory_pool().release_unused()  # the worker lives on

    return docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, out)


class Sums:
    """Index of the sums of one, two and three lengths under the counts that are left.

    For every sum it keeps the place of the first pair, as equal as can be, and of the first triple, by its least length
    from the largest, that the counts still allow. Counts only fall, so places only move on."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pairs = [total // 2 for total in range(len(left))]  # the lesser length of the first pair
        self.triples = [total // 3 for total in range(len(left))]  # the least length of the first triple

    def _pair(self, total: int, free: np.ndarray) -> list[int]:
        left, moving = self.left, True
        for a in range(self.pairs[total], 0, -1):
            b = total - a
            if left[a] > (a == b) and left[b] > 0:
                moving = False
                if free[a] > (a == b) and free[b] > 0:
                    return [b, a]
            elif moving:
                self.pairs[total] = a - 1
        return []

    def _triple(self, total: int, free: np.ndarray) -> list[int]:
        moving = True
        for c in range(self.triples[total], 0, -1):
            if self.left[c] > 0 and self.pairs[total - c] > 0:
                moving = False
                if free[c] > 0:
                    free[c] -= 1
                    pair = self._pair(total - c, free)
                    free[c] += 1
                    if pair:
                        return [*pair, c]
            elif moving:
                self.triples[total] = c - 1
        return []

    def exact(self, total: int, free: np.ndarray) -> list[int]:
        """One, two or three lengths with this sum that are still free (``free``: left but for the sequence at hand)."""
        return [total] if free[total] > 0 else self._pair(total, free) or self._triple(total, free)


class Plan:
    """How often which lengths share a sequence, from the number of pieces of each length."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.sums = Sums(self.left)
        self.runs: list[tuple[list[int], int]] = []
        for length in range(capacity, 0, -1):
            while self.left[length] > 0:
                self._add(length)

    def _add(self, length: int) -> None:
        free, lengths, gap = self.left.copy(), [length], self.capacity - length
        free[length] -= 1
        while gap:
            there = np.flatnonzero(free[1 : gap + 1] > 0) + 1
            if not len(there):
                break
            largest = int(there[-1])
            fill = self.sums.exact(gap, free) if gap <= 3 * largest else []
            for x in fill or [largest]:
                lengths.append(x)
                free[x] -= 1
                gap -= x
        used, n = np.unique(lengths, return_counts=True)
        times = int((self.left[used] // n).min())
        self.left[used] -= n * times
        self.runs.append((lengths, times))

    def slots(self) -> dict[str, np.ndarray]:
        """For each place in each run: length, rank of the first piece there, first sequence, offset."""
        rank, sequence, rows = np.zeros(self.capacity + 1, dtype=np.int64), 0, []
        for lengths, times in self.runs:
            offset = 0
            for x in lengths:
                rows.append((x, rank[x], sequence, offset))
                rank[x] += times
                offset += x
            sequence += times
        rows.sort()
        return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 4).T, strict=True))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32, sequence_id, offset (and ids where asked for) per piece.

    A null or empty text is the end token alone. Repeated rows and null ids are packed like any others; other columns
    are not read; an empty table gives no rows. Pieces are written once; a piece's rank in its length is its number in
    its part plus the counts of the parts before, so a length that a third of all pieces have gathers nowhere. The plan
    has a bounded number of runs (each run uses up a length), and is broadcast as four arrays.
    """
    pieces = written(tokenize(docs, tokenizer_path, capacity, 0, id_col, text_col, with_ids), "pieces")
    by_part = pieces.groupBy("length", "part").count()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    shared = docs.sparkSession.sparkContext.broadcast(Plan(counts, capacity).slots())
    before = by_part.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")
    extra = ", ids array<int>" if with_ids else ""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = shared.value
        keys = (slots["length"] << 48) + slots["rank"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            k = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            yield batch.drop(columns="rank").assign(sequence_id=slots["sequence"][k] + rank - slots["rank"][k], offset=slots["offset"][k])

    out = f"_id string, length long, piece int, start long, ids_crc32 long{extra}, sequence_id long, offset long"
    placed = ranked.mapInPandas(place, out)
    return placed.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), *(c for c in placed.columns if c != "_id"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of its pieces in a row, of ``pack(..., with_ids=True)``; a sequence has at most ``capacity`` ids."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences."""
    import public_tokenizers

    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"))
