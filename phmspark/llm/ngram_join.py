"""Exact Jaccard join of word-shingle sets by universe-partition pigeonhole.

Two sets of r <= s shingles have a Jaccard similarity of at least t only if they differ in at most
``(r + s) (1 - t) / (1 + t)`` shingles. Sizes are cut into bands. In each band the shingle universe is hashed into
segments; the part of a set in a segment is a segment subset, and its hash an index key. Some segments also index their
one-deletion neighbourhood (the subset without each of its shingles in turn): two sets that share no key of such a
segment differ in two shingles there, in any other segment in one. So a set indexes segments worth one more than it can
differ in, and linked sets have a key in common.

Allocation by cost: how many segments of a band get the neighbourhood (each costs as many rows as it has shingles and
saves another segment) is what makes expected index rows plus expected pairs the least; both are counted for every
choice on a bounded sample of sets (``sample`` sets, which decides on cost only). Each set indexes a few segments more
than it must, and then does without as many of its keys, those that most sets share.

Sets that meet in a key are held against two leads of it. What is in different components then meets pair by pair in
keys of few sets. In keys of many sets a finer partition takes over: every shingle is a segment, a set keeps its rarest,
and a pair is worth a look only if enough of both sets is left behind the shingle in which it meets. Sizes and parity
bitmaps (a lower bound of the difference) sort pairs out before they are verified on their whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phmspark.llm.batches import cuts
from phmspark.llm.bits import flagged
from phmspark.llm.common import spread, table, written
from phmspark.llm.components import connect

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_BLANK = bytes(c == 32 or 9 <= c <= 13 for c in range(256))
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # masks of the first k bytes of eight
_BLANK = re.compile(rb"[ \t-\r]")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
FEW = 16  # sets of a key that meet pair by pair
SAMPLE = 2000  # sets on which the cost of layouts is counted
PAIR_COST = 30  # index rows that cost as much as one candidate pair
PARITY_LONGS = 8
NO_ID = 1 << 62  # rows without an id stand under a number of their text from here on
_PIECE = 1_000_000  # bytes of texts that are split into words and made into sets at once, but for one long text


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; x is not changed."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x *= _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, and where they begin: eight bytes at a time, of all words at once."""
    n = len(text)
    blank = np.frombuffer(text.translate(_IS_BLANK), dtype=np.bool_)
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    eight = np.ndarray((n + 1,), dtype="<u8", buffer=text.translate(_LOWER) + bytes(8), strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64), 43)
    some = np.arange(len(starts))
    at = starts
    while len(some):
        part = eight[at] & _FIRST[np.minimum(left, 8)]
        h[some] = mix(h[some] * _A + part, 47)
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    return h, starts


class Shingles:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words of texts; of all words of a text that has fewer."""

    def __init__(self, width: int):
        self.width = width

    def _hashes(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, and how many each has."""
        hashes, counts, held, size = [], np.zeros(len(texts), dtype=np.int64), [], 0

        def flush():
            whole = b" ".join(piece for _, piece in held)
            h, starts = word_hashes(whole)
            ends = np.cumsum([len(piece) + 1 for _, piece in held])
            np.add.at(counts, [k for k, _ in held], np.diff(np.searchsorted(starts, ends), prepend=0))
            hashes.append(h)
            held.clear()

        for k, t in enumerate(texts):
            for piece in _pieces(t or b""):
                held.append((k, piece))
                size += len(piece)
                if size >= _PIECE:
                    flush()
                    size = 0
        if held:
            flush()
        return np.concatenate([np.empty(0, np.uint64), *hashes]), counts

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The sets of all texts one behind the other, and where each begins (and the last ends)."""
        h, counts = self._hashes(texts)
        w, starts = self.width, np.concatenate(([0], np.cumsum(counts)))
        run = np.zeros(max(0, len(h) - w + 1), dtype=np.uint64)
        for k in range(w):
            run *= _A
            run += h[k : k + len(run)]
        run = mix(run, w)
        sizes = np.where(counts >= w, counts - w + 1, np.minimum(counts, 1))
        at = np.concatenate(([0], np.cumsum(sizes)))
        first = np.repeat(starts[:-1] - at[:-1], sizes) + np.arange(at[-1])
        sets = run[np.minimum(first, max(0, len(run) - 1))] if len(run) else np.zeros(at[-1], dtype=np.uint64)
        for k in np.flatnonzero((counts > 0) & (counts < w)).tolist():
            few = np.zeros(1, dtype=np.uint64)
            for x in h[starts[k] : starts[k + 1]]:
                few = few * _A + x
            sets[at[k]] = mix(few, 100 + int(counts[k]))[0]
        for a, b in zip(at.tolist(), at[1:].tolist()):
            if b - a > 1:
                sets[a:b].sort()
        new = np.ones(len(sets), dtype=bool)
        new[1:] = sets[1:] != sets[:-1]
        new[at[:-1][sizes > 0]] = True
        return sets[new], np.concatenate(([0], np.cumsum(new)))[at]


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text, cut at blanks if it is very long."""
    a = 0
    while len(text) - a > _PIECE and (m := _BLANK.search(text, a + _PIECE)):
        yield text[a : m.start()]
        a = m.start()
    yield text[a:] if a else text


@dataclass(frozen=True)
class Layout:
    """How the sets of a size band are indexed."""

    band: int
    most: int  # shingles of its largest sets
    segments: int
    deletions: int  # of the segments, the first so many, have the one-deletion neighbourhood
    spare: int  # keys that each set indexes beyond what it must, and then does without


class Bands:
    """Size bands for a similarity of ``num / den``: a set meets sets not larger in its own band, larger ones in the next."""

    def __init__(self, num: int, den: int, chosen: dict[int, int] | None = None):
        self.num, self.den, self.chosen = num, den, chosen or {}
        self.over, self.under = den - num, den + num  # difference <= (r + s) * over / under
        most = 1
        while self.differ(most + 1, most + 1) <= 1:
            most += 1
        self.most = [most]

    def differ(self, size: int, largest: int) -> int:
        """Most shingles in which a set of ``size`` differs from any linked set of at most ``largest``."""
        return (size + min(size * self.den // self.num, largest)) * self.over // self.under

    def size_of(self, k: int) -> int:
        """Shingles of the largest sets of a band."""
        while len(self.most) <= k:
            self.most.append(self.most[-1] * self.den**4 // self.num**4 + 1)
        return self.most[k]

    def of(self, size: int) -> list[int]:
        k = 0
        while self.size_of(k) < size:
            k += 1
        return [k] + ([k + 1] if size * self.den >= (self.size_of(k) + 1) * self.num else [])

    def choices(self, k: int) -> list[Layout]:
        """Layouts of a band: neighbourhoods for none, half or all of what a set can differ in."""
        most = self.size_of(k)
        need = self.differ(most, most) + 1
        spare = min(1 + 3 * need // 20, 0xFFFF)
        full, found = (need + 1) // 2, []
        for deletions in dict.fromkeys((0, full // 2, full)):
            plain = need + spare - 2 * deletions
            if deletions == full:
                found.append(Layout(k, most, full, full, 0))
            else:
                found.append(Layout(k, most, deletions + math.ceil(1.35 * plain) + 1, deletions, spare))
        return found

    def layout(self, k: int) -> Layout:
        found = self.choices(k)
        return found[min(self.chosen.get(k, 0), len(found) - 1)]

    def keys(self, lay: Layout, sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index keys of sets (sorted, one behind the other, beginning ``at``), the number of the set of each, and of
        how many keys of its kind the set can do without."""
        m, salt = np.uint64(lay.segments), np.uint64((1009 * lay.band + 31 * lay.deletions + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        sizes = np.diff(at)
        own = np.repeat(np.arange(len(sizes)), sizes)
        segment = ((sets >> np.uint64(32)) * m) >> np.uint64(32)  # rises with the shingle, so subsets stand together
        one = mix(sets, 3)
        begins = np.ones(len(sets), dtype=bool)
        begins[1:] = (segment[1:] != segment[:-1]) | (own[1:] != own[:-1])
        starts = np.flatnonzero(begins)
        content = np.add.reduceat(one, starts) if len(starts) else np.empty(0, np.uint64)
        number, of = segment[starts], own[starts]
        place = mix(number, 7) + salt
        keys, owners = [], []
        near = number < np.uint64(lay.deletions)
        if lay.deletions:
            keys.append(mix(content[near] + mix(place[near], 23), 29))
            owners.append(of[near])
            which = np.cumsum(begins) - 1
            inside = near[which]
            keys.append(mix(content[which[inside]] - one[inside] + mix(place[which[inside]], 23), 29))
            owners.append(own[inside])
            for k in range(lay.deletions):  # an empty subset is one deletion from any single shingle
                empty = np.setdiff1d(np.arange(len(sizes)), of[number == np.uint64(k)])
                keys.append(np.repeat(mix(mix(mix(np.array([k], np.uint64), 7) + salt, 23), 29), len(empty)))
                owners.append(empty)
        always = sum(map(len, keys))
        if lay.segments > lay.deletions:
            number, of, plain = number[~near], of[~near], mix(content[~near] + place[~near], 31)
            filled = np.bincount(of, minlength=len(sizes))
            before = np.concatenate(([0], np.cumsum(filled)))[:-1]
            wanted = (sizes + np.minimum(sizes * self.den // self.num, lay.most)) * self.over // self.under + 1 + lay.spare - 2 * lay.deletions
            chosen = np.arange(len(of)) - before[of] < wanted[of]
            keys.append(plain[chosen])
            owners.append(of[chosen])
            for k in np.flatnonzero(filled < wanted).tolist():  # the first empty segments stand in
                free = np.setdiff1d(np.arange(lay.deletions, lay.segments, dtype=np.uint64), number[before[k] : before[k] + filled[k]])[: wanted[k] - filled[k]]
                keys.append(mix(mix(free, 7) + salt, 31))
                owners.append(np.full(len(free), k))
        spares = np.zeros(sum(map(len, keys)), dtype=np.int32)
        spares[always:] = lay.spare
        return np.concatenate(keys), np.concatenate(owners), spares


def _name(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two longs for each set: its name; equal sets have one name."""
    out = np.zeros((len(at) - 1, 2), dtype=np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for k in range(2):
            total = np.add.reduceat(mix(sets, 13 + k), at[full])
            out[full, k] = mix(total + np.diff(at)[full].astype(np.uint64), 17 + k)
    return out


def _parity(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the sets: a bit is whether an odd number of shingles fall on it."""
    n, bits = len(at) - 1, 64 * PARITY_LONGS
    on = np.repeat(np.arange(n), np.diff(at)) * bits + (mix(sets, 19) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(on, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits), axis=1)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        where = cuts(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), _PIECE) if batch.num_rows else []
        for a, b in zip(where, where[1:]):
            yield batch.slice(a, b - a), batch.column(column).slice(a, b - a).cast(pa.binary()).to_pylist()
    pa.default_memory_pool().release_unused()  # the worker lives on


def _by_band(lay: Bands, at: np.ndarray, fresh: np.ndarray) -> dict[int, np.ndarray]:
    """Numbers of the sets that are indexed in each band."""
    found: dict[int, list[int]] = {}
    sizes = np.diff(at).tolist()
    for k in fresh.tolist():
        for band in lay.of(sizes[k]):
            if lay.differ(sizes[k], lay.size_of(band)):  # else only equal sets are linked
                found.setdefault(band, []).append(k)
    return {band: np.array(some) for band, some in found.items()}


def _taken(sets: np.ndarray, at: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the sets."""
    sizes = np.diff(at)[some]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return sets[np.repeat(at[:-1][some] - ends[:-1], sizes) + np.arange(ends[-1])], ends


_INDEX = "key long, name long, layout int, more binary"


def index(docs: DataFrame, width: int, lay: Bands) -> DataFrame:
    """Of docs (_id, _text): a row for each index key of each set, once for equal sets of a task (layout: band << 16 and
    spare keys), and for each document a row of layout -1 with id, name, size and parity bitmap, as ``more``."""

    def run(batches):
        shingles, met = Shingles(width), set()
        for batch, texts in _texts(batches, 1):
            sets, at = shingles(texts)
            names, sizes = _name(sets, at), np.diff(at)
            head = np.concatenate((batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), names.astype(">u8").view(np.uint8).reshape(-1, 16), sizes.astype(">i8").view(np.uint8).reshape(-1, 8), _parity(sets, at)), axis=1)
            first = names[:, 0].tolist()
            fresh = []
            for k in np.flatnonzero(sizes).tolist():
                if first[k] not in met:
                    met.add(first[k])
                    fresh.append(k)
            keys, owner, layouts = [mix(names[:, 0] + np.arange(len(texts), dtype=np.uint64), 41)], [names[:, 0]], [np.full(len(texts), -1, dtype=np.int32)]
            for band, some in _by_band(lay, at, np.array(fresh, dtype=np.int64)).items():
                form = lay.layout(band)
                found, of, spares = lay.keys(form, *_taken(sets, at, some))
                keys.append(found)
                owner.append(names[some[of], 0])
                layouts.append(spares | (band << 16))
            more = pa.concat_arrays([pa.array(list(map(bytes, head)), pa.binary()), pa.nulls(sum(map(len, keys[1:])), pa.binary())])
            yield from pa.Table.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner).view(np.int64)), pa.array(np.concatenate(layouts)), more], names=["key", "name", "layout", "more"]).to_batches(max_chunksize=200_000)

    return docs.mapInArrow(run, _INDEX)


def chosen(docs: DataFrame, width: int, num: int, den: int, sample: int = SAMPLE) -> dict[int, int]:
    """The cheapest layout of each band, by index rows and pairs counted on about ``sample`` texts and carried on to all."""
    n = docs.count()
    share = min(1.0, sample / max(1, n))
    some = docs.filter(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 40)) < math.ceil(share * (1 << 40)))

    def run(batches):
        shingles, lay = Shingles(width), Bands(num, den)
        for _, texts in _texts(batches, 1):
            sets, at = shingles(texts)
            for band, these in _by_band(lay, at, np.flatnonzero(np.diff(at))).items():
                for k, form in enumerate(lay.choices(band)):
                    keys = lay.keys(form, *_taken(sets, at, these))[0].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), band, np.int32)), pa.array(np.full(len(keys), k, np.int32)), pa.array(keys)], names=["band", "choice", "key"])

    counted = some.mapInArrow(run, "band int, choice int, key long").groupBy("band", "choice", "key").agg(F.count("*").alias("n"))
    costs = counted.groupBy("band", "choice").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()  # a row for each band and choice
    least: dict[int, tuple[float, int]] = {}
    for r in costs:
        cost = (r["rows"] / share + PAIR_COST * r["pairs"] / share**2, r["choice"])
        least[r["band"]] = min(cost, least.get(r["band"], cost))
    return {band: choice for band, (_, choice) in least.items()}


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and name: those whose key more than one name has, each once, and all of layout -1. Holds
    one row back."""
    held: pa.Table | None = None
    told = False  # whether the held row's key was met before it
    for batch in batches:
        rows = pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks() if held else pa.Table.from_batches([batch])
        key, name = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])))
        head = rows.column(2).to_numpy() < 0
        new |= head
        if not new.all():
            rows, key, head = rows.filter(pa.array(new)), key[new], head[new]
        same = key[1:] == key[:-1]
        keep = np.concatenate(([told], same)) | np.concatenate((same, [False])) | head
        told, held = bool(np.concatenate(([told], same))[-1]), rows.slice(len(key) - 1)
        out = rows.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
        if out.num_rows:
            yield from out.combine_chunks().to_batches()
    if held is not None and (told or held.column(2)[0].as_py() < 0):
        yield from held.combine_chunks().to_batches()


def _long(at: int) -> Column:
    return F.conv(F.hex(F.substring("more", at, 8)), 16, -10).cast("long")


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Sizes and parity bitmaps allow the link."""
    c = lambda side, name: F.col(f"{side}.{name}")
    apart = sum((F.bit_count(c(a, f"b{k}").bitwiseXOR(c(b, f"b{k}"))) for k in range(PARITY_LONGS)), F.lit(0))
    total = c(a, "size") + c(b, "size")
    return (F.least(c(a, "size"), c(b, "size")) * den >= F.greatest(c(a, "size"), c(b, "size")) * num) & (apart * (den + num) <= total * (den - num))


_NODE = ["node", "id", "size", *(f"b{k}" for k in range(PARITY_LONGS))]


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (id, ...) with the texts of their ids: only texts that are wanted travel."""
    some = flagged(docs, F.col("_id"), wanted, "id").filter("_may").drop("_may")
    return some.join(wanted, some["_id"] == wanted["id"]).drop("_id", "id")


def verified(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int, salt_rows: int = 512) -> DataFrame:
    """The pairs (a, a_id, b, b_id: nodes and ids of documents that have their sets; a written table) that are similar
    enough, by their whole texts.

    Each b's text meets those of its a's over one shuffle, b's first; a b with many a's is dealt over several groups of
    about ``salt_rows``, its text repeated in each. Texts of other sets under the same id are passed over.
    """
    salts = pairs.groupBy("b").agg(F.min("b_id").alias("b_id"), F.ceil(F.count("*") / salt_rows).cast("int").alias("salts"))
    dealt = pairs.join(salts.select("b", "salts"), "b").select("b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("a").alias("node"), F.col("a_id").alias("id"))
    leads = salts.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("b").alias("node"), F.col("b_id").alias("id"))
    met = _with_texts(docs, written(dealt.unionByName(leads), "dealt")).select("b", "salt", "role", "node", "_text")
    met = met.repartition("b", "salt").sortWithinPartitions("b", "salt", "role")

    def run(batches):
        shingles, lead, own = Shingles(width), None, np.empty(0, np.uint64)
        for batch, texts in _texts(batches, 4):
            sets, at = shingles(texts)
            names = [x.tobytes() for x in _name(sets, at).astype(">u8")]
            b, role, node = (batch.column(k).to_pylist() for k in (0, 2, 3))
            out_a, out_b = [], []
            for k in range(len(texts)):
                if names[k] != node[k]:
                    continue
                s = sets[at[k] : at[k + 1]]
                if role[k] == 0:
                    lead, own = b[k], s.copy()
                    continue
                if lead != b[k]:
                    continue
                met = np.sort(np.concatenate((own, s)))
                both = int((met[1:] == met[:-1]).sum())
                if den * both >= num * (len(met) - both):
                    out_a.append(node[k])
                    out_b.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])

    return met.mapInArrow(run, "a binary, b binary").distinct()


class _Search:
    """Links found so far, and the components that they make."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.docs, self.width, self.num, self.den = docs, width, num, den
        self.found: DataFrame | None = None  # node, component
        self.tested: DataFrame | None = None

    def components_of(self, rows: DataFrame) -> DataFrame:
        if self.found is None:
            return rows.withColumn("component", F.col("node"))
        return rows.join(self.found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def mixed(self, rows: DataFrame) -> DataFrame:
        """Rows (key, node, ...) with their components and how many sets their key has, of keys of more than one component."""
        own = self.components_of(rows)
        of = own.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("sets")).filter("least < most").select("key", "sets")
        return written(own.join(of, "key"), "mixed")

    def may_link(self) -> Column:
        """What rows x and y of a key show of their sets allows a link."""
        return _may_link("x", "y", self.num, self.den)

    def pairs(self, x: DataFrame, y: DataFrame, also: Column | None = None, ordered: bool = True) -> DataFrame:
        """Rows of x and of y of the same key and another component that may link; ``ordered``: each pair one way."""
        x, y = x.alias("x"), y.alias("y")
        apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
        if ordered:
            apart &= F.col("x.node") > F.col("y.node")
        joined = x.join(y, apart & self.may_link() & (F.lit(True) if also is None else also))
        first = F.col("x.node") > F.col("y.node")
        pick = lambda c: [F.when(first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")), F.when(first, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}"))]
        (a, b), (a_id, b_id) = pick("node"), pick("id")
        return joined.select(a.alias("a"), b.alias("b"), a_id.alias("a_id"), b_id.alias("b_id")).distinct()

    def look(self, pairs: DataFrame) -> None:
        """Verifies pairs that were not tested before."""
        pairs = written(pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return
        self.tested = pairs.select("a", "b") if self.tested is None else self.tested.unionByName(pairs.select("a", "b"))
        self.join(written(verified(pairs, self.docs, self.width, self.num, self.den), "links"))

    def join(self, links: DataFrame) -> None:
        """Joins the components of linked nodes (a, b; a written table)."""
        if links.isEmpty():
            return
        # New links join components, so that only those are gone through again
        of = lambda side: self.components_of(links.select(F.col(side).alias("node"), F.col("a").alias("_a"), F.col("b").alias("_b"))).select("_a", "_b", F.col("component").alias(side))
        over = connect(of("a").join(of("b"), ["_a", "_b"]).select("a", "b"))
        if self.found is None:
            self.found = written(over, "components")
        else:
            moved = self.found.join(over.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
            self.found = written(moved.unionByName(over.join(self.found.select("node"), "node", "left_anti")), "components")


def _leads(own: DataFrame, turn: int) -> DataFrame:
    """Two sets of each key, by hash and others each turn, that its other sets are held against."""
    order = [F.xxhash64("node", F.lit(2 * turn)), F.xxhash64("node", F.lit(2 * turn + 1))]
    rows = [*_NODE, "component"]
    picked = own.groupBy("key").agg(*(F.min(F.struct(o.alias("o"), *rows)).alias(f"l{k}") for k, o in enumerate(order)))
    return picked.select("key", F.explode(F.array_distinct(F.transform(F.array("l0", "l1"), lambda r: F.struct(*(r[c].alias(c) for c in rows))))).alias("l")).select("key", "l.*")


def _rarest_shingles(some: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """key (a shingle), node, left and the node's columns: the shingles of sets (rows of nodes) by which a linked one of
    ``some`` must be met, rarest first, and how many of the set stand from there on."""

    def run(batches):
        shingles = Shingles(width)
        for batch, texts in _texts(batches, 1):
            sets, at = shingles(texts)
            names = [x.tobytes() for x in _name(sets, at).astype(">u8")]
            right = np.array([a == b for a, b in zip(names, batch.column(0).to_pylist(), strict=True)], dtype=bool)
            these = np.flatnonzero(right)
            keys, ends = _taken(sets, at, these)
            yield from pa.Table.from_arrays([pa.array(keys.view(np.int64)), pa.array([names[k] for k in these.tolist()], pa.binary()).take(pa.array(np.repeat(np.arange(len(these)), np.diff(ends))))], names=["key", "node"]).to_batches(max_chunksize=200_000)

    texts = _with_texts(docs, some.select("node", "id")).select("node", "_text")
    rows = written(texts.mapInArrow(run, "key long, node binary").distinct(), "shingles")
    often = rows.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1")
    met = rows.join(often, "key")  # those before the first met are the set's own
    back = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("often"), "key"))
    return written(met.withColumn("left", back).join(some, "node").filter(F.col("left") * den >= F.col("size") * num).drop("often"), "rarest")


def components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, set_id and component_id per row of ``docs``; sets with a similarity of at least
    ``num / den`` are linked.

    Null and empty texts, and texts of blanks only, have no shingles, are linked with nothing and are components of
    their own. Equal sets are one node (set_id: its smallest id), however many copies there are. Rows with a null id are
    linked by their text like others, but never name a component unless all of its ids are null: then its name is null.
    Repeated rows each keep a row, also those of one id with different texts. Other columns are not read. Ids are longs
    below 2^62. Shingles are compared by 64-bit hashes, sets by 128 bits.
    """
    text_id = F.lit(NO_ID) + F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).bitwiseAND(F.lit(NO_ID // 2 - 1))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), text_id).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    lay = Bands(num, den, chosen(docs, width, num, den))
    live = index(docs, width, lay).repartition("key").sortWithinPartitions("key", "name").mapInArrow(_shared, _INDEX)
    live = written(live, "live")
    rows, nodes = documents(live)
    keys = live.filter("layout >= 0").select("key", "name", "layout")
    often = keys.groupBy("key").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("name", "layout").orderBy(F.desc("often"), "key"))
    kept = keys.join(often, "key").withColumn("rank", rank).filter(F.col("rank") > F.col("layout").bitwiseAND(F.lit(0xFFFF))).select("key", "name")
    kept = once_for_equal_keys(kept, nodes)
    search = _Search(docs, width, num, den)
    own = search.mixed(kept)
    search.look(search.pairs(own, _leads(own, 0), ordered=False))
    own = search.mixed(kept)
    few, many = own.filter(F.col("sets") <= FEW), own.filter(F.col("sets") > FEW)
    search.look(search.pairs(few, few).unionByName(search.pairs(many, _leads(many, 1), ordered=False)).distinct())
    some = written(search.mixed(many.select("key", *_NODE)).select(_NODE).distinct(), "crowded")
    if not some.isEmpty():
        rare = _rarest_shingles(some, docs, width, num, den)
        own = search.mixed(rare)
        search.look(search.pairs(own, _leads(own, 0), ordered=False))
        own = search.mixed(rare)
        need = (F.col("x.size") + F.col("y.size")) * num
        search.look(search.pairs(own, own, also=F.least("x.left", "y.left") * (num + den) >= need))

    return labelled(search, rows, nodes, id_col)


def documents(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a live index: its documents (name, _id, node, size, b0...) and their different sets (a written table)."""
    rows = live.filter("layout = -1").select("name", _long(1).alias("_id"), F.substring("more", 9, 16).alias("node"), _long(25).alias("size"), *(_long(33 + 8 * k).alias(f"b{k}") for k in range(PARITY_LONGS)))
    nodes = rows.filter("size > 0").groupBy("name", "node").agg(F.min("_id").alias("id"), *(F.max(c).alias(c) for c in _NODE[2:]))
    return rows, written(nodes, "nodes")


def once_for_equal_keys(kept: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (key, name) as rows of key and node; keys of the same sets say the same, so one of them does."""
    kept = written(kept, "kept")
    members = kept.groupBy("key").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("name", F.lit(k))).alias(f"m{k}") for k in range(2)))
    one = members.filter("n > 1").groupBy("n", "m0", "m1").agg(F.min("key").alias("key")).select("key")
    return written(kept.join(one, "key").join(nodes, "name").drop("name"), "kept")


def labelled(search: _Search, rows: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """``id_col``, n_shingles, set_id and component_id for each document."""
    named = search.components_of(nodes.select("node", "id"))
    named = named.join(named.groupBy("component").agg(F.min("id").alias("least")), "component").select("node", F.col("id").alias("set_id"), "least")
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    alone = F.col("size") == 0
    return rows.join(named, "node", "left").select(
        real("_id").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.when(alone, real("_id")).otherwise(real("set_id")).alias("set_id"),
        F.when(alone, real("_id")).otherwise(real("least")).alias("component_id"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents; odd texts and ids as said at ``components``."""
    return components(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "n_shingles", "component_id", "set_id")
