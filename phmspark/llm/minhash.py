"""Near duplicates by a signature-coordinate inverted join.

A set of shingles has a signature: its least shingle under each of ``COORDINATES`` hash orders. Two sets agree in a
coordinate with the probability of their Jaccard similarity, so sets of a similarity of 0.85 agree in 54 of 64, and in
fewer than ``LEAST_MATCHES`` = 32 with a probability below 1e-11. Each (coordinate, value) is a posting list of the sets
that have it.

Prefix: two sets that agree in T coordinates still have a posting in common when each is left out of its T - 1 longest
ones, so the long lists are never merged. Skip: what meets in a short list is counted over its whole signature, and given
up as soon as the coordinates that are left cannot make up T. Pairs with T matches are confirmed on their full sets.

Copies count once. In a list of many sets, all are first held against two leads of the list; only what is then still in
different components meets, chunk by chunk, and a chunk passes on no more than the links that join its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phmspark.llm.common import spread, table, written
from phmspark.llm.ngram_join import _INDEX, _NODE, FEW, NO_ID, Shingles, _leads, _name, _Search, _shared, _taken, _texts, _with_texts, documents, labelled, mix, once_for_equal_keys

COORDINATES = 64  # a byte of each fills the eight longs that a node carries
LEAST_MATCHES = 32
CHUNK_SETS, CHUNK_SHINGLES = 2048, 1_000_000  # of a crowded list that meet as many others in one task
PURE = 256  # sets of one component in a list from which on they have chunks of their own

_ORDERS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64), 51) | np.uint64(1)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of the coordinates (64 bits each) of sets, one behind the other, beginning ``at``, none empty."""
    out = np.empty((len(at) - 1, COORDINATES), dtype=np.uint64)
    if len(out):
        for k in range(COORDINATES):
            out[:, k] = np.minimum.reduceat(sets * _ORDERS[k], at[:-1])
    return out


def bytes_of(signature: np.ndarray) -> np.ndarray:
    """A byte of each coordinate: equal values have equal bytes, others seldom."""
    return (mix(signature, 53) >> np.uint64(56)).astype(np.uint8)


def index(docs: DataFrame, width: int, least_size: int) -> DataFrame:
    """Of docs (_id, _text): a row for each coordinate of each set (key of coordinate and value), once for equal sets of
    a task, and for each document a row of layout -1 with id, name, size and signature bytes, as ``more``. Sets of fewer
    than ``least_size`` shingles are linked with no other set and have no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, met = Shingles(width), set()
        places = mix(np.arange(COORDINATES, dtype=np.uint64), 57)
        for batch, texts in _texts(batches, 1):
            sets, at = shingles(texts)
            names, sizes = _name(sets, at), np.diff(at)
            full = np.flatnonzero(sizes)
            signed = signatures(*_taken(sets, at, full))
            short = np.zeros((len(texts), COORDINATES), dtype=np.uint8)
            short[full] = bytes_of(signed)
            head = np.concatenate((batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), names.astype(">u8").view(np.uint8).reshape(-1, 16), sizes.astype(">i8").view(np.uint8).reshape(-1, 8), short), axis=1)
            first = names[:, 0].tolist()
            fresh = []
            for place, k in enumerate(full.tolist()):
                if sizes[k] >= least_size and first[k] not in met:
                    met.add(first[k])
                    fresh.append(place)
            keys = [mix(names[:, 0] + np.arange(len(texts), dtype=np.uint64), 41), mix(signed[fresh] + places, 59).ravel()]
            owner = [names[:, 0], np.repeat(names[full[fresh], 0], COORDINATES)]
            layout = np.zeros(sum(map(len, keys)), dtype=np.int32)
            layout[: len(texts)] = -1
            more = pa.concat_arrays([pa.array(list(map(bytes, head)), pa.binary()), pa.nulls(len(keys[1]), pa.binary())])
            yield from pa.Table.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owner).view(np.int64)), pa.array(layout), more], names=["key", "name", "layout", "more"]).to_batches(max_chunksize=200_000)

    return docs.mapInArrow(run, _INDEX)


def _apart(k: int) -> Column:
    """In how many of the eight coordinates of long k x and y differ: bits of a byte are folded into its lowest."""
    x = F.col(f"x.b{k}").bitwiseXOR(F.col(f"y.b{k}"))
    for by in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, by))
    return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


class _Matches(_Search):
    """A search whose rows show their signatures."""

    least = LEAST_MATCHES

    def may_link(self) -> Column:
        sizes = F.least("x.size", "y.size") * self.den >= F.greatest("x.size", "y.size") * self.num
        most = COORDINATES - self.least  # coordinates in which sets may differ
        parts = [sum((_apart(k) for k in some), F.lit(0)) for some in (range(5), range(8))]
        return sizes & (parts[0] <= most) & (parts[1] <= most)


def _compare(width: int, num: int, den: int, least: int):
    """For one pair of chunks (rows with side 0 or 1; of a chunk with itself only 0): links between different
    components, as many as join them."""

    def run(group: pa.Table) -> pa.Table:
        texts = group.column("_text").cast(pa.binary()).to_pylist()
        sets, at = Shingles(width)(texts)
        names = [x.tobytes() for x in _name(sets, at).astype(">u8")]
        node, component = group.column("node").to_pylist(), group.column("component").to_pylist()
        right = np.flatnonzero([a == b for a, b in zip(names, node)])
        sets, at = _taken(sets, at, right)
        sizes, side = np.diff(at), np.array(group.column("side").to_numpy())[right]
        short = bytes_of(signatures(sets, at))
        universe, number = np.unique(sets, return_inverse=True)
        mark = np.zeros(len(universe), dtype=bool)
        parent = {component[k]: component[k] for k in right.tolist()}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        both_sides = bool(side.any())
        out_a, out_b = [], []
        for p in np.flatnonzero(side == 0).tolist() if both_sides else range(len(right)):
            others = np.flatnonzero(side == 1) if both_sides else np.arange(p + 1, len(right))
            near = (short[others] == short[p]).sum(1, dtype=np.int16) >= least
            near &= np.minimum(sizes[others], sizes[p]) * den >= np.maximum(sizes[others], sizes[p]) * num
            mine = root(component[right[p]])
            others = np.array([k for k in others[near].tolist() if root(component[right[k]]) != mine], dtype=np.int64)
            if not len(others):
                continue
            mark[number[at[p] : at[p + 1]]] = True
            members, ends = _taken(number, at, others)
            both = np.add.reduceat(mark[members], ends[:-1], dtype=np.int64)
            mark[number[at[p] : at[p + 1]]] = False
            for k in others[den * both >= num * (sizes[p] + sizes[others] - both)].tolist():
                if (theirs := root(component[right[k]])) != root(component[right[p]]):
                    parent[theirs] = root(component[right[p]])
                    out_a.append(node[right[p]])
                    out_b.append(node[right[k]])
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return run


def crowded(search: _Matches, own: DataFrame) -> DataFrame:
    """Links (a, b) between different components among the rows of crowded lists (key, node, id, size, component).

    A list is cut into chunks of bounded sets and shingles; a component of many of its sets has chunks of its own, and
    two chunks of one component do not meet. Each pair of the others is a task's group."""
    per = own.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).withColumn("pool", F.when(F.col("n") >= PURE, F.col("component")).otherwise(F.lit(b"")))
    pools = per.groupBy("key", "pool").agg(F.ceil(F.greatest(F.sum("n") / CHUNK_SETS, F.sum("shingles") / CHUNK_SHINGLES)).cast("int").alias("parts"))
    placed = own.join(per.select("key", "component", "pool"), ["key", "component"]).join(pools, ["key", "pool"])
    placed = written(placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("key", "pool", "part", "node", "id", "component"), "placed")
    chunk = placed.select("key", F.struct("pool", "part").alias("c")).distinct()
    a, b = chunk.withColumnRenamed("c", "a"), chunk.withColumnRenamed("c", "b")
    pairs = written(a.join(b, "key").filter("a <= b AND (a.pool != b.pool OR a.pool = X'')"), "chunk-pairs")
    sides = [pairs.select("key", "a", "b", F.lit(k).alias("side"), F.col(f"{c}.pool").alias("pool"), F.col(f"{c}.part").alias("part")).filter("a != b OR side = 0") for k, c in enumerate("ab")]
    rows = written(sides[0].unionByName(sides[1]).join(placed, ["key", "pool", "part"]).select("key", "a", "b", "side", "node", "id", "component"), "chunk-rows")
    met = _with_texts(search.docs, rows).select("key", "a", "b", "side", "node", "component", "_text")
    return met.groupBy("key", "a", "b").applyInArrow(_compare(search.width, search.num, search.den, search.least), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, set_id and component_id per row of ``docs``; sets with a similarity of at least
    ``num / den`` are linked (0.85 or more: below, more coordinates are needed for as little risk).

    Null and empty texts, and texts of blanks only, have no shingles, are linked with nothing and are components of
    their own. Equal sets are one node (set_id: its smallest id), however many copies there are. Rows with a null id are
    linked by their text like others, but never name a component unless all of its ids are null: then its name is null.
    Repeated rows each keep a row, also those of one id with different texts. Other columns are not read. Ids are longs
    below 2^62. Shingles are compared by 64-bit hashes, sets by 128 bits.
    """
    if num * 100 < den * 85:
        raise ValueError("64 coordinates are for similarities of 0.85 or more")
    text_id = F.lit(NO_ID) + F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).bitwiseAND(F.lit(NO_ID // 2 - 1))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), text_id).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    least_size = -(-num // (den - num)) if den > num else 1 << 60
    live = written(index(docs, width, least_size).repartition("key").sortWithinPartitions("key", "name").mapInArrow(_shared, _INDEX), "live")
    rows, nodes = documents(live)
    posts = live.filter("layout >= 0").select("key", "name")
    lengths = posts.groupBy("key").agg(F.count("*").alias("length"))
    longest = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("length"), "key"))
    prefix = posts.join(lengths, "key").withColumn("rank", longest).filter(F.col("rank") >= LEAST_MATCHES).select("key", "name")
    kept = once_for_equal_keys(prefix, nodes)

    search = _Matches(docs, width, num, den)
    own = search.mixed(kept)
    search.look(search.pairs(own, _leads(own, 0), ordered=False))
    own = search.mixed(kept)
    few, many = own.filter(F.col("sets") <= FEW), own.filter(F.col("sets") > FEW)
    search.look(search.pairs(few, few).unionByName(search.pairs(many, _leads(many, 1), ordered=False)).distinct())
    rest = search.mixed(many.select("key", *_NODE))
    if not rest.isEmpty():
        search.join(written(crowded(search, rest), "links"))
    return labelled(search, rows, nodes, id_col)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents``; of each component the document that names it is kept."""
    found = near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "set_id")
