"""Exact nearest neighbours.

A bank of few rows travels to the queries. A larger one is cut into cells around pivots, and the cells into blocks that
know their ball: the greatest distance of a row to the pivot. Each query first meets one block of the nearest cell of
every class, which gives it a floor: it needs no row farther than the k-th found there. Then it meets only blocks whose
ball reaches within the floor. Blocks meet queries over one shuffle, a block of either side at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phmspark.sources.scratch import written

BROADCAST_VALUES = 4_000_000  # numbers of a bank that travels to the queries (32 MB)
MOST_CELLS = 1024  # pivots of a bank; each class has one at least
MET_VALUES = 1_000_000  # distances between queries and bank rows that a task works out at once (8 MB)
SLACK = 1e-9  # of a distance: what rounding may hide


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


@dataclass
class Bank:
    """Rows by id, and where each class's rows are."""

    ids: np.ndarray
    m: np.ndarray
    at: dict[str, np.ndarray]
    square: np.ndarray  # of a row's length

    @classmethod
    def of(cls, ids: np.ndarray, names: np.ndarray, m: np.ndarray) -> Bank:
        order = np.argsort(ids, kind="stable")
        names, m = names[order], m[order]
        return cls(ids[order], m, {c: np.flatnonzero(names == c) for c in sorted(set(names.tolist()))}, np.einsum("ij,ij->i", m, m))


def _best(bank: Bank, ids: np.ndarray, m: np.ndarray, k: int, not_self: bool) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray, np.ndarray]]:
    """For each class query, class, rank, neighbour and distance of the k nearest rows of the bank, ties to smaller ids;
    so many queries at once that a task holds about ``MET_VALUES`` distances, whatever the size of the bank."""
    rows = max(1, MET_VALUES // max(1, len(bank.ids)))
    for start in range(0, len(ids), rows):
        yield from _best_of(bank, ids[start : start + rows], m[start : start + rows], k, not_self)


def _best_of(bank: Bank, ids: np.ndarray, m: np.ndarray, k: int, not_self: bool) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray, np.ndarray]]:
    square = (-2 * m) @ bank.m.T
    square += (m * m).sum(axis=1)[:, None]
    square += bank.square
    if not_self:
        square[bank.ids[None] == ids[:, None]] = np.inf
    for c, at in bank.at.items():
        own = square[:, at] if len(bank.at) > 1 else square
        few = min(k + 8, len(at))  # a few more than asked for: their distances are worked out exactly
        near = np.sort(at[np.argpartition(own, few - 1, axis=1)[:, :few]], axis=1)  # by id
        exact = np.sqrt(((bank.m[near] - m[:, None]) ** 2).sum(axis=2))
        exact[np.isinf(np.take_along_axis(square, near, axis=1))] = np.inf
        order = np.argsort(exact, axis=1, kind="stable")[:, :k]
        exact, near = np.take_along_axis(exact, order, axis=1), np.take_along_axis(near, order, axis=1)
        row, place = np.nonzero(np.isfinite(exact))
        yield ids[row], c, place + 1, bank.ids[near[row, place]], exact[row, place]


_FOUND = "query long, cls string, rank int, neighbour long, distance double"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _batch(q: np.ndarray, c: str, rank: np.ndarray, near: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array([c] * len(q), pa.string()), pa.array(rank.astype(np.int32)), pa.array(near), pa.array(d)], names=_NAMES)


def nearest(queries: DataFrame, bank: DataFrame, k: int, id_col: str, f: str = "f", cls: str | None = None, not_self: bool = False, block_rows: int = 2048, broadcast_values: int = BROADCAST_VALUES, meter=None) -> DataFrame:
    """query, cls, rank (from 1), neighbour, distance: the ``k`` nearest bank rows of each class for each query row.

    Ties go to smaller ids; fewer than ``k`` rows of a class give all of them. Ids of queries are distinct. A bank of at
    most ``broadcast_values`` numbers is broadcast, a larger one is indexed; the rows are the same. ``meter``, an
    accumulator, adds up how many pairs of a query and a bank row were compared.
    """
    kind = F.col(cls).cast("string") if cls else F.lit("")
    b = bank.select(F.col(id_col).cast("long").alias("_id"), kind.alias("_c"), F.col(f).alias("f"))
    q = queries.select(F.col(id_col).cast("long").alias("_id"), F.col(f).alias("f"))
    width = b.select(F.size("f")).first()
    if width is None:
        return written(queries.sparkSession.createDataFrame([], _FOUND), "neighbours")
    most = broadcast_values // max(1, width[0])
    some = b.limit(most + 1).toArrow() if most > 0 else None
    if some is not None and some.num_rows <= most:
        return _beside_all(q, some, k, not_self, block_rows, meter)
    return _indexed(q, written(b, "bank"), k, not_self, block_rows, meter)


def _beside_all(q: DataFrame, bank: pa.Table, k: int, not_self: bool, block_rows: int, meter) -> DataFrame:
    bank = bank.combine_chunks()
    own = Bank.of(bank.column(0).to_numpy(), np.array(bank.column(1).to_pylist(), dtype=object), _matrix(bank.column(2).chunk(0)))
    shared = q.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                some = batch.slice(at, block_rows)
                if meter is not None:
                    meter.add(some.num_rows * len(own.ids))
                for found in _best(own, some.column(0).to_numpy(), _matrix(some.column(1)), k, not_self):
                    yield _batch(*found)

    return written(q.mapInArrow(run, _FOUND), "neighbours")


@dataclass
class Cells:
    """Pivots of cells by class, and the blocks of the cells with the radius of each."""

    pivots: np.ndarray
    classes: list[str]  # of a pivot
    radius: np.ndarray
    first: np.ndarray  # number of a cell's first block; -1 if it is empty
    blocks: DataFrame  # block, cell, n, ids, m


def cells(bank: DataFrame, block_rows: int, most_cells: int = MOST_CELLS, aside: int = 0) -> Cells:
    """The bank (_id, _c, f; a written table) in blocks of up to ``block_rows`` rows of one cell. Pivots are rows, chosen
    by hash, as many for a class as it has blocks, at most ``most_cells`` in proportion; they are all that the driver sees.
    The last ``aside`` components are carried along, and are no part of the space."""
    counts = {r["_c"]: r["n"] for r in bank.groupBy("_c").agg(F.count("*").alias("n")).collect()}  # a row for each class
    whole = sum(-(-n // block_rows) for n in counts.values())
    share = min(1.0, most_cells / whole)
    wanted = F.create_map(*(x for c, n in counts.items() for x in (F.lit(c), F.lit(max(1, int(-(-n // block_rows) * share))))))
    order = F.row_number().over(Window.partitionBy("_c").orderBy(F.xxhash64("_id", F.lit(5)), "_id"))
    chosen = bank.withColumn("_k", order).filter(F.col("_k") <= wanted[F.col("_c")]).select("_c", "f").orderBy("_c", "_k").collect()
    pivots, classes = np.array([r["f"][: len(r["f"]) - aside] for r in chosen]), [r["_c"] for r in chosen]
    shared = bank.sparkSession.sparkContext.broadcast((pivots, {c: np.array([k for k, x in enumerate(classes) if x == c]) for c in counts}))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, of = shared.value
        for batch in batches:
            m, names = _matrix(batch.column(2))[:, : pivots.shape[1]], np.array(batch.column(1).to_pylist(), dtype=object)
            cell, away = np.zeros(len(m), np.int32), np.zeros(len(m))
            for c in set(names.tolist()):
                at = np.flatnonzero(names == c)
                d = _distances(m[at], pivots[of[c]])
                cell[at], away[at] = of[c][d.argmin(axis=1)], d.min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), pa.array(away), batch.column(2)], names=["cell", "id", "away", "f"])

    placed = bank.mapInArrow(assign, "cell int, id long, away double, f array<double>")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def block():
            nonlocal number
            ids, m = np.concatenate([x[1] for x in held]), np.concatenate([x[3] for x in held])
            row = {"block": [number], "cell": [held[0][0]], "radius": [float(max(x[2].max() for x in held))], "n": [len(ids)], "ids": [ids.tolist()], "m": [m.tobytes()]}
            number += 1
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema=_BLOCK)

        for batch in batches:
            cell = batch.column(0).to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
            for a, z in zip(edges, edges[1:]):
                while a < z:
                    if held and (held[0][0] != cell[a] or sum(len(x[1]) for x in held) >= block_rows):
                        yield block()
                    some = batch.slice(a, min(z - a, block_rows - sum(len(x[1]) for x in held)))
                    held.append((int(cell[a]), some.column(1).to_numpy(), some.column(2).to_numpy(), _matrix(some.column(3))))
                    a += some.num_rows
        if held:
            yield block()

    by_cell = placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")  # a crowded cell is several ranges
    blocks = written(by_cell.mapInArrow(pack, "block long, cell int, radius double, n int, ids array<long>, m binary"), "blocks")
    radius, first = np.zeros(len(pivots)), np.full(len(pivots), -1, np.int64)
    for r in blocks.groupBy("cell").agg(F.max("radius").alias("radius"), F.min("block").alias("first")).collect():
        radius[r["cell"]], first[r["cell"]] = r["radius"], r["first"]
    return Cells(pivots, classes, radius, first, blocks.drop("radius"))


_BLOCK = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("radius", pa.float64()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("m", pa.binary())])


def unpacked(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of one packed block of a batch, of its last two columns; nothing is copied."""
    ids, m = batch.column(batch.num_columns - 2)[at].values.to_numpy(), batch.column(batch.num_columns - 1)[at].as_buffer()
    return ids, np.frombuffer(m).reshape(len(ids), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T))


def _indexed(q: DataFrame, bank: DataFrame, k: int, not_self: bool, block_rows: int, meter) -> DataFrame:
    index = cells(bank, block_rows)
    names = sorted(set(index.classes))
    shared = q.sparkSession.sparkContext.broadcast((index.pivots, index.radius, index.first, [np.array([i for i, c in enumerate(index.classes) if c == name]) for name in names]))
    ask = "cell int, only long, but long, n int, ids array<long>, m binary"
    schema = pa.schema([("cell", pa.int32()), ("only", pa.int64()), ("but", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("m", pa.binary())])

    def rows(cell: int, only: int, but: int, ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"cell": [cell], "only": [only], "but": [but], "n": [len(ids)], "ids": [ids.tolist()], "m": [m.tobytes()]}, schema=schema)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query asks the first block of the nearest cell of every class."""
        pivots, _, first, of = shared.value
        for batch in batches:
            ids, m = batch.column(0).to_numpy(), _matrix(batch.column(1)) if batch.num_rows else None
            for at in range(0, len(ids), block_rows):
                d = _distances(m[at : at + block_rows], pivots)
                for own in of:
                    nearest_cell = own[d[:, own].argmin(axis=1)]
                    for cell in np.unique(nearest_cell).tolist():
                        here = at + np.flatnonzero(nearest_cell == cell)
                        yield rows(cell, int(first[cell]), -1, ids[here], m[here])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query asks the blocks that reach within its floors, but for that which it has asked."""
        pivots, radius, first, of = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m, floors = batch.column(0).to_numpy(), _matrix(batch.column(1)), _matrix(batch.column(2))
            for at in range(0, len(ids), block_rows):
                d = _distances(m[at : at + block_rows], pivots)
                for j, own in enumerate(of):
                    floor = floors[at : at + block_rows, j][:, None]
                    reaches = d[:, own] - radius[own] <= floor + SLACK * (1 + d[:, own])
                    was = d[:, own].argmin(axis=1)
                    for i, cell in enumerate(own.tolist()):
                        if first[cell] < 0:
                            continue
                        for again in (False, True):  # of the own cell the first block has been asked
                            here = at + np.flatnonzero(reaches[:, i] & ((was == i) == again))
                            if len(here):
                                yield rows(cell, -1, int(first[cell]) if again else -1, ids[here], m[here])

    names_of = index.classes
    places = index.blocks.select("block", F.col("cell").alias("_cell"))

    def met(asked: DataFrame) -> DataFrame:
        dealt = asked.join(places, (F.col("cell") == F.col("_cell")) & ((F.col("only") < 0) | (F.col("only") == F.col("block"))) & (F.col("but") != F.col("block")))
        own = index.blocks.select("block", "cell", F.lit(0).alias("side"), "n", "ids", "m")
        both = own.unionByName(dealt.select("block", "cell", F.lit(1).alias("side"), "n", "ids", "m")).repartition("block").sortWithinPartitions("block", "side")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                cell, side = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for at in range(batch.num_rows):
                    ids, m = unpacked(batch, at)
                    if side[at] == 0:
                        held = Bank.of(ids, np.array([names_of[cell[at]]] * len(ids), dtype=object), m)
                        continue
                    if meter is not None:
                        meter.add(len(ids) * len(held.ids))
                    for found in _best(held, ids, m, k, not_self):
                        yield _batch(*found)

        return both.mapInArrow(run, _FOUND)

    near = written(met(q.mapInArrow(home, ask)), "home")
    floors = near.groupBy("query", "cls").agg(F.count("*").alias("n"), F.max("distance").alias("floor")).filter(F.col("n") >= k)
    by_class = floors.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("cls", "floor"))).alias("_m"))  # an entry for each class
    far = F.lit(float("inf"))
    floor = F.array(*(F.coalesce(F.col("_m")[c], far) for c in names))
    asked = q.join(by_class, q["_id"] == by_class["query"], "left").select("_id", "f", floor.alias("floors")).mapInArrow(others, ask)
    found = near.unionByName(met(asked)).drop("rank")
    rank = F.row_number().over(Window.partitionBy("query", "cls").orderBy("distance", "neighbour"))
    return written(found.withColumn("rank", rank).filter(F.col("rank") <= k).select(_NAMES), "neighbours")


def mean_distance(queries: DataFrame, bank: DataFrame, k: int, id_col: str, cls: str | None = None, not_self: bool = False) -> DataFrame:
    """query, cls, d: mean distance to the k nearest of each class."""
    return nearest(queries, bank, k, id_col, cls=cls, not_self=not_self).groupBy("query", "cls").agg(F.avg("distance").alias("d"))
