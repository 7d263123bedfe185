"""Discovery of new classes: quarantine, density clustering, adoption, pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phmspark.operators import neighbours, openset, quantiles, ranking
from phmspark.sources.scratch import written

# Rows needed, least cluster, neighbours for core distances, of the density ladder's steps.
LADDER = ((25, 25, 3), (75, 15, 3), (100, 10, 2))
SEGMENT = 1 << 18  # edges of the spanning forest that one task merges
BESIDE_ROWS = 2048  # rows that one task clusters


def quarantine(scored: DataFrame, f: str = "f", margin: float = 2.0) -> DataFrame:
    """Rows scored above (not at) the margin, equal vectors once (the smallest id), with the number of attempts."""
    far = scored.filter(F.col("score") > margin)
    return far.groupBy(f).agg(F.min(F.struct("vec_id", "label", "score")).alias("x"), F.count("*").alias("attempts")).select("x.*", f, "attempts")


def attempts(held: DataFrame, order: str, least: int = 25, every: int = 10) -> DataFrame:
    """``held`` with n, each row's number in the quarantine in the order of arrival, and attempt: whether clustering is
    tried at it, with at least ``least`` rows held and ``every`` of them new since the last attempt."""
    return ranking.placed(held, [order]).withColumn("attempt", (F.col("n") >= least) & ((F.col("n") - least) % every == 0))


BLOCK_ROWS = 1024  # rows of a block of the spanning tree; a task holds two


def _tree_of(ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, w: minimum spanning tree of rows under mutual reachability, by growing it row by row. The last component of
    a row is its core distance. Rows that are inside are put away from time to time."""
    x, core, left = m[:, :-1], m[:, -1], ids
    n, at = len(ids), 0
    least, to, out = np.full(n, np.inf), np.full(n, ids[0], np.int64), np.ones(n, dtype=bool)
    a, b, w = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.empty(n - 1)
    for k in range(n - 1):
        out[at] = False
        here, reach, name = x[at], core[at], left[at]
        if 4 * (n - k - 1) < 3 * len(x):
            x, core, left, least, to = x[out], core[out], left[out], least[out], to[out]
            out = np.ones(len(x), dtype=bool)
        d = np.maximum(np.maximum(core, reach), np.sqrt(((x - here) ** 2).sum(axis=1)))
        closer = out & (d < least)
        least[closer], to[closer] = d[closer], name
        at = int(np.where(out, least, np.inf).argmin())
        a[k], b[k], w[k] = left[at], to[at], least[at]
    return np.minimum(a, b), np.maximum(a, b), w


def _edges(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in _tree_of(ids, m)], names=["a", "b", "w"])


def _needed(index: neighbours.Cells, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of cells between which an edge may be in the tree. Pivots are rows, so a row reaches any other over its own
    pivot, pivots, and the other's pivot; a pair of cells whose least possible weight is above the heaviest edge of the
    best such way has no edge in the tree. ``low``, ``high``: least and largest core distance in a cell."""
    there = np.flatnonzero(index.first >= 0)
    p, r, low, high = index.pivots[there], index.radius[there], low[there], high[there]
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)) if len(p) <= 64 else neighbours._distances(p, p)
    over = np.maximum(d, np.maximum(high[:, None], high[None]))
    n = len(there)
    way, inside, least, to = np.zeros((n, n)), [0], over[0].copy(), np.zeros(n, np.int64)
    left = set(range(1, n))
    while left:  # the heaviest edge of the ways in the pivots' own tree
        k = min(left, key=lambda x: least[x])
        left.remove(k)
        way[k, inside] = way[inside, k] = np.maximum(way[to[k], inside], least[k])
        inside.append(k)
        closer = over[k] < least
        least[closer], to[closer] = over[k][closer], k
    own = np.maximum(r, high)
    best = np.maximum(way, np.maximum(own[:, None], own[None]))
    floor = np.maximum(d - r[:, None] - r[None], np.maximum(low[:, None], low[None]))
    a, b = np.nonzero(np.triu(floor <= best * (1 + neighbours.SLACK) + neighbours.SLACK))
    return list(zip(there[a].tolist(), there[b].tolist(), strict=True))


def spanning_edges(rows: DataFrame, id_col: str, min_samples: int, block_rows: int = BLOCK_ROWS, meter=None, segment: int = SEGMENT) -> DataFrame:
    """a, b, w: minimum spanning tree under mutual reachability (the largest of the two core distances and the distance),
    of all pairs of rows. The core distance is that to the ``min_samples``-th nearest row, the row itself the first.

    Rows are dealt to blocks around pivots. Every two blocks that may share an edge of the tree give the tree of their
    rows; whatever edge joins two rows, one of these trees joins them by edges no heavier, so the tree of those trees'
    edges is the whole's. ``meter``, an accumulator, adds up the pairs of rows that were compared."""
    near = neighbours.nearest(rows, rows, max(1, min_samples - 1), id_col, not_self=True)
    core = near.groupBy(F.col("query").alias("_id")).agg(F.max("distance").alias("core"))
    own = rows.select(F.col(id_col).cast("long").alias("_id"), "f").join(core, "_id", "left")
    own = written(own.select("_id", F.lit("").alias("_c"), F.concat("f", F.array(F.coalesce("core", F.lit(0.0)))).alias("f")), "cores")
    n = own.count()
    if n <= block_rows:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(x.column(0).to_numpy(), neighbours._matrix(x.column(2))) for x in batches if x.num_rows]
            if held:
                yield _edges(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

        return written(own.coalesce(1).mapInArrow(whole, "a long, b long, w double"), "tree")
    index = neighbours.cells(own, block_rows, aside=1)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                c = neighbours.unpacked(batch, at)[1][:, -1]
                yield pa.RecordBatch.from_pydict({"cell": [batch.column(0)[at].as_py()], "low": [float(c.min())], "high": [float(c.max())]}, schema=pa.schema([("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))

    low, high = np.zeros(len(index.pivots)), np.zeros(len(index.pivots))
    for r in index.blocks.select("cell", "ids", "m").mapInArrow(cores, "cell int, low double, high double").groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
    wanted = rows.sparkSession.createDataFrame(_needed(index, low, high), "x int, y int")
    at = index.blocks.select("block", "cell")
    pairs = wanted.join(at.select(F.col("cell").alias("x"), F.col("block").alias("a")), "x").join(at.select(F.col("cell").alias("y"), F.col("block").alias("b")), "y")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    other = pairs.join(index.blocks.withColumnRenamed("block", "b"), "b").select("a", F.lit(1).alias("side"), "n", "ids", "m")
    met = index.blocks.select(F.col("block").alias("a"), F.lit(0).alias("side"), "n", "ids", "m").unionByName(other).repartition("a").sortWithinPartitions("a", "side")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            side = batch.column(0).to_numpy()
            for at in range(batch.num_rows):
                mine = neighbours.unpacked(batch, at)
                if side[at] == 0:
                    first = mine
                    yield _edges(*mine)
                    continue
                if meter is not None:
                    meter.add(len(first[0]) * len(mine[0]))
                yield _edges(np.concatenate((first[0], mine[0])), np.concatenate((first[1], mine[1])))

    edges = met.select("side", "n", "ids", "m").mapInArrow(trees, "a long, b long, w double")
    if 2 * n <= segment:
        return lightest(written(edges, "edges"), segment)
    edges = written(edges.groupBy("a", "b").agg(F.min("w").alias("w")), "edges")
    return grown(edges, own.select(F.col("_id").alias("node")))[0]


def _forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of the minimum spanning forest, equal weights in the order of a and b."""
    ends = np.unique(np.concatenate((a, b)), return_inverse=True)[1]
    up, kept = list(range(int(ends.max(initial=-1)) + 1)), []
    order = np.lexsort((b, a, w))
    for k, x, y in zip(order.tolist(), ends[: len(a)][order].tolist(), ends[len(a) :][order].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def lightest(edges: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The minimum spanning forest of edges (a, b, w; a written table) between at most half of ``segment`` nodes. Runs of
    ``segment`` edges leave their own forests, at most half of them, until one run holds the rest: an edge that is not in the
    forest of a part is not in that of the whole."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from t.take(pa.array(_forest(*(c.to_numpy() for c in t.columns)))).to_batches()

    while (runs := -(-edges.count() // segment)) > 1:
        edges = written(edges.repartition(runs).mapInArrow(own, "a long, b long, w double"), "edges")
    return written(edges.coalesce(1).mapInArrow(own, "a long, b long, w double"), "tree")


def grown(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, w) of the minimum spanning forest, and node, c: the tree of each node. Boruvka rounds: each takes
    every component's least edge outward."""
    label = written(nodes.select("node", F.col("node").alias("c")), "labels")
    tree = edges.select("a", "b", "w").limit(0)
    for _ in range(40):  # halves the components each round
        la, lb = label.select(F.col("node").alias("a"), F.col("c").alias("x")), label.select(F.col("node").alias("b"), F.col("c").alias("y"))
        out = edges.join(la, "a").join(lb, "b").filter("x <> y")
        both = out.select(F.col("x").alias("c"), F.struct("w", "a", "b", F.col("y").alias("to")).alias("e")).unionByName(out.select(F.col("y").alias("c"), F.struct("w", "a", "b", F.col("x").alias("to")).alias("e")))
        least = written(both.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"), "least")
        if least.isEmpty():
            break
        tree = tree.unionByName(least.select("a", "b", "w").distinct())
        hooks = least.select("c", "to")
        parent = hooks.join(hooks.select(F.col("c").alias("to"), F.col("to").alias("back")), "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"))
        parent = written(parent, "parents")
        while True:  # pointers double until each shows its root
            up = written(parent.join(parent.select(F.col("c").alias("p"), F.col("p").alias("g")), "p", "left").select("c", F.coalesce("g", "p").alias("p")), "parents")
            if up.join(parent, ["c", "p"], "left_anti").isEmpty():
                break
            parent = up
        label = written(label.join(parent, "c", "left").select("node", F.coalesce("p", "c").alias("c")), "labels")
    return tree, label


def segmented(tree: DataFrame, segment: int) -> DataFrame:
    """seg, w, a, b, x, sx, y, sy: the tree's edges in runs of ``segment`` by weight, with the component (its smallest
    row, and its rows) that holds either end before the run begins. Runs are halved level by level: the trees of every
    lower half become the nodes of its upper half, all runs at once."""
    n = tree.count()
    spread = written(tree.select("w", "a", "b").repartitionByRange("w", "a", "b").withColumn("_p", F.spark_partition_id()), "ordered")
    sums = spread.groupBy("_p").agg(F.count("*").alias("_n"))
    sums = sums.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_from"))  # a row for each partition
    place = F.col("_from") + F.row_number().over(Window.partitionBy("_p").orderBy("w", "a", "b")) - 1
    edges = spread.join(F.broadcast(sums), "_p").select(F.floor(place / segment).cast("long").alias("seg"), "w", "a", "b", F.col("a").alias("x"), F.lit(1).cast("long").alias("sx"), F.col("b").alias("y"), F.lit(1).cast("long").alias("sy"))
    edges = written(edges, "segments")
    for bit in reversed(range(max(0, -(-n // segment) - 1).bit_length())):
        g = F.shiftright("seg", bit + 1)
        upper = F.shiftright("seg", bit).bitwiseAND(1) == 1
        low = edges.filter(~upper).select("w", F.struct(g.alias("g"), F.col("x").alias("id")).alias("a"), F.struct(g.alias("g"), F.col("y").alias("id")).alias("b"), "sx", "sy")
        nodes = written(low.select(F.col("a").alias("node"), F.col("sx").alias("s")).unionByName(low.select(F.col("b").alias("node"), F.col("sy").alias("s"))).distinct(), "nodes")
        _, label = grown(written(low.select("w", "a", "b"), "low"), nodes)
        whole = label.join(nodes, "node").groupBy("c").agg(F.min("node.id").alias("to"), F.sum("s").alias("ts"))
        moved = written(label.join(whole, "c").select(F.col("node.g").alias("g"), F.col("node.id").alias("id"), "to", "ts"), "moved")
        high = edges.filter(upper).withColumn("g", g)
        for x, s in (("x", "sx"), ("y", "sy")):
            high = high.join(moved.withColumnRenamed("id", x), ["g", x], "left").withColumn(x, F.coalesce("to", x)).withColumn(s, F.coalesce("ts", s)).drop("to", "ts")
        edges = written(edges.filter(~upper).unionByName(high.drop("g")), "segments")
    return edges


_MERGED = "x long, s long, tx long, ts long, frag long, first double, mass double, last double, up long, side int"


def merge_segment(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """What one run of edges does to the hierarchy. Rows without mass: component (x, s) of under ``least`` rows went
    into component (tx, ts), or into fragment frag. Rows with mass: a fragment of a cluster: the component it began as
    (null: it was born here), the densities of its first and last merge, its rows times density between them, and
    either the component it still is (tx, ts) or the fragment ``up`` that it ended in."""
    base = int(pdf["seg"].iloc[0]) << 32
    pdf = pdf.sort_values(["w", "a", "b"])
    at: dict[int, int] = {}
    up: list[int] = []
    size: list[int] = []
    name: list[int] = []
    own: list[list[tuple[int, int]]] = []  # components of under ``least`` rows that a small root is of
    frag: list[int] = []  # of a root with ``least`` rows or more
    frags: list[list] = []  # x, s, tx, ts, first, mass, last, up, side, rows now
    links: list[tuple] = []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def node(x: int, s: int) -> int:
        k = at.get(x)
        if k is None:
            k = at[x] = len(up)
            up.append(k)
            size.append(s)
            name.append(x)
            own.append([(x, s)] if s < least else [])
            frag.append(-1)
            if s >= least:
                frag[k] = len(frags)
                frags.append([x, s, None, None, None, 0.0, None, None, 0, s])
        return root(k)

    def lower(f: list, density: float) -> None:
        if f[4] is None:
            f[4] = f[6] = density
        f[5] += f[9] * (f[6] - density)
        f[6] = density

    for w, x, sx, y, sy in zip(*(pdf[c].tolist() for c in ("w", "x", "sx", "y", "sy")), strict=True):
        density = min(1 / w, 1e12) if w > 0 else 1e12
        a, b = node(x, sx), node(y, sy)
        both, k = size[a] + size[b], -1
        if frag[a] >= 0 and frag[b] >= 0:
            k = len(frags)
            for side, r in enumerate((a, b)):
                lower(frags[frag[r]], density)
                frags[frag[r]][7:9] = [k, side]
            frags.append([None, None, None, None, density, 0.0, density, None, 0, both])
        elif frag[a] >= 0 or frag[b] >= 0:
            k = max(frag[a], frag[b])
            lower(frags[k], density)
            frags[k][9] = both
        elif both >= least:
            k = len(frags)
            frags.append([None, None, None, None, density, 0.0, density, None, 0, both])
        small = own[a] + own[b]
        if k >= 0:
            links += [(*c, None, None, base + k, None, None, None, None, None) for c in small]
            small = []
        if size[a] < size[b]:
            a, b = b, a
        up[b] = a
        size[a], name[a], own[a], frag[a] = both, min(name[a], name[b]), small, k
        own[b] = []
    for k in range(len(up)):
        if up[k] == k:
            links += [(*c, name[k], size[k], None, None, None, None, None, None) for c in own[k]]
            if frag[k] >= 0:
                frags[frag[k]][2:4] = [name[k], size[k]]
    rows = links + [(*f[:4], base + k, *f[4:7], None if f[7] is None else base + f[7], f[8]) for k, f in enumerate(frags)]
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _MERGED.split(", ")])
    return out.astype({c: "Int64" for c in ("x", "s", "tx", "ts", "frag", "up", "side")} | {c: "float64" for c in ("first", "mass", "last")})


def select_fragments(pdf: pd.DataFrame) -> pd.DataFrame:
    """frag, cluster: by excess of mass over the clusters that the fragments make up; the whole is never a cluster."""
    pdf = pdf.sort_values("frag").astype(object).where(pdf.sort_values("frag").notna(), None)
    of: dict[int, int] = {}  # fragment: its cluster; what a cluster came from is numbered before it
    mass: list[float] = []
    last: list[float] = []
    inner: list[list[tuple[int, int]]] = []
    still: dict[tuple[int, int], int] = {}
    below: dict[int, list[tuple[int, int]]] = {}
    for x, s, tx, ts, frag, first, m, end, up, side in zip(*(pdf[c.split()[0]].tolist() for c in _MERGED.split(", ")), strict=True):
        if x is None:
            c = len(mass)
            mass.append(0.0)
            last.append(end)
            inner.append([k for _, k in sorted(below.pop(frag, []))])
        else:
            c = still.pop((x, s))
            mass[c] += s * (last[c] - first)
        last[c] = end
        of[frag] = c
        mass[c] += m
        if up is None:
            still[tx, ts] = c
        else:
            below.setdefault(up, []).append((side, c))
    best, chosen = list(mass), [False] * len(mass)
    for c in range(len(mass)):
        under = sum(best[k] for k in inner[c])
        chosen[c] = not inner[c] or mass[c] >= under
        best[c] = max(mass[c], under)
    number, label = 0, [-1] * len(mass)
    todo = [k for c in still.values() for k in inner[c]]
    for c in todo:
        if chosen[c]:
            inside = [c]
            for k in inside:
                label[k] = number
                inside += inner[k]
            number += 1
        else:
            todo += inner[c]
    return pd.DataFrame([(f, label[c]) for f, c in of.items() if label[c] >= 0], columns=["frag", "cluster"]).astype({"frag": "int64", "cluster": "int32"})


def density_clusters(rows: DataFrame, id_col: str, least: int, min_samples: int, segment: int = SEGMENT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, cluster of clustered rows; ``least`` is 2 or more. Neighbours, spanning tree and the runs of its edges are
    jobs; a task merges one run of ``segment`` edges."""
    return clusters_of(spanning_edges(rows, id_col, min_samples, block_rows), least, segment).withColumnRenamed("node", id_col)


def clusters_of(tree: DataFrame, least: int, segment: int = SEGMENT) -> DataFrame:
    """node, cluster of a spanning tree. What meets in one task is a row for each component of ``least`` rows or more
    in each run that changes it."""
    done = written(segmented(tree, segment).groupBy("seg").applyInPandas(lambda pdf: merge_segment(pdf, least), _MERGED), "merged")
    chosen = done.filter("mass IS NOT NULL").groupBy().applyInPandas(select_fragments, "frag long, cluster int")
    links = done.filter("mass IS NULL").select("x", "s", "tx", "ts", "frag")
    found, now = None, links.filter("s = 1").select(F.col("x").alias("node"), "tx", "ts", "frag")
    for _ in range(least):  # a component grows by a row at least, and is small for that long
        some = now.filter("frag IS NOT NULL").select("node", "frag")
        found = some if found is None else found.unionByName(some)
        rest = now.filter("frag IS NULL").select("node", F.col("tx").alias("x"), F.col("ts").alias("s"))
        now = written(rest.join(links, ["x", "s"]).select("node", "tx", "ts", "frag"), "climbed")
        if now.isEmpty():
            break
    return found.join(chosen, "frag").select("node", "cluster")


def clusters_beside(ids: np.ndarray, x: np.ndarray, least: int, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Clustered ids and their clusters, as ``density_clusters`` gives them, of a few rows that one task holds."""
    none = np.empty(0, np.int64)
    if len(ids) < 2:
        return none, none
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    bank, core = neighbours.Bank.of(ids, np.array([""] * len(ids), dtype=object), x), np.zeros(len(ids))
    for at in range(0, len(ids), BLOCK_ROWS):
        for query, _, _, _, d in neighbours._best(bank, ids[at : at + BLOCK_ROWS], x[at : at + BLOCK_ROWS], max(1, min_samples - 1), True):
            np.maximum.at(core, np.searchsorted(ids, query), d)
    a, b, w = _tree_of(ids, np.column_stack((x, core)))
    merged = merge_segment(pd.DataFrame({"seg": 0, "w": w, "a": a, "b": b, "x": a, "sx": 1, "y": b, "sy": 1}), least)
    whole = merged[merged["mass"].notna()]
    if not len(whole):
        return none, none
    links = merged[merged["mass"].isna() & merged["frag"].notna()][["x", "frag"]].astype("int64")
    found = links.merge(select_fragments(whole), on="frag")
    return found["x"].to_numpy(), found["cluster"].to_numpy()


def first_candidate(held: DataFrame, ends: list[int], order: str, least: int = 25, ladder: tuple = LADDER) -> tuple[int, DataFrame] | None:
    """The first of ``ends`` at which the rows (vec_id, f) of ``held`` up to it by ``order`` have a candidate, and its
    vec_ids; None if none has. The ends are the keys of one job; each has at most ``BESIDE_ROWS`` rows."""

    def tried(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, top = pdf["vec_id"].to_numpy(), np.stack(pdf["f"].to_numpy()), np.empty(0, np.int64)
        for needed, smallest, min_samples in ladder:
            if len(ids) < needed:
                break
            rows, cluster = clusters_beside(ids, x, smallest, min_samples)
            sizes = np.bincount(cluster) if len(rows) else np.zeros(1, np.int64)
            if sizes.max() >= least:  # the smaller number first
                top = rows[cluster == sizes.argmax()]
                break
        return pd.DataFrame({"end": pdf["end"].iloc[0], "vec_id": top})

    dealt = held.select("vec_id", "f", F.explode(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e >= F.col(order))).alias("end"))
    found = written(dealt.repartition(len(ends), "end").groupBy("end").applyInPandas(tried, "end long, vec_id long"), "candidates")
    first = found.agg(F.min("end")).first()[0]
    return None if first is None else (first, found.filter(F.col("end") == first).select("vec_id"))


def largest(clusters: DataFrame, least: int) -> DataFrame:
    """Rows of the largest cluster of at least ``least`` rows, ties to the smaller number."""
    top = clusters.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= least).agg(F.min(F.struct((-F.col("n")).alias("m"), "cluster")).alias("t")).select("t.cluster")
    return clusters.join(F.broadcast(top), "cluster", "left_semi")  # one row


def candidate(held: DataFrame, least: int = 25, ladder: tuple = LADDER) -> tuple[DataFrame, DataFrame]:
    """vec_id, cluster of the last step of the ladder that was tried, and of its largest cluster. The first step with a
    cluster of ``least`` rows ends the ladder; a step is tried only on as many rows as it needs."""
    n, clusters = held.count(), held.select("vec_id", F.lit(0).alias("cluster")).limit(0)
    top = clusters
    for needed, smallest, min_samples in ladder:
        if n < needed:
            break
        clusters = written(density_clusters(held.select("vec_id", "f"), "vec_id", smallest, min_samples), "clusters")
        top = written(largest(clusters, least), "candidate")
        if not top.isEmpty():
            break
    return clusters, top


def adopt(candidate: DataFrame, boundary: float, needed: int = 5) -> tuple[str, int]:
    """rejected (median score not above the known boundary), insufficient (under ``needed`` rows) or adopted."""
    n = candidate.count()
    median = quantiles.exact_quantiles(candidate, [], "score", [0.5]).first()
    return ("rejected" if median and median["x"] <= boundary else "insufficient" if n < needed else "adopted"), n


def refit(adopted: DataFrame, rest: DataFrame, k: int = 5) -> DataFrame:
    """vec_id, score, nearest, verdict of ``rest`` (vec_id, f, score under the classes known before), once ``adopted``
    (vec_id, f) is a class too: its training rows are the bank, its calibration rows give the threshold."""
    new = F.lit("discovered-1")
    own = written(ranking.with_role(adopted.select("vec_id", "f", new.alias("cls")), ["cls"], "vec_id").select("vec_id", "f", "cls", "role"), "adopted")
    asked = rest.select("vec_id", "f").unionByName(own.filter("role = 'cal'").select("vec_id", "f"))
    d = written(neighbours.mean_distance(asked, own.filter("role = 'train'"), k, "vec_id", cls="cls", not_self=True).withColumnRenamed("query", "vec_id"), "distances")
    t = openset.thresholds(d.join(own.filter("role = 'cal'").select("vec_id"), "vec_id"), "cls", "d")
    told = openset.decide(d, t, "vec_id", "cls", "d").select("vec_id", F.col("score").alias("_new"))
    score = F.least("score", "_new")
    near = F.when(score <= 1, F.when(F.col("_new") <= F.col("score"), new).otherwise("known"))
    return rest.select("vec_id", "score").join(told, "vec_id").select("vec_id", score.alias("score"), near.alias("nearest"), F.when(score > 1, "unknown").otherwise("known").alias("verdict"))


def pruned(held: DataFrame, rescored: DataFrame, margin: float = 2.0) -> DataFrame:
    """What stays in quarantine after a refit: rows still unknown and still above the margin."""
    gone = rescored.filter(F.col("nearest").isNotNull() & (F.col("verdict") == "known") | (F.col("score") <= margin)).select("vec_id")
    return held.join(gone, "vec_id", "left_anti")
