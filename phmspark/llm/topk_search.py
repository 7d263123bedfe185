"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt by length into buckets, longest first. A query's k-th best product with the longest vectors is its
first threshold; divided by the query's and a bucket's length it is the least cosine that a vector of that bucket needs.
Above 1, the bucket is left out, before any vector moves. In the others each query takes the way its local threshold
suggests: near 1, few vectors can point close enough, so bounds on the query's two largest coordinates choose them; else
only lengths are cut, and the bucket's longest vectors are multiplied in one block. What remains is multiplied exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phmspark.llm.common import bounded_collect, table, written

_CHUNK = "part long, dim int, n int, longest double, ids binary, vectors binary, lengths binary"
SEED_BYTES = 64_000_000  # of the vectors from which queries get their first thresholds
_SLACK = 1e-9  # of rounding in lengths and cosines; products are exact


def quantised(vectors: DataFrame, id_col: str, vec_col: str, factor: float = 256.0) -> DataFrame:
    """_id, _v (floor(factor * x) as longs), dim and length of the vectors that take part: neither null nor with null or
    non-finite components."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = vectors.filter(fine).select(F.col(id_col).cast("long").alias("_id"), F.transform(x, lambda c: F.floor(F.lit(factor) * c)).alias("_v"))
    return v.withColumn("dim", F.size("_v")).withColumn("length", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def chunked(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors of like dimension and length together, longest first, up to ``rows`` in a row of the result."""
    dealt = vectors.repartitionByRange(F.col("dim"), F.col("length").desc(), F.col("_id")).sortWithinPartitions("dim", F.col("length").desc(), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            ids, vs, ls = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            vs = vs.astype(np.int32) if not len(vs) or np.abs(vs).max() < 2**31 else vs
            out = pa.RecordBatch.from_pydict({"part": [(part << 32) + seq], "dim": [held[0][0]], "n": [len(ids)], "longest": [float(ls.max())], "ids": [ids.tobytes()], "vectors": [vs.tobytes()], "lengths": [ls.tobytes()]}, schema=_arrow_chunk())
            held.clear()
            seq += 1
            return out

        for batch in batches:
            dims = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(cuts, cuts[1:]):
                at = a
                while at < b:
                    if held and (held[0][0] != dims[a] or sum(len(h[1]) for h in held) >= rows):
                        yield flush()
                    end = min(b, at + rows - sum(len(h[1]) for h in held))
                    some = batch.slice(at, end - at)
                    held.append((int(dims[a]), some.column(0).to_numpy(), some.column(1).flatten().to_numpy(), some.column(3).to_numpy()))
                    at = end
        if held:
            yield flush()

    return dealt.select("_id", "_v", "dim", "length").mapInArrow(run, _CHUNK)


def _arrow_chunk() -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("lengths", pa.binary())])


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, dim = row["n"], row["dim"]
    kind = np.int32 if len(row["vectors"]) == 4 * n * dim else np.int64
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], kind).reshape(n, dim), np.frombuffer(row["lengths"], np.float64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where all sums stay below 2**53."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if largest >= 2.0**63:
        exact = a.astype(object) @ b.astype(object).T
        if any(abs(x) >= 2**63 for x in exact.flat):
            raise OverflowError("products beyond 64 bits: vectors are too long for integer scores")
        return exact.astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_bucket(q_ids, q, q_len, floor, ids, v, lengths, k: int, sharp: float = 0.8) -> list[tuple[int, int, int]]:
    """(query, vector, product) of each query's k best in a bucket, but for vectors that cannot reach the query's floor."""
    out: list[tuple[int, int, int]] = []
    longest = float(lengths[0]) if len(lengths) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_len * longest > 0, floor / (q_len * longest), np.where(floor > 0, np.inf, -np.inf))
    live = np.flatnonzero(local <= 1 + _SLACK)
    narrow = live[local[live] >= sharp]
    wide = live[local[live] < sharp]
    if len(narrow):
        unit = v / np.maximum(lengths, 1e-300)[:, None]
        for i in narrow.tolist():
            t, u = min(1.0, float(local[i])), q[i] / q_len[i]
            keep = lengths * q_len[i] >= floor[i] * (1 - _SLACK)
            for f in np.argsort(-np.abs(u))[:2]:
                spread = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f])))
                low = u[f] * t - spread if u[f] > -t else -1.0
                high = u[f] * t + spread if u[f] < t else 1.0
                keep &= (unit[:, f] >= low - 1e-6) & (unit[:, f] <= high + 1e-6)
            at = np.flatnonzero(keep & (ids != q_ids[i]))
            s = _products(q[i : i + 1], v[at])[0]
            out += [(int(q_ids[i]), int(ids[at[j]]), int(s[j])) for j in _best(s, ids[at], k)]
    if len(wide):
        reach = np.where(floor[wide] > 0, floor[wide] * (1 - _SLACK) / np.maximum(q_len[wide], 1e-300), -1.0)
        m = np.searchsorted(-lengths, -reach, side="right")  # lengths fall
        s = _products(q[wide], v[: int(m.max())])
        for r, i in enumerate(wide.tolist()):
            own = ids[: m[r]]
            at = np.flatnonzero(own != q_ids[i])
            out += [(int(q_ids[i]), int(own[at[j]]), int(s[r, at[j]])) for j in _best(s[r, at], own[at], k)]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", bucket_rows: int = 16384, query_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (a row where ``is_query`` of ``_id`` holds) its ``k`` largest integer
    inner products with all other rows, ties to smaller ids; all of them, if there are fewer.

    Rows with a null id, and vectors null or with null or non-finite components, take no part. Repeated rows (of one id
    and vector) are candidates each, and one query; rows of one id with different vectors are rows of their own, as
    queries and as candidates; rows of the query's own id are never found. Vectors of another dimension than the query's are no candidates. Scores
    beyond 64 bits raise OverflowError. Other columns are not read; an empty table gives no rows. Buckets and query
    blocks meet over one shuffle on the bucket, the bucket's row first, so a task holds one bucket and one block. Only
    one bucket for each dimension is broadcast (in all at most SEED_BYTES; queries of other dimensions start without a
    threshold), and one row of numbers for each bucket if those are at most a million.
    """
    rows = written(quantised(vectors, id_col, vec_col), "vectors")
    buckets = written(chunked(rows, bucket_rows), "buckets")
    first = buckets.groupBy("dim").agg(F.max_by(F.struct("part", "n"), F.struct("longest", "n")).alias("x"), F.sum("n").alias("rows"))
    kept, size = [], 0
    for r in first.select("dim", "x.part", "x.n", "rows").orderBy(F.desc("rows"), "dim").limit(1000).collect():
        size += 8 * r["n"] * (r["dim"] + 2)
        if size <= SEED_BYTES:
            kept.append(r["part"])
    seeds = {r["dim"]: _open(r.asDict()) for r in bounded_collect(buckets.filter(F.col("part").isin(kept)), 1000)}
    shared = vectors.sparkSession.sparkContext.broadcast(seeds)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query blocks with each query's k-th best product in the bucket of the longest vectors, and the least length
        that any of the block's queries still looks for."""
        for batch in batches:
            floor, reach = [], []
            for row in batch.to_pylist():
                q_ids, q, q_len = _open(row)
                f = np.full(len(q_ids), -np.inf)
                ids, v, _ = shared.value.get(row["dim"], (np.empty(0, np.int64), np.empty((0, row["dim"]), np.int32), None))
                s = _products(q, v)
                for i in range(len(q_ids) if len(ids) else 0):
                    own = s[i, ids != q_ids[i]]
                    if len(own) >= k:
                        f[i] = np.partition(own, len(own) - k)[len(own) - k]
                floor.append(f.tobytes())
                reach.append(float(np.min(np.where(f > 0, f / np.maximum(q_len, 1e-300), -1.0))) * (1 - _SLACK))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor, pa.binary()), pa.array(reach, pa.float64())], names=[*batch.schema.names, "floor", "reach"])

    blocks = chunked(rows.filter(is_query).dropDuplicates(["_id", "_v"]), query_rows).mapInArrow(floors, _CHUNK + ", floor binary, reach double")
    sizes = buckets.select(F.col("part").alias("bucket"), F.col("dim").alias("b_dim"), F.col("longest").alias("b_longest"))
    sizes = F.broadcast(sizes) if sizes.count() <= 1_000_000 else sizes
    asked = blocks.join(sizes, (F.col("dim") == F.col("b_dim")) & (F.col("b_longest") >= F.col("reach")))
    asked = asked.select("bucket", F.lit(1).alias("kind"), "dim", "n", "ids", "vectors", "lengths", "floor")
    held = buckets.select(F.col("part").alias("bucket"), F.lit(0).alias("kind"), "dim", "n", "ids", "vectors", "lengths", F.lit(None).cast("binary").alias("floor"))
    met = held.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "kind")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = None
        for batch in batches:
            for j in range(batch.num_rows):
                row = batch.slice(j, 1).to_pylist()[0]
                if row["kind"] == 0:
                    bucket = _open(row)
                    continue
                found = search_bucket(*_open(row), np.frombuffer(row["floor"], np.float64), *bucket, k)
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(multiply, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 as a query, against all others; what takes no part is said at ``top_k``."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("_id") % 50 == 0)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0))
WHERE rank <= 5
"""
