"""Nearest neighbours by a block matrix join.

Queries and candidates are packed into blocks, in the precision of their column. In a tile every vector gets int8 codes (one scale
a vector) and the norm of what the codes leave out. Each query block meets each candidate block in one tile, by an equi-join on tile coordinates: query blocks
are copied to every candidate group and candidate blocks to every query block, so that no task gathers a side. In a tile,
the product of the codes gives each distance with a bound of its error (the sum of both vectors' quantisation errors);
only pairs whose least possible distance is within the k-th largest possible one are recomputed in double precision. Heaps merge tiles in
a task, then tasks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as a query
nor as a candidate; vectors of another length than the query's aren't its candidates. A vec_id that occurs in several rows
counts once for a query, at its least distance; rows with the query's own id are no candidates. A query with no candidates
has no rows. Ties go to the smaller id. Vectors so large that squares overflow are compared exactly; a distance that overflows is infinite.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsymbol.llm.common import materialise

QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 4096
#: Queries of a tile that are compared at once.
AT_ONCE = 512
#: Candidate blocks that share a copy of a query block.
GROUP = 4

_BLOCK = "dim int, n int, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score double"


def _usable(vector: str):
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def _pack(df: DataFrame, rows: int, form: str) -> DataFrame:
    """(dim, n, ids, vectors): up to `rows` vectors of one length from one partition in a row, as numbers of that form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int):
            ids, vectors = zip(*held.pop(dim), strict=True)
            return dim, len(ids), np.array(ids, "<i8").tobytes(), np.array(vectors, form).tobytes()

        def out(blocks: list) -> pa.RecordBatch:
            dim, n, ids, vectors = zip(*blocks, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(dim, pa.int32()), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array(vectors, pa.binary())], names=["dim", "n", "ids", "vectors"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = held.setdefault(len(v), [])
                mine.append((i, v))
                if len(mine) >= rows:
                    yield out([block(len(v))])
        if held:
            yield out([block(dim) for dim in list(held)])

    return df.mapInArrow(run, _BLOCK)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the norm of the rest."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(v - codes * scale[:, None], axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, components added in order."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        d = a[:, k] - b[:, k]
        total += d * d
    return np.sqrt(total)


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: ids and distances of the candidates in this tile that can be among its k nearest."""
    cc, cs, ce = quantise(c)
    wide, cn = cc.T.astype(np.float64), (cc.astype(np.int64) ** 2).sum(1) * cs**2
    spare = len(c_ids) - len(np.unique(c_ids))
    last = min(k + spare, len(c_ids)) - 1
    for begin in range(0, len(q), AT_ONCE):
        mine, ids = q[begin : begin + AT_ONCE], q_ids[begin : begin + AT_ONCE]
        qc, qs, qe = quantise(mine)
        qn = (qc.astype(np.int64) ** 2).sum(1) * qs**2
        # int8 products add up exactly in float64
        near = np.sqrt(np.maximum(qn[:, None] + cn - 2 * (qc.astype(np.float64) @ wide) * qs[:, None] * cs, 0))
        # besides quantisation, the square root of a difference of sums of squares may be off by rounding
        slack = qe[:, None] + ce + 1e-7 * np.sqrt(qn[:, None] + cn)
        own = ids[:, None] == c_ids
        low, high = near - slack, near + slack
        low[np.isnan(low)], high[np.isnan(high) | own] = -np.inf, np.inf
        bound = np.partition(high, last, axis=1)[:, last]
        for i, live in enumerate((low <= bound[:, None]) & ~own):
            live = np.flatnonzero(live)
            if len(live):
                yield ids[i], c_ids[live], exact(np.broadcast_to(mine[i], (len(live), mine.shape[1])), c[live])


def _merge(best: dict[int, dict[int, float]], query: int, ids, scores, k: int) -> None:
    mine = best.setdefault(int(query), {})
    for i, s in zip(ids.tolist(), scores.tolist(), strict=True):
        if i not in mine or s < mine[i]:
            mine[i] = s
    if len(mine) > 4 * k:
        best[int(query)] = dict(heapq.nsmallest(k, mine.items(), key=lambda x: (x[1], x[0])))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest candidates."""
    single = all(df.schema[vector].dataType.elementType == T.FloatType() for df in (vectors, queries))
    number, form = ("float", "<f4") if single else ("double", "<f8")
    pick = lambda df: df.filter(_usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast(f"array<{number}>"))
    n_queries = max(1, -(-queries.filter(F.col(key).isNotNull()).count() // QUERY_BLOCK))
    q = _pack(pick(queries).repartition(n_queries), QUERY_BLOCK, form).withColumn("q", F.monotonically_increasing_id())
    q = materialise(q, "ann-queries")  # ids of blocks must not change when a task runs again
    c = materialise(_pack(pick(vectors), CANDIDATE_BLOCK, form).withColumn("g", F.floor(F.monotonically_increasing_id() / GROUP)), "ann-candidates")
    # coordinates of the tiles: one small row for each pair of a query block and a group of candidate blocks
    groups = c.select("g", F.col("dim").alias("c_dim")).distinct().groupBy("c_dim").agg(F.collect_list("g").alias("gs"))
    left = q.join(groups, q.dim == groups.c_dim).select("dim", "q", F.explode("gs").alias("g"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    blocks = q.select("q", F.col("dim").alias("q_dim")).groupBy("q_dim").agg(F.collect_list("q").alias("qs"))
    right = c.join(blocks, c.dim == blocks.q_dim).select("dim", F.explode("qs").alias("q"), "g", F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))
    tiles = left.join(right, ["dim", "q", "g"]).select("dim", "q_ids", "q_vectors", "c_ids", "c_vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore", invalid="ignore")  # squares that overflow are compared exactly
        best: dict[int, dict[int, float]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dim, q_ids, q_vectors, c_ids, c_vectors = (col[row].as_py() for col in batch.columns)
                a, b = (np.frombuffer(x, form).reshape(-1, dim).astype(np.float64) for x in (q_vectors, c_vectors))
                for query, ids, score in tile(np.frombuffer(q_ids, "<i8"), a, np.frombuffer(c_ids, "<i8"), b, k):
                    _merge(best, query, ids, score, k)
                if len(best) > 50_000:
                    yield found(best)
                    best = {}
        if best:
            yield found(best)

    def found(best: dict[int, dict[int, float]]) -> pa.RecordBatch:
        rows = [(query, i, s) for query, mine in best.items() for i, s in heapq.nsmallest(k, mine.items(), key=lambda x: (x[1], x[0]))]
        a, b, s = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    partial = tiles.mapInArrow(run, _FOUND).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    # at most k rows of each task that saw the query reach this heap
    nearest = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    return partial.groupBy("query_id").agg(nearest.alias("best")).select("query_id", F.posexplode("best").alias("pos", "one")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))
