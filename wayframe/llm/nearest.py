"""Exact nearest neighbours of a stated query set by a block matrix join.

Rows and queries are packed into blocks; each pair of a query block and a row block is one tile. In a tile, int8
products give distances with a bound on the quantisation error; only pairs that the bound leaves open are computed
again from the original vectors, in double precision. Heaps merge the nearest rows of the tiles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Steps

#: Vectors in a block of rows and in a block of queries.
ROW_BLOCK = 4096
QUERY_BLOCK = 512
LEVELS = 127.0


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale per vector, and the exact length of what the codes leave out (rounded up)."""
    scale = np.abs(vectors).max(axis=1) / LEVELS
    scale = np.where(scale > 0, scale, 1.0)
    codes = np.clip(np.rint(vectors / scale[:, None]), -LEVELS, LEVELS).astype(np.int8)
    rest = np.sqrt(((vectors - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, rest * (1 + 1e-9) + 1e-12 * scale


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distance of paired rows, components added in their order."""
    total = np.zeros(len(left))
    for k in range(left.shape[1]):
        total += (left[:, k] - right[:, k]) ** 2
    return np.sqrt(total)


def tile_nearest(query_ids, queries, row_ids, rows, k, slack: float = 1e-9):
    """For each query its k nearest rows of this tile (ties: smaller id), without the row of its own id."""
    q_code, q_scale, q_rest = quantised(queries)
    r_code, r_scale, r_rest = quantised(rows)
    # products of int8 codes of up to 1,000 components are whole numbers below 2^24, so float32 holds them exactly
    exact = np.float32 if queries.shape[1] <= 1000 else np.float64
    product = (q_code.astype(exact) @ r_code.astype(exact).T).astype(np.float64)
    q_size = (q_code.astype(np.float64) ** 2).sum(axis=1) * q_scale**2
    r_size = (r_code.astype(np.float64) ** 2).sum(axis=1) * r_scale**2
    about = np.sqrt(np.maximum(q_size[:, None] + r_size[None, :] - 2 * product * q_scale[:, None] * r_scale[None, :], 0))
    # the squares' rounding error, as a length, belongs to the bound too
    spread = q_rest[:, None] + r_rest[None, :] + np.sqrt(slack * (q_size[:, None] + r_size[None, :]))
    own = query_ids[:, None] == row_ids[None, :]
    high = np.where(own, np.inf, about + spread)
    kth = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k else np.full(len(queries), np.inf)
    who, what = np.nonzero((about - spread <= kth[:, None]) & ~own)
    score = distances(queries[who], rows[what])
    order = np.lexsort((row_ids[what], score, who))
    who, what, score = who[order], what[order], score[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    keep = rank < k
    return query_ids[who[keep]], row_ids[what[keep]], score[keep]


def _pack(limit: int):
    """Rows come sorted by (dim, block); gives blocks of at most ``limit`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, values = None, [], []

        def block():
            data = np.concatenate(values)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                 pa.array([data.tobytes()], pa.binary())], ["dim", "block", "ids", "vectors"])

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            dims, blocks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat = batch.column(3).flatten().to_numpy()
            edge = np.concatenate([[0], np.cumsum(dims)])
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(blocks) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(dims)]):
                at = (int(dims[lo]), int(blocks[lo]))
                while lo < hi:
                    if held and (at != key or held >= limit):
                        yield block()
                        ids, values, held = [], [], 0
                    key = at
                    take = min(hi - lo, limit - held)
                    ids.append(batch.column(2).to_numpy()[lo : lo + take])
                    values.append(flat[edge[lo] : edge[lo + take]])
                    held += take
                    lo += take
        if held:
            yield block()

    return run


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids, r_ids = np.frombuffer(blobs[0], np.int64), np.frombuffer(blobs[2], np.int64)
                queries = np.frombuffer(blobs[1], np.float64).reshape(-1, dim)
                rows = np.frombuffer(blobs[3], np.float64).reshape(-1, dim)
                found = tile_nearest(q_ids, queries, r_ids, rows, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    return run


def _merge(k: int):
    """Rows come sorted by query; a heap holds the k nearest of one query at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap = None, []

        def rows():
            best = sorted((-d, -v) for d, v in heap)
            return pa.RecordBatch.from_pydict({
                "query_id": pa.array([query] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                "vec_id": pa.array([v for _, v in best], pa.int64()), "score": pa.array([d for d, _ in best], pa.float64())})

        for batch in batches:
            for q, v, d in zip(*(c.to_pylist() for c in batch.columns)):
                if q != query:
                    if heap:
                        yield rows()
                    query, heap = q, []
                item = (-d, -v)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        if heap:
            yield rows()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query by Euclidean distance, all rows if fewer.

    ``queries`` has the columns of ``vectors``. A row is no neighbour of a query of the same id. Ties go to the
    smaller id. Vectors that are null, zero, or hold null or non-finite components take no part, neither do rows
    without id; vectors meet vectors of their own length only. Repeated ids are rows of their own. Other columns are
    not read. Empty input gives no rows. A tile holds ROW_BLOCK x QUERY_BLOCK products whatever the input's size.
    """
    spark = vectors.sparkSession
    steps = Steps(spark, "nearest")

    def sound(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
        good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        return rows.where(F.col("id").isNotNull() & good).select(F.size("vector").alias("dim"), "id", "vector")

    def blocks(df: DataFrame, limit: int, name: str) -> DataFrame:
        count = max(1, -(-df.count() // limit))
        dealt = df.select("dim", F.pmod(F.xxhash64("id"), F.lit(count)).alias("block"), "id", "vector")
        packed = dealt.repartition("dim", "block").sortWithinPartitions("dim", "block").mapInArrow(_pack(limit), "dim int, block long, ids binary, vectors binary")
        return steps.table(packed, name)

    rows, asked = blocks(sound(vectors), ROW_BLOCK, "rows"), blocks(sound(queries), QUERY_BLOCK, "queries")
    held = rows.groupBy("dim").agg(F.max("block").alias("last"))
    spread = (
        asked.join(held, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("block"), "ids", "vectors")
        .select("dim", "block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    )
    tiles = spread.join(rows, ["dim", "block"]).select("dim", "q_ids", "q_vectors", "ids", "vectors").repartition(F.xxhash64("q_ids", "ids"))
    found = tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score double")
    return (
        found.repartition("query_id").sortWithinPartitions("query_id")
        .mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
    )
