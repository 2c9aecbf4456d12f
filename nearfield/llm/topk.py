"""Exact top-k inner-product search by no-random-access aggregation.

Method: within a block of candidates each dimension is a list sorted by value. For a query the lists are read in
step from the end that is best for the sign of its weight. Every candidate has a lower bound (unread entries at the
list's worst value) and an upper bound (unread entries at the value last read). Reading stops when no candidate
outside the k best lower bounds has an upper bound that reaches them; the final scores of those left are then
resolved from their own entries. Blocks of candidates meet blocks of queries; each pair of blocks gives at most k rows a query.

Arithmetic is exact: integer components with absolute values below 2**20 and up to 4096 dimensions stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema

#: Candidates and queries of one block.
CANDIDATES, QUERIES = 4096, 256
#: Query blocks of at most this size in all are broadcast; beyond it both sides are dealt out by block number.
BROADCAST_BYTES = 16 << 20

_NONE = np.iinfo(np.int64).max
_PACKED = "n int, dims int, ids binary, data binary"


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector or a component is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return F.when(vector.isNotNull() & ~bad, whole)


def _pack(size: int):
    """Rows (id, vector) -> blocks of at most ``size`` vectors of one length, within a task."""
    schema = arrow_schema(_PACKED)

    def emit(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        row = [[len(ids)], [x.shape[1]], [ids.astype("<i8").tobytes()], [x.astype("<i8").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            col = b.column(1)
            lengths = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            for d in np.unique(lengths):
                rows = np.nonzero(lengths == d)[0]
                x = flat[starts[rows][:, None] + np.arange(d)[None, :]]
                got = held.setdefault(int(d), [np.empty(0, np.int64), np.empty((0, int(d)), np.int64)])
                got[0], got[1] = np.concatenate([got[0], ids[rows]]), np.concatenate([got[1], x])
                while len(got[0]) >= size:
                    yield emit(got[0][:size], got[1][:size])
                    got[0], got[1] = got[0][size:], got[1][size:]
        for ids, x in held.values():
            if len(ids):
                yield emit(ids, x)

    return run


def nra_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, rounds: int = 8):
    """The k best (query row, candidate row, score) of each query in one block; itself left out, ties to smaller ids.

    The lists of all dimensions are read in ``rounds`` equal strides of ranks. Bounds of all queries advance together.
    """
    n = len(x)
    by_id = np.argsort(x_ids, kind="stable")
    x, x_ids = x[by_id], x_ids[by_id]
    xf = x.astype(np.float64)
    order = np.argsort(x, axis=0, kind="stable")
    listed = np.take_along_axis(xf, order, axis=0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    worst = up @ listed[0] + down @ listed[-1]  # the least that any candidate can score
    own = q_ids[:, None] == x_ids[None, :]
    seen = np.zeros((len(q), n))  # sum over read entries of w * (value - worst value of its list)
    alive = np.ones(n, bool)
    read = 0
    for r in range(1, rounds + 1):
        upto = n * r // rounds
        # Entries whose rank from the top (weights > 0) or from the bottom (weights < 0) was passed in this stride.
        top = (rank >= n - upto) & (rank < n - read)
        low = (rank < upto) & (rank >= read)
        seen += up @ ((xf - listed[0]) * top).T + down @ ((xf - listed[-1]) * low).T
        read = upto
        if upto >= n:
            break
        lower = worst[:, None] + seen
        lower[own] = -np.inf
        if n <= k + 1:
            continue
        bar = np.partition(lower, n - k, axis=1)[:, n - k]
        # Unread entries are at most the values the heads of the lists have now.
        room_up, room_low = listed[n - upto - 1] - listed[0], listed[upto] - listed[-1]
        unread_top, unread_low = (rank < n - upto) * room_up, (rank >= upto) * room_low
        upper = worst[:, None] + seen + up @ unread_top.T + down @ unread_low.T
        can = (upper >= bar[:, None]) & ~own
        alive = can.any(axis=0)
        if alive.sum() <= max(4 * k, n // 16):
            break
    at = np.nonzero(alive)[0]
    score = q @ x[at].T  # the final scores of those that can still qualify
    for i in range(len(q)):
        s = np.where(own[i, at], -_NONE, score[i])
        best = np.argsort(-s, kind="stable")[: k + 1]
        best = best[s[best] > -_NONE][:k]
        yield i, x_ids[at[best]], s[best]


def _search(k: int):
    schema = arrow_schema("query_id long, vec_id long, score long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                x = np.frombuffer(row["data"], "<i8").reshape(-1, row["dims"])
                q = np.frombuffer(row["q_data"], "<i8").reshape(-1, row["dims"])
                out: list[list] = [[], [], []]
                for i, who, score in nra_block(q, q_ids, x, ids, k):
                    out[0].append(np.full(len(who), q_ids[i]))
                    out[1].append(who)
                    out[2].append(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=schema)

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest inner products with all other rows of ``vectors``.

    Both inputs have a long id and an array of longs; rows with a null in either take no part, nor do pairs of
    different length. Equal scores go to the smaller id; fewer candidates than k give fewer rows; a query's own id is
    no candidate. Ids are taken to be unique. Empty inputs give an empty result.
    """
    ready = lambda df: df.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<long>")).dropna()
    spark = vectors.sparkSession
    x = ready(vectors).mapInArrow(_pack(CANDIDATES), _PACKED).withColumn("block", F.monotonically_increasing_id())
    # The queries may come a few from each file: deal them out into full blocks; how many is known from a count.
    total = ready(queries).agg(F.count("*"), F.max(F.size(vec_col))).head()
    blocks = max(1, -(-total[0] // QUERIES))
    q = (
        ready(queries)
        .repartition(blocks, F.xxhash64(id_col))
        .mapInArrow(_pack(QUERIES), _PACKED)
        .select("dims", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    )
    if total[0] * ((total[1] or 0) + 1) * 8 <= BROADCAST_BYTES:
        pairs = x.join(F.broadcast(q), "dims")
    else:
        q = q.withColumn("q_block", F.pmod(F.xxhash64("q_ids"), F.lit(blocks)))
        salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        x = x.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
        x = x.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        pairs = x.join(q, ["q_block", "salt", "dims"])
    found = pairs.select("dims", "ids", "data", "q_ids", "q_data").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
