"""Exact top-k search by inner product: columnar branch-and-bound.

Candidates of a task lie in vertical layout, a contiguous array for each block of dimensions.  A block of queries
is scored against a chunk of candidates one dimension block at a time: partial sums grow, and a candidate's bound
is its partial sum plus the product of both vectors' remaining mass (the norms over the dimensions to come, by
Cauchy-Schwarz).  Candidates whose bound is below a query's k-th best score so far are dropped, and survivors are compacted before
the next block.  Scores are integers and bounds are rounded up, so pruning never loses a result; ties at the bound
stay and go to the smaller id.  Sums are floating-point numbers as long as no product of two norms reaches 2**53, below which they
are exact; where one does, the survivors' scores are made again with integers of any size.

Queries reach the tasks in broadcast blocks of at most ``query_block`` vectors, one pass over the candidates for
each.  With several blocks each one's result is written to the shared folder and its broadcast dropped before the next one is
collected, so that the driver holds one block whatever the tables' size.  Each task keeps k rows a query, and a window with a group limit
merges them.

Defined results: a vector that is null or holds a null or a non-finite component takes no part; vectors are compared with those of
the same length; components beyond the range of 64-bit integers count as its end, and a score beyond it is an error; an empty table
or query set gives no rows; fewer than k candidates give all of them; a query's own row (the same id) is no candidate of it, nor are
other rows with that id; repeated ids count once as a query for each row.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import written

QUERY_BLOCK = 1 << 15
CHUNK = 1 << 12
DIM_BLOCK = 16
_NONE, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """id and v (array<bigint>), the components as floor(scale * x), of vectors that can take part."""
    v = F.col(vector_column)
    fine = F.col(id_column).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(fine).select(F.col(id_column).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")).alias("v"))


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the given length as integers, whether each row has that length)."""
    lengths = np.diff(column.offsets.to_numpy())
    right = lengths == dims
    values = np.asarray(column.flatten(), dtype=np.int64)
    if right.all():
        return values.reshape(len(right), dims), right
    return values[np.repeat(right, lengths)].reshape(int(right.sum()), dims), right


def _mass(m: np.ndarray, block: int) -> np.ndarray:
    """Norms over the dimensions from each block on; shape (blocks + 1, rows)."""
    squares = np.add.reduceat(m * m, np.arange(0, m.shape[1], block), axis=1)
    rest = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.vstack([np.sqrt(rest).T, np.zeros((1, len(m)))])


class _Best:
    """The k best (score, id) of every query so far, best first."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, query: int, score: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate([self.score[query], score])
        ids = np.concatenate([self.id[query], ids])
        order = np.lexsort((ids, ~score))[: self.k]  # ~x falls as x grows, for all 64-bit integers
        self.score[query], self.id[query] = score[order], ids[order]


def _exact(query: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Inner products by integers of any size."""
    scores = (cand.astype(object) * query.astype(object)).sum(axis=1).tolist()
    if scores and (max(scores) > _MOST or min(scores) <= _NONE):
        raise ValueError("a score is beyond 64 bits")
    return np.array(scores, np.int64)


def _search_chunk(ids: np.ndarray, whole: np.ndarray, q_ids: np.ndarray, q_whole: np.ndarray, queries: np.ndarray, q_mass: np.ndarray, best: _Best, block: int) -> None:
    """whole and q_whole: vectors as integers; queries: the same as floating-point numbers."""
    cand = whole.astype(np.float64)
    dims = cand.shape[1]
    starts = list(range(0, dims, block))
    columns = [np.ascontiguousarray(cand[:, s : s + block].T) for s in starts]  # the vertical layout
    mass = _mass(cand, block)
    large = q_mass[0].max(initial=0) * mass[0].max(initial=0) >= 2.0**53
    for at in range(0, len(queries), 64):
        rows = slice(at, at + 64)
        # The first block is dense: every candidate is alive for every query.
        partial = queries[rows, :block] @ columns[0]
        alive_of = []
        for j in range(partial.shape[0]):
            alive_of.append(None)
            q = at + j
            last = best.score[q, -1]
            floor = float(last) if last > _NONE else -np.inf
            alive = np.arange(len(ids))
            total = partial[j]
            for b in range(1, len(starts) + 1):
                bound = total + q_mass[b, q] * mass[b][alive]
                keep = bound + 1e-6 * (1 + np.abs(bound)) >= floor
                if not keep.all():
                    alive, total = alive[keep], total[keep]  # compaction
                if b == len(starts) or not len(alive):
                    break
                part = columns[b] if len(alive) == len(ids) else columns[b][:, alive]
                total = total + queries[q, starts[b] : starts[b] + block] @ part
            keep = ids[alive] != q_ids[q]
            alive, total = alive[keep], total[keep]
            if len(total) > best.k:
                cut = np.partition(total, len(total) - best.k)[len(total) - best.k]
                keep = total >= (cut - 1e-6 * (1 + abs(cut)) if large else cut)
                alive, total = alive[keep], total[keep]
            if len(total):
                best.add(q, _exact(q_whole[q], whole[alive]) if large else total.astype(np.int64), ids[alive])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", query_block: int = QUERY_BLOCK, dim_block: int = DIM_BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long): the k rows of vectors with the highest integer inner product
    for every row of queries, both quantised to floor(scale * x)."""
    spark = vectors.sparkSession
    candidates = usable(vectors, id_column, vector_column, scale)
    wanted = usable(queries, id_column, vector_column, scale)
    n = wanted.count()
    blocks = max(1, -(-n // query_block))
    found = None
    for b in range(blocks):
        held = (wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).toArrow()
        part, sent = _pass(spark, candidates, held, k, dim_block, chunk)
        if blocks > 1:
            part = written(part, "topk")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(spark, candidates: DataFrame, held: pa.Table, k: int, dim_block: int, chunk: int) -> tuple[DataFrame, object]:
    """The k best rows of every task, and the broadcast that they need."""
    ids = held["id"].to_numpy()
    vectors = held["v"].combine_chunks()
    groups = {}
    if len(ids):
        vectors = vectors if isinstance(vectors, pa.Array) else pa.concat_arrays(vectors.chunks)
        for dims in np.unique(np.diff(vectors.offsets.to_numpy())):
            m, right = _matrix(vectors, int(dims))
            groups[int(dims)] = (ids[right], np.flatnonzero(right), m)
    sent = spark.sparkContext.broadcast(groups)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dims = sent.value
        best = {d: _Best(len(q[0]), k) for d, q in by_dims.items()}
        plain = {d: q[2].astype(np.float64) for d, q in by_dims.items()}
        mass = {d: _mass(q, dim_block) if d else None for d, q in plain.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1)
            own = np.asarray(batch.column(0))
            for d, (q_ids, _, q) in by_dims.items():
                m, right = _matrix(v, d)
                c_ids = own[right]
                for at in range(0, len(c_ids), chunk):
                    if d:
                        _search_chunk(c_ids[at : at + chunk], m[at : at + chunk], q_ids, q, plain[d], mass[d], best[d], dim_block)
                    else:
                        for j, q_id in enumerate(q_ids):
                            rest = c_ids[at : at + chunk][c_ids[at : at + chunk] != q_id]
                            best[d].add(j, np.zeros(len(rest), np.int64), rest)
        for d, (q_ids, copies, _) in by_dims.items():
            j, r = np.nonzero(best[d].score > _NONE)
            if len(j):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[j]), pa.array(copies[j].astype(np.int64)), pa.array(best[d].id[j, r]), pa.array(best[d].score[j, r])],
                    names=["query_id", "copy", "vec_id", "score"],
                )

    return candidates.mapInArrow(search, "query_id bigint, copy bigint, vec_id bigint, score bigint"), sent
