"""Exact nearest neighbours by a block matrix join over int8 tiles.

Vectors are scaled to unit length and rounded to int8 with a scale of their own.  For a tile
of queries and candidates the int8 product approximates all cosines, and the norms of the
rounding errors bound how far each may be off.  Products are summed exactly, whatever the
dimension.  A pair survives if its upper bound reaches the k-th best cosine that its query has
so far; survivors are recomputed in double precision from the original vectors, a bounded number
at a time, and go into a heap of k per query.  The heaps of all tiles are merged at the end.
Nothing is approximate in the result.

Scale: the query set is fixed by the caller.  Equal rows are one before anything else.  Rows go
to blocks by a hash of id and vector, query blocks meet candidate blocks in a grid of tasks
whose memory is bounded by the bytes of a block, and each tile returns at most k rows a query.
Of candidates with equal vectors a tile looks at the k + 1 smallest ids only, as no query can
have more of them; so ties cost neither time nor memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailspark.llm.common import one_thread_a_task, settle, table

K = 5
#: Most rows in a block, and most numbers: the rows that fit are fewer where vectors are long.
QUERY_BLOCK = 32_768
CANDIDATE_BLOCK = 65_536
BLOCK_NUMBERS = 1 << 23
#: Least number of candidate blocks, so that small tables use all cores too.
LEAST_BLOCKS = 64
_TILE = 2_048
#: Components whose int8 products sum up exactly in single precision: 1024 * 127 * 127 < 2 ** 24.
_EXACT = 1_024
#: Numbers of the surviving pairs that are recomputed at a time.
_PAIR_NUMBERS = 1 << 21


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest components lie between a half and one: exact, and no square overflows or vanishes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0.0))[1][:, None])


def _quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values as float32, scales, norms of the rounded vectors and of the errors."""
    unit = _scaled(v)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q.astype(np.float32), scale, np.sqrt((near * near).sum(axis=1)), np.sqrt(((unit - near) ** 2).sum(axis=1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int8 rows, exactly: single precision holds sums over ``_EXACT`` components, double precision those of all."""
    out = (a[:, :_EXACT] @ b[:, :_EXACT].T).astype(np.float64)
    for at in range(_EXACT, a.shape[1], _EXACT):
        out += a[:, at : at + _EXACT] @ b[:, at : at + _EXACT].T
    return out


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, summed from the first component to the last."""
    a, b = _scaled(a), _scaled(b)
    total = lambda x: np.cumsum(x, axis=1)[:, -1]
    return np.clip(total(a * b) / np.sqrt(total(a * a) * total(b * b)), -1.0, 1.0)


def _few_of_each(cid: np.ndarray, cv: np.ndarray, k: int) -> np.ndarray:
    """Rows, by id, that hold one of the k smallest ids of their vector."""
    order = np.argsort(cid, kind="stable")
    rows = np.ascontiguousarray(cv[order]).view(np.dtype((np.void, 8 * cv.shape[1]))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    by = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[by], prepend=-1))
    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return order[np.sort(by[rank < k])]


def tile_top(qid: np.ndarray, qv: np.ndarray, cid: np.ndarray, cv: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, cosine) of each query's k nearest candidates, ties to smaller ids."""
    order = _few_of_each(cid, cv, k + 1)
    cid, cv = cid[order], cv[order]
    qq, qs, qn, qe = _quantise(qv)
    n, slack = len(qid), 1e-9 + 1e-15 * qv.shape[1]
    heap_score, heap_row = np.full((n, k), -np.inf), np.full((n, k), len(cid))  # best first
    for at in range(0, len(cid), _TILE):
        cq, cs, cn, ce = _quantise(cv[at : at + _TILE])
        near = _products(qq, cq) * qs[:, None] * cs[None, :]
        off = qn[:, None] * ce[None, :] + qe[:, None] * cn[None, :] + qe[:, None] * ce[None, :] + slack
        near[qid[:, None] == cid[None, at : at + _TILE]] = -np.inf
        m = min(k, near.shape[1])
        floor = np.partition(near - off, near.shape[1] - m, axis=1)[:, near.shape[1] - m] if m == k else np.full(n, -np.inf)
        floor = np.maximum(floor, heap_score[:, -1])
        q, c = np.nonzero((near + off >= floor[:, None]) & (near > -np.inf))
        step = max(1, _PAIR_NUMBERS // qv.shape[1])
        for s in range(0, len(q), step):
            pq, pc = q[s : s + step], c[s : s + step] + at
            score = _cosine(qv[pq], cv[pc])
            good = score >= heap_score[pq, -1]  # later candidates have larger ids
            pq, pc, score = pq[good], pc[good], score[good]
            own = np.unique(pq)
            if not len(own):
                continue
            aq = np.concatenate((np.repeat(own, k), pq))
            ar, sc = np.concatenate((heap_row[own].ravel(), pc)), np.concatenate((heap_score[own].ravel(), score))
            by = np.lexsort((ar, -sc, aq))
            first = np.searchsorted(aq[by], own)
            best = by[first[:, None] + np.arange(k)]
            heap_score[own], heap_row[own] = sc[best], ar[best]
    q, r = np.nonzero(heap_row < len(cid))
    return q, order[heap_row[q, r]], heap_score[q, r]


def _usable(vectors: DataFrame) -> DataFrame:
    """id and vector (doubles) of rows that take part, equal rows once."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column by their length, as flat values and sizes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def nearest(vectors: DataFrame, every: int, k: int = K) -> DataFrame:
    """The k nearest of each query by cosine: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows of
    other ids.  Rows whose id or vector is null, empty, zero or holds null or non-finite
    components take no part.  Vectors of different length never meet.  Rows equal in id and
    vector count once.  Other columns are ignored; an empty table gives no rows.
    """
    one_thread_a_task(vectors.sparkSession)
    rows = settle(_usable(vectors).distinct())
    n, n_queries, longest = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(F.size("v"))).first()
    fit = max(1, BLOCK_NUMBERS // (longest or 1))
    c_blocks = max(LEAST_BLOCKS, -(-n // min(CANDIDATE_BLOCK, fit)))
    q_blocks = max(1, -(-(n_queries or 0) // min(QUERY_BLOCK, fit)))
    block = lambda m: F.pmod(F.xxhash64("id", "v"), F.lit(m))
    queries = rows.filter(F.col("id") % every == 0).select(block(q_blocks).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"), "id", "v")
    against = rows.select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), block(c_blocks).cast("int").alias("cb"), "id", "v")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sides = []
        for t in (left, right):
            flat, size = _matrix(t.column("v"))
            sides.append((t.column("id").to_numpy(), flat, size, np.concatenate(([0], np.cumsum(size)))))
        for d in np.intersect1d(sides[0][2], sides[1][2]).tolist():
            part = []
            for ids, flat, size, at in sides:
                own = np.flatnonzero(size == d)
                part += [ids[own], flat[at[own][:, None] + np.arange(d)] if len(own) else np.zeros((0, d))]
            qid, qv, cid, cv = part
            for s in range(0, len(qid), _TILE):
                q, c, score = tile_top(qid[s : s + _TILE], qv[s : s + _TILE], cid, cv, k)
                out.append((qid[s : s + _TILE][q], cid[c], score))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = queries.groupBy("qb", "cb").cogroup(against.groupBy("qb", "cb")).applyInArrow(tile, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return settle(found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=50)
