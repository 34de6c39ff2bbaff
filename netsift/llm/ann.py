"""Nearest neighbours by cosine as a block matrix join on int8 tiles.

Unit vectors are quantised to int8 with a scale a row.  The product of two
blocks of them is one matrix product; with the norms of the quantisation errors
it bounds every cosine from both sides.  Pairs whose upper bound reaches the
k-th best lower bound of their query are recomputed in double precision from
the original vectors and merged by a heap.  The bounds hold always, so the
search is exact; recall is 1.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import table
from netsift.llm.grid import matrices, top_by_query, usable

#: Queries of one tile, and components of the pairs that are recomputed at once.
TILE, AT_ONCE = 128, 1 << 20


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first dimension to the last."""
    acc = np.zeros(len(a))
    for j in range(a.shape[1]):
        acc += a[:, j] * b[:, j]
    return acc


def _cosines(q_mat: np.ndarray, q_len: np.ndarray, i: np.ndarray, mat: np.ndarray, norm: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (i, c), some at a time: however many pairs tie, their vectors take bounded memory."""
    out, step = np.empty(len(i)), max(1, AT_ONCE // mat.shape[1])
    for lo in range(0, len(i), step):
        a, b = i[lo : lo + step], c[lo : lo + step]
        out[lo : lo + step] = _dot(q_mat[a], mat[b]) / (q_len[a] * norm[b])
    return out


def _sized(m: np.ndarray) -> np.ndarray:
    """m, but rows whose square sum leaves the doubles are divided by their largest component."""
    with np.errstate(over="ignore", under="ignore"):
        odd = ~np.isfinite(s := (m * m).sum(axis=1)) | (s < 1e-280)
    if odd.any():
        m = m.copy()
        m[odd] /= np.abs(m[odd]).max(axis=1, keepdims=True)
    return m


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, error norms, norms of the quantised rows) of the unit vectors of m."""
    unit = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt(((unit - back) ** 2).sum(axis=1)), np.sqrt((back**2).sum(axis=1))


def _cell(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        groups = {m.shape[1]: (ids, _sized(m)) for ids, _, m in matrices(candidates)}
        for q_ids, q_rows, q_mat in matrices(queries):
            if q_mat.shape[1] not in groups:
                continue
            ids, mat = groups[q_mat.shape[1]]
            q_mat = _sized(q_mat)
            exact = np.float32 if mat.shape[1] * 127 * 127 < 1 << 24 else np.float64
            code, scale, error, _ = quantise(mat)
            columns = np.ascontiguousarray(code.T.astype(exact))
            q_code, q_scale, q_error, q_norm = quantise(q_mat)
            norm, q_len = np.sqrt(_dot(mat, mat)), np.sqrt(_dot(q_mat, q_mat))
            for lo in range(0, len(q_ids), TILE):
                at = slice(lo, lo + TILE)
                near = (q_code[at].astype(exact) @ columns) * q_scale[at, None] * scale
                slack = q_error[at, None] + q_norm[at, None] * error + 1e-6
                low = np.where(ids == q_ids[at, None], -np.inf, near - slack)
                floor = np.partition(low, low.shape[1] - k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
                i, c = np.nonzero((near + slack >= floor[:, None]) & (ids != q_ids[at, None]))
                score = _cosines(q_mat, q_len, lo + i, mat, norm, c)
                cut = np.searchsorted(i, np.arange(len(low) + 1))
                for r in range(len(low)):
                    own = np.arange(cut[r], cut[r + 1])
                    if len(own) > 4 * k:  # of equal scores only the smallest ids can stay
                        own = own[np.lexsort((ids[c[own]], -score[own]))[:k]]
                    for s, v in heapq.nsmallest(k, zip((-score[own]).tolist(), ids[c[own]].tolist(), strict=True)):
                        out.append((q_ids[lo + r], q_rows[lo + r], v, -s))
        ints = [np.array([x[j] for x in out], np.int64) for j in range(3)]
        return pa.table([*ints, np.array([x[3] for x in out], np.float64)], names=["query_id", "query_row", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest cosine, in double precision.

    is_query: a Column over vec_id.  Candidates are all rows with another id and as
    many dimensions; ties go to the smaller id; fewer than k candidates are all
    returned.  Rows whose id or vector is null, empty, zero, or holds a null or
    non-finite component take no part.  Rows that repeat an id are ranked apart
    as queries and each count as candidates.
    """
    rows = usable(vectors, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    return top_by_query(rows, is_query, k, "double", _cell(k))


def op4_ann(spark, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 5 nearest of each row whose vec_id is divisible by 50; unusable rows as in nearest."""
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


OP4_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
