"""Exact top-k inner products by columnar branch and bound.

A candidate group lies in vertical layout: dimension blocks, the ones of most
mass first.  Scores accumulate block by block.  After each block, the
Cauchy-Schwarz product of the query's and a candidate's remaining mass bounds
what the other blocks can still add, so candidates whose upper bound is under
the k-th best lower bound leave, and the survivors are compacted before the
next block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import table
from netsift.llm.grid import matrices, top_by_query, usable

#: Dimensions of a block; queries scored at once in the first block.
BLOCK, AT_ONCE = 16, 64
_EXACT = 2.0**53
_LONG = (-(2**63), 2**63 - 1)


def _remaining(m: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms of m's columns from each cut on, a row for each cut; rounded up a little."""
    tail = np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]
    tail = np.concatenate((tail, np.zeros((len(m), 1))), axis=1)
    return np.sqrt(tail[:, cuts].T) * (1 + 1e-9) + 1e-9


def _branch_and_bound(q_ids, q_mat, ids, mat, k: int):
    """Yields (query position, candidate positions, scores): at least the k best each."""
    order = np.argsort(-(mat * mat).sum(axis=0), kind="stable")
    mat, q_mat = mat[:, order], q_mat[:, order]
    d = mat.shape[1]
    cuts = [*range(min(BLOCK, d), d, BLOCK), d]
    vertical = [np.ascontiguousarray(mat[:, lo:hi].T) for lo, hi in zip([0, *cuts], cuts, strict=False)]
    mass, q_mass = _remaining(mat, cuts), _remaining(q_mat, cuts)
    for lo in range(0, len(q_mat), AT_ONCE):
        first = q_mat[lo : lo + AT_ONCE, : cuts[0]] @ vertical[0]
        for i, partial in enumerate(first, lo):
            live = np.flatnonzero(ids != q_ids[i])
            partial = partial[live]
            for b in range(len(cuts)):
                if b:
                    partial = partial + q_mat[i, cuts[b - 1] : cuts[b]] @ vertical[b][:, live]
                if len(live) <= k:
                    continue
                slack = q_mass[b, i] * mass[b, live]
                floor = np.partition(partial - slack, len(live) - k)[len(live) - k]
                stay = partial + slack >= floor
                live, partial = live[stay], partial[stay]
            yield i, live, partial


def _cell(k: int, scale: float):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        groups = {m.shape[1]: (ids, np.floor(scale * m)) for ids, _, m in matrices(candidates)}
        for q_ids, q_rows, q_mat in matrices(queries):
            if q_mat.shape[1] not in groups:
                continue
            ids, mat = groups[q_mat.shape[1]]
            q_mat = np.floor(scale * q_mat)
            if mat.shape[1] * np.abs(mat).max() * np.abs(q_mat).max() < _EXACT:
                found = _branch_and_bound(q_ids, q_mat, ids, mat, k)
            else:  # beyond exact doubles: Python's integers
                whole = np.array([[int(x) for x in r] for r in mat], dtype=object)
                found = ((i, at := np.flatnonzero(ids != q_ids[i]), whole[at] @ np.array([int(x) for x in q_mat[i]], dtype=object)) for i in range(len(q_ids)))
            for i, at, score in found:
                score = np.array([min(max(int(x), _LONG[0]), _LONG[1]) for x in score], np.int64) if score.dtype == object else score.astype(np.int64)
                best = np.lexsort((ids[at], -score))[:k]
                for part, values in zip(out, (np.full(len(best), q_ids[i]), np.full(len(best), q_rows[i]), ids[at][best], score[best]), strict=True):
                    part.append(values)
        if not out[0]:
            out = [[np.empty(0, np.int64)]] * 4
        return pa.table([np.concatenate(x) for x in out], names=["query_id", "query_row", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(scale * x).

    is_query: a Column over vec_id.  Candidates are all rows with another id and as
    many dimensions; ties go to the smaller id; fewer than k candidates are all
    returned.  Rows whose id or vector is null, empty, or holds a null or
    non-finite component take no part.  Rows that repeat an id are ranked apart
    as queries and each count as candidates.  Scores beyond a long stay at its ends.
    """
    return top_by_query(usable(vectors, id_col, vec_col), is_query, k, "long", _cell(k, scale))


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 20 best of each row whose vec_id is divisible by 20; unusable rows as in exact_topk."""
    return exact_topk(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
