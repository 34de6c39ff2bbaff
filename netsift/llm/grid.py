"""A query set against all vectors, in blocks.

Vectors stay in Arrow batches: each candidate row goes to one of C candidate
groups, each query row to one of Q query groups, and cell (q, c) of the grid
gets one group of each, so a task holds a bounded number of rows whatever the
table's size.  A cell returns its best few per query; those are merged per
query.  Groups are dealt by a hash of the row's id and values and of the part of the input it
came from, so repeated ids or vectors spread over all groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate group and of a query group, about.  Each vector goes to all groups of the other side, so their
#: number, and with it the shuffle, is the rows by these.
CANDIDATES, QUERIES = 8192, 16384

_CELL = "query_id long, query_row long, vec_id long, score {kind}"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec: array of floats, or doubles) of rows whose id and vector hold no null and no non-finite number."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    v = F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>")  # floats travel as they are: half the bytes
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0").where(~bad)


def matrices(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vec_id, row, matrix of doubles) for the rows of each number of dimensions."""
    if not table.num_rows:
        return
    vec = table["vec"].combine_chunks()
    size = np.diff(np.asarray(vec.offsets))
    flat = np.asarray(vec.flatten())
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    ids, rows = np.asarray(table["vec_id"]), np.asarray(table["row"])
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield ids[at], rows[at], flat[start[at][:, None] + np.arange(d)].astype(np.float64)


def top_by_query(vectors: DataFrame, is_query, k: int, kind: str, cell: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all cells, ties to the smaller vec_id.

    vectors: (vec_id, vec).  cell(queries, candidates) gets tables (vec_id, row,
    vec) and returns (query_id, query_row, vec_id, score) with at least the k best
    of its candidates for each query.  Query rows that repeat an id are ranked apart.
    """
    rows = vectors.withColumn("row", F.monotonically_increasing_id())
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).head()
    groups = max(1, -(-sizes["n"] // CANDIDATES))
    asked = max(1, -(-sizes["q"] // QUERIES))
    deal = F.xxhash64("vec_id", "row")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.withColumn("c", F.pmod(deal, F.lit(groups)).cast("int")).withColumn("q", every(asked))
    queries = rows.where(is_query).withColumn("q", F.pmod(deal, F.lit(asked)).cast("int")).withColumn("c", every(groups))
    schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if kind == "long" else pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        return cell(left, right).cast(schema)

    cells = groups * asked
    keyed = lambda df: df.select("q", "c", "vec_id", "row", "vec").repartition(cells, "q", "c").groupBy("q", "c")
    found = keyed(queries).cogroup(keyed(candidates)).applyInArrow(run, _CELL.format(kind=kind))
    best = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
