import math
import random

import pytest
from pyspark.sql import functions as F

import netsift.llm.grid as grid
from netsift.llm.ann import nearest
from netsift.llm.exact_topk import exact_topk

SCHEMA = "vec_id long, embedding array<float>, label int, q int, c int, row long, vec string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, "x", 5) for i, v in rows], SCHEMA)


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, every, k, score, extra=lambda v: True):
    rows = [(i, v) for i, v in rows if i is not None and good(v) and extra(v)]
    out = []
    for q, a in rows:
        if q % every == 0:
            best = sorted(((-score(a, b), i) for i, b in rows if i != q and len(a) == len(b)))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def vectors(n, d, seed, grain=None):
    rng = random.Random(seed)
    draw = lambda: round(rng.gauss(0, 1), 1) if grain is None else rng.randint(-grain, grain) / 2
    return [(i, [float(f) for f in __import__("numpy").float32([draw() for _ in range(d)])]) for i in range(n)]


HOSTILE = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (40, None), (60, []), (80, [1.0, None]), (100, [float("nan"), 1.0]), (1, [float("inf"), 1.0]), (2, [0.0, 0.0]), (3, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (120, [-1.0, -2.0]), (5, [1e30, 1e30]), (7, [2.0, 1.0])]


def inner(a, b):
    return sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b))


def clipped(a, b):
    return max(-(2**63), min(2**63 - 1, inner(a, b)))


def cosine(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))


@pytest.mark.parametrize("rows", [vectors(150, 64, 1), vectors(120, 5, 2, grain=2), vectors(30, 17, 3), vectors(12, 3, 4)], ids=["wide", "ties", "odd", "few"])
def test_exact_topk(spark, rows, monkeypatch):
    monkeypatch.setattr(grid, "CANDIDATES", 40)
    monkeypatch.setattr(grid, "QUERIES", 3)
    got = exact_topk(frame(spark, rows), F.pmod("vec_id", F.lit(5)) == 0, k=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 4, inner)


def test_exact_topk_hostile(spark):
    got = exact_topk(frame(spark, HOSTILE), F.pmod("vec_id", F.lit(20)) == 0)
    assert sorted(map(tuple, got.collect())) == brute(HOSTILE, 20, 20, clipped)
    assert exact_topk(frame(spark, []), F.lit(True)).collect() == []


@pytest.mark.parametrize("rows", [vectors(150, 64, 5), vectors(120, 5, 6, grain=2), vectors(12, 3, 7)], ids=["wide", "ties", "few"])
def test_nearest(spark, rows, monkeypatch):
    monkeypatch.setattr(grid, "CANDIDATES", 40)
    monkeypatch.setattr(grid, "QUERIES", 3)
    got = nearest(frame(spark, rows), F.pmod("vec_id", F.lit(5)) == 0)
    want = brute(rows, 5, 5, cosine, any)
    assert [(q, r, round(s, 12)) for q, r, _, s in sorted(map(tuple, got.collect()))] == [(q, r, round(s, 12)) for q, r, _, s in want]


def test_nearest_copies_and_hostile(spark):
    rows = [(i, [3.0, 4.0, 12.0]) for i in range(30)] + [(100 + i, [float(i), 1.0, 0.0]) for i in range(10)]
    got = [tuple(r) for r in nearest(frame(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [x[2] for x in got] == [1, 2, 3, 4, 5]
    got = nearest(frame(spark, HOSTILE), F.pmod("vec_id", F.lit(20)) == 0)
    assert [x[:3] for x in sorted(map(tuple, got.collect()))] == [x[:3] for x in brute(HOSTILE, 20, 5, cosine, any)]
    assert nearest(frame(spark, []), F.lit(True)).collect() == []


def test_repeated_ids_are_ranked_apart(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    got = sorted(map(tuple, exact_topk(frame(spark, rows), F.col("vec_id") == 0, k=1).collect()))
    assert got == [(0, 1, 1, 64 * 64), (0, 1, 2, 64 * 64)]


def test_ties_take_bounded_memory():
    """128 equal queries against 8,192 equal vectors: every pair survives the bounds."""
    import tracemalloc

    import pyarrow as pa

    import netsift.llm.ann as ann

    d, n = 256, 8192
    side = lambda ids: pa.table({"vec_id": pa.array(ids, pa.int64()), "row": pa.array(ids, pa.int64()), "vec": pa.array([[1.0] * d] * len(ids), pa.list_(pa.float32()))})
    queries, candidates = side(range(n, n + 128)), side(range(n))
    tracemalloc.start()
    got = ann._cell(5)(queries, candidates)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["vec_id"].to_pylist() == [0, 1, 2, 3, 4] * 128 and set(got["score"].to_pylist()) == {1.0}
    assert peak < 250e6
