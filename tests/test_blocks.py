"""Pairs by blocks against brute force; what is decided in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from netsift.operators import blocks, spatial, topology

SIDES = "grp string, id string, bbox struct<x1:double,y1:double,x2:double,y2:double>"


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "STRIPE", 3)


def drawn(n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        x, y = sorted(r.random() for _ in "ab"), sorted(r.random() for _ in "ab")
        rows.append(("g%d" % (k % 2), f"b{k}", (x[0], y[0], x[1], y[1])))
    return rows


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0.0) * max(h, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union else 0.0


def test_overlapping_pairs_of_many_blocks(spark, tiny):
    rows = drawn(60, 1)
    got = sorted(tuple(r) for r in spatial.overlapping_pairs(spark.createDataFrame(rows, SIDES), ["grp"], 0.2).collect())
    want = [(a[0], *sorted((a[1], b[1])), overlap(a[2], b[2])) for i, a in enumerate(rows) for b in rows[:i] if a[0] == b[0] and overlap(a[2], b[2]) >= 0.2]
    assert got == sorted(want)


def test_meetings_of_many_blocks(spark, tiny):
    rows = [(g, i, (b[0], b[1]), (b[2], b[3]) if k % 3 else (b[2], b[1])) for k, (g, i, b) in enumerate(drawn(50, 2))]
    s = spark.createDataFrame(rows, "grp string, id string, a struct<x:double,y:double>, b struct<x:double,y:double>")
    from netsift.functions.geometry import is_tee, line_intersection

    side = lambda n: s.select("grp", *[F.col(c).alias(f"{n}_{c}") for c in ("id", "a", "b")])
    four = [F.col(f"{n}_{e}") for n in "lr" for e in "ab"]
    want = side("l").join(side("r"), "grp").where("l_id < r_id").withColumn("p", line_intersection(*four)).where("p is not null")
    want = want.select("grp", "l_id", "r_id", "p.x", "p.y", is_tee(F.col("p"), *four))
    assert sorted(map(tuple, topology.meetings(s, ["grp"]).collect())) == sorted(map(tuple, want.collect()))


def test_a_chain_of_matches_needs_no_round_a_link(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(spatial, "cut", lambda df, f=spatial.cut: cuts.append(1) or f(df))
    n = 12  # truth box k overlaps detections k and k + 1, the latter more, so each waits for the one before it
    d = spark.createDataFrame([("g", k, 1 - k / 100, (k * 1.0, 0.0, k + 1.0, 1.0)) for k in range(n)], "grp string, detection_id long, confidence double, bbox struct<x1:double,y1:double,x2:double,y2:double>")
    t = spark.createDataFrame([("g", k, (k + 0.45, 0.0, k + 1.45, 1.0)) for k in range(-1, n)], "grp string, truth_id long, bbox struct<x1:double,y1:double,x2:double,y2:double>")
    got = sorted((r["detection_id"], r["truth_id"]) for r in spatial.match_detections(d, t, ["grp"], 0.2).collect())
    boxes, used, want = {r["truth_id"]: tuple(r["bbox"]) for r in t.collect()}, set(), []
    for k in range(n):
        best = max((overlap((k, 0, k + 1, 1), b), -i) for i, b in boxes.items() if i not in used)
        if best[0] >= 0.2:
            used.add(-best[1])
            want.append((k, -best[1]))
    assert got == sorted(want) and len(cuts) <= 3
    monkeypatch.setattr(spatial, "FOLDED", 0)
    assert sorted((r["detection_id"], r["truth_id"]) for r in spatial.match_detections(d, t, ["grp"], 0.2).collect()) == got


def test_crossings_are_spread_in_order(spark):
    r = random.Random(3)
    rows = [("r", 1, f"{k:03d}", [(r.random(), r.random()), (r.random(), r.random())], 0.9) for k in range(60)]
    lines = spark.createDataFrame(rows, "analysis_run_id string, page int, id string, polyline array<struct<x:double,y:double>>, confidence double")
    dot = [("r", 1, 0.5, 0.5), ("r", 1, 0.3, 0.6)]
    got = topology.crossings(lines, spark.createDataFrame(dot, "analysis_run_id string, page int, x double, y double"), 0.05, 0.05).collect()
    s = lines.select(F.lit("g").alias("grp"), "id", F.get("polyline", 0).alias("a"), F.get("polyline", 1).alias("b"))
    kept = []
    for m in sorted(topology.meetings(s, ["grp"]).collect(), key=lambda m: (m["a"], m["b"])):
        far = lambda x, y, m=m: ((m["x"] - x) ** 2 + (m["y"] - y) ** 2) ** 0.5 >= 0.05
        if all(far(d[2], d[3]) for d in dot) and all(far(*k) for k in kept):
            kept.append((m["x"], m["y"]))
    assert [(c["x"], c["y"]) for c in sorted(got, key=lambda c: int(c["id"].split(":")[1]))] == [(round(x, 6), round(y, 6)) for x, y in kept]


def test_touching_traces_span_their_groups(spark, tiny):
    n = 40  # all touch: as many links as hold a group together in two blocks, not all pairs
    rows = [("r", 1, f"{k:03d}", 0.5, 0.5, 0.6, 0.5 + k / 1000) for k in range(n)]
    lines = spark.createDataFrame(rows, "analysis_run_id string, page int, id string, ax double, ay double, bx double, by double")
    links = blocks.pairs(lines, None, ["analysis_run_id", "page"], blocks.boxes_near(0.012), blocks.touching(0.012), {}, spans=True).collect()
    reached = {"000"}
    for _ in range(n):
        reached |= {x for k in links if reached & {k["a"], k["b"]} for x in (k["a"], k["b"])}
    assert len(reached) == n and len(links) < n * (n - 1) / 4


def test_ends_snap_once_and_issues_read_what_is_stored(spark, monkeypatch):
    calls, snapped = [], topology._snapped
    monkeypatch.setattr(topology, "_snapped", lambda *a: calls.append(1) or snapped(*a))
    symbols = spark.createDataFrame([("r", "s0", 1, "load", 0.9, (0.1, 0.4, 0.2, 0.6)), ("r", "s1", 1, "feeder_terminal", 0.9, (0.4, 0.4, 0.5, 0.6))], "analysis_run_id string, id string, page int, predicted_class string, confidence double, bbox struct<x1:double,y1:double,x2:double,y2:double>")
    lines = spark.createDataFrame([("r", 1, "w", [(0.2, 0.5), (0.4, 0.5)], 0.9)], "analysis_run_id string, page int, id string, polyline array<struct<x:double,y:double>>, confidence double")
    _, ranked, issues = topology.reconstruct(lines, spatial.terminals_of(symbols), symbols)
    assert ranked.where("rank = 1").count() == 1 and issues.where("kind = 'ORPHAN_TERMINAL'").count() == 0
    assert len(calls) == 1
