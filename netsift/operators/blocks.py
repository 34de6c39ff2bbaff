"""Pairs of rows that NumPy holds against each other, block by block.

Long segments and large boxes cover so many grid cells that an equi-join on
cells makes more rows than there are pairs.  Here the rows of a group are dealt
into blocks by a hash of their id, every two blocks meet in one place, and only
the pairs that pass leave it; no row is left out, whatever the size of a group.
The arithmetic is that of netsift.functions.geometry, in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block, and how many of them are held against another block at once.
BLOCK, STRIPE = 1024, 128
Values = dict[str, np.ndarray]


def columns_of(table: pa.Table, values: list[str]) -> Values:
    return {v: table.column(v).to_numpy().astype(float) for v in values}


def met(a: Values, b: Values, near: Callable[[Values, Values], np.ndarray], stripe: int = STRIPE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (of a, of b) of the pairs that are near, in order of a and then b, some rows of a at a time."""
    size = len(next(iter(a.values())))
    across = {k: v[None, :] for k, v in b.items()}
    for lo in range(0, size, stripe):
        i, j = np.nonzero(near({k: v[lo : lo + stripe, None] for k, v in a.items()}, across))
        yield i + lo, j


def pairs(left: DataFrame, right: DataFrame | None, keys: list[str], near: Callable[[Values, Values], np.ndarray], made: Callable[[Values, Values], tuple[np.ndarray, Values]], columns: dict[str, T.DataType], spans: bool = False, least: tuple[str, str] | None = None) -> DataFrame:
    """(keys, a, b, columns) of all pairs of equal keys for which both near and made hold.

    left, right: (keys, id, values), values being doubles; where one is null, nothing
    holds.  Without right, left meets itself, each pair once with a < b.  near looks at
    a block of pairs by broadcasting and may let too many pass; made gets the pairs'
    values, one by one, and gives which hold and their columns.
    spans: of the pairs of two blocks only as many as tie the same ids together.
    least: (value of left, column); of the pairs of two blocks, for each b and value only the
    one of the least column, ties to the smaller a.  Not for left alone.
    """
    own = right is None
    values = list(dict.fromkeys(c for df in (left, left if own else right) for c in df.columns if c not in (*keys, "id")))
    if not own:  # each side has the other's values, as null
        left, right = (df.select("*", *[F.lit(None).cast("double").alias(v) for v in values if v not in df.columns]) for df in (left, right))
    count = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(n))
    # an id's block; copies of the row for every block of the other side
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if own:
        rows = left.join(count(left, "n"), keys).withColumn("at", at("n")).withColumn("other", copies("n"))
        i, j = F.least("at", "other"), F.greatest("at", "other")
        rows = rows.select(*keys, "id", *values, i.alias("i"), j.alias("j"), (F.col("at") == i).alias("first"), (F.col("at") == j).alias("second"))
    else:
        both = count(left, "n").join(count(right, "m"), keys)
        rows = left.join(both, keys).select(*keys, "id", *values, at("n").alias("i"), copies("m").alias("j"), F.lit(True).alias("first"), F.lit(False).alias("second"))
        rows = rows.unionByName(right.join(both, keys).select(*keys, "id", *values, copies("n").alias("i"), at("m").alias("j"), F.lit(False).alias("first"), F.lit(True).alias("second")))
    names = [*keys, "a", "b", *columns]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if own:
            table = table.sort_by("id")
        data, ids = columns_of(table, values), table.column("id").combine_chunks()
        rank = np.asarray(ids.dictionary_encode().indices) if own else None
        sides = [np.flatnonzero(table.column(c).to_numpy()) for c in ("first", "second")]
        same = own and key[-1].as_py() == key[-2].as_py()
        found, root = [], np.arange(table.num_rows)
        for i, j in met(*({k: v[s] for k, v in data.items()} for s in sides), near):
            i, j = sides[0][i], sides[1][j]
            if own:
                if same:
                    once = rank[i] < rank[j]
                    i, j = i[once], j[once]
                else:
                    i, j = np.minimum(i, j), np.maximum(i, j)
            if spans:
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
            holds, more = made({k: v[i] for k, v in data.items()}, {k: v[j] for k, v in data.items()})
            i, j, more = i[holds], j[holds], {k: v[holds] for k, v in more.items()}
            if spans:
                kept = _forest(root, i, j)
                i, j, more = i[kept], j[kept], {k: v[kept] for k, v in more.items()}
            found.append((i, j, more))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (0, 1))
        more = {c: np.concatenate([f[2][c] for f in found]) if found else np.zeros(0) for c in columns}
        if least:
            of, names_of = data[least[0]][i], np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.lexsort((names_of[i], more[least[1]], j, of))
            first = np.ones(len(order), bool)
            first[1:] = (np.diff(j[order]) != 0) | (np.diff(of[order]) != 0)
            order = order[first]
            i, j, more = i[order], j[order], {k: v[order] for k, v in more.items()}
        out = [pa.repeat(k, len(i)) for k in key[:-2]] + [ids.take(pa.array(i)), ids.take(pa.array(j))]
        out += [pa.array(more[c]) for c in columns]
        return pa.Table.from_arrays(out, names=names)

    fields = [left.schema[k] for k in keys] + [T.StructField(c, left.schema["id"].dataType) for c in ("a",)]
    fields += [T.StructField("b", (left if own else right).schema["id"].dataType)] + [T.StructField(c, t) for c, t in columns.items()]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the rows are few for their work, so they are not gathered by size
    return rows.repartition(parts, *keys, "i", "j").groupBy(*keys, "i", "j").applyInArrow(run, T.StructType(fields))


def _forest(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs join what was apart so far; root, the component of every row, is brought up to date."""
    parent = root.tolist()

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    root[:] = [top(x) for x in range(len(parent))]
    return np.array(kept, int)


def boxes_overlap(threshold: float):
    """(near, made) for pairs() of boxes x1, y1, x2, y2 whose intersection over union is at least the threshold, above 0; made has iou."""

    def both(a: Values, b: Values) -> tuple[np.ndarray, np.ndarray]:
        w = np.minimum(a["x2"], b["x2"]) - np.maximum(a["x1"], b["x1"])
        h = np.minimum(a["y2"], b["y2"]) - np.maximum(a["y1"], b["y1"])
        common = np.maximum(w, 0.0) * np.maximum(h, 0.0)
        area = lambda s: (s["x2"] - s["x1"]) * (s["y2"] - s["y1"])
        return common, area(a) + area(b) - common

    def near(a: Values, b: Values) -> np.ndarray:
        common, union = both(a, b)
        return (common > 0) & (common >= threshold * (1 - 1e-9) * union)

    def made(a: Values, b: Values) -> tuple[np.ndarray, Values]:
        common, union = both(a, b)
        iou = common / np.where(union != 0, union, 1.0)
        return (iou >= threshold) & (union != 0), {"iou": iou}

    return near, made


def boxes_near(margin: float):
    """near for pairs() of segments ax, ay, bx, by whose boxes are at most so far apart on both axes."""

    def near(a: Values, b: Values) -> np.ndarray:
        ok = True
        for k in ("x", "y"):
            low, high = (lambda s, k=k: np.minimum(s[f"a{k}"], s[f"b{k}"])), (lambda s, k=k: np.maximum(s[f"a{k}"], s[f"b{k}"]))
            ok = ok & (low(a) - margin <= high(b)) & (low(b) - margin <= high(a))
        return ok

    return near


def crossing(a: Values, b: Values, slack: float = 0.003, reach: float = 0.006) -> tuple[np.ndarray, Values]:
    """made for pairs() of segments: geometry.line_intersection as x, y, and geometry.is_tee."""
    dx, dy, ex, ey = a["ax"] - a["bx"], a["ay"] - a["by"], b["ax"] - b["bx"], b["ay"] - b["by"]
    den = dx * ey - dy * ex
    ok = np.abs(den) >= 1e-9
    den = np.where(ok, den, 1.0)
    ca, cb = a["ax"] * a["by"] - a["ay"] * a["bx"], b["ax"] * b["by"] - b["ay"] * b["bx"]
    at = {"x": (ca * ex - dx * cb) / den, "y": (ca * ey - dy * cb) / den}
    for s in (a, b):
        for k, v in at.items():
            ok &= (v >= np.minimum(s[f"a{k}"], s[f"b{k}"]) - slack) & (v <= np.maximum(s[f"a{k}"], s[f"b{k}"]) + slack)
    ends = [np.minimum(*(np.hypot(at["x"] - s[f"{e}x"], at["y"] - s[f"{e}y"]) for e in "ab")) < reach for s in (a, b)]
    return ok, at | {"tee": ends[0] != ends[1]}


def first_choices(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, detection_id, truth_id): of pairs (keys, detection_id, confidence, truth_id, iou), best detections first, each detection's best truth that is free."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sure, iou = table.column("confidence"), table.column("iou").to_numpy()
        turn = np.where(sure.is_null().to_numpy(), -np.inf, -sure.to_numpy())  # Spark puts null first
        ids = {c: np.unique(table.column(c).to_numpy(), return_inverse=True)[1] for c in ("detection_id", "truth_id")}
        order = np.lexsort((ids["truth_id"], -iou, ids["detection_id"], turn))
        done, used, kept = set(), set(), []
        for k, d, t in zip(order.tolist(), ids["detection_id"][order].tolist(), ids["truth_id"][order].tolist(), strict=True):
            if d not in done and t not in used:
                done.add(d)
                used.add(t)
                kept.append(k)
        return table.select([*keys, "detection_id", "truth_id"]).take(pa.array(kept, pa.int64()))

    fields = [found.schema[c] for c in (*keys, "detection_id", "truth_id")]
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, T.StructType(fields))


#: Offsets of the cells, whose diagonal is a reach, that hold what is within that reach; the own one first.
_AROUND = sorted(((x, y) for x in range(-2, 3) for y in range(-2, 3)), key=lambda o: o[0] ** 2 + o[1] ** 2)


class _Spread:
    """Points no two of which are closer than a reach; a cell has one at most."""

    def __init__(self, reach: float):
        self.reach, self.width = reach, reach / 2**0.5
        self.at: dict[tuple[int, int], tuple[float, float]] = {}
        self.sorted: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]

    def _cells(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.floor(x / self.width).astype(np.int64), np.floor(y / self.width).astype(np.int64)

    def free(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Indices of the points that are not close to any that are held."""
        cells, xs, ys = self.sorted
        left = np.arange(len(x))
        if not len(cells):
            return left
        cx, cy = self._cells(x, y)
        for ox, oy in _AROUND:
            code = (cx[left] + ox) * (1 << 31) + cy[left] + oy
            at = np.minimum(np.searchsorted(cells, code), len(cells) - 1)
            near = (cells[at] == code) & (np.hypot(xs[at] - x[left], ys[at] - y[left]) < self.reach)
            left = left[~near]
        return left

    def add(self, x: np.ndarray, y: np.ndarray) -> list[int]:
        """Takes the points in order, each unless one that is held is close; gives the indices of those taken."""
        taken = []
        candidates = self.free(x, y)
        cx, cy = self._cells(x, y)
        for k in candidates.tolist():
            a, b, px, py = int(cx[k]), int(cy[k]), float(x[k]), float(y[k])
            if not any((o := self.at.get((a + ox, b + oy))) and np.hypot(o[0] - px, o[1] - py) < self.reach for ox, oy in _AROUND):
                self.at[a, b] = (px, py)
                taken.append(k)
        if taken:
            own = np.array(taken)
            code = cx[own] * (1 << 31) + cy[own]
            rows = [np.concatenate([old, new]) for old, new in zip(self.sorted, (code, x[own], y[own]), strict=True)]
            order = np.argsort(rows[0])
            self.sorted = [r[order] for r in rows]
        return taken


def spread_crossings(segments: DataFrame, dots: DataFrame, keys: list[str], margin: float, near_dot: float, near_other: float) -> DataFrame:
    """(keys, k, x, y, tee): where segments (keys, id, ax, ay, bx, by) meet, in order of both ids, without what is close to a dot (keys, x, y) or to an earlier one.

    A page's segments are in one task; its crossings, which grow with their square, are
    looked at stripe by stripe and never held together.
    """
    near = boxes_near(margin)

    def run(key: tuple, lines: pa.Table, spots: pa.Table) -> pa.Table:
        data = columns_of(lines.sort_by("id"), ["ax", "ay", "bx", "by"])
        known = columns_of(spots, ["x", "y"])
        rank = np.asarray(lines.sort_by("id").column("id").combine_chunks().dictionary_encode().indices)
        held, out, size, lo, stripe = _Spread(near_other), [], len(rank), 0, 4
        while lo < size:
            i, j = np.nonzero(near({k: v[lo : lo + stripe, None] for k, v in data.items()}, {k: v[None, lo:] for k, v in data.items()}))
            i, j = i + lo, j + lo
            once = rank[i] < rank[j]
            i, j = i[once], j[once]
            holds, at = crossing({k: v[i] for k, v in data.items()}, {k: v[j] for k, v in data.items()})
            x, y, tee = (at[c][holds] for c in ("x", "y", "tee"))
            for dx, dy in zip(known["x"], known["y"], strict=True):
                far = ~(np.hypot(x - dx, y - dy) < near_dot)
                x, y, tee = x[far], y[far], tee[far]
            taken = held.add(x, y)
            out.append((x[taken], y[taken], tee[taken]))
            lo, stripe = lo + stripe, min(2 * stripe, STRIPE)
        x, y, tee = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3))
        return pa.Table.from_arrays([pa.repeat(k, len(x)) for k in key] + [pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x), pa.array(y), pa.array(tee.astype(bool))], names=[*keys, "k", "x", "y", "tee"])

    schema = T.StructType([*[segments.schema[k] for k in keys], T.StructField("k", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("tee", T.BooleanType())])
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(parts, *keys).groupBy(*keys).cogroup(dots.repartition(parts, *keys).groupBy(*keys)).applyInArrow(run, schema)


def points_beside(margin: float):
    """(near, made) for pairs() of segments and points x, y that lie within their own radius; made has geometry.project_on_segment."""

    def near(a: Values, b: Values) -> np.ndarray:
        ok = True
        for k in ("x", "y"):
            low, high = np.minimum(a[f"a{k}"], a[f"b{k}"]), np.maximum(a[f"a{k}"], a[f"b{k}"])
            ok = ok & (low - margin <= b[k]) & (b[k] <= high + margin)
        return ok

    def made(a: Values, b: Values) -> tuple[np.ndarray, Values]:
        x, y = _projected(b["x"], b["y"], a)
        gap = np.hypot(b["x"] - x, b["y"] - y)
        return gap <= b["radius"], {"x": x, "y": y, "distance": gap}

    return near, made


def points_close(margin: float):
    """(near, made) for pairs() of points rx, ry with a radius of margin at most, and points lx, ly within it; made has gap."""

    def near(a: Values, b: Values) -> np.ndarray:
        return (np.abs(b["lx"] - a["rx"]) <= margin) & (np.abs(b["ly"] - a["ry"]) <= margin)

    def made(a: Values, b: Values) -> tuple[np.ndarray, Values]:
        gap = np.hypot(b["lx"] - a["rx"], b["ly"] - a["ry"])
        return (gap <= margin) & (gap <= a["radius"]), {"gap": gap}

    return near, made


def _projected(px: np.ndarray, py: np.ndarray, s: Values) -> tuple[np.ndarray, np.ndarray]:
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    long = dx * dx + dy * dy
    has = long > 1e-12
    t = np.where(has, np.maximum(0.0, np.minimum(1.0, ((px - s["ax"]) * dx + (py - s["ay"]) * dy) / np.where(has, long, 1.0))), 0.0)
    return s["ax"] + t * dx, s["ay"] + t * dy


def touching(reach: float):
    """made for pairs() of segments: geometry.segment_gap is at most the reach."""

    def gap(px: np.ndarray, py: np.ndarray, s: Values) -> np.ndarray:
        x, y = _projected(px, py, s)
        return np.hypot(px - x, py - y)

    def made(a: Values, b: Values) -> tuple[np.ndarray, Values]:
        gaps = [gap(s["ax"], s["ay"], o) for s, o in ((a, b), (b, a))] + [gap(s["bx"], s["by"], o) for s, o in ((a, b), (b, a))]
        return np.minimum.reduce(gaps) <= reach, {}

    return made
