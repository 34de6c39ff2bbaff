"""Boxes, points and segments as Column expressions.

A box is struct<x1,y1,x2,y2>, a point struct<x,y>, a segment two points; all in
page coordinates from 0 to 1 unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(c(x1).alias("x1"), c(y1).alias("y1"), c(x2).alias("x2"), c(y2).alias("y2"))


def point(x, y) -> Column:
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(c(x).alias("x"), c(y).alias("y"))


def box_of_array(a: Column) -> Column:
    return box(*[F.get(a, k) for k in range(4)])


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = overlap_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union != 0, both / F.when(union != 0, union)).otherwise(0.0)


def valid_box(b: Column) -> Column:
    inside = [b[k].between(0, 1) for k in ("x1", "y1", "x2", "y2")]
    ok = b.isNotNull() & (b["x1"] < b["x2"]) & (b["y1"] < b["y2"])
    for x in inside:
        ok = ok & x
    return F.coalesce(ok, F.lit(False))


def centre(b: Column) -> Column:
    return point((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def _nearness(d: Column, reach: float) -> Column:
    """1 at distance 0, 0 at reach and beyond."""
    return 1.0 - F.least(F.lit(1.0), d / reach)


def symbol_association(text_box: Column, symbol_box: Column, semantic: Column) -> Column:
    """struct(score, distance, semantic, alignment): nearness .52, meaning .30, vertical alignment .18."""
    t, s = centre(text_box), centre(symbol_box)
    near, aligned = _nearness(distance(t, s), 0.24), _nearness(F.abs(t["x"] - s["x"]), 0.22)
    return F.struct(F.round(0.52 * near + 0.3 * semantic + 0.18 * aligned, 4).alias("score"), F.round(near, 4).alias("distance"), semantic.alias("semantic"), F.round(aligned, 4).alias("alignment"))


def entity_association(text_type: Column, text_box: Column, entity_type: Column, entity_box: Column) -> Column:
    """struct(score, distance, semantic, alignment): nearness .55, meaning .25, horizontal alignment .20."""
    t, e = centre(text_box), centre(entity_box)
    near, aligned = _nearness(distance(t, e), 0.32), _nearness(F.abs(t["y"] - e["y"]), 0.2)
    wanted = (
        F.when(text_type == "feeder_id", F.lit("feeder"))
        .when(text_type == "bus_id", F.lit("busbar"))
        .when(text_type.isin("power_rating", "voltage"), F.lit("power_transformer"))
        .when(text_type == "current_rating", F.lit("circuit_breaker"))
        .when(text_type == "equipment_id", entity_type)
    )
    semantic = F.when(wanted == entity_type, 1.0).when(text_type.isin("voltage", "current_rating"), 0.45).otherwise(0.0)
    return F.struct(F.round(0.55 * near + 0.25 * semantic + 0.2 * aligned, 4).alias("score"), F.round(near, 4).alias("distance"), semantic.alias("semantic"), F.round(aligned, 4).alias("alignment"))


def project_on_segment(p: Column, a: Column, b: Column) -> Column:
    """struct(x, y, distance): the segment's point nearest to p; a itself where the segment has no length."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    long = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.when(long > 1e-12, long)))
    t = F.when(long > 1e-12, t).otherwise(0.0)
    x, y = a["x"] + t * dx, a["y"] + t * dy
    return F.struct(x.alias("x"), y.alias("y"), F.hypot(p["x"] - x, p["y"] - y).alias("distance"))


def segment_gap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Smallest distance from an end of either segment to the other; crossings do not count."""
    return F.least(*[project_on_segment(p, *s)["distance"] for p, s in ((a1, (b1, b2)), (a2, (b1, b2)), (b1, (a1, a2)), (b2, (a1, a2)))])


def snap_radius(b: Column, confidence: Column | None = None) -> Column:
    """How far a symbol's terminal reaches; wider for an unsure symbol if its confidence is given."""
    reach = 0.009 + 0.46 * F.hypot(b["x2"] - b["x1"], b["y2"] - b["y1"])
    if confidence is not None:
        sure = F.when(confidence.isNull() | (confidence == 0), 0.5).otherwise(confidence)
        reach = reach * (1 + F.greatest(F.lit(0.0), 0.82 - sure) * 0.3)
    return F.greatest(F.lit(0.018), F.least(F.lit(0.07), reach))


def candidate_scores(gap: Column, radius: Column, visual: Column, bends: Column | None = None) -> Column:
    """struct of the seven scores of a candidate edge; bends: false where its trace has no direction."""
    endpoint = F.greatest(F.lit(0.0), 1 - gap / F.greatest(radius, F.lit(1e-6)))
    orientation = F.lit(0.86) if bends is None else F.when(bends, 0.86).otherwise(0.55)
    terminal = (endpoint + orientation) / 2
    overall = 0.28 * visual + 0.24 * endpoint + 0.18 * orientation + 0.17 * terminal + 0.07 * 0.7 + 0.06 * 0.8
    named = {"visual": visual, "endpoint": endpoint, "orientation": orientation, "terminal": terminal, "junction": F.lit(0.7), "structural": F.lit(0.8), "overall": overall}
    return F.struct(*[v.alias(k) for k, v in named.items()])


def line_intersection(a1: Column, a2: Column, b1: Column, b2: Column, slack: float = 0.003) -> Column:
    """Point where two segments meet, within slack of both boxes; null for parallels."""
    den = (a1["x"] - a2["x"]) * (b1["y"] - b2["y"]) - (a1["y"] - a2["y"]) * (b1["x"] - b2["x"])
    safe = F.when(F.abs(den) >= 1e-9, den)
    ca, cb = a1["x"] * a2["y"] - a1["y"] * a2["x"], b1["x"] * b2["y"] - b1["y"] * b2["x"]
    x = (ca * (b1["x"] - b2["x"]) - (a1["x"] - a2["x"]) * cb) / safe
    y = (ca * (b1["y"] - b2["y"]) - (a1["y"] - a2["y"]) * cb) / safe
    ok = F.lit(True)
    for p, q in ((a1, a2), (b1, b2)):
        for v, k in ((x, "x"), (y, "y")):
            ok = ok & (v >= F.least(p[k], q[k]) - slack) & (v <= F.greatest(p[k], q[k]) + slack)
    return F.when(ok, point(x, y))


def ends_at(p: Column, a: Column, b: Column, reach: float = 0.006) -> Column:
    return F.least(distance(p, a), distance(p, b)) < reach


def is_tee(p: Column, a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """One of two crossing segments ends where they meet, the other runs on."""
    return ends_at(p, a1, a2) != ends_at(p, b1, b2)


def angle_degrees(a: Column, b: Column) -> Column:
    """Direction of a segment, from 0 up to 180."""
    return F.pmod(F.abs(F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))), F.lit(180.0))


def is_slanted(angle: Column) -> Column:
    """Neither level nor upright."""
    return (angle > 8) & (angle < 172) & ~((angle > 82) & (angle < 98))


def terminal_points(symbol_class: Column, b: Column) -> Column:
    """array<struct<name, x, y, orientation, confidence>>: where a symbol of a class connects."""
    level = (symbol_class == "power_transformer") | (b["x2"] - b["x1"] >= 0.5 * (b["y2"] - b["y1"]))
    mid = centre(b)
    spot = lambda name, x, y: F.struct(F.lit(name).alias("name"), x.alias("x"), y.alias("y"), F.when(level, 0).otherwise(90).alias("orientation_deg"), F.when(level, 0.7).otherwise(0.55).alias("orientation_confidence"))
    return (
        F.when(symbol_class.isin("energy_source", "load"), F.array(spot("ATTACH", b["x2"], mid["y"])))
        .when(symbol_class == "feeder_terminal", F.array(spot("ATTACH", b["x1"], mid["y"])))
        .when(level, F.array(spot("IN", b["x1"], mid["y"]), spot("OUT", b["x2"], mid["y"])))
        .otherwise(F.array(spot("IN", mid["x"], b["y1"]), spot("OUT", mid["x"], b["y2"])))
    )


def tile_starts(extent: Column, size: int, overlap: int) -> Column:
    """Origins of tiles along one axis; the last one ends at the edge."""
    last = F.greatest(F.lit(0), extent - size)
    steps = F.sequence(F.lit(0), last, F.lit(size - overlap))
    return F.when(F.element_at(steps, -1) == last, steps).otherwise(F.array_append(steps, last))


def tile_origins(width: Column, height: Column, size: int = 800, overlap: int = 96) -> Column:
    """array<struct<x, y>> of tile origins, row by row."""
    return F.flatten(F.transform(tile_starts(height, size, overlap), lambda y: F.transform(tile_starts(width, size, overlap), lambda x: F.struct(x.alias("x"), y.alias("y")))))


def tile_to_page(b: Column, origin: Column, width: Column, height: Column) -> Column:
    """A box in tile pixels as a page box."""
    return box((b["x1"] + origin["x"]) / width, (b["y1"] + origin["y"]) / height, (b["x2"] + origin["x"]) / width, (b["y2"] + origin["y"]) / height)


def polygon_box(polygon: Column, width: Column, height: Column) -> Column:
    """The page box around array<struct<x, y>> in pixels."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return box(F.array_min(xs) / width, F.array_min(ys) / height, F.array_max(xs) / width, F.array_max(ys) / height)


def visible_share(b: Column, origin: Column, size: int) -> Column:
    """Share of a pixel box inside a tile; boxes under one pixel count as one."""
    w = F.least(origin["x"] + size, b["x2"]) - F.greatest(origin["x"], b["x1"])
    h = F.least(origin["y"] + size, b["y2"]) - F.greatest(origin["y"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h) / F.greatest(F.lit(1.0), area(b))


def scaled(b: Column, width, height) -> Column:
    return box(b["x1"] * width, b["y1"] * height, b["x2"] * width, b["y2"] * height)


def coco_box(b: Column, width, height) -> Column:
    """[x, y, width, height] in pixels."""
    return F.array(b["x1"] * width, b["y1"] * height, (b["x2"] - b["x1"]) * width, (b["y2"] - b["y1"]) * height)


def yolo_line(class_index: Column, b: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_index, (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2, b["x2"] - b["x1"], b["y2"] - b["y1"])


def jittered(b: Column, width: int, height: int, by: int = 2) -> Column:
    """A pixel box and copies shifted by some pixels in each direction, inside the page."""
    shift = lambda dx, dy: box(F.greatest(F.lit(0.0), b["x1"] + dx), F.greatest(F.lit(0.0), b["y1"] + dy), F.least(F.lit(float(width)), b["x2"] + dx), F.least(F.lit(float(height)), b["y2"] + dy))
    return F.array(shift(0, 0), shift(by, by), shift(-by, by), shift(by, -by))


def fit_view(width: Column, height: Column, view_width: Column, view_height: Column) -> Column:
    """struct(scale, dx, dy) that centres a page in a view."""
    scale = F.least(view_width / width, view_height / height)
    return F.struct(scale.alias("scale"), ((view_width - width * scale) / 2).alias("dx"), ((view_height - height * scale) / 2).alias("dy"))


def to_view(p: Column, width: Column, height: Column, view: Column) -> Column:
    return point(p["x"] * width * view["scale"] + view["dx"], p["y"] * height * view["scale"] + view["dy"])


def from_view(p: Column, width: Column, height: Column, view: Column) -> Column:
    return point((p["x"] - view["dx"]) / view["scale"] / width, (p["y"] - view["dy"]) / view["scale"] / height)
