"""Spatial joins and greedy selections over boxes, points and segments.

A join by distance is an equi-join on grid cells as wide as the largest radius,
the probing side repeated over the nine cells around it, and then the exact
test.  Boxes meet in the grid cells that they cover, each pair in one of them.
Greedy selections and matches run in rounds over the pairs that overlap: what no
better undecided box disputes is decided, whatever the size of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.functions.geometry import entity_association, iou, point, project_on_segment, snap_radius, symbol_association, terminal_points
from netsift.functions.text import expected_classes
from netsift.operators import blocks
from netsift.plans.lineage import cut

#: Score from which an association holds, and the widest snap radius.
ASSOCIATED, WIDEST = 0.55, 0.07
#: Side of the grid cells in which boxes in page coordinates (0 to 1) meet.
CELL = 0.125
#: Overlapping pairs of a group that one task decides on matches of.
FOLDED = 2_000_000


def _cells(df: DataFrame, x: Column, y: Column, width: float, around: bool) -> DataFrame:
    """df with cx, cy: the cell of a point, or of it and its eight neighbours."""
    cx, cy = F.floor(x / width).cast("long"), F.floor(y / width).cast("long")
    if not around:
        return df.withColumns({"cx": cx, "cy": cy})
    steps = lambda c: F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: c + k)
    return df.withColumn("cx", F.explode(steps(cx))).withColumn("cy", F.explode(steps(cy)))


def near_points(left: DataFrame, right: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """All pairs (left.*, right.*, gap) of equal keys at most radius apart.  left: lx, ly; right: rx, ry."""
    a = _cells(left, F.col("lx"), F.col("ly"), radius, True)
    b = _cells(right, F.col("rx"), F.col("ry"), radius, False)
    gap = F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))
    return a.join(b, [*keys, "cx", "cy"]).drop("cx", "cy").withColumn("gap", gap).where(F.col("gap") <= radius)


def box_around(a: Column, b: Column, margin: float = 0.0) -> Column:
    """The box of two points, wider by a margin on each side."""
    low = lambda k: F.least(a[k], b[k]) - margin
    high = lambda k: F.greatest(a[k], b[k]) + margin
    return F.struct(low("x").alias("x1"), low("y").alias("y1"), high("x").alias("x2"), high("y").alias("y2"))


def meeting(left: DataFrame, right: DataFrame, keys: list[str], left_box: str, right_box: str, cell: float = CELL) -> DataFrame:
    """All pairs (left.*, right.*) of equal keys whose boxes touch, each once; boxes hold no null.

    A box goes to the cells it covers; a pair counts in the cell of the corner where
    its common part begins.
    """
    at = lambda c: F.floor(c / cell).cast("long")

    def spread(df: DataFrame, box: str) -> DataFrame:
        b = F.col(box)
        df = df.where(b["x1"].isNotNull() & b["y1"].isNotNull() & (b["x2"] >= b["x1"]) & (b["y2"] >= b["y1"]))
        return df.withColumn("cx", F.explode(F.sequence(at(b["x1"]), at(b["x2"])))).withColumn("cy", F.explode(F.sequence(at(b["y1"]), at(b["y2"]))))

    a, b = F.col(left_box), F.col(right_box)
    begin = {k: F.greatest(a[k], b[k]) for k in ("x1", "y1")}
    touch = (begin["x1"] <= F.least(a["x2"], b["x2"])) & (begin["y1"] <= F.least(a["y2"], b["y2"]))
    pairs = spread(left, left_box).join(spread(right, right_box), [*keys, "cx", "cy"])
    return pairs.where(touch & (at(begin["x1"]) == F.col("cx")) & (at(begin["y1"]) == F.col("cy"))).drop("cx", "cy")


def nearest_points(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, k: int, radius: float) -> DataFrame:
    """The k nearest right points within radius of each left point, ties to the smaller right id."""
    order = Window.partitionBy(*keys, left_id).orderBy("gap", right_id)
    return near_points(left, right, keys, radius).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def associate_texts(texts: DataFrame, symbols: DataFrame, threshold: float = ASSOCIATED) -> DataFrame:
    """(analysis_run_id, text_id, symbol_id, score, factors): each text's best symbol of its page, null under the threshold.

    A symbol's rejection takes it out; the engineer's value of a text goes before
    the read one.  Ties go to the smaller symbol id.
    """
    value = F.coalesce(F.nullif("engineer_value", F.lit("")), "normalized_text")
    t = texts.select("analysis_run_id", "page", F.col("id").alias("text_id"), F.col("bbox").alias("tb"), expected_classes(F.col("text_type"), value).alias("classes"))
    s = symbols.where(F.coalesce(F.col("review_status"), F.lit("")) != "rejected").select("analysis_run_id", "page", F.col("id").alias("symbol_id"), F.col("bbox").alias("sb"), "predicted_class")
    pairs = t.join(s, ["analysis_run_id", "page"])
    semantic = F.when(F.array_contains("classes", F.col("predicted_class")), 1.0).otherwise(0.0)
    scored = pairs.withColumn("a", symbol_association(F.col("tb"), F.col("sb"), semantic))
    best = scored.groupBy("analysis_run_id", "text_id").agg(F.min_by(F.struct("symbol_id", "a"), F.struct(-F.col("a.score"), "symbol_id")).alias("b"))
    kept = best.where(F.col("b.a.score") >= threshold)
    factors = F.create_map(F.lit("distance"), F.col("b.a.distance"), F.lit("orientation"), F.lit(1.0), F.lit("semantic"), F.col("b.a.semantic"), F.lit("alignment"), F.col("b.a.alignment"), F.lit("context"), F.lit(0.0))
    found = kept.select("analysis_run_id", "text_id", F.col("b.symbol_id").alias("symbol_id"), F.col("b.a.score").alias("score"), factors.alias("factors"))
    return texts.select("analysis_run_id", F.col("id").alias("text_id")).join(found, ["analysis_run_id", "text_id"], "left").fillna(0.0, ["score"])


def associate_entities(texts: DataFrame, entities: DataFrame, keys: list[str], threshold: float = ASSOCIATED) -> DataFrame:
    """(keys, text_id, entity_id, score): the other weighting, over (entity_id, entity_type, bbox) of the same keys."""
    e = entities.select(*keys, "entity_id", "entity_type", F.col("bbox").alias("eb"))
    pairs = texts.select(*keys, "text_id", "text_type", F.col("bbox").alias("tb")).join(e, keys)
    scored = pairs.withColumn("score", entity_association(F.col("text_type"), F.col("tb"), F.col("entity_type"), F.col("eb"))["score"])
    best = scored.groupBy(*keys, "text_id").agg(F.min_by(F.struct("entity_id", "score"), F.struct(-F.col("score"), "entity_id")).alias("b")).select(*keys, "text_id", "b.*")
    return texts.select(*keys, "text_id").join(best.where(F.col("score") >= threshold), [*keys, "text_id"], "left").fillna(0.0, ["score"])


def terminals_of(symbols: DataFrame) -> DataFrame:
    """The terminals that symbols' classes and boxes imply; ids name their symbol."""
    p = symbols.withColumn("p", F.explode(terminal_points(F.col("predicted_class"), F.col("bbox"))))
    return p.select(
        "analysis_run_id", F.concat(F.lit("terminal:"), "id", F.lit(":"), F.lower("p.name")).alias("id"), F.col("id").alias("symbol_id"), F.col("predicted_class").alias("symbol_class"), "page",
        F.col("p.name").alias("name"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.orientation_deg").alias("orientation_deg"), F.col("p.orientation_confidence").alias("orientation_confidence"),
    )


def reach(terminals: DataFrame, symbols: DataFrame, unsure: bool = True) -> DataFrame:
    """terminals with radius: how far each snaps."""
    radius = snap_radius(F.col("bbox"), F.col("confidence") if unsure else None)
    return terminals.join(symbols.select("analysis_run_id", F.col("id").alias("symbol_id"), radius.alias("radius")), ["analysis_run_id", "symbol_id"])


def snap_points(points: DataFrame, terminals: DataFrame, symbols: DataFrame) -> DataFrame:
    """points (analysis_run_id, page, key, lx, ly) with the nearest terminal in whose own radius they lie, or null."""
    run = ["analysis_run_id", "page"]
    t = reach(terminals, symbols)
    name = F.to_json(F.struct("key"))  # ids of both sides are texts
    left = t.select(*run, "id", F.col("x").cast("double").alias("rx"), F.col("y").cast("double").alias("ry"), "radius", F.lit(0.0).alias("all"))
    right = points.select(*run, name.alias("id"), F.col("lx").cast("double").alias("lx"), F.col("ly").cast("double").alias("ly"))
    near = blocks.pairs(left, right, run, *blocks.points_close(WIDEST), {"gap": T.DoubleType()}, least=("all", "gap"))
    near = near.select(*run, F.col("a").alias("terminal_id"), F.col("b").alias("name"), "gap").join(t.select(*run, F.col("id").alias("terminal_id"), "symbol_id"), [*run, "terminal_id"])
    best = near.groupBy(*run, "name").agg(F.min_by(F.struct("terminal_id", "symbol_id", "gap"), F.struct("gap", "terminal_id")).alias("b"))
    return points.withColumn("name", name).join(best, [*run, "name"], "left").select(*points.columns, "b.*")


def snap_segments(segments: DataFrame, terminals: DataFrame, symbols: DataFrame) -> DataFrame:
    """segments (analysis_run_id, page, id, polyline) with the terminal nearest to their whole span, or null."""
    t = reach(terminals, symbols).select("analysis_run_id", "page", F.col("id").alias("terminal_id"), "symbol_id", "x", "y", "radius")
    line = F.col("polyline")
    on = project_on_segment(point(F.col("x"), F.col("y")), F.get(line, 0), F.element_at(line, -1))
    spans = segments.withColumn("span", box_around(F.get(line, 0), F.element_at(line, -1), WIDEST))
    t = t.withColumn("spot", F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2")))
    near = meeting(spans, t, ["analysis_run_id", "page"], "span", "spot").withColumn("on", on).where("on.distance <= radius")
    best = near.groupBy("analysis_run_id", "page", "id").agg(F.min_by(F.struct("terminal_id", "symbol_id", "on"), F.struct("on.distance", "terminal_id")).alias("b"))
    return segments.join(best, ["analysis_run_id", "page", "id"], "left").select(*segments.columns, "b.*")


def suppress(boxes: DataFrame, keys: list[str], id_col: str = "id", threshold: float = 0.45, order: Column | None = None) -> DataFrame:
    """boxes (keys, id, confidence, bbox) without those that overlap a better one of the same keys.

    keys with the class make it class-aware, without it class-agnostic; with the
    normalised text they merge regions.  Best first by confidence, ties by id;
    order: another ascending order, as that of arrival.  In each round the boxes
    that no better one disputes stay, and those that they overlap go.
    """
    rank = F.struct(-F.col("confidence"), F.col(id_col)) if order is None else F.struct(order, F.col(id_col))
    ranks = boxes.select(*keys, F.col(id_col).alias("id"), rank.alias("rank"))
    pairs = overlapping_pairs(boxes, keys, threshold, id_col)
    side = lambda n: ranks.select(*keys, F.col("id").alias(n), F.col("rank").alias(f"{n}_rank"))
    first = F.col("a_rank") < F.col("b_rank")
    pairs = pairs.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    open_ = cut(pairs.select(*keys, F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse")))
    gone = []
    while not open_.isEmpty():
        disputed = open_.select(*keys, F.col("worse").alias("better"))
        out = cut(open_.join(disputed, [*keys, "better"], "left_anti").select(*keys, "worse").distinct())
        gone.append(out)
        open_ = cut(open_.join(out, [*keys, "worse"], "left_anti").join(out.withColumnRenamed("worse", "better"), [*keys, "better"], "left_anti"))
    if not gone:
        return boxes
    return boxes.join(reduce(DataFrame.unionByName, gone).withColumnRenamed("worse", id_col), [*keys, id_col], "left_anti")


def _flat(df: DataFrame, keys: list[str], id_col: str, box: str = "bbox") -> DataFrame:
    """(keys, id, x1, y1, x2, y2) of boxes that are none the wrong way round."""
    b = F.col(box)
    rows = df.where((b["x2"] >= b["x1"]) & (b["y2"] >= b["y1"]))
    return rows.select(*keys, F.col(id_col).alias("id"), *[b[k].cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")])


def overlapping_pairs(boxes: DataFrame, keys: list[str], threshold: float, id_col: str = "id") -> DataFrame:
    """(keys, a, b, iou) of all pairs of equal keys with at least the threshold, above 0, of overlap."""
    return blocks.pairs(_flat(boxes, keys, id_col), None, keys, *blocks.boxes_overlap(threshold), {"iou": T.DoubleType()})


def match_detections(detections: DataFrame, truth: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """(keys, detection_id, truth_id): greedy one-to-one matches of equal keys, best detections first.

    detections: (keys, detection_id, confidence, bbox); truth: (keys, truth_id, bbox).
    A detection takes the unused truth box it overlaps most, if by the threshold;
    ties go to the smaller id.  Groups of at most FOLDED overlapping pairs are decided
    in one pass each; of larger ones, in each round a detection and a truth box that
    are each other's first choice match.
    """
    turns = detections.select(*keys, "detection_id", "confidence")
    pairs = blocks.pairs(_flat(detections, keys, "detection_id"), _flat(truth, keys, "truth_id"), keys, *blocks.boxes_overlap(threshold), {"iou": T.DoubleType()})
    pairs = cut(pairs.withColumnsRenamed({"a": "detection_id", "b": "truth_id"}).join(turns, [*keys, "detection_id"]).select(*keys, "detection_id", F.col("confidence").cast("double").alias("confidence"), "truth_id", "iou"))
    large = cut(pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLDED).select(*keys))
    found = [blocks.first_choices(pairs.join(large, keys, "left_anti"), keys)]
    open_ = cut(pairs.join(large, keys, "left_semi").select(*keys, "detection_id", F.struct(-F.col("confidence"), F.col("detection_id")).alias("turn"), "truth_id", "iou"))
    while not open_.isEmpty():
        wants = open_.groupBy(*keys, "detection_id").agg(F.min_by("truth_id", F.struct(-F.col("iou"), F.col("truth_id"))).alias("truth_id"))
        first = open_.groupBy(*keys, "truth_id").agg(F.min_by("detection_id", "turn").alias("detection_id"))
        match = cut(wants.join(first, [*keys, "detection_id", "truth_id"]).select(*keys, "detection_id", "truth_id"))
        found.append(match)
        open_ = cut(open_.join(match.select(*keys, "detection_id"), [*keys, "detection_id"], "left_anti").join(match.select(*keys, "truth_id"), [*keys, "truth_id"], "left_anti"))
    return reduce(DataFrame.unionByName, found)


def map_to_truth(symbols: DataFrame, truth: DataFrame, keys: list[str], threshold: float = 0.25) -> DataFrame:
    """(keys, symbol_id, truth_id): the truth box of equal keys that each symbol overlaps most; several may share one."""
    pairs = meeting(symbols.select(*keys, "symbol_id", F.col("bbox").alias("sb")), truth.select(*keys, "truth_id", F.col("bbox").alias("tb")), keys, "sb", "tb").withColumn("iou", iou(F.col("sb"), F.col("tb")))
    best = pairs.groupBy(*keys, "symbol_id").agg(F.min_by(F.struct("truth_id", "iou"), F.struct(-F.col("iou"), "truth_id")).alias("b"))
    return best.where(F.col("b.iou") >= threshold).select(*keys, "symbol_id", F.col("b.truth_id").alias("truth_id"))


def match_labels(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected_id, observed_id, errors): labels in order, each held against the unused observed one of least edit distance.

    expected: (keys, expected_id, label); observed: (keys, observed_id, label).
    observed_id is set, and used up, only by an exact hit; with nothing left the
    whole label counts as errors.
    """
    e = expected.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("expected_id", "label"))).alias("es"))
    o = observed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("observed_id", "label"))).alias("os"))
    o_type = observed.schema["observed_id"].dataType

    def step(state: Column, x: Column) -> Column:
        tried = F.transform(state["free"], lambda y: F.struct(F.levenshtein(x["label"], y["label"]).alias("d"), y["observed_id"].alias("id")))
        best = F.array_min(tried)
        hit = F.when(best["d"] == 0, best["id"])
        found = F.struct(x["expected_id"].alias("expected_id"), hit.alias("observed_id"), F.coalesce(best["d"], F.length(x["label"])).alias("errors"))
        return F.struct(F.filter(state["free"], lambda y: hit.isNull() | (y["observed_id"] != hit)).alias("free"), F.array_append(state["found"], found).alias("found"))

    both = e.join(o, keys, "left").withColumn("os", F.coalesce("os", F.array().cast(o.schema["os"].dataType)))
    empty = F.transform(F.filter("es", lambda x: F.lit(False)), lambda x: F.struct(x["expected_id"].alias("expected_id"), F.lit(None).cast(o_type).alias("observed_id"), F.lit(0).alias("errors")))
    return both.select(*keys, F.explode(F.aggregate("es", F.struct(F.col("os").alias("free"), empty.alias("found")), step, lambda s: s["found"])).alias("m")).select(*keys, "m.*")


def merge_row_boxes(boxes: DataFrame, keys: list[str], rise: float = 30, gap: float = 36) -> DataFrame:
    """(keys, bbox, is_bus): boxes of one text row joined from left to right, in reading order; buses stay apart.

    boxes: (keys, bbox in pixels, is_bus).  A box joins the first merged box whose
    middle is less than rise off and that ends less than gap to its left.
    """
    one = F.struct(F.col("bbox.y1").alias("y1"), F.col("bbox.x1").alias("x1"), F.col("bbox.x2").alias("x2"), F.col("bbox.y2").alias("y2"), F.col("is_bus").alias("is_bus"))
    held = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("all"))
    joins = lambda o, x: ~o["is_bus"] & ~x["is_bus"] & (F.abs((o["y1"] + o["y2"]) / 2 - (x["y1"] + x["y2"]) / 2) < rise) & (x["x1"] - o["x2"] >= 0) & (x["x1"] - o["x2"] < gap)

    def step(merged: Column, x: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(merged, lambda o: joins(o, x)), True), F.lit(0))
        grown = F.transform(merged, lambda o, k: F.when(k + 1 == at, F.struct(F.least(o["y1"], x["y1"]).alias("y1"), o["x1"].alias("x1"), x["x2"].alias("x2"), F.greatest(o["y2"], x["y2"]).alias("y2"), F.lit(False).alias("is_bus"))).otherwise(o))
        return F.when(at > 0, grown).otherwise(F.array_append(merged, x))

    done = held.select(*keys, F.explode(F.aggregate("all", F.filter("all", lambda x: F.lit(False)), step)).alias("b"))
    return done.select(*keys, F.struct("b.x1", "b.y1", "b.x2", "b.y2").alias("bbox"), F.col("b.is_bus").alias("is_bus"))


def distinct_segments(segments: DataFrame, keys: list[str], grid: float = 5) -> DataFrame:
    """segments (keys, ord, x1, y1, x2, y2 in pixels), the first of each that look alike on a grid, either way round."""
    r = lambda c: F.rint(F.col(c) / grid).cast("long")
    a, b = F.struct(r("x1").alias("x"), r("y1").alias("y")), F.struct(r("x2").alias("x"), r("y2").alias("y"))
    w = Window.partitionBy(*keys, F.sort_array(F.array(a, b))).orderBy("ord")
    return segments.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def coupler_boxes(buses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left_id, right_id, bbox in pixels): where a coupler lies between two buses of one level.  buses: (keys, id, bbox)."""
    side = lambda n: buses.select(*keys, F.col("id").alias(f"{n}_id"), F.col("bbox").alias(n))
    mid = lambda n: (F.col(f"{n}.y1") + F.col(f"{n}.y2")) / 2
    order = lambda n: F.struct(f"{n}.x1", f"{n}.y1", f"{n}.x2", f"{n}.y2", f"{n}_id")
    gap = F.col("right.x1") - F.col("left.x2")
    pairs = side("left").join(side("right"), keys).where(order("left") < order("right")).where((F.abs(mid("left") - mid("right")) <= 14) & gap.between(70, 250))
    half = F.floor(F.round(F.least(F.lit(110.0), F.greatest(F.lit(56.0), gap * 0.48))) / 2)
    cx, cy = F.round((F.col("left.x2") + F.col("right.x1")) / 2), F.round((mid("left") + mid("right")) / 2)
    return pairs.select(*keys, "left_id", "right_id", F.struct(F.greatest(F.lit(0.0), cx - half).alias("x1"), F.greatest(F.lit(0.0), cy - half).alias("y1"), (cx + half).alias("x2"), (cy + half).alias("y2")).alias("bbox"))


def longest_run(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """(keys, n, supported, longest): length of the longest unbroken run of a true flag, by gaps and islands."""
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    island = F.row_number().over(Window.partitionBy(*keys, flag).orderBy(order))
    runs = rows.withColumn("pos", pos).withColumn("island", F.col("pos") - island)
    per_run = runs.groupBy(*keys, flag, "island").agg(F.count(F.lit(1)).alias("len"))
    return per_run.groupBy(*keys).agg(F.sum("len").alias("n"), F.coalesce(F.sum(F.when(F.col(flag), F.col("len"))), F.lit(0)).alias("supported"), F.coalesce(F.max(F.when(F.col(flag), F.col("len"))), F.lit(0)).alias("longest"))
