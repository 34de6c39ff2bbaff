"""From conductors, symbols and junctions to physical connections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.functions.evidence import equipment_type, or_default, review_status
from netsift.functions.geometry import candidate_scores, distance, point
from netsift.operators import blocks
from netsift.operators.components import connected_components
from netsift.operators.spatial import WIDEST, near_points, reach, snap_points
from netsift.plans.lineage import cut

RUN = ["analysis_run_id", "page"]
#: How far outside a segment an intersection may lie, and more than that.
OUTSIDE = 0.004


def _ends(conductors: DataFrame) -> DataFrame:
    """(run, page, id, confidence, bends, s, e): first and last point of each trace."""
    return conductors.select(*RUN, "id", "confidence", "polyline", (F.size("polyline") >= 2).alias("bends"), F.get("polyline", 0).alias("s"), F.element_at("polyline", -1).alias("e"))


def _snapped(conductors: DataFrame, terminals: DataFrame, symbols: DataFrame) -> DataFrame:
    """_ends with st, et: struct(terminal_id, symbol_id, gap) at either end, or null."""
    ends = _ends(conductors)
    points = ends.select(*RUN, F.explode(F.array(F.struct(F.lit("s").alias("w"), "s.*"), F.struct(F.lit("e").alias("w"), "e.*"))).alias("p"), "id")
    points = points.select(*RUN, F.struct("id", F.col("p.w").alias("w")).alias("key"), F.col("p.x").alias("lx"), F.col("p.y").alias("ly"))
    hit = snap_points(points, terminals, symbols)
    at = hit.groupBy(*RUN, F.col("key.id").alias("id")).agg(*[F.max(F.when((F.col("key.w") == w) & F.col("terminal_id").isNotNull(), F.struct("terminal_id", "symbol_id", "gap"))).alias(f"{w}t") for w in ("s", "e")])
    return ends.join(at, [*RUN, "id"])


def _candidates(df: DataFrame, id_: Column, left: Column, right: Column, line: Column, scores: Column, overall: Column, provenance: str, status, reason=None, gap_bridge: bool = False, conductor=None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    s = df.withColumn("__s", scores)
    named = [F.round(f"__s.{k}", 4).alias(k) for k in ("visual", "endpoint", "orientation", "terminal", "junction", "structural")]
    return s.select(
        *RUN, id_.alias("id"), left.alias("from_node_id"), right.alias("to_node_id"), lit(conductor).cast("string").alias("conductor_id"), line.alias("polyline"), *named, F.round(overall, 4).alias("overall_confidence"),
        F.lit(provenance).alias("provenance"), lit(status).alias("review_status"), lit(reason).cast("string").alias("review_reason"), F.lit(gap_bridge).alias("gap_bridge"),
    )


def endpoint_candidates(conductors: DataFrame, terminals: DataFrame, symbols: DataFrame) -> DataFrame:
    """One candidate for each trace whose two ends snap to terminals of different symbols."""
    return _between_ends(_snapped(conductors, terminals, symbols))


def _between_ends(snapped: DataFrame) -> DataFrame:
    c = snapped.where("st is not null and et is not null and st.symbol_id <> et.symbol_id")
    radius = F.greatest(F.lit(0.014), F.col("st.gap"), F.col("et.gap"))
    scores = candidate_scores((F.col("st.gap") + F.col("et.gap")) / 2, radius * 1.8, F.col("confidence"), F.col("bends"))
    weak = F.col("__s.overall") < 0.72
    return _candidates(c, F.concat(F.lit("candidate:"), "id"), F.col("st.terminal_id"), F.col("et.terminal_id"), F.col("polyline"), scores, F.col("__s.overall"), "wire_trace+terminal_snap", F.when(weak, "pending").otherwise("unreviewed"), F.when(weak, "LOW_CONNECTIVITY_CONFIDENCE"), conductor=F.col("id"))


def conductor_groups(conductors: DataFrame, reach_: float = 0.012) -> DataFrame:
    """(run, page, id, grp): traces that touch end to span; crossings in the middle do not join."""
    lines = _flat(_ends(conductors).select(*RUN, "id", F.col("s").alias("a"), F.col("e").alias("b")), RUN)
    touch = blocks.pairs(lines, None, RUN, blocks.boxes_near(reach_), blocks.touching(reach_), {}, spans=True)
    key = lambda c: F.struct(*RUN, F.col(c).alias("id"))
    found = connected_components(touch.select(key("a").alias("src"), key("b").alias("dst"))).select("node.*", F.col("component.id").alias("grp"))
    return conductors.select(*RUN, "id").join(found, [*RUN, "id"], "left").withColumn("grp", F.coalesce("grp", "id"))


def group_candidates(conductors: DataFrame, terminals: DataFrame, symbols: DataFrame) -> DataFrame:
    """Candidates from terminals beside the spans of touching traces: of two attached symbols, or of one bus to each other symbol."""
    groups = cut(conductor_groups(conductors))
    t = reach(terminals, symbols, unsure=False).select(*RUN, F.col("id").alias("terminal_id"), "symbol_id", "symbol_class", F.struct("x", "y").alias("at"), "radius")
    lines = _ends(conductors).join(groups, [*RUN, "id"])
    sure = lines.groupBy(*RUN, "grp").agg(F.min("confidence").alias("confidence"))
    # of the traces of a group that a terminal lies beside only the nearest matters
    nth = F.dense_rank().over(Window.partitionBy(*RUN).orderBy("grp")).cast("double")
    flat = _flat(lines.select(*RUN, "id", F.col("s").alias("a"), F.col("e").alias("b")), RUN).join(lines.select(*RUN, "id", nth.alias("g")), [*RUN, "id"])
    spots = t.select(*RUN, F.col("terminal_id").alias("id"), F.col("at.x").cast("double").alias("x"), F.col("at.y").cast("double").alias("y"), "radius")
    beside = blocks.pairs(flat, spots, RUN, *blocks.points_beside(WIDEST), {c: T.DoubleType() for c in ("x", "y", "distance")}, least=("g", "distance"))
    near = beside.select(*RUN, F.col("a").alias("id"), F.col("b").alias("terminal_id"), F.struct("x", "y", "distance").alias("on")).join(lines.select(*RUN, "id", "grp"), [*RUN, "id"]).join(t, [*RUN, "terminal_id"])
    att = near.groupBy(*RUN, "grp", "symbol_id", "symbol_class").agg(F.min_by(F.struct("terminal_id", F.struct("on.x", "on.y").alias("p"), F.col("on.distance").alias("gap"), "radius"), F.struct("on.distance", "terminal_id", "id")).alias("a"))
    att = att.select(*RUN, "grp", "symbol_id", "symbol_class", "a.*")
    over = Window.partitionBy(*RUN, "grp")
    att = att.withColumn("n", F.count(F.lit(1)).over(over)).withColumn("buses", F.count_if(F.col("symbol_class") == "busbar").over(over)).where("n = 2 or (n > 2 and buses = 1)")
    side = lambda n: att.select(*RUN, "grp", F.col("n").alias("n"), "buses", F.struct("terminal_id", "symbol_id", "symbol_class", "p", "gap", "radius").alias(n))
    pairs = side("l").where("n = 2 or l.symbol_class = 'busbar'").join(side("r").drop("n", "buses"), [*RUN, "grp"])
    pairs = pairs.where("(n = 2 and l.terminal_id < r.terminal_id) or (n > 2 and buses = 1 and l.symbol_class = 'busbar' and r.symbol_id <> l.symbol_id)").join(sure, [*RUN, "grp"])
    nth = F.row_number().over(Window.partitionBy(*RUN, "grp").orderBy("r.terminal_id")) - 1
    pairs = pairs.withColumn("nth", nth)
    scores = candidate_scores((F.col("l.gap") + F.col("r.gap")) / 2, F.greatest("l.radius", "r.radius") * 1.45, F.col("confidence"))
    return _candidates(pairs, F.concat_ws(":", F.lit("candidate:component"), "grp", "nth"), F.col("l.terminal_id"), F.col("r.terminal_id"), F.array("l.p", "r.p"), scores, F.greatest(F.lit(0.76), F.col("__s.overall")), "segment_component+terminal_projection", "unreviewed")


def gap_candidates(conductors: DataFrame, terminals: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bridges over short gaps between two traces in line, each held by a terminal at its far end; for review."""
    return _over_gaps(_snapped(conductors, terminals, symbols))


def _over_gaps(snapped: DataFrame) -> DataFrame:
    c = snapped.where("(st is null) <> (et is null)")
    held = F.coalesce("st", "et")
    start = F.col("st").isNotNull()
    part = c.select(*RUN, "id", "confidence", held.alias("t"), F.when(start, F.col("s")).otherwise(F.col("e")).alias("anchor"), F.when(start, F.col("e")).otherwise(F.col("s")).alias("free")).where("t.gap <= 0.055")
    left = part.select(*RUN, *[F.col(k).alias(f"l_{k}") for k in ("id", "confidence", "t", "anchor", "free")], F.col("free.x").alias("lx"), F.col("free.y").alias("ly"))
    right = part.select(*RUN, *[F.col(k).alias(f"r_{k}") for k in ("id", "confidence", "t", "anchor", "free")], F.col("free.x").alias("rx"), F.col("free.y").alias("ry"))
    pairs = near_points(left, right, RUN, 0.035).where("l_id < r_id and l_t.symbol_id <> r_t.symbol_id")
    run = lambda s, k: F.col(f"{s}_free.{k}") - F.col(f"{s}_anchor.{k}")
    norm = lambda s: F.greatest(F.lit(1e-6), F.hypot(run(s, "x"), run(s, "y")))
    pairs = pairs.withColumn("aligned", F.abs((run("l", "x") * run("r", "x") + run("l", "y") * run("r", "y")) / (norm("l") * norm("r")))).where("aligned >= 0.94")
    weak = F.least("l_confidence", "r_confidence")
    scores = F.struct((weak * F.col("aligned")).alias("visual"), F.lit(0.82).alias("endpoint"), F.col("aligned").alias("orientation"), F.lit(0.82).alias("terminal"), F.lit(0.5).alias("junction"), F.lit(0.62).alias("structural"))
    return _candidates(pairs, F.concat_ws(":", F.lit("candidate:gap"), "l_id", "r_id"), F.col("l_t.terminal_id"), F.col("r_t.terminal_id"), F.array("l_anchor", "l_free", "r_free", "r_anchor"), scores, 0.38 + 0.18 * F.col("aligned") + 0.15 * weak, "masked_gap_bridge", "pending", "GAP_BRIDGE_REVIEW", gap_bridge=True)


def corridor_pairs(terminals: DataFrame, reach_: float = 0.11, offset: float = 0.008) -> DataFrame:
    """(run, page, left, right): close terminals of different symbols on one level or one upright."""
    side = lambda n, x, y: terminals.select(*RUN, F.struct("id", "symbol_id", F.struct("x", "y").alias("at")).alias(n), F.col("x").alias(x), F.col("y").alias(y))
    pairs = near_points(side("l", "lx", "ly"), side("r", "rx", "ry"), RUN, reach_).where("l.id < r.id and l.symbol_id <> r.symbol_id")
    return pairs.where(F.least(F.abs(F.col("lx") - F.col("rx")), F.abs(F.col("ly") - F.col("ry"))) <= offset).select(*RUN, "l", "r", "gap")


def corridor_candidates(supported: DataFrame) -> DataFrame:
    """Candidates of corridor_pairs with coverage and longest: shares of their length that have ink, in all and in one run."""
    c = supported.where("coverage >= 0.2 and longest >= 0.16")
    scores = F.struct(F.col("coverage").alias("visual"), F.least(F.lit(1.0), F.col("longest") + 0.35).alias("endpoint"), F.lit(0.9).alias("orientation"), F.lit(0.92).alias("terminal"), F.lit(0.7).alias("junction"), F.lit(0.76).alias("structural"))
    thin = F.col("coverage") < 0.36
    return _candidates(c, F.concat_ws(":", F.lit("candidate:corridor"), "l.id", "r.id"), F.col("l.id"), F.col("r.id"), F.array("l.at", "r.at"), scores, F.least(F.lit(0.9), 0.45 + F.col("coverage") * 0.38 + F.col("longest") * 0.18), "terminal_corridor_scan", F.when(thin, "pending").otherwise("unreviewed"), F.when(thin, "CORRIDOR_REVIEW"))


def select_connections(candidates: DataFrame) -> DataFrame:
    """candidates with rank: 1 is the strongest of its unordered terminal pair, ties by id; those are the connections."""
    pair = Window.partitionBy(*RUN, F.least("from_node_id", "to_node_id"), F.greatest("from_node_id", "to_node_id")).orderBy(F.col("overall_confidence").desc(), "id")
    return candidates.withColumn("rank", F.row_number().over(pair))


def topology_issues(ranked: DataFrame, terminals: DataFrame) -> DataFrame:
    """(run, page, id, kind, related_id): duplicates, gap bridges, weak edges, orphan and crowded terminals."""
    issue = lambda df, short, kind: df.select(*RUN, F.concat(F.lit(f"issue:{short}:"), "id").alias("id"), F.lit(kind).alias("kind"), F.col("id").alias("related_id"))
    kept = ranked.where("rank = 1")
    ends = kept.select(*RUN, F.explode(F.array("from_node_id", "to_node_id")).alias("id"), F.struct(F.least("from_node_id", "to_node_id"), F.greatest("from_node_id", "to_node_id")).alias("pair"))
    degree = terminals.select(*RUN, "id", "symbol_class").join(ends.groupBy(*RUN, "id").agg(F.count_distinct("pair").alias("degree")), [*RUN, "id"], "left").fillna(0, ["degree"])
    parts = [
        issue(ranked.where("rank > 1"), "duplicate", "DUPLICATE_EDGE"), issue(kept.where("gap_bridge"), "gap", "GAP_BRIDGE_REVIEW"), issue(kept.where("overall_confidence < 0.58"), "low", "LOW_CONFIDENCE_EDGE"),
        issue(degree.where("degree = 0"), "orphan", "ORPHAN_TERMINAL"), issue(degree.where("degree > 2 and symbol_class in ('circuit_breaker', 'disconnector', 'bus_coupler')"), "degree", "DEVICE_DEGREE_WARNING"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _flat(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, ax, ay, bx, by) of segments (keys, id, a, b)."""
    return segments.select(*keys, "id", *[F.col(f"{e}.{k}").cast("double").alias(f"{e}{k}") for e in "ab" for k in "xy"])


def meetings(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, x, y, tee) of all pairs of segments (keys, id, a, b) of equal keys that meet, a < b."""
    return blocks.pairs(_flat(segments, keys), None, keys, blocks.boxes_near(2 * OUTSIDE), blocks.crossing, {"x": T.DoubleType(), "y": T.DoubleType(), "tee": T.BooleanType()})


def crossings(conductors: DataFrame, junctions: DataFrame, near_dot: float = 0.012, near_other: float = 0.008) -> DataFrame:
    """(run, page, id, x, y, kind, reason): where traces meet away from known junctions.

    A tee, one trace ending on another, is connected; a bare cross stays
    ambiguous.  Pairs are taken in id order and one that falls beside an earlier
    find is dropped.
    """
    lines = _flat(_ends(conductors).select(*RUN, "id", F.col("s").alias("a"), F.col("e").alias("b")), RUN)
    done = blocks.spread_crossings(lines, junctions.select(*RUN, F.col("x").cast("double"), F.col("y").cast("double")), RUN, 2 * OUTSIDE, near_dot, near_other)
    return done.select(*RUN, F.format_string("crossing:%03d", "k").alias("id"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.when(F.col("tee"), "connected_junction").otherwise("ambiguous_crossing").alias("kind"), F.when(F.col("tee"), "t_endpoint_intersection").otherwise("line_intersection_without_dot").alias("reason"))


def buses(conductors: DataFrame, symbols: DataFrame) -> DataFrame:
    """(run, page, id, polyline, confidence, symbol_id): bus symbols, and long level traces on no bus's level yet."""
    b = F.col("bbox")
    mid_x, mid_y = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    level = b["x2"] - b["x1"] >= b["y2"] - b["y1"]
    line = F.when(level, F.array(point(b["x1"], mid_y), point(b["x2"], mid_y))).otherwise(F.array(point(mid_x, b["y1"]), point(mid_x, b["y2"])))
    sure = F.least(F.lit(0.98), F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5)))
    own = symbols.where("predicted_class = 'busbar'").select(*RUN, F.concat(F.lit("bus:"), "id").alias("id"), line.alias("polyline"), sure.alias("confidence"), F.col("id").alias("symbol_id"))
    long = _ends(conductors).where((distance(F.col("s"), F.col("e")) >= 0.18) & (F.abs(F.col("e.y") - F.col("s.y")) <= 0.012))
    levels = own.groupBy(*RUN).agg(F.collect_list((F.get("polyline", 0)["y"] + F.element_at("polyline", -1)["y"]) / 2).alias("ys"))
    free = long.join(levels, RUN, "left").where(~F.coalesce(F.exists("ys", lambda y: F.abs(y - F.col("s.y")) < 0.02), F.lit(False)))
    listed = free.groupBy(*RUN).agg(F.sort_array(F.collect_list(F.struct("id", "polyline", "confidence", F.col("s.y").alias("y"), ((F.col("s.y") + F.col("e.y")) / 2).alias("mid")))).alias("all"))
    kept = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), lambda k, x: F.when(F.exists(k, lambda o: F.abs(o["mid"] - x["y"]) < 0.02), k).otherwise(F.array_append(k, x)))
    found = listed.select(*RUN, F.explode(kept).alias("c")).select(*RUN, F.concat(F.lit("bus:geometry:"), "c.id").alias("id"), F.col("c.polyline").alias("polyline"), F.col("c.confidence").alias("confidence"), F.lit(None).cast("string").alias("symbol_id"))
    return own.unionByName(found)


def reconstruct(conductors: DataFrame, terminals: DataFrame, symbols: DataFrame, corridors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, ranked candidates, issues) of all pages; rank 1 are the physical connections."""
    snapped = cut(_snapped(conductors, terminals, symbols))
    parts = [_between_ends(snapped), group_candidates(conductors, terminals, symbols), _over_gaps(snapped)]
    if corridors is not None:
        parts.append(corridor_candidates(corridors))
    candidates = reduce(DataFrame.unionByName, parts)
    ranked = cut(select_connections(candidates))  # the issues read it several times
    return candidates, ranked, topology_issues(ranked, terminals)


def graph_tables(symbols: DataFrame, labels: DataFrame, states: DataFrame, terminals: DataFrame, connections: DataFrame, keep_rejected: bool = True) -> dict[str, DataFrame]:
    """Graph tables of analysed runs.  labels: (analysis_run_id, symbol_id, value, text_type, score), the best one a symbol counts."""
    best = labels.where("symbol_id is not null and value <> ''").groupBy("analysis_run_id", "symbol_id").agg(F.min_by(F.struct("value", "text_type", "score"), F.struct(-F.col("score"), "value")).alias("l"))
    kind = equipment_type(F.col("predicted_class"))
    rows = symbols if keep_rejected else symbols.where("review_status <> 'rejected'")
    rows = rows.join(best, (symbols["analysis_run_id"] == best["analysis_run_id"]) & (symbols["id"] == best["symbol_id"]), "left").drop(best["analysis_run_id"])
    rows = rows.join(states.select("analysis_run_id", F.col("equipment_id").alias("id"), "state"), ["analysis_run_id", "id"], "left")
    label = F.coalesce("l.value", "predicted_class")
    kind_of_text = F.coalesce("l.text_type", F.lit("unknown"))
    attributes = F.map_filter(
        F.create_map(
            F.lit("text_type"), kind_of_text, F.lit("text_association_confidence"), F.coalesce("l.score", F.lit(0.0)).cast("string"),
            F.lit("switch_state"), F.when(kind.isin("circuit_breaker", "disconnector", "bus_coupler"), F.coalesce("state", F.lit("unknown"))), F.lit("rating"), F.when(kind_of_text.isin("voltage", "current_rating", "power_rating"), label),
        ), lambda k, v: v.isNotNull(),
    )
    order = F.row_number().over(Window.partitionBy("graph_id").orderBy("id"))
    equipment = rows.select(F.col("analysis_run_id").alias("graph_id"), "id", label.alias("equipment_id"), kind.alias("type"), "page", "bbox", attributes.alias("attributes"), or_default(F.col("confidence"), 0.45).alias("confidence"), F.when(F.col("l").isNotNull(), F.array(F.lit("ocr"), F.lit("vision"))).otherwise(F.array(F.lit("vision"))).alias("provenance"), review_status(F.col("review_status")).alias("review_status"))
    lines = connections.where("review_status <> 'rejected'").select(F.col("analysis_run_id").alias("graph_id"), "id", F.col("from_node_id").alias("from_terminal_id"), F.col("to_node_id").alias("to_terminal_id"), "polyline", F.lit(None).cast("string").alias("switch_state"), "confidence", F.array(F.lit("wire_trace"), F.lit("terminal_snap")).alias("provenance"), review_status(F.col("review_status")).alias("review_status"))
    points = terminals.select(F.col("analysis_run_id").alias("graph_id"), "id", F.col("symbol_id").alias("equipment_id"), "name", "x", "y")
    return {k: v.withColumn("ord", order) for k, v in (("equipment", equipment), ("terminals", points), ("connections", lines))}


