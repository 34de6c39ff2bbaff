"""The registered queries over derived tables; oracles.py has the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.functions import geometry as geo
from netsift.functions import text as txt
from netsift.operators import graph, metrics, raster, review, spatial, topology
from netsift.plans import derived
from netsift.plans.lineage import cut
from netsift.sources import fixtures, readers, sinks

BASE = graph.BASE


def _held(tables: derived.Graph) -> derived.Graph:
    return {k: cut(v) for k, v in tables.items()}


def _base(tables: derived.Graph, **how):
    """(edges, labelled components, sources) of the base variant."""
    edges = cut(graph.operational_edges(**tables, **how))
    nodes = tables["equipment"].select("graph_id", F.lit(BASE).alias("variant_id"), F.col("id").alias("node"))
    labelled = cut(graph.components(edges, nodes))
    return edges, labelled, cut(graph.source_candidates(tables["equipment"], labelled))


def _paths(tables: derived.Graph, **how) -> DataFrame:
    edges, _, sources = _base(tables)
    if how:
        edges = cut(graph.operational_edges(**tables, **how))
    return graph.feeder_paths(tables["equipment"], edges, sources)


def _path_rows(paths: DataFrame) -> DataFrame:
    line = lambda c: F.array_join(c, "|")
    return paths.select("graph_id", F.col("feeder_equipment_id").alias("feeder"), F.col("source_equipment_id").alias("source"), line("equipment_path").alias("path"), line("connection_path").alias("connections"), F.col("source_bus_equipment_id").alias("bus"), F.col("weakest_connection_id").alias("weakest"), line("uncertainty_flags").alias("flags"), "confidence", "active")


def feeder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source supplies each feeder, by which path and how sure."""
    return _path_rows(_paths(_held(derived.net(spark, sf_dir))))


def feeder_paths_definite(spark, sf_dir):
    return _path_rows(_paths(_held(derived.net(spark, sf_dir)), policy="definite"))


def feeder_paths_physical(spark, sf_dir):
    """The baseline that ignores switches."""
    return _path_rows(_paths(_held(derived.net(spark, sf_dir)), ignore_switches=True)).drop("flags")


def ambiguous_feeders(spark, sf_dir):
    p = _paths(_held(derived.net2(spark, sf_dir)))
    return p.select(F.col("feeder_equipment_id").alias("feeder"), F.col("source_equipment_id").alias("source"), F.array_join("equipment_path", "|").alias("path"), F.array_contains("uncertainty_flags", "MULTIPLE_SOURCE_OR_PATH_CANDIDATES").alias("multiple"), F.array_contains("uncertainty_flags", "UNKNOWN_SWITCH_ON_PATH").alias("unknown"))


def _what_if(spark, sf_dir):
    """Every feeder's source in net2 as it is, and with the switches of poor suppliers opened and closed."""
    t = derived.net2(spark, sf_dir, repeats=True)
    poor = derived.read(spark, sf_dir, "supplier").where("s_acctbal < 2000")
    over = F.explode(F.array(F.lit("open"), F.lit("closed")))
    overrides = poor.select(F.lit("net2").alias("graph_id"), over.alias("variant_id"), derived.name("S", "s_suppkey").alias("equipment_id")).withColumn("state", F.col("variant_id"))
    variants = spark.range(1).select(F.lit("net2").alias("graph_id"), F.explode(F.array(*map(F.lit, (BASE, "open", "closed")))).alias("variant_id"))
    return graph.nearest_supply(**t, sources=cut(graph.found_sources(**t)), variants=variants, overrides=overrides, paths=False)


def what_if_switches(spark, sf_dir):
    """Every feeder's source as it is, with switches opened, and with them closed: three variants in one traversal."""
    p = _what_if(spark, sf_dir)
    return p.select("variant_id", F.col("feeder_equipment_id").alias("feeder"), F.col("source_equipment_id").alias("source"), "active")


def scenario_diff(spark, sf_dir):
    """Feeders reached as it is, with switches opened and closed; opening never adds, closing never takes."""
    p = cut(_what_if(spark, sf_dir).select("graph_id", "variant_id", "source_equipment_id"))
    of = lambda v: p.where(F.col("variant_id") == v)
    return metrics.monotone(of(BASE), of("open"), of("closed"))


def source_candidates(spark, sf_dir):
    return _base(_held(derived.supply(spark, sf_dir)))[2]


def resolution_counts(spark, sf_dir):
    t = _held(derived.net2(spark, sf_dir))
    records = graph.feeder_records(t["equipment"], _paths(t))
    return records.groupBy("resolution", "voltage").agg(F.count(F.lit(1)).alias("n"))


def components(spark, sf_dir):
    _, labelled, _ = _base(_held(derived.net2(spark, sf_dir)))
    return labelled.select("node", "component")


def component_count(spark, sf_dir):
    _, labelled, _ = _base(_held(derived.net(spark, sf_dir)))
    return graph.component_counts(labelled).select("graph_id", "components")


def bridges(spark, sf_dir):
    edges, labelled, _ = _base(_held(derived.net(spark, sf_dir)))
    return graph.bridges(edges, labelled).select("graph_id", "u", "v")


def bridges_cyclic(spark, sf_dir):
    edges, labelled, _ = _base(_held(derived.net2(spark, sf_dir)))
    return graph.bridges(edges, labelled).select("graph_id", "u", "v")


def risk_ranking(spark, sf_dir):
    t = _held(derived.net(spark, sf_dir))
    edges, labelled, sources = _base(t)
    paths = cut(graph.feeder_paths(t["equipment"], edges, sources))
    r = graph.criticality(**t, edges=edges, labelled=labelled, sources=sources, paths=paths)
    return r.select("graph_id", "connection_id", F.size("affected_feeders").alias("feeders"), F.size("affected_nodes").alias("nodes"), "component_change", "bridge_importance", "risk_score", "priority")


def health(spark, sf_dir):
    t = _held(derived.net(spark, sf_dir))
    return graph.Analysis(**t).health.select("graph_id", "sources", "feeders", "resolved_paths", "unresolved_feeders", "validation_errors", "review_items", "critical_issues", "status")


def _findings(code: str, graph_of, with_paths: bool):
    def run(spark, sf_dir):
        t = _held(graph_of(spark, sf_dir))
        edges = cut(graph.operational_edges(**t))
        if with_paths:
            paths = cut(_paths(t))
        else:
            paths = spark.createDataFrame([], "graph_id string, feeder_equipment_id string, source_equipment_id string, equipment_path array<string>, uncertainty_flags array<string>")
        found = graph.validate(**t, edges=edges, paths=paths).where(F.col("code") == code)
        return found.select("graph_id", "code", "severity", "target_type", "target_id")

    run.__doc__ = f"Findings of the rule {code}."
    return run


STRUCTURAL = ("DUPLICATE_EQUIPMENT_ID", "UNRESOLVED_TERMINAL", "NO_SELF_LOOP", "DUPLICATE_PARALLEL_EDGE", "DISCONNECTED_EQUIPMENT", "BREAKER_TERMINAL_SANITY", "DISCONNECTOR_TERMINAL_SANITY", "BUS_COUPLER_SANITY", "TRANSFORMER_TERMINAL_SANITY")
ON_PATHS = {"FEEDER_WITHOUT_UPSTREAM_PATH": derived.net, "UNKNOWN_SWITCH_ON_REQUIRED_PATH": derived.net, "VOLTAGE_TRANSITION_WITHOUT_TRANSFORMER": derived.net, "FEEDER_MULTIPLE_UNRESOLVED_SOURCES": derived.net2}


def degree(spark, sf_dir):
    t = _held(derived.orders_graph(spark, sf_dir))
    nodes = t["equipment"].select("graph_id", F.lit(BASE).alias("variant_id"), F.col("id").alias("node"))
    return graph.degrees(graph.operational_edges(**t, ignore_switches=True), nodes).select("node", "degree")


def strongest_edge(spark, sf_dir):
    """The best candidate of each unordered pair, and the rank of all its rivals."""
    li = derived.read(spark, sf_dir, "lineitem")
    c = li.select(F.lit("run").alias("analysis_run_id"), (F.col("l_linenumber")).alias("page"), F.format_string("%d-%d", "l_orderkey", "l_linenumber").alias("id"), derived.name("x", "l_suppkey").alias("from_node_id"), F.concat(F.lit("x"), (F.col("l_partkey") % 100).cast("string")).alias("to_node_id"), F.col("l_discount").alias("overall_confidence"))
    return topology.select_connections(c).select("page", "id", "rank")


def text_normalize(spark, sf_dir):
    return derived.labels(spark, sf_dir).select("id", txt.normalize(F.col("raw_text")).alias("r")).select("id", "r.normalized_text", "r.confidence", "r.requires_review", "r.evidence")


def text_classify(spark, sf_dir):
    return derived.labels(spark, sf_dir).select("id", txt.classify(F.col("raw_text")).alias("r")).select("id", "r.text_type", "r.confidence", "r.evidence")


def text_summary(spark, sf_dir):
    rows = derived.labels(spark, sf_dir).select(F.lit("run").alias("analysis_run_id"), txt.classify(F.col("raw_text"))["text_type"].alias("text_type"), txt.normalize(F.col("raw_text"))["requires_review"].alias("requires_review"), F.lit("unreviewed").alias("review_status"))
    return metrics.text_summary(rows).select("text_type", "n", "needs_review")


def voltage_extract(spark, sf_dir):
    rows = derived.labels(spark, sf_dir).withColumn("rating", F.concat("raw_text", F.lit(" · 11 kV · 630 A 5 MVA")))
    parts = txt.rating_components(F.col("rating"))
    return rows.select("id", txt.first_kilovolts(F.col("rating")).alias("kv"), txt.voltage_part(F.col("rating")).alias("part"), F.array_join(F.transform(parts, lambda x: F.concat(x["semantic_type"], F.lit("="), x["value"])), ";").alias("parts"))


def label_dup_groups(spark, sf_dir):
    e = derived.orders_graph(spark, sf_dir)["equipment"]
    return e.groupBy(F.upper("equipment_id").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "ord").alias("first_id")).where("n > 1")


def character_errors(spark, sf_dir):
    """Edit distance of read labels from canonical ones, by kind."""
    rows = derived.labels(spark, sf_dir).select(txt.classify(F.col("raw_text"))["text_type"].alias("text_type"), F.upper("raw_text").alias("a"), txt.canonical(F.col("raw_text")).alias("b"))
    return rows.groupBy("text_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.levenshtein("a", "b")).alias("errors"), F.sum(F.length("b")).alias("chars"), F.round(F.sum(F.levenshtein("a", "b")) / F.sum(F.length("b")), 4).alias("rate"))


def iou_pairs(spark, sf_dir):
    p = spatial.overlapping_pairs(derived.boxes(spark, sf_dir), ["grp"], 0.45)
    return p.select("grp", "a", "b", F.round("iou", 6).alias("iou"))


def nms_kept(spark, sf_dir):
    """Class-aware suppression."""
    return spatial.suppress(derived.boxes(spark, sf_dir), ["grp"], threshold=0.45).select("grp", "id")


def nms_agnostic(spark, sf_dir):
    """Suppression within a page, whatever the class."""
    b = derived.boxes(spark, sf_dir).withColumn("page", F.col("grp") % 5)
    return spatial.suppress(b, ["page"], threshold=0.35).select("page", "id")


def merge_regions(spark, sf_dir):
    """Regions of one text, in arrival order."""
    return spatial.suppress(derived.boxes(spark, sf_dir), ["grp"], threshold=0.3, order=F.col("id")).select("grp", "id")


def nearest_point_topk(spark, sf_dir):
    b = derived.boxes(spark, sf_dir)
    c = geo.centre(F.col("bbox"))
    left = b.where("id % 2 = 0").select("grp", F.col("id").alias("left_id"), c["x"].alias("lx"), c["y"].alias("ly"))
    right = b.where("id % 2 = 1").select("grp", F.col("id").alias("right_id"), c["x"].alias("rx"), c["y"].alias("ry"))
    return spatial.nearest_points(left, right, ["grp"], "left_id", "right_id", 3, 0.07).select("left_id", "right_id", "rank", F.round("gap", 9).alias("gap"))


def association_top1(spark, sf_dir):
    b = derived.boxes(spark, sf_dir)
    kinds = F.array(*[F.lit(k) for k in ("feeder_id", "bus_id", "voltage", "current_rating", "equipment_id")])
    texts = b.where("id % 2 = 0").select("grp", F.col("id").alias("text_id"), F.get(kinds, (F.col("id") / 2 % 5).cast("int")).alias("text_type"), "bbox")
    types = F.array(*[F.lit(k) for k in ("feeder", "busbar", "power_transformer", "circuit_breaker")])
    entities = b.where("id % 2 = 1").select("grp", F.col("id").alias("entity_id"), F.get(types, ((F.col("id") - 1) / 2 % 4).cast("int")).alias("entity_type"), "bbox")
    return spatial.associate_entities(texts, entities, ["grp"]).select("text_id", "entity_id", "score")


def segment_intersections(spark, sf_dir):
    s = derived.segments(spark, sf_dir)
    met = topology.meetings(s, ["grp"])
    return met.select("grp", F.col("a").alias("l_id"), F.col("b").alias("r_id"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "tee")


def segment_geometry(spark, sf_dir):
    """Projection, direction, snap radius and candidate score of each segment and box."""
    s = derived.segments(spark, sf_dir).join(derived.boxes(spark, sf_dir), ["grp", "id"])
    p = geo.project_on_segment(geo.centre(F.col("bbox")), F.col("a"), F.col("b"))
    angle = geo.angle_degrees(F.col("a"), F.col("b"))
    radius = geo.snap_radius(F.col("bbox"), F.col("confidence"))
    score = geo.candidate_scores(p["distance"], radius, F.col("confidence"))["overall"]
    return s.select("id", F.round(p["distance"], 9).alias("gap"), F.round(angle, 6).alias("angle"), geo.is_slanted(angle).alias("slanted"), F.round(radius, 9).alias("radius"), F.round(score, 6).alias("score"), geo.valid_box(F.col("bbox")).alias("valid"))


def dataset_lines(spark, sf_dir):
    """COCO and YOLO forms of every box."""
    b = derived.boxes(spark, sf_dir)
    c = geo.coco_box(F.col("bbox"), F.lit(640.0), F.lit(480.0))
    return b.select("id", geo.yolo_line(F.col("grp"), F.col("bbox")).alias("yolo"), *[F.round(F.get(c, k), 6).alias(n) for k, n in enumerate(("x", "y", "w", "h"))])


def tile_cover(spark, sf_dir):
    p = derived.read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 50 + 100).alias("w"), (F.col("p_size") * 37 + 100).alias("h"))
    return p.select("p_partkey", F.posexplode(geo.tile_origins(F.col("w"), F.col("h"))).alias("pos", "o")).select("p_partkey", "pos", "o.x", "o.y")


def terminal_template(spark, sf_dir):
    b = derived.boxes(spark, sf_dir)
    kinds = F.array(*[F.lit(k) for k in ("energy_source", "feeder_terminal", "power_transformer", "circuit_breaker")])
    s = b.select(F.lit("run").alias("analysis_run_id"), F.lit(1).alias("page"), F.col("id").cast("string").alias("id"), F.get(kinds, (F.col("id") % 4).cast("int")).alias("predicted_class"), "bbox")
    return spatial.terminals_of(s).select("id", "symbol_id", "name", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "orientation_deg")


def longest_run(spark, sf_dir):
    e = derived.read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "view").alias("seen"))
    return spatial.longest_run(e, ["user_id"], "event_id", "seen")


def latest_review_state(spark, sf_dir):
    last = review.latest(derived.review_log(spark, sf_dir))
    return last.select("analysis_run_id", "target_id", "action", review.status_after(F.col("action")).alias("status"), last["payload"]["value"].alias("value"))


def audit_history(spark, sf_dir):
    return review.history(derived.review_log(spark, sf_dir)).select("id", "target_id", "prior_status", "new_status", "step")


def recompute_changed(spark, sf_dir):
    log = derived.review_log(spark, sf_dir)
    return review.changed_runs(log, F.lit("2024-01-15").cast("timestamp_ntz"))


def review_connections(spark, sf_dir):
    """Statuses of connections, one a user, after the whole log."""
    log = derived.review_log(spark, sf_dir)
    users = log.select("analysis_run_id", F.col("target_id").alias("id")).distinct()
    lines = users.select("analysis_run_id", "id", F.lit(1).alias("page"), F.lit("a").alias("from_node_id"), F.lit("b").alias("to_node_id"), F.lit(0.5).alias("confidence"), F.lit("trace").alias("provenance"), F.lit("unreviewed").alias("review_status"))
    nobody = users.select("analysis_run_id", "id").limit(0)
    return review.review_connections(lines, log, nobody).groupBy("analysis_run_id", "review_status").agg(F.count(F.lit(1)).alias("n"))


def precision_recall_f1(spark, sf_dir):
    rows = derived.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("t"), (1 - F.col("toxic")).alias("p"))
    one = lambda df, c: df.select(F.col(c).cast("string").alias("class"))
    return metrics.class_scores(one(rows.where("t = p"), "t"), one(rows, "p"), one(rows, "t"), "class")


def set_ops_pairs(spark, sf_dir):
    li = derived.read(spark, sf_dir, "lineitem")
    pairs = lambda cond: metrics.unordered(li.where(cond).select("l_returnflag", F.col("l_suppkey"), (F.col("l_partkey") % 50).alias("q")), ["l_returnflag"], "l_suppkey", "q")
    return metrics.pair_scores(pairs("l_quantity >= 25"), pairs("l_discount >= 0.05"), ["l_returnflag"])


def multiset_overlap(spark, sf_dir):
    o = derived.read(spark, sf_dir, "orders")
    side = lambda cond: o.where(cond).select("o_orderpriority", "o_orderstatus")
    return metrics.multiset_overlap(side("o_orderkey % 2 = 0"), side("o_totalprice > 100000"), ["o_orderpriority", "o_orderstatus"])


def pivot_confusion(spark, sf_dir):
    rows = derived.read(spark, sf_dir, "labels").select("quality", F.concat(F.lit("toxic_"), F.col("toxic").cast("string")).alias("p"))
    return metrics.confusion(rows, "quality", "p", ["toxic_0", "toxic_1"])


def reachability_accuracy(spark, sf_dir):
    e = derived.read(spark, sf_dir, "embeddings").select(F.lit("all").alias("g"), F.col("vec_id").alias("node"), "label")
    truth, guess = e.select("g", "node", F.col("label").alias("component")), e.select("g", "node", (F.col("node") % 7).alias("component"))
    return metrics.reachability_agreement(truth, guess, ["g"]).select("pairs", "agree", "accuracy")


def error_tags(spark, sf_dir):
    p = derived.read(spark, sf_dir, "part")
    n = lambda k: (F.col("p_partkey") % k).cast("int")
    return p.select("p_partkey", F.array_join(metrics.error_tags(n(2), n(3), n(5), n(7), F.lit(3)), "|").alias("tags"))


def export_json(spark, sf_dir):
    """Graphs written as documents, in parts of bounded size, and read back."""
    docs = sinks.graph_parts(**derived.net(spark, sf_dir)).select(F.from_json("document", readers.GRAPH_DOCUMENT).alias("d")).select("d.*")
    back = readers.explode_graphs(docs)["equipment"]
    return back.select("graph_id", "id", "equipment_id", "type", back["attributes"]["rating"].alias("rating"), F.round("bbox.x2", 3).alias("x2"))


def export_csv_rows(spark, sf_dir):
    flat = sinks.flat(derived.net(spark, sf_dir)["connections"].withColumn("provenance", F.col("provenance")))
    return flat.select("graph_id", "id", "confidence", "provenance", "switch_state")


def corpus_plan(spark, sf_dir):
    return fixtures.corpus_plan(spark)


def canonical_paths(spark, sf_dir):
    """Feeder paths of the canonical fixtures."""
    return _path_rows(_paths(fixtures.graphs(spark)))


def canonical_risks(spark, sf_dir):
    """Review ranking of the canonical fixtures, with one weak edge."""
    t = fixtures.graphs(spark, tuple(fixtures.SPECS))
    t["connections"] = t["connections"].withColumn("confidence", F.when(F.col("id") == "edge_03", 0.5).otherwise(F.col("confidence")))
    r = graph.Analysis(**t).risks
    return r.select("graph_id", "connection_id", "component_change", "bridge_importance", "risk_score", "priority", F.array_join("affected_feeders", "|").alias("affected"))


def _page_symbols(spark, sf_dir):
    """boxes as symbols of runs by label, with traces from segments."""
    b = derived.boxes(spark, sf_dir)
    kinds = F.array(*[F.lit(k) for k in ("energy_source", "feeder_terminal", "power_transformer", "circuit_breaker", "busbar")])
    run = F.concat(F.lit("run:"), F.col("grp").cast("string")).alias("analysis_run_id")
    name = F.format_string("%06d", "id").alias("id")
    symbols = b.select(run, name, F.lit(1).alias("page"), F.get(kinds, (F.col("id") % 5).cast("int")).alias("predicted_class"), "confidence", "bbox")
    lines = derived.segments(spark, sf_dir).select(run, F.lit(1).alias("page"), F.format_string("c%06d", "id").alias("id"), F.array("a", "b").alias("polyline"), F.lit(0.8).alias("confidence"))
    return symbols, spatial.terminals_of(symbols), lines


def terminal_snap(spark, sf_dir):
    """The terminal that the first point of each trace snaps to."""
    symbols, terminals, lines = _page_symbols(spark, sf_dir)
    points = lines.select("analysis_run_id", "page", F.col("id").alias("key"), F.get("polyline", 0)["x"].alias("lx"), F.get("polyline", 0)["y"].alias("ly"))
    return spatial.snap_points(points, terminals, symbols).select("key", "terminal_id", F.round("gap", 9).alias("gap"))


def physical_connections(spark, sf_dir):
    """Candidates from traces and terminals, the strongest of each terminal pair."""
    symbols, terminals, lines = _page_symbols(spark, sf_dir)
    _, ranked, _ = topology.reconstruct(lines, terminals, symbols)
    return ranked.where("rank = 1").select("analysis_run_id", "id", "from_node_id", "to_node_id", "overall_confidence", "provenance", "review_status")


def topology_issues(spark, sf_dir):
    symbols, terminals, lines = _page_symbols(spark, sf_dir)
    return topology.reconstruct(lines, terminals, symbols)[2].groupBy("analysis_run_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def crossing_kinds(spark, sf_dir):
    """Junctions between traces, one at a place."""
    _, _, lines = _page_symbols(spark, sf_dir)
    none = lines.select("analysis_run_id", "page", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    return topology.crossings(lines, none).groupBy("analysis_run_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def detection_matches(spark, sf_dir):
    """Greedy one-to-one matches of even boxes to odd ones of a label."""
    b = derived.boxes(spark, sf_dir)
    d = b.where("id % 2 = 0").select("grp", F.col("id").alias("detection_id"), "confidence", "bbox")
    return spatial.match_detections(d, b.where("id % 2 = 1").select("grp", F.col("id").alias("truth_id"), "bbox"), ["grp"], 0.3)


def svg_parts(spark, sf_dir):
    """How many lines and nodes each graph's picture has."""
    pictures = sinks.svg(**derived.net(spark, sf_dir))
    count = lambda x: F.regexp_count("svg", F.lit(x)).cast("long")
    return pictures.select("graph_id", count("<line ").alias("lines"), count("<text ").alias("labels"), count("#a54224").alias("open_lines"))


def truth_manifest(spark, sf_dir):
    t = _held(derived.net(spark, sf_dir))
    m = sinks.truth_manifest(t["equipment"], t["connections"], _paths(t))
    return m.select("graph_id", F.size("sources").alias("sources"), F.size("feeders").alias("feeders"), F.size("busbars").alias("busbars"), F.size("switch_states").alias("switch_states"), F.size("paths").alias("paths"))


def symbol_scenes(spark, sf_dir):
    s = fixtures.symbol_scenes(spark)
    return s.groupBy("split", "class_name").agg(F.count(F.lit(1)).alias("n"))


def raster_conductors(spark, sf_dir):
    """Straight strokes of pages that are drawn from the signs of embeddings, a component a block of pixels."""
    e = derived.read(spark, sf_dir, "embeddings")
    bit = F.transform("embedding", lambda v: F.when(v > 0, "FF").otherwise("00"))
    row = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.repeat(F.array_join(F.transform(F.slice(bit, y * 8 + 1, F.lit(8)), lambda h: F.repeat(h, 8)), ""), 8))
    pages = e.select(F.concat(F.lit("run:"), F.col("label").cast("string")).alias("analysis_run_id"), F.col("vec_id").cast("int").alias("page"), F.lit(64).alias("width"), F.lit(64).alias("height"), F.unhex(F.array_join(row, "")).alias("pixels"))
    return raster.page_conductors(pages).groupBy("analysis_run_id", "page").agg(F.count(F.lit(1)).alias("strokes"), F.round(F.max("confidence"), 4).alias("best"))


QUERIES = {
    f.__name__: f
    for f in (
        feeder_paths, feeder_paths_definite, feeder_paths_physical, ambiguous_feeders, what_if_switches, scenario_diff, source_candidates, resolution_counts, components, component_count, bridges, bridges_cyclic,
        risk_ranking, health, degree, strongest_edge, text_normalize, text_classify, text_summary, voltage_extract, label_dup_groups, character_errors, iou_pairs, nms_kept, nms_agnostic, merge_regions,
        nearest_point_topk, association_top1, segment_intersections, segment_geometry, dataset_lines, tile_cover, terminal_template, longest_run, latest_review_state, audit_history, recompute_changed, review_connections,
        precision_recall_f1, set_ops_pairs, multiset_overlap, pivot_confusion, reachability_accuracy, error_tags, export_json, export_csv_rows, corpus_plan, canonical_paths, canonical_risks,
        terminal_snap, physical_connections, topology_issues, crossing_kinds, detection_matches, svg_parts, truth_manifest, symbol_scenes, raster_conductors,
    )
}
QUERIES |= {f"validate_{c.lower()}": _findings(c, derived.orders_graph, False) for c in STRUCTURAL}
QUERIES |= {f"validate_{c.lower()}": _findings(c, g, True) for c, g in ON_PATHS.items()}
