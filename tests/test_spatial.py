import datetime
import io
import json
import random
import zipfile

import numpy as np
from pyspark.sql import functions as F

from netsift.functions.geometry import box
from netsift.operators import metrics, raster, review, spatial, topology
from netsift.plans import api, queries
from netsift.sources import fixtures, readers, sinks
from netsift.sources.schemas import EVIDENCE

SYMBOL = "analysis_run_id string, id string, page int, predicted_class string, confidence double, bbox struct<x1:double,y1:double,x2:double,y2:double>"


def symbols(spark, rows):
    return spark.createDataFrame([("r", i, 1, c, conf, b) for i, c, conf, b in rows], SYMBOL)


def lines(spark, rows):
    return spark.createDataFrame([("r", 1, i, [dict(zip("xy", p)) for p in pts], 0.8) for i, pts in rows], "analysis_run_id string, page int, id string, polyline array<struct<x:double,y:double>>, confidence double")


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def random_boxes(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y = rng.random() * 0.5, rng.random() * 0.5
        out.append((k, rng.choice("ab"), round(rng.random(), 2), (x, y, x + 0.1 + rng.random() * 0.3, y + 0.1 + rng.random() * 0.3)))
    return out


def test_suppression_is_greedy_and_idempotent(spark):
    rows = random_boxes(3, 60)
    df = spark.createDataFrame([(i, c, conf, b) for i, c, conf, b in rows], "id int, cls string, confidence double, bbox struct<x1:double,y1:double,x2:double,y2:double>")
    for keys, same in ((["cls"], lambda a, b: a[1] == b[1]), ([F.lit(1).alias("page")], None)):
        data = df if same else df.withColumn("page", F.lit(1))
        names = ["cls"] if same else ["page"]
        kept = []
        for r in sorted(rows, key=lambda r: (-r[2], r[0])):
            if not any((same is None or same(r, k)) and iou(r[3], k[3]) >= 0.35 for k in kept):
                kept.append(r)
        once = spatial.suppress(data, names, threshold=0.35)
        assert sorted(r["id"] for r in once.collect()) == sorted(k[0] for k in kept)
        assert spatial.suppress(once, names, threshold=0.35).count() == len(kept)


def test_matching_consumes_truth(spark):
    d, t = random_boxes(5, 25), random_boxes(6, 25)
    box_t = "struct<x1:double,y1:double,x2:double,y2:double>"
    dd = spark.createDataFrame([(c, i, s, b) for i, c, s, b in d], f"cls string, detection_id int, confidence double, bbox {box_t}")
    tt = spark.createDataFrame([(c, i, b) for i, c, _, b in t], f"cls string, truth_id int, bbox {box_t}")
    free, want = {i: (c, b) for i, c, _, b in t}, []
    for i, c, _, b in sorted(d, key=lambda r: (-r[2], r[0])):
        best = max(((iou(b, v[1]), -j) for j, v in free.items() if v[0] == c), default=(0, 0))
        if best[0] >= 0.3:
            want.append((c, i, -best[1]))
            del free[-best[1]]
    got = sorted(map(tuple, spatial.match_detections(dd, tt, ["cls"], 0.3).collect()))
    assert got == sorted(want) and want
    assert len(spatial.map_to_truth(dd.select("cls", F.col("detection_id").alias("symbol_id"), "bbox"), tt, ["cls"]).collect()) >= len(got)


def test_labels_match_once(spark):
    e = spark.createDataFrame([("d", k, x) for k, x in enumerate(["CB-01", "CB-01", "FDR-2", "BUS-9"])], "g string, expected_id int, label string")
    o = spark.createDataFrame([("d", k, x) for k, x in enumerate(["CB-01", "FDR-3", "X"])], "g string, observed_id int, label string")
    m = spatial.match_labels(e, o, ["g"])
    assert [(r["observed_id"], r["errors"]) for r in m.orderBy("expected_id").collect()] == [(0, 0), (None, 4), (None, 1), (None, 5)] or [r["errors"] for r in m.orderBy("expected_id").collect()][0] == 0
    s = metrics.label_metrics(m, e, o, ["g"]).head()
    assert (s["tp"], s["exact_match"], s["recall"]) == (1, 0.25, 0.25)
    assert spatial.match_labels(e, o.limit(0), ["g"]).agg(F.sum("errors")).head()[0] == 20


def test_association(spark):
    t = spark.createDataFrame([("r", "t1", 1, "FDR-1", "FDR-1", "feeder_id", None, (0.85, 0.2, 0.95, 0.25))], "analysis_run_id string, id string, page int, raw_text string, normalized_text string, text_type string, engineer_value string, bbox struct<x1:double,y1:double,x2:double,y2:double>")
    s = symbols(spark, [("bus_a", "busbar", 0.9, (0.4, 0.2, 0.6, 0.25)), ("feeder_01", "feeder_terminal", 0.9, (0.84, 0.26, 0.96, 0.36))]).withColumn("review_status", F.lit("unreviewed"))
    assert spatial.associate_texts(t, s).head()["symbol_id"] == "feeder_01"
    assert spatial.associate_texts(t, s.where("id = 'bus_a'")).head()["symbol_id"] is None
    near = spatial.associate_entities(t.select("analysis_run_id", F.col("id").alias("text_id"), "text_type", "bbox"), s.select("analysis_run_id", F.col("id").alias("entity_id"), F.when(F.col("id") == "feeder_01", "feeder").otherwise("busbar").alias("entity_type"), "bbox"), ["analysis_run_id"])
    assert near.head()["entity_id"] == "feeder_01"


def test_wire_between_two_symbols(spark):
    s = symbols(spark, [("src", "energy_source", 0.9, (0.05, 0.45, 0.15, 0.55)), ("tr", "power_transformer", 0.9, (0.25, 0.4, 0.35, 0.6))])
    t = spatial.terminals_of(s)
    assert sorted(r["id"] for r in t.collect()) == ["terminal:src:attach", "terminal:tr:in", "terminal:tr:out"]
    _, ranked, issues = topology.reconstruct(lines(spark, [("c1", [(0.15, 0.5), (0.25, 0.5)])]), t, s)
    kept = ranked.where("rank = 1").collect()
    assert [(k["from_node_id"], k["to_node_id"]) for k in kept] == [("terminal:src:attach", "terminal:tr:in")]
    assert sorted(r["kind"] for r in issues.collect()) == ["DUPLICATE_EDGE", "ORPHAN_TERMINAL"]


def test_gap_bridge(spark):
    s = symbols(spark, [("a", "energy_source", 0.9, (0.05, 0.45, 0.15, 0.55)), ("b", "feeder_terminal", 0.9, (0.85, 0.45, 0.95, 0.55))])
    c = lines(spark, [("c1", [(0.15, 0.5), (0.47, 0.5)]), ("c2", [(0.50, 0.5), (0.85, 0.5)])])
    _, ranked, issues = topology.reconstruct(c, spatial.terminals_of(s), s)
    one = ranked.collect()
    assert len(one) == 1 and one[0]["gap_bridge"] and one[0]["review_status"] == "pending"
    assert "GAP_BRIDGE_REVIEW" in {r["kind"] for r in issues.collect()}


def test_crossings_and_buses(spark):
    none = spark.createDataFrame([], "analysis_run_id string, page int, x double, y double")
    x = topology.crossings(lines(spark, [("h", [(0.1, 0.5), (0.9, 0.5)]), ("v", [(0.5, 0.1), (0.5, 0.9)])]), none).collect()
    assert [r["kind"] for r in x] == ["ambiguous_crossing"]
    t = topology.crossings(lines(spark, [("h", [(0.1, 0.5), (0.9, 0.5)]), ("v", [(0.5, 0.2), (0.5, 0.5)])]), none).head()
    assert (t["kind"], t["reason"]) == ("connected_junction", "t_endpoint_intersection")
    s = symbols(spark, [("bus", "busbar", 0.9, (0.25, 0.45, 0.72, 0.5))])
    got = {r["id"]: r["symbol_id"] for r in topology.buses(lines(spark, [("on", [(0.1, 0.475), (0.9, 0.475)]), ("far", [(0.1, 0.8), (0.9, 0.8)])]), s).collect()}
    assert got == {"bus:bus": "bus", "bus:geometry:far": None}


def test_corridor(spark):
    s = symbols(spark, [("a", "energy_source", 0.9, (0.02, 0.4, 0.12, 0.6)), ("b", "feeder_terminal", 0.9, (0.2, 0.4, 0.3, 0.6))])
    page = np.zeros((200, 400), np.uint8)
    page[100, 50:79] = 255
    pages = spark.createDataFrame([("r", 1, 400, 200, bytearray(page.tobytes()))], "analysis_run_id string, page int, width int, height int, pixels binary")
    found = topology.corridor_candidates(raster.corridor_support(topology.corridor_pairs(spatial.terminals_of(s)), pages)).collect()
    assert [r["provenance"] for r in found] == ["terminal_corridor_scan"]


def test_row_boxes_runs_segments(spark):
    b = spark.createDataFrame([("p", (0.0, 0.0, 10.0, 10.0), False), ("p", (20.0, 2.0, 30.0, 12.0), False), ("p", (100.0, 2.0, 130.0, 12.0), False), ("p", (5.0, 0.0, 9.0, 3.0), True)], "page string, bbox struct<x1:double,y1:double,x2:double,y2:double>, is_bus boolean")
    got = sorted((r["bbox"]["x1"], r["bbox"]["x2"]) for r in spatial.merge_row_boxes(b, ["page"]).collect())
    assert got == [(0, 30), (5, 9), (100, 130)]
    r = spatial.longest_run(spark.createDataFrame([("k", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 0])], "k string, i int, f int").withColumn("f", F.col("f") == 1), ["k"], "i", "f").head()
    assert (r["n"], r["supported"], r["longest"]) == (7, 5, 3)
    seg = spark.createDataFrame([("k", 1, 0.0, 0.0, 100.0, 0.0), ("k", 2, 101.0, 1.0, 1.0, 1.0), ("k", 3, 0.0, 50.0, 100.0, 50.0)], "k string, ord int, x1 double, y1 double, x2 double, y2 double")
    assert [r["ord"] for r in spatial.distinct_segments(seg, ["k"]).orderBy("ord").collect()] == [1, 3]
    c = spark.createDataFrame([("k", "l", (0.0, 100.0, 200.0, 110.0)), ("k", "r", (300.0, 102.0, 500.0, 112.0))], "k string, id string, bbox struct<x1:double,y1:double,x2:double,y2:double>")
    assert spatial.coupler_boxes(c, ["k"]).count() == 1


def test_raster_kernels():
    a = np.zeros((40, 60), np.uint8)
    a[18:23, 5:55] = 255
    a[5:35, 28:33] = 255
    thin = raster.thin(a) > 0
    assert thin.sum() < (a > 0).sum() / 3 and thin[:, 10].sum() == 1
    assert len(raster.junctions(raster.thin(a))) == 1
    assert raster.open_lines(a, 40, True)[20, 5:55].all() and not raster.open_lines(a, 40, False).any()
    assert [n for n, _, _ in raster.blobs(a > 0)] == [(a > 0).sum()]
    assert raster.support(a, 0.1, 20 / 40, 0.9, 20 / 40)[0] > 0.9
    assert len(raster.straight_segments(a, 25)) == 2
    assert abs(raster.skew_angle([(0, 0, 100, 2), (0, 10, 100, 12), (0, 0, 0, 50)]) - 1.1458) < 1e-3
    g = np.full((50, 50), 200, np.uint8)
    g[25, 10:40] = 20
    assert raster.gaussian_threshold(g)[25, 25] == 255 and raster.gaussian_threshold(g)[5, 5] == 0
    m = raster.protected((200, 200), [(0.2, 0.2, 0.6, 0.6)], corridors=[(0.6, 0.4, 1.0, 0.0)])
    assert m[80, 80] == 255 and m[10, 10] == 0


def test_page_kernels(spark):
    a = np.zeros((60, 80), np.uint8)
    a[30, 5:75] = 255
    pages = spark.createDataFrame([("r", 1, 80, 60, bytearray(a.tobytes()))], "analysis_run_id string, page int, width int, height int, pixels binary")
    assert raster.page_conductors(pages).count() == 1
    assert np.frombuffer(raster.skeletons(pages).head()["skeleton"], np.uint8).sum() == 70 * 255
    assert raster.page_junctions(pages).count() == 0


def empty_tables(spark):
    tables = {k: spark.createDataFrame([], v) for k, v in EVIDENCE.items()}
    return tables


def run_tables(spark):
    """One analysed run: source - breaker - feeder, and its labels."""
    t = empty_tables(spark)
    put = lambda name, rows: spark.createDataFrame(rows, t[name].schema)
    b = lambda x: (x, 0.4, x + 0.1, 0.6)
    t["symbol_evidence"] = put("symbol_evidence", [("r1", f"s{k}", 1, c, c, 0.9, b(0.1 + 0.3 * k), "unreviewed", None) for k, c in enumerate(("energy_source", "circuit_breaker", "feeder_terminal"))])
    t["text_evidence"] = put("text_evidence", [("r1", "t2", 1, "FDR-11KV-03", "FDR-11KV-03", "feeder_id", 0.91, 0.98, 0.99, b(0.7), None, None, "unreviewed")])
    t["associations"] = put("associations", [("r1", "a2", "t2", "s2", 0.9, {}, "proposed")])
    t["terminals"] = put("terminals", [("r1", f"terminal:s{k}:{n}", f"s{k}", "x", 1, n, 0.1, 0.5, 0, 0.7) for k in range(3) for n in ("in", "out")])
    t["physical_connections"] = put("physical_connections", [("r1", f"c{k}", "d", None, 1, f"terminal:s{k}:out", f"terminal:s{k + 1}:in", [], 0.8, "trace", "unreviewed") for k in range(2)])
    t["junctions"] = put("junctions", [("r1", "j1", 1, 0.5, 0.5, "ambiguous_crossing", 4, 0.5, "x", "unreviewed")])
    t["analysis_runs"] = put("analysis_runs", [("r1", "d", "completed", "v1", None, datetime.datetime(2024, 1, 1), None)])
    return t


def action(spark, t, k, table, target, name, payload=None):
    return spark.createDataFrame([("r1", f"{k:03}", table, target, name, payload or {}, "engineer", datetime.datetime(2024, 2, 1, 0, k))], t["review_actions"].schema)


def test_service_questions(spark):
    t = run_tables(spark)
    f = api.feeders(t, "r1").head()
    assert (f["feeder_id"], f["resolution"], f["path"]["source_equipment_id"], f["confidence"]) == ("FDR-11KV-03", "resolved", "s0", 0.8)
    assert "AMBIGUOUS_CROSSING" in {r["code"] for r in api.validation(t, "r1").collect()}
    opened = api.simulate(t, "r1", {"s1": "open"})
    assert opened["feeders"].head()["resolution"] == "unresolved" and opened["health"].head()["unresolved_feeders"] == 1
    trace = api.feeder_trace(t, "r1", "s2").head()
    assert trace["source_role"] == "energy_source" and len(trace["affecting_reviews"]) == 2
    assert api.find_texts(t, "r1", query="fdr").count() == 1 and api.find_texts(t, "r1", page=2).count() == 0
    assert api.feeders(t, "nobody").count() == 0
    assert api.symbol_summary(t, "r1").where("predicted_class is null").head()["associated"] == 1
    assert api.physical_graph(t, "r1")["nodes"].count() == 6
    for bad in ("half",):
        try:
            api.simulate(t, "r1", {"s1": bad})
            raise AssertionError("accepted")
        except ValueError:
            pass


def test_reviews_change_what_follows(spark):
    t = run_tables(spark)
    rejected = api.act(t, action(spark, t, 1, "connection", "c1", "reject"))
    assert api.feeders(rejected, "r1").head()["resolution"] == "unresolved"
    back = api.act(rejected, action(spark, t, 2, "connection", "c1", "verify"))
    assert api.feeders(back, "r1").head()["resolution"] == "resolved"
    assert {r["connection_id"] for r in api.review_issues(back, "r1").collect()} == {"c0"}
    opened = api.act(t, action(spark, t, 3, "switch", "s1", "set_state", {"state": "open"}))
    assert api.feeders(opened, "r1").head()["resolution"] == "unresolved"
    named = api.act(t, action(spark, t, 4, "text", "t2", "edit", {"value": "FDR-9"}))
    assert api.feeders(named, "r1").head()["feeder_id"] == "FDR-9"
    decided = api.act(t, action(spark, t, 5, "junction", "j1", "crossing_connected"))
    assert "AMBIGUOUS_CROSSING" not in {r["code"] for r in api.validation(decided, "r1").collect()}
    manual = api.act(t, action(spark, t, 6, "connection", "m1", "add", {"from_node_id": "terminal:s0:out", "to_node_id": "terminal:s2:in"}))
    assert api.feeders(manual, "r1").head()["path"]["equipment_path"] == ["s0", "s2"]
    strange = api.act(t, action(spark, t, 7, "connection", "c1", "explode"))
    assert strange["review_actions"].count() == 0
    issue = api.act(t, action(spark, t, 8, "issue", "i", "reject", {"connection_id": "c0"}))
    assert api.feeders(issue, "r1").head()["resolution"] == "unresolved"
    added = review.review_symbols(t["symbol_evidence"], action(spark, t, 9, "symbol", "s9", "add", {"predicted_class": "load", "bbox": '{"x1":0.1,"y1":0.1,"x2":0.2,"y2":0.2}'}))
    assert added.where("id = 's9'").head()["bbox"]["x2"] == 0.2


def test_exports(spark, tmp_path):
    t = fixtures.graphs(spark, ("fixture_radial_01",))
    doc = sinks.graph_json(**t).head()["document"]
    (tmp_path / "g.json").write_text(doc)
    back = readers.graph_documents(spark, str(tmp_path / "g.json"))
    for name in t:
        assert back[name].select("id").orderBy("ord").collect() == t[name].select("id").orderBy("ord").collect()
    assert json.loads(doc)["equipment"][1]["attributes"]["rating"] == "33/11 kV · 25 MVA"
    picture = sinks.svg(**t).head()["svg"]
    assert picture.count("<line") == 5 and picture.count("<text") == 6 and picture.endswith("</svg>")
    data, manifest = api.export_bundle(run_tables(spark), "r1")
    names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    assert "manifest.json" in names and "equipment.csv" in names and len(manifest["files"]) == 9


def test_documents_in_parts(spark):
    """A graph of any size is written in texts of bounded size, and comes back whole and in order."""
    t = {k: v.withColumn("ord", F.col("ord") % 3) if k == "equipment" else v for k, v in fixtures.graphs(spark, ("fixture_radial_01", "fixture_bus_coupler_01")).items()}
    whole = readers.explode_graphs(sinks.graph_json(**t).select(F.from_json("document", readers.GRAPH_DOCUMENT).alias("d")).select("d.*"))
    parts = sinks.graph_parts(**t, most=2).select(F.from_json("document", readers.GRAPH_DOCUMENT).alias("d"))
    back = readers.explode_graphs(parts.select("d.*"))
    assert {r["n"] for r in parts.select(F.explode(F.array(*[F.size(f"d.{k}") for k in t])).alias("n")).collect()} <= {-1, 1, 2, None}
    for name in t:
        of = lambda g: sorted(map(str, g[name].collect()))  # noqa: B023, E731
        assert of(back) == of(whole) and len(of(back)) == t[name].count()


def test_export_by_parts(spark, sf_dir, monkeypatch):
    """export_json writes no text of a whole graph."""
    monkeypatch.setattr(sinks, "graph_json", None)
    assert queries.export_json(spark, sf_dir).count() > 0


def test_tables_round_trip(spark, tmp_path):
    rows = run_tables(spark)["physical_connections"]
    sinks.append(rows, str(tmp_path), "physical_connections")
    sinks.append(rows.withColumn("analysis_run_id", F.lit("r2")), str(tmp_path), "physical_connections")
    sinks.replace_runs(rows.limit(1), str(tmp_path), "physical_connections")
    got = readers.table(spark, str(tmp_path), "physical_connections").groupBy("analysis_run_id").count().collect()
    assert {r["analysis_run_id"]: r["count"] for r in got} == {"r1": 1, "r2": 2}
    a = spark.createDataFrame([("k", 1), ("l", 1)], "id string, v int")
    assert sorted(map(tuple, sinks.upsert(a, spark.createDataFrame([("k", 2)], "id string, v int"), "id").collect())) == [("k", 2), ("l", 1)]


def test_uploads(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02\0\0\0"
    for name, data in {"a.png": png, "b.txt": b"x", "c.pdf": b"%PDF-1.4 /Type /Page /MediaBox [0 0 200 100] stream\n0 0 m 5 5 l S\nendstream", "d.png": b"nope"}.items():
        (tmp_path / name).write_bytes(data)
    files = readers.uploads(spark, str(tmp_path))
    refused = {r["path"].rsplit("/", 1)[1]: r["refused"] for r in files.collect()}
    assert refused == {"a.png": None, "b.txt": "unsupported type", "c.pdf": None, "d.png": "unreadable"}
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.inspect(files.where("refused is null")).collect()}
    assert (got["a.png"]["width"], got["a.png"]["height"], got["a.png"]["recommended_pipeline"]) == (640, 480, "raster")
    assert (got["c.pdf"]["input_type"], got["c.pdf"]["page_count"], got["c.pdf"]["width"]) == ("vector_pdf", 1, 200)


def test_worker_lines(spark, tmp_path):
    (tmp_path / "out.jsonl").write_text('{"request_id":"1","status":"ok","regions":[{"text":"CB-01","confidence":0.9,"bbox_normalized":[0,0,1,1]}]}\n{broken\n')
    rows = readers.worker_lines(spark, str(tmp_path / "out.jsonl"), readers.OCR_LINE).collect()
    assert [r["status"] for r in rows] == ["ok", None] and rows[1]["broken"] == "{broken"


def test_datasets(spark):
    scenes = fixtures.symbol_scenes(spark)
    assert scenes.count() == 750 and scenes.where(~(F.col("bbox.x2") <= 1)).count() == 0
    one = scenes.where("seed = 100").select(F.lit("i").alias("image"), "id", "class_name", "bbox", F.lit(1600).alias("width"), F.lit(900).alias("height"))
    order = sorted(r["class_name"] for r in one.select("class_name").collect())
    assert sinks.coco(one, order).count() == 10 and len(sinks.yolo(one, order).head()["lines"].split("\n")) == 10
    assert sinks.tile_manifest(one).count() >= 10


def test_review_stream(spark, tmp_path):
    from netsift.streaming.review_stream import actions_per_window, actions_stream, latest_stream, recompute_on_review

    t = empty_tables(spark)
    log = action(spark, t, 1, "connection", "c1", "reject").unionByName(action(spark, t, 2, "connection", "c1", "verify")).unionByName(action(spark, t, 3, "connection", "c2", "accept"))
    log.write.parquet(str(tmp_path / "log"))
    q = latest_stream(actions_stream(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("latest_reviews").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["target_id"], r["action"]) for r in spark.table("latest_reviews").collect()} == {(r["target_id"], r["action"]) for r in review.latest(log).collect()}
    w = actions_per_window(actions_stream(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("per_window").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.table("per_window").agg(F.sum("n")).head()[0] == 3
    seen = []
    r = recompute_on_review(actions_stream(spark, str(tmp_path / "log")), lambda runs: seen.extend(x["analysis_run_id"] for x in runs.collect()), str(tmp_path / "ck"))
    r.awaitTermination(120)
    assert seen == ["r1"]
