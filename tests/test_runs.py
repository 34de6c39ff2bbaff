"""A drawing's way from workers' lines to stored tables, reviews, recomputation and exports."""

import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from netsift.plans import runs
from netsift.sources.schemas import EVIDENCE
from netsift.sources import readers, sinks

AT = {"s0": (0.1, "energy_source"), "s1": (0.4, "circuit_breaker"), "s2": (0.7, "feeder_terminal")}


def lines_of(spark, tmp_path):
    ocr = [{"request_id": "q1", "status": "ok", "regions": [{"text": "FDR-11KV-03", "confidence": 0.9, "bbox_normalized": [0.7, 0.62, 0.8, 0.66], "tile_index": k} for k in (0, 1)]}, {"request_id": "q2", "status": "error", "error": "no picture"}]
    found = [{"request_id": "q1", "status": "ok", "detections": [{"id": i, "predicted_class": c, "confidence": 0.9, "bbox_normalized": [x, 0.4, x + 0.1, 0.6]} for i, (x, c) in AT.items()]}]
    for name, rows in (("ocr", ocr), ("symbols", found)):
        (tmp_path / name).write_text("\n".join([*map(json.dumps, rows), '{"request_id": "q9", "sta']))
    return readers.worker_lines(spark, str(tmp_path / "ocr"), readers.OCR_LINE), readers.worker_lines(spark, str(tmp_path / "symbols"), readers.SYMBOL_LINE)


def wires(spark):
    rows = [("r1", f"w{k}", 1, [(a, 0.5), (b, 0.5)], 0.9, "trace", False) for k, (a, b) in enumerate(((0.2, 0.4), (0.5, 0.7)))]
    return spark.createDataFrame(rows, EVIDENCE["conductors"])


def test_from_lines_to_exports(spark, tmp_path):
    root = str(tmp_path / "store")
    ocr, found = lines_of(spark, tmp_path)
    requests = spark.createDataFrame([("q1", "r1", 1)], "request_id string, analysis_run_id string, page int")
    none = spark.createDataFrame([], EVIDENCE["junctions"])
    runs.analyse_evidence(spark, root, requests, ocr, found, wires(spark), none)
    t = runs.evidence_tables(spark, root)
    assert t["text_evidence"].count() == 1 and t["symbol_evidence"].count() == 3 and t["associations"].count() == 1
    assert t["physical_connections"].count() == 2 and t["terminals"].count() == 4
    stages = {r["name"]: r["status"] for r in t["analysis_stages"].collect()}
    assert stages == dict.fromkeys(("texts", "symbols", "associations", "conductors", "topology", "semantics"), "completed")
    feeder = lambda: spark.read.parquet(f"{root}/semantic_feeders").head()
    assert (feeder()["feeder_id"], feeder()["resolution"]) == ("FDR-11KV-03", "ambiguous" if "MULTIPLE" in feeder()["path"] else "resolved")

    # a review makes the run stale; only its semantic tables change
    line = t["physical_connections"].head()["id"]
    day = datetime.datetime(2024, 2, 1)
    act = spark.createDataFrame([("r1", "001", "connection", line, "reject", {}, "engineer", day)], EVIDENCE["review_actions"])
    sinks.append(act, root, "review_actions")
    assert runs.recompute_changed(spark, root, F.lit(day).cast("timestamp_ntz")).count() == 0 and feeder()["resolution"] == "resolved"
    assert [r[0] for r in runs.recompute_changed(spark, root, F.lit(day - datetime.timedelta(1)).cast("timestamp_ntz")).collect()] == ["r1"]
    assert feeder()["resolution"] == "unresolved" and spark.read.parquet(f"{root}/semantic_feeders").count() == 1
    assert runs.evidence_tables(spark, root)["symbol_evidence"].count() == 3

    # one document and one bundle a run, with a receipt that replaces an older one
    t = runs.evidence_tables(spark, root)
    t["projects"] = spark.createDataFrame([("p", "Plant", "", day)], EVIDENCE["projects"])
    t["drawings"] = spark.createDataFrame([("d", "p", "a.png", "image/png", "00", 1, 100, 100, 1, "raster_image", day)], EVIDENCE["drawings"])
    t["analysis_runs"] = spark.createDataFrame([("r1", "d", "completed", "v1", None, day, day)], EVIDENCE["analysis_runs"])
    document = json.loads(runs.full_export(t).head()["document"])
    assert document["project"]["name"] == "Plant" and len(document["equipment"]) == 3 and len(document["semantic_feeders"]) == 1 and document["id"] == "r1"
    for _ in range(2):
        archive, t["export_artifacts"] = runs.export_run(t, "r1")
    assert t["export_artifacts"].count() == 1
    inside = zipfile.ZipFile(io.BytesIO(archive))
    assert json.loads(inside.read("project.json"))["drawing"]["original_filename"] == "a.png"


def answers(spark, field, item):
    """Two workers' answers for one page, each with the same item twice, and their requests."""
    schema = {"regions": readers.OCR_LINE, "detections": readers.SYMBOL_LINE}[field]
    rows = [(json.dumps({"request_id": q, "status": "ok", field: [item(q, k) for k in (0, 1)]}),) for q in ("q1", "q2")]
    lines = spark.createDataFrame(rows, "j string").select(F.from_json("j", schema).alias("a")).select("a.*")
    return lines, spark.createDataFrame([(q, "r1", 1) for q in ("q1", "q2")], "request_id string, analysis_run_id string, page int")


def test_texts_of_other_answers_stay(spark):
    lines, requests = answers(spark, "regions", lambda q, k: {"text": "11KV", "confidence": 0.9, "bbox_normalized": [0.1, 0.1, 0.2, 0.2], "tile_index": k})
    assert sorted(r["id"] for r in runs.text_rows(lines, requests).collect()) == ["text:q1:0000", "text:q2:0000"]


def test_symbols_of_other_answers_stay(spark):
    lines, requests = answers(spark, "detections", lambda q, k: {"id": f"{q}-{k}", "predicted_class": "load", "confidence": 0.9 - k / 10, "bbox_normalized": [0.1, 0.1, 0.2, 0.2]})
    assert sorted(r["id"] for r in runs.symbol_rows(lines, requests).collect()) == ["q1-0", "q2-0"]


def test_failures_are_logged(spark, tmp_path):
    stages = runs.Stages(spark, ["r1", "r2"], str(tmp_path / "store"))
    with pytest.raises(ZeroDivisionError):
        stages.run("texts", lambda: 1 / 0)
    got = runs.evidence_tables(spark, str(tmp_path / "store"))["analysis_stages"].collect()
    assert {(r["analysis_run_id"], r["name"], r["status"]) for r in got} == {("r1", "texts", "failed"), ("r2", "texts", "failed")} and all("ZeroDivisionError" in r["message"] for r in got)


def test_artifacts_stay_below_their_root(spark, tmp_path):
    assert runs.artifact_path("/a", "r1/./x/../page.json") == "/a/r1/page.json"
    for bad in ("../x", "r/../../x", "/etc/x", "", "a\\..\\x"):
        with pytest.raises(ValueError):
            runs.artifact_path("/a", bad)
    runs.write_page_artifacts(spark.createDataFrame([("r1", 1, "a"), ("r1", 2, "b")], "analysis_run_id string, page int, v string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("page = 2").head()["v"] == "b"
