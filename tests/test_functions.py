import pytest
from pyspark.sql import functions as F

from netsift.functions import geometry as geo
from netsift.functions import text as txt

LABELS = [
    ("11KV", "11 kV", 1.0, False, "voltage"), ("630A", "630 A", 1.0, False, "current_rating"), ("25MVA", "25 MVA", 1.0, False, "power_rating"), ("CB-O7", "CB-07", 0.62, True, "equipment_id"),
    ("FDR-11KV-03", "FDR-11KV-03", 0.98, False, "feeder_id"), ("BUS-A", "BUS-A", 0.98, False, "bus_id"), ("BUS-B", "BUS-8", 0.62, True, "bus_id"), ("CBO7", "CBO7", 1.0, False, "unknown"),
    ("N/O", "N/O", 1.0, False, "switch_state"), ("LOAD-01", "LOAD-01", 1.0, False, "unknown"), ("unstructured note", "unstructured note", 1.0, False, "unknown"), (" 33.5 k v\t", "33.5 kV", 1.0, False, "voltage"), ("", "", 1.0, False, "unknown"),
]


def test_labels(spark):
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(LABELS)], "id int, t string")
    got = df.select("id", txt.normalize(F.col("t")).alias("n"), txt.classify(F.col("t")).alias("c")).orderBy("id").collect()
    assert [(r["n"]["normalized_text"], r["n"]["confidence"], r["n"]["requires_review"], r["c"]["text_type"]) for r in got] == [x[1:] for x in LABELS]


def test_null_label(spark):
    r = spark.createDataFrame([(None,)], "t string").select(txt.normalize(F.col("t")).alias("n"), txt.classify(F.col("t")).alias("c")).head()
    assert r["n"] is None and r["c"]["text_type"] == "unknown"


def test_long_prose_is_quick(spark):
    r = spark.createDataFrame([("CB" + "A1-" * 3000 + "!",)], "t string").select(txt.normalize(F.col("t")).alias("n")).head()
    assert r["n"]["evidence"] == "raw text retained"


def test_ratings(spark):
    r = spark.createDataFrame([("33/11 kV · 25 MVA 630 a",)], "t string").select(txt.first_kilovolts(F.col("t")).alias("kv"), txt.voltage_part(F.col("t")).alias("p"), txt.rating_components(F.col("t")).alias("c")).head()
    assert r["kv"] == 11 and r["p"] == "33/11 kV"
    assert [(x["semantic_type"], x["value"]) for x in r["c"]] == [("current_rating", "630 A"), ("power_rating", "25 MVA")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_boxes(spark):
    a, b = geo.box(0, 0, 1, 1), geo.box(0.5, 0.5, 1, 1)
    assert one(spark, geo.iou(a, b)) == one(spark, geo.iou(b, a)) == 0.25
    assert one(spark, geo.iou(geo.box(0, 0, 0, 0), geo.box(0, 0, 0, 0))) == 0
    assert one(spark, geo.valid_box(a)) and not one(spark, geo.valid_box(geo.box(0.5, 0, 0.5, 1)))
    assert [(t["x"], t["y"]) for t in one(spark, geo.tile_origins(F.lit(1500), F.lit(1100), 800, 96))] == [(0, 0), (700, 0), (0, 300), (700, 300)]
    assert [(t["x"], t["y"]) for t in one(spark, geo.tile_origins(F.lit(100), F.lit(100), 800, 96))] == [(0, 0)]
    assert one(spark, geo.yolo_line(F.lit(3), geo.box(0.1, 0.2, 0.3, 0.6))) == "3 0.200000 0.400000 0.200000 0.400000"


def test_segments(spark):
    p = geo.point
    x = [p(0.1, 0.5), p(0.9, 0.5), p(0.5, 0.1), p(0.5, 0.9)]
    met = one(spark, geo.line_intersection(*x))
    assert (met["x"], met["y"]) == (0.5, 0.5)
    assert not one(spark, geo.is_tee(geo.line_intersection(*x), *x))
    t = [p(0.1, 0.5), p(0.9, 0.5), p(0.5, 0.2), p(0.5, 0.5)]
    assert one(spark, geo.is_tee(geo.line_intersection(*t), *t))
    assert one(spark, geo.line_intersection(p(0, 0), p(1, 0), p(0, 1), p(1, 1))) is None
    assert one(spark, geo.project_on_segment(p(2, 1), p(0, 0), p(1, 0)))["distance"] == pytest.approx(2**0.5)
    assert one(spark, geo.project_on_segment(p(3, 4), p(0, 0), p(0, 0)))["distance"] == 5
    assert one(spark, geo.snap_radius(geo.box(0, 0, 1, 1))) == 0.07 and one(spark, geo.snap_radius(geo.box(0, 0, 0, 0))) == 0.018
    view = geo.fit_view(F.lit(100.0), F.lit(50.0), F.lit(400.0), F.lit(400.0))
    back = one(spark, geo.from_view(geo.to_view(p(0.3, 0.7), F.lit(100.0), F.lit(50.0), view), F.lit(100.0), F.lit(50.0), view))
    assert (back["x"], back["y"]) == (pytest.approx(0.3), pytest.approx(0.7))
