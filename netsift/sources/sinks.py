"""Writing tables, graph documents, pictures and bundles."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions.geometry import coco_box, tile_origins, visible_share, yolo_line
from netsift.functions.text import html_escape


def append(df: DataFrame, root: str, name: str) -> None:
    """Evidence of further runs, a partition a run."""
    df.write.mode("append").partitionBy("analysis_run_id").parquet(f"{root}/{name}")


def replace_runs(df: DataFrame, root: str, name: str) -> None:
    """Derived rows instead of what their runs had; other runs stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_run_id").parquet(f"{root}/{name}")


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows by key before stored ones."""
    return fresh.unionByName(stored.join(fresh, key, "left_anti"), allowMissingColumns=True)


#: Items of a part of a graph's document.
PART_ITEMS = 1000


def _document_items() -> dict[str, Column]:
    """By table, what stands for a row in a graph's document; attributes are still entries, as maps have no order."""
    box = F.when(F.col("bbox").isNotNull(), F.array("bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2"))
    geometry = lambda b, line: F.struct(b.alias("bbox"), line.alias("polyline"), F.lit(0).alias("rotation"))
    no_line, no_box = F.array().cast("array<array<double>>"), F.lit(None).cast("array<double>")
    line = F.transform("polyline", lambda p: F.array(p["x"], p["y"]))
    return {
        "equipment": F.struct("id", "equipment_id", "type", "page", geometry(box, no_line).alias("geometry"), F.map_entries("attributes").alias("attributes"), "confidence", "provenance", "review_status"),
        "terminals": F.struct("id", "equipment_id", "name", F.array("x", "y").alias("position")),
        "connections": F.struct("id", "from_terminal_id", "to_terminal_id", geometry(no_box, line).alias("geometry"), "switch_state", "confidence", "provenance", "review_status"),
    }


def _listed(name: str) -> Column:
    """The items of a group in their order.  To be taken of rows (ord, item)."""
    return F.transform(F.sort_array(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]).alias(name)


def _with_maps(rows: DataFrame) -> DataFrame:
    return rows.withColumn("equipment", F.transform("equipment", lambda x: x.withField("attributes", F.map_from_entries(x["attributes"]))))


def graph_json(equipment: DataFrame, terminals: DataFrame, connections: DataFrame) -> DataFrame:
    """(graph_id, document): each graph as one JSON text that readers.explode_graphs takes back.

    A text holds its whole graph: for drawings.  Graphs of any size are written by graph_parts.
    """
    tables, items = {"equipment": equipment, "terminals": terminals, "connections": connections}, _document_items()
    e, t, c = (df.select("graph_id", "ord", items[name].alias("item")).groupBy("graph_id").agg(_listed(name)) for name, df in tables.items())
    rows = _with_maps(e).join(t, "graph_id", "left").join(c, "graph_id", "left")
    return rows.select("graph_id", F.to_json(F.struct(F.col("graph_id").alias("id"), "equipment", "terminals", "connections")).alias("document"))


def graph_parts(equipment: DataFrame, terminals: DataFrame, connections: DataFrame, most: int = PART_ITEMS) -> DataFrame:
    """(graph_id, document): each graph as JSON texts of at most `most` items of one table each, for graphs of any size.

    A text names its graph and the place of its first item among the table's, so
    readers.explode_graphs takes all of them back in order, whatever order they are read in.
    """
    tables, items, found = {"equipment": equipment, "terminals": terminals, "connections": connections}, _document_items(), []
    for name, df in tables.items():
        # Places by ranges of ord, so that no graph is ordered in one task; within a range they are counted, as ord may repeat.
        at = F.coalesce(F.floor(F.col("ord") / most), F.lit(-(1 << 40))).alias("at")
        sizes = df.select("graph_id", at).groupBy("graph_id", "at").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("graph_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("graph_id", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        turn = F.row_number().over(Window.partitionBy("graph_id", "at").orderBy("ord", "item")) - 1
        rows = df.select("graph_id", "ord", at, items[name].alias("item")).withColumn("nth", F.floor(turn / most))
        rows = rows.groupBy("graph_id", "at", "nth").agg(_listed(name)).join(sizes, ["graph_id", "at"])
        rows = _with_maps(rows) if name == "equipment" else rows
        found.append(rows.select("graph_id", F.to_json(F.struct(F.col("graph_id").alias("id"), (F.col("before") + F.col("nth") * most).alias("first"), name)).alias("document")))
    return reduce(DataFrame.unionByName, found)


def svg(equipment: DataFrame, terminals: DataFrame, connections: DataFrame, width: int = 1280, height: int = 680) -> DataFrame:
    """(graph_id, svg): a clean picture of each graph; open connections in their own colour, labels escaped."""
    at = terminals.select("graph_id", F.col("id").alias("t"), (F.col("x") * width).alias("px"), (F.col("y") * height).alias("py"))
    end = lambda n, c: at.select("graph_id", F.col("t").alias(c), F.col("px").alias(f"x{n}"), F.col("py").alias(f"y{n}"))
    colour = F.when(F.col("switch_state") == "open", "#a54224").otherwise("#30332f")
    line = F.format_string('<line x1="%.0f" y1="%.0f" x2="%.0f" y2="%.0f" stroke="%s" stroke-width="4" stroke-linecap="round"/>', "x1", "y1", "x2", "y2", colour)
    lines = connections.join(end(1, "from_terminal_id"), ["graph_id", "from_terminal_id"]).join(end(2, "to_terminal_id"), ["graph_id", "to_terminal_id"]).select("graph_id", F.lit(0).alias("layer"), "ord", line.alias("part"))
    b = F.coalesce("bbox", F.struct(F.lit(0.1).alias("x1"), F.lit(0.1).alias("y1"), F.lit(0.15).alias("x2"), F.lit(0.15).alias("y2")))
    x, y, w, h = b["x1"] * width, b["y1"] * height, (b["x2"] - b["x1"]) * width, (b["y2"] - b["y1"]) * height
    shape = F.format_string('<rect x="%.0f" y="%.0f" width="%.0f" height="%.0f" rx="6" fill="#f8f7f2" stroke="#30332f" stroke-width="2"/>', x, y, w, h)
    label = F.format_string('<text x="%.0f" y="%.0f" fill="#222522" font-size="15" text-anchor="middle" font-family="Arial">%s</text>', x + w / 2, y + h / 2 + 5, html_escape(F.col("equipment_id")))
    nodes = equipment.select("graph_id", F.lit(1).alias("layer"), "ord", F.concat(shape, label).alias("part"))
    parts = lines.unionByName(nodes).groupBy("graph_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("layer", "ord", "part"))), lambda p: p["part"]), "").alias("body"))
    opening = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img" aria-label="Network graph"><rect width="100%" height="100%" fill="#f8f7f2"/>'
    return parts.select("graph_id", F.concat(F.lit(opening), "body", F.lit("</svg>")).alias("svg"))


def flat(df: DataFrame) -> DataFrame:
    """df for CSV: columns by name, nested ones as JSON."""
    nested = ("array", "map", "struct")
    return df.select(*[(F.to_json(c) if t.startswith(nested) else F.col(c)).alias(c) for c, t in sorted(df.dtypes)])


def bundle(tables: dict[str, DataFrame], documents: dict[str, str], graph: str, picture: str) -> tuple[bytes, dict]:
    """(zip, manifest) of one graph: its JSON, a CSV a table, the picture and a manifest with digests.

    One graph's rows are bounded by a drawing; a corpus is written with write_csv.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in documents.items():
            archive.writestr(name, text)
        archive.writestr("graph.json", graph)
        for name, df in tables.items():
            rows = flat(df)
            stream = io.StringIO()
            writer = csv.writer(stream)
            writer.writerow(rows.columns or ["id"])
            writer.writerows(rows.toLocalIterator())
            archive.writestr(f"{name}.csv", stream.getvalue())
        archive.writestr("reconstructed.svg", picture)
        manifest = {"graph_sha256": hashlib.sha256(graph.encode()).hexdigest(), "files": sorted(archive.namelist())}
        archive.writestr("manifest.json", json.dumps(manifest, indent=2))
    return out.getvalue(), manifest


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def coco(objects: DataFrame, class_order: list[str]) -> DataFrame:
    """(image, object_id, category_id, bbox, area): pixel boxes.  objects: image, id, class_name, bbox, width, height."""
    index = F.array_position(F.array(*map(F.lit, class_order)), F.col("class_name")) - 1
    b = coco_box(F.col("bbox"), F.col("width"), F.col("height"))
    return objects.select("image", F.col("id").alias("object_id"), index.alias("category_id"), b.alias("bbox"), (F.get(b, 2) * F.get(b, 3)).alias("area"))


def yolo(objects: DataFrame, class_order: list[str]) -> DataFrame:
    """(image, lines): one text a picture, one line an object in order."""
    index = (F.array_position(F.array(*map(F.lit, class_order)), F.col("class_name")) - 1).cast("int")
    line = yolo_line(index, F.col("bbox"))
    return objects.groupBy("image").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def tile_manifest(objects: DataFrame, size: int = 640, overlap: int = 96, least: float = 0.6) -> DataFrame:
    """(image, origin, id, visibility): objects that are mostly inside each tile."""
    tiles = objects.withColumn("origin", F.explode(tile_origins(F.col("width"), F.col("height"), size, overlap)))
    b = F.struct((F.col("bbox.x1") * F.col("width")).alias("x1"), (F.col("bbox.y1") * F.col("height")).alias("y1"), (F.col("bbox.x2") * F.col("width")).alias("x2"), (F.col("bbox.y2") * F.col("height")).alias("y2"))
    return tiles.withColumn("v", visible_share(b, F.col("origin"), size)).where(F.col("v") >= least).select("image", "origin", "id", F.round("v", 4).alias("visibility"))


def truth_manifest(equipment: DataFrame, connections: DataFrame, paths: DataFrame) -> DataFrame:
    """(graph_id, sources, feeders, busbars, switch_states, paths): what a generated drawing must show."""
    ids = lambda *kinds: F.sort_array(F.collect_list(F.when(F.col("type").isin(*kinds), F.col("id"))))
    e = equipment.groupBy("graph_id").agg(ids("energy_source", "grid_incomer", "generator").alias("sources"), ids("feeder").alias("feeders"), ids("busbar").alias("busbars"))
    c = connections.groupBy("graph_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "switch_state")))).alias("switch_states"))
    p = paths.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("feeder_equipment_id", "source_equipment_id", "equipment_path", "connection_path"))).alias("paths"))
    return e.join(c, "graph_id", "left").join(p, "graph_id", "left")


