"""Reading uploads, worker lines, manifests and graph documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.sources.schemas import EVIDENCE

#: What may be uploaded, and how large.
SUFFIXES, LARGEST = ("png", "jpg", "jpeg", "pdf"), 50 * 1024 * 1024

_GEOMETRY = "struct<bbox:array<double>,polyline:array<array<double>>,rotation:int>"
GRAPH_DOCUMENT = (
    f"id string, first long, equipment array<struct<id:string,equipment_id:string,type:string,page:int,geometry:{_GEOMETRY},attributes:map<string,string>,confidence:double,provenance:array<string>,review_status:string>>, "
    "terminals array<struct<id:string,equipment_id:string,name:string,position:array<double>>>, "
    f"connections array<struct<id:string,from_terminal_id:string,to_terminal_id:string,geometry:{_GEOMETRY},switch_state:string,confidence:double,provenance:array<string>,review_status:string>>"
)


def table(spark: SparkSession, root: str, name: str, run: str | None = None) -> DataFrame:
    """An evidence table, one run's partition of it, or an empty one of its schema where nothing was written."""
    rows = spark.read.schema(EVIDENCE[name]).parquet(f"{root}/{name}")
    return rows if run is None else rows.where(F.col("analysis_run_id") == run)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, size_bytes, sha256, content, refused) of files; refused says why one is not taken."""
    files = spark.read.format("binaryFile").load(path)
    # content of files that are refused by name or length is never looked at, and not handed on
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    fits = suffix.isin(*SUFFIXES) & F.col("length").between(1, LARGEST)
    why = F.when(~suffix.isin(*SUFFIXES), "unsupported type").when(F.col("length") > LARGEST, "too large").when(F.col("length") == 0, "empty").when(~_magic(suffix), "unreadable")
    return files.select("path", suffix.alias("suffix"), F.col("length").alias("size_bytes"), F.when(fits, F.sha2("content", 256)).alias("sha256"), F.when(fits, F.col("content")).alias("content"), why.alias("refused"))


def _magic(suffix: Column) -> Column:
    head = F.hex(F.substring("content", 1, 8))
    return F.when(suffix == "png", head.startswith("89504E470D0A1A0A")).when(suffix == "pdf", head.startswith("25504446")).otherwise(head.startswith("FFD8FF"))


def inspect(files: DataFrame) -> DataFrame:
    """(path, input_type, page_count, width, height, text_count, vector_count, image_count, recommended_pipeline) of files that were not refused.

    PNG and JPEG sizes come from their headers; a broken header has none.  A PDF is looked at as bytes:
    pages, text and path operators of streams that zlib can open, and images.
    """
    columns = "path string, page_count int, width int, height int, text_count int, vector_count int, image_count int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(p, *_measure(s, bytes(c))) for p, s, c in zip(part["path"], part["suffix"], part["content"], strict=True)], columns=["path", "page_count", "width", "height", "text_count", "vector_count", "image_count"])

    if "refused" in files.columns:
        files = files.where("refused is null")
    found = files.select("path", "suffix", "content").mapInPandas(run, columns).join(files.select("path", "suffix"), "path")
    pdf = F.col("suffix") == "pdf"
    kind = F.when(~pdf & F.col("suffix").isin(*SUFFIXES), "raster_image").when(~pdf, "unknown").when((F.col("vector_count") > 0) & (F.col("image_count") > 0), "hybrid_pdf").when(F.col("vector_count") > 0, "vector_pdf").otherwise("raster_pdf")
    route = F.when(kind == "hybrid_pdf", "hybrid_ready").when(kind == "vector_pdf", "vector_ready").when(kind == "unknown", "unsupported").otherwise("raster")
    return found.select("path", kind.alias("input_type"), "page_count", "width", "height", "text_count", "vector_count", "image_count", route.alias("recommended_pipeline"))


def _measure(suffix: str, data: bytes) -> tuple:
    import re
    import struct
    import zlib

    if suffix == "png":
        w, h = struct.unpack(">II", data[16:24]) if len(data) >= 24 else (None, None)
        return 1, w, h, 0, 0, 1
    if suffix in ("jpg", "jpeg"):
        at = 2
        while at + 9 < len(data):
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return 1, w, h, 0, 0, 1
            at += 2 + max(2, size)
        return 1, None, None, 0, 0, 1
    if suffix != "pdf":
        return 0, None, None, 0, 0, 0
    pages = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data))
    boxes = re.findall(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", data)
    width, height = (round(float(boxes[-1][2]) - float(boxes[-1][0])), round(float(boxes[-1][3]) - float(boxes[-1][1]))) if boxes else (None, None)
    text = vector = 0
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", data, re.S):
        try:
            body = zlib.decompress(m[1])
        except zlib.error:
            body = m[1]
        text += len(re.findall(rb"\bT[jJ]\b", body))
        vector += len(re.findall(rb"(?<=[\s\d])(?:re|l|c)\s*\n?", body)) if re.search(rb"\b[SsfFbB]\*?\b", body) else 0
    images = len(re.findall(rb"/Subtype\s*/Image", data))
    return pages, width, height, text, vector, images


def worker_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a worker's JSON lines; malformed ones keep their text in broken."""
    return spark.read.schema(f"{schema}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)


OCR_LINE = "request_id string, status string, error string, regions array<struct<text:string,confidence:double,bbox_normalized:array<double>,tile_index:int>>"
SYMBOL_LINE = "request_id string, status string, error string, detections array<struct<id:string,predicted_class:string,confidence:double,bbox_normalized:array<double>,orientation_deg:int,tile_origin:array<int>>>"


def graph_documents(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Graph tables of JSON documents, one graph a file."""
    return explode_graphs(spark.read.schema(GRAPH_DOCUMENT).option("multiLine", True).json(path))


def explode_graphs(documents: DataFrame) -> dict[str, DataFrame]:
    """Graph tables of whole documents, or of sinks.graph_parts' texts, which say where their items begin."""
    first = F.coalesce("first", F.lit(0)) if "first" in documents.columns else F.lit(0)
    # posexplode would let Spark ask for the array's size before, and read each text a second time for it.
    rows = lambda name: documents.select(F.col("id").alias("graph_id"), first.alias("first"), F.posexplode_outer(name).alias("pos", "x")).where("pos is not null").select("graph_id", (F.col("first") + F.col("pos")).cast("int").alias("ord"), "x")
    box, line = F.col("x.geometry.bbox"), F.col("x.geometry.polyline")
    equipment = rows("equipment").select("graph_id", "ord", "x.id", "x.equipment_id", "x.type", F.coalesce("x.page", F.lit(1)).alias("page"), F.when(box.isNotNull(), F.struct(*[F.get(box, k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])).alias("bbox"), F.coalesce("x.attributes", F.create_map().cast("map<string,string>")).alias("attributes"), "x.confidence", "x.provenance", F.coalesce("x.review_status", F.lit("pending")).alias("review_status"))
    terminals = rows("terminals").select("graph_id", "ord", "x.id", "x.equipment_id", "x.name", F.get("x.position", 0).alias("x"), F.get("x.position", 1).alias("y"))
    connections = rows("connections").select("graph_id", "ord", "x.id", "x.from_terminal_id", "x.to_terminal_id", F.transform(line, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))).alias("polyline"), "x.switch_state", "x.confidence", "x.provenance", F.coalesce("x.review_status", F.lit("pending")).alias("review_status"))
    return {"equipment": equipment, "terminals": terminals, "connections": connections}


def manifest(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """Entries of a {"entries": [...]} manifest by their schema."""
    return spark.read.schema(f"entries array<struct<{entry}>>").option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")
