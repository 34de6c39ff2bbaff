"""Pixel kernels on page rasters, for mapInPandas: NumPy only.

A raster is a uint8 array; ink is non-zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a[y + dy, x + dx] at (y, x), 0 outside."""
    out = np.zeros_like(a)
    h, w = a.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def thin(ink: np.ndarray, rounds: int = 100) -> np.ndarray:
    """One-pixel skeleton by Zhang and Suen's two alternating peelings (1984)."""
    a = (ink > 0).astype(np.uint8)
    for _ in range(rounds):
        before = a.sum()
        for first in (True, False):
            ring = np.stack([shifted(a, dy, dx) for dy, dx in RING])
            north, east, south, west = ring[0], ring[2], ring[4], ring[6]
            rises = ((ring == 0) & (np.roll(ring, -1, axis=0) == 1)).sum(axis=0)
            count = ring.sum(axis=0)
            open_sides = (north & east & south) | (east & south & west) if first else (north & east & west) | (north & south & west)
            a[(a == 1) & (count >= 2) & (count <= 6) & (rises == 1) & (open_sides == 0)] = 0
        if a.sum() == before:
            break
    return a * 255


def box_sum(a: np.ndarray, ry: int, rx: int) -> np.ndarray:
    """Sum over the (2 ry + 1) by (2 rx + 1) window around each pixel."""
    padded = np.pad(a.astype(np.int64), ((ry + 1, ry), (rx + 1, rx)))
    s = padded.cumsum(0).cumsum(1)
    k, m = 2 * ry + 1, 2 * rx + 1
    return s[k:, m:] - s[:-k, m:] - s[k:, :-m] + s[:-k, :-m]


def open_lines(ink: np.ndarray, length: int, horizontal: bool) -> np.ndarray:
    """Morphological opening by a line: ink in level or upright runs of at least length."""
    a = (ink > 0) if horizontal else (ink > 0).T
    out = np.zeros_like(a)
    for y in range(a.shape[0]):
        edge = np.diff(np.concatenate(([0], a[y].astype(np.int8), [0])))
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if e - s >= length:
                out[y, s:e] = True
    return (out if horizontal else out.T).astype(np.uint8) * 255


def gaussian_threshold(gray: np.ndarray, size: int = 31, offset: float = 9) -> np.ndarray:
    """Ink darker than its Gaussian-weighted surroundings by offset."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    soft = np.apply_along_axis(lambda r: np.convolve(np.pad(r, size // 2, mode="edge"), kernel, "valid"), 1, gray.astype(float))
    soft = np.apply_along_axis(lambda r: np.convolve(np.pad(r, size // 2, mode="edge"), kernel, "valid"), 0, soft)
    return np.where(gray <= soft - offset, 255, 0).astype(np.uint8)


def blobs(mask: np.ndarray) -> list[tuple[int, float, float]]:
    """(area, x, y) of 8-connected components, in order of their first pixel."""
    todo = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}
    out = []
    for seed in sorted(todo):
        if seed not in todo:
            continue
        todo.discard(seed)
        queue, pixels = [seed], []
        while queue:
            y, x = queue.pop()
            pixels.append((y, x))
            for dy, dx in RING:
                if (y + dy, x + dx) in todo:
                    todo.discard((y + dy, x + dx))
                    queue.append((y + dy, x + dx))
        ys, xs = np.array(pixels).T
        out.append((len(pixels), float(xs.mean()), float(ys.mean())))
    return out


def junctions(skeleton: np.ndarray, gray: np.ndarray | None = None, mask: np.ndarray | None = None, density: float = 0.58) -> list[tuple[float, float, int]]:
    """(x, y, degree) in page coordinates of branchings; with the page's gray values only those on a dark dot."""
    a = (skeleton > 0).astype(np.uint8)
    degree = box_sum(a, 1, 1) - a
    h, w = a.shape
    ink = None
    if gray is not None:
        ink = gray <= 150
        if mask is not None:
            ink &= mask == 0
    out = []
    for area, x, y in blobs((degree >= 3) & (a > 0)):
        if area < 2:
            continue
        px, py = round(x), round(y)
        if ink is not None:
            r = max(4, min(h, w) // 180)
            part = ink[max(0, py - r) : py + r + 1, max(0, px - r) : px + r + 1]
            if part.mean() < density:
                continue
        out.append((round(px / w, 6), round(py / h, 6), int(degree[py, px])))
    return out


def protected(shape: tuple[int, int], boxes: list[tuple[float, float, float, float]], inset_share: float = 0.0018, corridors: list[tuple[float, float, float, float]] = ()) -> np.ndarray:
    """255 inside boxes less a small inset; 0 again in short strips outwards from (x, y, dx, dy) terminals."""
    h, w = shape
    mask = np.zeros(shape, np.uint8)
    inset = max(1, round(min(h, w) * inset_share))
    for x1, y1, x2, y2 in boxes:
        mask[max(0, round(y1 * h) + inset) : min(h - 1, round(y2 * h) - inset) + 1, max(0, round(x1 * w) + inset) : min(w - 1, round(x2 * w) - inset) + 1] = 255
    length, half = max(14, round(min(h, w) * 0.032)), max(3, round(min(h, w) * 0.0045)) // 2
    for x, y, dx, dy in corridors:
        norm = max(1e-6, float(np.hypot(dx, dy)))
        for t in range(length + 1):
            px, py = round(x * w + dx / norm * t), round(y * h + dy / norm * t)
            mask[max(0, py - half) : py + half + 1, max(0, px - half) : px + half + 1] = 0
    return mask


def support(lines: np.ndarray, x1: float, y1: float, x2: float, y2: float, spread: int = 2) -> tuple[float, float]:
    """(coverage, longest): shares of a straight way that have ink near them, in all and in one run."""
    h, w = lines.shape
    n = max(12, round(float(np.hypot(x2 - x1, y2 - y1)) * max(h, w) * 1.4))
    near = box_sum((lines > 0).astype(np.uint8), spread, spread) > 0
    xs, ys = np.linspace(x1 * w, x2 * w, n).astype(int), np.linspace(y1 * h, y2 * h, n).astype(int)
    inside = (xs >= 0) & (xs < w) & (ys >= 0) & (ys < h)
    hit = np.zeros(n, bool)
    hit[inside] = near[ys[inside], xs[inside]]
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    runs = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    return float(hit.mean()), float(runs.max(initial=0)) / n


def straight_segments(lines: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Level and upright runs of ink of at least a length, one a stroke: a deterministic stand-in for a line transform."""
    out = []
    for horizontal in (True, False):
        mask = open_lines(lines, least, horizontal)
        a = mask if horizontal else mask.T
        used = np.zeros_like(a, bool)
        for y in range(a.shape[0]):
            edge = np.diff(np.concatenate(([0], (a[y] > 0).astype(np.int8), [0])))
            for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                if not used[y, s:e].any():
                    depth = y
                    while depth + 1 < a.shape[0] and a[depth + 1, s:e].mean() > 0.5:
                        depth += 1
                        used[depth, s:e] = True
                    mid = (y + depth) // 2
                    out.append((int(s), mid, int(e - 1), mid) if horizontal else (mid, int(s), mid, int(e - 1)))
    return out


def skew_angle(segments: list[tuple[int, int, int, int]], limit: float = 15.0) -> float:
    """Median angle of the nearly level segments, in degrees; 0 without any."""
    angles = [a for x1, y1, x2, y2 in segments if abs(a := float(np.degrees(np.arctan2(y2 - y1, x2 - x1)))) <= limit]
    return float(np.median(angles)) if angles else 0.0


def _decode(row) -> np.ndarray:
    return np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width)


def skeletons(pages: DataFrame) -> DataFrame:
    """pages (analysis_run_id, page, width, height, pixels: ink, row by row) with skeleton instead of pixels."""

    def run(parts):
        for part in parts:
            part["skeleton"] = [thin(_decode(r)).tobytes() for r in part.itertuples()]
            yield part[["analysis_run_id", "page", "width", "height", "skeleton"]]

    return pages.select("analysis_run_id", "page", "width", "height", "pixels").mapInPandas(run, "analysis_run_id string, page int, width int, height int, skeleton binary")


def page_junctions(pages: DataFrame) -> DataFrame:
    """(analysis_run_id, page, id, x, y, degree, kind) of each page's skeleton branchings."""

    def run(parts):
        for part in parts:
            rows = [(r.analysis_run_id, r.page, f"junction:{k:03}", x, y, d, "connected_junction") for r in part.itertuples() for k, (x, y, d) in enumerate(junctions(thin(_decode(r))))]
            yield pd.DataFrame(rows, columns=["analysis_run_id", "page", "id", "x", "y", "degree", "kind"])

    return pages.select("analysis_run_id", "page", "width", "height", "pixels").mapInPandas(run, "analysis_run_id string, page int, id string, x double, y double, degree int, kind string")


def page_conductors(pages: DataFrame) -> DataFrame:
    """(analysis_run_id, page, id, polyline, confidence) of each page's straight traces; confidence grows with length."""

    def run(parts):
        for part in parts:
            rows = []
            for r in part.itertuples():
                least = max(18, round(min(r.height, r.width) * 0.018))
                for k, (x1, y1, x2, y2) in enumerate(straight_segments(_decode(r), least)):
                    line = [{"x": round(x1 / r.width, 6), "y": round(y1 / r.height, 6)}, {"x": round(x2 / r.width, 6), "y": round(y2 / r.height, 6)}]
                    rows.append((r.analysis_run_id, r.page, f"conductor:{k:04}", line, round(min(0.95, 0.48 + float(np.hypot(x2 - x1, y2 - y1)) / max(r.width, r.height) * 0.85), 4)))
            yield pd.DataFrame(rows, columns=["analysis_run_id", "page", "id", "polyline", "confidence"])

    return pages.select("analysis_run_id", "page", "width", "height", "pixels").mapInPandas(run, "analysis_run_id string, page int, id string, polyline array<struct<x:double,y:double>>, confidence double")


def corridor_support(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """topology.corridor_pairs with coverage and longest, from the page's line raster."""
    flat = pairs.select("analysis_run_id", "page", "l", "r", "gap", F.col("l.at.x").alias("x1"), F.col("l.at.y").alias("y1"), F.col("r.at.x").alias("x2"), F.col("r.at.y").alias("y2"))
    grouped = flat.groupBy("analysis_run_id", "page").agg(F.collect_list(F.struct("l", "r", "gap", "x1", "y1", "x2", "y2")).alias("ways"))
    ways = grouped.join(pages.select("analysis_run_id", "page", "width", "height", "pixels"), ["analysis_run_id", "page"])

    def run(parts):
        for part in parts:
            part["found"] = [[dict(zip(("coverage", "longest"), support(_decode(r), w["x1"], w["y1"], w["x2"], w["y2"]), strict=True)) for w in r.spans] for r in part.itertuples()]
            yield part[["analysis_run_id", "page", "found"]]

    spans = ways.withColumn("spans", F.transform("ways", lambda w: F.struct(w["x1"].alias("x1"), w["y1"].alias("y1"), w["x2"].alias("x2"), w["y2"].alias("y2"))))
    found = spans.select("analysis_run_id", "page", "width", "height", "pixels", "spans").mapInPandas(run, "analysis_run_id string, page int, found array<struct<coverage:double,longest:double>>")
    both = grouped.join(found, ["analysis_run_id", "page"]).select("analysis_run_id", "page", F.explode(F.arrays_zip("ways", "found")).alias("z"))
    return both.select("analysis_run_id", "page", "z.ways.l", "z.ways.r", "z.ways.gap", "z.found.coverage", "z.found.longest")
