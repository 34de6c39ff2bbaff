"""Canonical small graphs as tables: six feeder topologies and a cyclic one.

Names, kinds, ratings and links are fixed values; the layout is computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netsift.sources.schemas import GRAPH

#: graph -> ({id: (label, type, rating)}, [(from, to, switch_state)]).
_TR20, _TR25, _FDR = "33/11 kV · 20 MVA", "33/11 kV · 25 MVA", "11 kV · 630 A"
_DUAL = {
    f"{kind}_{x}": (f"{label}-{x.upper()}{n}", kind_type, rating)
    for x in "ab"
    for kind, label, n, kind_type, rating in (
        ("source", "GRID", "", "energy_source", "11 kV"),
        ("transformer", "TR", "", "power_transformer", _TR20),
        ("bus", "BUS", "", "busbar", "11 kV"),
        ("breaker", "CB", "1", "circuit_breaker", "11 kV"),
        ("feeder", "FDR", "", "feeder", _FDR),
    )
}
_DUAL_LINKS = [link for x in "ab" for link in ((f"source_{x}", f"transformer_{x}", None), (f"transformer_{x}", f"bus_{x}", None), (f"bus_{x}", f"breaker_{x}", "closed"), (f"breaker_{x}", f"feeder_{x}", None))]
_COUPLER = {"bus_coupler": ("BC-01", "bus_coupler", "11 kV · 1250 A")}
SPECS = {
    "fixture_radial_01": (
        {"source_grid": ("GRID-01", "energy_source", _FDR), "transformer_01": ("TR-01", "power_transformer", _TR25), "bus_a": ("BUS-A", "busbar", _FDR), "breaker_01": ("CB-01", "circuit_breaker", _FDR), "ct_01": ("CT-01", "current_transformer", _FDR), "feeder_01": ("FDR-01", "feeder", _FDR)},
        [("source_grid", "transformer_01", None), ("transformer_01", "bus_a", None), ("bus_a", "breaker_01", None), ("breaker_01", "ct_01", None), ("ct_01", "feeder_01", None)],
    ),
    "fixture_dual_transformer_01": (_DUAL, _DUAL_LINKS),
    "fixture_sectionalized_bus_01": (
        {"source_grid": ("GRID-01", "energy_source", "11 kV"), "transformer": ("TR-01", "power_transformer", _TR25), "bus_left": ("BUS-1", "busbar", "11 kV"), "section": ("S-01", "bus_coupler", "11 kV"), "bus_right": ("BUS-2", "busbar", "11 kV"), "feeder_left": ("FDR-1", "feeder", "11 kV"), "feeder_right": ("FDR-2", "feeder", "11 kV")},
        [("source_grid", "transformer", None), ("transformer", "bus_left", None), ("bus_left", "section", "closed"), ("section", "bus_right", "closed"), ("bus_left", "feeder_left", "closed"), ("bus_right", "feeder_right", "closed")],
    ),
    "fixture_bus_coupler_01": (_DUAL | _COUPLER, [*_DUAL_LINKS, ("bus_a", "bus_coupler", "closed"), ("bus_coupler", "bus_b", "closed")]),
    "fixture_alternate_supply_01": (_DUAL | _COUPLER, [*_DUAL_LINKS, ("bus_a", "bus_coupler", "open"), ("bus_coupler", "bus_b", "open")]),
    "fixture_ring_01": (
        {"source_grid": ("GRID-01", "energy_source", "11 kV"), "bus": ("BUS-R", "busbar", "11 kV"), "cb_1": ("CB-1", "circuit_breaker", "11 kV"), "fdr_1": ("FDR-1", "feeder", "11 kV"), "cb_2": ("CB-2", "circuit_breaker", "11 kV"), "fdr_2": ("FDR-2", "feeder", "11 kV")},
        [("source_grid", "bus", None), ("bus", "cb_1", "closed"), ("cb_1", "fdr_1", None), ("bus", "cb_2", "closed"), ("cb_2", "fdr_2", None)],
    ),
    "ours_diamond": (
        {"s": ("GRID-S", "energy_source", ""), "b1": ("BUS-B1", "busbar", ""), "b2": ("BUS-B2", "busbar", ""), "f": ("FDR-F", "feeder", "")},
        [("s", "b1", None), ("b1", "f", None), ("s", "b2", None), ("b2", "f", None)],
    ),
}
CANONICAL = tuple(g for g in SPECS if g.startswith("fixture_"))


def edge_ids(name: str) -> list[str]:
    links = SPECS[name][1]
    if name == "ours_diamond":
        return [f"d{k}" for k in range(1, len(links) + 1)]
    ids, couplers = [], 0
    for k, (a, b, _) in enumerate(links, 1):
        if "bus_coupler" in (a, b):
            couplers += 1
            ids.append(f"edge_bc_{couplers:02}")
        else:
            ids.append(f"edge_{k:02}")
    return ids


def rows_of(name: str) -> dict[str, list[tuple]]:
    """Literal rows of one graph by table, in the order of GRAPH's columns."""
    nodes, links = SPECS[name]
    confidence = 0.5 if name == "ours_diamond" else 1.0
    per_row = 5
    equipment, terminals, at = [], [], {}
    for k, (i, (label, kind, rating)) in enumerate(nodes.items()):
        x, y = 0.03 + 0.19 * (k % per_row), 0.1 + 0.25 * (k // per_row)
        box = (x, y, x + 0.1, y + 0.12)
        at[i] = box
        attributes = {"rating": rating} if rating else {}
        equipment.append((name, k, i, label, kind, 1, box, attributes, 1.0, ["synthetic_ground_truth"], "pending"))
        for j, (end, px) in enumerate((("IN", box[0]), ("OUT", box[2]))):
            terminals.append((name, 2 * k + j, f"{i}_{end.lower()}", i, end, px, (box[1] + box[3]) / 2))
    connections = []
    for k, ((a, b, state), edge) in enumerate(zip(links, edge_ids(name), strict=True)):
        line = [(at[a][2], (at[a][1] + at[a][3]) / 2), (at[b][0], (at[b][1] + at[b][3]) / 2)]
        connections.append((name, k, edge, f"{a}_out", f"{b}_in", line, state, confidence, ["synthetic_ground_truth"], "pending"))
    return {"equipment": equipment, "terminals": terminals, "connections": connections}


def tables_of(spark: SparkSession, rows: dict[str, list[tuple]]) -> dict[str, DataFrame]:
    return {t: spark.createDataFrame(rows[t], GRAPH[t]) for t in ("equipment", "terminals", "connections")}


def graphs(spark: SparkSession, names: tuple[str, ...] = CANONICAL) -> dict[str, DataFrame]:
    """equipment, terminals and connections of the named graphs together."""
    total: dict[str, list[tuple]] = {"equipment": [], "terminals": [], "connections": []}
    for name in names:
        for t, rows in rows_of(name).items():
            total[t] += rows
    return tables_of(spark, total)


#: Splits, style families, first seeds and drawings of the symbol corpus.
CORPUS_PLAN = (("train", "abc", 100, 15), ("validation", "abc", 300, 3), ("test", "abc", 400, 3), ("style_holdout", "d", 500, 12))


def corpus_plan(spark: SparkSession) -> DataFrame:
    """(split, style, seed) of every drawing of the symbol corpus."""
    from pyspark.sql import functions as F

    plan = spark.createDataFrame([(s, list(f"style_{x}" for x in styles), first, n) for s, styles, first, n in CORPUS_PLAN], "split string, styles array<string>, first int, n int")
    plan = plan.select("split", "first", "n", F.posexplode("styles").alias("k", "style"))
    return plan.select("split", "style", F.explode(F.expr("sequence(first + 100 * k, first + 100 * k + n - 1)")).alias("seed"))


def symbol_scenes(spark: SparkSession, plan: DataFrame | None = None) -> DataFrame:
    """(split, style, seed, id, class_name, bbox): one symbol of each class a drawing, in a seeded jittered grid.

    Boxes are a function of the seed alone; no picture is drawn.
    """
    from pyspark.sql import functions as F

    from netsift.functions.geometry import box

    classes = ("busbar", "bus_coupler", "circuit_breaker", "current_transformer", "disconnector", "energy_source", "feeder_terminal", "load", "potential_transformer", "power_transformer")
    plan = corpus_plan(spark) if plan is None else plan
    rows = plan.select("*", F.posexplode(F.array(*map(F.lit, classes))).alias("k", "class_name"))
    noise = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "seed", "k"), F.lit(1000)) / 1000.0
    x, y = 0.05 + 0.18 * (F.col("k") % 5) + 0.03 * noise("x"), 0.15 + 0.35 * F.floor(F.col("k") / 5) + 0.08 * noise("y")
    return rows.select("split", "style", "seed", F.format_string("symbol_%03d", F.col("k") + 1).alias("id"), "class_name", box(x, y, x + 0.1 + 0.02 * noise("w"), y + 0.1 + 0.04 * noise("h")).alias("bbox"))
