import itertools
import random

import pytest
from pyspark.sql import functions as F

from netsift.operators import graph, metrics
from netsift.operators.components import connected_components
from netsift.sources.fixtures import CANONICAL, SPECS, graphs, rows_of, tables_of


@pytest.fixture(scope="module")
def canonical(spark):
    return graph.Analysis(**graphs(spark, tuple(SPECS)))


def change(spark, name, **edit):
    """Graph tables of one fixture with rows edited: table=lambda rows: rows."""
    rows = rows_of(name)
    for t, f in edit.items():
        rows[t] = f(rows[t])
    return tables_of(spark, rows)


def paths(a):
    return {(r["graph_id"], r["feeder_equipment_id"]): r for r in a.paths.collect()}


def test_canonical_paths(canonical):
    p = paths(canonical)
    radial = p["fixture_radial_01", "feeder_01"]
    assert radial["equipment_path"] == ["source_grid", "transformer_01", "bus_a", "breaker_01", "ct_01", "feeder_01"]
    assert radial["connection_path"] == [f"edge_0{k}" for k in range(1, 6)]
    assert (radial["source_bus_equipment_id"], radial["switching_equipment_ids"], radial["uncertainty_flags"]) == ("bus_a", ["breaker_01"], ["UNKNOWN_SWITCH_ON_PATH"])
    left, right = p["fixture_sectionalized_bus_01", "feeder_left"], p["fixture_sectionalized_bus_01", "feeder_right"]
    assert left["uncertainty_flags"] == [] and left["connection_path"] == ["edge_01", "edge_02", "edge_05"]
    assert right["connection_path"] == ["edge_01", "edge_02", "edge_03", "edge_04", "edge_06"] and right["source_bus_equipment_id"] == "bus_right"
    assert p["fixture_bus_coupler_01", "feeder_a"]["uncertainty_flags"] == ["UNKNOWN_SWITCH_ON_PATH", "MULTIPLE_SOURCE_OR_PATH_CANDIDATES"]
    assert p["fixture_alternate_supply_01", "feeder_b"]["source_equipment_id"] == "source_b"
    diamond = p["ours_diamond", "f"]
    assert diamond["equipment_path"] == ["s", "b1", "f"] and diamond["confidence"] == 0.5


def test_canonical_structure(canonical):
    count = lambda df: {r["graph_id"]: r["count"] for r in df.groupBy("graph_id").count().collect()}
    assert {r["graph_id"]: r["components"] for r in graph.component_counts(canonical.labelled).collect()} == {"fixture_radial_01": 1, "fixture_dual_transformer_01": 2, "fixture_sectionalized_bus_01": 1, "fixture_bus_coupler_01": 1, "fixture_alternate_supply_01": 3, "fixture_ring_01": 1, "ours_diamond": 1}
    assert count(graph.bridges(canonical.edges, canonical.labelled)) == {"fixture_radial_01": 5, "fixture_dual_transformer_01": 8, "fixture_sectionalized_bus_01": 6, "fixture_bus_coupler_01": 10, "fixture_alternate_supply_01": 8, "fixture_ring_01": 5}
    assert count(canonical.findings) == {"fixture_radial_01": 1, "fixture_dual_transformer_01": 2, "fixture_sectionalized_bus_01": 1, "fixture_bus_coupler_01": 4, "fixture_alternate_supply_01": 2, "fixture_ring_01": 2}
    assert all(r["status"] == "Review Needed" for r in canonical.health.collect() if r["graph_id"] in CANONICAL)


def test_canonical_impact(canonical):
    def impact(r):
        f = r["risk_factors"]
        return round(0.35 * f["affected_feeder_fraction"] + 0.2 * f["affected_node_fraction"] + 0.2 * f["source_assignment_change"] + 0.15 * f["bridge_importance"] + 0.1 * f["component_change"], 4)

    got = {(r["graph_id"], r["connection_id"]): impact(r) for r in canonical.risks.collect()}
    for k in range(1, 6):
        assert got["fixture_radial_01", f"edge_0{k}"] == 0.95
    assert got["fixture_dual_transformer_01", "edge_03"] == 0.575
    assert [got["fixture_sectionalized_bus_01", f"edge_0{k}"] for k in range(1, 7)] == [0.95, 0.95, 0.6464, 0.6464, 0.5893, 0.6464]
    assert got["fixture_bus_coupler_01", "edge_01"] == 0.5659 and got["fixture_bus_coupler_01", "edge_bc_01"] == 0.2
    assert got["fixture_alternate_supply_01", "edge_bc_01"] == 0.0 and got["fixture_ring_01", "edge_02"] == 0.6083
    assert all(v == 0 for (g, _), v in got.items() if g == "ours_diamond")


def test_overrides(spark):
    t = graphs(spark, ("fixture_radial_01",))
    over = lambda s: spark.createDataFrame([("fixture_radial_01", "v", "breaker_01", s)], "graph_id string, variant_id string, equipment_id string, state string")
    opened = graph.Analysis(**t, overrides=over("open"), variant="v").paths.head()
    assert (opened["source_equipment_id"], opened["equipment_path"], opened["confidence"], opened["active"], opened["uncertainty_flags"]) == (None, [], 0.0, False, ["PHYSICAL_TOPOLOGY_BREAK"])
    closed = graph.Analysis(**t, overrides=over("closed"), variant="v")
    assert closed.paths.head()["uncertainty_flags"] == []
    definite = graph.Analysis(**t, policy="definite")
    assert definite.paths.head()["source_equipment_id"] is None
    both = graph.Analysis(**t, overrides=over("open"), variant="v")
    assert metrics.monotone(both.base_paths, both.paths, closed.paths).head()["monotone"]
    assert {r["connection_id"]: r["affected_feeders"] for r in both.risks.collect()}["edge_01"] == []  # lost either way


def test_parallel_and_weak_edges(spark):
    def edit(rows):
        rows = [(*r[:7], 0.72, *r[8:]) if r[2] == "edge_03" else r for r in rows]
        return [*rows, ("fixture_dual_transformer_01", 99, "harmless_parallel", "source_a_out", "transformer_a_in", [], None, 0.35, ["geometry"], "pending")]

    a = graph.Analysis(**change(spark, "fixture_dual_transformer_01", connections=edit))
    risks = [(r["connection_id"], r["risk_score"], r["priority"]) for r in a.risks.orderBy(F.desc("risk_score"), "connection_id").collect()]
    assert risks[0] == ("edge_03", 0.161, "MEDIUM") and ("harmless_parallel", 0.0975, "MEDIUM") in risks
    feeder = paths(a)["fixture_dual_transformer_01", "feeder_a"]
    assert (feeder["confidence"], feeder["weakest_connection_id"]) == (0.7085, "harmless_parallel")
    assert [r["target_id"] for r in a.findings.where("code = 'DUPLICATE_PARALLEL_EDGE'").collect()] == ["harmless_parallel"]


def test_critical_and_verified(spark):
    weak = lambda c, status: lambda rows: [(*r[:7], c, r[8], status) if r[2] == "edge_03" else r for r in rows]
    a = graph.Analysis(**change(spark, "fixture_radial_01", connections=weak(0.5, "pending")))
    top = a.risks.orderBy(F.desc("risk_score")).head()
    assert (top["connection_id"], top["risk_score"], top["priority"]) == ("edge_03", 0.475, "CRITICAL")
    assert a.health.head()["status"] == "Critical"
    b = graph.Analysis(**change(spark, "fixture_radial_01", connections=weak(0.2, "verified")))
    assert "edge_03" not in {r["connection_id"] for r in b.risks.collect()}


def test_fallback_and_destination(spark):
    cut = {"equipment": lambda r: [x for x in r if x[2] != "source_grid"], "terminals": lambda r: [x for x in r if x[3] != "source_grid"], "connections": lambda r: r[1:]}
    a = graph.Analysis(**change(spark, "fixture_radial_01", **cut))
    s = a.sources.head()
    assert (s["equipment_id"], s["source_role"], s["confidence"]) == ("transformer_01", "transformer_secondary_source", 0.82)
    load = {
        "equipment": lambda r: [*r, (*r[0][:1], 90, "load_01", "LOAD-01", "load", *r[0][5:])],
        "terminals": lambda r: [*r, ("fixture_radial_01", 90, "load_01_in", "load_01", "IN", 0.9, 0.5)],
        "connections": lambda r: [*r, ("fixture_radial_01", 90, "edge_load", "feeder_01_out", "load_01_in", [], None, 1.0, ["geometry"], "pending")],
    }
    assert graph.Analysis(**change(spark, "fixture_radial_01", **load)).paths.head()["destination_equipment_id"] == "load_01"


def brute_components(edges, nodes):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    """Components, bridges and source changes against recomputation without each edge."""
    rng = random.Random(seed)
    nodes = [f"n{k:02}" for k in range(16)]
    kinds = {n: ("energy_source" if k < 3 else "feeder" if k > 11 else "busbar") for k, n in enumerate(nodes)}
    pairs = [tuple(rng.sample(nodes, 2)) for _ in range(20)]
    rows = {
        "equipment": [("g", k, n, n, kinds[n], 1, None, {}, 1.0, [], "pending") for k, n in enumerate(nodes)],
        "terminals": [("g", k, f"t{n}", n, "A", 0.0, 0.0) for k, n in enumerate(nodes)],
        "connections": [("g", k, f"e{k:02}", f"t{a}", f"t{b}", [], None, 0.5, [], "pending") for k, (a, b) in enumerate(pairs)],
    }
    a = graph.Analysis(**tables_of(spark, rows))

    def sources(edges):
        near = {n: set() for n in nodes}
        for x, y in edges:
            near[x].add(y)
            near[y].add(x)
        out = {}
        for f in nodes[12:]:
            seen, level = {f}, {f}
            while level and not any(kinds[n] == "energy_source" for n in level):
                level = {m for n in level for m in near[n]} - seen
                seen |= level
            out[f] = min((n for n in level if kinds[n] == "energy_source"), default=None)
        return out

    want = sources(pairs)
    assert {r["feeder_equipment_id"]: r["source_equipment_id"] for r in a.paths.collect()} == want
    labels = brute_components(pairs, nodes)
    assert {r["node"]: r["component"] for r in a.labelled.collect()} == labels
    simple = {tuple(sorted(p)) for p in pairs}
    n_of = lambda edges: len(set(brute_components(edges, nodes).values()))
    cuts = {p for p in simple if n_of(simple - {p}) > n_of(simple)}
    assert {(r["u"], r["v"]) for r in graph.bridges(a.edges, a.labelled).collect()} == cuts
    for r in a.risks.collect():
        k = int(r["connection_id"][1:])
        rest = pairs[:k] + pairs[k + 1 :]
        without = sources(rest)
        assert r["affected_feeders"] == sorted(f for f in want if want[f] != without[f])
        assert r["component_change"] == n_of(rest) - n_of(pairs)
        assert r["bridge_importance"] == float(tuple(sorted(pairs[k])) in cuts)


def test_components_of_hub_chain_and_noise(spark):
    edges = [(0, k) for k in range(1, 200)] + [(1000 + k, 1001 + k) for k in range(120)] + [(5000, 5000), (7, 7)]
    rows = [(a, b) for a, b in edges] + [(None, 3), (4, None), (0, 5), (0, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {**{k: 0 for k in range(200)}, **{1000 + k: 1000 for k in range(121)}, 5000: 5000}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_order_of_edges_does_not_matter(spark):
    rows = rows_of("fixture_bus_coupler_01")
    shuffled = {t: sorted(r, key=lambda x: hash(x[2])) for t, r in rows.items()}
    a, b = (graph.Analysis(**tables_of(spark, r)) for r in (rows, shuffled))
    assert sorted(map(str, a.paths.collect())) == sorted(map(str, b.paths.collect()))


def test_reachability_without_pairs(spark):
    rng = random.Random(5)
    nodes = [(k, rng.randrange(4), rng.randrange(5)) for k in range(40)]
    df = spark.createDataFrame([("x", *n) for n in nodes], "g string, node int, t int, p int")
    got = metrics.reachability_agreement(df.select("g", "node", F.col("t").alias("component")), df.select("g", "node", F.col("p").alias("component")), ["g"]).head()
    agree = sum((a[1] == b[1]) == (a[2] == b[2]) for a, b in itertools.combinations(nodes, 2))
    assert (got["pairs"], got["agree"]) == (780, agree)
    assert not metrics.same_partition(df.select("g", "node", F.col("t").alias("component")), df.select("g", "node", F.col("p").alias("component")), ["g"]).head()["same"]


def test_nearest_supply(spark):
    """The lean traversal has feeder_paths' sources and paths, of all variants, however many share a mask."""
    t = graphs(spark, tuple(SPECS))
    sources = graph.found_sources(**t)
    assert sources.exceptAll(graph.Analysis(**t).sources).count() == 0
    switches = t["equipment"].where(F.col("type").isin(*graph.SWITCH_TYPES))
    names = ["base", *[f"v{k:02d}" for k in range(64)]]
    variants = t["equipment"].select("graph_id").distinct().crossJoin(spark.createDataFrame([(n,) for n in names], "variant_id string"))
    over = switches.select("graph_id", F.col("id").alias("equipment_id")).join(variants, "graph_id").where("variant_id in ('v03', 'v63') or variant_id = 'v01' and equipment_id like '%1'")
    over = over.withColumn("state", F.when(F.col("variant_id") == "v63", "closed").otherwise("open"))
    shown = ["graph_id", "variant_id", "feeder_equipment_id", "source_equipment_id", "equipment_path", "active"]
    of = lambda df, columns=shown: sorted(map(str, df.select(*columns).where("variant_id in ('base', 'v01', 'v03', 'v63')").collect()))
    edges = graph.operational_edges(**t, variants=variants, overrides=over)
    slow = graph.feeder_paths(t["equipment"], edges.where("variant_id in ('base', 'v01', 'v03', 'v63')"), sources, variants.where("variant_id in ('base', 'v01', 'v03', 'v63')")).cache()
    assert of(graph.nearest_supply(**t, sources=sources, variants=variants, overrides=over)) == of(slow)
    lean = [c for c in shown if c != "equipment_path"]
    assert of(graph.nearest_supply(**t, sources=sources, variants=variants, overrides=over, paths=False), lean) == of(slow, lean)
    for how in ({}, {"policy": "definite"}, {"ignore_switches": True}):
        assert of(graph.nearest_supply(**t, sources=sources, **how)) == of(graph.feeder_paths(t["equipment"], graph.operational_edges(**t, **how), sources))


def test_nearest_supply_of_links_as_they_are(spark, monkeypatch):
    """Repeated connections, several terminals an equipment and terminals of nothing change no answer; links are joined with nothing before the search."""
    t = graphs(spark, tuple(SPECS))
    sources = graph.found_sources(**t)
    lean = ["graph_id", "feeder_equipment_id", "source_equipment_id", "active"]
    of = lambda t, **how: sorted(map(str, graph.nearest_supply(**t, sources=sources, **how).select(*lean).collect()))
    more = t["terminals"].withColumn("id", F.concat("id", F.lit("'")))
    crossed = t["connections"].withColumn("to_terminal_id", F.concat("to_terminal_id", F.lit("'")))
    loose = t["connections"].withColumn("from_terminal_id", F.lit("nowhere"))
    untidy = {"equipment": t["equipment"], "terminals": t["terminals"].unionByName(more), "connections": t["connections"].unionByName(t["connections"]).unionByName(crossed).unionByName(loose)}
    plans, held = [], graph.packed
    monkeypatch.setattr(graph, "packed", lambda df: plans.append(df) or held(df))
    for how in ({"paths": False}, {"paths": True}):
        assert of(untidy, **how) == sorted(map(str, graph.feeder_paths(t["equipment"], graph.operational_edges(**t), sources).select(*lean).collect()))
    links = [df for df in plans if df.columns == ["graph_id", "u", "v"]]
    assert links and not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in links)
