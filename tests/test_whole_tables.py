"""Derived graphs hold every row of their tables: the queries against brute force over the whole tables."""

from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows(name, *columns):
    return list(zip(*(pq.read_table(f"{SF}/{name}.parquet", columns=[c])[c].to_pylist() for c in columns), strict=True))


def collected(spark, query, *columns):
    return sorted(tuple(r[c] for c in columns) for r in entry.queries()[query](spark, SF).collect())


@pytest.fixture(scope="module")
def orders():
    """(kinds of customers, [(order, one end, other end)] of all orders in order of keys)."""
    kinds = ("feeder", "circuit_breaker", "disconnector", "bus_coupler", "power_transformer", "load")
    kind = {f"C{k}": kinds[k % 6] for (k,) in rows("customer", "c_custkey")}
    joins = []
    for o, c in sorted(rows("orders", "o_orderkey", "o_custkey")):
        other = "nobody" if o % 50 == 0 else f"C{c}" if o % 77 == 0 else f"C{c + o % 3 + 1}"
        joins.append((f"O{o}", f"C{c}", other))
    return kind, joins


@pytest.fixture(scope="module")
def neighbours(orders):
    kind, joins = orders
    met = defaultdict(set)
    for _, a, b in joins:
        if a != b and a in kind and b in kind:
            met[a].add(b)
            met[b].add(a)
    return met


def test_degree_counts_every_order(spark, orders, neighbours):
    assert collected(spark, "degree", "node", "degree") == sorted((c, len(neighbours[c])) for c in orders[0])


def test_rules_see_every_order(spark, orders, neighbours):
    kind, joins = orders
    seen = Counter()
    parallel = []
    for o, a, b in joins:
        if a in kind and b in kind:
            seen[frozenset((a, b))] += 1
            if seen[frozenset((a, b))] > 1:
                parallel.append(o)
    odd = lambda k: [c for c in kind if kind[c] == k and len(neighbours[c]) not in (0, 2)]
    want = {
        "unresolved_terminal": [o for o, a, b in joins if a not in kind or b not in kind],
        "no_self_loop": [o for o, a, b in joins if a == b],
        "duplicate_parallel_edge": parallel,
        "disconnected_equipment": [c for c in kind if kind[c] == "feeder" and not neighbours[c]],
        "breaker_terminal_sanity": odd("circuit_breaker"),
        "disconnector_terminal_sanity": odd("disconnector"),
        "bus_coupler_sanity": odd("bus_coupler"),
        "transformer_terminal_sanity": odd("power_transformer"),
    }
    for rule, targets in want.items():
        assert collected(spark, f"validate_{rule}", "target_id") == sorted((t,) for t in targets), rule


@pytest.fixture(scope="module")
def cyclic():
    """(neighbours of every node of net2 over all pairs of lineitem, suppliers not known to be closed)."""
    nation = dict(rows("nation", "n_nationkey", "n_regionkey"))
    met = defaultdict(set)
    lines = [(f"R{r}", f"N{n}") for n, r in nation.items()]
    unknown = set()
    for s, n, balance in rows("supplier", "s_suppkey", "s_nationkey", "s_acctbal"):
        lines.append((f"N{n}", f"S{s}"))
        if balance < 5000:
            unknown.add(f"S{s}")
    lines += [(f"S{s}", f"P{p}") for s, p in set(rows("lineitem", "l_suppkey", "l_partkey"))]
    for a, b in lines:
        met[a].add(b)
        met[b].add(a)
    return met, unknown


def distances(met, start):
    far, edge = {start: 0}, [start]
    while edge:
        edge = [b for a in edge for b in met[a] if b not in far and not far.update({b: far[a] + 1})]
    return far


def test_components_hold_every_part_and_supplier(spark, cyclic):
    met, _ = cyclic
    assert collected(spark, "components", "node", "component") == sorted((n, min(distances(met, n))) for n in met)


def test_every_part_has_its_feeder_path(spark, cyclic):
    met, unknown = cyclic
    far = {r: distances(met, r) for r in met if r[0] == "R"}
    want = []
    for p in (n for n in met if n[0] == "P"):
        path = min((r, n, s, p) for s in met[p] for n in met[s] if n[0] == "N" for r in met[n] if r[0] == "R")
        ranked = sorted((d[p], r) for r, d in far.items() if p in d)[:4]
        want.append((p, path[0], "|".join(path), any(d <= ranked[0][0] + 2 for d, _ in ranked[1:]), path[2] in unknown))
    assert collected(spark, "ambiguous_feeders", "feeder", "source", "path", "multiple", "unknown") == sorted(want)


def test_strongest_edge_ranks_every_candidate(spark):
    pairs = defaultdict(list)
    for o, k, s, p, d in rows("lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount"):
        pairs[k, frozenset((s, p % 100))].append((-d, f"{o}-{k}"))
    want = [(k, i, n) for (k, _), found in pairs.items() for n, (_, i) in enumerate(sorted(found), 1)]
    assert collected(spark, "strongest_edge", "page", "id", "rank") == sorted(want)
