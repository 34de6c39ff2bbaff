"""DuckDB SQL of the registered queries, written from the rules and not from the plans."""

from __future__ import annotations

_TRUST = "greatest(0.01, least(1.0, floor(({} + 1000) / 11000 * 10000) / 10000))"
#: The trees of derived.net: customers with their way to the region.
_NET = f"""
ways AS (SELECT 'net:' || n_regionkey AS graph_id, 'C' || c_custkey AS feeder, 'R' || n_regionkey AS r, 'N' || n_nationkey AS n, 'RN' || n_nationkey AS e1, 'NC' || c_custkey AS e2,
         {_TRUST.format("c_acctbal")} AS c2, c_mktsegment = 'HOUSEHOLD' AS is_open, c_mktsegment = 'MACHINERY' AS unknown, c_nationkey % 3 = 0 AS high
         FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _net_paths(blocked: str, flags: str | None) -> str:
    flag = f", CASE WHEN {blocked} THEN 'PHYSICAL_TOPOLOGY_BREAK' {flags} ELSE '' END AS flags" if flags is not None else ""
    return f"""WITH {_NET}
SELECT graph_id, feeder, CASE WHEN NOT ({blocked}) THEN r END AS source, CASE WHEN {blocked} THEN '' ELSE r || '|' || n || '|' || feeder END AS path,
       CASE WHEN {blocked} THEN '' ELSE e1 || '|' || e2 END AS connections, CASE WHEN NOT ({blocked}) THEN n END AS bus,
       CASE WHEN {blocked} THEN NULL WHEN c2 < 1 THEN e2 ELSE e1 END AS weakest{flag},
       CASE WHEN {blocked} THEN 0.0 ELSE round(pow(c2, 0.5), 4) END AS confidence, NOT ({blocked}) AS active FROM ways"""


#: derived.net2: pairs (part, supplier), and every region's steps to every part, at distance 3 or 5.
_NET2 = """
sp AS (SELECT DISTINCT 'S' || l_suppkey AS s, 'P' || l_partkey AS p FROM lineitem),
up AS (SELECT 'S' || s_suppkey AS s, 'N' || n_nationkey AS n, 'R' || n_regionkey AS r, s_acctbal >= 5000 AS closed, s_acctbal < 2000 AS poor FROM supplier JOIN nation ON s_nationkey = n_nationkey),
near AS (SELECT sp.p, up.* FROM sp JOIN up USING (s)),
beside AS (SELECT DISTINCT a.s, u.r FROM sp a JOIN sp b ON a.p = b.p AND a.s <> b.s JOIN up u ON u.s = b.s),
far AS (SELECT DISTINCT sp.p, beside.r FROM sp JOIN beside USING (s)),
steps AS (SELECT p, r, min(d) AS d FROM (SELECT p, r, 3 AS d FROM near UNION ALL SELECT p, r, 5 FROM far) GROUP BY p, r)"""

_NUM = r"(\d+(?:\.\d+)?)"
_LABELS = """
labels8 AS (SELECT p_partkey * 8 + pos AS id, raw_text FROM (SELECT p_partkey, unnest(range(8)) AS pos, unnest([
  n || 'KV', ' ' || n || '.5 kv ', n || ' A', n || 'mva', 'FDR-' || n || 'KV-' || k, 'cb_O' || k, 'BUS-B' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE k END, 'note ' || n]) AS raw_text
  FROM (SELECT p_partkey, p_size::VARCHAR AS n, lpad((p_partkey % 100)::VARCHAR, 2, '0') AS k FROM part)))"""
_PARSED = rf"""{_LABELS},
shaped AS (SELECT id, raw_text, trim(raw_text) AS raw, regexp_replace(upper(raw_text), '[\s_]+', '', 'g') AS short FROM labels8),
cut AS (SELECT *, regexp_extract(short, '^([A-Z]+)-?([A-Z0-9]+(?:-?[A-Z0-9]+)*)$', 1) AS pre, regexp_extract(short, '^([A-Z]+)-?([A-Z0-9]+(?:-?[A-Z0-9]+)*)$', 2) AS suf FROM shaped),
kinds AS (SELECT *, CASE WHEN regexp_full_match(raw, '(?i)\s*{_NUM}\s*K\s*V\s*') THEN 'voltage' WHEN regexp_full_match(raw, '(?i)\s*{_NUM}\s*A\s*') THEN 'current_rating'
  WHEN regexp_full_match(raw, '(?i)\s*{_NUM}\s*[KM]\s*VA\s*') THEN 'power_rating' WHEN pre = 'FDR' THEN 'feeder_id' WHEN pre = 'BUS' THEN 'bus_id'
  WHEN pre IN ('TR', 'CB', 'DS', 'CT', 'PT', 'VT', 'GEN', 'GRID', 'BC') THEN 'equipment_id' WHEN upper(raw) IN ('OPEN', 'CLOSED', 'N/O', 'N/C') THEN 'switch_state' ELSE 'unknown' END AS kind FROM cut),
fixed AS (SELECT *, regexp_matches(suf, '[OILSB]') AS unsure, pre || '-' || CASE WHEN regexp_full_match(suf, '[OILSB0-9]+') THEN translate(suf, 'OILSB', '01158') ELSE suf END AS named,
  regexp_extract(raw, '{_NUM}', 1) AS num FROM kinds),
normal AS (SELECT *, CASE kind WHEN 'voltage' THEN num || ' kV' WHEN 'current_rating' THEN num || ' A' WHEN 'power_rating' THEN num || ' ' || upper(regexp_extract(raw, '(?i)([KM])\s*VA', 1)) || 'VA'
  WHEN 'feeder_id' THEN named WHEN 'bus_id' THEN named WHEN 'equipment_id' THEN named ELSE raw END AS normalized_text, kind IN ('feeder_id', 'bus_id', 'equipment_id') AS is_id FROM fixed)"""

_BOXES = """
raw AS (SELECT label AS grp, vec_id AS id, list_transform(embedding, lambda v: (v::DOUBLE + 1) / 2) AS e FROM embeddings),
boxes AS (SELECT grp, id, round(e[5], 6) AS confidence, least(e[1], e[2]) AS x1, least(e[3], e[4]) AS y1, greatest(e[1], e[2]) AS x2, greatest(e[3], e[4]) AS y2, e FROM raw)"""
_IOU = """(CASE WHEN ({a}.x2-{a}.x1)*({a}.y2-{a}.y1) + ({b}.x2-{b}.x1)*({b}.y2-{b}.y1) - greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1), 0)*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1), 0) = 0 THEN 0
 ELSE greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1), 0)*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1), 0)
 / (({a}.x2-{a}.x1)*({a}.y2-{a}.y1) + ({b}.x2-{b}.x1)*({b}.y2-{b}.y1) - greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1), 0)*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1), 0)) END)"""


def _greedy(group: str, alias: str, threshold: float, order: str) -> str:
    """A box stays unless a better kept one of its group overlaps it: a fold over ranks."""
    return f"""WITH RECURSIVE {_BOXES},
ranked AS (SELECT {group} AS g, id, x1, y1, x2, y2, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS k FROM boxes),
clash AS (SELECT a.g, a.k AS better, b.k FROM ranked a JOIN ranked b ON a.g = b.g AND a.k < b.k WHERE {_IOU.format(a="a", b="b")} >= {threshold}),
worse AS (SELECT g, k, list(better) AS bs FROM clash GROUP BY g, k),
fold(g, k, kept) AS (SELECT DISTINCT g, 0::BIGINT, []::BIGINT[] FROM ranked
  UNION ALL SELECT f.g, f.k + 1, CASE WHEN w.bs IS NOT NULL AND list_has_any(w.bs, f.kept) THEN f.kept ELSE list_append(f.kept, f.k + 1) END
  FROM fold f JOIN ranked r ON r.g = f.g AND r.k = f.k + 1 LEFT JOIN worse w ON w.g = r.g AND w.k = r.k),
done AS (SELECT g, unnest(arg_max(kept, k)) AS k FROM fold GROUP BY g)
SELECT r.g AS {alias}, r.id FROM done d JOIN ranked r USING (g, k)"""


_ORDERS = """
eq AS (SELECT 'C' || c_custkey AS id, c_custkey AS ord, substr(c_mktsegment, 1, 4) || c_nationkey AS label, ['feeder','circuit_breaker','disconnector','bus_coupler','power_transformer','load'][c_custkey % 6 + 1] AS type FROM customer),
co AS (SELECT 'O' || o_orderkey AS id, o_orderkey AS ord, 'C' || o_custkey AS a, CASE WHEN o_orderkey % 50 = 0 THEN 'nobody' WHEN o_orderkey % 77 = 0 THEN 'C' || o_custkey ELSE 'C' || (o_custkey + o_orderkey % 3 + 1) END AS b
       FROM orders),
ends AS (SELECT co.id, co.ord, l.id AS l, r.id AS r FROM co LEFT JOIN eq l ON l.id = co.a LEFT JOIN eq r ON r.id = co.b),
types AS (SELECT e.*, tl.type AS lt, tr.type AS rt FROM ends e JOIN eq tl ON tl.id = e.l JOIN eq tr ON tr.id = e.r),
adj AS (SELECT l AS node, r AS nbr FROM types WHERE l <> r UNION SELECT r, l FROM types WHERE l <> r),
deg AS (SELECT eq.*, count(DISTINCT nbr) AS degree FROM eq LEFT JOIN adj ON adj.node = eq.id GROUP BY ALL)"""


def _found(code: str, severity: str, kind: str, rest: str, prefix: str = _ORDERS, graph: str = "'orders'") -> str:
    return f"WITH {prefix} SELECT {graph} AS graph_id, '{code}' AS code, '{severity}' AS severity, '{kind}' AS target_type, {rest}"


_MINS = """
rr AS (SELECT DISTINCT a.r AS x, b.r AS y FROM near a JOIN near b USING (p)),
lab(x, y) AS (SELECT DISTINCT r, r FROM up UNION SELECT l.x, rr.y FROM lab l JOIN rr ON rr.x = l.y),
grp AS (SELECT x AS r, min(y) AS g FROM lab GROUP BY x)"""

_ACTIONS = """
acts AS (SELECT 'run:' || (user_id % 20) AS analysis_run_id, lpad(event_id::VARCHAR, 12, '0') AS id, 'u' || user_id AS target_id, ts, value,
  CASE event_type WHEN 'click' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'verify' END AS action FROM events WHERE event_type IN ('click', 'error', 'purchase')),
stat AS (SELECT *, CASE action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'verified' END AS status FROM acts)"""

SQL = {
    "feeder_paths": _net_paths("is_open", "WHEN unknown THEN 'UNKNOWN_SWITCH_ON_PATH'"),
    "feeder_paths_definite": _net_paths("is_open OR unknown", ""),
    "feeder_paths_physical": _net_paths("false", None),
    "ambiguous_feeders": f"""WITH {_NET2},
firsts AS (SELECT p, min([r, n, s, p]) AS path FROM near GROUP BY p),
ranked AS (SELECT p, d, row_number() OVER (PARTITION BY p ORDER BY d, r) AS k, min(d) OVER (PARTITION BY p) AS best FROM steps),
many AS (SELECT p, count(*) FILTER (k BETWEEN 2 AND 4 AND d <= best + 2) > 0 AS multiple FROM ranked GROUP BY p)
SELECT p AS feeder, path[1] AS source, array_to_string(path, '|') AS path, multiple, NOT closed AS unknown
FROM firsts JOIN many USING (p) JOIN up ON up.s = path[3]""",
    "what_if_switches": f"""WITH {_NET2}, v AS (SELECT unnest(['base', 'open', 'closed']) AS variant_id),
best AS (SELECT variant_id, p, min(r) AS r FROM near, v WHERE NOT (variant_id = 'open' AND poor) GROUP BY ALL)
SELECT v.variant_id, q.p AS feeder, b.r AS source, b.r IS NOT NULL AS active FROM v, (SELECT DISTINCT p FROM sp) q LEFT JOIN best b ON b.p = q.p AND b.variant_id = v.variant_id""",
    "scenario_diff": f"""WITH {_NET2}, n AS (SELECT count(DISTINCT p) AS a, count(DISTINCT p) FILTER (NOT poor) AS o FROM near)
SELECT 'net2' AS graph_id, a AS base, o AS opened, a AS closed, true AS monotone FROM n""",
    "source_candidates": """SELECT 'nation:' || n_nationkey AS graph_id, CASE WHEN n_nationkey % 2 = 1 THEN 'R' || n_regionkey || '@' || n_nationkey ELSE 'N' || n_nationkey END AS equipment_id,
CASE WHEN n_nationkey % 2 = 1 THEN 'grid' ELSE n_name END AS label, CASE WHEN n_nationkey % 2 = 1 THEN 'grid_incomer' ELSE 'transformer_secondary_source' END AS source_role,
CASE WHEN n_nationkey % 2 = 1 THEN 1.0::DOUBLE ELSE 0.82::DOUBLE END AS confidence FROM nation""",
    "resolution_counts": f"""WITH {_NET2}, ranked AS (SELECT p, d, row_number() OVER (PARTITION BY p ORDER BY d, r) AS k, min(d) OVER (PARTITION BY p) AS best FROM steps),
many AS (SELECT p, count(*) FILTER (k BETWEEN 2 AND 4 AND d <= best + 2) > 0 AS multiple FROM ranked GROUP BY p)
SELECT CASE WHEN multiple THEN 'ambiguous' ELSE 'resolved' END AS resolution, '33 kV' AS voltage, count(*) AS n FROM many GROUP BY 1""",
    "components": f"""WITH RECURSIVE {_NET2}, {_MINS},
nodes AS (SELECT r AS node, r FROM up UNION SELECT n, r FROM up UNION SELECT s, r FROM up UNION SELECT p, min(r) FROM near GROUP BY p
          UNION SELECT 'R' || n_regionkey, 'R' || n_regionkey FROM nation UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
named AS (SELECT node, coalesce(g, r) AS g FROM nodes LEFT JOIN grp USING (r))
SELECT node, min(node) OVER (PARTITION BY g) AS component FROM named""",
    "component_count": """SELECT 'net:' || n_regionkey AS graph_id, 1 + count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS components FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "bridges": """SELECT 'net:' || n_regionkey AS graph_id, 'N' || n_nationkey AS u, 'R' || n_regionkey AS v FROM nation
UNION ALL SELECT 'net:' || n_regionkey, 'C' || c_custkey, 'N' || n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'HOUSEHOLD'
UNION ALL SELECT 'net:' || n_regionkey, 'N' || n_nationkey, 'S' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "risk_ranking": f"""WITH lines AS (
  SELECT n_regionkey AS g, 'RN' || n_nationkey AS id, 1.0 AS c, true AS linked, k.f AS feeders, CASE WHEN k.f > 0 THEN k.f + 2 ELSE 0 END AS nodes FROM nation
    JOIN (SELECT n_nationkey AS nk, count(c_custkey) FILTER (c_mktsegment <> 'HOUSEHOLD') AS f FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) k ON nk = n_nationkey
  UNION ALL SELECT n_regionkey, 'NC' || c_custkey, {_TRUST.format("c_acctbal")}, c_mktsegment <> 'HOUSEHOLD', CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 1 ELSE 0 END, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 3 ELSE 0 END FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 'NS' || s_suppkey, {_TRUST.format("s_acctbal")}, true, 0, 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
sizes AS (SELECT n_regionkey AS g, 1 + count(DISTINCT n_nationkey) + (SELECT count(*) FROM customer JOIN nation m ON c_nationkey = m.n_nationkey WHERE m.n_regionkey = n.n_regionkey)
            + (SELECT count(*) FROM supplier JOIN nation m ON s_nationkey = m.n_nationkey WHERE m.n_regionkey = n.n_regionkey) AS nodes,
            (SELECT count(*) FROM customer JOIN nation m ON c_nationkey = m.n_nationkey WHERE m.n_regionkey = n.n_regionkey) AS feeders FROM nation n GROUP BY n_regionkey),
scored AS (SELECT l.*, round((1 - c) * (0.35 * l.feeders / greatest(1, s.feeders) + 0.2 * l.nodes / s.nodes + 0.2 * l.feeders / greatest(1, s.feeders) + CASE WHEN linked THEN 0.15 + 0.05 ELSE 0 END), 4) AS risk FROM lines l JOIN sizes s USING (g))
SELECT 'net:' || g AS graph_id, id AS connection_id, feeders::INTEGER AS feeders, nodes::INTEGER AS nodes, linked::INTEGER AS component_change, linked::INTEGER::DOUBLE AS bridge_importance, risk AS risk_score,
  CASE WHEN risk >= 0.36 THEN 'CRITICAL' WHEN risk >= 0.18 THEN 'HIGH' WHEN risk >= 0.06 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM scored""",
    "degree": f"WITH {_ORDERS} SELECT id AS node, degree FROM deg",
    "strongest_edge": """WITH c AS (SELECT l_linenumber AS page, l_orderkey || '-' || l_linenumber AS id, 'x' || l_suppkey AS a, 'x' || (l_partkey % 100) AS b, l_discount AS conf FROM lineitem),
r AS (SELECT page, id, row_number() OVER (PARTITION BY page, least(a, b), greatest(a, b) ORDER BY conf DESC, id)::INTEGER AS rank FROM c) SELECT * FROM r""",
    "text_normalize": f"""WITH {_PARSED} SELECT id, normalized_text, CASE WHEN is_id AND unsure THEN 0.62 WHEN is_id THEN 0.98 ELSE 1.0 END::DOUBLE AS confidence, is_id AND unsure AS requires_review,
CASE WHEN is_id THEN replace(kind, '_id', '') || ' syntax' || CASE WHEN unsure THEN '; ambiguous character candidate' ELSE '' END
     WHEN kind = 'voltage' THEN 'voltage format' WHEN kind = 'current_rating' THEN 'current format' WHEN kind = 'power_rating' THEN 'power format' ELSE 'raw text retained' END AS evidence FROM normal""",
    "text_classify": f"""WITH {_PARSED} SELECT id, kind AS text_type, CASE kind WHEN 'unknown' THEN 0.0 WHEN 'equipment_id' THEN 0.98 ELSE 0.99 END::DOUBLE AS confidence,
CASE kind WHEN 'voltage' THEN 'voltage parser' WHEN 'current_rating' THEN 'current parser' WHEN 'power_rating' THEN 'power parser' WHEN 'feeder_id' THEN 'feeder prefix' WHEN 'bus_id' THEN 'bus prefix'
  WHEN 'equipment_id' THEN 'equipment prefix' WHEN 'switch_state' THEN 'switch-state lexicon' ELSE 'no conservative semantic rule' END AS evidence FROM normal""",
    "text_summary": f"WITH {_PARSED} SELECT kind AS text_type, count(*) AS n, count(*) FILTER (is_id AND unsure) AS needs_review FROM normal GROUP BY ROLLUP (kind)",
    "voltage_extract": rf"""WITH {_LABELS}, r AS (SELECT id, raw_text || ' · 11 kV · 630 A 5 MVA' AS t FROM labels8)
SELECT id, regexp_extract(t, '(?i){_NUM}\s*kV', 1)::DOUBLE AS kv, trim(list_filter(string_split(t, '·'), lambda x: contains(lower(x), 'v'))[1]) AS part,
array_to_string(list_concat(list_concat(list_transform(regexp_extract_all(t, '(?i)(?:^|[^0-9/.])(\d+(?:\.\d+)?)\s*k\s*v', 1), lambda x: 'voltage=' || upper(x || ' kV')), list_transform(regexp_extract_all(t, '(?i){_NUM}\s*a\b', 1), lambda x: 'current_rating=' || upper(x || ' A'))),
  list_transform(list_zip(regexp_extract_all(t, '(?i){_NUM}\s*([km])\s*va', 1), regexp_extract_all(t, '(?i){_NUM}\s*([km])\s*va', 2)), lambda x: 'power_rating=' || upper(x[1] || ' ' || x[2] || 'VA'))), ';') AS parts FROM r""",
    "label_dup_groups": f"WITH {_ORDERS} SELECT upper(label) AS label, count(*) AS n, arg_min(id, ord) AS first_id FROM eq GROUP BY 1 HAVING count(*) > 1",
    "character_errors": f"""WITH {_PARSED} SELECT kind AS text_type, count(*) AS n, sum(levenshtein(upper(raw_text), upper(normalized_text)))::BIGINT AS errors, sum(length(normalized_text))::BIGINT AS chars,
round(sum(levenshtein(upper(raw_text), upper(normalized_text))) / sum(length(normalized_text)), 4) AS rate FROM normal GROUP BY 1""",
    "iou_pairs": f"WITH {_BOXES}, j AS (SELECT a.grp, a.id AS a, b.id AS b, {_IOU.format(a='a', b='b')} AS v FROM boxes a JOIN boxes b ON a.grp = b.grp AND a.id < b.id) SELECT grp, a, b, round(v, 6) AS iou FROM j WHERE v >= 0.45",
    "nms_kept": _greedy("grp", "grp", 0.45, "confidence DESC, id"),
    "nms_agnostic": _greedy("grp % 5", "page", 0.35, "confidence DESC, id"),
    "merge_regions": _greedy("grp", "grp", 0.3, "id"),
    "nearest_point_topk": f"""WITH {_BOXES}, c AS (SELECT grp, id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM boxes),
j AS (SELECT a.id AS left_id, b.id AS right_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS gap FROM c a JOIN c b ON a.grp = b.grp WHERE a.id % 2 = 0 AND b.id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY gap, right_id)::INTEGER AS rank FROM j WHERE gap <= 0.07) SELECT left_id, right_id, rank, round(gap, 9) AS gap FROM r WHERE rank <= 3""",
    "association_top1": f"""WITH {_BOXES}, c AS (SELECT grp, id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM boxes),
t AS (SELECT *, ['feeder_id','bus_id','voltage','current_rating','equipment_id'][(id // 2) % 5 + 1] AS tt FROM c WHERE id % 2 = 0),
e AS (SELECT *, ['feeder','busbar','power_transformer','circuit_breaker'][((id - 1) // 2) % 4 + 1] AS et FROM c WHERE id % 2 = 1),
s AS (SELECT t.id AS text_id, e.id AS entity_id, round(0.55 * (1 - least(1, sqrt((t.x - e.x) ** 2 + (t.y - e.y) ** 2) / 0.32)) + 0.2 * (1 - least(1, abs(t.y - e.y) / 0.2))
  + 0.25 * CASE WHEN CASE tt WHEN 'feeder_id' THEN 'feeder' WHEN 'bus_id' THEN 'busbar' WHEN 'voltage' THEN 'power_transformer' WHEN 'current_rating' THEN 'circuit_breaker' ELSE et END = et THEN 1 WHEN tt IN ('voltage', 'current_rating') THEN 0.45 ELSE 0 END, 4) AS score FROM t JOIN e USING (grp)),
b AS (SELECT text_id, entity_id, score, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, entity_id) AS k FROM s)
SELECT t.id AS text_id, CASE WHEN score >= 0.55 THEN entity_id END AS entity_id, CASE WHEN score >= 0.55 THEN score ELSE 0.0 END AS score FROM t LEFT JOIN b ON b.text_id = t.id AND k = 1""",
    "segment_intersections": f"""WITH {_BOXES}, s AS (SELECT grp, id, e[6] AS ax, e[7] AS ay, e[8] AS bx, e[9] AS by FROM boxes),
j AS (SELECT l.grp, l.id AS l_id, r.id AS r_id, l.ax x1, l.ay y1, l.bx x2, l.by y2, r.ax x3, r.ay y3, r.bx x4, r.by y4 FROM s l JOIN s r ON l.grp = r.grp AND l.id < r.id),
d AS (SELECT *, (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4) AS den FROM j),
p AS (SELECT *, ((x1 * y2 - y1 * x2) * (x3 - x4) - (x1 - x2) * (x3 * y4 - y3 * x4)) / den AS x, ((x1 * y2 - y1 * x2) * (y3 - y4) - (y1 - y2) * (x3 * y4 - y3 * x4)) / den AS y FROM d WHERE abs(den) >= 1e-9)
SELECT grp, l_id, r_id, round(x, 6) AS x, round(y, 6) AS y,
  (least(sqrt((x - x1) ** 2 + (y - y1) ** 2), sqrt((x - x2) ** 2 + (y - y2) ** 2)) < 0.006) <> (least(sqrt((x - x3) ** 2 + (y - y3) ** 2), sqrt((x - x4) ** 2 + (y - y4) ** 2)) < 0.006) AS tee
FROM p WHERE x BETWEEN least(x1, x2) - 0.003 AND greatest(x1, x2) + 0.003 AND y BETWEEN least(y1, y2) - 0.003 AND greatest(y1, y2) + 0.003
  AND x BETWEEN least(x3, x4) - 0.003 AND greatest(x3, x4) + 0.003 AND y BETWEEN least(y3, y4) - 0.003 AND greatest(y3, y4) + 0.003""",
    "segment_geometry": f"""WITH {_BOXES}, s AS (SELECT id, confidence, x1, y1, x2, y2, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py, e[6] AS ax, e[7] AS ay, e[8] AS cx, e[9] AS cy FROM boxes),
t AS (SELECT *, CASE WHEN (cx - ax) ** 2 + (cy - ay) ** 2 > 1e-12 THEN greatest(0, least(1, ((px - ax) * (cx - ax) + (py - ay) * (cy - ay)) / ((cx - ax) ** 2 + (cy - ay) ** 2))) ELSE 0 END AS f FROM s),
g AS (SELECT *, sqrt((px - ax - f * (cx - ax)) ** 2 + (py - ay - f * (cy - ay)) ** 2) AS gap, abs(degrees(atan2(cy - ay, cx - ax))) % 180 AS angle,
  greatest(0.018, least(0.07, (0.009 + 0.46 * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) * (1 + greatest(0, 0.82 - CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END) * 0.3))) AS radius FROM t),
q AS (SELECT *, greatest(0, 1 - gap / greatest(radius, 1e-6)) AS ep FROM g)
SELECT id, round(gap, 9) AS gap, round(angle, 6) AS angle, angle > 8 AND angle < 172 AND NOT (angle > 82 AND angle < 98) AS slanted, round(radius, 9) AS radius,
  round(0.28 * confidence + 0.24 * ep + 0.18 * 0.86 + 0.17 * (ep + 0.86) / 2 + 0.07 * 0.7 + 0.06 * 0.8, 6) AS score,
  x1 BETWEEN 0 AND 1 AND y1 BETWEEN 0 AND 1 AND x2 BETWEEN 0 AND 1 AND y2 BETWEEN 0 AND 1 AND x1 < x2 AND y1 < y2 AS valid FROM q""",
    "dataset_lines": f"""WITH {_BOXES} SELECT id, printf('%d %.6f %.6f %.6f %.6f', grp, (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1) AS yolo, round(x1 * 640, 6) AS x, round(y1 * 480, 6) AS y, round((x2 - x1) * 640, 6) AS w, round((y2 - y1) * 480, 6) AS h FROM boxes""",
    "tile_cover": """WITH p AS (SELECT p_partkey, p_size * 50 + 100 AS w, p_size * 37 + 100 AS h FROM part),
xs AS (SELECT p_partkey, unnest(list_sort(list_distinct(list_append(range(0, greatest(1, w - 799), 704), greatest(0, w - 800))))) AS x FROM p),
ys AS (SELECT p_partkey, unnest(list_sort(list_distinct(list_append(range(0, greatest(1, h - 799), 704), greatest(0, h - 800))))) AS y FROM p)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY y, x) - 1)::INTEGER AS pos, x::INTEGER AS x, y::INTEGER AS y FROM xs JOIN ys USING (p_partkey)""",
    "terminal_template": f"""WITH {_BOXES}, k AS (SELECT *, ['energy_source','feeder_terminal','power_transformer','circuit_breaker'][id % 4 + 1] AS c, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM boxes),
l AS (SELECT *, c = 'power_transformer' OR x2 - x1 >= 0.5 * (y2 - y1) AS flat FROM k),
t AS (SELECT id, 'ATTACH' AS name, CASE WHEN c = 'energy_source' THEN x2 ELSE x1 END AS x, my AS y, flat FROM l WHERE c IN ('energy_source', 'feeder_terminal')
  UNION ALL SELECT id, 'IN', CASE WHEN flat THEN x1 ELSE mx END, CASE WHEN flat THEN my ELSE y1 END, flat FROM l WHERE c NOT IN ('energy_source', 'feeder_terminal')
  UNION ALL SELECT id, 'OUT', CASE WHEN flat THEN x2 ELSE mx END, CASE WHEN flat THEN my ELSE y2 END, flat FROM l WHERE c NOT IN ('energy_source', 'feeder_terminal'))
SELECT 'terminal:' || id || ':' || lower(name) AS id, id::VARCHAR AS symbol_id, name, round(x, 9) AS x, round(y, 9) AS y, CASE WHEN flat THEN 0 ELSE 90 END AS orientation_deg FROM t""",
    "longest_run": """WITH e AS (SELECT user_id, event_id, event_type = 'view' AS seen, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY event_id) AS isle FROM events),
r AS (SELECT user_id, seen, isle, count(*) AS len FROM e GROUP BY ALL)
SELECT user_id, sum(len)::BIGINT AS n, coalesce(sum(len) FILTER (seen), 0)::BIGINT AS supported, coalesce(max(len) FILTER (seen), 0)::BIGINT AS longest FROM r GROUP BY user_id""",
    "latest_review_state": f"WITH {_ACTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY ts DESC, id DESC) AS k FROM stat) SELECT analysis_run_id, target_id, action, status, value::VARCHAR AS value FROM r WHERE k = 1",
    "audit_history": f"WITH {_ACTIONS} SELECT id, target_id, lag(status) OVER w AS prior_status, status AS new_status, row_number() OVER w::INTEGER AS step FROM stat WINDOW w AS (PARTITION BY target_id ORDER BY ts, id)",
    "recompute_changed": f"WITH {_ACTIONS} SELECT DISTINCT analysis_run_id FROM acts WHERE ts > TIMESTAMP '2024-01-15'",
    "review_connections": f"""WITH {_ACTIONS}, u AS (SELECT DISTINCT 'run:' || (user_id % 20) AS analysis_run_id, 'u' || user_id AS target_id FROM events),
r AS (SELECT target_id, status, row_number() OVER (PARTITION BY target_id ORDER BY ts DESC, id DESC) AS k FROM stat)
SELECT analysis_run_id, coalesce(status, 'unreviewed') AS review_status, count(*) AS n FROM u LEFT JOIN r ON r.target_id = u.target_id AND k = 1 GROUP BY ALL""",
    "precision_recall_f1": """WITH l AS (SELECT quality AS t, 1 - toxic AS p FROM labels), c AS (SELECT DISTINCT unnest([t, p])::VARCHAR AS class FROM l),
n AS (SELECT class, (SELECT count(*) FROM l WHERE t = p AND t::VARCHAR = class) AS tp, (SELECT count(*) FROM l WHERE p::VARCHAR = class) AS d, (SELECT count(*) FROM l WHERE t::VARCHAR = class) AS k FROM c),
a AS (SELECT * FROM n UNION ALL SELECT NULL, sum(tp), sum(d), sum(k) FROM n)
SELECT class, tp::BIGINT AS tp, (d - tp)::BIGINT AS fp, (k - tp)::BIGINT AS fn, round(CASE WHEN d = 0 THEN 0 ELSE tp / d END, 4) AS precision, round(CASE WHEN k = 0 THEN 0 ELSE tp / k END, 4) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (d + k) END, 4) AS f1 FROM a""",
    "set_ops_pairs": """WITH q AS (SELECT l_returnflag AS k, l_suppkey AS a, l_partkey % 50 AS b, l_quantity >= 25 AS t, l_discount >= 0.05 AS p FROM lineitem WHERE l_suppkey <> l_partkey % 50),
t AS (SELECT DISTINCT k, least(a, b) AS u, greatest(a, b) AS v FROM q WHERE t), p AS (SELECT DISTINCT k, least(a, b) AS u, greatest(a, b) AS v FROM q WHERE p),
n AS (SELECT k, (SELECT count(*) FROM (SELECT * FROM t WHERE t.k = x.k INTERSECT SELECT * FROM p)) AS tp, (SELECT count(*) FROM (SELECT * FROM p WHERE p.k = x.k EXCEPT SELECT * FROM t)) AS fp, (SELECT count(*) FROM (SELECT * FROM t WHERE t.k = x.k EXCEPT SELECT * FROM p)) AS fn
  FROM (SELECT DISTINCT k FROM q) x)
SELECT k AS l_returnflag, tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM n""",
    "multiset_overlap": "SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 INTERSECT ALL SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice > 100000",
    "pivot_confusion": "SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY quality",
    "reachability_accuracy": """WITH e AS (SELECT vec_id AS n, label AS t, vec_id % 7 AS p FROM embeddings), j AS (SELECT (a.t = b.t) = (a.p = b.p) AS same FROM e a JOIN e b ON a.n < b.n)
SELECT count(*) AS pairs, count(*) FILTER (same) AS agree, round(count(*) FILTER (same) / count(*), 4) AS accuracy FROM j""",
    "error_tags": """WITH n AS (SELECT p_partkey, p_partkey % 2 AS tp, p_partkey % 3 AS fp, p_partkey % 5 AS fn, p_partkey % 7 AS mapped FROM part),
t AS (SELECT *, array_to_string(list_filter([CASE WHEN fn > 0 THEN 'MISSED_CONDUCTOR' END, CASE WHEN fp > 0 THEN 'FALSE_CONDUCTOR' END, CASE WHEN mapped < 3 THEN 'TERMINAL_SNAP_ERROR' END], lambda x: x IS NOT NULL), '|') AS s FROM n)
SELECT p_partkey, CASE WHEN s = '' AND tp > 0 THEN 'NONE' ELSE s END AS tags FROM t""",
    "export_json": """SELECT 'net:' || r_regionkey AS graph_id, 'R' || r_regionkey AS id, r_name AS equipment_id, 'energy_source' AS type, '33 kV' AS rating, 0.2::DOUBLE AS x2 FROM region
UNION ALL SELECT 'net:' || n_regionkey, 'N' || n_nationkey, n_name, 'busbar', '33 kV', 0.2 FROM nation
UNION ALL SELECT 'net:' || n_regionkey, 'C' || c_custkey, c_name, 'feeder', CASE WHEN c_nationkey % 3 = 0 THEN '33 kV · 630 A' ELSE '11 kV · 630 A' END, 0.2 FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'net:' || n_regionkey, 'S' || s_suppkey, s_name, 'circuit_breaker', '11 kV', 0.2 FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "export_csv_rows": f"""SELECT 'net:' || n_regionkey AS graph_id, 'RN' || n_nationkey AS id, 1.0::DOUBLE AS confidence, '["geometry"]' AS provenance, NULL::VARCHAR AS switch_state FROM nation
UNION ALL SELECT 'net:' || n_regionkey, 'NC' || c_custkey, {_TRUST.format("c_acctbal")}, '["geometry"]', CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'open' WHEN 'MACHINERY' THEN 'unknown' END FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'net:' || n_regionkey, 'NS' || s_suppkey, {_TRUST.format("s_acctbal")}, '["geometry"]', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "corpus_plan": """WITH p AS (SELECT * FROM (VALUES ('train', 'abc', 100, 15), ('validation', 'abc', 300, 3), ('test', 'abc', 400, 3), ('style_holdout', 'd', 500, 12)) t(split, styles, first, n)),
s AS (SELECT split, first, n, unnest(range(length(styles))) AS k, styles FROM p)
SELECT split, 'style_' || substr(styles, k::INTEGER + 1, 1) AS style, unnest(range(first + 100 * k, first + 100 * k + n))::INTEGER AS seed FROM s""",
    "validate_duplicate_equipment_id": _found("DUPLICATE_EQUIPMENT_ID", "warning", "equipment", "arg_min(id, ord) AS target_id FROM eq GROUP BY upper(label) HAVING count(*) > 1"),
    "validate_unresolved_terminal": _found("UNRESOLVED_TERMINAL", "error", "connection", "id AS target_id FROM ends WHERE l IS NULL OR r IS NULL"),
    "validate_no_self_loop": _found("NO_SELF_LOOP", "error", "connection", "id AS target_id FROM ends WHERE l = r"),
    "validate_duplicate_parallel_edge": _found("DUPLICATE_PARALLEL_EDGE", "warning", "connection", "id AS target_id FROM (SELECT id, row_number() OVER (PARTITION BY least(l, r), greatest(l, r) ORDER BY ord) AS k FROM ends WHERE l IS NOT NULL AND r IS NOT NULL) WHERE k > 1"),
    "validate_disconnected_equipment": _found("DISCONNECTED_EQUIPMENT", "warning", "equipment", "id AS target_id FROM deg WHERE type = 'feeder' AND degree = 0"),
    "validate_breaker_terminal_sanity": _found("BREAKER_TERMINAL_SANITY", "warning", "equipment", "id AS target_id FROM deg WHERE type = 'circuit_breaker' AND degree NOT IN (0, 2)"),
    "validate_disconnector_terminal_sanity": _found("DISCONNECTOR_TERMINAL_SANITY", "warning", "equipment", "id AS target_id FROM deg WHERE type = 'disconnector' AND degree NOT IN (0, 2)"),
    "validate_bus_coupler_sanity": _found("BUS_COUPLER_SANITY", "warning", "equipment", "id AS target_id FROM deg WHERE type = 'bus_coupler' AND degree NOT IN (0, 2)"),
    "validate_transformer_terminal_sanity": _found("TRANSFORMER_TERMINAL_SANITY", "warning", "equipment", "id AS target_id FROM deg WHERE type = 'power_transformer' AND degree NOT IN (0, 2)"),
    "validate_feeder_without_upstream_path": _found("FEEDER_WITHOUT_UPSTREAM_PATH", "warning", "equipment", "feeder AS target_id FROM ways WHERE is_open", _NET, "graph_id"),
    "validate_unknown_switch_on_required_path": _found("UNKNOWN_SWITCH_ON_REQUIRED_PATH", "warning", "equipment", "feeder AS target_id FROM ways WHERE unknown", _NET, "graph_id"),
    "validate_voltage_transition_without_transformer": _found("VOLTAGE_TRANSITION_WITHOUT_TRANSFORMER", "warning", "equipment", "feeder AS target_id FROM ways WHERE NOT is_open AND NOT high", _NET, "graph_id"),
    "validate_feeder_multiple_unresolved_sources": f"""WITH {_NET2}, ranked AS (SELECT p, d, row_number() OVER (PARTITION BY p ORDER BY d, r) AS k, min(d) OVER (PARTITION BY p) AS best FROM steps)
SELECT DISTINCT 'net2' AS graph_id, 'FEEDER_MULTIPLE_UNRESOLVED_SOURCES' AS code, 'warning' AS severity, 'equipment' AS target_type, p AS target_id FROM ranked WHERE k BETWEEN 2 AND 4 AND d <= best + 2""",
}
SQL["terminal_snap"] = f"""WITH {_BOXES}, k AS (SELECT *, ['energy_source','feeder_terminal','power_transformer','circuit_breaker','busbar'][id % 5 + 1] AS c, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my,
  greatest(0.018, least(0.07, (0.009 + 0.46 * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) * (1 + greatest(0, 0.82 - CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END) * 0.3))) AS radius FROM boxes),
l AS (SELECT *, c = 'power_transformer' OR x2 - x1 >= 0.5 * (y2 - y1) AS flat FROM k),
t AS (SELECT grp, id, radius, 'attach' AS name, CASE WHEN c = 'energy_source' THEN x2 ELSE x1 END AS x, my AS y FROM l WHERE c IN ('energy_source', 'feeder_terminal')
  UNION ALL SELECT grp, id, radius, 'in', CASE WHEN flat THEN x1 ELSE mx END, CASE WHEN flat THEN my ELSE y1 END FROM l WHERE c NOT IN ('energy_source', 'feeder_terminal')
  UNION ALL SELECT grp, id, radius, 'out', CASE WHEN flat THEN x2 ELSE mx END, CASE WHEN flat THEN my ELSE y2 END FROM l WHERE c NOT IN ('energy_source', 'feeder_terminal')),
j AS (SELECT b.id AS k, 'terminal:' || lpad(t.id::VARCHAR, 6, '0') || ':' || name AS terminal_id, sqrt((b.e[6] - t.x) ** 2 + (b.e[7] - t.y) ** 2) AS gap, radius FROM boxes b JOIN t USING (grp)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, terminal_id) AS n FROM j WHERE gap <= radius)
SELECT 'c' || lpad(b.id::VARCHAR, 6, '0') AS key, terminal_id, round(gap, 9) AS gap FROM boxes b LEFT JOIN r ON r.k = b.id AND n = 1"""
SQL["svg_parts"] = f"""WITH {_NET} SELECT 'net:' || n_regionkey AS graph_id, count(DISTINCT n_nationkey) + coalesce(any_value(c), 0) + coalesce(any_value(s), 0) AS lines, 1 + count(DISTINCT n_nationkey) + coalesce(any_value(c), 0) + coalesce(any_value(s), 0) AS labels, coalesce(any_value(o), 0) AS open_lines
FROM nation n LEFT JOIN (SELECT graph_id, count(*) AS c, count(*) FILTER (is_open) AS o FROM ways GROUP BY 1) w ON w.graph_id = 'net:' || n_regionkey
LEFT JOIN (SELECT n_regionkey AS k, count(*) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) q ON q.k = n_regionkey GROUP BY n_regionkey"""
SQL["truth_manifest"] = f"""WITH {_NET} SELECT 'net:' || n_regionkey AS graph_id, 1::INTEGER AS sources, coalesce(any_value(c), 0)::INTEGER AS feeders, count(DISTINCT n_nationkey)::INTEGER AS busbars,
(count(DISTINCT n_nationkey) + coalesce(any_value(c), 0) + coalesce(any_value(s), 0))::INTEGER AS switch_states, coalesce(any_value(c), 0)::INTEGER AS paths
FROM nation n LEFT JOIN (SELECT graph_id, count(*) AS c FROM ways GROUP BY 1) w ON w.graph_id = 'net:' || n_regionkey
LEFT JOIN (SELECT n_regionkey AS k, count(*) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) q ON q.k = n_regionkey GROUP BY n_regionkey"""
SQL["symbol_scenes"] = f"""WITH plan AS ({SQL["corpus_plan"]}), c AS (SELECT unnest(['busbar', 'bus_coupler', 'circuit_breaker', 'current_transformer', 'disconnector', 'energy_source', 'feeder_terminal', 'load', 'potential_transformer', 'power_transformer']) AS class_name)
SELECT split, class_name, count(*) AS n FROM plan, c GROUP BY ALL"""
SQL["health"] = f"""WITH {_NET}, risks AS ({SQL["risk_ranking"]})
SELECT graph_id, 1::BIGINT AS sources, count(*) AS feeders, count(*) FILTER (NOT is_open) AS resolved_paths, count(*) FILTER (is_open) AS unresolved_feeders, 0::BIGINT AS validation_errors,
  (SELECT count(*) FROM risks r WHERE r.graph_id = w.graph_id) AS review_items, (SELECT count(*) FROM risks r WHERE r.graph_id = w.graph_id AND priority = 'CRITICAL') AS critical_issues,
  CASE WHEN (SELECT count(*) FROM risks r WHERE r.graph_id = w.graph_id AND priority = 'CRITICAL') > 0 THEN 'Critical' ELSE 'Review Needed' END AS status FROM ways w GROUP BY graph_id"""
