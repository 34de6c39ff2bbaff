"""Operational graphs: switch states, components, bridges, shortest paths and what follows from them.

Tables (see netsift.sources.schemas) hold any number of graphs, keyed by
graph_id; states under what-if variants are keyed by (graph_id, variant_id) too,
so a question over all graphs and variants is one job.  Traversals are
level-synchronous joins: a level's neighbours lie in the level before, the same
and the next one, so only two levels are held against new rows, and each level
is checkpointed.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions.text import first_kilovolts, voltage_part
from netsift.operators.components import connected_components
from netsift.plans.lineage import cut, packed

#: Kinds of equipment by role.
SWITCH_TYPES = ("circuit_breaker", "disconnector", "bus_coupler")
SOURCE_TYPES = ("energy_source", "grid_incomer", "generator")
STATES = ("open", "closed", "unknown")
BASE = "base"
SCOPE = ["graph_id", "variant_id"]
#: Variants that one mask holds; rows that are counted first and then broadcast.
LOT, FEW = 62, 100_000


def resolved(connections: DataFrame, terminals: DataFrame) -> DataFrame:
    """connections with left_id and right_id: the equipment at both ends, null where a terminal is unknown."""
    ends = terminals.select("graph_id", F.col("id").alias("__t"), F.col("equipment_id").alias("__e"))
    left = ends.select("graph_id", F.col("__t").alias("from_terminal_id"), F.col("__e").alias("left_id"))
    right = ends.select("graph_id", F.col("__t").alias("to_terminal_id"), F.col("__e").alias("right_id"))
    return connections.join(left, ["graph_id", "from_terminal_id"], "left").join(right, ["graph_id", "to_terminal_id"], "left")


def base_variant(equipment: DataFrame) -> DataFrame:
    return equipment.select("graph_id").distinct().withColumn("variant_id", F.lit(BASE))


def switch_states(equipment: DataFrame, variants: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(graph_id, variant_id, id, type, state) of all equipment; state is null for what is no switch.

    An override wins, then the equipment's own attribute; anything else is unknown.
    """
    said = F.lower(F.col("attributes")["switch_state"])
    nodes = equipment.select("graph_id", "id", "type", said.alias("said")).join(variants, "graph_id")
    if overrides is not None:
        nodes = nodes.join(overrides.select(*SCOPE, F.col("equipment_id").alias("id"), F.lower("state").alias("forced")), [*SCOPE, "id"], "left")
        said = F.coalesce("forced", "said")
    else:
        said = F.col("said")
    state = F.when(F.col("type").isin(*SWITCH_TYPES), F.when(said.isin(*STATES), said).otherwise("unknown"))
    return nodes.select(*SCOPE, "id", "type", state.alias("state"))


def operational_edges(equipment: DataFrame, terminals: DataFrame, connections: DataFrame, variants: DataFrame | None = None, overrides: DataFrame | None = None, policy: str = "possible", ignore_switches: bool = False) -> DataFrame:
    """(graph_id, variant_id, u, v, connection_id, confidence, unknown_switch, first_ord, parallel), u < v.

    An edge is admitted unless an end is unresolved, both ends are the same
    equipment, it or a switch at either end is open or, under the policy
    "definite", unknown.  Of parallel edges the last in order stands for the
    pair; parallel counts them.
    """
    if policy not in ("possible", "definite"):
        raise ValueError(f"unknown policy {policy}")
    variants = base_variant(equipment) if variants is None else variants
    states = switch_states(equipment, variants, overrides)
    side = lambda name: states.select(*SCOPE, F.col("id").alias(f"{name}_id"), F.col("state").alias(f"{name}_state"))
    edges = resolved(connections, terminals).where("left_id <> right_id").join(variants, "graph_id")
    edges = edges.join(side("left"), [*SCOPE, "left_id"]).join(side("right"), [*SCOPE, "right_id"])
    has = lambda state: F.coalesce(F.lower("switch_state") == state, F.lit(False)) | F.coalesce(F.col("left_state") == state, F.lit(False)) | F.coalesce(F.col("right_state") == state, F.lit(False))
    edges = edges.withColumn("unknown_switch", has("unknown"))
    if not ignore_switches:
        edges = edges.where(~has("open"))
        if policy == "definite":
            edges = edges.where(~F.col("unknown_switch"))
    pair = edges.select(*SCOPE, F.least("left_id", "right_id").alias("u"), F.greatest("left_id", "right_id").alias("v"), "ord", F.struct(F.col("id").alias("connection_id"), "confidence", "unknown_switch").alias("e"))
    return pair.groupBy(*SCOPE, "u", "v").agg(F.max_by("e", "ord").alias("e"), F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("parallel")).select(*SCOPE, "u", "v", "e.*", "first_ord", "parallel")


def adjacency(edges: DataFrame) -> DataFrame:
    """(graph_id, variant_id, node, nbr, first_ord), both ways."""
    there = edges.select(*SCOPE, F.col("u").alias("node"), F.col("v").alias("nbr"), "first_ord")
    return there.unionByName(edges.select(*SCOPE, F.col("v").alias("node"), F.col("u").alias("nbr"), "first_ord"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, variant_id, node, component) of every node; isolated nodes are their own component.

    nodes: (graph_id, variant_id, node).  A component's name is its smallest node.
    """
    key = lambda n: F.struct(F.col("graph_id"), F.col("variant_id"), F.col(n).alias("node"))
    found = connected_components(edges.select(key("u").alias("src"), key("v").alias("dst")))
    found = found.select("node.*", F.col("component.node").alias("component"))
    return nodes.join(found, [*SCOPE, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def component_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(*SCOPE).agg(F.count_distinct("component").alias("components"))


def shortest_paths(edges: DataFrame, starts: DataFrame, nearest: int | None = None, max_rounds: int = 100_000) -> DataFrame:
    """(graph_id, variant_id, source, node, path) of every node that a start reaches, itself included.

    starts: (graph_id, variant_id, source).  path runs from source to node; of the
    shortest ones it is the smallest in the order of its node ids.
    nearest: only so many sources of each node, nearest first, ties to the smaller
    one.  A source among the nearest of a node is among those of every node on its way
    there, so a search holds that many rows a node, however many sources there are.
    """
    if nearest is not None and (starts.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).head()["n"] or 0) <= nearest:
        nearest = None
    near = cut(adjacency(edges))
    key = [*SCOPE, "source", "node"]
    level = cut(starts.select(*SCOPE, "source", F.col("source").alias("node"), F.array("source").alias("path")).distinct())
    before, found = None, [level]
    reached = None if nearest is None else cut(level.groupBy(*SCOPE, "node").agg(F.count(F.lit(1)).alias("had")))
    for _ in range(max_rounds):
        step = level.join(near, [*SCOPE, "node"]).select(*SCOPE, "source", F.col("nbr").alias("node"), F.concat("path", F.array("nbr")).alias("path"))
        step = step.groupBy(*key).agg(F.min("path").alias("path"))
        known = level.select(*key) if before is None else level.select(*key).unionByName(before.select(*key))
        step = step.join(known, key, "left_anti")
        if reached is not None:
            turn = F.row_number().over(Window.partitionBy(*SCOPE, "node").orderBy("source"))
            step = step.withColumn("turn", turn).join(reached, [*SCOPE, "node"], "left").where(F.coalesce("had", F.lit(0)) + F.col("turn") <= nearest).drop("turn", "had")
        step = cut(step)
        if step.isEmpty():
            return reduce(DataFrame.unionByName, found)
        if reached is not None:
            more = step.groupBy(*SCOPE, "node").agg(F.count(F.lit(1)).alias("had"))
            reached = cut(reached.unionByName(more).groupBy(*SCOPE, "node").agg(F.sum("had").alias("had")))
        before, level = level, step
        found.append(step)
    raise RuntimeError("shortest_paths did not end")


def bridges(edges: DataFrame, labelled: DataFrame) -> DataFrame:
    """(graph_id, variant_id, u, v) of the pairs without which a component falls apart.

    A spanning tree comes from shortest paths from each component's first node.
    Every other pair gets a 64-bit hash; a tree pair is a bridge if the hashes of
    the other pairs with an end below it cancel out, that is, none leaves its
    subtree (two sets of hashes cancel by chance with odds of 2 ** -64).
    """
    roots = labelled.where("node = component").select(*SCOPE, F.col("node").alias("source"))
    tree = cut(shortest_paths(edges, roots).select(*SCOPE, "node", "path"))
    limbs = tree.where(F.size("path") > 1).select(*SCOPE, "node", F.element_at("path", -2).alias("parent"))
    limbs = limbs.select(*SCOPE, "node", F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))
    chords = edges.join(limbs, [*SCOPE, "u", "v"], "left_anti").withColumn("mark", F.xxhash64(*SCOPE, "u", "v"))
    ends = chords.select(*SCOPE, F.col("u").alias("node"), "mark").unionByName(chords.select(*SCOPE, F.col("v").alias("node"), "mark"))
    ends = ends.groupBy(*SCOPE, "node").agg(F.bit_xor("mark").alias("mark"))
    below = ends.join(tree, [*SCOPE, "node"]).select(*SCOPE, F.explode("path").alias("node"), "mark").groupBy(*SCOPE, "node").agg(F.bit_xor("mark").alias("mark"))
    return limbs.join(below.where("mark <> 0"), [*SCOPE, "node"], "left_anti").select(*SCOPE, "u", "v")


def source_candidates(equipment: DataFrame, labelled: DataFrame) -> DataFrame:
    """(graph_id, equipment_id, label, source_role, confidence): explicit sources, and transformers of components without one.

    labelled: components of the base variant.
    """
    place = labelled.select("graph_id", F.col("node").alias("id"), "component")
    explicit = equipment.where(F.col("type").isin(*SOURCE_TYPES))
    fed = explicit.join(place, ["graph_id", "id"]).select("graph_id", "component").distinct()
    spare = equipment.where("type = 'power_transformer'").join(place, ["graph_id", "id"]).join(fed, ["graph_id", "component"], "left_anti")
    row = lambda role, conf: ["graph_id", F.col("id").alias("equipment_id"), F.col("equipment_id").alias("label"), role.alias("source_role"), F.round(conf, 4).alias("confidence")]
    return explicit.select(*row(F.col("type"), F.col("confidence"))).unionByName(spare.select(*row(F.lit("transformer_secondary_source"), F.col("confidence") * 0.82)))


def feeder_paths(equipment: DataFrame, edges: DataFrame, sources: DataFrame, variants: DataFrame | None = None, max_alternates: int = 3) -> DataFrame:
    """One row a feeder and variant: the path from its nearest source, ties to the smaller source id.

    Further sources among the next max_alternates at most two steps farther raise
    MULTIPLE_SOURCE_OR_PATH_CANDIDATES; an unknown switch on the path raises
    UNKNOWN_SWITCH_ON_PATH; a feeder without any path stays, with
    PHYSICAL_TOPOLOGY_BREAK.  confidence is the geometric mean of the path's.
    """
    variants = base_variant(equipment) if variants is None else variants
    feeders = equipment.where("type = 'feeder'").select("graph_id", F.col("id").alias("feeder")).join(variants, "graph_id")
    reached = shortest_paths(edges, sources.select("graph_id", F.col("equipment_id").alias("source")).join(variants, "graph_id"), 1 + max_alternates)
    ends = reached.join(feeders.withColumnRenamed("feeder", "node"), [*SCOPE, "node"]).withColumnRenamed("node", "feeder")
    order = Window.partitionBy(*SCOPE, "feeder").orderBy(F.size("path"), "source")
    ranked = ends.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 1 + max_alternates)
    best = ranked.groupBy(*SCOPE, "feeder").agg(F.min_by("source", "rank").alias("source"), F.min_by("path", "rank").alias("path"), F.sort_array(F.collect_list(F.size("path"))).alias("lengths"))
    best = cut(best.select(*SCOPE, "feeder", "source", "path", F.exists(F.slice("lengths", 2, max_alternates), lambda n: n <= F.element_at(F.col("lengths"), 1) + 2).alias("multiple")))

    steps = best.select(*SCOPE, "feeder", F.posexplode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("a"), F.expr("slice(path, 2, size(path))").alias("b"))).alias("pos", "s"))
    steps = steps.select(*SCOPE, "feeder", "pos", F.least("s.a", "s.b").alias("u"), F.greatest("s.a", "s.b").alias("v")).join(edges, [*SCOPE, "u", "v"])
    weakest = F.min_by(F.struct("connection_id", "confidence"), F.struct("confidence", "pos"))
    lines = steps.groupBy(*SCOPE, "feeder").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "connection_id"))), lambda x: x["connection_id"]).alias("connection_path"),
        F.round(F.pow(F.product("confidence"), 1 / F.count(F.lit(1))), 4).alias("confidence"),
        weakest.alias("weakest"), F.max("unknown_switch").alias("unknown"),
    )
    kinds = equipment.select("graph_id", F.col("id").alias("node"), "type")
    stops = best.select(*SCOPE, "feeder", F.posexplode("path").alias("pos", "node")).join(kinds, ["graph_id", "node"])
    stops = stops.groupBy(*SCOPE, "feeder").agg(
        F.max_by("node", F.when((F.col("type") == "busbar"), F.col("pos"))).alias("bus"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("type").isin(*SWITCH_TYPES), F.struct("pos", "node")))), lambda x: x["node"]).alias("switching"),
    )
    origin = sources.select("graph_id", F.col("equipment_id").alias("nbr"))
    ends_at = kinds.where("type in ('load', 'offpage_connector')").select("graph_id", F.col("node").alias("nbr")).join(origin, ["graph_id", "nbr"], "left_anti")
    beside = adjacency(edges).join(ends_at, ["graph_id", "nbr"]).groupBy(*SCOPE, F.col("node").alias("feeder")).agg(F.min_by("nbr", "first_ord").alias("destination"))

    key = [*SCOPE, "feeder"]
    all_of = feeders.join(best, key, "left").join(lines, key, "left").join(stops, key, "left").join(beside, key, "left")
    found = F.col("source").isNotNull()
    flags = F.array_compact(F.array(F.when(~found, F.lit("PHYSICAL_TOPOLOGY_BREAK")), F.when(F.col("unknown"), F.lit("UNKNOWN_SWITCH_ON_PATH")), F.when(F.col("multiple"), F.lit("MULTIPLE_SOURCE_OR_PATH_CANDIDATES"))))
    none = F.array().cast("array<string>")
    return all_of.select(
        *SCOPE, F.col("feeder").alias("feeder_equipment_id"), F.col("source").alias("source_equipment_id"),
        F.coalesce("path", none).alias("equipment_path"), F.coalesce("connection_path", none).alias("connection_path"),
        F.col("bus").alias("source_bus_equipment_id"), F.when(found, F.col("destination")).alias("destination_equipment_id"), F.coalesce("switching", none).alias("switching_equipment_ids"),
        F.col("weakest.connection_id").alias("weakest_connection_id"), F.round("weakest.confidence", 4).alias("weakest_connection_confidence"),
        flags.alias("uncertainty_flags"), F.when(found, F.coalesce("confidence", F.lit(1.0))).otherwise(0.0).alias("confidence"), found.alias("active"),
    )


def found_sources(equipment: DataFrame, terminals: DataFrame, connections: DataFrame) -> DataFrame:
    """source_candidates of tables.  Only a transformer's rank depends on components, so only graphs that hold one are taken apart."""
    holding = cut(equipment.where("type = 'power_transformer'").select("graph_id").distinct())
    if holding.isEmpty():
        none = equipment.select("graph_id", F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
        return source_candidates(equipment.where(F.col("type").isin(*SOURCE_TYPES)), none)
    some = {k: v.join(holding, "graph_id", "left_semi") for k, v in (("equipment", equipment), ("terminals", terminals), ("connections", connections))}
    nodes = some["equipment"].select("graph_id", F.lit(BASE).alias("variant_id"), F.col("id").alias("node"))
    return source_candidates(equipment, cut(components(cut(operational_edges(**some)), nodes)))


def _few(df: DataFrame, n: int) -> DataFrame:
    """df of n rows as a side of a join: what a plan guesses of its size counts for nothing."""
    return F.broadcast(df) if n <= FEW else df.hint("merge")


def nearest_supply(equipment: DataFrame, terminals: DataFrame, connections: DataFrame, sources: DataFrame, variants: DataFrame | None = None, overrides: DataFrame | None = None, policy: str = "possible", ignore_switches: bool = False, paths: bool = True, max_rounds: int = 100_000) -> DataFrame:
    """(feeder_equipment_id, source_equipment_id, active, and equipment_path with paths) a feeder and variant, as feeder_paths has them.

    For questions that need no more.  A switch that is open in a variant is a node
    that this variant does not enter, so all variants share one table of links,
    and a row stands for all variants that it holds in, as bits of a mask.  Links
    stay as the connections have them, from terminal to terminal: a level is taken
    to its terminals, and what they meet back to equipment.  A node keeps its
    nearest source only, of ties the smaller: what precedes a node on the way to
    that source has the same one.  With paths the smallest path stands for its source.
    """
    if policy not in ("possible", "definite"):
        raise ValueError(f"unknown policy {policy}")
    barred = [] if ignore_switches else ["open", "unknown"] if policy == "definite" else ["open"]
    if variants is None:
        bits = n = None
        every = lambda df: df.withColumn("lot", F.lit(0)).withColumn("mask", F.lit(1).cast("long"))
    else:
        nth = F.row_number().over(Window.partitionBy("graph_id").orderBy("variant_id")) - 1
        bits = variants.select(*SCOPE).distinct().withColumn("nth", nth)
        bits = cut(bits.select(*SCOPE, F.floor(F.col("nth") / LOT).cast("int").alias("lot"), F.expr(f"shiftleft(1L, nth % {LOT})").alias("mask")))
        n = bits.count()
        every = lambda df: df.join(_few(bits.groupBy("graph_id", "lot").agg(F.bit_or("mask").alias("mask")), n), "graph_id")
    place = ["graph_id", "lot", "node"]

    none = F.lit(0).cast("long")
    wanted = every(equipment.select("graph_id", F.col("id").alias("node"))).select(*place, F.col("mask").alias("wants"), none.alias("shut"))
    if barred:
        switches = equipment.where(F.col("type").isin(*SWITCH_TYPES))
        if variants is None:
            shut = every(switch_states(switches, base_variant(switches).hint("merge"), overrides).where(F.col("state").isin(*barred)))
        else:
            shut = switch_states(switches, _few(variants.select(*SCOPE).distinct(), n), overrides).where(F.col("state").isin(*barred)).join(_few(bits, n), SCOPE)
        wanted = wanted.unionByName(shut.select("graph_id", "lot", F.col("id").alias("node"), none.alias("wants"), F.col("mask").alias("shut")))
    wanted = wanted.groupBy(*place).agg(F.expr("bit_or(wants) & ~bit_or(shut)").alias("wants"))
    lines = connections if not barred else connections.where(~F.coalesce(F.lower("switch_state").isin(*barred), F.lit(False)))
    links = lines.select("graph_id", F.col("from_terminal_id").alias("u"), F.col("to_terminal_id").alias("v")).where("u <> v")
    ends = terminals.select("graph_id", F.col("id").alias("t"), F.col("equipment_id").alias("node"))
    starts = cut(sources.select("graph_id", F.col("equipment_id").alias("node")).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("graph_id").orderBy("node"))))
    # without paths a source is its place among its graph's: of rows with the same mask the smallest is enough
    by, same, least = ("node", "by", F.bit_or("mask").alias("mask")) if paths else ("nth", "mask", F.min("by").alias("by"))
    found = []
    with packed(wanted) as wanted, packed(ends) as ends, packed(links) as links:
        level = every(starts).join(wanted.hint("merge"), place)
        level = cut(level.withColumn("mask", F.expr("mask & wants")).where("mask <> 0").select(*place, (F.array(by) if paths else F.col(by)).alias("by"), "mask"))
        left = wanted.where("wants <> 0").join(ends.hint("merge"), ["graph_id", "node"])
        for _ in range(max_rounds):
            n_level = level.count()
            if not n_level:
                break
            found.append(level)
            had = level.groupBy(*place).agg(F.bit_or("mask").alias("had"))
            left = cut(left.join(had.hint("merge"), place, "left").select(*place, "t", F.expr("wants & ~coalesce(had, 0L)").alias("wants")).where("wants <> 0"))
            if left.isEmpty():
                break
            front = cut(ends.join(_few(level, n_level), ["graph_id", "node"]).select("graph_id", "lot", "t", "by", "mask"))
            span = front.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n")).head()
            # the join asks for no more than the span, which Parquet's statistics can tell before it
            way = lambda a, b: links.where(F.col(a).between(span["lo"], span["hi"])).select("graph_id", F.col(a).alias("t"), F.col(b).alias("to"))  # noqa: B023, E731
            step = way("u", "v").unionByName(way("v", "u")).join(_few(front, span["n"]), ["graph_id", "t"])
            step = step.groupBy("graph_id", "lot", F.col("to").alias("t"), same).agg(least).join(left.hint("merge"), ["graph_id", "lot", "t"])
            step = step.select(*place, (F.concat("by", F.array("node")) if paths else F.col("by")).alias("by"), F.expr("mask & wants").alias("mask")).where("mask <> 0")
            better = F.bit_or("mask").over(Window.partitionBy(*place).orderBy("by").rowsBetween(Window.unboundedPreceding, -1))
            step = step.withColumn("better", better).select(*place, "by", F.expr("mask & ~coalesce(better, 0L)").alias("mask")).where("mask <> 0")
            level = cut(step)
        else:
            raise RuntimeError("nearest_supply did not end")
    if not found:
        found.append(level)

    reached = reduce(DataFrame.unionByName, found)
    feeders = equipment.where("type = 'feeder'").select("graph_id", F.col("id").alias("node"))
    hits = reached.groupBy("graph_id", "node").agg(F.collect_list(F.struct("lot", "mask", "by")).alias("hits"))
    rows = feeders.join(hits.hint("merge"), ["graph_id", "node"], "left")
    if variants is None:
        rows = rows.withColumn("variant_id", F.lit(BASE)).withColumn("by", F.get("hits.by", F.lit(0)))
    else:
        each = variants.select(*SCOPE).join(_few(bits.withColumnRenamed("mask", "bit"), n), SCOPE)
        rows = rows.join(_few(each, n), "graph_id")
        rows = rows.withColumn("by", F.expr("get(filter(hits, h -> h.lot = lot and h.mask & bit <> 0), 0).by"))
    if not paths:
        named = starts.select("graph_id", F.col("nth").alias("by"), F.col("node").alias("source"))
        rows = rows.join(_few(named, starts.count()), ["graph_id", "by"], "left")
    source = F.get("by", F.lit(0)) if paths else F.col("source")
    more = [F.coalesce("by", F.array().cast("array<string>")).alias("equipment_path")] if paths else []
    return rows.select(*SCOPE, F.col("node").alias("feeder_equipment_id"), source.alias("source_equipment_id"), *more, F.col("by").isNotNull().alias("active"))


def resolution_of(source: Column, flags: Column) -> Column:
    return F.when(source.isNull(), "unresolved").when(F.array_contains(flags, "MULTIPLE_SOURCE_OR_PATH_CANDIDATES"), "ambiguous").otherwise("resolved")


def feeder_records(equipment: DataFrame, paths: DataFrame) -> DataFrame:
    """One row a feeder and variant with its label, voltage, rating and resolution."""
    rating = F.nullif(F.col("attributes")["rating"], F.lit(""))
    named = equipment.select("graph_id", F.col("id").alias("feeder_equipment_id"), F.col("equipment_id").alias("feeder_id"), rating.alias("rating"))
    return paths.join(named, ["graph_id", "feeder_equipment_id"]).select(
        *SCOPE, F.col("feeder_equipment_id").alias("equipment_id"), "feeder_id", "source_bus_equipment_id", "destination_equipment_id", voltage_part(F.col("rating")).alias("voltage"), "rating",
        resolution_of(F.col("source_equipment_id"), F.col("uncertainty_flags")).alias("resolution"), "confidence",
    )


def _finding(df: DataFrame, code, severity: str, message: Column, target_type: str, target: Column) -> DataFrame:
    code = code if isinstance(code, Column) else F.lit(code)
    return df.select("graph_id", code.alias("code"), F.lit(severity).alias("severity"), message.alias("message"), F.lit(target_type).alias("target_type"), target.alias("target_id"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, variant_id, node, degree): neighbours of every node, none included."""
    counted = adjacency(edges).groupBy(*SCOPE, "node").agg(F.count_distinct("nbr").alias("degree"))
    return nodes.join(counted, [*SCOPE, "node"], "left").fillna(0, ["degree"])


def validate(equipment: DataFrame, terminals: DataFrame, connections: DataFrame, edges: DataFrame, paths: DataFrame, junctions: DataFrame | None = None) -> DataFrame:
    """(graph_id, code, severity, message, target_type, target_id): one row a finding, each rule a DataFrame.

    edges and paths are those of the base variant.  junctions: (graph_id, id, kind).
    """
    say = lambda text, *cols: F.format_string(text, *cols)
    label = F.upper("equipment_id")
    twins = equipment.where("equipment_id <> ''").groupBy("graph_id", label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "ord").alias("first")).where("n > 1")
    found = [_finding(twins, "DUPLICATE_EQUIPMENT_ID", "warning", say("Equipment ID %s occurs %d times", "label", "n"), "equipment", F.col("first"))]

    lines = cut(resolved(connections, terminals).select("graph_id", "ord", "id", "left_id", "right_id"))
    lost = F.col("left_id").isNull() | F.col("right_id").isNull()
    found.append(_finding(lines.where(lost), "UNRESOLVED_TERMINAL", "error", say("Connection %s references an unresolved terminal", "id"), "connection", F.col("id")))
    whole = lines.where(~lost)
    found.append(_finding(whole.where("left_id = right_id"), "NO_SELF_LOOP", "error", say("Connection %s creates an equipment self loop", "id"), "connection", F.col("id")))
    nth = F.row_number().over(Window.partitionBy("graph_id", F.least("left_id", "right_id"), F.greatest("left_id", "right_id")).orderBy("ord"))
    again = whole.withColumn("nth", nth).where("nth > 1")
    found.append(_finding(again, "DUPLICATE_PARALLEL_EDGE", "warning", say("Duplicate physical connection between %s and %s", "left_id", "right_id"), "connection", F.col("id")))

    nodes = equipment.select("graph_id", F.lit(BASE).alias("variant_id"), F.col("id").alias("node"))
    seen = equipment.join(degrees(edges, nodes).select("graph_id", F.col("node").alias("id"), "degree"), ["graph_id", "id"])
    found.append(_finding(seen.where("type = 'feeder' and degree = 0"), "DISCONNECTED_EQUIPMENT", "warning", say("Feeder %s is disconnected", "equipment_id"), "equipment", F.col("id")))
    odd = seen.where("degree not in (0, 2)")
    code = F.when(F.col("type") == "bus_coupler", "BUS_COUPLER_SANITY").when(F.col("type") == "circuit_breaker", "BREAKER_TERMINAL_SANITY").otherwise("DISCONNECTOR_TERMINAL_SANITY")
    found.append(_finding(odd.where(F.col("type").isin(*SWITCH_TYPES)), code, "warning", say("%s has %d attachments; a simple device has two", "equipment_id", "degree"), "equipment", F.col("id")))
    found.append(_finding(odd.where("type = 'power_transformer'"), "TRANSFORMER_TERMINAL_SANITY", "warning", say("%s has %d attachments", "equipment_id", "degree"), "equipment", F.col("id")))

    named = paths.join(equipment.select("graph_id", F.col("id").alias("feeder_equipment_id"), F.col("equipment_id").alias("label")), ["graph_id", "feeder_equipment_id"])
    feeder = F.col("feeder_equipment_id")
    has = lambda flag: F.array_contains("uncertainty_flags", flag)
    found.append(_finding(named.where("source_equipment_id is null"), "FEEDER_WITHOUT_UPSTREAM_PATH", "warning", say("Feeder %s has no path from a source", "label"), "equipment", feeder))
    found.append(_finding(named.where(has("MULTIPLE_SOURCE_OR_PATH_CANDIDATES")), "FEEDER_MULTIPLE_UNRESOLVED_SOURCES", "warning", say("Feeder %s has several candidate sources or routes", "label"), "equipment", feeder))
    found.append(_finding(named.where(has("UNKNOWN_SWITCH_ON_PATH")), "UNKNOWN_SWITCH_ON_REQUIRED_PATH", "warning", say("Feeder %s depends on an unknown switch state", "label"), "equipment", feeder))
    ratings = equipment.select("graph_id", F.col("id").alias("node"), "type", first_kilovolts(F.col("attributes")["rating"]).alias("kv"))
    levels = named.select("graph_id", "feeder_equipment_id", "label", F.explode("equipment_path").alias("node")).join(ratings, ["graph_id", "node"])
    levels = levels.groupBy("graph_id", "feeder_equipment_id", "label").agg(F.count_distinct("kv").alias("n"), F.max(F.col("type") == "power_transformer").alias("transformed")).where("n > 1 and not transformed")
    found.append(_finding(levels, "VOLTAGE_TRANSITION_WITHOUT_TRANSFORMER", "warning", say("Feeder %s's path has several voltages and no transformer", "label"), "equipment", feeder))
    if junctions is not None:
        found.append(_finding(junctions.where("kind = 'ambiguous_crossing'"), "AMBIGUOUS_CROSSING", "warning", say("Crossing %s is not decided", "id"), "junction", F.col("id")))
    return reduce(DataFrame.unionByName, found)


def risk(uncertainty: Column, feeder_share: Column, node_share: Column, bridge: Column, component_change: Column) -> Column:
    """What an uncertain connection puts at stake."""
    split = F.least(F.lit(1.0), F.greatest(F.lit(0), component_change) / 2)
    return F.round(uncertainty * (0.35 * feeder_share + 0.2 * node_share + 0.2 * feeder_share + 0.15 * bridge + 0.1 * split), 4)


def priority(score: Column) -> Column:
    return F.when(score >= 0.36, "CRITICAL").when(score >= 0.18, "HIGH").when(score >= 0.06, "MEDIUM").otherwise("LOW")


def _sources_without(edges: DataFrame, sources: DataFrame, tasks: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(graph_id, connection_id, feeder, source): the nearest source once a pair is gone; null if none is reached.

    tasks: (graph_id, connection_id, feeder, gone_u, gone_v).  Each searches outwards from its feeder.
    """
    near = cut(adjacency(edges).select("graph_id", "node", "nbr"))
    source = sources.select("graph_id", F.col("equipment_id").alias("node"), F.lit(True).alias("is_source"))
    key = ["graph_id", "connection_id", "feeder"]
    level = cut(tasks.withColumn("node", F.col("feeder")))
    before, found = None, []
    for _ in range(max_rounds):
        step = level.join(near, ["graph_id", "node"]).where((F.least("node", "nbr") != F.col("gone_u")) | (F.greatest("node", "nbr") != F.col("gone_v")))
        step = step.select(*key, "gone_u", "gone_v", F.col("nbr").alias("node")).distinct()
        known = level.select(*key, "node") if before is None else level.select(*key, "node").unionByName(before.select(*key, "node"))
        step = cut(step.join(known, [*key, "node"], "left_anti").join(source, ["graph_id", "node"], "left"))
        if step.isEmpty():
            break
        hits = cut(step.where("is_source").groupBy(*key).agg(F.min("node").alias("source")))
        found.append(hits)
        before, level = level, cut(step.join(hits.select(*key), key, "left_anti").drop("is_source"))
    done = reduce(DataFrame.unionByName, found) if found else tasks.select(*key, F.lit(None).cast("string").alias("source")).limit(0)
    return tasks.select(*key).join(done, key, "left")


def criticality(equipment: DataFrame, terminals: DataFrame, connections: DataFrame, edges: DataFrame, labelled: DataFrame, sources: DataFrame, paths: DataFrame, base_paths: DataFrame | None = None) -> DataFrame:
    """Risk of every connection that is neither accepted nor verified, all without overrides.

    The source of a feeder can change only with a connection on its own path, and
    only if no parallel one takes over; so those pairs are searched, not each
    connection's whole graph.  In a component with one source nothing needs to be
    searched: the feeder loses it exactly if the pair is a bridge.  edges,
    labelled and base_paths (paths by default) are the base variant's; paths are
    those that the result is held against.
    """
    base_paths = paths if base_paths is None else base_paths
    cuts = cut(bridges(edges, labelled).select("graph_id", "u", "v", F.lit(True).alias("bridge")))
    lines = resolved(connections, terminals).withColumn("u", F.least("left_id", "right_id")).withColumn("v", F.greatest("left_id", "right_id"))
    open_lines = lines.where(F.coalesce(~F.col("review_status").isin("accepted", "verified"), F.lit(True)))
    single = edges.where("parallel = 1").select("graph_id", "u", "v", "connection_id")

    place = labelled.select("graph_id", F.col("node").alias("equipment_id"), "component")
    supply = sources.join(place, ["graph_id", "equipment_id"]).groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("supplies"))
    at = place.select("graph_id", F.col("equipment_id").alias("feeder"), "component").join(supply, ["graph_id", "component"]).select("graph_id", "feeder", "supplies")
    used = base_paths.select("graph_id", F.col("feeder_equipment_id").alias("feeder"), F.explode("connection_path").alias("connection_id"))
    used = used.join(single, ["graph_id", "connection_id"]).join(at, ["graph_id", "feeder"]).join(cuts, ["graph_id", "u", "v"], "left")
    used = cut(used.join(open_lines.select("graph_id", F.col("id").alias("connection_id")), ["graph_id", "connection_id"], "left_semi"))
    searched = _sources_without(edges, sources, used.where("supplies > 1").select("graph_id", "connection_id", "feeder", F.col("u").alias("gone_u"), F.col("v").alias("gone_v")))
    lost = used.where("supplies = 1 and bridge").select("graph_id", "connection_id", "feeder", F.lit(None).cast("string").alias("source"))
    without = searched.unionByName(lost)

    original = paths.select("graph_id", F.col("feeder_equipment_id").alias("feeder"), F.col("source_equipment_id").alias("original"))
    base = base_paths.select("graph_id", F.col("feeder_equipment_id").alias("feeder"), F.col("source_equipment_id").alias("base"))
    changed = without.join(original, ["graph_id", "feeder"]).where(~F.col("source").eqNullSafe(F.col("original"))).select("graph_id", "connection_id", "feeder")
    if base_paths is not paths:  # what overrides changed differs for every connection whose loss does not restore it
        shifted = original.join(base, ["graph_id", "feeder"]).where(~F.col("base").eqNullSafe(F.col("original"))).select("graph_id", "feeder")
        rest = open_lines.select("graph_id", F.col("id").alias("connection_id")).join(shifted, "graph_id").join(without, ["graph_id", "connection_id", "feeder"], "left_anti")
        changed = changed.unionByName(rest)
    changed = cut(changed)

    hit = changed.groupBy("graph_id", "connection_id").agg(F.sort_array(F.collect_set("feeder")).alias("affected_feeders"))
    route = paths.select("graph_id", F.col("feeder_equipment_id").alias("feeder"), F.explode("equipment_path").alias("node"))
    touched = changed.join(route, ["graph_id", "feeder"]).groupBy("graph_id", "connection_id").agg(F.sort_array(F.collect_set("node")).alias("affected_nodes"))
    totals = equipment.groupBy("graph_id").agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("n_nodes"), F.greatest(F.lit(1), F.count_if(F.col("type") == "feeder")).alias("n_feeders"))

    pairs = edges.select("graph_id", "u", "v", "connection_id", "parallel")
    rows = open_lines.select("graph_id", F.col("id").alias("connection_id"), "confidence", "u", "v")
    rows = rows.join(cuts, ["graph_id", "u", "v"], "left").join(pairs.where("parallel = 1").select("graph_id", "connection_id", F.lit(True).alias("alone")), ["graph_id", "connection_id"], "left")
    rows = rows.join(hit, ["graph_id", "connection_id"], "left").join(touched, ["graph_id", "connection_id"], "left").join(totals, "graph_id")
    none = F.array().cast("array<string>")
    rows = rows.select(
        "graph_id", "connection_id", "confidence", F.greatest(F.lit(0.0), 1 - F.col("confidence")).alias("doubt"), F.coalesce("affected_feeders", none).alias("affected_feeders"), F.coalesce("affected_nodes", none).alias("affected_nodes"),
        F.when(F.coalesce(F.col("bridge") & F.col("alone"), F.lit(False)), 1).otherwise(0).alias("component_change"), F.when(F.col("bridge"), 1.0).otherwise(0.0).alias("bridge_importance"), "n_nodes", "n_feeders",
    )
    feeder_share, node_share = F.size("affected_feeders") / F.col("n_feeders"), F.size("affected_nodes") / F.col("n_nodes")
    score = risk(F.col("doubt"), feeder_share, node_share, F.col("bridge_importance"), F.col("component_change"))
    factors = F.create_map(
        F.lit("affected_feeder_fraction"), F.round(feeder_share, 4), F.lit("affected_node_fraction"), F.round(node_share, 4), F.lit("source_assignment_change"), F.round(feeder_share, 4),
        F.lit("bridge_importance"), F.col("bridge_importance"), F.lit("component_change"), F.round(F.least(F.lit(1.0), F.col("component_change") / 2), 4),
    )
    return rows.select("graph_id", "connection_id", "confidence", F.round("doubt", 4).alias("uncertainty"), "affected_feeders", "affected_nodes", F.col("affected_feeders").alias("source_assignment_changes"), "component_change", "bridge_importance", factors.alias("risk_factors"), score.alias("risk_score"), priority(score).alias("priority"))


def health(sources: DataFrame, feeders: DataFrame, findings: DataFrame, risks: DataFrame, equipment: DataFrame) -> DataFrame:
    """One row a graph: status and the counts that it follows from."""
    graphs = equipment.select("graph_id").distinct()
    count = lambda df, **aggs: df.groupBy("graph_id").agg(*[v.alias(k) for k, v in aggs.items()])
    one = F.count(F.lit(1))
    parts = [
        count(sources, sources=one), count(feeders, feeders=one, resolved_paths=F.count_if(F.col("resolution") == "resolved"), unresolved_feeders=F.count_if(F.col("resolution") == "unresolved")),
        count(findings, findings=one, validation_errors=F.count_if(F.col("severity") == "error")), count(risks, review_items=one, critical_issues=F.count_if(F.col("priority") == "CRITICAL")),
    ]
    rows = reduce(lambda a, b: a.join(b, "graph_id", "left"), parts, graphs).fillna(0)
    status = F.when((F.col("validation_errors") > 0) | (F.col("critical_issues") > 0), "Critical").when((F.col("findings") > 0) | (F.col("unresolved_feeders") > 0), "Review Needed").otherwise("Healthy")
    return rows.withColumn("status", status)


class Analysis:
    """Everything that is derived from graph tables, under overrides where they are given.

    Sources, criticality and validation's degrees look at the graph without
    overrides; paths, feeders and what follows from them look at it with them.
    """

    def __init__(self, equipment: DataFrame, terminals: DataFrame, connections: DataFrame, overrides: DataFrame | None = None, variant: str = BASE, policy: str = "possible", junctions: DataFrame | None = None):
        self.equipment, self.terminals, self.connections = equipment, terminals, connections
        nodes = equipment.select("graph_id", F.lit(BASE).alias("variant_id"), F.col("id").alias("node"))
        self.edges = cut(operational_edges(equipment, terminals, connections))
        self.labelled = cut(components(self.edges, nodes))
        self.sources = cut(source_candidates(equipment, self.labelled))
        self.base_paths = self.paths = cut(feeder_paths(equipment, self.edges, self.sources))
        if overrides is not None or policy != "possible":
            own = base_variant(equipment)
            forced = None if overrides is None else overrides.where(F.col("variant_id") == variant).withColumn("variant_id", F.lit(BASE))
            shifted = cut(operational_edges(equipment, terminals, connections, own, forced, policy))
            self.paths = cut(feeder_paths(equipment, shifted, self.sources, own))
        self.feeders = feeder_records(equipment, self.paths)
        self.junctions = junctions

    @cached_property
    def findings(self) -> DataFrame:
        return cut(validate(self.equipment, self.terminals, self.connections, self.edges, self.paths, self.junctions))

    @cached_property
    def risks(self) -> DataFrame:
        return cut(criticality(self.equipment, self.terminals, self.connections, self.edges, self.labelled, self.sources, self.paths, self.base_paths))

    @property
    def health(self) -> DataFrame:
        return health(self.sources, self.feeders, self.findings, self.risks, self.equipment)
