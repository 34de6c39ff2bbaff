"""Graph and evidence tables derived from a star schema, so that every operator has whole tables to run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.functions.geometry import box

Graph = dict[str, DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def trust(balance: str) -> Column:
    """An account balance as a confidence from 0.01 to 1."""
    return F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.floor((F.col(balance) + 1000) / 11000 * 10000) / 10000))


def _equipment(graph: Column, ord_: Column, id_: Column, label: Column, kind, rating: Column, state: Column | None = None) -> list[Column]:
    attributes = F.map_filter(F.create_map(F.lit("rating"), rating, F.lit("switch_state"), F.lit(None).cast("string") if state is None else state), lambda k, v: v.isNotNull())
    return [graph.alias("graph_id"), ord_.cast("int").alias("ord"), id_.alias("id"), label.alias("equipment_id"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), F.lit(1).alias("page"), box(0.1, 0.1, 0.2, 0.2).alias("bbox"), attributes.alias("attributes"), F.lit(1.0).alias("confidence"), F.array(F.lit("geometry")).alias("provenance"), F.lit("pending").alias("review_status")]


def _connection(graph: Column, ord_: Column, id_: Column, left: Column, right: Column, confidence: Column, state: Column | None = None) -> list[Column]:
    t = lambda c: F.concat(F.lit("T:"), c)
    return [graph.alias("graph_id"), ord_.cast("int").alias("ord"), id_.alias("id"), t(left).alias("from_terminal_id"), t(right).alias("to_terminal_id"), F.array(F.struct(F.lit(0.1).alias("x"), F.lit(0.1).alias("y"))).alias("polyline"), (F.lit(None).cast("string") if state is None else state).alias("switch_state"), confidence.alias("confidence"), F.array(F.lit("geometry")).alias("provenance"), F.lit("pending").alias("review_status")]


def _with_terminals(equipment: DataFrame, connections: DataFrame) -> Graph:
    terminals = equipment.select("graph_id", "ord", F.concat(F.lit("T:"), "id").alias("id"), F.col("id").alias("equipment_id"), F.lit("ATTACH").alias("name"), F.lit(0.1).alias("x"), F.lit(0.1).alias("y"))
    return {"equipment": equipment, "terminals": terminals, "connections": connections}


def net(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph a region: region (source) - nation (bus) - customers (feeders) and suppliers (breakers); trees."""
    r, n, c, s = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    home = n.select(F.col("n_nationkey"), F.col("n_regionkey"))
    g = name("net:", "n_regionkey")
    c = c.join(F.broadcast(home), c["c_nationkey"] == home["n_nationkey"])
    s = s.join(F.broadcast(home), s["s_nationkey"] == home["n_nationkey"])
    kv = F.when(F.col("c_nationkey") % 3 == 0, "33 kV").otherwise("11 kV")
    equipment = (
        r.select(*_equipment(name("net:", "r_regionkey"), F.col("r_regionkey"), name("R", "r_regionkey"), F.col("r_name"), "energy_source", F.lit("33 kV")))
        .unionByName(n.select(*_equipment(g, F.col("n_nationkey"), name("N", "n_nationkey"), F.col("n_name"), "busbar", F.lit("33 kV"))))
        .unionByName(c.select(*_equipment(g, F.col("c_custkey"), name("C", "c_custkey"), F.col("c_name"), "feeder", F.concat(kv, F.lit(" · 630 A")))))
        .unionByName(s.select(*_equipment(g, F.col("s_suppkey"), name("S", "s_suppkey"), F.col("s_name"), "circuit_breaker", F.lit("11 kV"))))
    )
    state = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "open").when(F.col("c_mktsegment") == "MACHINERY", "unknown")
    connections = (
        n.select(*_connection(g, F.col("n_nationkey"), name("RN", "n_nationkey"), name("R", "n_regionkey"), name("N", "n_nationkey"), F.lit(1.0)))
        .unionByName(c.select(*_connection(g, F.col("c_custkey") + 100, name("NC", "c_custkey"), name("N", "c_nationkey"), name("C", "c_custkey"), trust("c_acctbal"), state)))
        .unionByName(s.select(*_connection(g, -F.col("s_suppkey"), name("NS", "s_suppkey"), name("N", "s_nationkey"), name("S", "s_suppkey"), trust("s_acctbal"))))
    )
    return _with_terminals(equipment, connections)


def net2(spark: SparkSession, sf_dir: str, repeats: bool = False) -> Graph:
    """One cyclic graph: regions (sources) - nations (buses) - suppliers (breakers, some closed) - parts (feeders) that they sell.

    repeats: a pair that is sold again has its connection again, for questions in which that changes nothing.
    """
    r, n, s = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    lines = read(spark, sf_dir, "lineitem")
    sold = lines.select("l_suppkey", "l_partkey")
    sold = sold if repeats else sold.distinct()
    g = F.lit("net2")
    state = F.when(F.col("s_acctbal") >= 5000, "closed")
    equipment = (
        r.select(*_equipment(g, F.col("r_regionkey"), name("R", "r_regionkey"), F.col("r_name"), "energy_source", F.lit("33 kV")))
        .unionByName(n.select(*_equipment(g, F.col("n_nationkey"), name("N", "n_nationkey"), F.col("n_name"), "busbar", F.lit("33 kV"))))
        .unionByName(s.select(*_equipment(g, F.col("s_suppkey"), name("S", "s_suppkey"), F.col("s_name"), "circuit_breaker", F.lit("33 kV"), state)))
        .unionByName(lines.select("l_partkey").distinct().select(*_equipment(g, F.col("l_partkey"), name("P", "l_partkey"), name("P", "l_partkey"), "feeder", F.lit("33 kV"))))
    )
    connections = (
        n.select(*_connection(g, F.col("n_nationkey"), name("RN", "n_nationkey"), name("R", "n_regionkey"), name("N", "n_nationkey"), F.lit(1.0)))
        .unionByName(s.select(*_connection(g, F.col("s_suppkey") + 100, name("NS", "s_suppkey"), name("N", "s_nationkey"), name("S", "s_suppkey"), trust("s_acctbal"))))
        .unionByName(sold.select(*_connection(g, -F.col("l_partkey") - 1, F.concat_ws("-", name("SP", "l_suppkey"), "l_partkey"), name("S", "l_suppkey"), name("P", "l_partkey"), F.lit(0.9))))
    )
    return _with_terminals(equipment, connections)


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph a nation: nation (transformer) - customers (feeders); a region feeds only nations of odd key."""
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    fed = n.where("n_nationkey % 2 = 1")
    g, gc = name("nation:", "n_nationkey"), name("nation:", "c_nationkey")
    equipment = (
        fed.select(*_equipment(g, F.col("n_nationkey"), F.concat(name("R", "n_regionkey"), name("@", "n_nationkey")), F.lit("grid"), "grid_incomer", F.lit("33 kV")))
        .unionByName(n.select(*_equipment(g, F.col("n_nationkey"), name("N", "n_nationkey"), F.col("n_name"), "power_transformer", F.lit("33/11 kV"))))
        .unionByName(c.select(*_equipment(gc, F.col("c_custkey"), name("C", "c_custkey"), F.col("c_name"), "feeder", F.lit("11 kV"))))
    )
    connections = (
        fed.select(*_connection(g, F.col("n_nationkey"), name("RN", "n_nationkey"), F.concat(name("R", "n_regionkey"), name("@", "n_nationkey")), name("N", "n_nationkey"), F.lit(1.0)))
        .unionByName(c.select(*_connection(gc, F.col("c_custkey") + 100, name("NC", "c_custkey"), name("N", "c_nationkey"), name("C", "c_custkey"), F.lit(0.9))))
    )
    return _with_terminals(equipment, connections)


def orders_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """One untidy graph: customers of mixed kinds; orders join two of them, some to nobody, some to themselves, some twice."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    kinds = F.array(*[F.lit(k) for k in ("feeder", "circuit_breaker", "disconnector", "bus_coupler", "power_transformer", "load")])
    kind = F.get(kinds, (F.col("c_custkey") % 6).cast("int"))
    g = F.lit("orders")
    equipment = c.select(*_equipment(g, F.col("c_custkey"), name("C", "c_custkey"), F.concat(F.substring("c_mktsegment", 1, 4), F.col("c_nationkey")), kind, F.lit("11 kV")))
    other = F.when(F.col("o_orderkey") % 50 == 0, F.lit("nobody")).when(F.col("o_orderkey") % 77 == 0, name("C", "o_custkey")).otherwise(F.concat(F.lit("C"), (F.col("o_custkey") + F.col("o_orderkey") % 3 + 1).cast("string")))
    connections = o.select(*_connection(g, F.col("o_orderkey"), name("O", "o_orderkey"), name("C", "o_custkey"), other, F.lit(0.8)))
    return _with_terminals(equipment, connections)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw_text): eight engineering labels a part, of all kinds, well and badly read."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("n"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0").alias("k"))
    forms = F.array(
        F.concat("n", F.lit("KV")), F.concat(F.lit(" "), "n", F.lit(".5 kv ")), F.concat("n", F.lit(" A")), F.concat("n", F.lit("mva")),
        F.concat(F.lit("FDR-"), "n", F.lit("KV-"), "k"), F.concat(F.lit("cb_O"), "k"), F.concat(F.lit("BUS-B"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("k"))), F.concat(F.lit("note "), "n"),
    )
    return p.select("p_partkey", F.posexplode(forms).alias("pos", "raw_text")).select((F.col("p_partkey") * 8 + F.col("pos")).alias("id"), "raw_text")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, id, confidence, bbox): a box in [0, 1] from four components of each embedding."""
    at = lambda k: (F.get("embedding", k).cast("double") + 1) / 2
    x, y = [at(0), at(1)], [at(2), at(3)]
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.round(at(4), 6).alias("confidence"), box(F.least(*x), F.least(*y), F.greatest(*x), F.greatest(*y)).alias("bbox"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, id, a, b): a segment from four components of each embedding."""
    at = lambda k: (F.get("embedding", k).cast("double") + 1) / 2
    p = lambda i, j: F.struct(at(i).alias("x"), at(j).alias("y"))
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), p(5, 6).alias("a"), p(7, 8).alias("b"))


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as review actions on connections: run by user, one target a user."""
    e = read(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "purchase", "verify").otherwise("look")
    return e.select(F.concat(F.lit("run:"), (F.col("user_id") % 20).cast("string")).alias("analysis_run_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.lit("connection").alias("target_table"), name("u", "user_id").alias("target_id"), action.alias("action"), F.create_map(F.lit("value"), F.col("value").cast("string")).alias("payload"), F.lit("engineer").alias("actor"), F.col("ts").alias("created_at"))
