"""The append-only review log and what is recomputed from it.

Actions are rows that are only ever appended; current values are a fold over
them: the last action of each target, by time and then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an action makes of a status, by table.
STATUS_AFTER = {"accept": "accepted", "reject": "rejected", "verify": "verified", "unknown": "accepted", "edit": "edited", "add": "verified"}
CROSSING = {"connected": "connected_junction", "unconnected": "crossover_no_connection", "unable_to_determine": "ambiguous_crossing"}
ACTIONS = {
    "text": ("edit", "accept", "reject", "unknown"),
    "symbol": ("edit", "accept", "reject", "verify", "add"),
    "connection": ("accept", "reject", "verify", "add"),
    "junction": tuple(f"crossing_{k}" for k in CROSSING),
    "switch": ("set_state",),
    "issue": ("accept", "reject"),
}


def status_after(action: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in STATUS_AFTER.items():
        out = F.when(action == k, v).otherwise(out)
    return F.when(action.isin("crossing_connected", "crossing_unconnected"), "verified").when(action == "crossing_unable_to_determine", "pending").otherwise(out)


def known_actions(actions: DataFrame) -> DataFrame:
    """Actions that their table has; others are refused by leaving them out."""
    ok = F.lit(False)
    for t, names in ACTIONS.items():
        ok = ok | ((F.col("target_table") == t) & F.col("action").isin(*names))
    return actions.where(ok)


def latest(actions: DataFrame) -> DataFrame:
    """(analysis_run_id, target_table, target_id, action, payload, created_at): the last action of each target."""
    last = F.max_by(F.struct("action", "payload", "created_at"), F.struct("created_at", "id"))
    return known_actions(actions).groupBy("analysis_run_id", "target_table", "target_id").agg(last.alias("a")).select("analysis_run_id", "target_table", "target_id", "a.*")


def last_value(actions: DataFrame, table: str, key: str) -> DataFrame:
    """(analysis_run_id, id, key): the last payload value of a key, whichever later actions lack it."""
    rows = known_actions(actions).where((F.col("target_table") == table) & F.col("payload")[key].isNotNull())
    return rows.groupBy("analysis_run_id", F.col("target_id").alias("id")).agg(F.max_by(F.col("payload")[key], F.struct("created_at", "id")).alias(key))


def history(actions: DataFrame) -> DataFrame:
    """Actions with the status before and after each, in order."""
    w = Window.partitionBy("analysis_run_id", "target_table", "target_id").orderBy("created_at", "id")
    after = status_after(F.col("action"))
    return known_actions(actions).withColumn("new_status", after).withColumn("prior_status", F.lag("new_status").over(w)).withColumn("step", F.row_number().over(w))


def _apply(rows: DataFrame, actions: DataFrame, table: str, values: dict[str, str]) -> DataFrame:
    """rows with the status after their last action and the last values of payload keys (key -> column)."""
    own = latest(actions).where(F.col("target_table") == table).select("analysis_run_id", F.col("target_id").alias("id"), status_after(F.col("action")).alias("__status"))
    out = rows.join(own, ["analysis_run_id", "id"], "left").withColumn("review_status", F.coalesce("__status", "review_status")).drop("__status")
    for key, column in values.items():
        v = last_value(actions, table, key).withColumnRenamed(key, "__v")
        out = out.join(v, ["analysis_run_id", "id"], "left").withColumn(column, F.coalesce("__v", column)).drop("__v")
    return out


def review_texts(texts: DataFrame, actions: DataFrame) -> DataFrame:
    """Texts after their reviews: edited value and type, status; 'unknown' sets the type and accepts."""
    out = _apply(texts, actions, "text", {"value": "engineer_value", "text_type": "engineer_text_type"})
    unknown = latest(actions).where("target_table = 'text' and action = 'unknown'").select("analysis_run_id", F.col("target_id").alias("id"), F.lit(True).alias("__u"))
    return out.join(unknown, ["analysis_run_id", "id"], "left").withColumn("engineer_text_type", F.when(F.col("__u"), "unknown").otherwise(F.col("engineer_text_type"))).drop("__u")


def review_symbols(symbols: DataFrame, actions: DataFrame) -> DataFrame:
    """Symbols after their reviews, and those that were added by hand."""
    out = _apply(symbols, actions, "symbol", {"predicted_class": "predicted_class"})
    box = F.from_json(F.col("payload")["bbox"], "x1 double, y1 double, x2 double, y2 double")
    moved = last_value(actions, "symbol", "bbox").select("analysis_run_id", "id", F.from_json("bbox", "x1 double, y1 double, x2 double, y2 double").alias("__b"))
    out = out.join(moved, ["analysis_run_id", "id"], "left").withColumn("bbox", F.coalesce("__b", "bbox")).drop("__b")
    added = known_actions(actions).where("target_table = 'symbol' and action = 'add'")
    made = {"analysis_run_id": F.col("analysis_run_id"), "id": F.col("target_id"), "page": F.coalesce(F.col("payload")["page"].cast("int"), F.lit(1)), "predicted_class": F.col("payload")["predicted_class"], "original_predicted_class": F.col("payload")["predicted_class"], "confidence": F.lit(1.0), "bbox": box, "review_status": F.lit("verified")}
    added = added.select(*[made.get(f.name, F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in symbols.schema.fields])
    return out.select(*symbols.columns).unionByName(added)


def review_connections(connections: DataFrame, actions: DataFrame, terminals: DataFrame) -> DataFrame:
    """Connections after their reviews, those of review issues too, and manual ones between two known terminals."""
    issues = known_actions(actions).where("target_table = 'issue'").withColumn("target_table", F.lit("connection")).withColumn("target_id", F.coalesce(F.col("payload")["connection_id"], F.col("target_id")))
    out = _apply(connections, actions.unionByName(issues), "connection", {})
    add = known_actions(actions).where("target_table = 'connection' and action = 'add'")
    known = terminals.select("analysis_run_id", F.col("id").alias("__t"))
    end = lambda k: F.col("payload")[k]
    for k in ("from_node_id", "to_node_id"):
        add = add.join(known, (add["analysis_run_id"] == known["analysis_run_id"]) & (end(k) == F.col("__t")), "left_semi")
    add = add.where(end("from_node_id") != end("to_node_id"))
    made = {"analysis_run_id": F.col("analysis_run_id"), "id": F.col("target_id"), "page": F.coalesce(end("page").cast("int"), F.lit(1)), "from_node_id": end("from_node_id"), "to_node_id": end("to_node_id"), "confidence": F.lit(1.0), "provenance": F.lit("engineer_verified"), "review_status": F.lit("verified")}
    add = add.select(*[made.get(f.name, F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in connections.schema.fields])
    return out.select(*connections.columns).unionByName(add)


def review_junctions(junctions: DataFrame, actions: DataFrame) -> DataFrame:
    """Crossings after their decisions."""
    out = _apply(junctions, actions, "junction", {})
    own = latest(actions).where("target_table = 'junction'")
    kind = F.lit(None).cast("string")
    for k, v in CROSSING.items():
        kind = F.when(F.col("action") == f"crossing_{k}", v).otherwise(kind)
    own = own.select("analysis_run_id", F.col("target_id").alias("id"), kind.alias("__k"))
    return out.join(own, ["analysis_run_id", "id"], "left").withColumn("kind", F.coalesce("__k", "kind")).drop("__k").select(*junctions.columns)


def switch_table(states: DataFrame, actions: DataFrame, equipment: DataFrame) -> DataFrame:
    """(analysis_run_id, equipment_id, state, provenance): set states, stored ones, and unknown for switches without any."""
    put = last_value(actions, "switch", "state").where("state in ('open', 'closed', 'unknown')").select("analysis_run_id", F.col("id").alias("equipment_id"), F.col("state").alias("__s"))
    switches = equipment.where("type in ('circuit_breaker', 'disconnector', 'bus_coupler')").select(F.col("graph_id").alias("analysis_run_id"), F.col("id").alias("equipment_id"))
    missing = switches.join(states, ["analysis_run_id", "equipment_id"], "left_anti").withColumns({"state": F.lit("unknown"), "provenance": F.lit("unresolved")})
    rows = states.select("analysis_run_id", "equipment_id", "state", "provenance").unionByName(missing)
    rows = rows.join(put, ["analysis_run_id", "equipment_id"], "left")
    return rows.select("analysis_run_id", "equipment_id", F.coalesce("__s", "state").alias("state"), F.when(F.col("__s").isNotNull(), "engineer").otherwise(F.col("provenance")).alias("provenance"))


def changed_runs(actions: DataFrame, since=None) -> DataFrame:
    """Runs whose semantic tables an action after since makes stale."""
    rows = known_actions(actions)
    if since is not None:
        rows = rows.where(F.col("created_at") > since)
    return rows.select("analysis_run_id").distinct()
