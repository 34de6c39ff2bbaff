"""Summaries and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.functions.text import rating_components
from netsift.operators.components import connected_components


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, and empty where b is 0."""
    out = a / F.when(b != 0, b)
    return out if empty is None else F.coalesce(out, F.lit(empty))


def f_scores(tp: Column, fp: Column, fn: Column, empty: float | None = 0.0) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp, empty), ratio(tp, tp + fn, empty)
    return {"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(ratio(2 * p * r, p + r, empty), 4)}


def text_summary(texts: DataFrame) -> DataFrame:
    """(analysis_run_id, text_type, n, needs_review); a null type is the run's total."""
    waiting = F.count_if(F.col("review_status").isin("pending", "unreviewed") & F.col("requires_review"))
    return texts.rollup("analysis_run_id", "text_type").agg(F.count(F.lit(1)).alias("n"), waiting.alias("needs_review")).where("analysis_run_id is not null")


def symbol_summary(symbols: DataFrame, associations: DataFrame) -> DataFrame:
    """(analysis_run_id, predicted_class, n, associated, pending); a null class is the run's total."""
    named = associations.select("analysis_run_id", F.col("symbol_evidence_id").alias("id"), F.lit(True).alias("named")).distinct()
    rows = symbols.join(named, ["analysis_run_id", "id"], "left")
    return rows.rollup("analysis_run_id", "predicted_class").agg(F.count(F.lit(1)).alias("n"), F.count_if("named").alias("associated"), F.count_if(F.col("review_status") == "pending").alias("pending")).where("analysis_run_id is not null")


def stored_health(findings: DataFrame, risks: DataFrame, runs: DataFrame) -> DataFrame:
    """(graph_id, status) from stored rows alone: errors, then anything at all; unlike graph.health it looks at no priority."""
    f = findings.groupBy("graph_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"))
    r = risks.groupBy("graph_id").agg(F.count(F.lit(1)).alias("risks"))
    rows = runs.select("graph_id").distinct().join(f, "graph_id", "left").join(r, "graph_id", "left").fillna(0)
    return rows.withColumn("status", F.when(F.col("errors") > 0, "Critical").when(F.col("findings") + F.col("risks") > 0, "Review Needed").otherwise("Healthy"))


def unordered(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Distinct unordered pairs (keys, u, v) of two different columns' values."""
    return df.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def pair_scores(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall, f1) of two sets of pairs (keys, u, v)."""
    both = truth.withColumn("t", F.lit(1)).join(predicted.withColumn("p", F.lit(1)), [*keys, "u", "v"], "full")
    counted = both.groupBy(*keys).agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return counted.withColumns(f_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def recall_of(truth: DataFrame, predicted: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): share of truth pairs that are predicted; no truth counts as 1."""
    hit = truth.join(predicted.withColumn("p", F.lit(1)), [*keys, "u", "v"], "left")
    return hit.groupBy(*keys).agg(F.round(ratio(F.count("p"), F.count(F.lit(1)), 1.0), 4).alias(name))


def reachability_agreement(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pairs, agree, accuracy): node pairs that both labelings join, or both part.

    truth, predicted: (keys, node, component).  Counted from the sizes of the
    components and of their intersections, without listing pairs: pairs joined by
    both, plus all pairs less those joined by one of them.
    """
    both = truth.withColumnRenamed("component", "t").join(predicted.withColumnRenamed("component", "p"), [*keys, "node"])
    two = F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2
    sizes = lambda *g: both.groupBy(*keys, *g).agg(two.alias("k")).groupBy(*keys).agg(F.sum("k").alias("s"))
    t, p, tp = sizes("t").withColumnRenamed("s", "in_t"), sizes("p").withColumnRenamed("s", "in_p"), sizes("t", "p").withColumnRenamed("s", "in_both")
    total = both.groupBy(*keys).agg(two.alias("pairs"))
    rows = total.join(t, keys).join(p, keys).join(tp, keys)
    agree = F.col("pairs") - F.col("in_t") - F.col("in_p") + 2 * F.col("in_both")
    return rows.select(*keys, F.col("pairs").cast("long").alias("pairs"), agree.cast("long").alias("agree"), F.round(ratio(agree, F.col("pairs"), 1.0), 4).alias("accuracy"))


def same_partition(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, same): whether two labelings have the same components, whatever their names."""
    name = lambda df, c: df.join(df.groupBy(*keys, "component").agg(F.min("node").alias(c)), [*keys, "component"]).select(*keys, "node", c)
    both = name(truth, "t").join(name(predicted, "p"), [*keys, "node"], "full")
    return both.groupBy(*keys).agg(F.bool_and(F.col("t").eqNullSafe(F.col("p"))).alias("same"))


def error_tags(tp: Column, fp: Column, fn: Column, mapped: Column, nodes: Column) -> Column:
    tags = F.array_compact(F.array(F.when(fn > 0, F.lit("MISSED_CONDUCTOR")), F.when(fp > 0, F.lit("FALSE_CONDUCTOR")), F.when(mapped < nodes, F.lit("TERMINAL_SNAP_ERROR"))))
    return F.when((F.size(tags) == 0) & (tp > 0), F.array(F.lit("NONE"))).otherwise(tags)


def corpus_scores(per_drawing: DataFrame, keys: list[str], means: list[str]) -> DataFrame:
    """Micro precision, recall and f1 from summed tp, fp and fn; plain means of other columns."""
    total = per_drawing.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.round(F.avg(c), 4).alias(c) for c in means])
    return total.withColumns(f_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def class_scores(matches: DataFrame, detections: DataFrame, truth: DataFrame, class_col: str) -> DataFrame:
    """(class, tp, fp, fn, precision, recall, f1); a null class is the total.

    matches: one row a match with its class; detections and truth: one row each with theirs.
    """
    tally = lambda df, tp, d, t: df.select(class_col, F.lit(tp).alias("tp"), F.lit(d).alias("d"), F.lit(t).alias("t"))
    rows = tally(matches, 1, 0, 0).unionByName(tally(detections, 0, 1, 0)).unionByName(tally(truth, 0, 0, 1))
    rows = rows.rollup(class_col).agg(F.sum("tp").alias("tp"), (F.sum("d") - F.sum("tp")).alias("fp"), (F.sum("t") - F.sum("tp")).alias("fn"))
    return rows.withColumns(f_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion(rows: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """One row a true class, one column a predicted one."""
    return rows.groupBy(truth).pivot(predicted, classes).agg(F.count(F.lit(1))).fillna(0)


def label_metrics(matched: DataFrame, expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected, observed, exact_match, character_error_rate, precision, recall, f1) of spatial.match_labels' rows."""
    e = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"), F.sum(F.length("label")).alias("chars"))
    o = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("observed"))
    m = matched.groupBy(*keys).agg(F.count("observed_id").alias("tp"), F.sum("errors").alias("errors"))
    rows = e.join(o, keys, "left").join(m, keys, "left").fillna(0)
    scores = f_scores(F.col("tp"), F.col("observed") - F.col("tp"), F.col("expected") - F.col("tp"), None)
    return rows.withColumns({"exact_match": F.round(ratio(F.col("tp"), F.col("expected"), None), 4), "character_error_rate": F.round(ratio(F.col("errors"), F.col("chars"), None), 4)} | scores)


def typed_exact(expected: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """(semantic_type, eligible, exact, value): exact hits by type.  expected: (keys, expected_id, semantic_type)."""
    hit = matched.where("observed_id is not null").select(*keys, "expected_id", F.lit(1).alias("h"))
    return expected.join(hit, [*keys, "expected_id"], "left").groupBy("semantic_type").agg(F.count(F.lit(1)).alias("eligible"), F.count("h").alias("exact"), F.round(ratio(F.count("h"), F.count(F.lit(1)), None), 4).alias("value"))


def multiset_overlap(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows common to both, as often as in both."""
    return a.select(*columns).intersectAll(b.select(*columns))


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.round(ratio(F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col(weight)), F.sum(weight), None), 4).alias(value))


def path_scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(graph_id, feeders, exact_source_assignment, exact_path, exact_edges, feeder_precision, feeder_recall) of feeder paths."""
    cols = ["source_equipment_id", "equipment_path", "connection_path"]
    side = lambda df, p: df.select("graph_id", "feeder_equipment_id", F.lit(True).alias(f"{p}_"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    both = side(expected, "e").join(side(predicted, "p"), ["graph_id", "feeder_equipment_id"], "full")
    same = lambda c: F.count_if(F.col("e_") & F.col("p_") & F.col(f"e_{c}").eqNullSafe(F.col(f"p_{c}")))
    e, p, hit = F.count("e_"), F.count("p_"), F.count_if(F.col("e_") & F.col("p_"))
    score = lambda c: F.round(ratio(same(c), e, 1.0), 4)
    return both.groupBy("graph_id").agg(e.alias("feeders"), score("source_equipment_id").alias("exact_source_assignment"), score("equipment_path").alias("exact_path"), score("connection_path").alias("exact_edges"), F.round(ratio(hit, p, 1.0), 4).alias("feeder_precision"), F.round(ratio(hit, e, 1.0), 4).alias("feeder_recall"))


def set_scores(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(graph_id, tp, fp, fn, precision, recall, f1) of two sets (graph_id, key); nothing missed of nothing counts as 1."""
    both = truth.select("graph_id", key).distinct().withColumn("t", F.lit(1)).join(predicted.select("graph_id", key).distinct().withColumn("p", F.lit(1)), ["graph_id", key], "full")
    rows = both.groupBy("graph_id").agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return rows.withColumns(f_scores(F.col("tp"), F.col("fp"), F.col("fn"), 1.0))


def monotone(base: DataFrame, opened: DataFrame, closed: DataFrame) -> DataFrame:
    """(graph_id, opened, base, closed, monotone): feeders reached; opening a switch never adds, closing never takes."""
    n = lambda df, c: df.groupBy("graph_id").agg(F.count_if(F.col("source_equipment_id").isNotNull()).alias(c))
    rows = n(base, "base").join(n(opened, "opened"), "graph_id").join(n(closed, "closed"), "graph_id")
    return rows.withColumn("monotone", (F.col("opened") <= F.col("base")) & (F.col("base") <= F.col("closed")))


def missed_reasons(missed: DataFrame) -> DataFrame:
    """missed pairs with reason.  Columns: mapped, in_candidates, conductors (count), gap, radius, touches_bus."""
    reason = (
        F.when(~F.col("mapped"), "SYMBOL_DETECTION_ERROR_PROPAGATION").when(F.col("in_candidates"), "GRAPH_REPAIR_DROPPED_EDGE").when(F.col("conductors") == 0, "CONDUCTOR_NOT_EXTRACTED")
        .when(F.coalesce(F.col("gap"), F.lit(float("inf"))) > F.col("radius"), "TERMINAL_SNAP_DISTANCE_FAILURE").when(F.col("touches_bus"), "BUS_ATTACHMENT_FAILURE").otherwise("CONDUCTOR_FRAGMENTED")
    )
    return missed.withColumn("reason", reason)


def counted(rows: DataFrame, column: str) -> DataFrame:
    """(column, n): how often each value, or each element of an array, occurs."""
    value = F.explode(column) if rows.schema[column].dataType.typeName() == "array" else F.col(column)
    return rows.select(value.alias(column)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def mean_runtime(rows: DataFrame, keys: list[str], runtime: str, digits: int = 4) -> DataFrame:
    """(keys, mean_runtime, n)."""
    return rows.groupBy(*keys).agg(F.round(F.avg(runtime), digits).alias("mean_runtime"), F.count(F.lit(1)).alias("n"))


def edges_within(edges: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """edges (keys, u, v) both of whose ends are members (keys, node) of the same keys."""
    out = edges
    for end in ("u", "v"):
        out = out.join(members.select(*keys, F.col("node").alias(end)).distinct(), [*keys, end], "left_semi")
    return out.select(edges.columns)


def rating_matches(expected: DataFrame, observed: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, semantic_type, eligible, exact, value): rating components of labels, each matched as often as it was read.

    expected, observed: (keys, id, label).  Components count as a multiset in each label.
    """
    parts = lambda df: df.select(*keys, id_col, F.explode(rating_components(F.col("label"))).alias("c")).groupBy(*keys, id_col, "c.semantic_type", "c.value").agg(F.count(F.lit(1)).alias("n"))
    both = parts(expected).join(parts(observed).withColumnRenamed("n", "m"), [*keys, id_col, "semantic_type", "value"], "left")
    rows = both.groupBy(*keys, "semantic_type").agg(F.sum("n").alias("eligible"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("exact"))
    return rows.withColumn("value", F.round(ratio(F.col("exact"), F.col("eligible"), None), 4))


def semantic_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, recognised, semantic_accuracy, tp, fp, fn, precision, recall, f1) of exactly recognised labels alone.

    rows: (keys, exact, expected_type, observed_type, expected_entity, observed_entity).
    """
    hit = F.count_if(F.col("observed_entity") == F.col("expected_entity"))
    got, want = F.count("observed_entity"), F.count("expected_entity")
    out = rows.where("exact").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("recognised"), F.round(ratio(F.count_if(F.col("observed_type") == F.col("expected_type")), F.count(F.lit(1)), None), 4).alias("semantic_accuracy"),
        hit.alias("tp"), (got - hit).alias("fp"), (want - hit).alias("fn"),
    )
    return out.withColumns(f_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def topology_scores(truth: DataFrame, predicted: DataFrame, candidates: DataFrame, critical: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One row a drawing: pair_scores, candidate_recall, critical_edge_recall, reachability and whether components are the same.

    All but nodes (keys, node) are sets of pairs (keys, u, v); of critical pairs those that are true count.
    """
    name = lambda df: _components_of(df, nodes, keys)
    real, guess = name(truth), name(predicted)
    rows = pair_scores(truth, predicted, keys).join(recall_of(truth, candidates, keys, "candidate_recall"), keys, "left")
    rows = rows.join(recall_of(truth.join(critical, [*keys, "u", "v"], "left_semi"), predicted, keys, "critical_edge_recall"), keys, "left")
    rows = rows.join(reachability_agreement(real, guess, keys).select(*keys, F.col("accuracy").alias("reachability")), keys, "left").join(same_partition(real, guess, keys), keys, "left")
    return rows.fillna(1.0, ["candidate_recall", "critical_edge_recall"])


def _components_of(pairs: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component) of nodes under pairs (keys, u, v)."""
    at = lambda c: F.struct(*keys, F.col(c).alias("node"))
    found = connected_components(pairs.select(at("u").alias("src"), at("v").alias("dst"))).select("node.*", F.col("component.node").alias("component"))
    return nodes.join(found, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))
