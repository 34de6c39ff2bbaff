"""The review log as a stream (an extension: the reviewed systems of this kind poll).

Actions arrive as files or any other append-only source.  Each micro-batch is
appended to the log, and the runs it touches are recomputed; the latest state of
each target is also kept by a watermarked aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netsift.operators.review import changed_runs, known_actions
from netsift.sources.schemas import EVIDENCE


def actions_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Review actions under path as they appear, with an event time in UTC."""
    rows = spark.readStream.schema(EVIDENCE["review_actions"]).parquet(path)
    return known_actions(rows).withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)


def latest_stream(actions: DataFrame) -> DataFrame:
    """(analysis_run_id, target_table, target_id, action, payload): the last action of each target so far."""
    last = F.max_by(F.struct("action", "payload"), F.struct("at", "id"))
    return actions.groupBy("analysis_run_id", "target_table", "target_id").agg(last.alias("a")).select("analysis_run_id", "target_table", "target_id", "a.*")


def actions_per_window(actions: DataFrame, width: str = "1 hour") -> DataFrame:
    """(start, action, n): actions by event time; windows close behind the watermark."""
    return actions.groupBy(F.window("at", width), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "action", "n")


def recompute_on_review(actions: DataFrame, recompute: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Calls recompute with the distinct runs of each micro-batch; it must be idempotent, as a batch may come twice."""

    def each(batch: DataFrame, _: int) -> None:
        runs = changed_runs(batch)
        if not runs.isEmpty():
            recompute(runs)

    return actions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
