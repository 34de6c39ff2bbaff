"""Small rules on evidence rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsift.sources.schemas import DOMAINS


def or_default(value: Column, default) -> Column:
    """value, or default where it is null, 0 or an empty text."""
    return F.when(value.isNull() | (value.cast("string").isin("", "0", "0.0")), F.lit(default)).otherwise(value)


def equipment_type(symbol_class: Column) -> Column:
    """The equipment a detected class stands for; unknown classes are generic."""
    return F.when(symbol_class.isin(*DOMAINS["equipment_type"]), symbol_class).when(symbol_class == "feeder_terminal", "feeder").otherwise("generic_equipment")


def review_status(status: Column) -> Column:
    """A stored status as one of the four; others wait."""
    return F.when(status.isin("accepted", "verified", "rejected"), status).otherwise("pending")


def detection_review(confidence: Column) -> Column:
    """struct(review_status, review_reason): weak detections wait for a review."""
    weak = confidence < 0.55
    return F.struct(F.when(weak, "pending").otherwise("unreviewed").alias("review_status"), F.when(weak, "LOW_DETECTION_CONFIDENCE").alias("review_reason"))


def best_class(probabilities: Column, classes: Column) -> Column:
    """The class of the largest probability, the first of equals."""
    return F.get(classes, F.array_position(probabilities, F.array_max(probabilities)) - 1)


def every_nth(items: Column, first: Column, step: int) -> Column:
    """items[first::step]."""
    return F.filter(items, lambda x, i: (i >= first) & ((i - first) % step == 0))
