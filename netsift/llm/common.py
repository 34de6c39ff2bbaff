"""Reading inputs and drawing bounded samples of labelled rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of a batch that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 2000, 16 * 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches are small enough for long texts; results do not depend on it."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) for an Arrow operator, in bounded batches."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, such that df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    name = "__" + name
    while name.lower() in taken:
        name = "_" + name
    return name


#: Operator whose tables this process holds -> what drops them.
_RESIDENT: dict[str, Callable[[], None]] = {}


def reside(owner: str, drop: Callable[[], None] = lambda: None) -> None:
    """Before an operator loads its tables in a process: those of others go, as processes outlive stages."""
    others = [k for k in _RESIDENT if k != owner]
    for k in others:
        _RESIDENT.pop(k)()
    _RESIDENT[owner] = drop
    if others:
        release()


def release() -> None:
    """Gives freed memory back: Python processes live on, and other operators' peaks would add up."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


#: Ids and labels that are counted first and then broadcast.
LABELS_SENT = 2_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, caps: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most about caps[value] training rows of each label value.

    keep selects training rows of labels.  A document whose labels disagree, or
    are null or other values, is no training row.  Rows are drawn by a hash of
    the id, so a rerun draws the same ones.  Their number is bounded by caps (the
    hash threshold is set from exact counts); they are broadcast up to LABELS_SENT.
    """
    clean = labels.where(keep).groupBy(F.col(id_col).alias("__id")).agg(F.min(label).alias("__lo"), F.max(label).alias("__hi"))
    clean = clean.where("__id is not null and __lo = __hi").select("__id", F.col("__lo").cast("int").alias("__label"))
    counts = {r["__label"]: r["n"] for r in clean.where(F.col("__label").isin(list(caps))).groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    part, whole = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "__id"), 1), 1 << 63
    draw = F.lit(False)
    for value, cap in caps.items():
        most = whole - 1 if counts.get(value, 0) <= cap else whole * cap // counts[value]
        draw = draw | ((F.col("__label") == value) & (part <= F.lit(most)))
    drawn = clean.where(draw)
    few = sum(min(cap, counts.get(value, 0)) for value, cap in caps.items()) <= LABELS_SENT
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(drawn) if few else drawn, "__id")
    return found.select(F.col("__id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("__label").alias("label"))
