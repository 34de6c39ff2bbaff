"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id.  Tokens are summed by source and by
the leading bits of the hash; the prefix sums of that histogram show in which
bucket a source's budget ends.  Only that bucket is refined by the next bits,
and so on until the bucket holds a single hash.  The result is one threshold a
source, so documents are chosen by a filter: no sort, and a rerun or a larger
budget keeps what a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import WORD
from netsift.plans.lineage import cut

#: Bits of the hash, and bits that one histogram level resolves.
HASH_BITS, LEVEL_BITS = 60, 12
#: Sources up to which per-source rows are broadcast; beyond, plain joins whose skewed partitions AQE splits.
BROADCAST_SOURCES = 100_000


def _numbered(totals: DataFrame) -> DataFrame:
    """totals with sid: the position of source by code point, null last.  Sorted by range, numbered by partition offsets."""
    ordered = totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    ordered = cut(ordered)
    part = F.shiftright("at", 33)
    counts = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, run = [], 0
    for p in range(max(counts, default=0) + 1):
        starts.append(run)
        run += counts.get(p, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), part.cast("int") + 1)
    return ordered.withColumn("sid", start + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def _targets(totals: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """totals with target: shares by weight of all sizes, none above cap times its source."""
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    totals = cut(totals.withColumn("w", w).withColumn("most", F.col("source_size") * cap))
    total = totals.agg(F.sum("source_size").alias("t")).head()["t"] or 0
    level, capped = None, None
    while True:
        full = F.lit(False) if level is None else F.col("w") * F.lit(level) > F.col("most")
        got = totals.agg(F.sum(F.when(full, F.col("most")).otherwise(0)).alias("m"), F.sum(F.when(full, 0).otherwise(F.col("w"))).alias("w"), F.count_if(full).alias("n")).head()
        if capped == got["n"] or not got["w"]:
            break
        level, capped = (total - got["m"]) / got["w"], got["n"]
    share = F.col("w") * F.lit(float(level or 0.0))
    return totals.withColumn("target", F.when(share > F.col("most"), F.col("most").cast("double")).otherwise(share))


def _hash(id_col: str) -> Column:
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


class Plan:
    """What a mix decides: per source its size, target, whole copies and hash threshold."""

    def __init__(self, rows: DataFrame, weights: tuple[int, ...], cap: int):
        """rows: (source, size, h), read several times."""
        totals = _targets(_numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, cap)
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        totals = totals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        totals = cut(totals.select(F.col("source").alias("__source"), "sid", "source_size", "target", "whole", "rest"))
        self.sources = totals.count()
        narrow = self._beside(rows, totals.select("__source", "sid"), F.col("source").eqNullSafe(F.col("__source"))).select("sid", "size", "h")

        at = totals.where("source_size > 0 and rest > 0").select("sid", "rest", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("below"))
        shift = HASH_BITS
        while shift:
            shift -= LEVEL_BITS
            inside = self._beside(narrow, at.withColumnRenamed("sid", "__sid"), (F.col("sid") == F.col("__sid")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("bucket")))
            hist = inside.groupBy("sid", "rest", "below", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("own"), (F.min("h") == F.max("h")).alias("single"))
            running = F.sum("own").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
            hist = hist.withColumn("upto", F.col("below") + running).where("upto > rest")
            at = cut(hist.groupBy("sid", "rest").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("own")).alias("below"), "own", "single"), "bucket").alias("b")).select("sid", "rest", "b.*"))
            if at.agg(F.bool_and("single").alias("s")).head()["s"] is not False:
                break
        nearer = (F.col("below") + F.col("own") - F.col("rest")) < (F.col("rest") - F.col("below"))
        ends = at.select(F.col("sid").alias("__at"), (F.col("bucket") + F.when(nearer, 1).otherwise(0)).alias("__end"))
        self.facts = totals.join(ends, F.col("sid") == F.col("__at"), "left").select("__source", F.col("source_size").alias("__size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), "__end")
        self.shift = shift

    def _beside(self, df: DataFrame, small: DataFrame, on) -> DataFrame:
        return df.join(F.broadcast(small) if self.sources <= BROADCAST_SOURCES else small, on)

    def apply(self, df: DataFrame, source_col: str, hashed: Column) -> DataFrame:
        """df with __size, __target and __copies of each row: a join with the sources and a filter's comparison, no sort."""
        copies = F.col("__whole") + F.when(F.shiftright(hashed, self.shift) < F.col("__end"), 1).otherwise(0)
        return self._beside(df, self.facts, df[source_col].eqNullSafe(F.col("__source"))).withColumn("__copies", copies.cast("long")).drop("__source", "__whole", "__end")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), _hash(id_col).alias("h")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of docs.

    size counts words (WORD); a null text has none.  Sources in code point order,
    null last, have weights, repeating; they share the sum of all sizes, and no
    target exceeds cap times its source's size.  A document is taken
    floor(target / source_size) times, and once more where its hash lies under
    its source's threshold, the one that comes nearest to the target; taken is
    copies * size.  A source without words has target 0 and copies 0.  Rows that
    repeat an id are taken alike.  Empty input: no rows.
    """
    rows = _sized(docs, id_col, text_col, source_col)
    out = Plan(rows, weights, cap).apply(rows, "source", F.col("h"))
    return out.select("doc_id", "source", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs' rows as often as mix() takes them; texts are not shuffled.

    Rows of a null text, of no words or of an empty source have size 0: they are
    taken as mix() says of their source and hash.  A null source is one of its own.
    Rows that repeat an id stay together; columns keep their names, whatever they are.
    """
    plan = Plan(_sized(docs, id_col, text_col, source_col), weights, cap)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source_col).alias("source"), _hash(id_col).alias("h"))
    taken = plan.apply(packed, "source", F.col("h")).where("__copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; nulls and repeats as in mix()."""
    from netsift.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
numbered AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS most FROM totals),
ratio AS (SELECT *, row_number() OVER (ORDER BY most::DOUBLE / w, source NULLS LAST) AS k,
                 sum(source_size) OVER ()::BIGINT AS total FROM numbered),
levels AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                     / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lam FROM ratio),
chosen AS (SELECT min_by(lam, k) AS lam FROM levels WHERE lam * w <= most),
targets AS (SELECT n.*, CASE WHEN n.w * c.lam > n.most THEN n.most::DOUBLE ELSE n.w * c.lam END AS target FROM numbered n, chosen c),
wholes AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
rests AS (SELECT *, target - whole * source_size AS rest FROM wholes),
running AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.whole, t.rest,
                   sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h RANGE UNBOUNDED PRECEDING) AS incl,
                   sum(r.size) OVER (PARTITION BY r.source, r.h) AS own
            FROM rows r JOIN rests t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN rest > 0 AND (incl <= rest OR (incl - rest) < (rest - (incl - own))) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM running
"""
