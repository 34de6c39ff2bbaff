"""Connected components of unbounded edge tables.

Alternating star contraction: each round points the larger neighbours of a
vertex at the smallest one it knows, then the smaller ones.  The number of
rounds grows with the logarithm of the longest chain, edges never grow in
number, and nothing but two scalars a round reaches the driver.  The minimum is
a partial aggregate, so a hub does not gather its neighbours in one task, and
the join back on a hub is a plain equi-join whose skewed side AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.plans.lineage import cut


def _point_at_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) with v's replaced: each v of u, and u, get the minimum over u's pairs."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(low, "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every endpoint; component is the smallest node reachable.

    Nulls in either end and self-loops link nothing; a node that occurs only in
    self-loops is its own component.  Repeated edges count once.  No edges: no
    rows.  Raises if max_rounds do not suffice (far beyond any real chain).
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    raw = cut(raw.distinct())
    stars = cut(raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    print_of = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = stars.agg(print_of.alias("p")).head()["p"]
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _point_at_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _point_at_minimum(large)
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        stars = cut(small)
        after = stars.agg(print_of.alias("p")).head()["p"]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected_components did not converge")
    nodes = raw.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
