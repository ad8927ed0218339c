"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a partially aggregated minimum a vertex and an equi-join.  The larger neighbours of a
vertex, of which there can be very many, meet its minimum in SALTS places, so that no task gets them
all.  Nothing is collected but one row of convergence counters a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Places in which the edges of a vertex meet its minimum.
SALTS = 16


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (node, component): component is the smallest node reachable.

    Null ends and loops are ignored; repeated edges count once; nodes without an edge do
    not appear; an empty table gives an empty table.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, before = checkpointed(e), None
    while True:
        # large-star: a vertex's larger neighbours hang on its smallest neighbour, or on itself
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        low = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m", salts)
        large = e.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")).join(low, ["v", "salt"], "left")
        large = large.select("u", F.coalesce("m", "v").alias("v")).distinct()
        # small-star: a vertex and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(ends).alias("x")).select("x.*").where("u <> v")
        e = checkpointed(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
