"""Greedy leaders: along a priority, a node leads unless a neighbour before it does.

One by one this takes as many steps as the longest chain of neighbours. Here nodes whose answer hangs on one open neighbour only
are short-cut: whether they lead is whether that neighbour leads, or the opposite, so everything that hangs on them can hang on that
neighbour instead. Chains fold to half their length each round.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept


def greedy_leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, leads) for every node. `nodes`: v, once each; `edges`: v, u, where u is a neighbour that comes before v.

    An open edge (v, u, s) says: v does not lead if u leads (s false), or if u does not lead (s true). A node that has lost
    all its edges leads; one with a true edge, or with both edges to one neighbour, does not. What a round settles is written once
    and only the edges between open nodes go on.
    """
    open_ = kept(edges.select("v", "u", F.lit(False).alias("s")).distinct())
    settled = kept(nodes.join(open_.select("v").distinct(), "v", "left_anti").select("v", F.lit(True).alias("leads")))
    tables, fresh = [settled], settled
    while not open_.isEmpty():
        known = fresh.select(F.col("v").alias("u"), "leads")
        # Each edge beside what is known of its neighbour since the last round.
        told = open_.join(known, "u", "left").withColumn("stops", F.col("leads") != F.col("s"))
        per_node = kept(told.groupBy("v", "u").agg(
            F.bool_or(F.coalesce("stops", F.lit(False))).alias("stops"), F.bool_and(F.col("stops").isNotNull()).alias("known"),
            F.min("s").alias("low"), F.max("s").alias("high"),
        ))
        verdict = per_node.groupBy("v").agg(
            F.bool_or(F.col("stops") | (~F.col("known") & (F.col("low") != F.col("high")))).alias("stopped"),
            F.count_if(~F.col("known")).alias("open"), F.max(F.when(~F.col("known"), F.struct("u", F.col("low").alias("s")))).alias("only"),
        )
        verdict = kept(verdict)
        fresh = kept(verdict.filter("stopped OR open = 0").select("v", (~F.col("stopped")).alias("leads")))
        tables.append(fresh)
        going = per_node.filter(~F.col("known")).join(
            verdict.filter("NOT stopped AND open > 0").select("v"), "v", "left_semi"
        ).select("v", "u", F.col("low").alias("s"))
        # A node with one open edge leads when that edge does not stop it.
        single = verdict.filter("NOT stopped AND open = 1").select(
            F.col("v").alias("u"), F.col("only.u").alias("next"), (~F.col("only.s")).alias("turn")
        )
        open_ = kept(
            going.join(single, "u", "left").select(
                "v", F.coalesce("next", "u").alias("u"),
                F.when(F.col("turn").isNull(), F.col("s")).otherwise(F.col("s") != F.col("turn")).alias("s"),
            ).distinct()
        )
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out
