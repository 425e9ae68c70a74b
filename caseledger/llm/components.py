"""Connected components of an edge table by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that has an edge; the component is its smallest id.

    Each round hangs all neighbours of a node under the smallest of them, first the larger, then
    the smaller ones. Every message is a row keyed by a node and minima are combined on the map
    side. Minima are stored before they are joined with the edges, so that Spark may split the edges of a node
    with very many. Rounds end when the edges no longer change; their number grows with the logarithm
    of the longest path. Self loops, repeated edges and null ends are ignored, no edges give no rows.
    """
    e = (
        edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e = stored(e, "edges")
    before = _mark(e)
    while before[0]:
        e = stored(_small_star(stored(_large_star(e), "edges")), "edges")
        now = _mark(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.selectExpr("u AS x", "v AS y").unionByName(e.selectExpr("v AS x", "u AS y"))
    least = stored(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
    return both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = stored(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    others = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.selectExpr("u", "m AS v")).distinct()
