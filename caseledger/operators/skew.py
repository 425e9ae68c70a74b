"""Building blocks that stay even when one key holds a large share of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: Column, *, last: bool = False) -> DataFrame:
    """One row per key, the smallest (or largest) by `order`.

    min_by combines on the map side, so a hot key sends one row per input partition.
    """
    others = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*others), order).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in others])
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """At most k rows per key with their rank.

    A row_number filter is pruned below the exchange too, so every input partition
    sends at most k rows of a key.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def lagged(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, str],
    *,
    slice_of: Column,
) -> DataFrame:
    """lag() of several columns within a key, in the given order.

    Every key is ordered slice by slice (`slice_of` must not decrease along the order), so a key with very many
    rows is many tasks. The last row of each slice travels as one row and is handed to the first row of the next.
    """
    others = [c for c in df.columns if c not in keys]
    sliced = df.withColumn("_slice", slice_of)
    ends = sliced.groupBy(*keys, "_slice").agg(F.max_by(F.struct(*values.values()), F.struct(*order)).alias("_end"))
    carried = ends.select(
        *keys, "_slice", F.lag("_end").over(W.partitionBy(*keys).orderBy("_slice")).alias("_before")
    )
    # The row that is carried in stands before the rows of its slice.
    rows = sliced.select(*keys, "_slice", F.struct(*others).alias("_row")).unionByName(
        carried.filter(F.col("_before").isNotNull()), allowMissingColumns=True
    )
    w = W.partitionBy(*keys, "_slice").orderBy(*[F.col(f"_row.{c}").asc_nulls_first() for c in order])
    before = F.lag(F.coalesce(
        "_before", F.struct(*[F.col(f"_row.{source}").alias(source) for source in values.values()])
    )).over(w)
    out = rows.withColumn("_lag", before).filter(F.col("_row").isNotNull())
    return out.select(
        *[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns],
        *[F.col(f"_lag.{source}").alias(name) for name, source in values.items()],
    )


def nearest_points(asks: DataFrame, points: DataFrame, keys: list[str], t: str, *, slice_of: Column) -> DataFrame:
    """For each different ask (keys, t) the nearest point before it and after it: (keys, t, before, after), null where there is none.

    `points` are different values of t within a key; one at t itself is neither before nor after. A key is ordered slice by slice
    (`slice_of` must not decrease with t). The last and the first point of each slice travel as one row, so that
    no task holds more of a key than a slice and one row per slice.
    """
    both = (
        points.select(*keys, t, F.lit(True).alias("_is"))
        .unionByName(asks.select(*keys, t, F.lit(False).alias("_is")))
        .groupBy(*keys, t).agg(F.bool_or("_is").alias("_point"), F.bool_or(~F.col("_is")).alias("_asked"))
        .withColumn("_slice", slice_of)
    )
    at = F.when(F.col("_point"), F.col(t))
    ends = both.groupBy(*keys, "_slice").agg(F.max(at).alias("_last"), F.min(at).alias("_first"))
    along = W.partitionBy(*keys).orderBy("_slice")
    carried = ends.select(
        *keys, "_slice",
        F.last("_last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_carried"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("_coming"),
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(t)
    found = both.select(
        *keys, "_slice", t, "_asked",
        F.last(at, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first(at, ignorenulls=True).over(inside.rowsBetween(1, W.unboundedFollowing)).alias("_after"),
    ).filter("_asked")
    return found.join(carried, [*keys, "_slice"]).select(
        *keys, t, F.coalesce("_before", "_carried").alias("before"), F.coalesce("_after", "_coming").alias("after")
    )


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], *, width: float = 1 / 24
) -> DataFrame:
    """Exact linear percentiles per key, without holding a key in one task.

    Equal values are counted first. A histogram of `width` wide bins locates the bins that
    hold the wanted ranks, and only those bins are ordered value by value.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_c"))
        .withColumn("_bin", F.floor(F.col(value) / width))
    )
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_bin_n"))
    along = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(
        *keys,
        "_bin",
        "_bin_n",
        F.coalesce(F.sum("_bin_n").over(along), F.lit(0)).alias("_before"),
        F.sum("_bin_n").over(W.partitionBy(*keys)).alias("n"),
    )
    ranks: dict[str, Column] = {}
    for name, p in probs.items():
        if not 0 <= p <= 1:
            raise ValueError(f"not a probability: {p}")
        position = F.lit(p) * (F.col("n") - 1)
        ranks[f"{name}_lo"], ranks[f"{name}_hi"] = F.floor(position), F.ceil(position)

    def covers(start: Column, size: Column, rank: Column) -> Column:
        return (rank >= start) & (rank < start + size)

    wanted = F.lit(False)
    for rank in ranks.values():
        wanted = wanted | covers(F.col("_before"), F.col("_bin_n"), rank)
    hits = bins.filter(wanted)
    inside = W.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    fine = counted.join(hits, [*keys, "_bin"]).withColumn(
        "_start", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0))
    )
    picked = fine.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[
            F.max(F.when(covers(F.col("_start"), F.col("_c"), rank), F.col(value))).alias(f"_{name}")
            for name, rank in ranks.items()
        ],
    )

    def interpolated(name: str, p: float) -> Column:
        position = F.lit(p) * (F.col("n") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return picked.select(*keys, "n", *[interpolated(name, p) for name, p in probs.items()])
