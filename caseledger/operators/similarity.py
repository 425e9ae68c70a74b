"""Lexical vectors and exact similarity joins inside blocks.

Vectors are sparse: an array of (dim, w) with unit length. A pair of unit vectors with a cosine of
at least t must share a dimension inside both of their prefixes, when dimensions are put in one
common order and a prefix is cut where the length of what follows drops below t. Joining on
(block, dimension) over prefixes therefore finds every such pair without comparing all of them,
and the rarest dimensions come first in the order, so few vectors meet. At a high t prefixes go on until
a pair must share two dimensions in them, and the join is on both.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..session import kept


def token_rows(texts: DataFrame, text: str) -> DataFrame:
    """Words, pairs of neighbours, and four-letter pieces of the whole, a row each.

    Every step is a column of its own, because an expression inside a lambda is evaluated again
    for each element.
    """
    n, m = F.size("_words"), F.length("_flat") - C.NGRAM_SIZE + 1
    empty = F.array().cast("array<int>")
    upto = lambda count: F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(empty)
    pairs = F.transform(
        upto(n - 1), lambda i: F.concat_ws(" ", F.get("_words", i - 1), F.get("_words", i))
    )
    pieces = F.transform(
        upto(m),
        lambda i: F.concat(F.lit("~"), F.substring(F.col("_flat"), i, F.lit(C.NGRAM_SIZE))),
    )
    return (
        texts.select(text)
        .withColumn("_words", F.filter(F.split(F.lower(text), "[^a-z0-9+#]+"), lambda w: w != ""))
        .withColumn("_flat", F.array_join("_words", " "))
        .select(text, F.explode(F.concat("_words", pairs, pieces)).alias("token"))
    )


def with_sparse_vector(df: DataFrame, text: str, name: str = "vector") -> DataFrame:
    """Add a hashed bag of tokens of unit length, as an array of (dim, w) ordered by dim.

    Built once per different text. A text without a token has an empty vector.
    """
    counted = token_rows(df.select(text).distinct(), text).groupBy(text, "token").agg(
        F.count("*").alias("_n")
    )
    is_piece = F.col("token").startswith("~")
    weight = (1 + F.ln("_n")) * F.when(is_piece, C.NGRAM_WEIGHT).otherwise(1.0)
    index = F.conv(F.substring(F.sha1(F.concat(F.lit("idx:"), "token")), 1, 6), 16, 10)
    sign = F.conv(F.substring(F.sha1(F.concat(F.lit("sign:idx:"), "token")), 1, 2), 16, 10)
    hashed = counted.select(
        text,
        (index.cast("int") % C.EMBEDDING_DIMS).alias("dim"),
        F.when(sign.cast("int") % 2 == 0, weight).otherwise(-weight).alias("w"),
    )
    # At most one entry for each dimension.
    summed = (
        hashed.groupBy(text, "dim").agg(F.sum("w").alias("w")).filter(F.col("w") != 0)
        .groupBy(text).agg(F.array_sort(F.collect_list(F.struct("dim", "w"))).alias("_sums"))
    )
    vectors = _with_unit(summed, "_sums", name).select(text, name)
    none = F.array().cast("array<struct<dim:int,w:double>>")
    return df.join(vectors, text, "left").withColumn(name, F.coalesce(name, none))


def _with_unit(df: DataFrame, raw: str, name: str) -> DataFrame:
    """Scale an array of (dim, w) to length one."""
    square = F.aggregate(raw, F.lit(0.0), lambda acc, p: acc + p["w"] * p["w"])
    # An empty vector has no length and stays empty.
    scaled = F.transform(
        raw, lambda p: F.struct(p["dim"].alias("dim"), (p["w"] / F.col("_norm")).alias("w"))
    )
    return df.withColumn("_norm", F.sqrt(square)).withColumn(name, scaled).drop("_norm")


def with_sparse_from_dense(df: DataFrame, values: str, name: str = "vector") -> DataFrame:
    """A sparse unit vector out of an array of numbers."""
    pairs = F.transform(
        values, lambda x, i: F.struct(i.cast("int").alias("dim"), x.cast("double").alias("w"))
    )
    raw = df.withColumn("_raw", F.filter(pairs, lambda p: p["w"] != 0))
    return _with_unit(raw, "_raw", name).drop("_raw")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; nothing is similar to an empty or zero vector."""
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    na = total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))
    nb = total(F.transform(b, lambda x: x.cast("double") * x.cast("double")))
    ok = (F.size(a) > 0) & (F.size(b) > 0) & (na > 0) & (nb > 0)
    return F.when(ok, dot / F.sqrt(na * nb)).otherwise(0.0)


def with_dot(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Cosine of two sparse unit vectors, with the one side looked up in the other."""
    total = F.aggregate(
        a,
        F.lit(0.0),
        lambda acc, p: acc + p["w"] * F.coalesce(F.col("_map")[p["dim"]], F.lit(0.0)),
    )
    # The second reference keeps the map a column of its own, built once per row.
    guarded = F.when(F.col("_map").isNotNull(), total)
    return df.withColumn("_map", F.map_from_entries(b)).withColumn(name, guarded).drop("_map")


#: From this cosine on vectors meet by two dimensions at once: prefixes are short there, so they have few twos.
PAIRED = 0.9


def _prefixes(vectors: DataFrame, block: list[str], rarity: DataFrame, t: float, twos: bool = False) -> DataFrame:
    """The dimensions of each vector that a partner above t can not avoid: one of them, or two where `twos` are asked for.

    One shared dimension adds at most its own square to what follows the prefix, so a prefix for twos is cut where both together
    drop below t.
    """
    parts = vectors.select(*block, "vec_id", F.explode("vector").alias("p")).select(
        *block, "vec_id", F.col("p.dim").alias("dim"), F.col("p.w").alias("w")
    )
    # One row per dimension that occurs. Spark sends it to all executors where it is small.
    ranked = parts.join(rarity, "dim")
    along = W.partitionBy(*block, "vec_id").orderBy("seen", "dim")
    bound = F.sum(F.col("w") * F.col("w")).over(along.rowsBetween(W.currentRow, W.unboundedFollowing))
    if twos:
        largest = F.max(F.col("w") * F.col("w")).over(along.rowsBetween(W.unboundedPreceding, -1))
        bound = bound + F.coalesce(largest, F.lit(0.0))
    return (
        ranked.withColumn("_bound", bound)
        # Slightly wide, so that rounding never loses a pair on the edge.
        .filter(F.col("_bound") >= t * t - 1e-9)
        .select(*block, "vec_id", "seen", "dim", (F.col("w") > 0).alias("up"))
    )


def _twos(prefixes: DataFrame, block: list[str]) -> DataFrame:
    """Every two dimensions of a prefix, in the common order, with their signs."""
    whole = prefixes.groupBy(*block, "vec_id").agg(F.array_sort(F.collect_list(F.struct("seen", "dim", "up"))).alias("_all"))
    first = whole.select(*block, "vec_id", "_all", F.posexplode("_all").alias("_at", "_a"))
    both = first.select(*block, "vec_id", "_a", F.explode(F.slice("_all", F.col("_at") + 2, F.size("_all"))).alias("_b"))
    return both.select(
        *block, "vec_id", F.col("_a.dim").alias("dim"), F.col("_a.up").alias("up"),
        F.col("_b.dim").alias("dim2"), F.col("_b.up").alias("up2"),
    )


def _candidates(left: DataFrame, right: DataFrame, block: list[str], rarity: DataFrame, t: float) -> DataFrame:
    """Pairs that may have a cosine of at least t: (block, left_id, right_id).

    What follows the prefixes adds less than t, so some shared dimension must pull the same way, or two of them. A vector
    that is nearly one dimension may share no other with its partner: such ones meet all others by one.
    """
    def met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        a, b = a.withColumnRenamed("vec_id", "left_id"), b.withColumnRenamed("vec_id", "right_id")
        return a.join(b, [*block, *on]).select(*block, "left_id", "right_id")

    ones = lambda df: _prefixes(df, block, rarity, t).drop("seen")
    if t < PAIRED:
        return met(ones(left), ones(right), ["dim", "up"]).distinct()
    narrow = F.exists("vector", lambda p: p["w"] * p["w"] >= t * t - 1e-9)
    two = lambda df: _twos(_prefixes(df.filter(~narrow), block, rarity, t, twos=True), block)
    return (
        met(two(left), two(right), ["dim", "up", "dim2", "up2"])
        .unionByName(met(ones(left.filter(narrow)), ones(right), ["dim", "up"]))
        .unionByName(met(ones(left.filter(~narrow)), ones(right.filter(narrow)), ["dim", "up"]))
        .distinct()
    )


def similar_pairs(
    left: DataFrame, right: DataFrame, block: list[str], t: float
) -> DataFrame:
    """All pairs of a block with a cosine of at least t: (block, left_id, right_id, cosine).

    `left` and `right`: block columns, vec_id, vector. Vectors should be distinct within a block:
    equal ones are better counted once and expanded afterwards. From `PAIRED` on the vectors are read several times.
    """
    both = left.select("vector").unionByName(right.select("vector"))
    rarity = (
        both.select(F.explode("vector.dim").alias("dim"))
        .groupBy("dim")
        .agg(F.count("*").alias("seen"))
    )
    candidates = _candidates(left, right, block, rarity, t)
    lv = left.select(*block, F.col("vec_id").alias("left_id"), F.col("vector").alias("_a"))
    rv = right.select(*block, F.col("vec_id").alias("right_id"), F.col("vector").alias("_b"))
    met = candidates.join(lv, [*block, "left_id"]).join(rv, [*block, "right_id"])
    return (
        with_dot(met, "_a", "_b", "cosine")
        .select(*block, "left_id", "right_id", "cosine")
        .filter(F.col("cosine") >= t)
    )


#: From high to low: where a top-k search looks first, and where it goes on for what is still open.
BOUNDS = (0.8, 0.6, 0.4, 0.25)


def top_pairs(
    left: DataFrame, right: DataFrame, block: list[str], k: int, bounds: tuple[float, ...] = BOUNDS
) -> DataFrame:
    """Pairs of a block among which the k best of every left vector are: (block, left_id, right_id, cosine).

    `right` has a column n: for how many items its vector stands. The bound starts high. A left vector is settled once the
    pairs at the bound or above stand for k items, as no pair that was not looked at can be better; the others
    go on to the next bound. What no bound settles is compared along every dimension it shares, and with what shares none only
    if fewer than k items are similar to it at all.
    """
    many = right.select(*block, F.col("vec_id").alias("right_id"), "n")
    open_, found = kept(left.select(*block, "vec_id", "vector")), []
    this = [*block, "left_id"]
    vectors = right.select(*block, "vec_id", "vector")
    for t in bounds:
        if open_.isEmpty():
            break
        pairs = kept(similar_pairs(open_, vectors, block, t))
        done = kept(
            pairs.join(many, [*block, "right_id"]).groupBy(*this).agg(F.sum("n").alias("_n")).filter(F.col("_n") >= k).select(*this)
        )
        found.append(pairs.join(done, this, "left_semi"))
        open_ = kept(open_.join(done.withColumnRenamed("left_id", "vec_id"), [*block, "vec_id"], "left_anti"))
    if not open_.isEmpty():
        pairs = kept(_touching(open_, vectors, block))
        found.append(pairs)
        above = pairs.filter("cosine > 0").join(many, [*block, "right_id"]).groupBy(*this).agg(F.sum("n").alias("_n"))
        alone = open_.select(*block, F.col("vec_id").alias("left_id")).join(above.filter(F.col("_n") >= k), this, "left_anti")
        others = alone.join(many.select(*block, "right_id"), block).join(pairs.select(*this, "right_id"), [*this, "right_id"], "left_anti")
        found.append(others.select(*this, "right_id", F.lit(0.0).alias("cosine")))
    none = similar_pairs(left.limit(0), vectors, block, 1.0)
    out = none
    for pairs in found:
        out = out.unionByName(pairs)
    return out


def _touching(left: DataFrame, right: DataFrame, block: list[str]) -> DataFrame:
    """All pairs of a block that share a dimension, with their cosine."""
    parts = lambda df, name, w: df.select(
        *block, F.col("vec_id").alias(name), F.explode("vector").alias("p")
    ).select(*block, name, F.col("p.dim").alias("dim"), F.col("p.w").alias(w))
    met = parts(left, "left_id", "_a").join(parts(right, "right_id", "_b"), [*block, "dim"])
    pairs = met.select(*block, "left_id", "right_id").distinct()
    lv = left.select(*block, F.col("vec_id").alias("left_id"), F.col("vector").alias("_a"))
    rv = right.select(*block, F.col("vec_id").alias("right_id"), F.col("vector").alias("_b"))
    both = pairs.join(lv, [*block, "left_id"]).join(rv, [*block, "right_id"])
    return with_dot(both, "_a", "_b", "cosine").select(*block, "left_id", "right_id", "cosine")
