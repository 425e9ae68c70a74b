"""Operator 1: mix sources to target weights, in DataFrame functions only.

The words of a source, document after document, are cut into blocks of fixed length. An output
shard has a fixed number of slots and draws how many of them each source fills (a multinomial draw);
draws beyond what a source may give are handed to sources that were drawn too rarely, so totals are
met exactly. The slots of a source run through pseudorandom permutations of its block numbers, a new
one for each pass over the source, and blocks are joined by their number.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD_AND_GAP, n_words, stored

_ROUNDS = 24
#: Shards of a run when the slots of a source are numbered.
_RUN = 4096


def permuted(x: Column, n: Column, *key: Column, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0 … n-1, one per key, in closed form (swap or not).

    Each round pairs every number with its mirror image about a keyed centre, and a keyed bit of the pair
    decides whether the two change places. A round undoes itself, so the inverse runs them backwards.
    """
    rounds = range(_ROUNDS - 1, -1, -1) if inverse else range(_ROUNDS)
    size = F.greatest(n, F.lit(1)).cast("long")

    def step(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit("centre"), r, *key), size) - at, size)
        swap = F.xxhash64(F.lit("bit"), r, *key, F.greatest(at, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), x.cast("long"), step)


def located(points: DataFrame, p: str, total: int, intervals: DataFrame, start: str, length: str, cells: int) -> DataFrame:
    """Join every point with the interval that holds it. Intervals tile 0 … total-1.

    The line is cut into cells; an interval is listed in each cell that it touches, a point looks in its own.
    """
    if total < 1:
        return points.withColumn("_cell", F.lit(0).cast("long")).join(
            intervals.filter(F.lit(False)).withColumn("_cell", F.lit(0).cast("long")), "_cell"
        ).drop("_cell")

    def cell(x: Column) -> Column:
        return F.floor(x * F.lit(min(cells, total)) / F.lit(total)).cast("long")

    end = F.col(start) + F.col(length)
    listed = intervals.filter(F.col(length) > 0).withColumn(
        "_cell", F.explode(F.sequence(cell(F.col(start)), cell(end - 1)))
    )
    inside = (F.col(p) >= F.col(start)) & (F.col(p) < end)
    return points.withColumn("_cell", cell(F.col(p))).join(listed, "_cell").filter(inside).drop("_cell")


@dataclass
class Mix:
    """`sources`: one row per source with its target; `slots`: which block each slot of each shard holds;
    `rows`: one row per document with its place and the words taken from it."""

    sources: DataFrame
    slots: DataFrame
    rows: DataFrame


def source_targets(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sid, source, source_size, n_docs, target: shares by weight, at most `most` times a source's size.

    Sources are ordered by code point, null last, and take the weights in turn. What a source cannot
    give is shared by weight among the others until none is above. With sources in the order of size
    per weight, those at their limit come first, so running sums find them in one pass.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_limit = W.orderBy("limit_per_weight", "sid")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        per.withColumn("sid", turn.cast("long"))
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("limit_per_weight", F.col("limit") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(whole).cast("double"))
        .withColumn("full", level >= F.col("limit_per_weight"))
        .withColumn("rest", F.col("all") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(whole))
        .withColumn("shares", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole))
        .withColumn(
            "target",
            F.when(F.col("full"), F.col("limit")).otherwise(
                F.col("rest") * F.col("weight") / F.when(F.col("shares") > 0, F.col("shares")).otherwise(1.0)
            ),
        )
        .select("sid", "source", "source_size", "n_docs", "target")
    )


def _quotas(targets: DataFrame, block_words: int, most: int) -> DataFrame:
    """How many slots each source fills: whole passes over its blocks and some blocks of a last one.

    The last block of a source is shorter; where the permutation of the last pass puts it decides how many
    blocks reach the target. `cut` is the number of words that the very last slot takes too many.
    """
    B = F.lit(block_words)
    S, n = F.col("source_size"), F.col("n_blocks")
    short = n * B - S
    k_plain = F.ceil(F.col("rest") / B).cast("long")
    k_short = F.ceil((F.col("rest") + short) / B).cast("long")
    k = F.when(k_plain <= F.col("short_at"), k_plain).otherwise(k_short)
    reached = F.col("k") * B - F.when(F.col("k") > F.col("short_at"), short).otherwise(0)
    along = W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    return (
        targets.withColumn("wanted", F.least(F.round("target").cast("long"), S * most))
        .withColumn("passes", F.when(S > 0, F.expr("wanted div greatest(source_size, 1)")).otherwise(0))
        .withColumn("rest", F.col("wanted") - F.col("passes") * S)
        .withColumn("n_blocks", F.ceil(S / B).cast("long"))
        .withColumn("short_at", permuted(F.greatest(n - 1, F.lit(0)), n, F.col("sid"), F.col("passes"), inverse=True))
        .withColumn("k", F.when(F.col("rest") > 0, k).otherwise(0))
        .withColumn("cut", F.when(F.col("k") > 0, reached - F.col("rest")).otherwise(0))
        .withColumn("quota", F.col("passes") * n + F.col("k"))
        .withColumn("quota_start", F.coalesce(F.sum("quota").over(along), F.lit(0)))
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    block_words: int = 512,
    shard_slots: int = 1024,
    seed: int = 11,
) -> Mix:
    """Mix all documents to the targets of their sources. Same rows and seed, same mix.

    Words are maximal runs other than ASCII white space; null and empty texts have none and nothing is taken
    from them. Null is a source of its own and so is the empty text. Null ids and repeated rows
    each have a place. Without any words all targets are 0 and there are no slots. Other columns are not read.
    """
    spark = docs.sparkSession
    sized = stored(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            n_words(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(text_col)).alias("digest"),
        ),
        "sizes",
    )
    sources = stored(_quotas(source_targets(sized, weights, most), block_words, most), "sources")
    n_docs, n_sources, total = sources.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)), F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))
    ).first()
    slots = stored(_slots(spark, sources, total, 4 * n_sources, shard_slots, seed), "slots")
    placed = stored(_placed(sized, sources, max(1, math.isqrt(n_docs))), "places")
    return Mix(sources, slots, _taken(placed, slots, block_words))


def _slots(spark: SparkSession, sources: DataFrame, total: int, cells: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, sid, j (the slot's number within its source), pass_, block, words_off."""
    drawn = located(
        spark.range(total).select(
            F.floor(F.col("id") / shard_slots).alias("shard"),
            F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(total, 1))).alias("p"),
        ),
        "p", total, sources.select("sid", "quota_start", "quota"), "quota_start", "quota", cells,
    )
    counts = stored(drawn.groupBy("shard", "sid").agg(F.count("*").alias("c")), "counts")
    # What each source was drawn too often and too rarely, laid end to end.
    along = W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
    balance = (
        sources.join(counts.groupBy("sid").agg(F.sum("c").alias("drawn")), "sid", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)))
        .withColumn("under", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
        .withColumn("over_start", F.coalesce(F.sum("over").over(along), F.lit(0)))
        .withColumn("under_start", F.coalesce(F.sum("under").over(along), F.lit(0)))
        .select("sid", "quota", "drawn", "under", "over_start", "under_start")
    )
    balance = stored(balance, "balance")
    moved = balance.agg(F.coalesce(F.sum("under"), F.lit(0))).first()[0]
    # Dealt anew by source and shard before they are written out: the slots of one source are many tasks.
    numbered = (
        _numbered(counts).join(balance, "sid")
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sid", "shard")
        .withColumn("j", F.explode(F.expr("sequence(first, first + c - 1)")))
    )
    kept = numbered.filter("j < quota").select("shard", "sid", "j")
    surplus = numbered.filter("j >= quota").select(
        "shard",
        permuted(F.col("over_start") + F.col("j") - F.col("quota"), F.lit(moved), F.lit(seed), F.lit(-1)).alias("p"),
    )
    refilled = located(
        surplus, "p", moved, balance.select("sid", "drawn", "under_start", "under"), "under_start", "under", cells
    ).select("shard", "sid", (F.col("drawn") + F.col("p") - F.col("under_start")).alias("j"))
    plan = kept.unionByName(refilled).join(
        sources.select("sid", "n_blocks", "passes", "quota", "cut"), "sid"
    ).withColumn("pass_", F.expr("j div greatest(n_blocks, 1)"))
    block = permuted(F.col("j") % F.greatest("n_blocks", F.lit(1)), F.col("n_blocks"), F.col("sid"), F.col("pass_"))
    return plan.select(
        "shard", "sid", "j", "pass_", block.alias("block"), (F.col("pass_") == F.col("passes")).alias("in_last"),
        F.when(F.col("j") == F.col("quota") - 1, F.col("cut")).otherwise(0).alias("words_off"),
    )


def _numbered(counts: DataFrame) -> DataFrame:
    """counts with `first`, the slots of the source in earlier shards: sums over runs of shards, and within a run."""
    runs = counts.withColumn("run", F.floor(F.col("shard") / _RUN))
    before = W.partitionBy("sid").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    bases = stored(
        runs.groupBy("sid", "run").agg(F.sum("c").alias("n")).select("sid", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")),
        "runs",
    )
    earlier = W.partitionBy("sid", "run").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    within = runs.withColumn("within", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    return within.join(bases, ["sid", "run"]).select("shard", "sid", "c", (F.col("base") + F.col("within")).alias("first"))


def _placed(sized: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """Every document with the number of words of its source before it.

    Documents are dealt into buckets by a hash; sums over buckets and within them replace one long
    running sum, so a large source is many tasks. Their number is the root of the number of documents: both
    sums stay short.
    """
    dealt = sized.join(
        sources.select(F.col("source").alias("source_"), "sid", "source_size", "target", "passes"),
        F.col("source").eqNullSafe(F.col("source_")),
    ).drop("source_").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    earlier = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).select(
        "sid", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")
    )
    inside = W.partitionBy("sid", "bucket").orderBy("id", "size", "digest")
    return dealt.select(
        "*", F.row_number().over(inside).alias("nth"),
        F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("within"),
    ).join(bases, ["sid", "bucket"]).select(
        "id", "source", "size", "digest", "sid", "source_size", "target", "passes", "bucket", "nth",
        (F.col("base") + F.col("within")).alias("start"),
    )


def _taken(placed: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """The documents with `taken`, and `spans`: the words that the last, partial pass takes."""
    B = F.lit(block_words)
    takes = slots.groupBy("sid", "block").agg(
        F.sum(F.when((F.col("words_off") == 0) & ~F.col("in_last"), 1).otherwise(0)).alias("whole"),
        F.max(F.when(F.col("in_last"), F.col("words_off"))).alias("off"),
    )
    S = F.col("source_size")
    parts = placed.filter("size > 0").select(
        "sid", "bucket", "nth", "start", "size", "source_size",
        F.explode(F.sequence(F.floor(F.col("start") / B), F.floor((F.col("start") + F.col("size") - 1) / B))).alias("block"),
    ).join(takes, ["sid", "block"])
    low = F.greatest(F.col("start"), F.col("block") * B)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * B)
    block_end = F.least((F.col("block") + 1) * B, S)
    last = F.when(F.col("off").isNotNull(), F.greatest(F.least(high, block_end - F.col("off")) - low, F.lit(0))).otherwise(0)
    parts = parts.select(
        "sid", "bucket", "nth", (F.col("whole") * (high - low) + last).alias("part"), last.alias("last"),
        (low - F.col("start")).alias("from"),
    )
    sums = parts.groupBy("sid", "bucket", "nth").agg(
        F.sum("part").alias("taken"),
        F.sort_array(F.collect_list(F.when(F.col("last") > 0, F.struct("from", F.col("last").alias("words"))))).alias("spans"),
    )
    return placed.join(sums, ["sid", "bucket", "nth"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    chars_col: str | None = "n_chars", **how,
) -> DataFrame:
    """The mixed corpus with the columns of the documents: a row per pass over a document.

    Whole passes repeat the document as it is; the last pass keeps the words it took, with the white
    space after each. Documents that the mix takes nothing from are left out.
    """
    rows = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).rows.filter("taken > 0")
    key = ["id", "source", "digest"]
    told = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col)).alias("digest"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
    )
    plan = rows.select(*key, F.struct("start", "passes", "spans").alias("plan"))
    # A document and its plan are brought together under one key by a single exchange, as the texts are most of what moves. Rows
    # alike in id, source and text take their plans in turn.
    dealt = told.unionByName(plan, allowMissingColumns=True).repartition(*key).withColumn("is_plan", F.col("plan").isNotNull())
    turns = dealt.withColumn("nth", F.row_number().over(W.partitionBy(*key, "is_plan").orderBy("plan.start")))
    met = turns.withColumn("plan", F.max("plan").over(W.partitionBy(*key, "nth"))).filter(~F.col("is_plan") & F.col("plan").isNotNull())
    passes, spans, text = F.col("plan.passes"), F.col("plan.spans"), F.col("doc")[text_col]
    words = F.regexp_extract_all(text, F.lit(WORD_AND_GAP), F.lit(0))
    kept = F.transform(spans, lambda s: F.array_join(F.slice(words, (s["from"] + 1).cast("int"), s["words"].cast("int")), ""))
    copies = F.concat(
        F.when(passes > 0, F.array_repeat(F.lit(False), passes.cast("int"))).otherwise(F.array().cast("array<boolean>")),
        F.when(F.size(spans) > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")),
    )
    out = met.withColumn("part", F.explode(copies)).withColumn("taken", F.when(F.col("part"), F.array_join(kept, "")).otherwise(text))
    made = {text_col: F.col("taken")}
    if chars_col in docs.columns:
        made[chars_col] = F.length("taken").cast(docs.schema[chars_col].dataType)
    return out.select(*[made.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
