"""Operator 11: hard negatives by coordinate pruning over length buckets.

Vectors are laid out by length, the longest first, and cut into blocks of bounded size; inside a block, buckets of
neighbouring lengths hold every coordinate of their unit vectors as a sorted list. An anchor whose best rows so far set a
threshold asks a bucket only if the product of the lengths can reach it. It then takes its largest coordinates (the focus), works
out which values a row above the threshold may have there, and intersects what the lists hold in those ranges. Only the rows of
the intersection are scored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import top_per_key
from .shared import stored

#: Lengths of one step of the layout differ by at most this factor, so a table has a few thousand steps at most.
_STEP = 1.05
#: What rounding may add to a bound on a product or on a coordinate.
_SLACK = 1e-6
#: Sums of whole numbers below this are exact in doubles.
_EXACT = 2.0**53
#: Components beyond count as this, so that no sum overflows.
_HUGE = 1e150
_LONG = 9.2233720368547e18


@dataclass(frozen=True)
class Search:
    """How a block of rows is searched."""

    #: Most rows of a bucket, all neighbours in length.
    bucket_rows: int = 1024
    #: A bucket ends where lengths fall below this share of its longest, unless it is smaller than `least_rows`.
    shortest_share: float = 0.9
    least_rows: int = 64
    #: Largest coordinates of an anchor whose lists are intersected.
    focus: int = 4
    #: A bucket of which the shortest range leaves more than this share is scored whole.
    whole_share: float = 0.5


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = 256,
    block_rows: int = 4096,
    search: Search = Search(),
) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchors` is a condition on the columns of `vectors`; where it is null a row is no anchor. A component x counts as
    floor(scale * x), a score is the inner product. An anchor's positives are its first `positives` other rows of the same label; for
    each of them the negatives are the first `negatives` rows of another label whose score is from low_percent to high_percent of the
    positive's. Higher scores come first, ties by smaller id. A positive without any such row gives no rows.

    Rows whose id, label or vector is null, or that hold a null or non-finite component, take no part. Rows that repeat id,
    label and vector are one row; rows that share only the id are rows of their own, but none is the other's positive.
    Vectors of different length never meet. Zero and empty vectors take part with a score of 0. Scores below 2**53 are exact; beyond
    they are sums in doubles in the order of the components, and come out within a long. Other columns are not
    read. An empty table gives no rows.

    No task holds more than a block of rows and a block of anchors, about `block_rows` each, whatever label, length
    or vector is frequent. A task returns the first rows of each anchor only.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    once = given.groupBy("id", "label", "v").agg(F.bool_or("asks").alias("asks"))
    # Scaled by the largest component, so that no square overflows; floor() lengthens a component by less than one.
    once = once.withColumn("most", F.greatest(F.array_max(F.transform("v", F.abs)), F.lit(1e-300)))
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + (x / F.col("most")) * (x / F.col("most")))
    length = F.least(F.col("most"), F.lit(_HUGE)) * scale * F.sqrt(square) + F.sqrt(F.size("v").cast("double"))
    rows = stored(
        once.select(
            "id", F.xxhash64("id", "label", "v").alias("uid"), "label", "v", "asks", F.size("v").alias("dim"),
            F.coalesce(length, F.lit(0.0)).alias("length"),
        ),
        "vectors",
    )
    probes = stored(_laid_out(rows, block_rows), "blocks")
    blocks = probes.groupBy("dim", "block").agg(F.max("length").alias("longest"))
    asking = rows.filter("asks")
    sizes = stored(
        asking.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
        .join(blocks.groupBy("dim").agg((F.max("block") + 1).alias("blocks")), "dim"),
        "sizes",
    )
    asking = stored(
        asking.join(sizes, "dim").withColumn("part", F.pmod(F.xxhash64("uid", F.lit("part")), F.col("parts")).cast("int"))
        .select("dim", "part", "blocks", "id", "uid", "label", "v", "length"),
        "anchors",
    )
    met = probes.join(sizes, "dim").select(
        "dim", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"),
        "id", "uid", "label", "v", F.lit(None).cast("array<double>").alias("targets"),
    )

    def searched(requests: DataFrame, same: bool, k: int, what: str) -> DataFrame:
        """The first k rows of each block for every request: (anchor, uid, request, other, score)."""

        def task(key: tuple, table: pa.Table) -> pa.Table:
            return _searched(table, same=same, k=k, scale=scale, percent=(low_percent, high_percent), how=search)

        asked = requests.select(
            "dim", "block", "part", F.lit(True).alias("asks"), "id", "uid", "label", "v", "targets"
        )
        return stored(met.unionByName(asked).groupBy("dim", "block", "part").applyInArrow(task, _SCHEMA), what)

    everywhere = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = searched(everywhere.withColumn("targets", F.lit(None).cast("array<double>")), True, positives, "positives")
    first = [F.col("score").desc(), F.col("other")]
    best = stored(
        top_per_key(found, ["anchor", "uid"], first, positives, "nth").select(
            "anchor", "uid", F.col("nth").alias("request"), F.col("other").alias("positive"), F.col("score").alias("target")
        ),
        "positives",
    )
    # At most `positives` of an anchor.
    targets = best.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("request", "target")))["target"].alias("targets"))
    lowest = F.array_min("targets") * low_percent / 100
    # A block whose longest row can't reach the lowest score asked for is not asked.
    reaches = F.col("length") * F.col("longest") * (1 + _SLACK) >= lowest
    asks = everywhere.join(targets, "uid").join(blocks, ["dim", "block"]).filter(reaches)
    found = searched(asks, False, negatives, "negatives")
    ranked = top_per_key(found, ["anchor", "uid", "request"], first, negatives, "rank")
    whole = lambda c: F.greatest(F.least(F.col(c), F.lit(_LONG)), F.lit(-_LONG)).cast("long")
    return ranked.select("uid", "request", "rank", "other", "score").join(best, ["uid", "request"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"), whole("target").alias("positive_score"), whole("score").alias("negative_score"),
    )


def _laid_out(rows: DataFrame, block_rows: int) -> DataFrame:
    """Every row in a block of about `block_rows` rows, by falling length.

    Lengths are cut into steps of a fixed factor and only the rows of a step are counted; a step larger than a block
    is dealt over as many as it needs.
    """
    stepped = rows.withColumn("step", F.floor(F.ln(F.col("length") + 1) / F.ln(F.lit(_STEP))).cast("int"))
    before = W.partitionBy("dim").orderBy(F.col("step").desc()).rowsBetween(W.unboundedPreceding, -1)
    steps = stored(
        stepped.groupBy("dim", "step").agg(F.count("*").alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))),
        "steps",
    )
    share = F.pmod(F.xxhash64("uid", F.lit("block")), F.lit(1 << 30)) / float(1 << 30)
    return stepped.join(steps, ["dim", "step"]).select(
        "dim", F.floor((F.col("start") + share * F.col("n")) / block_rows).cast("int").alias("block"),
        "id", "uid", "label", "v", "length",
    )


_SCHEMA = "anchor long, uid long, request int, other long, score double"
_FOUND = [("anchor", pa.int64()), ("uid", pa.int64()), ("request", pa.int32()), ("other", pa.int64()), ("score", pa.float64())]


def _whole_numbers(table: pa.Table, scale: int) -> np.ndarray:
    lists = table["v"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    raw = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.empty((0, 0))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(raw * scale), -_HUGE, _HUGE)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of both. Where a sum may pass 2**53, components are added in their order."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return a @ b.T
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += a[:, j, None] * b[None, :, j]
    return out


def lengths(rows: np.ndarray) -> np.ndarray:
    most = np.maximum(np.abs(rows).max(axis=1, initial=0), 1)
    scaled = rows / most[:, None]
    return most * np.sqrt((scaled * scaled).sum(axis=1))


class Bucket:
    """Rows of neighbouring lengths with every coordinate of their unit vectors as a sorted list."""

    def __init__(self, rows: np.ndarray, size: np.ndarray):
        self.rows = rows
        self.longest = float(size.max())
        unit = rows / np.maximum(size, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.values = np.take_along_axis(unit, self.order, axis=0)
        self.places = np.empty_like(self.order)
        np.put_along_axis(self.places, self.order, np.arange(len(rows))[:, None], axis=0)

    def ranges(self, unit: np.ndarray, focus: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and focus coordinate, the part of the list with the values of rows at that cosine or above.

        Rows and the axis of the coordinate are directions: a row within an angle of the anchor is at least the difference and at
        most the sum of both angles away from the axis.
        """
        own = np.take_along_axis(unit, focus, axis=1)
        to_axis, to_row = np.arccos(np.clip(own, -1, 1)), np.arccos(np.clip(cosine, -1, 1))[:, None]
        low = np.cos(np.minimum(to_axis + to_row, np.pi)) - _SLACK
        high = np.cos(np.maximum(to_axis - to_row, 0)) + _SLACK
        starts, ends = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            starts[at] = np.searchsorted(self.values[:, f], low[at], "left")
            ends[at] = np.searchsorted(self.values[:, f], high[at], "right")
        return starts, ends

    def within(self, focus: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rows in all ranges of one anchor, from the shortest list on."""
        order = np.argsort(ends - starts)
        one = order[0]
        rows = self.order[starts[one] : ends[one], focus[one]]
        for i in order[1:]:
            place = self.places[rows, focus[i]]
            rows = rows[(place >= starts[i]) & (place < ends[i])]
        return rows


def cuts(size: np.ndarray, how: Search) -> list[int]:
    """Where buckets begin and end among falling lengths."""
    at = [0]
    while at[-1] < len(size):
        alike = int(np.searchsorted(-size, -how.shortest_share * size[at[-1]], "right"))
        at.append(min(max(alike, at[-1] + how.least_rows), at[-1] + how.bucket_rows, len(size)))
    return at


def candidates(
    bucket: Bucket, unit: np.ndarray, size: np.ndarray, focus: np.ndarray, least: np.ndarray, how: Search
) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(anchors that have to see the whole bucket, (anchor, its rows) for the others). Anchors that can't reach their threshold are in neither."""
    reach = size * bucket.longest
    alive = np.flatnonzero(reach * (1 + _SLACK) >= least)
    prunable = (least[alive] > 0) & (focus.shape[1] > 0)
    whole, some = [alive[~prunable]], alive[prunable]
    listed: list[tuple[int, np.ndarray]] = []
    if len(some):
        starts, ends = bucket.ranges(unit[some], focus[some], least[some] / reach[some] - _SLACK)
        wide = (ends - starts).min(axis=1) > how.whole_share * len(bucket.rows)
        whole.append(some[wide])
        for i in np.flatnonzero(~wide):
            listed.append((int(some[i]), bucket.within(focus[some[i]], starts[i], ends[i])))
    return np.concatenate(whole), listed


def _searched(table: pa.Table, *, same: bool, k: int, scale: int, percent: tuple[int, int], how: Search) -> pa.Table:
    asks = table["asks"].to_numpy()
    probes, queries = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
    if not probes.num_rows or not queries.num_rows:
        return pa.table({name: pa.array([], kind) for name, kind in _FOUND})
    rows, anchors = _whole_numbers(probes, scale), _whole_numbers(queries, scale)
    row_size, size = lengths(rows), lengths(anchors)
    longest_first = np.argsort(-row_size, kind="stable")
    rows, row_size = rows[longest_first], row_size[longest_first]
    ids = probes["id"].to_numpy()[longest_first]
    names = {name: i for i, name in enumerate(dict.fromkeys(probes["label"].to_pylist() + queries["label"].to_pylist()))}
    labels = np.array([names[x] for x in probes["label"].to_pylist()])[longest_first]
    own_ids, own_labels = queries["id"].to_numpy(), np.array([names[x] for x in queries["label"].to_pylist()])
    unit = anchors / np.maximum(size, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, : how.focus]
    targets = [None] * len(own_ids) if same else queries["targets"].to_pylist()
    #: Of every anchor and request: the scores and ids found so far, best first, and the score that the next one needs.
    best = [[(np.empty(0), np.empty(0, np.int64))] * (1 if same else len(t)) for t in targets]
    needs = [np.array([-np.inf]) if same else np.array(t) * percent[0] / 100 for t in targets]
    least = np.array([n.min() for n in needs])

    def offer(a: int, at: np.ndarray, score: np.ndarray) -> None:
        keep = score >= least[a]
        keep &= (labels[at] == own_labels[a]) & (ids[at] != own_ids[a]) if same else labels[at] != own_labels[a]
        if not keep.any():
            return
        score, other = score[keep], ids[at[keep]]
        for r in range(len(best[a])):
            fits = score >= needs[a][r]
            if not same:
                target = targets[a][r]
                fits &= (percent[0] * target <= 100 * score) & (100 * score <= percent[1] * target)
            if not fits.any():
                continue
            all_scores, all_ids = np.concatenate([best[a][r][0], score[fits]]), np.concatenate([best[a][r][1], other[fits]])
            order = np.lexsort((all_ids, -all_scores))[:k]
            best[a][r] = all_scores[order], all_ids[order]
            if len(order) == k:
                needs[a][r] = all_scores[order[-1]]
        least[a] = needs[a].min()

    at = cuts(row_size, how)
    for start, end in zip(at, at[1:], strict=False):
        bucket = Bucket(rows[start:end], row_size[start:end])
        whole, listed = candidates(bucket, unit, size, focus, least, how)
        every = np.arange(start, end)
        for part in range(0, len(whole), 512):
            some = whole[part : part + 512]
            for a, score in zip(some, scores(anchors[some], bucket.rows), strict=True):
                offer(a, every, score)
        for a, inside in listed:
            if len(inside):
                offer(a, start + inside, scores(anchors[a : a + 1], bucket.rows[inside])[0])
    uids = queries["uid"].to_numpy()
    flat = [
        (own_ids[a], uids[a], r + 1, i, s)
        for a, found in enumerate(best) for r, (got, who) in enumerate(found) for s, i in zip(got, who, strict=True)
    ]
    columns = zip(*flat, strict=True) if flat else [[]] * len(_FOUND)
    return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(_FOUND, columns, strict=True)})
