"""Operator 7: near duplicates of texts by SuperMinHash, banding, verification and union-find.

Signatures come from one pass over the texts. Texts with equal shingle sets are one node from
then on. In every band bucket the members are compared with a few leaders, which is linear in the
bucket; only members that this leaves in other components than the bucket's main one are compared
with the rest, block by block. Each link is confirmed on the whole sets.
"""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import as_bytes, fresh, stored
from .superminhash import band_keys, set_digest, shingles, signatures

_LEADERS = 3
_BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10GB",
}
#: Members of one comparison task: bounds a task, not what is compared.
_LEFT, _RIGHT = 256, 512


def bands_for(percent: int, rows: int, miss: float) -> int:
    """Bands of `rows` places so that a pair at the threshold is missed with chance `miss`."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    rows: int = 4,
    miss: float = 1e-6,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |A ∩ B| >= percent * |A ∪ B| for their sets of distinct
    word shingles. component_id is the smallest id reachable over links, kept is id = component_id.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing.
    A text shorter than `width` words is one shingle. Equal ids are one node and share their links. A
    null id is linked with nothing, its component is null and it is kept. Other columns are not read;
    an empty table gives an empty one.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bands = bands_for(percent, rows, miss)
    signed = stored(
        source.mapInArrow(
            _signer(width, bands, rows), "id long, n long, one long, two long, bands array<long>"
        ),
        "signatures",
    )
    with_words = signed.filter("id IS NOT NULL AND n > 0")
    nodes = stored(
        with_words.groupBy("n", "one", "two").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "nodes"
    )
    copies = (
        with_words.select("id", "n", "one", "two")
        .join(nodes.select("n", "one", "two", "rep"), ["n", "one", "two"])
        .filter("id <> rep")
        .select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    members = stored(_in_buckets(nodes), "buckets")
    sets = stored(_sets(source, members, width), "sets")
    links = stored(copies.unionByName(_confirmed(_led(members), sets, percent)), "links")
    found = components(links)
    left = stored(_left_over(members, found), "open-buckets")
    if not left.isEmpty():
        more = _compared(left, sets, percent)
        stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = components(stars.unionByName(more))
    out = signed.select("id", F.col("n").alias("n_shingles")).join(stored(found, "components"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that stay: of each group the one with the smallest id, with all its columns.

    Of rows with equal ids one stays, the first by text. Rows with a null id all stay.
    """
    kept = near_duplicates(docs, id_col=id_col, **how).filter("kept").select(
        F.col(id_col).alias("id")
    ).filter("id IS NOT NULL").distinct()
    text, order = how.get("text_col", "text"), fresh(docs, "nth")
    whole = F.struct(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns])
    named = docs.filter(F.col(id_col).isNotNull())
    kept_rows = named.join(kept, named[id_col] == kept["id"], "left_semi")
    repeated = named.groupBy(id_col).agg(F.count("*").alias(order)).filter(F.col(order) > 1).select(id_col)
    single = kept_rows.join(repeated, id_col, "left_anti").select(docs.columns)
    again = (
        kept_rows.join(repeated, id_col, "left_semi")
        .groupBy(id_col)
        .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col(text), whole)).alias(order))
        .select(f"{order}.*")
        .select(docs.columns)
    )
    return single.unionByName(again).unionByName(docs.filter(F.col(id_col).isNull()))


def _signer(width: int, bands: int, rows: int):
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in as_bytes(batch.column(1))]
            keys = band_keys(signatures(sets, bands * rows), rows)
            digests = [set_digest(s) for s in sets]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            offsets = np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))),
                ],
                ["id", "n", "one", "two", "bands"],
            )

    return sign


def _in_buckets(nodes: DataFrame) -> DataFrame:
    """(key, rep, n) of the buckets that hold two nodes or more, with their leaders.

    Most buckets hold one node. Their rows are told by equal ends, before anything else is gathered.
    """
    spread = nodes.select("rep", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    # What is gathered per bucket is stored before it is joined, so that a bucket with very many members can be split.
    shared = stored(shared.select("key"), "buckets")
    members = stored(spread.join(shared, "key").join(nodes.select("rep", "n"), "rep"), "members")
    leaders = [
        F.min_by(F.struct("rep", "n"), F.xxhash64("rep", F.lit(k))).alias(f"leader_{k}") for k in range(_LEADERS)
    ]
    return members.join(stored(members.groupBy("key").agg(F.count("*").alias("size"), *leaders), "leaders"), "key")


def _led(members: DataFrame) -> DataFrame:
    leader = F.explode(F.array_distinct(F.array(*[f"leader_{k}" for k in range(_LEADERS)]))).alias("leader")
    pairs = members.select("rep", "n", leader)
    return pairs.select(
        F.least("rep", "leader.rep").alias("a"), F.greatest("rep", "leader.rep").alias("b"),
        F.least("n", "leader.n").alias("small"), F.greatest("n", "leader.n").alias("large"),
    ).filter("a <> b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    # |A ∩ B| is at most the smaller size and |A ∪ B| at least the larger one.
    wanted = pairs.filter(100 * F.col("small") >= percent * F.col("large")).select("a", "b").distinct()
    one = sets.select(F.col("id").alias("a"), F.col("hashes").alias("of_a"))
    two = sets.select(F.col("id").alias("b"), F.col("hashes").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - both
    return wanted.join(one, "a").join(two, "b").filter(100 * both >= percent * union).select("a", "b")


def _sets(source: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """The whole shingle sets of the nodes that share a bucket with another one.

    Few texts are wanted. A Bloom filter of the wanted ids, of bounded size, is sent to the scan and
    drops most of the others before the shuffle; the join drops the rest.
    """
    spark = source.sparkSession
    for key, value in _BLOOM.items():
        spark.conf.set(key, value)
    wanted = stored(members.groupBy("rep").agg(F.count("*").alias("buckets")), "wanted")
    wanted = wanted.filter("buckets > 0").select(F.col("rep").alias("id")).hint("merge")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width).view(np.int64) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], ["id", "hashes"])

    return source.join(wanted, "id", "left_semi").mapInArrow(cut, "id long, hashes array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _left_over(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components: bucket, rep, component, main or not.

    `others` is the number of members outside the component that most members have.
    """
    placed = members.filter("size > 2").select("key", "rep", "size").join(
        found.select(F.col("id").alias("rep"), "component"), "rep", "left"
    ).withColumn("component", F.coalesce("component", "rep"))
    counted = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = counted.groupBy("key").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("in_main")
    )
    return placed.join(stored(main, "main"), "key").select(
        "key", "rep", "component", "size", (F.col("size") - F.col("in_main")).alias("others"),
        (F.col("component") == F.col("main")).alias("is_main"),
    ).filter("others > 0")


def _compared(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components, by tasks of bounded size.

    Members outside the main component are dealt into blocks, all members into chunks; every
    block meets every chunk. Members of the main component need not meet each other.
    """
    def blocks_of(total: Column, most: int) -> Column:
        return F.ceil(total / most).cast("int")

    dealt = left.join(sets.select(F.col("id").alias("rep"), "hashes"), "rep").select(
        "*",
        F.pmod(F.xxhash64("rep", F.lit("block")), blocks_of(F.col("others"), _LEFT)).cast("int").alias("block"),
        F.pmod(F.xxhash64("rep", F.lit("chunk")), blocks_of(F.col("size"), _RIGHT)).cast("int").alias("chunk"),
    )
    payload = ["key", "rep", "component", "hashes"]
    asking = dealt.filter(~F.col("is_main")).select(
        *payload, "block", F.explode(F.sequence(F.lit(0), blocks_of(F.col("size"), _RIGHT) - 1)).alias("chunk"),
        F.lit(True).alias("asks"),
    )
    # Two members outside the main one meet in the block of the earlier.
    last = F.when(F.col("is_main"), blocks_of(F.col("others"), _LEFT) - 1).otherwise(F.col("block"))
    asked = dealt.select(
        *payload, F.explode(F.sequence(F.lit(0), last)).alias("block"), "chunk", F.lit(False).alias("asks")
    )

    def compare(table: pa.Table) -> pa.Table:
        return _compare(table, percent)

    return (
        asking.unionByName(asked)
        .groupBy("key", "block", "chunk")
        .applyInArrow(compare, "a long, b long")
    )


def _compare(table: pa.Table, percent: int) -> pa.Table:
    asks = table["asks"].to_numpy()
    reps, owners = table["rep"].to_numpy(), table["component"].to_numpy()
    lists = table["hashes"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    sizes = np.diff(ends)
    right = np.flatnonzero(~asks)
    parts = [values[ends[i] : ends[i + 1]] for i in right]
    if not parts or not asks.any():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    owner_of = np.repeat(np.arange(len(right)), sizes[right])
    pooled = np.concatenate(parts)
    order = np.argsort(pooled, kind="stable")
    pooled, owner_of = pooled[order], owner_of[order]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for i in np.flatnonzero(asks):
        mine = values[ends[i] : ends[i + 1]]
        low, high = np.searchsorted(pooled, mine, "left"), np.searchsorted(pooled, mine, "right")
        counts = high - low
        total = int(counts.sum())
        if not total:
            continue
        at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(total)
        both = np.bincount(owner_of[at], minlength=len(right))
        for j in np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[right] - both)):
            x, y = root(int(owners[i])), root(int(owners[right[j]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(reps[i]), int(reps[right[j]])))
    return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})
