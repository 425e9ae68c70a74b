"""Operator 6: best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Pieces that fill a sequence stand alone. The others are dealt into groups of bounded size so that
every group gets the same mix of lengths. Each group is packed by several islands, whose populations
evolve apart; between rounds the elite of an island migrates to the next one. Bins that stay
poorly filled are dissolved at the end and their pieces packed together across groups.
"""

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grouping_genetic import evolve
from .shared import stored
from .tokens import VOCABULARY, token_ids

END_ID = 2
_ITEMS = "grp long, island int, uid long, length int, bin int, bins int, spread long"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of `most` ids but the first, which takes the rest."""
    first = n % most or min(n, most)
    return [(0, first), *((at, most) for at in range(first, n, most))]


def pieces(docs: DataFrame, *, id_col: str, text_col: str, most: int, vocabulary: str, end_id: int) -> DataFrame:
    """uid, id, piece, start, length, ids_crc32, and the turn at which pieces of a length are dealt out."""

    def tokenised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done, turns = 0, Counter()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*token_ids(text or "", vocabulary), end_id], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), most)):
                    # Partitions begin at different turns, or the first groups would get all that is rare.
                    turn = turns[length] + (part * 7919 + length * 104729) % 1_000_003
                    turns[length] += 1
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    out.append((part << 40 | done, doc_id, piece, start, length, crc, turn))
                    done += 1
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), batch.schema.field(0).type, pa.int32(), *[pa.int64()] * 4]
            names = ["uid", "id", "piece", "start", "length", "ids_crc32", "turn"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(
        tokenised, f"uid long, id {kind}, piece int, start long, length long, ids_crc32 long, turn long"
    )


def packed(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = 1024,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    group_rows: int = 16_384,
    islands: int = 3,
    rounds: int = 2,
    well_filled: float = 0.995,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and `end_id`; null and empty texts are that id alone. Only documents of more
    than `most` ids are cut. Pieces of a sequence lie side by side from 0. Repeated rows are
    packed each for itself, a null id is carried along, other columns are not read, and an empty table gives no rows.
    `group_rows` bounds the pieces that one task packs; there are as many groups as that takes.
    """
    all_pieces = stored(
        pieces(docs, id_col=id_col, text_col=text_col, most=most, vocabulary=vocabulary, end_id=end_id), "pieces"
    )
    loose = all_pieces.filter(F.col("length") < most).select("uid", F.col("length").cast("int").alias("length"), "turn")
    how = {"most": most, "group_rows": group_rows, "islands": islands, "rounds": rounds}
    first = stored(_packed(loose, **how), "bins")
    fills = first.groupBy("grp", "bin").agg(F.sum("length").alias("filled"))
    poor = fills.filter(F.col("filled") < well_filled * most).select("grp", "bin")
    # Pieces of poorly filled bins meet those of other groups, dealt anew.
    again = first.join(poor, ["grp", "bin"]).select("uid", "length", F.xxhash64("uid").alias("turn"))
    second = stored(_packed(stored(again, "loose"), **how), "bins")
    fewer = second.select("grp", "bin").distinct().count() < poor.count()
    kept = first.join(poor, ["grp", "bin"], "left_anti") if fewer else first
    numbered = kept.select("uid", "length", (F.col("grp") * 2**24 + F.col("bin")).alias("sequence_id"))
    if fewer:
        numbered = numbered.unionByName(
            second.select("uid", "length", (F.lit(2**60) + F.col("grp") * 2**24 + F.col("bin")).alias("sequence_id"))
        )
    along = W.partitionBy("sequence_id").orderBy(F.desc("length"), "uid").rowsBetween(W.unboundedPreceding, -1)
    placed = numbered.select(
        "uid", "sequence_id", F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long").alias("offset")
    )
    alone = F.lit(2**61) + F.col("uid")
    return all_pieces.join(placed, "uid", "left").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", alone).alias("sequence_id"), F.coalesce("offset", F.lit(0)).alias("offset"),
    )


def _packed(items: DataFrame, *, most: int, group_rows: int, islands: int, rounds: int) -> DataFrame:
    """(grp, uid, length, bin): of every group the packing of its best island."""
    groups = max(1, -(-items.count() // group_rows))
    dealt = items.select(
        F.pmod("turn", F.lit(groups)).alias("grp"),
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        "uid", "length", F.lit(None).cast("int").alias("bin"), F.lit(0).alias("bins"),
        F.lit(0).cast("long").alias("spread"),
    )

    def live(round_: int):
        def one(key: tuple, table: pa.Table) -> pa.Table:
            return _evolved(table, most, seed=round_ * 1_000_003 + key[0].as_py() * 101 + key[1].as_py())

        return one

    state = dealt
    for r in range(rounds):
        if r:
            moved = state.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
            state = state.withColumn("origin", F.lit(0)).unionByName(moved.withColumn("origin", F.lit(1)))
        else:
            state = state.withColumn("origin", F.lit(0))
        state = stored(state.groupBy("grp", "island").applyInArrow(live(r), _ITEMS), "islands")
    best = state.groupBy("grp").agg(F.min_by("island", F.struct("bins", "spread", "island")).alias("island"))
    return state.join(best, ["grp", "island"]).select("grp", "uid", "length", "bin")


def _evolved(table: pa.Table, most: int, seed: int) -> pa.Table:
    origin = table["origin"].to_numpy()
    uid, length = table["uid"].to_numpy(), table["length"].to_numpy()
    bins = table["bin"].to_numpy()
    elites = []
    for source in np.unique(origin):
        rows = np.flatnonzero(origin == source)
        rows = rows[np.argsort(uid[rows], kind="stable")]
        elites.append((rows, bins[rows]))
    rows = elites[0][0]
    known = [e[1].astype(np.int64) for e in elites if not np.isnan(e[1].astype(float)).any()]
    best = evolve(length[rows].astype(np.int64), most, seed=seed, immigrants=known)
    n = len(rows)
    fewest, spread = best.cost
    return pa.table({
        "grp": table["grp"].combine_chunks().take(pa.array(rows)),
        "island": table["island"].combine_chunks().take(pa.array(rows)),
        "uid": pa.array(uid[rows]),
        "length": pa.array(length[rows], pa.int32()),
        "bin": pa.array(best.bin_of, pa.int32()),
        "bins": pa.array(np.full(n, fewest), pa.int32()),
        "spread": pa.array(np.full(n, spread), pa.int64()),
    })
