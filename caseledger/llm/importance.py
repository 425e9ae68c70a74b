"""Operator 12: documents resampled towards the distribution of target texts.

An untrained split of the tokenizers library over the text in ASCII lower case gives the words of a text and where they lie.
A window of one to three words is a pair of offsets in the words joined by single spaces; its CRC-32 is put together from
those of its words and picks a bucket. Histograms of both collections give each bucket a gain, the gains of its windows give a
document its weight, and noise keyed by the document's id turns the highest sums into a sample without replacement.
"""

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import as_bytes, new_path, stored

#: What separates words: ASCII other than digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST_WINDOW = 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GAP_BYTE = re.compile(GAP[:-1].encode())
#: Texts are split piece by piece, so that the lists of words stay small.
_PIECE = 1 << 20
_POLYNOMIAL = 0xEDB88320
#: Longer words are shifted bit by bit of their length.
_TABLES = 64


def _split():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(GAP), "removed")


@lru_cache(maxsize=1)
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Tables that append zero bytes to a CRC: by number of bytes, and by powers of two."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLYNOMIAL), one >> 1)
    start = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    counted = [start]
    for _ in range(_TABLES):
        last = counted[-1]
        counted.append(one[last & 255] ^ (last >> 8))
    doubled = [counted[1]]
    for _ in range(31):
        last = doubled[-1]
        doubled.append(_looked_up(last[None], np.zeros(1024, np.int64), last.reshape(-1)).reshape(4, 256))
    return np.stack(counted), np.stack(doubled)


def _looked_up(tables: np.ndarray, which: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[which, 0, crc & 255]
    for k in range(1, 4):
        out = out ^ tables[which, k, (crc >> (8 * k)) & 255]
    return out


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRCs of texts as they enter those of longer texts, n bytes before their end."""
    counted, doubled = _shifts()
    few = n <= _TABLES
    out = _looked_up(counted, np.where(few, n, 0), crc)
    for i in np.flatnonzero(~few):
        value = crc[i : i + 1]
        for bit in range(int(n[i]).bit_length()):
            if int(n[i]) >> bit & 1:
                value = _looked_up(doubled, np.full(1, bit), value)
        out[i] = value[0]
    return out


def _pieces(data: bytes) -> Iterator[str]:
    start = 0
    while len(data) - start > _PIECE:
        gap = _GAP_BYTE.search(data, start + _PIECE)
        if gap is None:
            break
        yield data[start : gap.start()].decode()
        start = gap.start()
    yield data[start:].decode()


def window_crcs(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its number of words and the CRC-32 of every window: first those of one word, then of two and three."""
    split, seen, found = _split(), {}, []
    for data in texts:
        ids: list[int] = []
        for piece in _pieces((data or b"").translate(_LOWER)):
            ids.extend([seen.setdefault(word, len(seen)) for word, _ in split.pre_tokenize_str(piece)])
        found.append(np.array(ids, np.int64))
    words = [w.encode() for w in seen]
    crcs = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words))
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    for ids in found:
        ends = np.cumsum(size[ids] + 1) - 1
        windows = [crcs[ids]]
        for k in range(1, min(LONGEST_WINDOW, len(ids))):
            # From windows of k words to those of one more: the last end moves on by a space and a word.
            longer = shifted(windows[-1][:-1], ends[k:] - ends[k - 1 : -1]) ^ spaced[ids[k:]]
            windows.append(longer)
        yield len(ids), np.concatenate(windows)


def featured(texts: DataFrame, *, id_col: str, text_col: str = "text", buckets: int = 10_000) -> DataFrame:
    """id, n_words, n_features and the sorted buckets of all windows, as differences in two bytes each."""
    if not 0 < buckets <= 65536:
        raise ValueError("buckets are numbered in two bytes")
    kind = texts.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, packed = [], []
            for n, crcs in window_crcs(as_bytes(batch.column("text"))):
                inside = np.sort((crcs % np.uint32(buckets)).astype("<u2"))
                counts.append((n, len(inside)))
                packed.append(np.diff(inside, prepend=inside.dtype.type(0)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([n for n, _ in counts], pa.int64()),
                 pa.array([n for _, n in counts], pa.int64()), pa.array(packed, pa.binary())],
                ["id", "n_words", "n_features", "buckets"],
            )

    given = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(of, f"id {kind}, n_words long, n_features long, buckets binary")


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u2"), dtype=np.int64)


def histogram(features: DataFrame, buckets: int = 10_000) -> list[int]:
    """How many windows fall in each bucket, over all rows. At most `buckets` rows come from a task, and as many to the driver."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column("buckets").to_pylist():
                total += np.bincount(_unpacked(data), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = features.select("buckets").mapInArrow(of, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for bucket, n in rows.collect():
        out[bucket] = n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """What a window of each bucket adds to a weight, in thousandths: the log ratio of both distributions, each with one more window a bucket."""
    S, T, n = sum(source), sum(target), len(source)
    return [
        floor(1000 * log(float((t + 1) * (S + n)) / float((s + 1) * (T + n)))) for s, t in zip(source, target, strict=True)
    ]


def noise(key: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths, from a digest of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_id_col: str = "item_id",
    target_text_col: str = "text",
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 5,
    seed: int = 42,
) -> DataFrame:
    """id, n_features, weight, score and rank of every document; rank is null where it is not drawn.

    Words are maximal runs of digits, letters and characters beyond ASCII, after A-Z became lower case. Of the documents with
    `least_words` words or more, floor(percent / 100 of them) with the highest scores are drawn and ranked from 1, ties
    by smaller id, null ids last. The noise in a score is keyed by the id (a null id counts as empty text).

    Null and empty texts have no words and a weight of 0. Repeated rows all count, score alike and take ranks of their own. Without
    target texts the gains stand against an even distribution; empty documents give no rows. Other columns are not read. Texts
    are read whole, in pieces of a megabyte that end between words.
    """
    path = new_path(docs.sparkSession, "features")
    made = featured(docs, id_col=id_col, text_col=text_col, buckets=buckets)
    made.write.option("compression", "zstd").parquet(path)
    known = docs.sparkSession.read.schema(made.schema).parquet(path)
    wanted = featured(target, id_col=target_id_col, text_col=target_text_col, buckets=buckets)
    gain = gains(histogram(known, buckets), histogram(wanted, buckets))
    kind = known.schema["id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_bucket = np.array(gain, np.int64)
        for batch in batches:
            weights = [int(per_bucket[_unpacked(data)].sum()) for data in batch.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "n_words", "n_features")), pa.array(weights, pa.int64())],
                ["id", "n_words", "n_features", "weight"],
            )

    weighed = known.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    able = F.col("n_words") >= least_words
    ranked = _numbered(scored.filter(able), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")])
    draw = scored.filter(able).count() * percent // 100
    rank = F.when(F.col("number") <= draw, F.col("number"))
    return ranked.withColumn("rank", rank).drop("number").unionByName(
        scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    ).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with their `number` in the order, from 1.

    Ranges of the order are sorted side by side; the sizes of the ranges before it, a row per range, lead from a row's place in its
    range to its number. Rows that tie in the whole order are alike, so a task that runs again numbers them alike.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number of a row holds that of its partition in its upper bits.
    placed = stored(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))),
        "ranges",
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = stored(
        placed.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")),
        "range-sizes",
    )
    return placed.join(sizes, "_part").withColumn("number", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
