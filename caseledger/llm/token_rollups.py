"""Operator 8: token counts as delta-maintained rollups.

Changes to documents are signed: an insert adds, a delete takes away, a revised count does both. A batch is
summed by source, language and tokenizer version and committed once under its id; totals are sums of
committed batches.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import token_ids

KEYS = ("source", "lang", "version")
_DELTA = "source string, lang string, version string, n_docs long, n_tokens long"


def counted(
    docs: DataFrame, version: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, source, lang, version, n_tokens of whole texts; a null text has none. `version` names the vocabulary."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(token_ids(t, version)) if t else 0 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([version] * len(n), pa.string()), pa.array(np.array(n, np.int64))],
                ["id", "source", "lang", "version", "n_tokens"],
            )

    source = docs.select(
        F.col(id_col).alias("id"), F.col("source").cast("string"), F.col("lang").cast("string"),
        F.col(text_col).cast("string").alias("text"),
    )
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, f"id {kind}, source string, lang string, version string, n_tokens long")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Changes that add counted rows (sign 1) or take them away (sign -1)."""
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (sign * F.col("n_tokens")).alias("n_tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that replace earlier counts of documents by new ones, where key or version may differ."""
    return signed(before, -1).unionByName(signed(after, 1))


@dataclass(frozen=True)
class Rollup:
    """A rollup kept under a folder that all executors share: one folder of sums per committed batch."""

    spark: SparkSession
    path: str

    def _batch(self, batch_id: str) -> str:
        if not batch_id or any(c in batch_id for c in "/\\ ?*{}[]=:"):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return f"{self.path}/batch={batch_id}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch_id: str) -> bool:
        at, fs = self._fs(f"{self._batch(batch_id)}/_SUCCESS")
        return fs.exists(at)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Sum a batch of signed changes and commit it. False, and nothing done, where the id was committed before.

        Sums are combined on the map side, so a source with a third of all rows sends a row per task. A writer that dies
        leaves no mark and the batch is written anew. Null sources, languages and versions are keys of their own.
        """
        if self.committed(batch_id):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(self._batch(batch_id))
        return True

    def batches(self) -> list[str]:
        at, fs = self._fs(self.path)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and self.committed(n[6:]))

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of the committed batches; keys that went back to nothing are left out."""
        paths = [self._batch(b) for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], _DELTA)
        rows = self.spark.read.schema(_DELTA).parquet(*paths)
        return (
            rows.groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .filter("n_docs <> 0 OR n_tokens <> 0")
        )
