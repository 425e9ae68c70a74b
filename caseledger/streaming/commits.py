"""Tables that a stream writes batch by batch and that hold each batch once, whatever happens while it is written.

A batch writes its rows, for all its tables, under a name that no attempt before it has used; when they are all
there, one mark names the attempt. Rows count only if their attempt is marked, so an attempt that dies half way leaves
files that nobody reads, and a batch that is sent again after its mark does nothing.
"""

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

_MARK = StructType([
    StructField("batch", LongType()), StructField("attempt", StringType()), StructField("folds", LongType()),
])


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = file_system(spark, path)
    return files.exists(at)


class Commits:
    """The marks of one stream, in the folder of its first table. Spark skips the folder when it reads the table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.marks = f"{folder.rstrip('/')}/_marks"

    # --- writing ---

    def write(self, batch: int, tables: dict[str, tuple[DataFrame, list[str]]]) -> bool:
        """Write {folder: (rows, partition columns)} as the batch; False when it was there already."""
        if self.holds(batch):
            return False
        attempt = f"{batch}-{uuid.uuid4().hex}"
        for folder, (rows, by) in tables.items():
            self._rows(rows, batch, attempt).write.mode("append").partitionBy("attempt", *by).parquet(folder)
        self._mark(batch, attempt)
        return True

    def _rows(self, rows: DataFrame, batch: int, attempt: str) -> DataFrame:
        # A fold keeps the batch that a row came with.
        own = rows if "batch" in rows.columns else rows.withColumn("batch", F.lit(batch).cast("long"))
        return own.withColumn("attempt", F.lit(attempt))

    def _mark(self, batch: int, attempt: str, folds: int | None = None) -> None:
        """Written aside and renamed, so that a mark is there whole or not at all. Of two writers one fails."""
        aside = f"{self.marks}/.{uuid.uuid4().hex}"
        at, files = file_system(self.spark, aside)
        stream = files.create(at, False)
        stream.write(bytearray(json.dumps({"batch": batch, "attempt": attempt, "folds": folds}).encode() + b"\n"))
        stream.close()
        final, _ = file_system(self.spark, self._name(batch, folds))
        if files.exists(final) or not files.rename(at, final):
            files.delete(at, False)
            raise RuntimeError(f"batch {batch} has been marked by another writer")

    def _name(self, batch: int, folds: int | None = None) -> str:
        return f"{self.marks}/{batch:020d}" + ("" if folds is None else f"-fold{folds:020d}") + ".json"

    def holds(self, batch: int) -> bool:
        """Whether the batch counts already, by its own mark or in a fold."""
        return exists(self.spark, self._name(batch)) or batch <= self._widest()[0]

    def _widest(self) -> tuple[int, str | None]:
        """The last batch that the widest fold holds, and its attempt."""
        upto, attempt = self._marks().agg(F.max("folds"), F.max_by("attempt", "folds")).first()
        return (-1, None) if upto is None else (upto, attempt)

    # --- reading ---

    def _marks(self) -> DataFrame:
        if not exists(self.spark, self.marks):
            return self.spark.createDataFrame([], _MARK)
        return self.spark.read.schema(_MARK).json(f"{self.marks}/*.json")

    def attempts(self) -> DataFrame:
        """The attempts that count: the widest fold, and the batches after it."""
        upto, whole = self._widest()
        later = F.col("folds").isNull() & (F.col("batch") > upto)
        return self._marks().filter(later | (F.col("attempt") == F.lit(whole)) if whole else later).select("attempt")

    def read(self, folder: str, schema: StructType) -> DataFrame:
        """The rows of a table that count, with the columns of `schema`.

        The names of the attempts are as many as the batches since the last fold, and prune the folders that are read.
        """
        if not exists(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        whole = StructType([*schema.fields, StructField("attempt", StringType())])
        rows = self.spark.read.schema(whole).parquet(folder)
        return rows.join(self.attempts(), "attempt", "left_semi").select(*schema.fieldNames())

    def follow(self, folder: str, schema: StructType, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
        """A stream over what is committed: every marked batch goes to `handle` with its rows, none twice under one batch id."""
        spark = self.spark
        whole = StructType([*schema.fields, StructField("attempt", StringType())])

        def pass_on(marks: DataFrame, number: int) -> None:
            rows = spark.read.schema(whole).parquet(folder)
            handle(rows.join(marks.filter("folds IS NULL").select("attempt"), "attempt", "left_semi").select(*schema.fieldNames()), number)

        marks = spark.readStream.schema(_MARK).json(self.marks)
        return marks.writeStream.foreachBatch(pass_on).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # --- upkeep ---

    def fold(self, tables: dict[str, tuple], squash: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> int | None:
        """Write all that counts as one attempt, {folder: (schema, partition columns)}, and mark it. `squash` may make fewer rows
        of a folder's, as many as they stand for.

        Readers that began before keep reading the old files; `sweep` removes them later. Returns the last batch folded.
        """
        upto = self._marks().agg(F.max(F.coalesce("folds", "batch"))).first()[0]
        if upto is None or self._marks().count() < 2:
            return None
        attempt = f"fold-{uuid.uuid4().hex}"
        for folder, (schema, by) in tables.items():
            rows = (squash or {}).get(folder, lambda df: df)(self.read(folder, schema))
            rows = rows.repartition(*by) if by else rows
            self._rows(rows, upto, attempt).write.mode("append").partitionBy("attempt", *by).parquet(folder)
        self._mark(upto, attempt, upto)
        return upto

    def sweep(self, folders: list[str]) -> list[str]:
        """Remove the files of attempts that do not count. Only while nothing writes and nobody reads what was folded."""
        live = {f"attempt={r.attempt}" for r in self.attempts().collect()}
        gone = []
        for folder in folders:
            at, files = file_system(self.spark, folder)
            if not files.exists(at):
                continue
            for status in files.listStatus(at):
                name = status.getPath().getName()
                if name.startswith("attempt=") and name not in live:
                    files.delete(status.getPath(), True)
                    gone.append(name)
        return gone
