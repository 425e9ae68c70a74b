"""Stored tables whose partitions can be written anew, one by one, while the table is read.

Rows lie in `attempt=…/<key>=…`. A mark lists which attempts hold a partition; it is renamed into place, so readers see a
rewrite whole or not at all. To erase, what goes is first named in a tombstone that every reader leaves out; then the
touched partitions are written without it, marked, and their old files are removed; the tombstone goes last. A job that dies on
the way is run again and goes on from the tombstone.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, LongType, StringType, StructField, StructType

from ..streaming.commits import exists, file_system

BUCKETS = 64


def bucket(column: str = "user_id", n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


class Partitions:
    """A table at `path`, partitioned by the column `by`, which `rows` carry."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, by: str = "bucket"):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self.schema = schema
        self._key: DataType = schema[by].dataType
        self._mark_schema = StructType([
            StructField("version", LongType()), StructField(by, self._key), StructField("attempt", StringType()),
            StructField("replaces", BooleanType()),
        ])

    # --- reading ---

    def current(self) -> DataFrame:
        """(by, attempt): which attempts hold each partition. A row per partition and write since it was last replaced."""
        marks = f"{self.path}/_marks"
        if not exists(self.spark, marks):
            return self.spark.createDataFrame([], self._mark_schema).select(self.by, "attempt")
        rows = self.spark.read.schema(self._mark_schema).json(f"{marks}/*.json")
        last = rows.filter("replaces").groupBy(F.col(self.by).alias("_by")).agg(F.max("version").alias("_from"))
        counts = rows.join(last, F.col(self.by).eqNullSafe(F.col("_by")), "left").filter(
            F.col("version") >= F.coalesce("_from", F.lit(-1))
        )
        return counts.filter("attempt IS NOT NULL").select(self.by, "attempt")

    def read(self) -> DataFrame:
        """The rows that count, without those that a tombstone names."""
        rows = self._rows()
        gone = self._gone()
        return rows if gone is None else rows.join(gone, "user_id", "left_anti")

    def _rows(self) -> DataFrame:
        whole = StructType([*self.schema.fields, StructField("attempt", StringType())])
        if not exists(self.spark, f"{self.path}/_marks"):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(whole).parquet(self.path).alias("r")
        held = self.current().alias("h")
        same = (F.col("r.attempt") == F.col("h.attempt")) & F.col(f"r.{self.by}").eqNullSafe(F.col(f"h.{self.by}"))
        return rows.join(held, same, "left_semi").select(*self.schema.fieldNames())

    def _gone(self) -> DataFrame | None:
        folder = f"{self.path}/_tombstones"
        if not exists(self.spark, folder):
            return None
        return self.spark.read.schema(StructType([self.schema["user_id"]])).json(folder).distinct()

    # --- writing ---

    def append(self, rows: DataFrame) -> None:
        self._write(rows, None)

    def _write(self, rows: DataFrame, replaced: list | None) -> None:
        attempt = uuid.uuid4().hex
        rows.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt", self.by).parquet(self.path)
        # A name per partition, at most as many as there are partitions.
        written = [r[0] for r in self._written(attempt)]
        entries = [{self.by: k, "attempt": attempt, "replaces": replaced is not None} for k in written]
        entries += [{self.by: k, "attempt": None, "replaces": True} for k in replaced or [] if k not in written]
        self._mark(entries)

    def _written(self, attempt: str) -> list:
        if not exists(self.spark, f"{self.path}/attempt={attempt}"):
            return []
        key = StructType([StructField(self.by, self._key)])
        return self.spark.read.schema(key).parquet(f"{self.path}/attempt={attempt}").select(self.by).distinct().collect()

    def _mark(self, entries: list[dict]) -> None:
        folder = f"{self.path}/_marks"
        version = 0
        if exists(self.spark, folder):
            at, files = file_system(self.spark, folder)
            names = [s.getPath().getName() for s in files.listStatus(at)]
            version = 1 + max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0] != "."), default=-1)
        lines = [json.dumps({"version": version, **e}, default=str) for e in entries]
        self._put(f"{folder}/{version:020d}.json", lines)

    def _put(self, path: str, lines: list[str]) -> None:
        aside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        at, files = file_system(self.spark, aside)
        stream = files.create(at, False)
        stream.write(bytearray("".join(x + "\n" for x in lines).encode()))
        stream.close()
        final, _ = file_system(self.spark, path)
        if files.exists(final) or not files.rename(at, final):
            files.delete(at, False)
            raise RuntimeError(f"{path} has been written by another job")

    # --- rewriting ---

    def rewrite(self, keys: list, keep: DataFrame | None = None) -> None:
        """Write some partitions anew with the rows of `keep` (of these partitions), or none, and remove their old files."""
        old = [(r[0], r[1]) for r in self.current().filter(F.col(self.by).isin(keys)).collect()] if keys else []
        if not old:
            return
        keys = sorted({k for k, _ in old})
        self._write(self.spark.createDataFrame([], self.schema) if keep is None else keep, keys)
        self._remove(old)

    def _remove(self, old: list[tuple]) -> None:
        for key, attempt in old:
            at, files = file_system(self.spark, f"{self.path}/attempt={attempt}/{self.by}={key}")
            files.delete(at, True)

    def sweep(self) -> int:
        """Remove files that no mark names: of writes and removals that died. Only while nothing is written."""
        held = {(str(r[0]), r[1]) for r in self.current().collect()}
        at, files = file_system(self.spark, self.path)
        gone = 0
        for attempt in files.listStatus(at) if files.exists(at) else []:
            name = attempt.getPath().getName()
            if not name.startswith("attempt="):
                continue
            for part in files.listStatus(attempt.getPath()):
                key = part.getPath().getName()
                if key.startswith(f"{self.by}=") and (key.split("=", 1)[1], name.split("=", 1)[1]) not in held:
                    files.delete(part.getPath(), True)
                    gone += 1
        return gone


def erase_stored(tables: dict[str, Partitions], erased: list, n: int = BUCKETS) -> None:
    """Erase tenants from every table: no reader sees them from the first step on, and no file holds them after the last.

    `erased` is what was asked for since the last run, so it is a short list. Tables are partitioned by `bucket()` of user_id into n.
    Only the partitions of these tenants are read and written.
    """
    for table in tables.values():
        if erased:
            table._put(f"{table.path}/_tombstones/{uuid.uuid4().hex}.json", [json.dumps({"user_id": u}) for u in erased])
    for table in tables.values():
        finish_erasing(table, n)


def finish_erasing(table: Partitions, n: int = BUCKETS) -> None:
    """Go on from the tombstones of a table, whoever wrote them."""
    gone = table._gone()
    if gone is None:
        return
    at, files = file_system(table.spark, f"{table.path}/_tombstones")
    stones = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().endswith(".json")]
    if not stones:
        return
    # At most as many numbers as there are buckets.
    keys = [r[0] for r in gone.select(bucket("user_id", n).alias("b")).distinct().collect()]
    table.rewrite(keys, table.read().filter(F.col("bucket").isin(keys)))
    table.sweep()
    for stone in stones:
        files.delete(stone, False)


def purge_stored(table: Partitions, day: Column, keep: Column) -> None:
    """Retention on a table partitioned by day: days that hold nothing to keep lose their files, a day that is cut is written anew.

    `day` is the first day of which rows may be kept, `keep` tells which rows.
    """
    first = table.spark.range(1).select(day.cast("string")).first()[0]
    keys = [r[0] for r in table.current().filter(F.col(table.by) <= F.lit(first)).select(table.by).distinct().collect()]
    if keys:
        table.rewrite(keys, table.read().filter((F.col(table.by) == F.lit(first)) & keep))
