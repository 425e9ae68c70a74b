"""The event log as a bucketed table: an append compares what comes in with the log where the log lies.

Buckets go by tenant, case and instant, so a case with very many events is spread over all of them, and rows that
are the same event lie in the same one.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import dedupe_events, valid_events
from ..session import kept

BY = ["user_id", "case_id", "occurred_at"]


class LogTable:
    """A log stored under a table name and a path, in a fixed number of buckets."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def create(self, log: DataFrame) -> None:
        """Store the events of a log, each once."""
        self._write(dedupe_events(valid_events(log)), "errorifexists")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def new_events(self, incoming: DataFrame) -> DataFrame:
        """The incoming events that the log does not hold, each once. Only they are dealt out; the log is read bucket by bucket."""
        fresh, known = dedupe_events(valid_events(incoming)).alias("i"), self.read().select(*BY, "type", "evidence_ref").alias("k")
        # Keys are those of the buckets alone; the rest of an event's key is compared beside them.
        rest = (F.col("i.type") == F.col("k.type")) & F.col("i.evidence_ref").eqNullSafe(F.col("k.evidence_ref"))
        same = F.coalesce(rest, F.lit(False))
        for c in BY:
            same = (F.col(f"i.{c}") == F.col(f"k.{c}")) & same
        return fresh.join(known, same, "left_anti")

    def append(self, incoming: DataFrame) -> DataFrame:
        """Add what is new and give it back. Run again, it adds nothing."""
        fresh = kept(self.new_events(incoming))
        self._write(fresh, "append")
        return fresh

    def _write(self, rows: DataFrame, mode: str) -> None:
        # A file per bucket and write.
        dealt = rows.select(*sorted(rows.columns)).repartition(self.buckets, *BY)
        dealt.write.mode(mode).format("parquet").option("path", self.path).bucketBy(self.buckets, *BY).sortBy(*BY).saveAsTable(self.name)
