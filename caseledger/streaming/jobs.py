"""Streaming shells over the batch functions.

Every job is a foreachBatch over stored tables, and every step of it can run twice: what a batch publishes counts
once it is marked as a whole (`commits`), and the states of touched cases are written anew.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.fold import fold
from ..operators.log import dedupe_events, new_events
from ..operators.reach import phase_reach
from ..operators.skew import first_per_key
from ..plans.sweeps import dead_letters
from ..schemas import EVENT
from .commits import Commits
from .views import refresh_views

MESSAGE_KEY = ["mailbox_id", "provider_message_id"]
CASE = ["user_id", "case_id"]
BUCKETS = 256


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table that may not exist yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def bucket(column: str = "user_id", n: int = BUCKETS):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


_GUESSED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def _measured(spark: SparkSession) -> SparkSession:
    """The session of a stream, in which a join sends a side to all only when that side is small once it is shuffled.

    The size that is guessed before is that of files. Events with most of their columns left out and stages that are the same few for
    every tenant are a hundred times as large as rows, and all of a broadcast goes through the driver. A batch has some twenty joins in
    one plan, each of whose sides is three times as large there as it was shuffled, hence an eighth of the size.
    """
    if spark.conf.get(_MEASURED, None) is None:
        size = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        spark.conf.set(_MEASURED, str(size // 8 if size > 0 else size))
    spark.conf.set(_GUESSED, "-1")
    return spark


def _ledger_schema(messages: StructType) -> StructType:
    return StructType([*[messages[c] for c in (*MESSAGE_KEY, "received_at")], StructField("bucket", IntegerType())])


def ingest(messages: DataFrame, ledger: str, out: str, checkpoint: str) -> StreamingQuery:
    """Each (mailbox, message) once, however old it is when it arrives and whatever dies on the way.

    There is no watermark: backfilled mail is new mail. Repeats are dropped inside a batch and by the ledger of what
    has landed, of which only the mailboxes of the batch are read. Messages and ledger are one commit: `landed` reads what
    counts of `out`, and `Commits(spark, out).follow` hands on every batch of it.
    """
    kinds = messages.schema
    bucketed = _ledger_schema(kinds)

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commits = Commits(spark, out)
        if commits.holds(number):
            return
        once = batch.dropDuplicates(MESSAGE_KEY).withColumn("bucket", bucket("mailbox_id"))
        known = commits.read(ledger, bucketed).join(once.select("bucket").distinct(), "bucket", "left_semi")
        fresh = once.join(known.select(*MESSAGE_KEY), MESSAGE_KEY, "left_anti")
        fresh.persist()
        commits.write(number, {
            out: (fresh.drop("bucket"), []),
            ledger: (fresh.select(*MESSAGE_KEY, "received_at", "bucket"), ["bucket"]),
        })
        fresh.unpersist()

    return (
        messages.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def landed(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """The messages that `ingest` has published, each once."""
    return Commits(spark, out).read(out, schema)


def fold_ingested(spark: SparkSession, ledger: str, out: str, schema: StructType) -> int | None:
    """Write messages and ledger anew, as one commit for all batches so far."""
    return Commits(spark, out).fold({out: (schema, []), ledger: (_ledger_schema(schema), ["bucket"])})


def current(spark: SparkSession, path: str, keys: list[str], schema: StructType | None = None) -> DataFrame:
    """A table of versions as it stands: of each key the row that the latest batch wrote."""
    rows = spark.read.parquet(path) if schema is None else stored(spark, path, schema)
    return first_per_key(rows, keys, F.col("batch"), last=True).drop("batch", "bucket")


def compact(spark: SparkSession, path: str, keys: list[str], into: str) -> None:
    """Write a table of versions anew, with one row per key. Readers move on to the new folder when it is done."""
    rows = spark.read.parquet(path)
    first_per_key(rows, keys, F.col("batch"), last=True).write.mode("overwrite").partitionBy("batch").parquet(into)


def _write_version(rows: DataFrame, path: str, batch: int) -> None:
    """A batch that runs twice replaces what it wrote before, and nothing else."""
    (
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    )


def touched_log(spark: SparkSession, log: str, schema: StructType, touched: DataFrame) -> DataFrame:
    """The events of some cases, from the partitions of the log that may hold them.

    `touched`: user_id, case_id, bucket. At most as many bucket numbers as there are buckets come to the driver.
    """
    wanted = [r[0] for r in touched.select("bucket").distinct().collect()]
    rows = stored(spark, log, schema).filter(F.col("bucket").isin(wanted) if wanted else F.lit(False))
    return rows.join(touched.select(*CASE).distinct(), CASE, "left_semi")


def project(
    events: DataFrame,
    log: str,
    states: str,
    checkpoint: str,
    *,
    stage_defs: DataFrame | None = None,
    buckets: int = BUCKETS,
    every: str | None = None,
    reach: tuple[str, str] | None = None,
    views: tuple[str, str] | None = None,
) -> StreamingQuery:
    """Append events and fold again the cases they touch.

    The fold takes late events in any order, so there is no watermark and nothing is ever late.
    It is not kept as state either: a correction can bring back what a freeze held off. The
    cases a batch touches, repeats included, are folded from their part of the log and written as the batch's
    version; `current` reads the table as it stands. With `reach`, the folders of the cases and of the reach table,
    reach follows in the same batch, after the states; with `views`, those of the cases and of the views, so do the
    totals of the reports (`streaming.views`).
    """
    schema = StructType([*EVENT.fields, StructField("bucket", IntegerType())])

    def land(batch: DataFrame, number: int) -> None:
        spark = _measured(batch.sparkSession)
        incoming = batch.withColumn("bucket", bucket(n=buckets)).persist()
        touched = incoming.select(*CASE, "bucket").distinct().persist()
        landed = new_events(touched_log(spark, log, schema, touched), incoming)
        landed.select(*[f.name for f in schema.fields]).write.mode("append").partitionBy("bucket").parquet(log)
        whole = dedupe_events(touched_log(spark, log, schema, touched).drop("bucket"))
        _write_version(fold(whole, stage_defs), states, number)
        if reach is not None:
            _refresh(spark, whole, touched, *reach, stage_defs, number)
        if views is not None:
            cases = spark.read.parquet(views[0]).join(touched.select(*CASE), CASE, "left_semi")
            refresh_views(spark, cases, whole, touched, views[1], stage_defs, number)
        touched.unpersist()
        incoming.unpersist()

    writer = events.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _refresh(
    spark: SparkSession, log: DataFrame, touched: DataFrame, cases: str, out: str, stage_defs: DataFrame | None, number: int
) -> None:
    theirs = spark.read.parquet(cases).join(touched.select(*CASE).distinct(), CASE, "left_semi")
    _write_version(phase_reach(theirs, log, stage_defs), out, number)


def refresh_reach(
    events: DataFrame, cases: str, log: str, stage_defs: DataFrame, out: str, checkpoint: str,
    *, buckets: int = BUCKETS, every: str | None = "5 seconds",
) -> StreamingQuery:
    """The reach of the cases that a burst of events touches, as the batch's version.

    Where the log is written by `project`, let that refresh reach itself, so that it never reads an older log.
    """
    schema = StructType([*EVENT.fields, StructField("bucket", IntegerType())])

    def refresh(batch: DataFrame, number: int) -> None:
        spark = _measured(batch.sparkSession)
        touched = batch.withColumn("bucket", bucket(n=buckets)).select(*CASE, "bucket").distinct().persist()
        whole = dedupe_events(touched_log(spark, log, schema, touched).drop("bucket"))
        _refresh(spark, whole, touched, cases, out, stage_defs, number)
        touched.unpersist()

    writer = events.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drain_failures(failed: DataFrame, retry: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Records that failed too often go to the dead letters without their text, others again. Both are one commit: read
    them with `drained`."""

    def land(batch: DataFrame, number: int) -> None:
        again, gone = dead_letters(batch)
        Commits(batch.sparkSession, retry).write(number, {retry: (again, []), dead: (gone, [])})

    return (
        failed.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def drained(spark: SparkSession, retry: str, dead: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """What `drain_failures` has put out, for records of that schema: (to be tried again, dead letters)."""
    again, gone = dead_letters(spark.createDataFrame([], schema))
    commits = Commits(spark, retry)
    return commits.read(retry, again.schema), commits.read(dead, gone.schema)
