"""Streaming jobs and stored tables: what batches and rewrites leave equals what the batch forms make of the whole."""

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseledger.operators.log import EVENT_KEY
from caseledger.schemas import EVENT
from caseledger.session import dealt, kept, shared_folder
from caseledger.sources.log_table import LogTable
from caseledger.sources.partitions import Partitions, bucket, erase_stored, purge_stored
from caseledger.streaming import jobs, views

from . import folding, log, reach, statistics, sweeps
from .account import account_tables
from .base import NOW, Registry, iso, rounded

REGISTRY = Registry()
add = REGISTRY.add

_BUCKETS = 16


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _sent(t, rows: DataFrame, parts: list[Column], folder: str) -> Iterator[DataFrame]:
    """The rows as a stream, once after each part has come: what runs on it until it has read all makes a batch of each part.

    A part is as many files as the tasks it is dealt over, so no task writes or reads a part whole.
    """
    rows = kept(rows)
    for part in parts:
        dealt(rows.filter(part)).write.mode("append").parquet(f"{folder}/in")
        yield t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


def _thirds(key: str) -> list[Column]:
    """The last third first, and every batch after it with a seventh of what came before."""
    third, again = F.pmod(F.col(key), F.lit(3)), F.pmod(F.col(key), F.lit(7)) == 0
    return [third == 2, (third == 1) | ((third == 2) & again), (third == 0) | ((third == 1) & again)]


@add("t01_ingest_stream", """SELECT doc_id % 7 AS mailbox_id, concat('m-', doc_id) AS provider_message_id,
  md5(coalesce(text, '')) AS text_md5 FROM documents""")
def t01(t):
    """All documents as mail that arrives in three batches, newest first, with repeats."""
    folder = _folder(t)
    mail = t.raw("documents").select(
        (F.col("doc_id") % 7).alias("mailbox_id"), F.concat(F.lit("m-"), "doc_id").alias("provider_message_id"),
        F.expr("TIMESTAMP '2024-07-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT))").alias("received_at"), "text", "doc_id",
    )
    for stream in _sent(t, mail, _thirds("doc_id"), folder):
        jobs.ingest(stream, f"{folder}/ledger", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = jobs.landed(t.spark, f"{folder}/out", stream.schema)
    return out.select("mailbox_id", "provider_message_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def _projected(t, **more) -> str:
    """The log streamed in three batches through the fold; the folder of what it keeps."""
    folder = _folder(t)
    t.cases.write.parquet(f"{folder}/cases")
    t.projected.write.parquet(f"{folder}/projected")
    targets = {name: tuple(f"{folder}/{x}" for x in where) for name, where in more.items()}
    stage_defs = kept(t.stage_defs)
    for stream in _sent(t, t.stored_log.select(*[f.name for f in EVENT.fields]), _thirds("seq"), folder):
        jobs.project(
            stream, f"{folder}/log", f"{folder}/states", f"{folder}/checkpoint", stage_defs=stage_defs, buckets=_BUCKETS, **targets
        ).awaitTermination()
    return folder


@add("t02_project_stream", folding.REGISTRY.oracles["a01_fold"])
def t02(t):
    """The fold of a log that arrives in three batches, newest first, with repeats."""
    out = jobs.current(t.spark, f"{_projected(t)}/states", jobs.CASE).drop("company_id")
    return iso(out, "applied_at", "last_signal_at")


@add("t03_reach_stream", reach.REGISTRY.oracles["a04_phase_reach"])
def t03(t):
    """Reach, refreshed for the cases that each batch touches."""
    out = jobs.current(t.spark, f"{_projected(t, reach=('projected', 'reach'))}/reach", jobs.CASE)
    return iso(out.drop("reached_acknowledged", "reached_screening"), "applied_at", "created_at", "first_human_at", "last_event_at")


def _told(df: DataFrame, report: str, item: str, measures: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    return df.select("user_id", F.lit(report).alias("report"), F.col(item).alias("item"), F.explode(each).alias("m")).select(
        "user_id", "report", "item", "m.measure", "m.value"
    )


_REPORTS = (
    ("effect", "a13_channel_effectiveness", "channel", ["sent", "interviews", "offers", "ghosted"]),
    ("channels", "a12_channels", "channel", ["sent", "interviews", "offers", "ghosted", "iv_value", "of_value", "ghost_value"]),
    ("funnel 12m", "a07_funnel", "label", ["ord", "n", "width"]),
    ("funnel 90d", "a07_funnel_90d", "label", ["ord", "n", "width"]),
    ("funnel all", "u01_labelled_counts", "label", ["ord", "n", "width"]),
)


def _report_sql(report, name, item, measures):
    cells = ", ".join(f"{{'measure': '{m}', 'value': round(CAST(\"{m}\" AS DOUBLE), 6)}}" for m in measures)
    return f"""SELECT user_id, '{report}' AS report, item, c.measure AS measure, c.value AS value FROM (
      SELECT user_id, {item} AS item, unnest([{cells}]) AS c FROM ({statistics.REGISTRY.oracles[name]}) q) z"""


@add("a13_maintained_reports", " UNION ALL ".join(_report_sql(*r) for r in _REPORTS))
def a13_maintained(t):
    """Channels and funnels out of totals that three batches have brought up to date, every figure of each."""
    folder, now = f"{_projected(t, views=('cases', 'views'))}/views", F.to_timestamp(F.lit(NOW))
    made = {
        "effect": views.channel_effectiveness(t.spark, folder), "channels": views.channels(t.spark, folder, now),
        "funnel 12m": views.funnel(t.spark, folder, now), "funnel 90d": views.funnel(t.spark, folder, now, "90d"),
        "funnel all": views.funnel(t.spark, folder, now, "all"),
    }
    out = None
    for report, _, item, measures in _REPORTS:
        rows = _told(made[report], report, item, measures)
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, "value")


@add("t10_drain_stream", """SELECT conv_id * 1000 + turn AS msg_id, CASE WHEN (conv_id + turn) % 7 >= 5 THEN 'raw_message_dlq' ELSE 'raw_message' END AS queue,
  CASE WHEN (conv_id + turn) % 7 >= 5 THEN '[stripped]' ELSE text END AS text FROM conversations""")
def t10(t):
    """All turns as failed records in three batches: tried again whole, or dead without their text."""
    folder = _folder(t)
    rows = t.raw("conversations").select(
        F.lit("raw_message").alias("queue"), (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"),
        ((F.col("conv_id") + F.col("turn")) % 7).alias("read_count"), F.to_json(F.struct("text")).alias("body"),
    )
    third = F.pmod(F.col("msg_id"), F.lit(3))
    for stream in _sent(t, rows, [third == k for k in range(3)], folder):
        jobs.drain_failures(stream, f"{folder}/retry", f"{folder}/dead", f"{folder}/checkpoint").awaitTermination()
    again, gone = jobs.drained(t.spark, f"{folder}/retry", f"{folder}/dead", stream.schema)
    both = again.select("msg_id", "queue", "body").unionByName(gone.select("msg_id", "queue", "body"))
    return both.select("msg_id", "queue", F.get_json_object("body", "$.text").alias("text"))


@add("t08_retention_stored", sweeps.REGISTRY.oracles["t08_retention_kept"])
def t08_stored(t):
    """Bodies stored by day: days before the cut lose their files, the day that is cut is written anew."""
    cut = F.to_timestamp(F.lit("2024-06-20 00:00:00")) - F.expr("INTERVAL 5 DAYS")
    bodies = t.log.select(
        F.col("seq").alias("body_id"), "user_id", F.col("occurred_at").alias("stored_at"), F.to_date("occurred_at").cast("string").alias("day")
    )
    table = Partitions(t.spark, f"{_folder(t)}/bodies", bodies.schema, by="day")
    table.append(bodies)
    purge_stored(table, F.to_date(cut), F.col("stored_at") >= cut)
    return table.read().select("body_id")


@add("t09_erase_stored", sweeps.REGISTRY.oracles["t09_erase_user"])
def t09_stored(t):
    """Every seventh tenant leaves all stored tables of the account; what is left is counted per table and tenant."""
    folder, tables = _folder(t), {}
    for name, df in account_tables(t).items():
        rows = df.withColumn("bucket", bucket(n=_BUCKETS))
        tables[name] = Partitions(t.spark, f"{folder}/{name}", rows.schema)
        tables[name].append(rows)
    erase_stored(tables, [r[0] for r in t.users.filter("user_id % 7 = 3").select("user_id").collect()], _BUCKETS)
    out = None
    for name, table in tables.items():
        n = table.read().groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "user_id", "n")
        out = n if out is None else out.unionByName(n)
    return out


@add("s07_append_stored", log.REGISTRY.plain["s07_dedupe_events"], uses="ev")
def s07_stored(t):
    """A bucketed log of two events in three, to which all events are appended twice."""
    name = f"log_{uuid.uuid4().hex}"
    table = LogTable(t.spark, name, f"{_folder(t)}/log", _BUCKETS)
    table.create(t.log.filter("seq % 3 <> 0"))
    table.append(t.log_with_repeats)
    table.append(t.log)
    rows = t.spark.read.schema(table.read().schema).parquet(table.path)
    t.spark.sql(f"DROP TABLE {name}")
    return iso(rows.select(*EVENT_KEY, "seq"), "occurred_at")
