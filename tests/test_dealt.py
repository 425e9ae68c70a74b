"""Work that is heavy per row is dealt out over all tasks, though a table is one file of one row group."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import catalogue
from caseledger.session import dealt
from catalogue.shapes import Tables

ROWS = 64


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("one_file")
    i = F.col("id")
    tables = {
        "customer": [i.alias("c_custkey"), F.concat(F.lit("Customer#"), i).alias("c_name"), (i % 25).cast("int").alias("c_nationkey"),
                     F.lit("BUILDING").alias("c_mktsegment")],
        "part": [i.alias("p_partkey"), F.concat(F.lit("part "), i).alias("p_name")],
        "events": [i.alias("event_id"), (i % 3).alias("user_id"), F.lit("signup").alias("event_type"), F.lit(1.0).alias("value"),
                   F.lit('{"k": 7}').alias("props"), F.lit(datetime(2024, 1, 2, 3, 4, 5)).alias("ts")],
        "documents": [i.alias("doc_id"), F.concat(F.lit("some text "), i).alias("text"), F.lit("web").alias("source")],
    }
    for name, columns in tables.items():
        spark.range(ROWS).select(*columns).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", [
    "p03_deny_list", "p04_anonymise", "p04_anonymise_documents", "x03_normalise_text", "x09_normalise_role", "s04_parse_ics",
])
def test_rows_are_dealt(spark, folder, name):
    out = catalogue.queries()[name](spark, folder)
    sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) > 1 and sum(r["count"] for r in sizes) == ROWS and max(r["count"] for r in sizes) < ROWS / 2


def test_messages_and_stored_log_are_dealt(spark, folder):
    t = Tables(spark, folder)
    assert t.messages.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert len(t.stored_log.inputFiles()) > 1 and t.stored_log.count() == t.log.count() == ROWS


def test_stream_parts_are_dealt(spark, folder, tmp_path):
    """Each part of a stream is a batch, and no batch is one file."""
    from catalogue import streams

    t, seen, files = Tables(spark, folder), [], set()
    rows = t.raw("documents")
    for stream in streams._sent(t, rows, streams._thirds("doc_id"), str(tmp_path)):
        now = set(spark.read.parquet(f"{tmp_path}/in").inputFiles())
        assert len(now - files) > 1
        files = now
        stream.writeStream.foreachBatch(lambda df, n: seen.append((n, df.count()))).option(
            "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    want = [rows.filter(p).count() for p in streams._thirds("doc_id")]
    assert seen == list(enumerate(want))


def test_dealt_keeps_all_rows(spark):
    df = spark.createDataFrame([(None,), (1,), (1,), (None,)], "a long").coalesce(1)
    assert sorted(map(str, dealt(df).collect())) == sorted(map(str, df.collect()))
