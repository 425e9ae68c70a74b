"""A job that dies between its writes leaves nothing twice and nothing out."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from caseledger.plans.sweeps import dead_letters
from caseledger.streaming import jobs
from caseledger.streaming.commits import Commits, exists

KIND = "mailbox_id long, provider_message_id string, received_at timestamp, text string"
FAILED = "queue string, msg_id long, read_count int, body string"


def mail(spark, ids):
    return spark.createDataFrame([(i % 5, f"m{i}") for i in ids], "m long, p string").select(
        F.col("m").alias("mailbox_id"), F.col("p").alias("provider_message_id"),
        F.to_timestamp(F.lit("2024-03-01")).alias("received_at"), F.concat(F.lit("text of "), "p").alias("text"))


def dies_at(monkeypatch, folder, times=1):
    """The first writes into a folder fail after their files are there."""
    left = {"n": times}
    real = DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        real(self, path, *args, **kwargs)
        if path == folder and left["n"]:
            left["n"] -= 1
            raise OSError("the driver is gone")

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return left


def ingest(spark, path):
    return jobs.ingest(spark.readStream.schema(KIND).parquet(path("in")), path("ledger"), path("out"), path("cp"))


def ids(df):
    return sorted(r.provider_message_id for r in df.collect())


@pytest.mark.parametrize("table", ["out", "ledger"])
def test_ingest_dies_between_its_writes(spark, tmp_path, monkeypatch, table):
    path = lambda n: str(tmp_path / n)
    mail(spark, range(40)).coalesce(1).write.mode("append").parquet(path("in"))
    ingest(spark, path).awaitTermination()
    mail(spark, range(20, 70)).coalesce(1).write.mode("append").parquet(path("in"))
    left = dies_at(monkeypatch, path(table))
    with pytest.raises(Exception, match="the driver is gone"):
        ingest(spark, path).awaitTermination()
    assert left["n"] == 0
    schema = spark.read.schema(KIND).parquet(path("in")).schema
    # What the dead attempt left is on disk, but does not count.
    assert ids(jobs.landed(spark, path("out"), schema)) == sorted(f"m{i}" for i in range(40))
    assert spark.read.parquet(path("out")).count() == 70
    ingest(spark, path).awaitTermination()
    mail(spark, range(60, 80)).coalesce(1).write.mode("append").parquet(path("in"))
    ingest(spark, path).awaitTermination()
    assert ids(jobs.landed(spark, path("out"), schema)) == sorted(f"m{i}" for i in range(80))
    gone = Commits(spark, path("out")).sweep([path("out"), path("ledger")])
    assert gone and spark.read.parquet(path("out")).count() == 80
    assert ids(jobs.landed(spark, path("out"), schema)) == sorted(f"m{i}" for i in range(80))


def test_ingest_dies_before_its_mark(spark, tmp_path, monkeypatch):
    path = lambda n: str(tmp_path / n)
    mail(spark, range(30)).coalesce(1).write.parquet(path("in"))
    real, left = Commits._mark, {"n": 1}

    def mark(self, *args):
        if left["n"]:
            left["n"] -= 1
            raise OSError("the driver is gone")
        real(self, *args)

    monkeypatch.setattr(Commits, "_mark", mark)
    with pytest.raises(Exception, match="the driver is gone"):
        ingest(spark, path).awaitTermination()
    ingest(spark, path).awaitTermination()
    schema = spark.read.schema(KIND).parquet(path("in")).schema
    assert ids(jobs.landed(spark, path("out"), schema)) == sorted(f"m{i}" for i in range(30))


def test_a_batch_that_comes_again_after_its_mark_does_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    commits = Commits(spark, folder)
    assert commits.write(0, {folder: (spark.range(5), [])}) and not commits.write(0, {folder: (spark.range(5, 9), [])})
    assert commits.read(folder, spark.range(0).schema).count() == 5
    with pytest.raises(RuntimeError):
        commits._mark(0, "another")
    assert not exists(spark, str(tmp_path / "none")) and Commits(spark, str(tmp_path / "none")).read(
        str(tmp_path / "none"), spark.range(0).schema).count() == 0


def test_folding_keeps_every_row(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    schema = mail(spark, []).schema
    for k in range(4):
        mail(spark, range(10 * k, 10 * k + 15)).coalesce(1).write.mode("append").parquet(path("in"))
        ingest(spark, path).awaitTermination()
    assert jobs.fold_ingested(spark, path("ledger"), path("out"), schema) == 3
    want = sorted(f"m{i}" for i in range(45))
    commits = Commits(spark, path("out"))
    assert ids(jobs.landed(spark, path("out"), schema)) == want and commits.attempts().count() == 1
    assert commits.holds(2) and not commits.holds(4)
    mail(spark, range(40, 60)).coalesce(1).write.mode("append").parquet(path("in"))
    ingest(spark, path).awaitTermination()
    commits.sweep([path("out"), path("ledger")])
    assert ids(jobs.landed(spark, path("out"), schema)) == sorted(f"m{i}" for i in range(60)) and commits.attempts().count() == 2
    assert spark.read.parquet(path("out")).count() == 60


def test_followers_get_what_is_committed(spark, tmp_path, monkeypatch):
    path = lambda n: str(tmp_path / n)
    schema, got = mail(spark, []).schema, []
    handle = lambda rows, number: got.extend(r.provider_message_id for r in rows.collect())
    follow = lambda: Commits(spark, path("out")).follow(path("out"), schema, handle, path("cp2"))
    mail(spark, range(10)).coalesce(1).write.mode("append").parquet(path("in"))
    ingest(spark, path).awaitTermination()
    follow().awaitTermination()
    mail(spark, range(5, 25)).coalesce(1).write.mode("append").parquet(path("in"))
    dies_at(monkeypatch, path("ledger"))
    with pytest.raises(Exception, match="the driver is gone"):
        ingest(spark, path).awaitTermination()
    follow().awaitTermination()
    assert sorted(got) == sorted(f"m{i}" for i in range(10))
    ingest(spark, path).awaitTermination()
    follow().awaitTermination()
    assert sorted(got) == sorted(f"m{i}" for i in range(25))


@pytest.mark.parametrize("table", ["retry", "dead"])
def test_draining_dies_between_its_writes(spark, tmp_path, monkeypatch, table):
    path = lambda n: str(tmp_path / n)
    failed = spark.range(30).select(
        F.lit("mail").alias("queue"), F.col("id").alias("msg_id"), (F.col("id") % 8).cast("int").alias("read_count"),
        F.lit('{"text": "secret", "id": 1}').alias("body"))
    failed.write.parquet(path("in"))
    drain = lambda: jobs.drain_failures(
        spark.readStream.schema(FAILED).parquet(path("in")), path("retry"), path("dead"), path("cp"))
    dies_at(monkeypatch, path(table))
    with pytest.raises(Exception, match="the driver is gone"):
        drain().awaitTermination()
    drain().awaitTermination()
    again, gone = jobs.drained(spark, path("retry"), path("dead"), failed.schema)
    want_again, want_gone = dead_letters(failed)
    show = lambda df, like: sorted(map(str, df.select(*like.columns).collect()))
    assert show(again, want_again) == show(want_again, want_again) and show(gone, want_gone) == show(want_gone, want_gone)
