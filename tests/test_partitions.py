"""Erasure and retention on stored tables: only touched partitions are written, and no file holds what is gone."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from caseledger.sources import partitions
from caseledger.sources.partitions import Partitions, bucket, erase_stored, finish_erasing, purge_stored

N = 8


def table(spark, path, rows=400):
    df = spark.range(rows).select((F.col("id") % 20).alias("user_id"), F.col("id").alias("x")).withColumn("bucket", bucket(n=N))
    t = Partitions(spark, path, df.schema)
    t.append(df.filter("x < 250"))
    t.append(df.filter("x >= 250"))
    return t, df


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def holding(path, users):
    return [f for f in files(path) if set(pq.ParquetFile(f).read(["user_id"])["user_id"].to_pylist()) & set(users)]


def rows(df):
    return sorted(map(tuple, df.select("user_id", "x").collect()))


def test_erasing_one_tenant(spark, tmp_path):
    one, df = table(spark, str(tmp_path / "one"))
    two, _ = table(spark, str(tmp_path / "two"), 60)
    assert rows(one.read()) == rows(df)
    before = files(tmp_path / "one")
    erase_stored({"one": one, "two": two}, [3], N)
    want = [r for r in rows(df) if r[0] != 3]
    assert rows(one.read()) == want and len(want) < 400 and rows(two.read()) == [r for r in want if r[1] < 60]
    assert not holding(tmp_path / "one", [3]) and not holding(tmp_path / "two", [3])
    own = spark.range(1).select(F.lit(3).cast("long").alias("user_id")).select(bucket(n=N)).first()[0]
    after = files(tmp_path / "one")
    assert {f for f in before if f"bucket={own}/" not in f} == {f for f in after if f in before}
    assert all(f"bucket={own}/" in f for f in after if f not in before)
    # The table goes on, and the tenant may come back.
    one.append(df.filter("user_id = 3 AND x < 30"))
    assert rows(one.read()) == sorted(want + [r for r in rows(df) if r[0] == 3 and r[1] < 30])
    erase_stored({"one": one}, [], N)
    erase_stored({"one": one}, [555], N)
    assert len(rows(one.read())) == len(want) + 2


@pytest.mark.parametrize("step", ["_write", "_mark", "_remove"])
def test_a_job_that_dies_goes_on(spark, tmp_path, monkeypatch, step):
    t, df = table(spark, str(tmp_path / "t"))
    want = [r for r in rows(df) if r[0] not in (3, 4)]
    real = getattr(Partitions, step)

    def dies(self, *args):
        raise OSError("the driver is gone")

    monkeypatch.setattr(Partitions, step, dies)
    with pytest.raises(OSError, match="gone"):
        erase_stored({"t": t}, [3, 4], N)
    # Nobody sees them any more, although files still hold them.
    assert rows(t.read()) == want and holding(tmp_path / "t", [3, 4])
    monkeypatch.setattr(Partitions, step, real)
    finish_erasing(t, N)
    assert rows(t.read()) == want and not holding(tmp_path / "t", [3, 4])
    assert t._gone().count() == 0


def test_retention_by_day(spark, tmp_path):
    df = spark.range(240).select(
        F.col("id").alias("x"), (F.col("id") % 5).alias("user_id"),
        (F.lit("2024-07-01").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, CAST(id AS INT))")).alias("stored_at"),
    ).withColumn("day", F.to_date("stored_at").cast("string"))
    t = Partitions(spark, str(tmp_path / "t"), df.schema, by="day")
    t.append(df)
    before = files(tmp_path / "t")
    cut = F.lit("2024-07-05 07:30:00").cast("timestamp")
    purge_stored(t, F.to_date(cut), F.col("stored_at") >= cut)
    assert rows(t.read()) == rows(df.filter(F.col("stored_at") >= cut))
    after = files(tmp_path / "t")
    kept = {f for f in before if f.split("day=")[1][:10] > "2024-07-05"}
    assert kept == set(before) & set(after) and {f.split("day=")[1][:10] for f in set(after) - set(before)} == {"2024-07-05"}
    purge_stored(t, F.to_date(cut), F.col("stored_at") >= cut)
    assert rows(t.read()) == rows(df.filter(F.col("stored_at") >= cut))


def test_an_empty_table(spark, tmp_path):
    schema = spark.range(0).select(F.col("id").alias("user_id"), bucket("id").alias("bucket")).schema
    t = Partitions(spark, str(tmp_path / "t"), schema)
    assert t.read().count() == 0
    erase_stored({"t": t}, [1])
    assert t.read().count() == 0 and partitions.BUCKETS == 64
