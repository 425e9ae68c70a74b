"""The delivery stream gives what the batch form gives, however it is cut into batches and restarted."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseledger.plans.nudges import delivery
from caseledger.streaming.delivery import deliver

PENDING = "user_id long, suggestion_key string, rule string, at timestamp, bypasses_budget boolean"
COLUMNS = ["user_id", "suggestion_key", "rule", "outcome", "reason", "delivered_at", "local_date"]


def as_set(df):
    return sorted(map(str, df.select(*COLUMNS).collect()))


def write(spark, rows, path):
    spark.createDataFrame(rows, PENDING).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, users, sent):
    stream = spark.readStream.schema(PENDING).option("maxFilesPerTrigger", 1).parquet(path("in"))
    deliver(stream, users, sent, path("out"), path("cp"), live=False).awaitTermination()


def random_pushes(n, tenants, days, seed):
    import random

    rng = random.Random(seed)
    start = datetime(2024, 3, 20)
    rows = []
    for k in range(n):
        rule = rng.choice(["deadline"] + ["follow_up_due"] * 8 + ["let_it_go"])
        at = start + timedelta(seconds=rng.randrange(days * 86400), microseconds=rng.randrange(10**6))
        rows.append((rng.randrange(tenants), f"k{k}", rule, at, rule == "deadline"))
    return sorted(rows, key=lambda r: r[3])


@pytest.fixture()
def small_state(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_replay_equals_the_batch_through_restarts(spark, tmp_path, small_state):
    path = lambda n: str(tmp_path / n)
    rows = random_pushes(600, 7, 16, 3)
    users = spark.createDataFrame(
        [(0, "Europe/Rome"), (1, "Asia/Tokyo"), (2, "America/New_York"), (3, "Etc/UTC"), (4, None)], "user_id long, tz string"
    )
    sent = spark.createDataFrame([(0, "2024-03-21"), (1, "2024-03-30"), (2, "2024-03-22"), (2, "2024-03-22")], "user_id long, d string").select(
        "user_id", F.to_date("d").alias("local_date"))
    # A tenant's history may reach beyond its first push.
    third = len(rows) // 3
    for part in (rows[: third // 2], rows[third // 2 : third]):
        write(spark, part, path("in"))
    run(spark, path, users, sent)
    write(spark, rows[third : 2 * third], path("in"))
    run(spark, path, users, sent)
    run(spark, path, users, sent)
    for part in (rows[2 * third :], [(99, "end", "let_it_go", rows[-1][3] + timedelta(days=3), False)]):
        write(spark, part, path("in"))
        run(spark, path, users, sent)
    got = spark.read.parquet(path("out")).filter("user_id <> 99")
    want = delivery(spark.createDataFrame(rows, PENDING), users, sent)
    assert as_set(got) == as_set(want)
    outcomes = {r["outcome"]: r["n"] for r in got.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert outcomes["sent"] > 50 and outcomes["suppressed"] > 50


def test_what_waits_is_not_told_before_its_time(spark, tmp_path, small_state):
    path = lambda n: str(tmp_path / n)
    evening = datetime(2024, 5, 6, 22, 30)
    users = spark.createDataFrame([(1, "Etc/UTC")], "user_id long, tz string")
    none = spark.createDataFrame([], "user_id long, local_date date")
    write(spark, [(1, "a", "follow_up_due", evening, False), (1, "b", "follow_up_due", evening + timedelta(hours=1), False)], path("in"))
    run(spark, path, users, none)
    first = {r["suggestion_key"]: r["outcome"] for r in spark.read.parquet(path("out")).collect()}
    assert first == {"b": "suppressed"}
    # A deadline takes the morning before the window ends.
    write(spark, [(1, "c", "deadline", datetime(2024, 5, 7, 6), True), (2, "x", "let_it_go", datetime(2024, 5, 7, 9), False)], path("in"))
    run(spark, path, users, none)
    later = {r["suggestion_key"]: r["outcome"] for r in spark.read.parquet(path("out")).collect()}
    assert later == {"a": "suppressed", "b": "suppressed", "c": "sent", "x": "suppressed"}


def test_a_live_stream_needs_no_new_rows(spark, tmp_path, small_state):
    """By the clock of the machine a push of the past whose window is over goes without anything after it."""
    path = lambda n: str(tmp_path / n)
    users = spark.createDataFrame([(1, "Etc/UTC")], "user_id long, tz string")
    none = spark.createDataFrame([], "user_id long, local_date date")
    write(spark, [(1, "a", "follow_up_due", datetime(2024, 5, 6, 22), False), (1, "b", "deadline", datetime(2024, 5, 6, 23), True)], path("in"))
    query = deliver(spark.readStream.schema(PENDING).parquet(path("in")), users, none, path("out"), path("cp"))
    try:
        for _ in range(60):
            query.awaitTermination(1)
            try:
                told = {r["suggestion_key"]: (r["outcome"], str(r["local_date"])) for r in spark.read.parquet(path("out")).collect()}
            except Exception:  # noqa: BLE001 nothing has been written yet
                continue
            if len(told) == 2:
                break
    finally:
        query.stop()
    assert told == {"a": ("sent", "2024-05-07"), "b": ("sent", "2024-05-06")}
