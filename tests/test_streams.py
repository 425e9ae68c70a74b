"""Streams give what the batch forms give, and go over what a batch touches."""

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from caseledger.operators.fold import fold
from caseledger.operators.reach import phase_reach
from caseledger.plans.sweeps import dead_letters
from caseledger.schemas import EVENT
from caseledger.streaming import jobs, views


def parts(tables, tmp_path):
    """The log of some tenants in three files, the newest first, each with events of the one before."""
    log = tables.log.filter("user_id < 12").select(*[f.name for f in EVENT.fields])
    for rest in ((2, 0), (1, 2), (0, 1)):
        log.filter(F.col("seq") % 3 == rest[0]).unionByName(log.filter((F.col("seq") % 3 == rest[1]) & (F.col("seq") % 7 == 0))).coalesce(
            1).write.mode("append").parquet(str(tmp_path / "in"))
    return log


def as_set(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_states_and_reach_equal_the_batch(spark, tables, tmp_path):
    log = parts(tables, tmp_path)
    path = lambda n: str(tmp_path / n)
    cases = tables.projected.filter("user_id < 12")
    cases.write.parquet(path("cases"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path("in"))
    jobs.project(
        stream, path("log"), path("states"), path("cp"), stage_defs=tables.stage_defs, buckets=4,
        reach=(path("cases"), path("reach")),
    ).awaitTermination()
    want = fold(log, tables.stage_defs)
    assert as_set(jobs.current(spark, path("states"), jobs.CASE), want.columns) == as_set(want, want.columns)
    reach = phase_reach(cases, log, tables.stage_defs)
    got = jobs.current(spark, path("reach"), jobs.CASE)
    assert as_set(got, reach.columns) == as_set(reach.filter("event_count > 0"), reach.columns)
    jobs.compact(spark, path("states"), jobs.CASE, path("compacted"))
    assert spark.read.parquet(path("compacted")).count() == want.count()
    assert as_set(jobs.current(spark, path("compacted"), jobs.CASE), want.columns) == as_set(want, want.columns)

    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path("in"))
    jobs.refresh_reach(
        stream, path("cases"), path("log"), tables.stage_defs, path("again"), path("cp2"), buckets=4, every=None
    ).awaitTermination()
    assert as_set(jobs.current(spark, path("again"), jobs.CASE), reach.columns) == as_set(got, reach.columns)


def test_a_tenant_reads_its_partition_only(spark, tables, tmp_path):
    schema = StructType([*EVENT.fields, StructField("bucket", IntegerType())])
    log = tables.log.select(*[f.name for f in EVENT.fields]).withColumn("bucket", jobs.bucket(n=16))
    log.write.partitionBy("bucket").parquet(str(tmp_path / "log"))
    touched = log.filter("user_id = 3").select(*jobs.CASE, "bucket").distinct()
    rows = jobs.touched_log(spark, str(tmp_path / "log"), schema, touched)
    number = touched.first().bucket
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "(bucket#" in plan and f"= {number})" in plan.split("PartitionFilters")[1][:200]
    assert rows.count() == log.filter("user_id = 3").count()


def test_joins_of_a_batch_do_not_go_by_the_size_of_files(spark, tables, tmp_path, monkeypatch):
    """Stages and stored events whose files are small are joined by shuffles until their rows have been seen to be few."""
    path = lambda n: str(tmp_path / n)
    log = tables.log.filter("user_id < 3").select(*[f.name for f in EVENT.fields])
    for k in range(2):
        log.filter(F.col("seq") % 2 == k).coalesce(1).write.mode("append").parquet(path("in"))
    tables.cases.filter("user_id < 3").withColumn("status", F.lit("live")).withColumn("applied_at", F.col("created_at")).withColumn(
        "current_phase", F.lit("sent")).write.parquet(path("cases"))
    tables.stage_defs.filter("user_id < 3").write.parquet(path("stages"))
    plans, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def seen(call):
        def noted(*args):
            rows = call(*args)
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            return rows

        return noted

    contributions = seen(views.contributions)
    for name in ("new_events", "fold", "phase_reach"):
        monkeypatch.setattr(jobs, name, seen(getattr(jobs, name)))
    monkeypatch.setattr(
        jobs, "refresh_views", lambda spark, cases, log, touched, folder, stage_defs, number: contributions(cases, log, stage_defs))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path("in"))
    jobs.project(
        stream, path("log"), path("states"), path("cp"), stage_defs=spark.read.parquet(path("stages")), buckets=4,
        reach=(path("cases"), path("reach")), views=(path("cases"), path("views")),
    ).awaitTermination()
    assert len(plans) == 8 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_large_sides_are_measured_and_kept_from_the_driver(spark):
    other = spark.newSession()
    for size, measured in (("10MB", str(10 * 2**20 // 8)), ("-1", "-1")):
        other.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        other.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        for _ in range(2):
            jobs._measured(other)
            assert other.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == measured
            assert other.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"


def test_projection_does_not_broadcast_parts_or_stages(spark, tables):
    plan = tables.cases._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_failures_drain(spark, tables, tmp_path):
    path = lambda n: str(tmp_path / n)
    failed = spark.range(12).select(
        F.lit("mail").alias("queue"), F.col("id").alias("msg_id"), (F.col("id") % 8).cast("int").alias("read_count"),
        F.lit('{"text": "a \\"secret\\"", "id": 1}').alias("body"))
    failed.write.parquet(path("in"))
    again, gone = dead_letters(failed)
    jobs.drain_failures(spark.readStream.schema(failed.schema).parquet(path("in")), path("retry"), path("dead"), path("cp")).awaitTermination()
    assert as_set(spark.read.parquet(path("retry")), again.columns) == as_set(again, again.columns)
    dead = spark.read.parquet(path("dead"))
    assert as_set(dead, gone.columns) == as_set(gone, gone.columns)
    assert {r.body for r in dead.collect()} == {'{"text": "[stripped]", "id": 1}'}
