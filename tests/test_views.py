"""Totals that a stream keeps equal the reports worked out anew, and a batch reads its own cases only."""

from pyspark.sql import functions as F

from caseledger.operators.activity import with_activity
from caseledger.operators.fold import project_cases
from caseledger.operators.log import interviews_from_events, sources_from_events
from caseledger.operators.reach import phase_reach, stage_dwell_in
from caseledger.plans import statistics
from caseledger.schemas import EVENT
from caseledger.session import kept
from caseledger.streaming import jobs, views


def as_set(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def reports(log, cases, stage_defs, now):
    projected = kept(project_cases(cases, log, now, stage_defs=stage_defs))
    reach, sources = kept(phase_reach(projected, log, stage_defs)), sources_from_events(log)
    active = kept(with_activity(projected, stage_defs, stage_dwell_in(log), interviews_from_events(log), now))
    return {
        "effect": statistics.channel_effectiveness(sources, reach),
        "channels": statistics.channels(sources, reach, active),
        **{f"funnel {p}": statistics.funnel(reach, now, p) for p in ("12m", "90d", "all")},
    }


def maintained(spark, folder, now):
    return {
        "effect": views.channel_effectiveness(spark, folder), "channels": views.channels(spark, folder, now),
        **{f"funnel {p}": views.funnel(spark, folder, now, p) for p in ("12m", "90d", "all")},
    }


def test_ten_batches_equal_the_report(spark, tables, tmp_path):
    path = lambda n: str(tmp_path / n)
    log = tables.log.filter("user_id < 12").select(*[f.name for f in EVENT.fields])
    cases = tables.cases.filter("user_id < 12")
    cases.write.parquet(path("cases"))
    log.write.parquet(path("all"))
    log, cases = spark.read.schema(log.schema).parquet(path("all")), spark.read.schema(cases.schema).parquet(path("cases"))
    run = lambda: jobs.project(
        spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path("in")), path("log"), path("states"),
        path("cp"), stage_defs=tables.stage_defs, buckets=4, views=(path("cases"), path("views")),
    ).awaitTermination()
    # The newest events come first; each batch brings back some of the one before.
    for k in range(9, -1, -1):
        again = log.filter((F.col("seq") % 10 == (k + 1) % 10) & (F.col("seq") % 7 == 0))
        log.filter(F.col("seq") % 10 == k).unionByName(again).coalesce(1).write.mode("append").parquet(path("in"))
    run()
    commits = views._commits(spark, path("views"))
    assert commits.attempts().count() == 10
    # Reports at several instants, one of them between two events of a day.
    moments = ["2024-07-15 12:00:00", "2024-10-02 09:30:00", str(log.agg(F.expr("percentile_approx(occurred_at, 0.4)")).first()[0])]
    for moment in moments:
        now = F.lit(moment).cast("timestamp")
        want, got = reports(log, cases, tables.stage_defs, now), maintained(spark, path("views"), now)
        for name, df in want.items():
            assert as_set(got[name]) == as_set(df), (moment, name)
    now = F.lit(moments[1]).cast("timestamp")
    before = {n: as_set(df) for n, df in maintained(spark, path("views"), now).items()}
    assert len(before["channels"]) > 10 and views.fold_views(spark, path("views")) == 9
    commits.sweep(list(views._folders(path("views")).values()))
    assert {n: as_set(df) for n, df in maintained(spark, path("views"), now).items()} == before
    # Totals go on from the fold.
    more = log.filter("user_id = 3").withColumn("occurred_at", F.col("occurred_at") + F.expr("INTERVAL 1 HOUR")).withColumn(
        "seq", F.col("seq") + 10**9)
    more.coalesce(1).write.mode("append").parquet(path("in"))
    run()
    for name, df in reports(log.unionByName(more), cases, tables.stage_defs, now).items():
        assert as_set(maintained(spark, path("views"), now)[name]) == as_set(df), name


def test_a_batch_reads_its_buckets_and_counts_once(spark, tables, tmp_path):
    path = lambda n: str(tmp_path / n)
    log = tables.log.filter("user_id < 8").select(*[f.name for f in EVENT.fields])
    cases = tables.cases.filter("user_id < 8")
    touched = log.select("user_id", "case_id").distinct().withColumn("bucket", jobs.bucket(n=4))
    assert views.refresh_views(spark, cases, log, touched, path("v"), tables.stage_defs, 0)
    before = as_set(views.channel_effectiveness(spark, path("v")))
    assert not views.refresh_views(spark, cases, log, touched, path("v"), tables.stage_defs, 0)
    # The same cases again change nothing, a case that is merged away is taken off.
    assert views.refresh_views(spark, cases, log, touched, path("v"), tables.stage_defs, 1)
    assert as_set(views.channel_effectiveness(spark, path("v"))) == before
    one = touched.filter("user_id = 3")
    merged = cases.filter("user_id = 3").withColumn("merged_into_id", F.lit(1).cast("long"))
    assert views.refresh_views(spark, merged, log.filter("user_id = 3"), one, path("v"), tables.stage_defs, 2)
    left = views.channel_effectiveness(spark, path("v"))
    want = [x for x in before if "user_id=3)" not in x and "user_id=3," not in x]
    assert as_set(left) == want and len(want) < len(before)
