"""Appends to the bucketed log: the log is not dealt out again, and a hot case is spread over all buckets."""

from pyspark.sql import functions as F

from caseledger.operators.log import EVENT_KEY, dedupe_events, new_events
from caseledger.schemas import EVENT
from caseledger.sources.log_table import LogTable


def rows(df):
    return sorted(map(str, df.select(*EVENT_KEY).collect()))


def test_append(spark, tables, tmp_path):
    log = tables.log_with_repeats.filter("user_id < 30").select(*[f.name for f in EVENT.fields])
    table = LogTable(spark, "log_append", str(tmp_path / "log"), 8)
    try:
        table.create(log.filter("seq % 3 <> 0"))
        want = new_events(log.filter("seq % 3 <> 0"), log)
        fresh = table.append(log)
        assert rows(fresh) == rows(want) and fresh.count() > 100
        assert rows(table.read()) == rows(dedupe_events(log)) and table.append(log).count() == 0
        assert table.read().count() == dedupe_events(log).count()
    finally:
        spark.sql("DROP TABLE IF EXISTS log_append")


def test_the_log_is_not_exchanged(spark, tables, tmp_path):
    log = tables.log.filter("user_id < 30").select(*[f.name for f in EVENT.fields])
    hot = log.limit(1).crossJoin(spark.range(4000)).withColumn("occurred_at", F.col("occurred_at") + F.expr("make_interval(0,0,0,0,0,0,id)")).drop("id")
    table = LogTable(spark, "log_plan", str(tmp_path / "log"), 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        table.create(log.unionByName(hot))
        per_file = [r["count"] for r in table.read().groupBy(F.input_file_name()).count().collect()]
        assert len(per_file) == 8 and max(per_file) < 2 * min(per_file)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = table.new_events(log)._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(i for i, x in enumerate(plan) if "Bucketed: true" in x)
        depth = lambda x: len(x) - len(x.lstrip(" :+-*(0123456789)"))
        above, at = [], depth(plan[scan])
        for line in reversed(plan[:scan]):
            if depth(line) < at:
                above.append(line)
                at = depth(line)
        joins = [i for i, x in enumerate(above) if "Join" in x]
        assert joins and not any("Exchange" in x for x in above[: joins[0]]), "\n".join(plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS log_plan")
