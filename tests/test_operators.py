"""Operators against brute force on small fixtures."""

import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from caseledger.operators import similarity, skew
from caseledger.operators.fold import fold
from caseledger.operators.similarity import similar_pairs, with_sparse_from_dense
from caseledger.plans.nudges import delivery
from caseledger.schemas import EVENT


def log(spark, rows):
    """rows: (case, seq, type, day, confidence, payload dict, to_stage)"""
    names = [f.name for f in EVENT["payload"].dataType.fields]
    out = []
    for case, seq, kind, day, confidence, payload, to_stage in rows:
        at = datetime(2024, 1, 1) + timedelta(days=day)
        out.append((1, case, seq, kind, at, at, None, to_stage, confidence, f"m-{seq}", 1,
                    tuple(payload.get(n) for n in names)))
    return spark.createDataFrame(out, EVENT)


HISTORY = [
    (1, 1, "acknowledged", 0, 0.99, {}, "acknowledged"),
    (1, 2, "stage_advanced", 11, 0.94, {}, "hr_call"),
    (2, 3, "applied", 0, 1.0, {}, "applied"),
    (2, 4, "rejected", 5, 0.9, {}, None),
    (2, 5, "stage_advanced", 9, 0.9, {}, "final"),
    (3, 6, "applied", 0, 1.0, {}, "applied"),
    (3, 7, "rejected", 5, 0.9, {}, None),
    (3, 8, "stage_advanced", 9, 0.9, {}, "final"),
    (3, 9, "human_corrected", 1, 1.0, {"field": "status", "to": "live"}, None),
    (4, 10, "interview_scheduled", 2, 0.9, {"stage": "technical", "status": "cancelled"}, None),
    (5, 11, "offer_received", 2, 0.59, {}, "offer"),
    (6, 12, "human_corrected", 3, 1.0, {"field": "applied_at", "to": "not a date"}, None),
    (6, 13, "acknowledged", 4, 0.9, {"role_title": ""}, "acknowledged"),
]


def states(df):
    return {r.case_id: r for r in fold(df).collect()}


def test_fold_rules(spark):
    got = states(log(spark, HISTORY))
    assert got[1].current_stage == "hr_call"  # recency beats confidence
    assert (got[2].status, got[2].current_stage) == ("rejected", "applied")  # frozen
    assert (got[3].status, got[3].current_stage) == ("live", "final")  # reopened by a person
    assert got[4].current_stage == "applied"  # a cancelled round claims nothing
    assert (got[5].current_stage, got[5].confidence) == ("applied", 0.0)  # below the floor
    assert got[6].applied_at == datetime(2024, 1, 5) and got[6].role_title == ""


def test_fold_does_not_depend_on_order(spark):
    wanted = states(log(spark, HISTORY))
    for seed in range(3):
        rows = HISTORY[:]
        random.Random(seed).shuffle(rows)
        assert states(log(spark, rows).repartition(3)) == wanted


def test_lag_of_a_hot_key_in_slices(spark):
    rows = [(1 if i % 3 else i % 7, datetime(2024, 1, 1) + timedelta(hours=7 * i), i, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, at timestamp, seq int, v int")
    args = (["k"], ["at", "seq"], {"before": "v"})
    cut = skew.lagged(df, *args, slice_of=F.date_trunc("day", "at"))
    whole = skew.lagged(df, *args, slice_of=F.lit(0))
    assert sorted(cut.collect()) == sorted(whole.collect())


def test_exact_percentiles(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i % 4, r.random() * 3 if i % 4 else 1.5) for i in range(500)], "k int, v double")
    got = {x.k: (x.p50, x.p90, x.n) for x in skew.exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    want = df.groupBy("k").agg(F.expr("percentile(v, 0.5)").alias("a"), F.expr("percentile(v, 0.9)").alias("b"), F.count("*").alias("n"))
    for x in want.collect():
        assert abs(got[x.k][0] - x.a) < 1e-12 and abs(got[x.k][1] - x.b) < 1e-12 and got[x.k][2] == x.n


def test_similar_pairs_finds_all(spark):
    r = random.Random(2)
    rows = [(i % 2, i, [r.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    v = with_sparse_from_dense(spark.createDataFrame(rows, "b int, vec_id int, e array<double>"), "e").drop("e")
    got = {(x.left_id, x.right_id) for x in similar_pairs(v, v, ["b"], 0.8).collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    want = {(i, j) for b, i, x in rows for c, j, y in rows if b == c and cos(x, y) >= 0.8}
    assert got == want


def test_high_cosines_meet_by_two_dimensions(spark):
    """All pairs, among them vectors of one dimension and of nearly one, and fewer candidates than by one dimension."""
    r = random.Random(3)
    rows = []
    for i in range(60):
        base = [r.gauss(0, 1) if r.random() < 0.3 else 0.0 for _ in range(24)]
        rows += [(base, 0.0), (base, 0.1), (base, 0.2)]
    rows = [[x + r.gauss(0, s) if x else x for x in base] for base, s in rows]
    rows += [[0.0] * k + [sign * 2.0] + [0.0] * (23 - k) for k in (0, 5) for sign in (1, -1)]
    rows += [[4.0] + [r.gauss(0, 0.2) for _ in range(23)] for _ in range(4)] + [[0.0] * 24]
    rows = [(i % 2, i, x) for i, x in enumerate(rows)]
    v = with_sparse_from_dense(spark.createDataFrame(rows, "b int, vec_id int, e array<double>"), "e").drop("e")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 or 1)

    for t in (0.9, 0.93, 0.99):
        got = {(x.left_id, x.right_id) for x in similar_pairs(v, v, ["b"], t).collect()}
        assert got == {(i, j) for b, i, x in rows for c, j, y in rows if b == c and cos(x, y) >= t}
    seen = v.select(F.explode("vector.dim").alias("dim")).groupBy("dim").agg(F.count("*").alias("seen"))
    by_one = similarity._prefixes(v, ["b"], seen, 0.93).select("b", "vec_id", "dim", "up")
    ones = by_one.join(by_one.withColumnRenamed("vec_id", "other"), ["b", "dim", "up"]).select("vec_id", "other").distinct().count()
    assert similarity._candidates(v, v, ["b"], seen, 0.93).count() < 0.75 * ones


def brute_delivery(pending, zones, sent):
    """The notifications one after the other, as a service would judge them."""
    used = {(u, d) for u, d in sent}
    queue = sorted((at, 0, at, key, u, rule, by) for u, key, rule, at, by in pending)
    out = {}

    def local(at, u):
        return at.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zones[u]))

    while queue:
        queue.sort()
        at, _, raised, key, u, rule, by = queue.pop(0)
        here = local(at, u)
        if rule == "let_it_go":
            out[key] = "suppressed"
        elif not by and (u, here.date()) in used:
            out[key] = "suppressed"
        elif not by and (here.hour >= 21 or here.hour < 8):
            end = here.replace(hour=8, minute=0, second=0, microsecond=0)
            if end <= here:
                end = (end.replace(tzinfo=None) + timedelta(days=1)).replace(tzinfo=ZoneInfo(zones[u]))
            queue.append((end.astimezone(ZoneInfo("UTC")).replace(tzinfo=None), 1, raised, key, u, rule, by))
        else:
            out[key] = "sent"
            used.add((u, here.date()))
    return out


def test_delivery_equals_a_service(spark):
    zones = {1: "Etc/UTC", 2: "Europe/Rome", 3: "Asia/Tokyo"}
    for seed in range(4):
        r = random.Random(seed)
        pending = []
        for i in range(160):
            rule = r.choice(["deadline", "follow_up_due", "follow_up_due", "prepare", "let_it_go"])
            # Times that never fall on the end of a quiet window.
            at = datetime(2024, 5, 1) + timedelta(minutes=r.randrange(0, 60 * 24 * 25), seconds=13 + i % 40)
            pending.append((r.randrange(1, 4), f"{i:03d}", rule, at, rule == "deadline"))
        sent = [(1, datetime(2024, 5, 3).date()), (2, datetime(2024, 5, 7).date())]
        users = spark.createDataFrame(list(zones.items()), "user_id int, tz string")
        df = spark.createDataFrame(pending, "user_id int, suggestion_key string, rule string, at timestamp, bypasses_budget boolean")
        done = delivery(df, users, spark.createDataFrame(sent, "user_id int, local_date date"))
        got = {x.suggestion_key: x.outcome for x in done.collect()}
        # Those that wait for the same morning are judged by the time they were raised.
        assert got == brute_delivery(pending, zones, sent)
