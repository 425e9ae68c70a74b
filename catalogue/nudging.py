"""Nudge rules, suggestions and their delivery."""

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from caseledger import constants as C
from caseledger.functions import clock as K
from caseledger.operators import stages as stage_ops
from caseledger.plans import nudges as ops
from caseledger.session import dealt, kept, shared_folder
from caseledger.streaming.delivery import deliver

from .base import NOW, Registry, iso, ziso
from .board import _OPEN
from .shapes import cte
from .sweeps import _MAILBOX, ledger, mailboxes

REGISTRY = Registry()
add = REGISTRY.add

_REL = f"""CASE WHEN h < 0 THEN 'overdue' WHEN h < 1 THEN 'within the hour'
  WHEN h < 24 THEN concat('in ', CAST(round_even(h, 0) AS INT), ' hours')
  WHEN round_even(h / 24, 0) = 1 THEN 'tomorrow' ELSE concat('in ', CAST(round_even(h / 24, 0) AS INT), ' days') END"""
cte("snap", """SELECT a.*, c.canonical_name AS company, coalesce(s.depth, 0) AS depth,
  coalesce(s.label, a.current_stage) AS label, coalesce(s.stale_after_days, 21) AS stale
  FROM projected a JOIN companies_ c USING (company_id)
  LEFT JOIN stages_ s ON s.user_id = a.user_id AND s.key = a.current_stage WHERE a.merged_into_id IS NULL""",
    "projected companies_ stages_")
cte("n1", f"""SELECT user_id, concat('deadline:', case_id) AS key, 'deadline' AS rule, case_id, CAST(1 AS BIGINT) AS members, {_REL} AS meta,
  concat(company, ' ', replace(kind, '_', '-'), ' due ', strftime(due_at, '%A')) AS title, due_at AS expires_at, due_at AS urgency_at, depth, true AS pushable, true AS bypasses_budget
  FROM (SELECT s.*, d.kind, d.due_at, epoch(d.due_at - TIMESTAMP '{NOW}') / 3600 AS h,
    row_number() OVER (PARTITION BY s.user_id, s.case_id ORDER BY d.due_at, d.deadline_id) AS rn
    FROM snap s JOIN deadlines_ d USING (user_id, case_id)
    WHERE status = 'live' AND d.due_at > TIMESTAMP '{NOW}' AND d.due_at <= TIMESTAMP '{NOW}' + INTERVAL 168 HOURS) x WHERE rn = 1""", "snap deadlines_")
cte("n2", f"""SELECT user_id, concat('prepare:', case_id) AS key, 'prepare' AS rule, case_id, CAST(1 AS BIGINT) AS members, {_REL} AS meta,
  concat(company, ' ', lower(round), ' ', {_REL}) AS title, starts_at AS expires_at, starts_at AS urgency_at, depth, true AS pushable, false AS bypasses_budget
  FROM (SELECT s.*, i.starts_at, coalesce(g.label, i.stage) AS round, epoch(i.starts_at - TIMESTAMP '{NOW}') / 3600 AS h,
    row_number() OVER (PARTITION BY s.user_id, s.case_id ORDER BY i.starts_at, i.interview_id) AS rn
    FROM snap s JOIN interviews_ i USING (user_id, case_id) LEFT JOIN stages_ g ON g.user_id = i.user_id AND g.key = i.stage
    WHERE status = 'live' AND i.cancelled_at IS NULL AND i.starts_at > TIMESTAMP '{NOW}' AND i.starts_at <= TIMESTAMP '{NOW}' + INTERVAL 48 HOURS) x WHERE rn = 1""",
    "snap interviews_ stages_")
cte("n3", f"""SELECT user_id, concat('follow_up_due:', case_id) AS key, 'follow_up_due' AS rule, case_id, CAST(1 AS BIGINT) AS members,
  CASE WHEN w <= 0 THEN 'today' WHEN w = 1 THEN '1 day quiet' ELSE concat(w, ' days quiet') END AS meta,
  concat(company, ' has gone quiet since the ', lower(label)) AS title,
  TIMESTAMP '{NOW}' + INTERVAL 14 DAYS AS expires_at,
  make_timestamp(epoch_us(last_signal_at) + CAST(round(lim * 86400000000) AS BIGINT)) AS urgency_at, depth, true AS pushable, false AS bypasses_budget,
  CASE WHEN p50_days IS NULL THEN concat('Nothing has come back in ', w, ' days. A short nudge is normal here.')
    ELSE concat('You last heard from them ', w, ' days ago and your median wait at this stage is ', CAST(floor(p50_days + 0.5) AS INT), ' days. A short nudge is normal here.') END AS body
  FROM (SELECT s.*, d.p50_days, coalesce(d.p75_days, s.stale * 0.6::DOUBLE) AS lim,
    CAST(floor(epoch(TIMESTAMP '{NOW}' - last_signal_at) / 86400) AS BIGINT) AS w
    FROM snap s LEFT JOIN dwell_in d ON d.user_id = s.user_id AND d.stage = s.current_stage AND d.n >= 5
    WHERE status = 'live' AND awaiting_them AND last_signal_at IS NOT NULL) x WHERE w > lim""", "snap dwell_in")
cte("idle", f"""SELECT * FROM snap WHERE status = 'dormant' AND floor(epoch(TIMESTAMP '{NOW}' - went_dormant_at) / 86400) >= 7
  AND NOT coalesce(last_user_action_at > went_dormant_at, false)""", "snap")
cte("n4", """SELECT user_id, concat('let_it_go:', min(case_id), '+', count(*) - 1, ':', printf('%x', bit_xor(('0x' || substr(md5(case_id::VARCHAR), 1, 15))::BIGINT))) AS key,
  'let_it_go' AS rule, min(case_id) AS case_id, count(*) AS members, concat(count(*), ' application', CASE WHEN count(*) = 1 THEN '' ELSE 's' END) AS meta,
  concat(arg_min(company, case_id), CASE WHEN count(*) = 1 THEN '' ELSE concat(' and ', count(*) - 1, ' more') END, CASE WHEN count(*) = 1 THEN ' looks finished' ELSE ' look finished' END) AS title,
  CAST(NULL AS TIMESTAMP) AS expires_at, min(went_dormant_at) AS urgency_at, max(depth) AS depth, false AS pushable, false AS bypasses_budget
  FROM idle GROUP BY user_id""", "idle")
cte("due", """SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * EXCLUDE body FROM n3 UNION ALL SELECT * FROM n4""", "n1 n2 n3 n4")

_COLS = f"""user_id, key, rule, case_id, members, meta, title, {ziso('expires_at')} AS expires_at, {ziso('urgency_at')} AS urgency_at, depth, pushable, bypasses_budget"""


def _shown(df):
    return iso(df.drop("body", "cta"), "expires_at", "urgency_at")


def _snap(t):
    return ops.snapshot(t.projected, t.companies, t.stage_defs)


def _all(t):
    return ops.evaluate(
        _snap(t), deadlines=t.deadlines, interviews=t.interviews, dwell=t.dwell,
        stage_defs=t.stage_defs, now=t.now,
    )


@add("n01_nudge_deadline", f"SELECT {_COLS} FROM n1", uses="n1")
def n01(t):
    return _shown(ops.deadlines_rule(_snap(t), t.deadlines, t.now))


@add("n02_nudge_prepare", f"SELECT {_COLS} FROM n2", uses="n2")
def n02(t):
    return _shown(ops.prepare_rule(_snap(t), t.interviews, t.stage_defs, t.now))


@add("n03_nudge_follow_up", f"SELECT {_COLS}, body FROM n3", uses="n3")
def n03(t):
    return iso(ops.follow_up_rule(_snap(t), t.dwell, t.now).drop("cta"), "expires_at", "urgency_at")


@add("n04_nudge_let_it_go", f"SELECT {_COLS} FROM n4", uses="n4")
def n04(t):
    return _shown(ops.let_it_go_rule(ops.lettable(_snap(t), t.now)))


@add("n04_members", "SELECT i.user_id, i.case_id, n.key FROM idle i JOIN n4 n USING (user_id)", uses="idle n4")
def n04_members(t):
    idle = ops.lettable(_snap(t), t.now)
    return ops.let_it_go_members(ops.let_it_go_rule(idle), idle).select("user_id", "case_id", "key")


@add("n05_issue_suggestions", f"SELECT {_COLS} FROM due WHERE NOT (rule = 'follow_up_due' AND case_id % 3 = 0)", uses="due")
def n05(t):
    """Follow-ups that every third case has had before do not come again."""
    stored = t.cases.filter("case_id % 3 = 0").select(
        "user_id", F.concat(F.lit("follow_up_due:"), F.col("case_id").cast("string")).alias("key")
    )
    return _shown(ops.issue(_all(t), stored))


@add("j08_insert_if_absent", "SELECT key FROM n3 WHERE user_id % 2 = 0", uses="n3")
def j08(t):
    fresh = ops.follow_up_rule(_snap(t), t.dwell, t.now)
    return ops.issue(fresh, fresh.filter("user_id % 2 = 1")).select("key")


@add("o04_rank_suggestions", """SELECT user_id, key, CAST(rn AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
  CASE rule WHEN 'deadline' THEN 0 WHEN 'prepare' THEN 1 WHEN 'follow_up_due' THEN 2 ELSE 3 END, urgency_at, depth DESC, key) AS rn FROM due) x WHERE rn <= 3""", uses="due")
def o04(t):
    return ops.rank(_all(t)).select("user_id", "key", F.col("position").cast("bigint").alias("position"))


_STORED = """(SELECT user_id, concat('follow_up_due:', case_id) AS key, min(occurred_at) AS created_at,
  CASE WHEN case_id % 5 = 1 THEN TIMESTAMP '2024-07-01' END AS acted_at, CASE WHEN case_id % 7 = 1 THEN TIMESTAMP '2024-07-01' END AS dismissed_at,
  CASE WHEN case_id % 3 = 1 THEN TIMESTAMP '2024-07-10' + to_days(CAST(case_id % 9 AS INT)) END AS snoozed_until,
  CASE WHEN case_id % 4 = 1 THEN TIMESTAMP '2024-07-10' + to_days(CAST(case_id % 11 AS INT)) END AS expires_at FROM ev GROUP BY user_id, case_id)"""


def _stored(t):
    day = lambda base, n: F.expr(f"TIMESTAMP '{base}' + make_dt_interval(CAST({n} AS INT))")
    first = F.to_timestamp(F.lit("2024-07-01"))
    c = F.col("case_id")
    return t.cases.select(
        "user_id", "case_id", F.concat(F.lit("follow_up_due:"), c.cast("string")).alias("key"), "created_at",
        F.when(c % 5 == 1, first).alias("acted_at"), F.when(c % 7 == 1, first).alias("dismissed_at"),
        F.when(c % 3 == 1, day("2024-07-10", "case_id % 9")).alias("snoozed_until"),
        F.when(c % 4 == 1, day("2024-07-10", "case_id % 11")).alias("expires_at"),
    )


@add("f07_open_suggestions", f"""SELECT user_id, key, CAST(rn AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, key) AS rn
  FROM {_STORED} s WHERE acted_at IS NULL AND dismissed_at IS NULL AND (snoozed_until IS NULL OR snoozed_until < TIMESTAMP '{NOW}')
  AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')) x WHERE rn <= 3""", uses="ev")
def f07(t):
    return ops.open_suggestions(_stored(t), t.now).select("user_id", "key", F.col("position").cast("bigint").alias("position"))


@add("n07_apply_actions", f"""SELECT key, {ziso("CASE WHEN c % 4 = 0 THEN TIMESTAMP '2024-07-12' ELSE acted_at END")} AS acted_at,
  {ziso("CASE WHEN c % 4 = 2 THEN TIMESTAMP '2024-07-12' ELSE dismissed_at END")} AS dismissed_at,
  {ziso("CASE WHEN c % 4 = 3 THEN TIMESTAMP '2024-07-13' ELSE snoozed_until END")} AS snoozed_until
  FROM (SELECT *, CAST(substr(key, 15) AS BIGINT) AS c FROM {_STORED} s) x""", uses="ev")
def n07(t):
    actions = t.cases.select(
        "user_id", F.concat(F.lit("follow_up_due:"), F.col("case_id").cast("string")).alias("key"),
        F.expr("get(array('act', 'none', 'dismiss', 'snooze'), CAST(case_id % 4 AS INT))").alias("action"),
        F.explode(F.array(*[F.to_timestamp(F.lit(d)) for d in ("2024-07-11", "2024-07-12")])).alias("at"),
    )
    out = ops.apply_actions(_stored(t), actions).select("key", "acted_at", "dismissed_at", "snoozed_until")
    return iso(out, "acted_at", "dismissed_at", "snoozed_until")


# In order of time, with the days each tenant has used so far: a push that has to wait is judged when it comes, and again
# when its quiet window ends.
_WALK = """WITH RECURSIVE pending AS (SELECT e.user_id, concat(type, ':', seq) AS key, occurred_at AS since, u.tz, type = 'deadline_set' AS bypass,
      CASE type WHEN 'deadline_set' THEN 'deadline' WHEN 'went_silent' THEN 'let_it_go' ELSE 'follow_up_due' END AS rule,
      timezone(u.tz, timezone('UTC', occurred_at)) AS l FROM ev e JOIN users_ u USING (user_id) WHERE type IN ('applied', 'deadline_set', 'went_silent')),
    judged AS (SELECT *, CASE WHEN bypass OR NOT (hour(l) >= 21 OR hour(l) < 8) THEN l WHEN hour(l) < 8 THEN date_trunc('day', l) + INTERVAL 8 HOURS ELSE date_trunc('day', l) + INTERVAL 32 HOURS END AS j FROM pending),
    steps AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, since, key, last) AS i FROM (
      SELECT *, since AS t, false AS last FROM judged WHERE j <> l UNION ALL SELECT *, timezone('UTC', timezone(tz, j)) AS t, true AS last FROM judged) y),
    sent AS (SELECT user_id, list(CAST(occurred_at AS DATE)) AS days FROM ev WHERE type = 'applied' AND seq % 50 = 0 GROUP BY user_id),
    walk AS (SELECT u.user_id, 0::BIGINT AS i, coalesce(s.days, []) AS used, []::VARCHAR[] AS dead, NULL::VARCHAR AS key, NULL::VARCHAR AS rule, false AS last, false AS goes, NULL::TIMESTAMP AS j, NULL::VARCHAR AS tz
        FROM (SELECT DISTINCT user_id FROM pending) u LEFT JOIN sent s USING (user_id)
      UNION ALL SELECT user_id, i, CASE WHEN last AND goes THEN list_append(used, CAST(j AS DATE)) ELSE used END, CASE WHEN NOT last AND NOT goes THEN list_append(dead, key) ELSE dead END, key, rule, last, goes, j, tz FROM (
        SELECT w.user_id, p.i, w.used, w.dead, p.key, p.rule, p.last, p.j, p.tz,
          p.rule <> 'let_it_go' AND (p.bypass OR NOT (list_contains(w.dead, p.key) OR list_contains(w.used, CAST(CASE WHEN p.last THEN p.j ELSE p.l END AS DATE)))) AS goes
        FROM walk w JOIN steps p ON p.user_id = w.user_id AND p.i = w.i + 1) x)
  SELECT * FROM walk WHERE last"""


_DELIVERY = f"""SELECT user_id, key AS suggestion_key, rule, CASE WHEN goes THEN 'sent' ELSE 'suppressed' END AS outcome,
  CASE WHEN rule = 'let_it_go' THEN 'never pushed' WHEN NOT goes THEN 'daily cap' END AS reason,
  CASE WHEN goes THEN {ziso("timezone('UTC', timezone(tz, j))")} END AS delivered_at, CASE WHEN goes THEN CAST(CAST(j AS DATE) AS VARCHAR) END AS local_date FROM ({_WALK}) w"""


def _pushes(t):
    """Every event of every tenant as a notification, and the days used before."""
    pending = t.log.filter("type IN ('applied', 'deadline_set', 'went_silent')").select(
        "user_id", F.concat(F.col("type"), F.lit(":"), "seq").alias("suggestion_key"),
        F.expr("CASE type WHEN 'deadline_set' THEN 'deadline' WHEN 'went_silent' THEN 'let_it_go' ELSE 'follow_up_due' END").alias("rule"),
        F.col("occurred_at").alias("at"), (F.col("type") == "deadline_set").alias("bypasses_budget"),
    )
    return pending, t.log.filter("type = 'applied' AND seq % 50 = 0").select("user_id", F.to_date("occurred_at").alias("local_date"))


@add("n06_delivery_decision", _DELIVERY, uses="ev users_")
def n06(t):
    """All notifications judged in one batch."""
    pending, sent = _pushes(t)
    out = ops.delivery(pending, t.users, sent)
    return iso(out.withColumn("local_date", F.col("local_date").cast("string")), "delivered_at")


@add("n06_delivery_stream", _DELIVERY, uses="ev users_")
def n06_stream(t):
    """The same notifications streamed in four slices of time, a batch each; those that wait are told by timers."""
    pending, sent = _pushes(t)
    pending = kept(pending)
    folder = f"{shared_folder(t.spark)}/delivery-{uuid.uuid4().hex}"
    first, last = pending.agg(F.min("at"), F.max("at")).first()
    if first is None:
        return iso(ops.delivery(pending, t.users, sent).withColumn("local_date", F.col("local_date").cast("string")), "delivered_at")
    step, users, sent = (last - first) / 4, kept(t.users), kept(sent)

    def answer() -> None:
        """A batch of all that has come and is not answered yet."""
        stream = t.spark.readStream.schema(pending.schema).parquet(f"{folder}/in")
        deliver(stream, users, sent, f"{folder}/out", f"{folder}/checkpoint", live=False).awaitTermination()

    for k in range(4):
        part = pending.filter((F.col("at") >= first + k * step if k else F.lit(True)) & (F.col("at") < first + (k + 1) * step if k < 3 else F.lit(True)))
        dealt(part).write.mode("append").parquet(f"{folder}/in")
        answer()
    # Of no tenant: the time that passes after the last notification.
    end = pending.limit(1).select(
        F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("suggestion_key"), F.lit("let_it_go").alias("rule"),
        F.lit(last + timedelta(days=3)).alias("at"), F.lit(False).alias("bypasses_budget"),
    )
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    answer()
    out = t.spark.read.parquet(f"{folder}/out").filter("user_id >= 0")
    return iso(out.withColumn("local_date", F.col("local_date").cast("string")), "delivered_at")


@add("x28_quiet_hours", f"""SELECT seq, q AS quiet, {ziso("timezone('UTC', timezone(tz, CASE WHEN NOT q THEN l WHEN hour(l) < 8 THEN date_trunc('day', l) + INTERVAL 8 HOURS ELSE date_trunc('day', l) + INTERVAL 32 HOURS END))")} AS deliverable_at
  FROM (SELECT *, hour(l) >= 21 OR hour(l) < 8 AS q FROM (SELECT e.seq, u.tz, timezone(u.tz, timezone('UTC', e.occurred_at)) AS l
    FROM ev e JOIN users_ u USING (user_id)) x) y""", uses="ev users_")
def x28(t):
    """Quiet hours in the zone of each tenant, in the nights the clocks change too."""
    rows = t.log.join(t.users, "user_id")
    at, tz = F.col("occurred_at"), F.col("tz")
    out = rows.select(
        "seq", K.is_quiet_hour(at, tz, "21:00", "08:00").alias("quiet"),
        K.next_deliverable_at(at, tz, "21:00", "08:00").alias("deliverable_at"),
    )
    return iso(out, "deliverable_at")


@add("x27_clock", f"""SELECT seq, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN '1 day quiet' ELSE concat(d, ' days quiet') END AS past, {_REL} AS future,
  d AS days, round(h, 4) AS hours FROM (SELECT seq, CAST(floor(epoch(TIMESTAMP '{NOW}' - occurred_at) / 86400) AS BIGINT) AS d,
  epoch(occurred_at - TIMESTAMP '2024-06-01') / 3600 AS h FROM ev) x""", uses="ev")
def x27(t):
    at, pivot = F.col("occurred_at"), F.to_timestamp(F.lit("2024-06-01"))
    return t.log.select(
        "seq", K.relative_past(t.now, at).alias("past"), K.relative_future(pivot, at).alias("future"),
        K.days_between(at, t.now).alias("days"), F.round(K.hours_exact(pivot, at), 4).alias("hours"),
    )


@add("x30_eyebrow", f"SELECT user_id, strftime(timezone(tz, timezone('UTC', TIMESTAMP '{NOW}')), '%A %-d %B') AS eyebrow FROM users_", uses="users_")
def x30_eyebrow(t):
    return t.users.select("user_id", K.date_eyebrow(t.now, F.col("tz")).alias("eyebrow"))


@add("c07_seed_stage_defs", """SELECT u.user_id, d.key, d.label, d.phase, CAST(d.depth AS BIGINT) AS depth, CAST(d.stale_after_days AS BIGINT) AS stale_after_days
  FROM users_ u, default_stages d WHERE NOT EXISTS (SELECT 1 FROM stage_defs_ s WHERE s.user_id = u.user_id AND s.key = d.key)""", uses="users_ default_stages stage_defs_")
def c07(t):
    out = stage_ops.seed_stage_defs(t.users, t.stage_defs)
    return out.withColumn("depth", F.col("depth").cast("bigint")).withColumn("stale_after_days", F.col("stale_after_days").cast("bigint"))


_WORDS = "[" + ", ".join(f"'{w}'" for w in C.NUMBER_WORDS) + "]"


@add("c11_today", f"""SELECT user_id, eyebrow, CASE WHEN moved > 0 THEN 'moved' WHEN live = 0 THEN 'empty' WHEN suggestions = 0 THEN 'clear' ELSE 'waiting' END AS headline_kind,
    CASE WHEN moved > 0 THEN concat(coalesce(({_WORDS})[moved + 1], CAST(moved AS VARCHAR)), ' moved / forward / this week') WHEN live = 0 THEN 'Nothing / to track yet'
      WHEN suggestions = 0 THEN 'You are / clear today' ELSE concat(coalesce(({_WORDS})[live + 1], CAST(live AS VARCHAR)), ' applications / waiting') END AS headline,
    live, quiet, interviewing, offer, overdue, closed, moved, suggestions, next_case_id, next_starts_at, mailbox_state
  FROM (SELECT u.user_id, strftime(timezone(u.tz, timezone('UTC', TIMESTAMP '{NOW}')), '%A %-d %B') AS eyebrow,
    coalesce(a.live, 0) AS live, coalesce(a.quiet, 0) AS quiet, coalesce(a.interviewing, 0) AS interviewing, coalesce(a.offer, 0) AS offer, coalesce(a.quiet, 0) AS overdue, coalesce(a.closed, 0) AS closed,
    coalesce(v.moved, 0) AS moved, coalesce(o.n, 0) AS suggestions, n.case_id AS next_case_id, {ziso('n.starts_at')} AS next_starts_at,
    CASE WHEN m.status = 'needs_reauth' THEN 'F1' WHEN m.backlog_estimate > 0 THEN 'F2' ELSE 'ok' END AS mailbox_state
  FROM users_ u LEFT JOIN (SELECT user_id, count(*) FILTER (activity = 'active') AS live, count(*) FILTER (activity = 'stale') AS quiet, count(*) FILTER (activity = 'closed') AS closed,
      count(*) FILTER ({_OPEN} AND current_phase = 'interviewing') AS interviewing, count(*) FILTER ({_OPEN} AND current_stage IN ('offer', 'negotiating')) AS offer FROM act GROUP BY user_id) a USING (user_id)
  LEFT JOIN moved_today_ v USING (user_id) LEFT JOIN {_MAILBOX} m USING (user_id)
  LEFT JOIN (SELECT user_id, least(count(*), 3) AS n FROM {_STORED} s WHERE acted_at IS NULL AND dismissed_at IS NULL AND (snoozed_until IS NULL OR snoozed_until < TIMESTAMP '{NOW}')
    AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') GROUP BY user_id) o USING (user_id) LEFT JOIN next_ n USING (user_id)) x""", uses="users_ act ev next_ moved_today_")
def c11(t):
    """The first screen of every tenant, every column of it."""
    from caseledger.plans import board as board_ops
    from caseledger.plans.sweeps import mailbox_health

    rows = ledger(t).withColumn("processed_at", F.col("received_at"))
    return board_ops.today(
        active=t.active, log=t.log, users=t.users, stage_defs=t.stage_defs,
        open_suggestions=ops.open_suggestions(_stored(t), t.now),
        upcoming=board_ops.next_interview(t.interviews, t.projected, t.companies, t.stage_defs, t.now),
        health=mailbox_health(mailboxes(t), rows, t.users, t.now), now=t.now,
    )
