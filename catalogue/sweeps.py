"""Scheduled jobs and health."""

from pyspark.sql import functions as F

from caseledger.plans import sweeps as ops

from .account import ACCOUNT, account_tables
from .base import NOW, Registry, iso, ziso

REGISTRY = Registry()
add = REGISTRY.add

_SWEEP = """SELECT a.user_id, a.case_id, 'went_silent' AS type, 0.9::DOUBLE AS confidence, CAST(floor(q) AS BIGINT) AS days_quiet,
  CASE WHEN presumed THEN 'presumed_closed' WHEN d.n IS NOT NULL THEN 'p90x2' ELSE 'stale_after_days' END AS threshold_used, presumed AS presumed_closed
  FROM (SELECT *, epoch(TIMESTAMP '{now}' - last_signal_at) / 86400 AS q,
    epoch(TIMESTAMP '{now}' - last_signal_at) / 86400 > {days} AND current_stage NOT IN ('take_home', 'offer', 'negotiating') AS presumed
    FROM projected WHERE status IN ('live', 'dormant') AND merged_into_id IS NULL AND last_signal_at IS NOT NULL) a
  JOIN stage_defs_ sd ON sd.user_id = a.user_id AND sd.key = a.current_stage
  LEFT JOIN dwell_in d ON d.user_id = a.user_id AND d.stage = a.current_stage AND d.n >= 5
  WHERE NOT (a.status = 'dormant' AND NOT presumed)
    AND NOT (q <= greatest(sd.stale_after_days, coalesce(2 * d.p90_days, 0)) AND NOT presumed)"""


@add("t06_dormancy_sweep_all", _SWEEP.format(now=NOW, days=90), uses="projected stage_defs_ dwell_in")
def t06(t):
    return ops.dormancy_sweep(t.projected, t.stage_defs, t.dwell, t.now).drop("occurred_at")


@add("t06_dormancy_sweep_due", _SWEEP.format(now="2024-07-15 01:30:00", days=60) + """
    AND a.user_id IN (SELECT user_id FROM users_ WHERE hour(timezone(tz, timezone('UTC', TIMESTAMP '2024-07-15 01:30:00'))) = 3)""",
     uses="projected stage_defs_ dwell_in users_")
def t06_due(t):
    """Half past one in the morning, UTC: it is three o'clock in Rome."""
    at = F.to_timestamp(F.lit("2024-07-15 01:30:00"))
    return ops.dormancy_sweep(
        t.projected, t.stage_defs, t.dwell, at, users=t.users, presumed_closed_days=60
    ).drop("occurred_at")


@add("t07_interview_held_sweep", f"""SELECT user_id, case_id, interview_id, {ziso('coalesce(ends_at, starts_at)')} AS occurred_at,
  0.95::DOUBLE AS confidence FROM interviews_ WHERE cancelled_at IS NULL
  AND coalesce(ends_at, starts_at + INTERVAL 1 HOUR) < TIMESTAMP '{NOW}' - INTERVAL 2 HOURS""", uses="interviews_")
def t07(t):
    return iso(ops.interview_held_sweep(t.interviews, t.now).drop("type"), "occurred_at")


_LEDGER = """(SELECT 1 AS mailbox_id, concat('m-', seq) AS provider_message_id, user_id, occurred_at AS received_at,
  CASE k % 4 WHEN 0 THEN 'parked' WHEN 1 THEN 'dropped' WHEN 2 THEN 'placed' END AS outcome, k % 9 AS park_attempts FROM ev)"""


def ledger(t):
    """A replay ledger with one row per event."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    ts = t.raw("events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), k.alias("k")
    )
    origin = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return ts.select(
        F.lit(1).alias("mailbox_id"),
        F.concat(F.lit("m-"), "event_id").alias("provider_message_id"),
        "user_id",
        (F.col("ts") + (F.col("ts") - origin) * 5).alias("received_at"),
        F.expr("get(array('parked', 'dropped', 'placed', NULL), k % 4)").alias("outcome"),
        F.expr("k % 9").alias("park_attempts"),
        "k",
    )


@add("t05_requeue", f"SELECT provider_message_id, user_id, true AS replay FROM {_LEDGER} x WHERE outcome = 'parked' AND park_attempts < 6", uses="ev")
def t05(t):
    return ops.park_and_retry(ledger(t))[0].drop("mailbox_id")


@add("t05_ask", f"SELECT provider_message_id AS evidence_ref, user_id, 'low_confidence' AS kind FROM {_LEDGER} x WHERE outcome = 'parked' AND park_attempts >= 6", uses="ev")
def t05_ask(t):
    return ops.park_and_retry(ledger(t))[1].drop("excerpt")


@add("t05_ledger_after", f"""SELECT provider_message_id, CASE WHEN outcome = 'parked' THEN CASE WHEN park_attempts >= 6 THEN 'review' END ELSE outcome END AS outcome,
  CAST(park_attempts + CASE WHEN outcome = 'parked' AND park_attempts < 6 THEN 1 ELSE 0 END AS BIGINT) AS park_attempts FROM {_LEDGER} x""", uses="ev")
def t05_after(t):
    out = ops.park_and_retry(ledger(t))[2]
    return out.select("provider_message_id", "outcome", F.col("park_attempts").cast("bigint").alias("park_attempts"))


@add("c06_ledger_outcomes", f"""SELECT provider_message_id, CASE WHEN n % 10 < 2 THEN 'placed' WHEN n % 10 < 4 THEN 'review'
    WHEN outcome IS NULL AND n % 10 = 5 THEN 'parked' ELSE outcome END AS outcome
  FROM (SELECT *, CAST(substr(provider_message_id, 3) AS BIGINT) AS n FROM {_LEDGER} x) y""", uses="ev")
def c06(t):
    """Ten kinds of message: two are placed last, two reviewed last, one reparked."""
    from caseledger.operators.log import ledger_outcomes

    n = F.substring("provider_message_id", 3, 20).cast("bigint") % 10
    rows = ledger(t).withColumn("processed_at", F.lit(None).cast("timestamp"))
    base = rows.select("mailbox_id", "provider_message_id", n.alias("n"))
    at = lambda s: F.to_timestamp(F.lit(s))
    early = base.filter("n < 4").select(
        "mailbox_id", "provider_message_id", F.lit("dropped").alias("outcome"),
        at("2024-07-01 00:00:00").alias("at"), F.lit(False).alias("repark"))
    late = base.filter("n < 4").select(
        "mailbox_id", "provider_message_id", F.expr("CASE WHEN n < 2 THEN 'placed' ELSE 'review' END").alias("outcome"),
        at("2024-07-02 00:00:00").alias("at"), F.lit(False).alias("repark"))
    stubs = base.filter("n = 5").select(
        "mailbox_id", "provider_message_id", F.lit(None).cast("string").alias("outcome"),
        at("2024-07-02 00:00:00").alias("at"), F.lit(True).alias("repark"))
    return ledger_outcomes(rows, early.unionByName(late).unionByName(stubs)).select("provider_message_id", "outcome")


@add("f09_reprocess_selection", f"""SELECT provider_message_id, user_id FROM (SELECT *, row_number() OVER
  (ORDER BY received_at DESC, provider_message_id) AS rn FROM {_LEDGER} x WHERE outcome = 'dropped'
    AND received_at >= TIMESTAMP '2024-02-01' AND received_at < TIMESTAMP '2024-06-01') y WHERE rn <= 500""", uses="ev")
def f09(t):
    from caseledger.operators.screening import reprocess_selection

    out = reprocess_selection(ledger(t), outcome="dropped", since="2024-02-01", until="2024-06-01", limit=500)
    return out.select("provider_message_id", "user_id")


@add("t08_retention_kept", f"""SELECT seq AS body_id FROM ev WHERE occurred_at >= TIMESTAMP '2024-06-20 00:00:00' - INTERVAL 5 DAYS""", uses="ev")
def t08(t):
    bodies = t.log.select(F.col("seq").alias("body_id"), F.col("occurred_at").alias("stored_at"))
    reviews = _reviews(t)
    kept, _ = ops.retention_sweep(bodies, reviews, F.to_timestamp(F.lit("2024-06-20 00:00:00")), 5)
    return kept.select("body_id")


def _reviews(t):
    return t.log.filter("confidence < 0.6").select(
        F.concat(F.lit("rv-"), "seq").alias("review_id"), "user_id", "case_id",
        F.concat(F.lit("text "), "seq").alias("excerpt"),
        F.when(F.col("seq") % 2 == 0, F.col("occurred_at")).alias("resolved_at"),
    )


@add("t08_excerpts_cleared", """SELECT concat('rv-', seq) AS review_id, CASE WHEN seq % 2 = 1 THEN concat('text ', seq) END AS excerpt
  FROM ev WHERE confidence < 0.6""", uses="ev")
def t08_excerpts(t):
    bodies = t.log.select(F.col("occurred_at").alias("stored_at"))
    return ops.retention_sweep(bodies, _reviews(t), t.now, 7)[1].select("review_id", "excerpt")


@add("t09_erase_user", " UNION ALL ".join(f"SELECT '{n}' AS name, user_id, count(*) AS n FROM {s} WHERE user_id % 7 <> 3 GROUP BY user_id" for n, (s, _) in ACCOUNT.items()),
     uses=" ".join(s for s, _ in ACCOUNT.values()))
def t09(t):
    """Every seventh tenant leaves; what is left is counted per table and tenant."""
    left = ops.erase_users(account_tables(t), t.users.filter("user_id % 7 = 3"))
    out = None
    for name, df in left.items():
        n = df.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "user_id", "n")
        out = n if out is None else out.unionByName(n)
    return out


@add("t10_dead_letters", """SELECT conv_id * 1000 + turn AS msg_id, 'raw_message_dlq' AS queue,
  concat('{"id":', conv_id, ',"text":"[stripped]","role":"', role, '"}') AS body FROM conversations WHERE (conv_id + turn) % 7 >= 5""")
def t10(t):
    """Messages that failed five times lose their text; the body of the record stays valid JSON."""
    rows = t.raw("conversations").select(
        F.lit("raw_message").alias("queue"), (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"),
        ((F.col("conv_id") + F.col("turn")) % 7).alias("read_count"),
        F.to_json(F.struct(F.col("conv_id").alias("id"), "text", "role")).alias("body"),
    )
    return ops.dead_letters(rows)[1]


_PENDING = """(SELECT CASE seq % 11 WHEN 10 THEN 'raw_message_dlq' ELSE (['raw_message', 'candidate_message', 'signal_extracted', 'event_pending', 'notify_pending'])[seq % 5 + 1] END AS queue,
  occurred_at AS enqueued_at FROM ev)"""


def _pending(t):
    queue = F.expr("""CASE WHEN seq % 11 = 10 THEN 'raw_message_dlq' ELSE get(array('raw_message',
      'candidate_message', 'signal_extracted', 'event_pending', 'notify_pending'), CAST(seq % 5 AS INT)) END""")
    return t.log.select(queue.alias("queue"), F.col("occurred_at").alias("enqueued_at"))


@add("a26_queue_stats", f"""SELECT queue, count(*) AS length, CAST(round(epoch(TIMESTAMP '{NOW}' - min(enqueued_at))) AS BIGINT) AS oldest_sec,
  CAST(round(epoch(TIMESTAMP '{NOW}' - max(enqueued_at))) AS BIGINT) AS newest_sec FROM {_PENDING} x GROUP BY queue""", uses="ev")
def a26(t):
    return ops.queue_stats(_pending(t), t.now)


_MAILBOX = """(SELECT DISTINCT user_id * 2 + user_id % 3 % 2 AS mailbox_id, user_id, (['ok', 'needs_reauth', 'error'])[user_id % 3 + 1] AS status,
  CASE WHEN user_id % 5 <> 0 THEN TIMESTAMP '2024-07-15 00:00:00' + to_minutes(user_id) END AS last_ok_at, user_id % 4 AS backlog_estimate FROM ev)"""


def mailboxes(t):
    return t.users.select(
        F.expr("user_id * 2").alias("mailbox_id"), "user_id",
        F.expr("get(array('ok', 'needs_reauth', 'error'), CAST(user_id % 3 AS INT))").alias("status"),
        F.expr("""CASE WHEN user_id % 5 <> 0 THEN TIMESTAMP '2024-07-15 00:00:00'
          + make_dt_interval(0, 0, CAST(user_id AS INT)) END""").alias("last_ok_at"),
        F.expr("user_id % 4").alias("backlog_estimate"),
    )


@add("s10_gauges", f"""SELECT ord, line FROM (
  SELECT 10 + i - 1 AS ord, concat('queue_depth{{queue="', q, '"}} ', (SELECT count(*) FROM {_PENDING} p WHERE p.queue = q)) AS line
    FROM (SELECT unnest(['raw_message', 'candidate_message', 'signal_extracted', 'event_pending', 'notify_pending']) AS q, unnest([1,2,3,4,5]) AS i) z
  UNION ALL SELECT 20, concat('dead_letters ', count(*)) FROM {_PENDING} p WHERE queue LIKE '%_dlq'
  UNION ALL SELECT 30, concat('review_items_open ', count(*) FILTER (seq % 2 = 1)) FROM ev WHERE confidence < 0.6
  UNION ALL SELECT 40, concat('mailbox_freshness_seconds ', printf('%.1f', epoch(TIMESTAMP '{NOW}' - max(last_ok_at)))) FROM {_MAILBOX} m
  UNION ALL SELECT 9, '# HELP queue_depth Messages waiting per queue' || chr(10) || '# TYPE queue_depth gauge'
  UNION ALL SELECT 19, '# HELP dead_letters Messages in a dead-letter queue' || chr(10) || '# TYPE dead_letters gauge'
  UNION ALL SELECT 29, '# HELP review_items_open Open review items' || chr(10) || '# TYPE review_items_open gauge'
  UNION ALL SELECT 39, '# HELP mailbox_freshness_seconds Seconds since a mailbox last read successfully' || chr(10) || '# TYPE mailbox_freshness_seconds gauge') x""", uses="ev")
def s10(t):
    return ops.gauges(_pending(t), _reviews(t), mailboxes(t), t.now)


@add("a22_mailbox_health", f"""SELECT u.user_id, coalesce(m.status = 'ok', false) AS connected, {ziso('m.last_ok_at')} AS last_ok_at,
  CAST(greatest(0, floor(epoch(TIMESTAMP '{NOW}' - m.last_ok_at) / 60)) AS BIGINT) AS minutes_since_read,
  coalesce(p.n, 0) AS placed_today, m.backlog_estimate AS backlog,
  CASE WHEN m.status = 'needs_reauth' THEN 'F1' WHEN m.backlog_estimate > 0 THEN 'F2' ELSE 'ok' END AS state
  FROM users_ u JOIN {_MAILBOX} m USING (user_id)
  LEFT JOIN (SELECT l.user_id, count(*) AS n FROM {_LEDGER} l JOIN users_ z USING (user_id) WHERE outcome = 'placed'
    AND received_at + INTERVAL 17 DAYS > timezone('UTC', timezone(tz, date_trunc('day', timezone(tz, timezone('UTC', TIMESTAMP '{NOW}'))))) GROUP BY ALL) p USING (user_id)"""
     .replace("CAST(greatest(0, floor(epoch(TIMESTAMP '" + NOW + "' - m.last_ok_at) / 60)) AS BIGINT)",
              "CASE WHEN m.last_ok_at IS NOT NULL THEN CAST(greatest(0, floor(epoch(TIMESTAMP '" + NOW + "' - m.last_ok_at) / 60)) AS BIGINT) END"),
     uses="users_ ev")
def a22(t):
    rows = ledger(t).withColumn("processed_at", F.col("received_at") + F.expr("INTERVAL 17 DAYS"))
    return ops.mailbox_health(mailboxes(t), rows, t.users, t.now)
