"""Log operators: append, satellites, latest-per-key."""

from pyspark.sql import functions as F

from caseledger.operators import log as ops
from caseledger.operators import skew

from .base import Registry, iso, ziso

REGISTRY = Registry()
add = REGISTRY.add

_ALL = """(SELECT seq, user_id, case_id, type, occurred_at, evidence_ref FROM ev
  UNION ALL SELECT seq + 1000000000, user_id, case_id, type, occurred_at, evidence_ref FROM ev WHERE seq % 5 = 0)"""


@add("s07_dedupe_events", f"""SELECT user_id, case_id, type, {ziso('occurred_at')} AS occurred_at,
  evidence_ref, min(seq) AS seq FROM {_ALL} x
  GROUP BY user_id, case_id, type, occurred_at, evidence_ref""", uses="ev")
def s07_dedupe(t):
    out = ops.dedupe_events(t.log_with_repeats)
    return iso(out.select(*ops.EVENT_KEY, "seq"), "occurred_at")


@add("s07_new_events", f"""SELECT user_id, case_id, type, {ziso('occurred_at')} AS occurred_at, min(seq) AS seq
  FROM ev i WHERE NOT EXISTS (SELECT 1 FROM ev k WHERE k.seq % 3 <> 0 AND k.case_id = i.case_id
    AND k.type = i.type AND k.occurred_at = i.occurred_at
    AND k.evidence_ref IS NOT DISTINCT FROM i.evidence_ref)
  GROUP BY user_id, case_id, type, i.occurred_at, evidence_ref""", uses="ev")
def s07_new(t):
    known = t.log.filter("seq % 3 <> 0")
    out = ops.new_events(known, t.log_with_repeats)
    return iso(out.select("user_id", "case_id", "type", "occurred_at", "seq"), "occurred_at")


@add("s07_rejected_events", """SELECT seq, CASE WHEN seq % 10 = 3 THEN 'unknown type' ELSE 'confidence outside 0 to 1' END AS reason
  FROM ev WHERE seq % 10 = 3 OR seq % 10 = 7""", uses="ev")
def s07_rejected(t):
    """Three events in ten arrive spoilt, one of them in a way that the log accepts."""
    d = F.col("seq") % 10
    spoilt = t.log.withColumn("type", F.when(d == 3, "opened").otherwise(F.col("type"))).withColumn(
        "confidence", F.when(d == 7, F.lit(1.01)).when(d == 9, F.lit(0.0)).otherwise(F.col("confidence")))
    return ops.rejected_events(spoilt).select("seq", "reason")


@add("u04_log_after_append", """SELECT user_id, type, count(*) AS n FROM ev GROUP BY ALL""", uses="ev")
def u04(t):
    after = ops.append_events(t.log.filter("seq % 3 <> 0"), t.log_with_repeats)
    return after.groupBy("user_id", "type").agg(F.count("*").alias("n"))


@add("w01_lag_stage", """SELECT user_id, case_id, seq, from_stage, to_stage, round(days, 6) AS days FROM moves""",
     uses="moves")
def w01(t):
    from caseledger.operators.reach import transitions

    out = transitions(t.log)
    return out.withColumn("days", F.round("days", 6))


@add("w02_latest_per_case", """SELECT user_id, case_id, type, seq FROM ev
  QUALIFY row_number() OVER (PARTITION BY user_id, case_id ORDER BY occurred_at DESC, seq DESC) = 1""", uses="ev")
def w02(t):
    return ops.latest_per_case(t.log).select("user_id", "case_id", "type", "seq")


@add("a21_thread_map", """SELECT user_id, p_thread_id AS thread_id, arg_max(case_id, occurred_at) AS case_id
  FROM ev WHERE p_thread_id IS NOT NULL GROUP BY ALL""", uses="ev")
def a21(t):
    return ops.thread_map(t.log)


@add("w03_interviews", f"""SELECT interview_id, user_id, case_id, stage, {ziso('starts_at')} AS starts_at,
  {ziso('ends_at')} AS ends_at, location, calendar_event_id, {ziso('cancelled_at')} AS cancelled_at
  FROM interviews_""", uses="interviews_")
def w03(t):
    return iso(t.interviews.drop("held"), "starts_at", "ends_at", "cancelled_at")


@add("w04_first_touch", """SELECT case_id, user_id, channel, seq AS source_id,
  type = 'applied' AND seq = min(CASE WHEN type = 'applied' THEN seq END) OVER (PARTITION BY user_id, case_id)
  AS is_first_touch FROM ev WHERE p_channel IS NOT NULL""".replace("channel, seq", "p_channel AS channel, seq"),
     uses="ev")
def w04(t):
    return t.sources.select("case_id", "user_id", "channel", "source_id", "is_first_touch")


@add("w05_rounds_done", """SELECT i.user_id, i.case_id, count(*) AS booked,
  count(*) FILTER (h.interview_id IS NOT NULL) AS rounds
  FROM interviews_ i LEFT JOIN (SELECT DISTINCT user_id, interview_id FROM interviews_
    WHERE epoch(starts_at)::BIGINT % 2 = 0) h USING (user_id, interview_id) GROUP BY ALL""", uses="interviews_")
def w05(t):
    held = t.interviews.withColumn("held", F.expr("CASE WHEN unix_seconds(starts_at) % 2 = 0 THEN true END"))
    return held.groupBy("user_id", "case_id").agg(
        F.count("*").alias("booked"), F.count_if("held").alias("rounds")
    )


@add("c01_offers", f"""SELECT offer_id, user_id, case_id, kind, min_minor, max_minor, currency,
  CAST(decide_by AS VARCHAR) AS decide_by, {ziso('created_at')} AS created_at FROM offers_""", uses="offers_")
def c01(t):
    out = iso(t.offers.drop("equity_note"), "created_at")
    return out.withColumn("decide_by", F.col("decide_by").cast("string"))


@add("c02_deadlines", f"""SELECT deadline_id, user_id, case_id, kind, {ziso('due_at')} AS due_at, source
  FROM deadlines_""", uses="deadlines_")
def c02(t):
    return iso(t.deadlines.drop("met_at", "url"), "due_at")


@add("c03_sources", f"""SELECT source_id, user_id, case_id, channel, posting_url, ats_vendor,
  {ziso('first_seen_at')} AS first_seen_at, is_first_touch FROM sources_""", uses="sources_")
def c03(t):
    return iso(t.sources, "first_seen_at")


@add("c04_held", """SELECT interview_id, user_id, case_id, held FROM (
  SELECT i.interview_id, i.user_id, i.case_id, h.held FROM interviews_ i LEFT JOIN (
    SELECT user_id, interview_id, true AS held FROM interviews_ WHERE case_id % 2 = 0) h
  USING (user_id, interview_id)) x""", uses="interviews_")
def c04(t):
    """Holding events for the interviews of even cases, folded back onto the interviews."""
    booked = t.interviews.select("interview_id", "user_id", "case_id")
    said = booked.filter("case_id % 2 = 0").select(
        "user_id",
        F.lit("interview_held").alias("type"),
        F.struct("interview_id").alias("payload"),
    )
    return booked.join(ops.held_from_events(said), ["user_id", "interview_id"], "left").select(
        "interview_id", "user_id", "case_id", "held"
    )


@add("j05_split_ids", """SELECT DISTINCT user_id, case_id, CAST(p_merged_id AS BIGINT) AS other_id FROM ev
  WHERE type = 'human_corrected' AND p_field = 'merge' AND p_to = 'split' AND p_merged_id IS NOT NULL""", uses="ev")
def j05(t):
    return ops.split_pairs(t.log)


@add("u03_split_membership", """SELECT DISTINCT least(a, b) AS low_id, greatest(a, b) AS high_id FROM (
    SELECT case_id AS a, CAST(p_merged_id AS BIGINT) AS b FROM ev
    WHERE p_field = 'merge' AND p_to = 'split') s""", uses="ev")
def u03(t):
    """Split pairs whichever side recorded them."""
    pairs = ops.split_pairs(t.log)
    return pairs.select(
        F.least("case_id", "other_id").alias("low_id"), F.greatest("case_id", "other_id").alias("high_id")
    ).distinct()


@add("r08_split_merge", """SELECT c.user_id, c.case_id, CASE WHEN f.case_id IS NULL THEN c.merged_into_id END AS merged_into_id
  FROM cases_ c LEFT JOIN (SELECT DISTINCT user_id, CAST(p_merged_id AS BIGINT) AS case_id FROM ev
    WHERE type = 'human_corrected' AND p_field = 'merge' AND p_merged_id IS NOT NULL) f
  ON f.user_id = c.user_id AND f.case_id = c.case_id""", uses="cases_ ev")
def r08(t):
    return ops.free_split_cases(t.cases, t.log).select("user_id", "case_id", "merged_into_id")


@add("j10_evidence", f"""SELECT e.user_id, e.case_id, e.evidence_ref, e.type, {ziso('e.occurred_at')} AS occurred_at, s.outcome
  FROM ev e JOIN (SELECT user_id, concat('m-', event_id) AS id, CASE WHEN event_id % 4 = 0 THEN 'review' ELSE 'placed' END AS outcome
    FROM events) s ON s.id = e.evidence_ref AND s.user_id = e.user_id""", uses="ev")
def j10(t):
    """Events of a case beside the ledger rows that produced them, one per message."""
    ledger = t.raw("events").select(
        "user_id", F.concat(F.lit("m-"), "event_id").alias("provider_message_id"),
        F.expr("CASE WHEN event_id % 4 = 0 THEN 'review' ELSE 'placed' END").alias("outcome"),
    )
    events = t.log_with_repeats.filter("evidence_ref IS NOT NULL").join(
        ledger,
        (F.col("evidence_ref") == F.col("provider_message_id"))
        & (t.log_with_repeats["user_id"] == ledger["user_id"]),
    ).drop(ledger["user_id"])
    newest = skew.first_per_key(
        events.select("user_id", "case_id", "evidence_ref", "type", "occurred_at", "outcome", "seq"),
        ["user_id", "case_id", "evidence_ref"], F.struct("occurred_at", "seq"), last=True,
    ).drop("seq")
    return iso(newest, "occurred_at")
