"""Evaluation against labels, and differences between two readings."""

from pyspark.sql import functions as F

from caseledger.operators import evaluate as ops
from caseledger.operators import screening as ops_screening
from caseledger.session import cut_lineage, dealt

from .base import Registry, rounded
from .screening import own, screened
from .shapes import cte

REGISTRY = Registry()
add = REGISTRY.add

# Expected intents: what the ladder read for most messages, another one for some, and some that it never saw.
_EXPECTED = """CASE WHEN doc_id % 11 = 0 THEN 'offer' WHEN doc_id % 13 = 1 THEN 'rejected' WHEN doc_id % 3 <> 0 THEN {got} END"""
_GOT = "CASE WHEN l.reading = 'extracted' THEN l.intent END"
cte("judged_", f"""SELECT *, NOT CASE WHEN should_drop THEN outcome <> 'drop' ELSE outcome = 'drop' OR (want IS NOT NULL AND want IS DISTINCT FROM got)
    OR (want_vendor IS NOT NULL AND want_vendor IS DISTINCT FROM vendor) END AS passed FROM (
  SELECT s.doc_id, s.outcome, s.vendor, {_GOT} AS got, {_EXPECTED.format(got=_GOT).replace('doc_id', 's.doc_id')} AS want,
    CASE WHEN s.doc_id % 10 = 3 THEN 'greenhouse' WHEN s.doc_id % 10 = 4 THEN s.vendor END AS want_vendor, q.quality = 0 AS should_drop
  FROM scored s JOIN labels q USING (doc_id) LEFT JOIN ladder l USING (message_id)) x""", "scored ladder")


def _judged(t):
    s = cut_lineage(screened(t))
    read = ops_screening.run_ladder(s, own=own(t)).filter("reading = 'extracted'").select("message_id", "intent")
    verdicts = s.select("message_id", "outcome", "vendor", F.lit(None).cast("string").alias("company")).join(read, "message_id", "left")
    labels = t.raw("labels").select("doc_id", F.concat(F.lit("d-"), "doc_id").alias("message_id"), (F.col("quality") == 0).alias("should_drop"))
    expected = labels.join(verdicts.select("message_id", F.col("intent").alias("got"), F.col("vendor").alias("v")), "message_id").select(
        "message_id", "should_drop", F.expr(_EXPECTED.format(got="got")).alias("intent"), F.lit(None).cast("string").alias("company"),
        F.expr("CASE WHEN doc_id % 10 = 3 THEN 'greenhouse' WHEN doc_id % 10 = 4 THEN v END").alias("vendor"))
    return ops.judged(expected, verdicts)


@add("e01_evaluate_extraction", """SELECT scored, passed, claimed, correct, expected, false_negatives, round(correct / claimed, 6) AS precision, round(correct / expected, 6) AS recall,
  correct / claimed >= 0.97 AND correct / expected >= 0.90 AND scored >= 15 AS gate_met FROM (
  SELECT count(*) AS scored, count(*) FILTER (passed) AS passed, count(*) FILTER (want IS NOT NULL AND got IS NOT NULL) AS claimed, count(*) FILTER (want = got) AS correct,
    count(*) FILTER (want IS NOT NULL) AS expected, count(*) FILTER (want IS NOT NULL AND got IS NULL AND outcome = 'drop') AS false_negatives FROM judged_) x""", uses="judged_")
def e01(t):
    return rounded(ops.evaluate_extraction(_judged(t)), "precision", "recall")


@add("e01_by_intent", "SELECT coalesce(want, CASE WHEN should_drop THEN 'drop' ELSE 'other' END) AS intent, count(*) AS expected, count(*) FILTER (passed) AS correct FROM judged_ GROUP BY ALL", uses="judged_")
def e01_intent(t):
    return ops.by_intent(_judged(t))


@add("e02_diff_against_baseline", """SELECT message_id, CASE WHEN doc_id % 2 = 0 THEN 'score' ELSE 'vendor' END AS fields, CASE WHEN doc_id % 2 = 0 AND vendor IS NOT NULL THEN 'waiver' ELSE 'unexplained' END AS explained_by
  FROM scored WHERE doc_id % 10 < 2""", uses="scored")
def e02(t):
    """A baseline whose score is four lower in one message of ten, and whose vendor is wrong in another."""
    nothing = F.lit(None).cast("string")
    d = F.substring("message_id", 3, 20).cast("bigint") % 10
    after = screened(t).select("message_id", "score", "outcome", *[nothing.alias(c) for c in ("intent", "company", "role", "stage_hint")],
                               F.lit(None).cast("int").alias("rung"), "vendor")
    before = after.withColumn("score", F.when(d == 0, F.col("score") - 4).otherwise(F.col("score"))).withColumn(
        "vendor", F.when(d == 1, "other vendor").otherwise(F.col("vendor")))
    waiver = (F.col("after_score") == F.col("before_score") + 4) & F.col("after_vendor").isNotNull()
    return ops.diff_against_baseline(before, after, {"waiver": waiver}).select("message_id", "fields", "explained_by")


@add("s04_parse_ics", """SELECT event_id, concat('uid-', event_id) AS uid, concat('Call, round ', event_id % 5) AS summary, strftime(date_trunc('second', ts) + to_hours(CASE WHEN event_id % 2 = 0 THEN 0 ELSE -1 END), '%Y-%m-%d %H:%M:%S') AS starts_at,
  'CANCEL' AS method, 'a@company1.com' AS organiser FROM events""")
def s04(t):
    """A calendar text per event: half in UTC, half in Roman time, with folded and escaped lines."""
    from caseledger.sources.mail import parse_ics

    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss")
    start = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("DTSTART:"), stamp, F.lit("Z"))).otherwise(F.concat(F.lit("DTSTART;TZID=Europe/Rome:"), stamp))
    text = F.concat(F.lit("BEGIN:VCALENDAR\r\nMETHOD:CANCEL\r\nBEGIN:VEVENT\r\nUID:uid-"), F.col("event_id").cast("string"), F.lit("\r\nSUMMARY:Call\\, ro\r\n und "),
                    (F.col("event_id") % 5).cast("string"), F.lit("\r\n"), start, F.lit("\r\nORGANIZER;CN=A:mailto:a@company1.com\r\nEND:VEVENT\r\nEND:VCALENDAR"))
    rows = dealt(t.raw("events").select("event_id", "ts")).select("event_id", text.alias("ics")).select("event_id", parse_ics(F.col("ics")).alias("i"))
    return rows.select("event_id", "i.uid", "i.summary", F.date_format("i.starts_at", "yyyy-MM-dd HH:mm:ss").alias("starts_at"), "i.method", "i.organiser")
