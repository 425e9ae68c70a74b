"""The driver tables as the shapes the engine works on, once in Spark and once in SQL.

Expressions that both dialects read the same way are written once.
"""

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseledger.operators import fold as fold_ops
from caseledger.operators import log as log_ops
from caseledger.operators import reach as reach_ops
from caseledger.operators.activity import with_activity
from caseledger.schemas import PAYLOAD
from caseledger.session import dealt, kept

from .base import NOW

STAGES6 = ("hr_call", "take_home", "interview", "technical", "final", "mystery")


def pick(index: str, values) -> str:
    """A value by position. Written once, read by both dialects after to_spark / to_duck."""
    items = ", ".join("NULL" if v is None else repr(v) for v in values)
    return f"PICK<<({index}) % {len(values)}|{items}>>"


_PICK = re.compile(r"PICK<<(.*?)\|(.*?)>>")


def to_spark(expression: str) -> str:
    return _PICK.sub(r"get(array(\2), CAST(\1 AS INT))", expression).replace("VARCHAR(20)", "STRING")


_ROWS = re.compile(r"<(supplier|part)>")


def to_duck(expression: str) -> str:
    expression = _ROWS.sub(r"(SELECT count(*) FROM \1)", expression)
    return _PICK.sub(r"([\2])[\1 + 1]", expression)


K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
K5 = "CAST(floor(k / 5) AS INT)"

EVENT_TYPE = f"""CASE event_type
  WHEN 'signup' THEN 'applied'
  WHEN 'view' THEN 'acknowledged'
  WHEN 'click' THEN {pick('k', ('interview_scheduled', 'interview_held', 'stage_advanced'))}
  WHEN 'purchase' THEN {pick('k', ('offer_received', 'offer_negotiated', 'deadline_set', 'stage_advanced'))}
  ELSE CASE k % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'went_silent' WHEN 2 THEN 'human_corrected'
       WHEN 3 THEN 'note_added' ELSE CASE WHEN k % 2 = 0 THEN 'withdrawn' ELSE 'accepted' END END
END"""

STAGE_K = pick("k", STAGES6)
FIELD = pick(K5, ("status", "stage", "role_title", "applied_at", "comp_expectation", "merge"))

# name -> expression over (k, type, user_id, case_id, event_id, value), in both dialects
FLAT = {
    "p_field": f"CASE WHEN type = 'human_corrected' THEN {FIELD} END",
    "p_to": f"""CASE WHEN type <> 'human_corrected' THEN NULL ELSE CASE {FIELD}
      WHEN 'status' THEN {pick('k', ('live', 'rejected', 'bogus', 'dormant'))}
      WHEN 'stage' THEN {STAGE_K}
      WHEN 'role_title' THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('corrected role ', k) END
      WHEN 'applied_at' THEN CASE WHEN event_id % 2 = 0 THEN '2024-01-03' ELSE 'not a date' END
      WHEN 'comp_expectation' THEN concat('{{"minor":', k * 100000, ',"currency":"eur"}}')
      ELSE 'split' END END""",
    "p_merged_id": f"CASE WHEN type = 'human_corrected' AND {FIELD} = 'merge'"
    " THEN CAST(user_id * 8 + (case_id + 1) % 8 AS VARCHAR(20)) END",
    "p_stage": f"CASE WHEN type = 'interview_scheduled' AND k % 12 <> 3 THEN {STAGE_K} END",
    "p_to_stage": f"CASE WHEN type = 'stage_advanced' AND k % 10 = 5 THEN {STAGE_K} END",
    "p_status": "CASE WHEN type = 'interview_scheduled' THEN"
    " CASE WHEN k % 7 = 0 THEN 'cancelled' ELSE 'confirmed' END END",
    "p_role_title": "CASE WHEN type IN ('applied', 'acknowledged', 'rejected') THEN"
    " CASE WHEN k % 50 = 1 THEN '' WHEN k % 3 = 0 THEN concat('role ', k % 9) END END",
    "p_seniority": f"CASE WHEN type = 'applied' THEN {pick('k', ('senior', None, 'junior', None, 'lead'))} END",
    "p_location": f"CASE WHEN type IN ('applied', 'interview_scheduled') THEN"
    f" {pick('k', ('Milano', 'Berlin', None, 'London', 'Roma', None, 'Atlantis'))} END",
    "p_work_mode": f"CASE WHEN type = 'applied' THEN {pick('k', ('remote', 'hybrid', None, 'onsite'))} END",
    "p_channel": "CASE WHEN type = 'applied' THEN"
    f" {pick('k', ('linkedin', 'indeed', 'career_page', 'referral', 'recruiter', 'other'))}"
    " WHEN type = 'acknowledged' AND k % 9 = 0 THEN 'linkedin' END",
    "p_thread_id": "CASE WHEN k % 2 = 0 THEN concat('t-', event_id % 400) END",
    "p_ats_vendor": "CASE WHEN type = 'acknowledged' AND k % 4 = 1 THEN 'lever' END",
    "p_posting_url": "CASE WHEN type = 'applied' AND k % 5 = 0 THEN"
    " concat('https://jobs.example.com/jobs/', event_id) END",
    "p_calendar_event_id": "CASE WHEN type = 'interview_scheduled' AND k % 8 <> 1"
    " THEN concat('c', k % 20) END",
    "p_min_minor": "CASE WHEN type IN ('offer_received', 'offer_negotiated') AND k % 11 <> 4"
    " THEN CAST(round(value * 10000) AS BIGINT) END",
    "p_max_minor": "CASE WHEN type = 'offer_received' AND k % 3 = 0"
    " THEN CAST(round(value * 15000) AS BIGINT) END",
    "p_currency": "CASE WHEN type IN ('offer_received', 'offer_negotiated') THEN"
    " CASE WHEN k % 13 = 0 THEN '' WHEN k % 9 = 0 THEN 'usd' ELSE 'EUR' END END",
    "p_kind": "CASE WHEN type = 'deadline_set' AND k % 4 = 2 THEN 'code_review' END",
    "p_note": "CASE WHEN type = 'note_added' AND k % 2 = 1 THEN concat('note ', k) END",
    "p_text": "CASE WHEN type = 'note_added' AND k % 2 = 0 THEN concat('text ', k) END",
    "p_after_stage": f"CASE WHEN type = 'rejected' AND k % 2 = 0 THEN {STAGE_K} END",
    "p_language": f"CASE WHEN k % 3 = 0 THEN 'it' WHEN k % 3 = 1 THEN 'en' END",
    "p_days_quiet": "CASE WHEN type = 'went_silent' THEN CAST(k AS BIGINT) END",
    "p_presumed_closed": "CASE WHEN type = 'went_silent' THEN k % 2 = 0 END",
}
# name -> (hours after the event, condition)
TIMES = {
    "p_starts_at": ("k * 12", "type = 'interview_scheduled' AND k % 17 <> 5"),
    "p_ends_at": ("k * 12 + 1", "type = 'interview_scheduled' AND k % 3 = 0"),
    "p_due_at": ("k * 9", "type = 'deadline_set' AND k % 10 <> 6"),
    "p_decide_by": ("k * 24", "type = 'offer_received' AND k % 8 = 0"),
}
HEAD = {
    "to_stage": f"""CASE WHEN type IN ('applied', 'acknowledged') THEN type
      WHEN type = 'stage_advanced' AND k % 10 <> 5 THEN {STAGE_K}
      WHEN type = 'interview_scheduled' AND k % 7 <> 0 THEN {STAGE_K}
      WHEN type = 'offer_received' THEN 'offer' END""",
    "from_stage": f"CASE WHEN type = 'stage_advanced' AND k % 4 = 3 THEN {pick('k + 5', STAGES6)} END",
    "confidence": "CASE WHEN type = 'human_corrected' AND k % 10 <> 7 THEN 1.0e0"
    " ELSE (50 + k % 51) / 100e0 END",
    "evidence_ref": "CASE WHEN k % 10 <> 0 THEN concat('m-', event_id) END",
    "rung": "CASE WHEN type IN ('human_corrected', 'note_added') THEN 4"
    " WHEN k % 4 = 3 THEN NULL ELSE 1 + k % 3 END",
}

SENDERS = (
    "Acme Hiring Team <no-reply@us.greenhouse-mail.io>", "Prima via Lever <no-reply@hire.lever.co>",
    "Jane Doe <janedoe@company3.com>", "LinkedIn <jobs-noreply@linkedin.com>",
    "Indeed <donotreply@match.indeed.com>", "GitHub <noreply@github.com>",
    "Marco Rossi <marco.rossi@gmail.com>", "Careers | Nova <careers@nova-labs.io>",
    "no-reply@shop.example.org", "Workable <mailer@workablemail.com>",
    "LeetCode <promo@leetcode.com>", "Talent <talent@company7.com>",
)
SUBJECTS = (
    "Thank you for applying to Nova Labs", "Application update", "Your application to Nova Labs",
    "Thank you for your application to Prima", "Weekly newsletter", "Colloquio conoscitivo",
    "Your application was sent to Nova Labs", "New job alert for you",
    "We would like to invite you to an interview", "Invito al colloquio", "Take-home assignment",
    "Offerta speciale: saldi", "Candidatura inviata", "Hello there", "A role in our team",
)
LEADS = (
    "We have received your application for the Senior Data Engineer position at Nova.",
    "Unfortunately we are moving forward with other candidates.", "Grazie per la tua candidatura.",
    "Dear all,", "Please schedule a call with us.",
    "See https://nova.example.com/jobs/123 for details, or meet.google.com/abc.", "Good morning.",
)
TITLES = ("Technical interview", "Intro call", "Chat with the CTO", "Catch up", "Take-home review")
ZONES = ("Etc/UTC", "Europe/Rome", "America/New_York", "Asia/Tokyo")
# <table> stands for the number of its rows, so that keys spread over all of it at every scale.
COMPANY_ID = "(user_id + CAST(floor((case_id % 8) / 3) AS INT)) % <supplier>"
CASE_COLUMNS = {
    "company_id": COMPANY_ID,
    "manually_created": "case_id % 11 = 0",
    "merged_into_id": "CASE WHEN case_id % 29 = 5 AND case_id % 8 > 0 THEN case_id - 1 END",
    "seniority": "CASE WHEN case_id % 3 = 0 THEN 'mid' END",
    "location": pick("case_id", ("Milano", None, "Berlin", "Remote")),
    "work_mode": pick("case_id", (None, "remote", "remote", None, "onsite")),
}
STAGE_ROWS = (
    ("applied", "Applied", "sent", 1, 21), ("acknowledged", "Acknowledged", "sent", 2, 21),
    ("recruiter_reachout", "Recruiter reach-out", "screening", 4, 10),
    ("hr_call", "HR call", "screening", 5, 10), ("take_home", "Take-home", "screening", 6, 14),
    ("interview", "Interview", "interviewing", 7, 12),
    ("technical", "Technical", "interviewing", 8, 12),
    ("system_design", "System design", "interviewing", 9, 12),
    ("onsite_loop", "Onsite loop", "interviewing", 10, 14),
    ("final", "Final", "interviewing", 11, 10), ("offer", "Offer", "decided", 12, 7),
    ("negotiating", "Negotiating", "decided", 13, 7),
)


class Tables:
    """Lazy DataFrames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sized(self, expression: str) -> str:
        """An expression with the numbers of rows put in."""
        return _ROWS.sub(lambda m: str(self.raw(m[1]).count()), expression)

    @cached_property
    def now(self):
        return F.to_timestamp(F.lit(NOW))

    @cached_property
    def log_with_repeats(self) -> DataFrame:
        """The event log, with every fifth event delivered twice."""
        again = self.log.filter("seq % 5 = 0").withColumn("seq", F.expr("seq + 1000000000"))
        return self.log.unionByName(again)

    @cached_property
    def log(self) -> DataFrame:
        return self._log_of(self.raw("events"))

    def _log_of(self, events: DataFrame) -> DataFrame:
        base = events.select(
            "event_id", "user_id", "event_type", "value", F.expr(K).alias("k"),
            F.col("ts").cast("timestamp").alias("ts"),
        )
        origin = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
        base = base.select(
            "event_id", "user_id", "value", "k",
            F.expr("user_id * 8 + event_id % 8").alias("case_id"),
            F.expr(to_spark(EVENT_TYPE)).alias("type"),
            (F.col("ts") + (F.col("ts") - origin) * 5).alias("occurred_at"),
        )
        flat = base.select(
            "*",
            *[F.expr(to_spark(e)).alias(n) for n, e in {**HEAD, **FLAT}.items()],
            *[
                F.when(
                    F.expr(cond),
                    F.date_format(
                        F.col("occurred_at") + F.expr(f"make_dt_interval(0, {hours})"),
                        "yyyy-MM-dd'T'HH:mm:ss'Z'",
                    ),
                ).alias(n)
                for n, (hours, cond) in TIMES.items()
            ],
        )
        fields = [
            (F.col(f"p_{f.name}") if f"p_{f.name}" in flat.columns else F.lit(None))
            .cast(f.dataType).alias(f.name)
            for f in PAYLOAD.fields
        ]
        return flat.select(
            "user_id", "case_id", F.col("event_id").alias("seq"), "type", "occurred_at",
            F.col("occurred_at").alias("recorded_at"), "from_stage", "to_stage", "confidence",
            "evidence_ref", F.col("rung").cast("int").alias("rung"),
            F.struct(*fields).alias("payload"),
        )

    @cached_property
    def stored_log(self) -> DataFrame:
        """The log as the table it is to reports, which read it more than once."""
        return kept(self._log_of(dealt(self.raw("events"))))

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("events").groupBy("user_id").agg(F.lit("EUR").alias("display_currency")).select(
            "user_id", F.expr(to_spark(pick("user_id", ZONES))).alias("tz"), "display_currency"
        )

    @cached_property
    def stage_defs(self) -> DataFrame:
        """Two tenants in three have stages of their own, one in three is slower to go stale."""
        rows = F.array(
            *[
                F.struct(
                    F.lit(k).alias("key"), F.lit(l).alias("label"), F.lit(p).alias("phase"),
                    F.lit(d).alias("depth"), F.lit(s).alias("stale_after_days"),
                )
                for k, l, p, d, s in STAGE_ROWS
            ]
        )
        return (
            self.users.filter("user_id % 3 <> 0")
            .select("user_id", F.explode(rows).alias("s"))
            .select(
                "user_id", "s.key", "s.label", "s.phase", "s.depth",
                F.expr("s.stale_after_days + CASE WHEN user_id % 3 = 2 THEN 20 ELSE 0 END")
                .alias("stale_after_days"),
            )
        )

    @cached_property
    def companies(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("company_id"),
            F.concat(F.lit("Company "), F.col("s_suppkey"),
                     F.expr(to_spark(pick("s_suppkey", (" GmbH", " S.p.A.", " Ltd", "", " Inc")))))
            .alias("canonical_name"),
            F.concat(F.lit("company"), F.col("s_suppkey"), F.lit(".com")).alias("domain"),
        )

    @cached_property
    def cases(self) -> DataFrame:
        rows = self.stored_log.groupBy("user_id", "case_id").agg(F.min("occurred_at").alias("created_at"))
        rows = rows.select("*", *[F.expr(to_spark(self.sized(e))).alias(n) for n, e in CASE_COLUMNS.items()])
        part = self.raw("part").select(
            F.col("p_partkey").alias("_pk"), F.col("p_name").alias("role_title")
        )
        # Spark guesses the names of all parts too small by their file, so they are not left to be broadcast.
        return rows.join(part.hint("merge"), F.expr(self.sized("case_id % <part>")) == F.col("_pk"), "left").drop("_pk")

    @cached_property
    def messages(self) -> DataFrame:
        """Documents as mail: senders, subjects and headers of our own around the whole text."""
        d = F.col("doc_id")
        invited = F.struct(
            F.concat(F.lit("uid-"), d).alias("uid"),
            F.expr(to_spark(pick("doc_id", TITLES))).alias("summary"),
            F.expr("TIMESTAMP '2024-08-01 09:00:00' + make_dt_interval(CAST(doc_id % 30 AS INT))")
            .alias("starts_at"),
            F.lit(None).cast("timestamp").alias("ends_at"),
            F.lit("Room 5").alias("location"),
            F.expr("CASE WHEN doc_id % 2 = 0 THEN 'cancelled' ELSE 'confirmed' END").alias("status"),
            F.lit("REQUEST").alias("method"),
            F.lit("people@company2.com").alias("organiser"),
        )
        lead = F.expr(to_spark(pick("doc_id", LEADS)))
        return dealt(self.raw("documents").select("doc_id", "text")).select(
            "doc_id",
            F.concat(F.lit("d-"), d).alias("message_id"),
            (d % 20).alias("user_id"),
            F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('t-', doc_id % 400) END").alias("thread_id"),
            F.expr("TIMESTAMP '2024-07-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT))")
            .alias("received_at"),
            F.expr(to_spark(pick("doc_id", SENDERS))).alias("sender"),
            F.expr(to_spark(pick("doc_id", SUBJECTS))).alias("subject"),
            F.concat(lead, F.lit("\n"), F.col("text")).alias("text"),
            F.expr("CASE WHEN doc_id % 8 = 3 THEN 'list.example.org' END").alias("list_id"),
            F.expr("CASE WHEN doc_id % 4 = 1 THEN '<mailto:off@example.org>' END").alias("list_unsubscribe"),
            F.expr("CASE WHEN doc_id % 4 = 2 THEN 'Bulk' END").alias("precedence"),
            F.when(d % 25 == 7, invited).alias("invite"),
        )

    @cached_property
    def interviews(self) -> DataFrame:
        return log_ops.interviews_from_events(self.stored_log)

    @cached_property
    def offers(self) -> DataFrame:
        return log_ops.offers_from_events(self.stored_log)

    @cached_property
    def deadlines(self) -> DataFrame:
        return log_ops.deadlines_from_events(self.stored_log)

    @cached_property
    def sources(self) -> DataFrame:
        return log_ops.sources_from_events(self.stored_log)

    @cached_property
    def projected(self) -> DataFrame:
        """The projection, a stored table as well. Spark guesses the stages of all tenants too small, so they are not left to be broadcast."""
        return kept(fold_ops.project_cases(
            self.cases, self.stored_log, self.now, stage_defs=self.stage_defs.hint("merge"), deadlines=self.deadlines
        ))

    @cached_property
    def dwell(self) -> DataFrame:
        return kept(reach_ops.stage_dwell_in(self.stored_log))

    @cached_property
    def reach(self) -> DataFrame:
        return kept(reach_ops.phase_reach(self.projected, self.stored_log, self.stage_defs))

    @cached_property
    def active(self) -> DataFrame:
        """Cases with their activity."""
        return kept(with_activity(self.projected, self.stage_defs, self.dwell, self.interviews, self.now))


# --- the same shapes in SQL ------------------------------------------------------

CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, text: str, uses: str = "") -> None:
    CTES[name] = (uses, text)


def with_ctes(body: str, names: list[str]) -> str:
    """Put the named tables, and what they need, before the query."""
    body = to_duck(body)
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        uses, _ = CTES[name]
        for other in uses.split():
            visit(other)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{to_duck(CTES[n][1])}\n)" for n in ordered)
    return f"WITH {parts}\n{body}"


_FLAT_SQL = ",\n  ".join(
    [f"{e} AS {n}" for n, e in {**HEAD, **FLAT}.items()]
    + [
        f"CASE WHEN {cond} THEN date_trunc('second', occurred_at + to_hours({hours})) END AS {n}"
        for n, (hours, cond) in TIMES.items()
    ]
)
cte("ev0", f"""SELECT event_id, user_id, value, {K} AS k, ts, event_type,
  user_id * 8 + event_id % 8 AS case_id FROM events""")
cte("ev1", f"""SELECT event_id, user_id, value, k, case_id, {EVENT_TYPE} AS type,
  ts + (ts - TIMESTAMP '2024-01-01 00:00:00') * 5 AS occurred_at FROM ev0""", "ev0")
cte("ev", f"SELECT event_id AS seq, *,\n  {_FLAT_SQL}\nFROM ev1", "ev1")
cte("users_", f"SELECT DISTINCT user_id, {pick('user_id', ZONES)} AS tz, 'EUR' AS display_currency FROM ev", "ev")
_STAGE_SQL = ", ".join(f"('{k}', '{l}', '{p}', {d}, {s})" for k, l, p, d, s in STAGE_ROWS)
cte("default_stages", f"""SELECT * FROM (VALUES {_STAGE_SQL})
  AS t(key, label, phase, depth, stale_after_days)""")
cte("stage_defs_", """SELECT user_id, key, label, phase, depth,
  stale_after_days + CASE WHEN user_id % 3 = 2 THEN 20 ELSE 0 END AS stale_after_days
  FROM users_, default_stages WHERE user_id % 3 <> 0""", "users_ default_stages")
cte("stages_", """SELECT * FROM stage_defs_
  UNION ALL SELECT user_id, key, label, phase, depth, stale_after_days
  FROM users_, default_stages WHERE user_id % 3 = 0""", "stage_defs_")
cte("companies_", f"""SELECT s_suppkey AS company_id,
  concat('Company ', s_suppkey, {pick('s_suppkey', (' GmbH', ' S.p.A.', ' Ltd', '', ' Inc'))}) AS canonical_name,
  concat('company', s_suppkey, '.com') AS domain FROM supplier""")
_CASES_SQL = ", ".join(f"{e} AS {n}" for n, e in CASE_COLUMNS.items())
cte("cases_", f"""SELECT c.*, p.p_name AS role_title FROM (
  SELECT user_id, case_id, created_at, {_CASES_SQL} FROM (
    SELECT user_id, case_id, min(occurred_at) AS created_at FROM ev GROUP BY ALL) x) c
  LEFT JOIN part p ON p.p_partkey = c.case_id % <part>""", "ev")

_TIER = """CASE WHEN type = 'human_corrected' AND p_field = '{f}' AND confidence >= 1 THEN 3
    WHEN type IN ('rejected', 'withdrawn', 'accepted') THEN 2 ELSE 1 END"""
_TIE = "concat(coalesce(evidence_ref, ''), ' ', type)"
_STATUS = """CASE WHEN type IN ('rejected', 'withdrawn', 'accepted') THEN type
    WHEN type = 'went_silent' THEN 'dormant'
    WHEN type = 'human_corrected' THEN CASE WHEN p_field = 'status' AND p_to IN
      ('live', 'dormant', 'rejected', 'withdrawn', 'accepted') THEN p_to END
    WHEN type <> 'note_added' THEN 'live' END"""
_STAGE = """CASE WHEN type IN ('applied', 'acknowledged') THEN type
    WHEN type = 'stage_advanced' THEN coalesce(nullif(to_stage, ''), p_to_stage)
    WHEN type = 'interview_scheduled' AND coalesce(p_status, '') <> 'cancelled' THEN p_stage
    WHEN type = 'offer_received' THEN 'offer' WHEN type = 'offer_negotiated' THEN 'negotiating'
    WHEN type = 'human_corrected' AND p_field = 'stage' THEN p_to END"""


def _ranked(field: str, value: str, where: str = "true") -> str:
    return f"""SELECT user_id, case_id, value, type, occurred_at, confidence, tie, seq FROM (
    SELECT user_id, case_id, {value} AS value, type, occurred_at, confidence, seq, {_TIE} AS tie,
      row_number() OVER (PARTITION BY user_id, case_id ORDER BY {_TIER.format(f=field)} DESC,
        occurred_at DESC, confidence DESC, {_TIE} DESC) AS rn
    FROM ev WHERE confidence >= 0.6 AND ({value}) IS NOT NULL AND {where}) r WHERE rn = 1"""


cte("w_status", _ranked("status", _STATUS), "ev")
cte("w_frozen", "SELECT * FROM w_status WHERE type IN ('rejected', 'withdrawn', 'accepted')", "w_status")
cte("w_stage", f"""SELECT user_id, case_id, value, type, occurred_at, confidence, seq FROM (
    SELECT e.user_id, e.case_id, e.type, e.occurred_at, e.confidence, e.seq, {_STAGE.replace('type', 'e.type')} AS value,
      row_number() OVER (PARTITION BY e.user_id, e.case_id ORDER BY
        CASE WHEN e.type = 'human_corrected' AND p_field = 'stage' AND e.confidence >= 1 THEN 3 ELSE 1 END DESC,
        e.occurred_at DESC, e.confidence DESC, concat(coalesce(evidence_ref, ''), ' ', e.type) DESC) AS rn
    FROM ev e LEFT JOIN w_frozen f USING (user_id, case_id)
    WHERE e.confidence >= 0.6 AND ({_STAGE.replace('type', 'e.type')}) IS NOT NULL
      AND (f.seq IS NULL
        OR (e.type = 'human_corrected' AND p_field = 'stage' AND e.confidence >= 1)
        OR (e.occurred_at, e.confidence, concat(coalesce(evidence_ref, ''), ' ', e.type))
           <= (f.occurred_at, f.confidence, f.tie))) r WHERE rn = 1""", "ev w_frozen")
for _f in ("role_title", "seniority", "location", "work_mode", "channel"):
    cte(f"w_{_f}", _ranked(_f, f"coalesce(CASE WHEN type = 'human_corrected' AND p_field = '{_f}'"
                               f" THEN nullif(p_to, '') END, p_{_f})"), "ev")
cte("w_comp", _ranked("comp_expectation", "CASE WHEN p_field = 'comp_expectation' THEN p_to END"), "ev")
cte("w_applied", _ranked("applied_at", "CASE WHEN p_field = 'applied_at' THEN TRY_CAST(p_to AS TIMESTAMP) END"), "ev")
cte("w_times", """SELECT user_id, case_id, count(*) AS event_count,
  min(occurred_at) FILTER (type = 'applied' AND confidence >= 0.6) AS first_applied,
  min(occurred_at) FILTER (type = 'acknowledged' AND confidence >= 0.6) AS first_ack,
  max(occurred_at) FILTER (confidence >= 0.6 AND type NOT IN
    ('withdrawn', 'accepted', 'went_silent', 'human_corrected', 'note_added')) AS last_signal_at,
  max(occurred_at) FILTER (type = 'went_silent') AS silent_at,
  arg_max(p_presumed_closed, occurred_at) FILTER (type = 'went_silent') AS silent_closed,
  max(occurred_at) FILTER (type IN ('human_corrected', 'note_added', 'withdrawn', 'accepted')
    OR rung = 4) AS last_user_action_at
  FROM ev GROUP BY ALL""", "ev")
cte("folded", """SELECT t.user_id, t.case_id,
  coalesce(sg.value, 'applied') AS current_stage,
  coalesce(sd.phase, 'sent') AS current_phase,
  coalesce(st.value, 'live') AS status,
  coalesce(ap.value, t.first_applied, t.first_ack) AS applied_at,
  t.last_signal_at, r.value AS role_title, s.value AS seniority, l.value AS location,
  m.value AS work_mode, c.value AS channel,
  CAST(json_extract_string(co.value, '$.minor') AS BIGINT) AS comp_expectation_minor,
  upper(json_extract_string(co.value, '$.currency')) AS comp_currency,
  coalesce(sg.confidence, 0.0) AS confidence,
  CASE WHEN coalesce(st.value, 'live') = 'dormant' THEN t.silent_at END AS went_dormant_at,
  coalesce(coalesce(st.value, 'live') = 'dormant' AND t.silent_closed, false) AS presumed_closed,
  t.last_user_action_at
  FROM w_times t
  LEFT JOIN w_status st USING (user_id, case_id) LEFT JOIN w_stage sg USING (user_id, case_id)
  LEFT JOIN w_role_title r USING (user_id, case_id) LEFT JOIN w_seniority s USING (user_id, case_id)
  LEFT JOIN w_location l USING (user_id, case_id) LEFT JOIN w_work_mode m USING (user_id, case_id)
  LEFT JOIN w_channel c USING (user_id, case_id) LEFT JOIN w_comp co USING (user_id, case_id)
  LEFT JOIN w_applied ap USING (user_id, case_id)
  LEFT JOIN stages_ sd ON sd.user_id = t.user_id AND sd.key = coalesce(sg.value, 'applied')""",
    "w_times w_status w_stage w_role_title w_seniority w_location w_work_mode w_channel w_comp"
    " w_applied stages_")
cte("interviews_", """SELECT concat('iv-', min(seq)) AS interview_id, user_id,
  arg_min(case_id, seq) AS case_id,
  coalesce(arg_max(stage, seq) FILTER (NOT cancelled), arg_min(stage, seq)) AS stage,
  arg_max(p_starts_at, seq) AS starts_at,
  max_by(struct_pack(v := p_ends_at), seq).v AS ends_at,
  min_by(struct_pack(v := p_location), seq).v AS location,
  p_calendar_event_id AS calendar_event_id,
  max_by(struct_pack(v := CASE WHEN cancelled THEN occurred_at END), seq).v AS cancelled_at,
  CAST(NULL AS BOOLEAN) AS held
  FROM (SELECT *, coalesce(p_status = 'cancelled', false) AS cancelled,
    coalesce(nullif(p_stage, ''), 'interview') AS stage,
    CASE WHEN p_calendar_event_id IS NULL THEN seq END AS own
    FROM ev WHERE type = 'interview_scheduled' AND p_starts_at IS NOT NULL) b
  GROUP BY user_id, p_calendar_event_id, own""", "ev")
cte("offers_", """SELECT seq AS offer_id, user_id, case_id, 'offer' AS kind, p_min_minor AS min_minor,
  p_max_minor AS max_minor, upper(p_currency) AS currency, CAST(p_decide_by AS DATE) AS decide_by,
  occurred_at AS created_at FROM ev
  WHERE type IN ('offer_received', 'offer_negotiated') AND p_min_minor IS NOT NULL
    AND coalesce(p_currency, '') <> ''""", "ev")
cte("deadlines_", """SELECT seq AS deadline_id, user_id, case_id, coalesce(p_kind, 'take_home') AS kind,
  p_due_at AS due_at, 'gmail' AS source FROM ev
  WHERE type = 'deadline_set' AND p_due_at IS NOT NULL""", "ev")
cte("sources_", """SELECT seq AS source_id, user_id, case_id, p_channel AS channel,
  p_posting_url AS posting_url, p_ats_vendor AS ats_vendor, occurred_at AS first_seen_at,
  type = 'applied' AND row_number() OVER (PARTITION BY user_id, case_id, type = 'applied'
    ORDER BY seq) = 1 AS is_first_touch
  FROM ev WHERE p_channel IS NOT NULL""", "ev")
cte("projected", f"""SELECT c.user_id, c.case_id, c.company_id, c.created_at, c.manually_created,
  c.merged_into_id, f.current_stage, f.current_phase, f.status, f.applied_at, f.last_signal_at,
  f.went_dormant_at, f.last_user_action_at,
  f.status = 'live' AND f.current_stage NOT IN ('take_home', 'offer', 'negotiating')
    AND NOT EXISTS (SELECT 1 FROM deadlines_ d WHERE d.user_id = c.user_id AND d.case_id = c.case_id
      AND d.due_at > TIMESTAMP '{NOW}') AS awaiting_them,
  f.presumed_closed, coalesce(f.role_title, c.role_title) AS role_title,
  coalesce(f.seniority, c.seniority) AS seniority, coalesce(f.location, c.location) AS location,
  coalesce(f.work_mode, c.work_mode) AS work_mode, f.comp_expectation_minor, f.comp_currency,
  f.confidence, false AS needs_review
  FROM cases_ c JOIN folded f USING (user_id, case_id)""", "cases_ folded deadlines_")
cte("moves", """SELECT * FROM (SELECT user_id, case_id, seq, to_stage, lag(to_stage) OVER w AS from_stage,
  epoch(occurred_at - lag(occurred_at) OVER w) / 86400 AS days FROM ev
  WHERE type IN ('stage_advanced', 'applied', 'acknowledged', 'interview_scheduled', 'offer_received')
  WINDOW w AS (PARTITION BY case_id ORDER BY occurred_at, seq)) x WHERE days IS NOT NULL""", "ev")
cte("dwell_in", """SELECT user_id, from_stage AS stage, quantile_cont(days, 0.5) AS p50_days,
  quantile_cont(days, 0.75) AS p75_days, quantile_cont(days, 0.9) AS p90_days, count(*) AS n
  FROM moves WHERE from_stage IS NOT NULL GROUP BY ALL""", "moves")
cte("reach_", """SELECT c.user_id, c.case_id, c.company_id, c.applied_at, c.created_at, c.status,
  c.current_phase,
  coalesce(bool_or(e.type IN ('interview_scheduled', 'interview_held')
    OR coalesce(sd.phase = 'interviewing', false)), false) AS reached_interview,
  coalesce(bool_or(e.type = 'offer_received'), false) AS reached_offer,
  min(e.occurred_at) FILTER (e.type IN ('stage_advanced', 'interview_scheduled', 'interview_held',
    'offer_received', 'offer_negotiated', 'rejected', 'deadline_set')) AS first_human_at,
  max(e.occurred_at) FILTER (e.type <> 'went_silent') AS last_event_at,
  count(e.seq) AS event_count
  FROM projected c LEFT JOIN ev e ON e.user_id = c.user_id AND e.case_id = c.case_id
  LEFT JOIN stage_defs_ sd ON sd.user_id = c.user_id AND sd.key = e.to_stage
  WHERE c.merged_into_id IS NULL GROUP BY ALL""", "projected ev stage_defs_")
cte("act", f"""SELECT a.*, sd.depth, sd.stale_after_days, d.p50_days, d.p75_days, d.p90_days, d.n AS dwell_n,
  nx.starts_at AS next_interview_at,
  CASE WHEN a.status <> 'live' THEN 'closed' WHEN nx.starts_at IS NOT NULL THEN 'active'
    WHEN a.presumed_closed THEN 'closed'
    WHEN a.current_stage IN ('negotiating', 'offer', 'take_home') THEN 'active'
    WHEN a.last_signal_at IS NULL THEN 'active'
    WHEN a.last_signal_at < TIMESTAMP '{NOW}' - to_days(CASE WHEN a.current_phase = 'sent' THEN 60 ELSE 90 END) THEN 'closed'
    WHEN a.last_signal_at < TIMESTAMP '{NOW}' - to_days(CAST(ceil(greatest(
      coalesce(sd.stale_after_days, 21), coalesce(2 * d.p90_days, 0))) AS INT)) THEN 'stale'
    ELSE 'active' END AS activity
  FROM projected a
  LEFT JOIN stage_defs_ sd ON sd.user_id = a.user_id AND sd.key = a.current_stage
  LEFT JOIN dwell_in d ON d.user_id = a.user_id AND d.stage = a.current_stage AND d.n >= 5
  LEFT JOIN (SELECT user_id, case_id, min(starts_at) AS starts_at FROM interviews_
    WHERE cancelled_at IS NULL AND starts_at > TIMESTAMP '{NOW}' GROUP BY ALL) nx
    ON nx.user_id = a.user_id AND nx.case_id = a.case_id
  WHERE a.merged_into_id IS NULL""", "projected stage_defs_ dwell_in interviews_")

cte("msg", f"""SELECT doc_id, concat('d-', doc_id) AS message_id, doc_id % 20 AS user_id,
  CASE WHEN doc_id % 3 = 0 THEN concat('t-', doc_id % 400) END AS thread_id,
  {pick('doc_id', SENDERS)} AS sender, {pick('doc_id', SUBJECTS)} AS subject,
  concat({pick('doc_id', LEADS)}, chr(10), text) AS text,
  doc_id % 8 = 3 AS has_list, doc_id % 4 = 1 AS has_unsubscribe, doc_id % 4 = 2 AS bulk,
  doc_id % 25 = 7 AS invited, doc_id % 2 = 0 AS cancelled, {pick('doc_id', TITLES)} AS title
  FROM documents""")
