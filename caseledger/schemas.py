"""Row shapes shared by the jobs."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "binary": T.BinaryType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(spec: str) -> T.StructType:
    """Fields written as `name type, name type`. Needs no running session."""
    fields = (field.split() for field in spec.split(","))
    return T.StructType([T.StructField(name.strip("`"), _TYPES[kind]) for name, kind in fields])


# The payload keys the jobs read. Anything else stays in the raw JSON of the landing table.
PAYLOAD = _struct(
    "field string, `to` string, `from` string, merged_id string, stage string, to_stage string,"
    " status string, role_title string, seniority string, location string, work_mode string,"
    " company_id string, channel string, thread_id string, posting_url string, ats_vendor string,"
    " starts_at string, ends_at string, calendar_event_id string, interview_id string,"
    " min_minor bigint, max_minor bigint, currency string, equity_note string, decide_by string,"
    " due_at string, kind string, url string, source string, note string, text string,"
    " after_stage string, language string, days_quiet bigint, threshold_used string,"
    " presumed_closed boolean"
)

EVENT = _struct(
    "user_id bigint, case_id bigint, seq bigint, type string, occurred_at timestamp,"
    " recorded_at timestamp, from_stage string, to_stage string, confidence double,"
    " evidence_ref string, rung int"
).add("payload", PAYLOAD)

# The log as it lands, with the payload still JSON text.
RAW_EVENT = _struct(
    "user_id bigint, case_id bigint, seq bigint, type string, occurred_at timestamp,"
    " recorded_at timestamp, from_stage string, to_stage string, confidence double,"
    " evidence_ref string, rung int, payload string"
)

HEADERS = _struct(
    "message_id string, sender string, subject string, date string, `to` array<string>,"
    " in_reply_to string, `references` array<string>, list_id string, list_unsubscribe string,"
    " precedence string, auto_submitted string"
)
INVITE = _struct(
    "uid string, summary string, starts_at timestamp, ends_at timestamp, location string,"
    " organiser string, attendees array<string>, status string, method string"
)
MESSAGE = (
    _struct(
        "user_id string, mailbox_id string, provider_message_id string, thread_id string,"
        " received_at timestamp"
    )
    .add("headers", HEADERS)
    .add("text", T.StringType())
    .add("body_sha256", T.StringType())
    .add("invite", INVITE)
    .add("backfill", T.BooleanType())
)
READING = _struct(
    "intent string, confidence double, rung int, company string, role string, stage_hint string,"
    " deadline string, comp_min_minor bigint, comp_max_minor bigint, comp_currency string"
)

# Account tables, read by sources.tables.read_account_tables.
TABLES = {
    "users": _struct("user_id bigint, tz string, display_currency string, locale string"),
    "companies": _struct("company_id bigint, canonical_name string, domain string"),
    "company_aliases": _struct("user_id bigint, company_id bigint, alias string"),
    "stage_defs": _struct(
        "user_id bigint, key string, label string, phase string, depth int, stale_after_days int"
    ),
    "cases": _struct(
        "case_id bigint, user_id bigint, company_id bigint, role_title string, seniority string,"
        " location string, work_mode string, manually_created boolean, merged_into_id bigint,"
        " created_at timestamp"
    ),
    "events": EVENT,
    "sources": _struct(
        "source_id bigint, user_id bigint, case_id bigint, channel string, posting_url string,"
        " ats_vendor string, first_seen_at timestamp, is_first_touch boolean"
    ),
    "interviews": _struct(
        "interview_id string, user_id bigint, case_id bigint, stage string, starts_at timestamp,"
        " ends_at timestamp, location string, calendar_event_id string, held boolean,"
        " cancelled_at timestamp"
    ),
    "comp_offers": _struct(
        "offer_id bigint, user_id bigint, case_id bigint, kind string, min_minor bigint,"
        " max_minor bigint, currency string, equity_note string, decide_by date,"
        " created_at timestamp"
    ),
    "deadlines": _struct(
        "deadline_id bigint, user_id bigint, case_id bigint, kind string, due_at timestamp,"
        " url string, source string, met_at timestamp"
    ),
    "review_items": _struct(
        "review_id string, user_id bigint, kind string, evidence_ref string, case_id bigint,"
        " excerpt string, candidates string, learned_pattern string, created_at timestamp,"
        " resolved_at timestamp, resolution string, expires_at timestamp"
    ),
    "suggestions": _struct(
        "user_id bigint, key string, rule string, payload string, created_at timestamp,"
        " expires_at timestamp, acted_at timestamp, snoozed_until timestamp,"
        " dismissed_at timestamp"
    ),
    "seen_messages": _struct(
        "mailbox_id bigint, provider_message_id string, user_id bigint, body_sha256 binary,"
        " received_at timestamp, processed_at timestamp, outcome string, park_attempts int"
    ),
    "mailbox_accounts": _struct(
        "mailbox_id bigint, user_id bigint, provider string, address string, status string,"
        " last_ok_at timestamp, backlog_estimate bigint"
    ),
    "notifications_sent": _struct(
        "user_id bigint, rule string, suggestion_key string, sent_at timestamp, local_date date"
    ),
}
