"""The append-only event log and the tables that follow from it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.clock import moment
from ..schemas import PAYLOAD
from .skew import first_per_key

EVENT_KEY = ["user_id", "case_id", "type", "occurred_at", "evidence_ref"]


def parse_payload(raw: DataFrame) -> DataFrame:
    """Landed JSON payloads to the typed struct the jobs read."""
    return raw.withColumn("payload", F.from_json("payload", PAYLOAD))


def valid_events(df: DataFrame) -> DataFrame:
    """Rows the log accepts: a known type and a confidence between 0 and 1."""
    return df.filter(F.col("type").isin(*C.EVENT_TYPES) & F.col("confidence").between(0, 1))


def rejected_events(df: DataFrame) -> DataFrame:
    """The other rows, with the reason: what an append leaves out is handed back, not lost."""
    reason = F.when(~F.coalesce(F.col("type").isin(*C.EVENT_TYPES), F.lit(False)), "unknown type").when(
        ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence outside 0 to 1"
    )
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def dedupe_events(log: DataFrame) -> DataFrame:
    """One row per event key, nulls equal, the first to arrive stays."""
    return first_per_key(log, EVENT_KEY, F.col("seq"))


def new_events(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows that are not in the log yet: what an append would land.

    Only the events of the cases that are coming in are compared; a log partitioned by them is read in part.
    """
    fresh = dedupe_events(valid_events(incoming)).alias("i")
    touched = incoming.select("user_id", "case_id").distinct()
    known = log.select(*EVENT_KEY).join(touched, ["user_id", "case_id"], "left_semi").distinct().alias("k")
    same = F.lit(True)
    for c in ("user_id", "case_id", "type", "occurred_at"):
        same = same & (F.col(f"i.{c}") == F.col(f"k.{c}"))
    same = same & F.col("i.evidence_ref").eqNullSafe(F.col("k.evidence_ref"))
    return fresh.join(known, same, "left_anti")


def append_events(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """The log after the append."""
    return log.unionByName(new_events(log, incoming), allowMissingColumns=True)


def thread_map(log: DataFrame) -> DataFrame:
    """The newest case of each thread of a tenant."""
    return (
        log.filter(F.col("payload.thread_id").isNotNull())
        .groupBy("user_id", F.col("payload.thread_id").alias("thread_id"))
        .agg(F.max_by("case_id", F.struct("occurred_at", "seq")).alias("case_id"))
    )


def latest_per_case(log: DataFrame) -> DataFrame:
    """The last event of each case."""
    return first_per_key(
        log, ["user_id", "case_id"], F.struct("occurred_at", "seq"), last=True
    )


# --- satellites ---------------------------------------------------------------


def interviews_from_events(log: DataFrame) -> DataFrame:
    """One row per booked interview, from the scheduling events in arrival order.

    A calendar entry keeps the case and place it was first seen with. Times follow the last
    event. A cancellation sets `cancelled_at` and leaves the round alone. Entries without a
    calendar id are never the same interview.
    """
    p = F.col("payload")
    booked = log.filter(
        (F.col("type") == "interview_scheduled") & moment(p["starts_at"]).isNotNull()
    ).select(
        "user_id",
        p["calendar_event_id"].alias("calendar_event_id"),
        F.when(p["calendar_event_id"].isNull(), F.col("seq")).alias("_own"),
        "case_id",
        "seq",
        "occurred_at",
        moment(p["starts_at"]).alias("starts_at"),
        moment(p["ends_at"]).alias("ends_at"),
        p["location"].alias("location"),
        F.coalesce(F.nullif(p["stage"], F.lit("")), F.lit(C.UNSPECIFIED_INTERVIEW)).alias("stage"),
        F.coalesce(p["status"] == "cancelled", F.lit(False)).alias("_cancelled"),
    )
    seq = F.col("seq")
    rows = booked.groupBy("user_id", "calendar_event_id", "_own").agg(
        F.min("seq").alias("_first"),
        F.min_by("case_id", seq).alias("case_id"),
        F.min_by("location", seq).alias("location"),
        F.max_by("starts_at", seq).alias("starts_at"),
        F.max_by("ends_at", seq).alias("ends_at"),
        F.max_by("stage", F.when(~F.col("_cancelled"), seq)).alias("_live_stage"),
        F.min_by("stage", seq).alias("_first_stage"),
        F.max_by(F.when(F.col("_cancelled"), F.col("occurred_at")), seq).alias("cancelled_at"),
    )
    rows = rows.select(
        F.concat(F.lit("iv-"), F.col("_first")).alias("interview_id"),
        "user_id",
        "case_id",
        F.coalesce("_live_stage", "_first_stage").alias("stage"),
        "starts_at",
        "ends_at",
        "location",
        "calendar_event_id",
        "cancelled_at",
    )
    held = held_from_events(log)
    return rows.join(held, ["user_id", "interview_id"], "left").select(
        "interview_id", "user_id", "case_id", "stage", "starts_at", "ends_at", "location",
        "calendar_event_id", "held", "cancelled_at",
    )


def held_from_events(log: DataFrame) -> DataFrame:
    """Interviews a later event says took place."""
    return (
        log.filter((F.col("type") == "interview_held") & F.col("payload.interview_id").isNotNull())
        .select("user_id", F.col("payload.interview_id").alias("interview_id"))
        .distinct()
        .withColumn("held", F.lit(True))
    )


def offers_from_events(log: DataFrame) -> DataFrame:
    """Offers with an amount and a currency. Anything less is not an offer row."""
    p = F.col("payload")
    return log.filter(
        F.col("type").isin("offer_received", "offer_negotiated")
        & p["min_minor"].isNotNull()
        & (F.coalesce(p["currency"], F.lit("")) != "")
    ).select(
        F.col("seq").alias("offer_id"),
        "user_id",
        "case_id",
        F.lit("offer").alias("kind"),
        p["min_minor"].alias("min_minor"),
        p["max_minor"].alias("max_minor"),
        F.upper(p["currency"]).alias("currency"),
        p["equity_note"].alias("equity_note"),
        F.to_date(moment(p["decide_by"])).alias("decide_by"),
        F.col("occurred_at").alias("created_at"),
    )


def deadlines_from_events(log: DataFrame) -> DataFrame:
    p = F.col("payload")
    return log.filter(
        (F.col("type") == "deadline_set") & moment(p["due_at"]).isNotNull()
    ).select(
        F.col("seq").alias("deadline_id"),
        "user_id",
        "case_id",
        F.coalesce(p["kind"], F.lit("take_home")).alias("kind"),
        moment(p["due_at"]).alias("due_at"),
        p["url"].alias("url"),
        F.coalesce(p["source"], F.lit("gmail")).alias("source"),
        F.lit(None).cast("timestamp").alias("met_at"),
    )


def sources_from_events(log: DataFrame) -> DataFrame:
    """Where each case was found. Only the first claim of a case is its first touch."""
    p = F.col("payload")
    rows = log.filter(p["channel"].isNotNull()).select(
        F.col("seq").alias("source_id"),
        "user_id",
        "case_id",
        p["channel"].alias("channel"),
        p["posting_url"].alias("posting_url"),
        p["ats_vendor"].alias("ats_vendor"),
        F.col("occurred_at").alias("first_seen_at"),
        (F.col("type") == "applied").alias("_claims"),
    )
    first = rows.filter("_claims").groupBy("user_id", "case_id").agg(
        F.min("source_id").alias("source_id"), F.lit(True).alias("is_first_touch")
    )
    return rows.drop("_claims").join(first, ["user_id", "case_id", "source_id"], "left").select(
        *[c for c in rows.columns if c != "_claims"],
        F.coalesce("is_first_touch", F.lit(False)).alias("is_first_touch"),
    )


def split_pairs(log: DataFrame) -> DataFrame:
    """Pairs a person pulled apart: (user_id, case_id, other_id)."""
    p = F.col("payload")
    return (
        log.filter(
            (F.col("type") == "human_corrected")
            & (p["field"] == "merge")
            & (p["to"] == "split")
            & p["merged_id"].isNotNull()
        )
        .select("user_id", "case_id", p["merged_id"].cast("bigint").alias("other_id"))
        .distinct()
    )


def free_split_cases(cases: DataFrame, log: DataFrame) -> DataFrame:
    """Undo a merge: a case named by a merge correction is on its own again."""
    p = F.col("payload")
    freed = (
        log.filter(
            (F.col("type") == "human_corrected") & (p["field"] == "merge")
            & (F.coalesce(p["merged_id"], F.lit("")) != "")
        )
        .select("user_id", p["merged_id"].cast("bigint").alias("case_id"))
        .distinct()
        .withColumn("_freed", F.lit(True))
    )
    return (
        cases.join(freed, ["user_id", "case_id"], "left")
        .withColumn("merged_into_id", F.when(F.col("_freed").isNull(), F.col("merged_into_id")))
        .drop("_freed")
    )


# --- commands of people ---------------------------------------------------------


def commands_to_events(commands: DataFrame, states: DataFrame) -> DataFrame:
    """Rows of human commands to events at full confidence.

    `commands`: command_id, user_id, case_id, kind (archive | correct | add), arg (archive:
    dormant or withdrawn; correct: the field; add: the channel), value, at. Rejected commands
    carry no event. `states` gives the value a correction replaces.
    """
    kind, arg = F.col("kind"), F.col("arg")
    archive = (kind == "archive") & arg.isin("dormant", "withdrawn")
    correct = (kind == "correct") & arg.isin(*C.CORRECTABLE)
    add = (kind == "add") & (arg.isNull() | arg.isin(*C.CHANNELS))
    before = F.when(arg == "stage", F.col("current_stage")).when(arg == "status", F.col("status"))
    current = states.select("user_id", "case_id", "current_stage", "status")
    return (
        commands.join(current, ["user_id", "case_id"], "left")
        .filter(archive | (correct & F.col("current_stage").isNotNull()) | add)
        .select(
            "command_id",
            "user_id",
            "case_id",
            F.when(archive & (arg == "withdrawn"), "withdrawn")
            .when(archive, "went_silent")
            .when(correct, "human_corrected")
            .otherwise("applied")
            .alias("type"),
            F.col("at").alias("occurred_at"),
            F.when(add, "applied").alias("to_stage"),
            F.lit(C.PINNED_CONFIDENCE).alias("confidence"),
            F.lit(C.HUMAN_RUNG).alias("rung"),
            F.when(correct, arg).alias("field"),
            F.when(correct, before).alias("from_value"),
            F.when(correct, F.col("value")).alias("to_value"),
            F.when(add, F.coalesce(arg, F.lit("career_page"))).alias("channel"),
            F.when(add, F.col("value")).alias("role_title"),
            F.when(archive & (arg == "dormant"), "archived_by_user").alias("threshold_used"),
        )
    )


def ledger_outcomes(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Close messages in the replay ledger.

    `outcomes`: mailbox_id, provider_message_id, outcome, at, and `repark` for stubs that go
    back to parked only where nothing has closed the message since.
    """
    key = ["mailbox_id", "provider_message_id"]
    closing = first_per_key(
        outcomes.filter(~F.col("repark")).select(*key, "outcome", "at"), key,
        F.struct("at", "outcome"), last=True,
    ).select(*key, F.col("outcome").alias("_new"), F.col("at").alias("_at"))
    reparked = outcomes.filter("repark").select(*key).distinct().withColumn("_park", F.lit(True))
    settled = F.coalesce(F.col("_new"), F.col("outcome"))
    return (
        ledger.join(closing, key, "left")
        .join(reparked, key, "left")
        .withColumn("processed_at", F.coalesce("_at", "processed_at"))
        .withColumn(
            "outcome",
            F.when(settled.isNull() & F.col("_park"), F.lit("parked")).otherwise(settled),
        )
        .drop("_new", "_at", "_park")
    )
