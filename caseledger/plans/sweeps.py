"""Scheduled jobs. Each takes the instant it runs at, and emits rows instead of changing any."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import wording as T
from ..functions.clock import days_exact, iso_z, local, minus_days, plus_hours
from ..operators.activity import with_gated_dwell
from ..operators.reach import not_merged
from ..operators.stages import join_defs

CASE = ["user_id", "case_id"]


def due_users(users: DataFrame, now: Column, hour: int = 3) -> DataFrame:
    """Tenants for whom it is that hour of the day right now."""
    return users.filter(F.hour(local(now, F.col("tz"))) == hour).select("user_id")


def dormancy_sweep(
    projected: DataFrame,
    stage_defs: DataFrame,
    dwell: DataFrame,
    now: Column,
    *,
    users: DataFrame | None = None,
    presumed_closed_days: int = C.PRESUMED_CLOSED_DAYS,
) -> DataFrame:
    """went_silent events for cases that have been quiet too long.

    With `users`, only tenants at three in the morning are swept. A case in a stage its tenant
    has no definition for is left alone.
    """
    rows = not_merged(projected).filter(
        F.col("status").isin("live", "dormant") & F.col("last_signal_at").isNotNull()
    )
    if users is not None:
        rows = rows.join(due_users(users, now), "user_id", "left_semi")
    rows = join_defs(rows, stage_defs, "current_stage", {"stale_after_days": "_stale"}).filter(
        F.col("_stale").isNotNull()
    )
    rows = with_gated_dwell(rows, dwell, "current_stage", {"p90_days": "_p90", "n": "_n"})
    quiet = days_exact(F.col("last_signal_at"), now)
    limit = F.greatest(F.col("_stale").cast("double"), F.coalesce(2 * F.col("_p90"), F.lit(0.0)))
    presumed = (quiet > presumed_closed_days) & ~F.col("current_stage").isin(*C.USER_OWES_STAGES)
    swept = ~((F.col("status") == "dormant") & ~presumed) & ~((quiet <= limit) & ~presumed)
    return rows.filter(swept).select(
        *CASE,
        F.lit("went_silent").alias("type"),
        now.alias("occurred_at"),
        F.lit(0.9).alias("confidence"),
        F.floor(quiet).alias("days_quiet"),
        F.when(presumed, "presumed_closed").when(F.col("_n").isNotNull(), "p90x2")
        .otherwise("stale_after_days").alias("threshold_used"),
        presumed.alias("presumed_closed"),
    )


def interview_held_sweep(interviews: DataFrame, now: Column) -> DataFrame:
    """interview_held events two hours after an interview that nobody cancelled."""
    over = F.coalesce("ends_at", plus_hours(F.col("starts_at"), 1)) < plus_hours(now, -2)
    return interviews.filter(
        F.col("held").isNull() & F.col("cancelled_at").isNull() & over
    ).select(
        *CASE,
        F.lit("interview_held").alias("type"),
        F.coalesce("ends_at", "starts_at").alias("occurred_at"),
        F.lit(0.95).alias("confidence"),
        "interview_id",
    )


def park_and_retry(ledger: DataFrame, max_attempts: int = C.PARK_MAX_ATTEMPTS):
    """Parked messages: (to queue again, to ask about, the ledger afterwards)."""
    parked = F.coalesce(F.col("outcome") == "parked", F.lit(False))
    again = parked & (F.col("park_attempts") < max_attempts)
    requeue = ledger.filter(again).select(
        "mailbox_id", "provider_message_id", "user_id", F.lit(True).alias("replay")
    )
    ask = ledger.filter(parked & ~again).select(
        "user_id",
        F.lit("low_confidence").alias("kind"),
        F.col("provider_message_id").alias("evidence_ref"),
        F.lit(T.PARKED_QUESTION).alias("excerpt"),
    )
    after = ledger.withColumn(
        "_out", F.when(again, F.lit(None)).when(parked, "review").otherwise(F.col("outcome"))
    ).withColumn("park_attempts", F.col("park_attempts") + F.when(again, 1).otherwise(0))
    after = after.withColumn("outcome", F.col("_out")).drop("_out")
    return requeue, ask, after


def retention_sweep(bodies: DataFrame, reviews: DataFrame, now: Column, days: int):
    """(debug bodies kept, reviews with answered excerpts removed)."""
    if days > C.RETENTION_MAX_DAYS:
        raise ValueError(f"retention is capped at {C.RETENTION_MAX_DAYS} days, got {days}")
    kept = bodies.filter(F.col("stored_at") >= minus_days(now, days))
    cleared = reviews.withColumn(
        "excerpt", F.when(F.col("resolved_at").isNull(), F.col("excerpt"))
    )
    return kept, cleared


def erase_users(tables: dict[str, DataFrame], erased: DataFrame) -> dict[str, DataFrame]:
    """Every table without a row of the given tenants."""
    gone = erased.select("user_id").distinct()
    return {name: df.join(gone, "user_id", "left_anti") for name, df in tables.items()}


def dead_letters(failed: DataFrame, attempts: int = C.DEAD_LETTER_ATTEMPTS):
    """(to retry, dead letters without any message text).

    `failed`: queue, msg_id, read_count, body (JSON text).
    """
    dead = F.col("read_count") >= attempts
    texts = r'("(?:text|body|html|snippet|excerpt)"\s*:\s*)"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    stripped = F.regexp_replace("body", texts, '$1"[stripped]"')
    return failed.filter(~dead), failed.filter(dead).select(
        F.concat("queue", F.lit("_dlq")).alias("queue"), "msg_id", stripped.alias("body")
    )


# --- health ------------------------------------------------------------------------


def queue_stats(pending: DataFrame, now: Column) -> DataFrame:
    """Length and ages in seconds of each queue."""
    age = lambda c: F.coalesce(
        F.round((F.unix_micros(now) - F.unix_micros(c)) / 1e6).cast("bigint"), F.lit(0)
    )
    return pending.groupBy("queue").agg(
        F.count("*").alias("length"),
        age(F.min("enqueued_at")).alias("oldest_sec"),
        age(F.max("enqueued_at")).alias("newest_sec"),
    )


def gauges(pending: DataFrame, reviews: DataFrame, mailboxes: DataFrame, now: Column) -> DataFrame:
    """Metric lines in text form: (ord, line)."""
    is_dead = F.col("queue").endswith("_dlq")
    depth = pending.filter(~is_dead).groupBy("queue").agg(F.count("*").alias("n"))
    known = depth.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(q) for q in C.QUEUES])).alias("at", "queue")
    )
    depths = known.join(depth, "queue", "left").select(
        (F.lit(10) + F.col("at")).alias("ord"),
        F.format_string('queue_depth{queue="%s"} %d', F.col("queue"), F.coalesce("n", F.lit(0)))
        .alias("line"),
    )
    dead = pending.agg(F.count_if(is_dead).alias("n")).select(
        F.lit(20).alias("ord"), F.format_string("dead_letters %d", "n").alias("line")
    )
    review = reviews.agg(F.count_if(F.col("resolved_at").isNull()).alias("n")).select(
        F.lit(30).alias("ord"), F.format_string("review_items_open %d", "n").alias("line")
    )
    fresh = (
        mailboxes.agg(F.max("last_ok_at").alias("at"))
        .filter(F.col("at").isNotNull())
        .select(
            F.lit(40).alias("ord"),
            F.format_string(
                "mailbox_freshness_seconds %.1f",
                (F.unix_micros(now) - F.unix_micros(F.col("at"))) / 1e6,
            ).alias("line"),
        )
    )
    help_ = (
        (9, "queue_depth", T.GAUGE_QUEUES),
        (19, "dead_letters", T.GAUGE_DEAD),
        (29, "review_items_open", T.GAUGE_REVIEWS),
        (39, "mailbox_freshness_seconds", T.GAUGE_FRESHNESS),
    )
    heads = known.sparkSession.range(1).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(o).alias("ord"),
                        F.lit(f"# HELP {n} {t}\n# TYPE {n} gauge").alias("line"),
                    )
                    for o, n, t in help_
                ]
            )
        ).alias("h")
    ).select("h.ord", "h.line")
    return heads.unionByName(depths).unionByName(dead).unionByName(review).unionByName(fresh)


def mailbox_health(
    mailboxes: DataFrame, ledger: DataFrame, users: DataFrame, now: Column
) -> DataFrame:
    """Freshness, backlog and state per tenant. One unread mailbox makes freshness unknown."""
    per_user = mailboxes.groupBy("user_id").agg(
        F.min("last_ok_at").alias("_worst"),
        F.count_if(F.col("last_ok_at").isNull()).alias("_never"),
        F.sum("backlog_estimate").alias("_backlog"),
        F.bool_or(F.col("status") == "ok").alias("_ok"),
        F.bool_and(F.col("status") == "needs_reauth").alias("_revoked"),
    )
    tz = F.coalesce("tz", F.lit("UTC"))
    zones = users.select("user_id", "tz")
    start = F.to_utc_timestamp(F.date_trunc("day", local(now, tz)), tz)
    placed = (
        ledger.filter(F.col("outcome") == "placed")
        .join(zones, "user_id")
        .filter(F.col("processed_at") > start)
        .groupBy("user_id")
        .agg(F.count("*").alias("placed_today"))
    )
    worst = F.when(F.col("_never") == 0, F.col("_worst"))
    minutes = F.greatest(
        F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(worst)) / 60e6)
    ).cast("bigint")
    backlog = F.coalesce("_backlog", F.lit(0))
    return (
        zones.join(per_user, "user_id", "left")
        .join(placed, "user_id", "left")
        .select(
            "user_id",
            F.coalesce("_ok", F.lit(False)).alias("connected"),
            iso_z(worst).alias("last_ok_at"),
            F.when(worst.isNotNull(), minutes).alias("minutes_since_read"),
            F.coalesce("placed_today", F.lit(0)).alias("placed_today"),
            backlog.alias("backlog"),
            F.when(F.coalesce("_revoked", F.lit(False)), "F1").when(backlog > 0, "F2")
            .otherwise("ok").alias("state"),
        )
    )
