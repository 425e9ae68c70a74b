"""How far each case got, and how long stages last."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.clock import days_exact
from .skew import exact_percentiles, lagged
from .stages import join_defs

CASE = ["user_id", "case_id"]


def not_merged(cases: DataFrame) -> DataFrame:
    return cases.filter(F.col("merged_into_id").isNull())


def tenant(df: DataFrame, user_id) -> DataFrame:
    return df.filter(F.col("user_id") == user_id)


def phase_reach(cases: DataFrame, log: DataFrame, stage_defs: DataFrame) -> DataFrame:
    """One row per case that is not merged away, events or not."""
    staged = join_defs(
        log.select(*CASE, "type", "occurred_at", "to_stage"), stage_defs, "to_stage",
        {"phase": "_phase"},
    )
    t = F.col("type")
    reached = staged.groupBy(*CASE).agg(
        F.bool_or(
            t.isin("interview_scheduled", "interview_held")
            | F.coalesce(F.col("_phase") == "interviewing", F.lit(False))
        ).alias("_interview"),
        F.bool_or(t == "offer_received").alias("_offer"),
        F.bool_or(t == "acknowledged").alias("_ack"),
        F.bool_or(
            F.coalesce(F.col("_phase").isin("screening", "interviewing", "decided"), F.lit(False))
        ).alias("_screening"),
        F.min(F.when(t.isin(*C.HUMAN_REPLY), F.col("occurred_at"))).alias("first_human_at"),
        F.max(F.when(t != "went_silent", F.col("occurred_at"))).alias("last_event_at"),
        F.count("*").alias("_n"),
    )
    no = F.lit(False)
    return (
        not_merged(cases)
        .join(reached, CASE, "left")
        .select(
            *CASE,
            "company_id",
            "applied_at",
            "created_at",
            "status",
            "current_phase",
            F.coalesce("_interview", no).alias("reached_interview"),
            F.coalesce("_offer", no).alias("reached_offer"),
            F.coalesce("_ack", no).alias("reached_acknowledged"),
            F.coalesce("_screening", no).alias("reached_screening"),
            "first_human_at",
            "last_event_at",
            F.coalesce("_n", F.lit(0)).alias("event_count"),
        )
    )


def transitions(log: DataFrame) -> DataFrame:
    """Each stage event beside the one before it in the same case."""
    moves = log.filter(F.col("type").isin(*C.DWELL_TYPES)).select(
        *CASE, "occurred_at", "seq", "to_stage"
    )
    out = lagged(
        moves,
        CASE,
        ["occurred_at", "seq"],
        {"from_stage": "to_stage", "_since": "occurred_at"},
        slice_of=F.date_trunc("day", "occurred_at"),
    )
    return out.filter(F.col("_since").isNotNull()).select(
        "user_id",
        "case_id",
        "seq",
        "from_stage",
        "to_stage",
        days_exact(F.col("_since"), F.col("occurred_at")).alias("days"),
    )


_QUARTILES = {"p50_days": 0.5, "p75_days": 0.75, "p90_days": 0.9}


def stage_dwell(log: DataFrame) -> DataFrame:
    """Days between two stages, per tenant and pair of stages."""
    moved = transitions(log).filter(F.col("to_stage").isNotNull())
    # A missing first stage is a group of its own.
    return exact_percentiles(
        moved.withColumn("_from", F.struct("from_stage")), ["user_id", "_from", "to_stage"],
        "days", _QUARTILES,
    ).select("user_id", "_from.from_stage", "to_stage", *_QUARTILES, "n")


def stage_dwell_in(log: DataFrame) -> DataFrame:
    """Days spent in a stage, per tenant."""
    sat = transitions(log).filter(F.col("from_stage").isNotNull())
    return exact_percentiles(
        sat.withColumnRenamed("from_stage", "stage"), ["user_id", "stage"], "days", _QUARTILES
    ).select("user_id", "stage", *_QUARTILES, "n")


def gated_dwell(dwell: DataFrame) -> DataFrame:
    """Dwell rows with enough observed transitions to be used as a threshold."""
    return dwell.filter(F.col("n") >= C.DWELL_MIN_TRANSITIONS)


def acknowledged_cases(cases: DataFrame, log: DataFrame) -> DataFrame:
    """Cases with at least one acknowledgement (a semi join)."""
    acks = log.filter(F.col("type") == "acknowledged").select(*CASE).distinct()
    return not_merged(cases).join(acks, CASE, "left_semi")


def period_window(df: DataFrame, now: Column, period: str | None) -> DataFrame:
    """Cases that began inside the period. An unknown period is twelve months."""
    began = F.coalesce("applied_at", "created_at")
    if period == "all":
        return df
    if period == "90d":
        return df.filter(began > now - F.expr("INTERVAL 90 DAYS"))
    return df.filter(began > now - F.expr("INTERVAL 12 MONTHS"))
