"""Whether anything is still happening on a case."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.clock import minus_days
from .reach import gated_dwell, not_merged
from .stages import join_defs

CASE = ["user_id", "case_id"]
FILTERS = {
    "open": ("active", "stale"),
    "active": ("active",),
    "stale": ("stale",),
    "closed": ("closed",),
    "all": None,
}


def next_interviews(interviews: DataFrame, now: Column) -> DataFrame:
    """The earliest interview ahead of each case."""
    return (
        interviews.filter(F.col("cancelled_at").isNull() & (F.col("starts_at") > now))
        .groupBy(*CASE)
        .agg(F.min("starts_at").alias("next_interview_at"))
    )


def with_gated_dwell(df: DataFrame, dwell: DataFrame, stage: str, wanted: dict[str, str]) -> DataFrame:
    """Dwell percentiles of the current stage, where the gate is met."""
    d = gated_dwell(dwell).select(
        F.col("user_id").alias("_du"),
        F.col("stage").alias("_ds"),
        *[F.col(c).alias(name) for c, name in wanted.items()],
    )
    return df.join(
        d, (F.col("user_id") == F.col("_du")) & (F.col(stage) == F.col("_ds")), "left"
    ).drop("_du", "_ds")


def activity(now: Column) -> Column:
    """closed, stale or active: the first rule that applies."""
    last = F.col("last_signal_at")
    verdict_days = F.when(F.col("current_phase") == "sent", C.NO_REPLY_CLOSED_DAYS).otherwise(
        C.PRESUMED_CLOSED_DAYS
    )
    stale_days = F.ceil(
        F.greatest(
            F.coalesce("stale_after_days", F.lit(C.UNKNOWN_STALE_DAYS)).cast("double"),
            F.coalesce(2 * F.col("p90_days"), F.lit(0.0)),
        )
    )
    return (
        F.when(F.col("status") != "live", "closed")
        .when(F.col("next_interview_at").isNotNull(), "active")
        .when(F.col("presumed_closed"), "closed")
        .when(F.col("current_stage").isin(*C.USER_OWES_STAGES), "active")
        .when(last.isNull(), "active")
        .when(last < minus_days(now, verdict_days), "closed")
        .when(last < minus_days(now, stale_days), "stale")
        .otherwise("active")
    )


def with_activity(
    projected: DataFrame,
    stage_defs: DataFrame,
    dwell: DataFrame,
    interviews: DataFrame,
    now: Column,
) -> DataFrame:
    """Cases that are not merged away, with their activity and what it was decided from."""
    rows = join_defs(
        not_merged(projected), stage_defs, "current_stage",
        {"stale_after_days": "stale_after_days", "depth": "depth"},
    )
    rows = with_gated_dwell(
        rows, dwell, "current_stage",
        {"p50_days": "p50_days", "p75_days": "p75_days", "p90_days": "p90_days", "n": "dwell_n"},
    )
    rows = rows.join(next_interviews(interviews, now), CASE, "left")
    return rows.withColumn("activity", activity(now))


def ghosted() -> Column:
    """Closed without anybody ever saying no."""
    return (F.col("activity") == "closed") & F.col("status").isin("live", "dormant")


def activity_filter(df: DataFrame, wanted: str | None) -> DataFrame:
    """Keep the rows a filter name admits. An unknown name means open."""
    admitted = FILTERS.get(wanted or "open", FILTERS["open"])
    return df if admitted is None else df.filter(F.col("activity").isin(*admitted))
