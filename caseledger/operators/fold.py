"""The fold: the state of every case, decided field by field from its events.

Each field is won by the largest key (tier, time, confidence, tie) among the events that say
something about it. A correction by a person outranks everything for the one field it names,
a terminal event outranks ordinary ones, and events below the confidence floor do not vote.
Once the status is decided by a terminal event, later ordinary events no longer move the stage.

All winners but the frozen stage come from one aggregation with map-side combine, so a case
with very many events sends one row per input partition. Only the stage of cases whose
unrestricted winner lies after the freeze is decided again.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from . import stages as S

CASE = ["user_id", "case_id"]
DESCRIPTIVE = ("role_title", "seniority", "location", "work_mode", "company_id", "channel")
STAGE_TYPES = (
    "applied", "acknowledged", "stage_advanced", "interview_scheduled", "offer_received",
    "offer_negotiated", "human_corrected",
)


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_VOTES = f"confidence >= {C.CONFIDENCE_FLOOR}D"
_TERMINAL = f"type IN ({_names(C.TERMINAL)})"
_INBOUND = f"type IN ({_names(C.INBOUND)})"
_STATUS = f"""CASE WHEN {_TERMINAL} THEN type
    WHEN type = 'went_silent' THEN 'dormant'
    WHEN type = 'human_corrected' AND payload.field = 'status'
      AND payload.`to` IN ({_names(C.STATUSES)}) THEN payload.`to`
    WHEN {_INBOUND} THEN 'live' END"""
_STAGE = """CASE WHEN type IN ('applied', 'acknowledged') THEN type
    WHEN type = 'stage_advanced' THEN coalesce(nullif(to_stage, ''), payload.to_stage)
    WHEN type = 'interview_scheduled' AND coalesce(payload.status, '') <> 'cancelled'
      THEN payload.stage
    WHEN type = 'offer_received' THEN 'offer'
    WHEN type = 'offer_negotiated' THEN 'negotiating'
    WHEN type = 'human_corrected' AND payload.field = 'stage' THEN payload.`to` END"""


def confidence_floor(log: DataFrame) -> DataFrame:
    """Events that may vote."""
    return log.filter(_VOTES)


def _corrected(field: str) -> str:
    return f"CASE WHEN type = 'human_corrected' AND payload.field = '{field}' THEN payload.`to` END"


def _described(field: str) -> str:
    """A non-empty correction, else whatever the payload carries (an empty text counts)."""
    return f"coalesce(nullif({_corrected(field)}, ''), payload.{field})"


def _claim(field: str, value: str) -> Column:
    """What an event says about a field, ordered by who wins. Null when it says nothing."""
    return F.expr(
        f"""CASE WHEN _votes AND ({value}) IS NOT NULL THEN named_struct(
        'tier', CASE WHEN _pinned = '{field}' THEN 3 ELSE _rank END,
        'at', occurred_at,
        'confidence', confidence,
        'tie', _tie,
        'value', {value},
        'seq', seq,
        'type', type) END"""
    )


def _weighed(log: DataFrame) -> DataFrame:
    """Events with what every claim needs, worked out once: the vote, the rank, the pinned field and the tie."""
    pinned = f"type = 'human_corrected' AND confidence >= {C.PINNED_CONFIDENCE}D"
    return log.select(
        "*",
        F.expr(_VOTES).alias("_votes"),
        F.expr(f"CASE WHEN {_TERMINAL} THEN 2 ELSE 1 END").alias("_rank"),
        F.expr(f"CASE WHEN {pinned} THEN payload.field END").alias("_pinned"),
        F.expr("concat(coalesce(evidence_ref, ''), ' ', type)").alias("_tie"),
    )


def _claims(log: DataFrame) -> DataFrame:
    """What each event says, one column per decision. Most of them are null in any row."""
    authored = f"type IN ({_names(C.HUMAN_AUTHORED)}) OR coalesce(rung = {C.HUMAN_RUNG}, false)"
    when = "named_struct('at', occurred_at, 'seq', seq)"
    applied = f"try_cast({_corrected('applied_at')} AS TIMESTAMP)"
    return _weighed(log).select(
        *CASE,
        "_votes",
        _claim("status", _STATUS).alias("_status"),
        _claim("stage", _STAGE).alias("_stage"),
        *[_claim(f, _described(f)).alias(f"_{f}") for f in DESCRIPTIVE],
        _claim("comp_expectation", _corrected("comp_expectation")).alias("_comp"),
        _claim("applied_at", applied).alias("_applied_fix"),
        F.expr(f"CASE WHEN _votes AND type = 'applied' THEN {when} END").alias("_first_applied"),
        F.expr(f"CASE WHEN _votes AND type = 'acknowledged' THEN {when} END").alias("_first_ack"),
        F.expr(
            f"""CASE WHEN _votes AND {_INBOUND}
            THEN named_struct('at', occurred_at, 'earliest', -seq, 'seq', seq) END"""
        ).alias("_last_signal"),
        # Kept whether or not the event may vote.
        F.expr(
            """CASE WHEN type = 'went_silent' THEN named_struct('at', occurred_at, 'seq', seq,
            'closed', coalesce(payload.presumed_closed, false)) END"""
        ).alias("_silent"),
        F.expr(f"CASE WHEN {authored} THEN occurred_at END").alias("last_user_action_at"),
    )


def _winners(log: DataFrame) -> DataFrame:
    latest = ["_status", "_stage", *[f"_{f}" for f in DESCRIPTIVE], "_comp", "_applied_fix",
              "_last_signal", "_silent", "last_user_action_at"]
    earliest = ["_first_applied", "_first_ack"]
    return _claims(log).groupBy(*CASE).agg(
        F.count("*").alias("event_count"),
        F.count_if("_votes").alias("voting_count"),
        *[F.max(c).alias(c) for c in latest],
        *[F.min(c).alias(c) for c in earliest],
    )


def _ordinary_key(claim: Column) -> Column:
    return F.struct(claim["at"], claim["confidence"], claim["tie"])


def _decided(log: DataFrame) -> DataFrame:
    """Winners per case, with the stage held back by the freeze."""
    won = _winners(log)
    status, stage = F.col("_status"), F.col("_stage")
    frozen = F.when(status["type"].isin(*C.TERMINAL), status)
    won = won.withColumn("_frozen", frozen)
    late = won.filter(
        F.col("_frozen").isNotNull()
        & (stage["tier"] < 3)
        & (_ordinary_key(stage) > _ordinary_key(F.col("_frozen")))
    ).select(
        *CASE,
        _ordinary_key(F.col("_frozen")).alias("_limit"),
    )
    # Spark splits the events of a hot case here: one limit per case meets them.
    claims = _weighed(log.filter(F.col("type").isin(*STAGE_TYPES))).select(*CASE, _claim("stage", _STAGE).alias("_claim"))
    held_back = (
        claims.join(late, CASE)
        .filter((F.col("_claim.tier") == 3) | (_ordinary_key(F.col("_claim")) <= F.col("_limit")))
        .groupBy(*CASE)
        .agg(F.max("_claim").alias("_earlier"))
    )
    is_late = (
        F.col("_frozen").isNotNull()
        & (stage["tier"] < 3)
        & (_ordinary_key(stage) > _ordinary_key(F.col("_frozen")))
    )
    return (
        won.join(held_back, CASE, "left")
        .withColumn("_stage", F.when(is_late, F.col("_earlier")).otherwise(stage))
        .drop("_earlier")
    )


def _state_columns() -> list[Column]:
    comp = F.col("_comp.value")
    minor = F.get_json_object(comp, "$.minor")
    currency = F.get_json_object(comp, "$.currency")
    return [
        *CASE,
        F.coalesce(F.col("_stage.value"), F.lit("applied")).alias("current_stage"),
        F.coalesce(F.col("_status.value"), F.lit("live")).alias("status"),
        F.coalesce("_applied_fix.value", "_first_applied.at", "_first_ack.at").alias("applied_at"),
        F.col("_last_signal.at").alias("last_signal_at"),
        *[F.col(f"_{f}.value").alias(f) for f in DESCRIPTIVE],
        F.when(minor.rlike("^-?[0-9]+$"), minor.cast("bigint")).alias("comp_expectation_minor"),
        F.upper(currency).alias("comp_currency"),
        F.coalesce(F.col("_stage.confidence"), F.lit(0.0)).alias("confidence"),
    ]


def fold(log: DataFrame, stage_defs: DataFrame | None = None) -> DataFrame:
    """One row of state per case that has events."""
    states = _decided(log).select(*_state_columns())
    return S.with_stage(states, stage_defs, "current_stage", {"phase": "current_phase"})


def fold_provenance(log: DataFrame) -> DataFrame:
    """Which event decided each field: (user_id, case_id, field, seq).

    `frozen_at` names the terminal event that stopped the stage.
    """
    won = _decided(log)
    applied = F.coalesce("_applied_fix.seq", "_first_applied.seq", "_first_ack.seq")
    parts = {
        "status": F.col("_status.seq"),
        "current_stage": F.col("_stage.seq"),
        "current_phase": F.col("_stage.seq"),
        **{f: F.col(f"_{f}.seq") for f in DESCRIPTIVE},
        "comp_expectation_minor": F.col("_comp.seq"),
        "applied_at": applied,
        "last_signal_at": F.col("_last_signal.seq"),
        "frozen_at": F.col("_frozen.seq"),
    }
    rows = F.explode(
        F.array(*[F.struct(F.lit(k).alias("field"), v.alias("seq")) for k, v in parts.items()])
    )
    return (
        won.select(*CASE, rows.alias("_r"))
        .select(*CASE, "_r.field", "_r.seq")
        .filter(F.col("seq").isNotNull())
    )


def ignored_events(log: DataFrame) -> DataFrame:
    """Events that stay in the log but do not vote."""
    return log.filter(f"NOT ({_VOTES})")


def project_cases(
    cases: DataFrame,
    log: DataFrame,
    now: Column,
    *,
    stage_defs: DataFrame | None = None,
    deadlines: DataFrame | None = None,
    reviews: DataFrame | None = None,
) -> DataFrame:
    """The full projection row of every case. A case without events keeps what it has."""
    won = _decided(log)
    dormant = F.coalesce(F.col("_status.value"), F.lit("live")) == "dormant"
    states = won.select(
        *_state_columns(),
        "last_user_action_at",
        F.when(dormant, F.col("_silent.at")).alias("went_dormant_at"),
        F.coalesce(dormant & F.col("_silent.closed"), F.lit(False)).alias("presumed_closed"),
    )
    states = S.with_stage(states, stage_defs, "current_stage", {"phase": "current_phase"})
    folded = states.select(
        *CASE,
        *[F.col(c).alias(f"_f_{c}") for c in states.columns if c not in CASE],
        F.lit(True).alias("_has_events"),
    )
    out = cases.join(folded, CASE, "left")
    if deadlines is not None:
        due = (
            deadlines.filter(F.col("met_at").isNull() & (F.col("due_at") > now))
            .select(*CASE).distinct().withColumn("_owes", F.lit(True))
        )
        out = out.join(due, CASE, "left")
    else:
        out = out.withColumn("_owes", F.lit(None).cast("boolean"))
    if reviews is not None:
        asked = (
            reviews.filter(F.col("resolved_at").isNull() & F.col("case_id").isNotNull())
            .select(*CASE).distinct().withColumn("_asked", F.lit(True))
        )
        out = out.join(asked, CASE, "left")
    else:
        out = out.withColumn("_asked", F.lit(None).cast("boolean"))
    status = F.coalesce("_f_status", F.lit("live"))
    stage = F.coalesce("_f_current_stage", F.lit("applied"))
    waits = (status == "live") & ~stage.isin(*C.USER_OWES_STAGES) & F.col("_owes").isNull()
    return out.select(
        *CASE,
        "company_id",
        "created_at",
        "manually_created",
        "merged_into_id",
        stage.alias("current_stage"),
        F.coalesce("_f_current_phase", F.lit("sent")).alias("current_phase"),
        status.alias("status"),
        F.col("_f_applied_at").alias("applied_at"),
        F.col("_f_last_signal_at").alias("last_signal_at"),
        F.col("_f_went_dormant_at").alias("went_dormant_at"),
        F.col("_f_last_user_action_at").alias("last_user_action_at"),
        F.when(F.col("_has_events"), waits).otherwise(F.lit(True)).alias("awaiting_them"),
        F.coalesce("_f_presumed_closed", F.lit(False)).alias("presumed_closed"),
        F.coalesce("_f_role_title", "role_title").alias("role_title"),
        F.coalesce("_f_seniority", "seniority").alias("seniority"),
        F.coalesce("_f_location", "location").alias("location"),
        F.coalesce("_f_work_mode", "work_mode").alias("work_mode"),
        F.col("_f_comp_expectation_minor").alias("comp_expectation_minor"),
        F.col("_f_comp_currency").alias("comp_currency"),
        F.coalesce("_f_confidence", F.lit(1.0)).alias("confidence"),
        (F.col("_has_events").isNotNull() & F.col("_asked").isNotNull()).alias("needs_review"),
    )


def rebuild_differences(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows that a rebuild would change, from both sides."""
    columns = stored.columns
    lost = stored.exceptAll(rebuilt.select(*columns)).withColumn("side", F.lit("stored"))
    gained = rebuilt.select(*columns).exceptAll(stored).withColumn("side", F.lit("rebuilt"))
    return lost.unionByName(gained)
