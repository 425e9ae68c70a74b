"""The fold, its provenance and the projection."""

from pyspark.sql import functions as F

from caseledger.operators import fold as ops

from .base import Registry, iso, ziso

REGISTRY = Registry()
add = REGISTRY.add

_STATE = """current_stage, current_phase, status, role_title, seniority, location, work_mode"""


@add("f06_confidence_floor", "SELECT user_id, case_id, seq, confidence FROM ev WHERE confidence >= 0.6", uses="ev")
def f06(t):
    return ops.confidence_floor(t.log).select("user_id", "case_id", "seq", "confidence")


@add("a01_fold", f"""SELECT user_id, case_id, {_STATE}, channel, comp_expectation_minor, comp_currency,
  confidence, {ziso('applied_at')} AS applied_at, {ziso('last_signal_at')} AS last_signal_at FROM folded""",
     uses="folded")
def a01(t):
    out = ops.fold(t.log, t.stage_defs).drop("company_id")
    return iso(out, "applied_at", "last_signal_at")


@add("a02_provenance", """SELECT user_id, case_id, 'status' AS field, seq FROM w_status
  UNION ALL SELECT user_id, case_id, 'current_stage', seq FROM w_stage
  UNION ALL SELECT user_id, case_id, 'current_phase', seq FROM w_stage
  UNION ALL SELECT user_id, case_id, 'role_title', seq FROM w_role_title
  UNION ALL SELECT user_id, case_id, 'seniority', seq FROM w_seniority
  UNION ALL SELECT user_id, case_id, 'location', seq FROM w_location
  UNION ALL SELECT user_id, case_id, 'work_mode', seq FROM w_work_mode
  UNION ALL SELECT user_id, case_id, 'channel', seq FROM w_channel
  UNION ALL SELECT user_id, case_id, 'comp_expectation_minor', seq FROM w_comp
  UNION ALL SELECT user_id, case_id, 'frozen_at', seq FROM w_frozen
  UNION ALL SELECT t.user_id, t.case_id, 'applied_at', coalesce(a.seq,
      (SELECT arg_min(seq, occurred_at) FROM ev e WHERE e.case_id = t.case_id AND type = 'applied' AND confidence >= 0.6),
      (SELECT arg_min(seq, occurred_at) FROM ev e WHERE e.case_id = t.case_id AND type = 'acknowledged' AND confidence >= 0.6)) AS s
    FROM w_times t LEFT JOIN w_applied a USING (user_id, case_id) WHERE s IS NOT NULL
  UNION ALL SELECT user_id, case_id, 'last_signal_at', arg_max(seq, occurred_at) FROM ev
    WHERE confidence >= 0.6 AND type NOT IN ('withdrawn', 'accepted', 'went_silent', 'human_corrected', 'note_added')
    GROUP BY ALL""",
     uses="w_status w_stage w_role_title w_seniority w_location w_work_mode w_channel w_comp w_frozen w_times w_applied ev")
def a02(t):
    return ops.fold_provenance(t.log)


@add("a02_ignored_events", "SELECT user_id, case_id, seq FROM ev WHERE confidence < 0.6", uses="ev")
def a02_ignored(t):
    return ops.ignored_events(t.log).select("user_id", "case_id", "seq")


@add("a03_project_cases", f"""SELECT user_id, case_id, company_id, merged_into_id, manually_created, {_STATE},
  awaiting_them, presumed_closed, comp_expectation_minor, comp_currency, confidence, needs_review,
  {ziso('created_at')} AS created_at, {ziso('applied_at')} AS applied_at, {ziso('last_signal_at')} AS last_signal_at,
  {ziso('went_dormant_at')} AS went_dormant_at, {ziso('last_user_action_at')} AS last_user_action_at
  FROM projected""", uses="projected")
def a03(t):
    return iso(t.projected, "created_at", "applied_at", "last_signal_at", "went_dormant_at", "last_user_action_at")


@add("a03_needs_review", """SELECT user_id, case_id, case_id % 5 = 0 AS needs_review FROM projected""", uses="projected")
def a03_reviews(t):
    """Open questions mark their case; answered ones do not."""
    reviews = t.cases.select(
        "user_id", "case_id",
        F.expr("CASE WHEN case_id % 5 <> 0 THEN created_at END").alias("resolved_at"),
    )
    return ops.project_cases(
        t.cases, t.log, t.now, stage_defs=t.stage_defs, reviews=reviews
    ).select("user_id", "case_id", "needs_review")


@add("f02_not_merged", "SELECT user_id, case_id FROM projected WHERE merged_into_id IS NULL", uses="projected")
def f02(t):
    from caseledger.operators.reach import not_merged

    return not_merged(t.projected).select("user_id", "case_id")


@add("t04_late_events_fold", f"""SELECT user_id, case_id, {_STATE}, {ziso('applied_at')} AS applied_at FROM folded""",
     uses="folded")
def t04(t):
    """The fold of a log that arrived newest first, in two appends, with every fifth event twice."""
    from caseledger.operators.log import append_events

    late_first = t.log_with_repeats.filter("seq % 2 = 1").orderBy(F.col("occurred_at").desc())
    whole = append_events(late_first.filter("seq < 1000000000"), t.log_with_repeats)
    out = ops.fold(whole, t.stage_defs).select("user_id", "case_id", *_STATE.split(", "), "applied_at")
    return iso(out, "applied_at")


@add("e03_rebuild_differences", f"""SELECT user_id, case_id, 'rebuilt' AS side, status FROM projected WHERE case_id % 50 = 0
  UNION ALL SELECT user_id, case_id, 'stored', 'stale' FROM projected WHERE case_id % 50 = 0""", uses="projected")
def e03(t):
    """Every fiftieth stored row is wrong; the rebuild finds exactly these."""
    keep = ["user_id", "case_id", "status", "current_stage", "applied_at"]
    rebuilt = t.projected.select(*keep)
    stored = rebuilt.withColumn(
        "status", F.when(F.col("case_id") % 50 == 0, F.lit("stale")).otherwise(F.col("status"))
    )
    return ops.rebuild_differences(stored, rebuilt).select("user_id", "case_id", "side", "status")
