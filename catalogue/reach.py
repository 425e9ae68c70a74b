"""Reach, dwell, joins and activity."""

from pyspark.sql import functions as F

from caseledger.operators import activity as act_ops
from caseledger.operators import reach as ops
from caseledger.operators import skew

from .base import NOW, Registry, iso, rounded, ziso

REGISTRY = Registry()
add = REGISTRY.add


@add("a04_phase_reach", f"""SELECT user_id, case_id, company_id, status, current_phase, reached_interview,
  reached_offer, event_count, {ziso('applied_at')} AS applied_at, {ziso('created_at')} AS created_at,
  {ziso('first_human_at')} AS first_human_at, {ziso('last_event_at')} AS last_event_at FROM reach_""", uses="reach_")
def a04(t):
    out = t.reach.drop("reached_acknowledged", "reached_screening")
    return iso(out, "applied_at", "created_at", "first_human_at", "last_event_at")


@add("a05_stage_dwell", """SELECT user_id, from_stage, to_stage, round(quantile_cont(days, 0.5), 6) AS p50_days,
  round(quantile_cont(days, 0.75), 6) AS p75_days, round(quantile_cont(days, 0.9), 6) AS p90_days, count(*) AS n
  FROM moves WHERE to_stage IS NOT NULL GROUP BY user_id, from_stage, to_stage""", uses="moves")
def a05(t):
    return rounded(ops.stage_dwell(t.log), "p50_days", "p75_days", "p90_days")


@add("a06_stage_dwell_in", """SELECT user_id, stage, round(p50_days, 6) AS p50_days, round(p75_days, 6) AS p75_days,
  round(p90_days, 6) AS p90_days, n FROM dwell_in""", uses="dwell_in")
def a06(t):
    return rounded(t.dwell, "p50_days", "p75_days", "p90_days")


@add("a06_dwell_of_parts", """SELECT l_partkey % 50 AS part_group, round(quantile_cont(d, 0.5), 6) AS p50,
  round(quantile_cont(d, 0.9), 6) AS p90, count(*) AS n FROM (
    SELECT l_partkey, epoch(l_shipdate - o_orderdate) / 86400 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x
  GROUP BY ALL""")
def a06_volume(t):
    """Days from order to shipment, exact percentiles on the largest table."""
    from caseledger.functions.clock import days_exact

    days = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_partkey") % 50).alias("part_group"),
        days_exact(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")).alias("d"),
    )
    out = skew.exact_percentiles(days, ["part_group"], "d", {"p50": 0.5, "p90": 0.9})
    return rounded(out, "p50", "p90")


@add("j01_events_cases_companies", f"""SELECT e.seq, e.case_id, c.canonical_name AS company, e.type, a.status FROM ev e
  JOIN projected a ON a.user_id = e.user_id AND a.case_id = e.case_id JOIN companies_ c ON c.company_id = a.company_id""",
     uses="ev projected companies_")
def j01(t):
    return t.log.select("user_id", "case_id", "seq", "type").join(
        t.projected.select("user_id", "case_id", "company_id", "status"), ["user_id", "case_id"]
    ).join(t.companies, "company_id").select("seq", "case_id", F.col("canonical_name").alias("company"), "type", "status")


@add("j02_left_outer_counts", """SELECT user_id, case_id, event_count FROM reach_ WHERE true
  UNION ALL SELECT user_id, -1, 0 FROM users_""", uses="reach_ users_")
def j02(t):
    """Cases without events stay in the denominator."""
    empty = t.users.select(
        "user_id", F.lit(-1).cast("bigint").alias("case_id"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in t.projected.schema if f.name not in ("user_id", "case_id")],
    )
    return ops.phase_reach(t.projected.unionByName(empty), t.log, t.stage_defs).select(
        "user_id", "case_id", "event_count"
    )


@add("j03_gated_dwell_join", """SELECT a.user_id, a.case_id, a.current_stage, round(d.p90_days, 6) AS p90_days
  FROM projected a LEFT JOIN dwell_in d ON d.user_id = a.user_id AND d.stage = a.current_stage AND d.n >= 5""",
     uses="projected dwell_in")
def j03(t):
    out = act_ops.with_gated_dwell(t.projected, t.dwell, "current_stage", {"p90_days": "p90_days"})
    return rounded(out.select("user_id", "case_id", "current_stage", "p90_days"), "p90_days")


@add("j04_first_of_each", f"""SELECT a.user_id, a.case_id, s.channel, {ziso('d.due_at')} AS due_at,
  CAST(o.decide_by AS VARCHAR) AS decide_by, {ziso('i.starts_at')} AS next_interview_at
  FROM cases_ a
  LEFT JOIN (SELECT user_id, case_id, arg_min(channel, (NOT is_first_touch, first_seen_at, source_id)) AS channel FROM sources_ GROUP BY ALL) s USING (user_id, case_id)
  LEFT JOIN (SELECT user_id, case_id, min(due_at) AS due_at FROM deadlines_ GROUP BY ALL) d USING (user_id, case_id)
  LEFT JOIN (SELECT user_id, case_id, arg_max(decide_by, (created_at, offer_id)) AS decide_by FROM offers_ WHERE decide_by IS NOT NULL GROUP BY ALL) o USING (user_id, case_id)
  LEFT JOIN (SELECT user_id, case_id, min(starts_at) AS starts_at FROM interviews_ WHERE cancelled_at IS NULL AND starts_at > TIMESTAMP '{NOW}' GROUP BY ALL) i USING (user_id, case_id)""",
     uses="cases_ sources_ deadlines_ offers_ interviews_")
def j04(t):
    from caseledger.plans.board import side_facts

    out = side_facts(t.cases, t.sources, t.deadlines, t.offers).join(
        act_ops.next_interviews(t.interviews, t.now), ["user_id", "case_id"], "left"
    ).select(
        "user_id", "case_id", "channel", F.col("deadline_at").alias("due_at"),
        F.col("decide_by").cast("string").alias("decide_by"), "next_interview_at",
    )
    return iso(out, "due_at", "next_interview_at")


@add("j06_semi_acknowledged", """SELECT user_id, case_id FROM projected p WHERE merged_into_id IS NULL AND EXISTS
  (SELECT 1 FROM ev e WHERE e.case_id = p.case_id AND e.user_id = p.user_id AND e.type = 'acknowledged')""",
     uses="projected ev")
def j06(t):
    return ops.acknowledged_cases(t.projected, t.log).select("user_id", "case_id")


@add("x23_activity", f"""SELECT user_id, case_id, activity, stale_after_days, depth, round(p90_days, 6) AS p90_days,
  {ziso('next_interview_at')} AS next_interview_at FROM act""", uses="act")
def x23(t):
    out = t.active.select(
        "user_id", "case_id", "activity", "stale_after_days", "depth", "p90_days", "next_interview_at"
    )
    return iso(rounded(out, "p90_days"), "next_interview_at")


@add("x24_stage_lookups", """SELECT e.seq, coalesce(s.phase, 'sent') AS phase, coalesce(s.depth, 0) AS depth,
  coalesce(s.label, e.to_stage) AS label, coalesce(s.stale_after_days, 21) AS stale
  FROM ev e LEFT JOIN stages_ s ON s.user_id = e.user_id AND s.key = e.to_stage WHERE e.to_stage IS NOT NULL""",
     uses="ev stages_")
def x24(t):
    from caseledger.operators.stages import with_stage

    out = with_stage(
        t.log.filter("to_stage IS NOT NULL").select("user_id", "seq", "to_stage"), t.stage_defs, "to_stage",
        {"phase": "phase", "depth": "depth", "label": "label", "stale_after_days": "stale"},
    )
    return out.select("seq", "phase", "depth", "label", "stale")


@add("f01_period_90d", f"""SELECT user_id, case_id FROM projected
  WHERE coalesce(applied_at, created_at) > TIMESTAMP '{NOW}' - INTERVAL 90 DAYS""", uses="projected")
def f01(t):
    return ops.period_window(t.projected, t.now, "90d").select("user_id", "case_id")


@add("f01_period_12m", f"""SELECT user_id, case_id FROM projected
  WHERE coalesce(applied_at, created_at) > TIMESTAMP '{NOW}' - INTERVAL 12 MONTHS""", uses="projected")
def f01_default(t):
    return ops.period_window(t.projected, t.now, "no such period").select("user_id", "case_id")


@add("f03_board_filter", """SELECT user_id, case_id, activity FROM act WHERE current_phase = 'sent' AND status = 'live'
  AND activity IN ('active', 'stale')""", uses="act")
def f03(t):
    from caseledger.plans.board import board_filter

    return board_filter(t.active, phase="sent", status="live", activity="nonsense").select(
        "user_id", "case_id", "activity"
    )
