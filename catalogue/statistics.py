"""The sections of the statistics report."""

from pyspark.sql import functions as F

from caseledger.functions import metrics as M
from caseledger.plans import statistics as ops

from .base import NOW, Registry, rounded

REGISTRY = Registry()
add = REGISTRY.add

_12M = f"coalesce(applied_at, created_at) > TIMESTAMP '{NOW}' - INTERVAL 12 MONTHS"
_90D = f"coalesce(applied_at, created_at) > TIMESTAMP '{NOW}' - INTERVAL 90 DAYS"
_COHORT = f"""(SELECT r.*, a.activity,
    coalesce(a.activity <> 'closed' AND NOT reached_interview AND r.applied_at > TIMESTAMP '{NOW}' - INTERVAL 21 DAYS, false) AS immature
  FROM reach_ r JOIN (SELECT user_id, case_id, activity FROM act) a USING (user_id, case_id) WHERE {{window}})"""
_PCT = "CASE WHEN {v} IS NULL THEN '—' ELSE concat(regexp_replace(printf('%.1f', {v} * 100), '\\.0$', ''), '%') END"


def _ratio_sql(num, den, excluded, window, reason=""):
    extra = f", CASE WHEN x > 0 THEN concat(x, ' {reason}') END" if reason else ""
    return f"""SELECT user_id, n AS numerator, d AS denominator, x AS excluded, c >= 8 AS gate_met,
      c >= 8 AND c <= 15 AS small_sample, round(v, 6) AS value, {_PCT.format(v='v')} AS display,
      CASE WHEN c < 8 THEN concat(c, ' closed · unlocks at 8 closed applications')
        ELSE concat_ws(' · ', concat(n, ' of ', d){extra}, CASE WHEN c <= 15 THEN 'small sample' END) END AS note
      FROM (SELECT *, CASE WHEN c >= 8 AND d <> 0 THEN n / d END AS v FROM (
        SELECT user_id, {num} AS n, {den} AS d, {excluded} AS x,
        count(*) FILTER (activity = 'closed') AS c FROM {_COHORT.format(window=window)} q GROUP BY user_id) z) y"""


def _cohort(t, period):
    return ops.tenant_counts(ops.cohort(t.reach, t.active, t.now, period), t.now)


def _funnel_sql(window):
    base = f"FROM projected p WHERE merged_into_id IS NULL AND {window}"
    screening = """EXISTS (SELECT 1 FROM ev e JOIN stage_defs_ sd ON sd.user_id = p.user_id AND sd.key = e.to_stage
      WHERE e.case_id = p.case_id AND sd.phase IN ('screening', 'interviewing', 'decided'))"""
    return f"""SELECT f.user_id, ord, label, n, CASE WHEN top > 0 THEN CAST(round_even(n / top * 100, 0) AS BIGINT) ELSE 0 END AS width
      FROM (
      SELECT user_id, 1 AS ord, 'Applied' AS label, count(*) AS n {base} GROUP BY user_id
      UNION ALL SELECT user_id, 2, 'Acknowledged', count(*) FILTER (EXISTS (SELECT 1 FROM ev e WHERE e.case_id = p.case_id AND e.type = 'acknowledged')) {base} GROUP BY user_id
      UNION ALL SELECT user_id, 3, 'Screening', count(*) FILTER ({screening}) {base} GROUP BY user_id
      UNION ALL SELECT user_id, 4, 'Interviewing', count(*) FILTER (case_id IN (SELECT case_id FROM reach_ WHERE reached_interview)) {base} GROUP BY user_id
      UNION ALL SELECT user_id, 5, 'Offer', count(*) FILTER (case_id IN (SELECT case_id FROM reach_ WHERE reached_offer)) {base} GROUP BY user_id
      ) f JOIN (SELECT user_id, count(*) AS top {base} GROUP BY user_id) g USING (user_id)"""


@add("a07_funnel", _funnel_sql(_12M), uses="projected ev stage_defs_ reach_")
def a07(t):
    return ops.funnel(t.reach, t.now)


@add("a07_funnel_90d", _funnel_sql(_90D), uses="projected ev stage_defs_ reach_")
def a07_90(t):
    return ops.funnel(t.reach, t.now, "90d")


@add("u01_labelled_counts", _funnel_sql("true"), uses="projected ev stage_defs_ reach_")
def u01(t):
    return ops.funnel(t.reach, t.now, "all")


@add("a08_conversion", _ratio_sql("count(*) FILTER (reached_interview AND NOT immature)", "count(*) FILTER (NOT immature)",
     "count(*) FILTER (immature)", _12M, "too recent to count"), uses="reach_ act")
def a08(t):
    return rounded(ops.conversion(_cohort(t, "12m")), "value")


@add("a09_offer_rate", _ratio_sql("count(*) FILTER (reached_offer)",
     "count(*) FILTER (reached_interview AND activity = 'closed')", "CAST(0 AS BIGINT)", _12M), uses="reach_ act")
def a09(t):
    return rounded(ops.offer_rate(_cohort(t, "12m")), "value")


@add("a11_ghost_rate", _ratio_sql("count(*) FILTER (activity = 'closed' AND status IN ('live', 'dormant'))",
     "count(*) FILTER (activity = 'closed')", "CAST(0 AS BIGINT)", "true"), uses="reach_ act")
def a11(t):
    return rounded(ops.ghost_rate(_cohort(t, "all")), "value")


@add("a10_first_response", f"""SELECT user_id, round(quantile_cont(d, 0.5), 6) AS median_days, count(d) AS n,
  CASE WHEN median_days IS NULL THEN '—' ELSE concat(regexp_replace(printf('%.1f', round_even(quantile_cont(d, 0.5) * 10, 0) / 10), '\\.0$', ''),
    CASE WHEN round_even(quantile_cont(d, 0.5) * 10, 0) = 10 THEN ' day' ELSE ' days' END) END AS display
  FROM (SELECT user_id, epoch(first_human_at - applied_at) / 86400 AS d FROM reach_ WHERE applied_at IS NOT NULL AND {_12M}) x
  GROUP BY user_id""", uses="reach_")
def a10(t):
    return rounded(ops.first_response(t.reach, t.now), "median_days")


@add("a12_channels", f"""SELECT user_id, channel, sent, interviews, offers, ghosted, sent >= 3 AS gate_met,
  CASE WHEN sent >= 3 THEN '' ELSE concat(sent, ' of 3 needed') END AS note,
  round(i, 6) AS iv_value, round(o, 6) AS of_value, round(g, 6) AS ghost_value,
  {_PCT.format(v='i')} AS iv, {_PCT.format(v='o')} AS of, {_PCT.format(v='g')} AS ghost FROM (
  SELECT *, CASE WHEN sent >= 3 THEN interviews / sent END AS i, CASE WHEN sent >= 3 THEN offers / sent END AS o,
    CASE WHEN sent >= 3 THEN ghosted / sent END AS g FROM (
  SELECT s.user_id, s.channel, count(*) AS sent, count(*) FILTER (reached_interview) AS interviews,
    count(*) FILTER (reached_offer) AS offers,
    count(*) FILTER (a.activity = 'closed' AND a.status IN ('live', 'dormant')) AS ghosted
  FROM sources_ s JOIN reach_ r USING (user_id, case_id) JOIN act a USING (user_id, case_id)
  WHERE is_first_touch GROUP BY ALL) x) y""", uses="sources_ reach_ act")
def a12(t):
    return rounded(ops.channels(t.sources, t.reach, t.active), "iv_value", "of_value", "ghost_value")


@add("a13_channel_effectiveness", """SELECT s.channel, s.user_id, count(*) AS sent, count(*) FILTER (reached_interview) AS interviews,
  count(*) FILTER (reached_offer) AS offers, count(*) FILTER (r.status = 'dormant') AS ghosted
  FROM sources_ s JOIN reach_ r USING (user_id, case_id) WHERE is_first_touch GROUP BY ALL""", uses="sources_ reach_")
def a13(t):
    return ops.channel_effectiveness(t.sources, t.reach)


@add("a14_by_month", f"""SELECT user_id, strftime(coalesce(applied_at, created_at), '%Y-%m') AS month,
  strftime(any_value(date_trunc('month', coalesce(applied_at, created_at))), '%b %y') AS label,
  count(*) AS applied, count(first_human_at) AS replied, count(*) FILTER (reached_interview) AS interviews,
  count(*) FILTER (reached_offer) AS offers FROM reach_ WHERE {_12M} GROUP BY user_id, month""", uses="reach_")
def a14(t):
    return ops.by_month(t.reach, t.now)


@add("a15_outcomes", f"""SELECT user_id, count(*) FILTER (activity <> 'closed') AS open,
  count(*) FILTER (activity = 'closed' AND status = 'accepted') AS accepted,
  count(*) FILTER (activity = 'closed' AND status = 'rejected') AS rejected,
  count(*) FILTER (activity = 'closed' AND status IN ('live', 'dormant')) AS ghosted,
  count(*) FILTER (activity = 'closed' AND status = 'withdrawn') AS withdrawn
  FROM {_COHORT.format(window=_12M)} q GROUP BY user_id""", uses="reach_ act")
def a15(t):
    return ops.outcomes(_cohort(t, "12m"))


@add("a16_quarters", """SELECT user_id, count(DISTINCT date_trunc('quarter', applied_at)) AS quarters,
  quarters >= 2 AS gate_met, CASE WHEN quarters >= 2 THEN '' ELSE concat('Seasonal averages need ', 2 - quarters,
    ' more quarter', CASE WHEN quarters = 1 THEN '' ELSE 's' END,
    ' of history before they mean anything, so they are hidden rather than shown noisy.') END AS note
  FROM projected WHERE applied_at IS NOT NULL GROUP BY user_id""", uses="projected")
def a16(t):
    return ops.distinct_quarters(t.projected)


_MONEY = """concat(CASE currency WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' WHEN 'USD' THEN '$' WHEN 'JPY' THEN '¥'
  ELSE concat(currency, ' ') END, format('{:,}', CAST(floor(min_minor / 100 + 0.5) AS BIGINT)))"""


@add("a17_compensation", f"""SELECT user_id, offer_id, kind, low, high, dropped, {_MONEY} AS label,
  CAST(round_even((coalesce(nullif(min_minor, 0), low) - low) / greatest(high - low, 1) * 100, 0) AS BIGINT) AS at,
  CAST(round_even((coalesce(nullif(coalesce(nullif(max_minor, 0), min_minor), 0), low) - low) / greatest(high - low, 1) * 100, 0) AS BIGINT) AS to
  FROM offers_ JOIN (SELECT user_id, count(*) FILTER (currency <> 'EUR') AS dropped,
    min(least(min_minor, max_minor)) FILTER (currency = 'EUR') AS low,
    max(greatest(min_minor, max_minor)) FILTER (currency = 'EUR') AS high FROM offers_ GROUP BY user_id) s USING (user_id)
  WHERE currency = 'EUR'""", uses="offers_")
def a17(t):
    return ops.compensation(t.offers, t.users)


@add("x25_time_in_stage", """SELECT d.user_id, d.stage AS key, coalesce(s.label, d.stage) AS stage,
  round_even(p50_days, 1) AS days, n, n >= 5 AS gate_met,
  concat(regexp_replace(printf('%.1f', round_even(p50_days * 10, 0) / 10), '\\.0$', ''),
    CASE WHEN round_even(p50_days * 10, 0) = 10 THEN ' day' ELSE ' days' END) AS display,
  CASE WHEN n >= 5 THEN concat(n, ' transitions') ELSE concat(n, ' of 5 stage changes needed') END AS note
  FROM dwell_in d LEFT JOIN stages_ s ON s.user_id = d.user_id AND s.key = d.stage""", uses="dwell_in stages_")
def x25(t):
    return ops.time_in_stage(t.dwell, t.stage_defs)


@add("x26_formats", f"""SELECT o_orderkey, {_PCT.format(v='share')} AS percent,
  concat(regexp_replace(printf('%.1f', round_even(share * 1000, 0) / 10), '\\.0$', ''),
    CASE WHEN round_even(share * 1000, 0) = 10 THEN ' day' ELSE ' days' END) AS days,
  concat(CASE WHEN cur = 'CHF' THEN concat('CHF', chr(160)) ELSE '€' END, format('{{:,}}', CAST(floor(minor / 100.0::DOUBLE + 0.5) AS BIGINT))) AS money
  FROM (SELECT o_orderkey, (o_orderkey % 64) / 64 AS share, CAST(round(o_totalprice * 100) AS BIGINT) AS minor,
    CASE WHEN o_orderkey % 2 = 0 THEN 'CHF' ELSE 'EUR' END AS cur FROM orders) x""")
def x26(t):
    rows = t.raw("orders").select(
        "o_orderkey", ((F.col("o_orderkey") % 64) / 64).alias("share"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("minor"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'chf' ELSE 'eur' END").alias("cur"),
    )
    return rows.select(
        "o_orderkey", M.format_percent(F.col("share")).alias("percent"),
        M.format_days(F.col("share") * 100).alias("days"),
        M.format_money(F.col("minor"), F.col("cur")).alias("money"),
    )


_RATIO = ("value numerator denominator excluded", "gate_met note small_sample display")
#: The sections of the report: the SQL of each, its item, its numbers and its texts.
_SECTIONS = (
    ("funnel", "a07_funnel", "label", "ord n width", ""),
    ("ratios", "a08_conversion", "'Application → interview'", *_RATIO),
    ("ratios", "a09_offer_rate", "'Interview → offer'", *_RATIO),
    ("first_response", "a10_first_response", "NULL", "median_days n", "display"),
    ("channels", "a12_channels", "channel", "sent interviews offers ghosted iv_value of_value ghost_value", "gate_met note iv of ghost"),
    ("time_in_stage", "x25_time_in_stage", "key", "days n", "stage display gate_met"),
    ("by_month", "a14_by_month", "month", "applied replied interviews offers", "label"),
    ("outcomes", "a15_outcomes", "NULL", "open accepted rejected ghosted withdrawn", ""),
    ("compensation", "a17_compensation", "offer_id", "low high dropped at to", "kind label"),
    ("seasonal", "a16_quarters", "NULL", "quarters", "gate_met note"),
    ("ghost", "", "NULL", *_RATIO),
)
_GHOST_12M = _ratio_sql("count(*) FILTER (activity = 'closed' AND status IN ('live', 'dormant'))",
                        "count(*) FILTER (activity = 'closed')", "CAST(0 AS BIGINT)", _12M)


def _section_sql(section, name, item, numbers, texts):
    cells = [f"{{'measure': '{c}', 'value': round(CAST(\"{c}\" AS DOUBLE), 6), 'text': CAST(NULL AS VARCHAR)}}" for c in numbers.split()]
    cells += [f"{{'measure': '{c}', 'value': CAST(NULL AS DOUBLE), 'text': CAST(\"{c}\" AS VARCHAR)}}" for c in texts.split()]
    return f"""SELECT user_id, '{section}' AS section, item, c.measure AS measure, c.value AS value, c.text AS text FROM (
    SELECT user_id, CAST({item} AS VARCHAR) AS item, unnest([{', '.join(cells)}]) AS c FROM ({REGISTRY.oracles[name] if name else _GHOST_12M}) q) z"""


@add("c10_statistics", " UNION ALL ".join(_section_sql(*s) for s in _SECTIONS), uses="reach_ act")
def c10(t):
    """The whole report for every tenant, every figure and text of every section."""
    report = ops.statistics(
        reach=t.reach, active=t.active, sources=t.sources, dwell=t.dwell, offers=t.offers,
        users=t.users, projected=t.projected, stage_defs=t.stage_defs, now=t.now,
    )
    return rounded(report, "value")
