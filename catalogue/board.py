"""Board, lookups, case detail and the first screen."""

from pyspark.sql import functions as F

from caseledger.functions import display as D
from caseledger.plans import board as ops

from .base import NOW, Registry, iso, ziso
from .shapes import Tables, cte

REGISTRY = Registry()
add = REGISTRY.add

cte("board_", f"""SELECT *, CASE WHEN flag_kind = 'deadline' THEN concat('Due ', strftime(timezone(tz, timezone('UTC', deadline_at)), '%A %H:%M'))
    WHEN flag_kind = 'decide' THEN concat('decide by ', strftime(timezone(tz, timezone('UTC', decide_by::TIMESTAMP)), '%-d %b'))
    WHEN flag_kind = 'quiet' THEN 'quiet · past your p90' ELSE '' END AS flag
  FROM (SELECT *, CASE WHEN status IN ('rejected', 'withdrawn', 'accepted') THEN 'none'
    WHEN deadline_at > TIMESTAMP '{NOW}' AND deadline_at <= TIMESTAMP '{NOW}' + INTERVAL 7 DAYS THEN 'deadline'
    WHEN decide_by::TIMESTAMP > TIMESTAMP '{NOW}' THEN 'decide'
    WHEN status = 'dormant' OR days_quiet > coalesce(2 * p90_days, stale_after_days) THEN 'quiet' ELSE 'none' END AS flag_kind
  FROM (SELECT a.user_id, a.case_id, c.canonical_name AS company, a.role_title AS role, a.current_stage AS stage,
    CASE a.status WHEN 'rejected' THEN 'Rejected' WHEN 'withdrawn' THEN 'Withdrawn' WHEN 'accepted' THEN 'Accepted'
      WHEN 'dormant' THEN CASE WHEN a.presumed_closed THEN 'Closed by silence' ELSE 'Dormant' END
      ELSE coalesce(sg.label, a.current_stage) END AS display_stage,
    a.current_phase AS phase, a.status, s.channel, a.applied_at, a.last_signal_at,
    CASE WHEN a.last_signal_at IS NOT NULL THEN CAST(greatest(0, floor(epoch(TIMESTAMP '{NOW}' - a.last_signal_at) / 86400)) AS BIGINT) END AS days_quiet,
    a.status <> 'live' AS closed, a.activity, a.next_interview_at, a.needs_review, a.confidence,
    a.depth, a.location, a.work_mode, a.p90_days, a.stale_after_days, d.due_at AS deadline_at, o.decide_by, u.tz
  FROM act a JOIN companies_ c USING (company_id) JOIN users_ u USING (user_id)
  LEFT JOIN stages_ sg ON sg.user_id = a.user_id AND sg.key = a.current_stage
  LEFT JOIN (SELECT user_id, case_id, arg_min(channel, (NOT is_first_touch, first_seen_at, source_id)) AS channel FROM sources_ GROUP BY ALL) s ON s.case_id = a.case_id AND s.user_id = a.user_id
  LEFT JOIN (SELECT user_id, case_id, min(due_at) AS due_at FROM deadlines_ GROUP BY ALL) d ON d.case_id = a.case_id AND d.user_id = a.user_id
  LEFT JOIN (SELECT user_id, case_id, arg_max(decide_by, (created_at, offer_id)) AS decide_by FROM offers_ WHERE decide_by IS NOT NULL GROUP BY ALL) o ON o.case_id = a.case_id AND o.user_id = a.user_id
  ) x) y""", "act companies_ users_ stages_ sources_ deadlines_ offers_")

_ROW = f"""user_id, case_id, company, role, stage, display_stage, phase, status, channel, days_quiet, flag, flag_kind,
  closed, activity, needs_review, confidence, {ziso('applied_at')} AS applied_at, {ziso('last_signal_at')} AS last_signal_at,
  {ziso('next_interview_at')} AS next_interview_at,
  CASE WHEN days_quiet IS NULL THEN '' WHEN days_quiet = 1 THEN 'quiet 1 day' ELSE concat('quiet ', days_quiet, ' days') END AS quiet_label"""


def board_rows(t: Tables):
    return ops.board(
        t.active, companies=t.companies, sources=t.sources, deadlines=t.deadlines, offers=t.offers,
        users=t.users, stage_defs=t.stage_defs, now=t.now,
    )


@add("c08_board", f"SELECT {_ROW} FROM board_", uses="board_")
def c08(t):
    rows = board_rows(t).drop("depth", "location", "work_mode", "current_phase")
    return iso(rows, "applied_at", "last_signal_at", "next_interview_at")


@add("x20_x21_flags", """SELECT case_id, days_quiet, flag_kind, flag FROM board_""", uses="board_")
def x21(t):
    return board_rows(t).select("case_id", "days_quiet", "flag_kind", "flag")


@add("x22_display_stage", """SELECT case_id, display_stage FROM board_""", uses="board_")
def x22(t):
    return board_rows(t).select("case_id", "display_stage")


_OPEN = "activity IN ('active', 'stale')"


@add("o01_board_by_signal", f"""SELECT user_id, case_id, rn AS position FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY last_signal_at DESC NULLS LAST, case_id) AS rn FROM board_ WHERE {_OPEN}) x WHERE rn <= 3""", uses="board_")
def o01(t):
    page = ops.board_page(ops.board_filter(board_rows(t)), limit=3)
    return page.select("user_id", "case_id", F.col("position").cast("bigint").alias("position"))


@add("o01_board_by_depth", """SELECT user_id, case_id, rn AS position FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY depth DESC NULLS LAST, case_id) AS rn FROM board_) x WHERE rn <= 100""", uses="board_")
def o01_depth(t):
    page = ops.board_page(ops.board_filter(board_rows(t), activity="all"), "stage_depth")
    return page.select("user_id", "case_id", F.col("position").cast("bigint").alias("position"))


@add("o01_board_by_company", """SELECT user_id, case_id, rn AS position FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY company, case_id) AS rn FROM board_ WHERE activity = 'closed') x WHERE rn <= 5""", uses="board_")
def o01_company(t):
    page = ops.board_page(ops.board_filter(board_rows(t), activity="closed"), "company", 5)
    return page.select("user_id", "case_id", F.col("position").cast("bigint").alias("position"))


@add("a19_board_tally", f"""SELECT user_id, count(*) FILTER (activity = 'active') AS active, count(*) FILTER (activity = 'stale') AS stale,
  count(*) FILTER (activity = 'closed') AS closed, count(*) FILTER ({_OPEN}) AS open, count(*) AS all
  FROM act GROUP BY user_id""".replace("AS all", 'AS "all"'), uses="act")
def a19(t):
    return ops.board_tally(t.active)


@add("a19_activity_rollup", "SELECT user_id, activity, count(*) AS n FROM act GROUP BY ROLLUP (user_id, activity)", uses="act")
def a19_rollup(t):
    return ops.activity_rollup(t.active)


@add("a18_counters", f"""SELECT user_id, count(*) FILTER (activity = 'active') AS live, count(*) FILTER (activity = 'stale') AS quiet,
  count(*) FILTER ({_OPEN} AND current_phase = 'interviewing') AS interviewing,
  count(*) FILTER ({_OPEN} AND current_stage IN ('offer', 'negotiating')) AS offer,
  count(*) FILTER (activity = 'stale') AS overdue, count(*) FILTER (activity = 'closed') AS closed
  FROM act GROUP BY user_id""", uses="act")
def a18(t):
    return ops.counters(t.active)


@add("f04_search_cases", """SELECT user_id, case_id, company, rn AS position FROM (SELECT a.user_id, a.case_id, c.canonical_name AS company,
  row_number() OVER (PARTITION BY a.user_id ORDER BY (lower(c.canonical_name) = 'company 3') DESC, a.last_signal_at DESC NULLS LAST, a.case_id) AS rn
  FROM projected a JOIN companies_ c USING (company_id) WHERE a.merged_into_id IS NULL
  AND (c.canonical_name ILIKE '%company 3%' OR a.role_title ILIKE '%company 3%')) x WHERE rn <= 6""", uses="projected companies_")
def f04(t):
    out = ops.search_cases(t.projected, t.companies, " Company 3 ")
    return out.select("user_id", "case_id", "company", F.col("position").cast("bigint").alias("position"))


@add("f05_list_cases", """SELECT user_id, case_id, rn AS position FROM (SELECT a.*, row_number() OVER (PARTITION BY a.user_id
  ORDER BY a.last_signal_at DESC NULLS LAST, a.case_id) AS rn
  FROM projected a JOIN companies_ c USING (company_id) WHERE a.merged_into_id IS NULL AND status = 'live'
  AND (c.canonical_name ILIKE '%role%' OR a.role_title ILIKE '%role%')) x WHERE rn <= 4""", uses="projected companies_")
def f05(t):
    out = ops.list_cases(t.projected, t.companies, phase="nonsense", status="live", query="ROLE", limit=4)
    return out.select("user_id", "case_id", F.col("position").cast("bigint").alias("position"))


cte("narrated", """SELECT e.user_id, e.case_id, e.seq,
  CASE type WHEN 'stage_advanced' THEN CASE WHEN to_stage IS NULL THEN 'Stage changed' ELSE coalesce(s.label, to_stage) END
    WHEN 'applied' THEN 'Applied' WHEN 'acknowledged' THEN 'Acknowledged' WHEN 'interview_scheduled' THEN 'Interview scheduled'
    WHEN 'interview_held' THEN 'Interview held' WHEN 'deadline_set' THEN 'Deadline detected' WHEN 'offer_received' THEN 'Offer received'
    WHEN 'offer_negotiated' THEN 'Offer revised' WHEN 'rejected' THEN 'Rejected' WHEN 'withdrawn' THEN 'Withdrawn'
    WHEN 'accepted' THEN 'Accepted' WHEN 'went_silent' THEN 'Went quiet' WHEN 'human_corrected' THEN 'You corrected this'
    WHEN 'note_added' THEN 'Note' END AS what,
  CASE WHEN p_note IS NOT NULL THEN p_note WHEN p_text IS NOT NULL THEN p_text
    WHEN p_ats_vendor IS NOT NULL THEN concat('Automated reply from ', p_ats_vendor)
    WHEN p_starts_at IS NOT NULL THEN concat('Invite for ', strftime(p_starts_at, '%Y-%m-%d %H:%M'))
    WHEN p_due_at IS NOT NULL THEN concat('Due ', strftime(p_due_at, '%Y-%m-%d %H:%M'))
    WHEN p_field IS NOT NULL THEN concat(p_field, ': None → ', coalesce(p_to, 'None'))
    WHEN p_days_quiet <> 0 THEN concat('No inbound signal for ', p_days_quiet, ' days') ELSE '' END AS detail,
  CASE WHEN rung IS NULL OR rung = 4 THEN 'quick add'
    WHEN rung = 1 THEN CASE WHEN p_ats_vendor IS NULL THEN 'gmail · template' ELSE concat('gmail · ', p_ats_vendor) END
    WHEN rung = 2 THEN CASE WHEN p_calendar_event_id IS NULL THEN 'gmail · thread' ELSE 'calendar · ics' END
    ELSE 'gmail · model' END AS source,
  printf('%.2f', confidence) AS conf, occurred_at, type, to_stage, p_language, p_thread_id
  FROM ev e LEFT JOIN stages_ s ON s.user_id = e.user_id AND s.key = e.to_stage""", "ev stages_")


@add("x29_narrate", "SELECT seq, what, detail, source, conf FROM narrated", uses="narrated")
def x29(t):
    return ops.narrated_log(t.log, t.stage_defs).select("seq", "what", "detail", "source", "conf")


@add("o06_case_events", "SELECT case_id, seq, what FROM narrated", uses="narrated")
def o06(t):
    """The narrated log of every case, newest first."""
    rows = ops.narrated_log(t.log, t.stage_defs)
    return rows.orderBy("case_id", F.col("occurred_at").desc(), F.col("seq").desc()).select("case_id", "seq", "what")


@add("c09_case_detail", f"""SELECT b.user_id, b.case_id, {ziso('b.applied_at')} AS applied, s.ats_vendor AS ats, s.posting_url,
  nullif(concat_ws(' · ', nullif(location, ''), nullif(work_mode, '')), '') AS location, coalesce(o.n, 0) AS offers
  FROM board_ b LEFT JOIN (SELECT DISTINCT ON (user_id, case_id) user_id, case_id, ats_vendor, posting_url FROM sources_
    ORDER BY user_id, case_id, first_seen_at, source_id) s ON s.case_id = b.case_id
  LEFT JOIN (SELECT case_id, count(*) AS n FROM offers_ GROUP BY case_id) o ON o.case_id = b.case_id""", uses="board_ sources_ offers_")
def c09(t):
    out = ops.case_facts(board_rows(t), t.sources, t.offers).drop("posted_min", "posted_max")
    return iso(out, "applied")


# The week before the middle of the log, so that something has happened in it.
_MID = "2024-06-20 00:00:00"


def _week(at):
    return f"occurred_at > TIMESTAMP '{at}' - INTERVAL 7 DAYS AND occurred_at <= TIMESTAMP '{at}'"



def _mid():
    return F.to_timestamp(F.lit(_MID))


for _name, _at in (("moved_", _MID), ("moved_today_", NOW)):
    cte(_name, f"""SELECT e.user_id, count(DISTINCT e.case_id) AS moved FROM ev e
  LEFT JOIN stages_ t ON t.user_id = e.user_id AND t.key = e.to_stage
  LEFT JOIN stages_ f ON f.user_id = e.user_id AND f.key = e.from_stage
  WHERE {_week(_at)} AND (type IN ('interview_scheduled', 'offer_received') OR (type = 'stage_advanced' AND to_stage IS NOT NULL
    AND (from_stage IS NULL OR coalesce(t.depth, 0) > coalesce(f.depth, 0)))) GROUP BY e.user_id""", "ev stages_")


@add("a23_moved_this_week", "SELECT user_id, moved FROM moved_", uses="moved_")
def a23(t):
    return ops.moved_this_week(t.log, t.stage_defs, _mid())


@add("o02_recent_feed", f"""SELECT x.user_id, rn AS position, x.case_id, c.canonical_name AS company, a.status <> 'live' AS closed,
  CASE x.type WHEN 'offer_received' THEN 'Offer received' WHEN 'acknowledged' THEN 'Application acknowledged' WHEN 'applied' THEN 'Application sent'
    WHEN 'rejected' THEN CASE WHEN p_after_stage IS NULL THEN 'Rejected' ELSE concat('Rejected after the ', lower(coalesce(sa.label, p_after_stage))) END
    WHEN 'interview_scheduled' THEN concat(CASE WHEN p_stage IS NULL THEN 'Interview' ELSE coalesce(sp.label, p_stage) END, ' scheduled')
    WHEN 'stage_advanced' THEN CASE WHEN coalesce(to_stage, p_to_stage) IS NULL THEN 'Stage changed' ELSE concat('Moved to ', lower(coalesce(st.label, to_stage, p_to_stage))) END
    ELSE replace(x.type, '_', ' ') END AS what,
  strftime(timezone(u.tz, timezone('UTC', x.occurred_at)), '%a') AS when
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, seq DESC) AS rn FROM ev
    WHERE occurred_at > TIMESTAMP '{_MID}' - INTERVAL 7 DAYS AND type <> 'went_silent') x
  JOIN projected a ON a.case_id = x.case_id JOIN companies_ c ON c.company_id = a.company_id JOIN users_ u ON u.user_id = x.user_id
  LEFT JOIN stages_ sa ON sa.user_id = x.user_id AND sa.key = p_after_stage
  LEFT JOIN stages_ sp ON sp.user_id = x.user_id AND sp.key = p_stage
  LEFT JOIN stages_ st ON st.user_id = x.user_id AND st.key = coalesce(to_stage, p_to_stage) WHERE rn <= 8""".replace("AS when", 'AS "when"'),
     uses="ev projected companies_ users_ stages_")
def o02(t):
    out = ops.recent_feed(t.log, t.projected, t.companies, t.stage_defs, t.users, _mid())
    return out.withColumn("position", F.col("position").cast("bigint"))


cte("next_", f"""SELECT n.user_id, n.case_id, c.canonical_name AS company, a.role_title AS role, coalesce(s.label, n.stage) AS stage, n.starts_at
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY starts_at, interview_id) AS rn FROM interviews_
    WHERE cancelled_at IS NULL AND starts_at > TIMESTAMP '{NOW}') n
  JOIN projected a ON a.case_id = n.case_id JOIN companies_ c USING (company_id)
  LEFT JOIN stages_ s ON s.user_id = n.user_id AND s.key = n.stage WHERE rn = 1""", "interviews_ projected companies_ stages_")


@add("o03_next_interview", f"""SELECT user_id, case_id, company, role, stage, {ziso('starts_at')} AS starts_at,
  CAST(0 AS BIGINT) AS rounds_done FROM next_""", uses="next_")
def o03(t):
    return iso(ops.next_interview(t.interviews, t.projected, t.companies, t.stage_defs, t.now), "starts_at")


@add("x30_headline", """SELECT user_id, CASE WHEN m > 0 THEN 'moved' WHEN live = 0 THEN 'empty' WHEN user_id % 2 = 0 THEN 'clear' ELSE 'waiting' END AS headline_kind,
  CASE WHEN m > 0 THEN concat(w[m + 1], ' moved / forward / this week') WHEN live = 0 THEN 'Nothing / to track yet'
    WHEN user_id % 2 = 0 THEN 'You are / clear today' ELSE concat(w[live + 1], ' applications / waiting') END AS headline
  FROM (SELECT u.user_id, coalesce(v.moved, 0) % 3 AS m, coalesce(l.live, 0) AS live,
    ['Zero','One','Two','Three','Four','Five','Six','Seven','Eight'] AS w FROM users_ u
    LEFT JOIN moved_ v USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) FILTER (activity = 'active') AS live FROM act GROUP BY user_id) l USING (user_id)) x""",
     uses="users_ moved_ act")
def x30(t):
    rows = t.users.select("user_id").join(ops.moved_this_week(t.log, t.stage_defs, _mid()), "user_id", "left").join(
        ops.counters(t.active).select("user_id", "live"), "user_id", "left"
    ).fillna(0, ["moved", "live"])
    line = D.headline(F.col("moved") % 3, F.col("live"), F.col("user_id") % 2)
    return rows.select("user_id", *[v.alias(k) for k, v in line.items()])


@add("x31_drafts", """SELECT b.user_id, b.case_id,
    CASE WHEN it THEN concat('Re: candidatura ', b.company) ELSE concat('Re: ', b.company, ' application') END AS subject,
    CASE WHEN it THEN concat('Ciao,', chr(10), chr(10), 'grazie ancora per ', lower(what), '.', chr(10), 'Serve qualcosa da parte mia mentre il team decide?', chr(10), chr(10), 'Un saluto,')
    ELSE concat('Hi,', chr(10), chr(10), 'thanks again for the ', lower(what), '.', chr(10), 'Is there anything you need from my side while the team decides?', chr(10), chr(10), 'Best,') END AS body
  FROM board_ b JOIN (SELECT DISTINCT ON (case_id) *, coalesce(p_language = 'it', false) AS it FROM narrated ORDER BY case_id, occurred_at DESC, seq DESC) n ON n.case_id = b.case_id""",
     uses="board_ narrated")
def x31(t):
    from caseledger.plans.drafts import drafts

    return drafts(board_rows(t), t.log, t.stage_defs).select("user_id", "case_id", "subject", "body")


@add("x31_mailto", r"""SELECT case_id, concat('mailto:?subject=', replace(replace(replace(subject, ':', '%3A'), ' ', '%20'), '.', '.'),
    '&body=', replace(replace(replace(replace(replace(body, chr(10), '%0A'), ',', '%2C'), ' ', '%20'), '?', '%3F'), ':', '%3A'),
    CASE WHEN p_thread_id IS NULL THEN '' ELSE concat('&In-Reply-To=%3C', p_thread_id, '%3E') END) AS mailto_url FROM (
  SELECT b.case_id, p_thread_id, CASE WHEN it THEN concat('Re: candidatura ', b.company) ELSE concat('Re: ', b.company, ' application') END AS subject,
    CASE WHEN it THEN concat('Ciao,', chr(10), chr(10), 'grazie ancora per ', lower(what), '.', chr(10), 'Serve qualcosa da parte mia mentre il team decide?', chr(10), chr(10), 'Un saluto,')
    ELSE concat('Hi,', chr(10), chr(10), 'thanks again for the ', lower(what), '.', chr(10), 'Is there anything you need from my side while the team decides?', chr(10), chr(10), 'Best,') END AS body
  FROM board_ b JOIN (SELECT DISTINCT ON (case_id) *, coalesce(p_language = 'it', false) AS it FROM narrated ORDER BY case_id, occurred_at DESC, seq DESC) n ON n.case_id = b.case_id) x""",
     uses="board_ narrated")
def x31_url(t):
    from caseledger.plans.drafts import drafts

    return drafts(board_rows(t), t.log, t.stage_defs).select("case_id", "mailto_url")
