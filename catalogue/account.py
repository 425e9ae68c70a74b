"""Exports, commands and conversations."""

from pyspark.sql import functions as F

from caseledger.operators import log as log_ops
from caseledger.plans import account as ops

from .base import Registry, ziso

REGISTRY = Registry()
add = REGISTRY.add


# The account's tables: where SQL finds them, and their columns as text (s), numbers and booleans (n), instants (t) and dates (d).
ACCOUNT = {
    "users": ("users_", "user_id:n tz:s display_currency:s"),
    "stage_defs": ("stage_defs_", "user_id:n key:s label:s phase:s depth:n stale_after_days:n"),
    "cases": ("cases_", "case_id:n user_id:n company_id:n role_title:s seniority:s location:s work_mode:s manually_created:n merged_into_id:n created_at:t"),
    "events": ("ev", "seq:n user_id:n case_id:n type:s occurred_at:t from_stage:s to_stage:s evidence_ref:s rung:n"),
    "sources": ("sources_", "source_id:n user_id:n case_id:n channel:s posting_url:s ats_vendor:s first_seen_at:t is_first_touch:n"),
    "interviews": ("interviews_", "interview_id:s user_id:n case_id:n stage:s starts_at:t ends_at:t location:s calendar_event_id:s cancelled_at:t"),
    "comp_offers": ("offers_", "offer_id:n user_id:n case_id:n kind:s min_minor:n max_minor:n currency:s decide_by:d created_at:t"),
    "deadlines": ("deadlines_", "deadline_id:n user_id:n case_id:n kind:s due_at:t source:s"),
}
_USES = " ".join(source for source, _ in ACCOUNT.values())


def _fields(name):
    return [f.split(":") for f in ACCOUNT[name][1].split()]


def account_tables(t):
    raw = {
        "users": t.users, "stage_defs": t.stage_defs, "cases": t.cases, "events": t.log, "sources": t.sources,
        "interviews": t.interviews, "comp_offers": t.offers, "deadlines": t.deadlines,
    }
    return {name: df.select(*[c for c, _ in _fields(name)]) for name, df in raw.items()}


def _json_sql(name):
    """A row as JSON, without what is null."""
    def member(column, kind):
        value = ziso(column) if kind == "t" else f"CAST({column} AS VARCHAR)"
        quote = "" if kind == "n" else '"'
        return f"""CASE WHEN {column} IS NOT NULL THEN concat('"{column}":{quote}', {value}, '{quote}') END"""

    members = ", ".join(member(c, k) for c, k in _fields(name))
    return f"concat('{{', array_to_string(list_filter([{members}], lambda x: x IS NOT NULL), ','), '}}')"


def _row_sql(name):
    return "concat_ws('|', " + ", ".join(f"coalesce({ziso(c) if k == 't' else f'CAST({c} AS VARCHAR)'}, '-')" for c, k in _fields(name)) + ")"


@add("s08_export_json", " UNION ALL ".join(f"SELECT user_id, '{n}' AS name, {_json_sql(n)} AS row FROM {s}" for n, (s, _) in ACCOUNT.items()), uses=_USES)
def s08(t):
    return ops.export_json(account_tables(t))


@add("s09_export_csv", f"""SELECT c.case_id, c.user_id, p.canonical_name AS company, {ziso('c.created_at')} AS created_at FROM cases_ c JOIN companies_ p USING (company_id)""", uses="cases_ companies_")
def s09(t):
    return ops.export_csv(t.cases, t.companies).select("case_id", "user_id", "company", "created_at")


@add("s09_export_selected", f"""SELECT c.case_id, c.user_id, p.canonical_name AS company FROM cases_ c JOIN companies_ p USING (company_id) WHERE c.case_id % 3 = 1""", uses="cases_ companies_")
def s09_selected(t):
    chosen = t.cases.filter("case_id % 3 = 1").select("case_id")
    return ops.export_csv(t.cases, t.companies, chosen).select("case_id", "user_id", "company")


@add("s11_account_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, user_id, {_row_sql(n)} AS row FROM {s}" for n, (s, _) in ACCOUNT.items()), uses=_USES)
def s11(t):
    """Tables brought to their declared schema, every row of them."""
    from caseledger.functions.clock import iso_z
    from caseledger.sources.tables import conform

    out = None
    for name, df in account_tables(t).items():
        shown = [iso_z(F.col(c)) if k == "t" else F.col(c).cast("string") for c, k in _fields(name)]
        rows = conform(df.withColumn("extra", F.lit(1)), name).select(
            F.lit(name).alias("name"), "user_id", F.concat_ws("|", *[F.coalesce(x, F.lit("-")) for x in shown]).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


@add("a24_conversation_summary", "SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def a24(t):
    return ops.conversation_summary(t.raw("conversations"))


@add("a25_history_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) x WHERE rn <= 3")
def a25(t):
    return _history(t, 3).select("conv_id", "turn")


def _history(t, turns):
    m = t.raw("conversations")
    files = m.select("conv_id", "turn", F.concat("conv_id", F.lit("-"), "turn").alias("attachment_id"), F.length("text").cast("bigint").alias("size"))
    return ops.history_budget(m, files, turns, 1500)


@add("a25_history_budget", """SELECT conv_id, turn, coalesce(kept, '') AS attachments FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) x
  LEFT JOIN (WITH RECURSIVE files AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i, concat(conv_id, '-', turn) AS id, length(text) AS size FROM conversations),
    walk AS (SELECT conv_id, 0::BIGINT AS i, 1500::BIGINT AS room, '' AS kept FROM (SELECT DISTINCT conv_id FROM conversations) c
      UNION ALL SELECT w.conv_id, f.i, CASE WHEN f.size <= w.room THEN w.room - f.size ELSE w.room END,
        CASE WHEN f.size <= w.room THEN concat(w.kept, CASE WHEN w.kept = '' THEN '' ELSE ',' END, f.id) ELSE w.kept END
      FROM walk w JOIN files f ON f.conv_id = w.conv_id AND f.i = w.i + 1 WHERE f.i <= 24)
    SELECT conv_id, arg_max(kept, i) AS kept FROM walk GROUP BY conv_id) k USING (conv_id) WHERE rn <= 24""")
def a25_budget(t):
    return _history(t, 24).select("conv_id", "turn", F.array_join("attachments", ",").alias("attachments"))


@add("c05_commands_to_events", """SELECT case_id, CASE case_id % 4 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'went_silent' WHEN 2 THEN 'human_corrected' ELSE 'applied' END AS type,
  CASE WHEN case_id % 4 = 2 THEN current_stage END AS from_value, CASE WHEN case_id % 4 = 2 THEN 'offer' END AS to_value, CASE WHEN case_id % 4 = 3 THEN 'career_page' END AS channel
  FROM folded""", uses="folded")
def c05(t):
    from caseledger.operators.fold import fold

    i = "CAST(case_id % 4 AS INT)"
    commands = t.cases.select(
        F.col("case_id").alias("command_id"), "user_id", "case_id", F.expr(f"get(array('archive', 'archive', 'correct', 'add'), {i})").alias("kind"),
        F.expr(f"get(array('withdrawn', 'dormant', 'stage', NULL), {i})").alias("arg"), F.lit("offer").alias("value"), t.now.alias("at"))
    bad = commands.withColumn("arg", F.lit("company_id")).filter("kind = 'correct'")
    out = log_ops.commands_to_events(commands.unionByName(bad), fold(t.log, t.stage_defs))
    return out.select("case_id", "type", "from_value", "to_value", "channel")
