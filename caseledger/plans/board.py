"""The board, one case in full, and the first screen, for all tenants at once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import display as D
from ..functions.clock import date_eyebrow, iso_z, local
from ..operators import reach as R
from ..operators.activity import activity_filter
from ..operators.skew import top_per_key
from ..operators.stages import display_stage, with_stage

CASE = ["user_id", "case_id"]
MAX_LIMIT = 200
DEFAULT_LIMIT = 100


# --- facts beside a case -----------------------------------------------------


def side_facts(
    cases: DataFrame, sources: DataFrame, deadlines: DataFrame, offers: DataFrame
) -> DataFrame:
    """Channel, earliest open deadline and newest decision date of each case."""
    channel = sources.groupBy(*CASE).agg(
        F.min_by(
            "channel", F.struct((~F.col("is_first_touch")).alias("later"), "first_seen_at", "source_id")
        ).alias("channel")
    )
    due = (
        deadlines.filter(F.col("met_at").isNull()).groupBy(*CASE)
        .agg(F.min("due_at").alias("deadline_at"))
    )
    decide = (
        offers.filter(F.col("decide_by").isNotNull()).groupBy(*CASE)
        .agg(F.max_by("decide_by", F.struct("created_at", "offer_id")).alias("decide_by"))
    )
    out = cases
    for side in (channel, due, decide):
        out = out.join(side, CASE, "left")
    return out


# --- filters, sorts, counts ------------------------------------------------------


def board_filter(
    active: DataFrame,
    *,
    phase: str | None = None,
    status: str | None = None,
    activity: str | None = None,
) -> DataFrame:
    out = active
    if phase and phase != "all":
        out = out.filter(F.col("current_phase") == phase)
    if status and status != "all":
        out = out.filter(F.col("status") == status)
    return activity_filter(out, activity)


def board_order(sort: str | None) -> list[Column]:
    first = {
        "stage_depth": F.col("depth").desc_nulls_last(),
        "company": F.col("company").asc(),
    }.get(sort or "", F.col("last_signal_at").desc_nulls_last())
    return [first, F.col("case_id").asc()]


def board_page(rows: DataFrame, sort: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first rows of every tenant, in board order."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return top_per_key(rows, ["user_id"], board_order(sort), limit, "position")


def board_tally(active: DataFrame) -> DataFrame:
    """Cases per activity, with the open and overall totals."""
    tally = active.groupBy("user_id").agg(
        *[F.count_if(F.col("activity") == a).alias(a) for a in ("active", "stale", "closed")]
    )
    return tally.select(
        "*",
        (F.col("active") + F.col("stale")).alias("open"),
        (F.col("active") + F.col("stale") + F.col("closed")).alias("all"),
    )


def activity_rollup(active: DataFrame) -> DataFrame:
    """Counts per tenant and activity with subtotals; a null activity is the tenant total."""
    return active.rollup("user_id", "activity").agg(F.count("*").alias("n"))


def _with_company(cases: DataFrame, companies: DataFrame) -> DataFrame:
    return cases.join(
        companies.select("company_id", F.col("canonical_name").alias("company")), "company_id"
    )


def board(
    active: DataFrame,
    *,
    companies: DataFrame,
    sources: DataFrame,
    deadlines: DataFrame,
    offers: DataFrame,
    users: DataFrame,
    stage_defs: DataFrame | None,
    now: Column,
) -> DataFrame:
    """Nineteen columns per case that is not merged away, plus the keys of the sorts."""
    rows = _with_company(side_facts(active, sources, deadlines, offers), companies)
    rows = rows.join(users.select("user_id", "tz"), "user_id", "left").withColumn(
        "tz", F.coalesce("tz", F.lit("UTC"))
    )
    rows = with_stage(rows, stage_defs, "current_stage", {"label": "_label"})
    threshold = F.coalesce(2 * F.col("p90_days"), F.col("stale_after_days").cast("double"))
    kind = D.flag_kind(
        now, status=F.col("status"), deadline_at=F.col("deadline_at"), decide_by=F.col("decide_by"),
        last_signal_at=F.col("last_signal_at"), quiet_threshold=threshold,
    )
    rows = rows.withColumn("flag_kind", kind).withColumn(
        "days_quiet", D.quiet_days(now, F.col("last_signal_at"))
    )
    return rows.select(
        "user_id",
        "case_id",
        "company",
        F.col("role_title").alias("role"),
        F.col("current_stage").alias("stage"),
        display_stage(F.col("status"), F.col("_label"), F.col("presumed_closed"))
        .alias("display_stage"),
        F.col("current_phase").alias("phase"),
        "current_phase",
        "status",
        "channel",
        "applied_at",
        "last_signal_at",
        "days_quiet",
        D.quiet_label(F.col("days_quiet")).alias("quiet_label"),
        D.flag_text(
            F.col("flag_kind"), deadline_at=F.col("deadline_at"), decide_by=F.col("decide_by"),
            tz=F.col("tz"),
        ).alias("flag"),
        "flag_kind",
        (F.col("status") != "live").alias("closed"),
        "activity",
        "next_interview_at",
        "needs_review",
        "confidence",
        "depth",
        "location",
        "work_mode",
    )


# --- looking cases up -------------------------------------------------------------


def _contains(query: str) -> Column:
    """ILIKE %query%: percent and underscore keep their meaning."""
    pattern = f"%{query.strip()}%"
    return F.col("company").ilike(pattern) | F.col("role_title").ilike(pattern)


def search_cases(projected: DataFrame, companies: DataFrame, query: str) -> DataFrame:
    """Up to six matches per tenant: the company of that very name first, then the newest."""
    rows = _with_company(R.not_merged(projected), companies).filter(_contains(query))
    order = [
        (F.lower("company") == query.strip().lower()).desc(),
        F.col("last_signal_at").desc_nulls_last(),
        F.col("case_id"),
    ]
    return top_per_key(rows, ["user_id"], order, 6, "position")


def list_cases(
    projected: DataFrame,
    companies: DataFrame,
    *,
    phase: str | None = None,
    status: str | None = None,
    query: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filtered cases of each tenant, newest first: as many as `limit` says, 20 where it says nothing. Unknown filters are ignored."""
    rows = _with_company(R.not_merged(projected), companies)
    if phase in C.PHASES:
        rows = rows.filter(F.col("current_phase") == phase)
    if status in C.STATUSES:
        rows = rows.filter(F.col("status") == status)
    if query and query.strip():
        rows = rows.filter(_contains(query))
    wanted = limit if limit and limit > 0 else 20
    order = [F.col("last_signal_at").desc_nulls_last(), F.col("case_id")]
    return top_per_key(rows, ["user_id"], order, wanted, "position")


# --- one case in full ----------------------------------------------------------------


def narrated_log(log: DataFrame, stage_defs: DataFrame | None) -> DataFrame:
    """Every event as a titled line. Order by occurred_at and seq, newest first, when shown."""
    rows = with_stage(log, stage_defs, "to_stage", {"label": "_label"})
    p = F.col("payload")
    return rows.select(
        "user_id",
        "case_id",
        "seq",
        "occurred_at",
        D.event_title(F.col("type"), F.col("to_stage"), F.col("_label")).alias("what"),
        D.event_detail(p).alias("detail"),
        D.event_provenance(F.col("rung"), p).alias("source"),
        F.format_string("%.2f", F.col("confidence")).alias("conf"),
        "rung",
        "evidence_ref",
    )


def case_facts(board_rows: DataFrame, sources: DataFrame, offers: DataFrame) -> DataFrame:
    """The facts under a case: where it came from, where the work is, what was offered."""
    earliest = sources.groupBy(*CASE).agg(
        F.min_by(F.struct("ats_vendor", "posting_url"), F.struct("first_seen_at", "source_id"))
        .alias("_s")
    )
    money = offers.groupBy(*CASE).agg(
        F.min_by(
            F.struct("min_minor", "max_minor", "currency"),
            F.when(F.col("kind") == "posted_range", F.struct("created_at", "offer_id")),
        ).alias("posted_range"),
        F.count_if(F.col("kind") == "offer").alias("offers"),
    )
    place = F.nullif(
        F.concat_ws(" · ", F.nullif("location", F.lit("")), F.nullif("work_mode", F.lit(""))),
        F.lit(""),
    )
    return (
        board_rows.join(earliest, CASE, "left")
        .join(money, CASE, "left")
        .select(
            *CASE,
            F.col("applied_at").alias("applied"),
            F.col("_s.ats_vendor").alias("ats"),
            F.col("_s.posting_url").alias("posting_url"),
            place.alias("location"),
            F.col("posted_range.min_minor").alias("posted_min"),
            F.col("posted_range.max_minor").alias("posted_max"),
            F.coalesce("offers", F.lit(0)).alias("offers"),
        )
    )


# --- the first screen -------------------------------------------------------------------


def counters(active: DataFrame) -> DataFrame:
    a = F.col("activity")
    return active.groupBy("user_id").agg(
        F.count_if(a == "active").alias("live"),
        F.count_if(a == "stale").alias("quiet"),
        F.count_if((a != "closed") & (F.col("current_phase") == "interviewing")).alias("interviewing"),
        F.count_if((a != "closed") & F.col("current_stage").isin("offer", "negotiating")).alias("offer"),
        F.count_if(a == "stale").alias("overdue"),
        F.count_if(a == "closed").alias("closed"),
    )


def moved_this_week(log: DataFrame, stage_defs: DataFrame | None, now: Column) -> DataFrame:
    """Cases of each tenant that moved forward in the last seven days."""
    week = log.filter(
        (F.col("occurred_at") > now - F.expr("INTERVAL 7 DAYS")) & (F.col("occurred_at") <= now)
    )
    week = with_stage(week, stage_defs, "to_stage", {"depth": "_to"})
    week = with_stage(week, stage_defs, "from_stage", {"depth": "_from"})
    deeper = (F.coalesce("from_stage", F.lit("")) == "") | (F.col("_to") > F.col("_from"))
    forward = F.col("type").isin("interview_scheduled", "offer_received") | (
        (F.col("type") == "stage_advanced") & (F.coalesce("to_stage", F.lit("")) != "") & deeper
    )
    return week.filter(forward).groupBy("user_id").agg(F.countDistinct("case_id").alias("moved"))


def recent_feed(
    log: DataFrame,
    projected: DataFrame,
    companies: DataFrame,
    stage_defs: DataFrame | None,
    users: DataFrame,
    now: Column,
    limit: int = 8,
) -> DataFrame:
    """The newest events of the week per tenant, as sentences."""
    week = log.filter(
        (F.col("occurred_at") > now - F.expr("INTERVAL 7 DAYS")) & (F.col("type") != "went_silent")
    )
    top = top_per_key(
        week, ["user_id"], [F.col("occurred_at").desc(), F.col("seq").desc()], limit, "position"
    )
    cases = _with_company(projected.select(*CASE, "company_id", "status"), companies)
    p = F.col("payload")
    rows = top.join(cases, CASE).withColumn(
        "_to", F.coalesce(F.nullif("to_stage", F.lit("")), p["to_stage"])
    )
    rows = rows.withColumn("_after", p["after_stage"]).withColumn("_stage", p["stage"])
    for key, name in (("_to", "_to_label"), ("_after", "_after_label"), ("_stage", "_stage_label")):
        rows = with_stage(rows, stage_defs, key, {"label": name})
    rows = rows.join(users.select("user_id", "tz"), "user_id", "left")
    what = D.what_happened(
        F.col("type"), p, F.col("_to"), F.col("_to_label"), F.col("_after_label"),
        F.col("_stage_label"),
    )
    when = F.date_format(local(F.col("occurred_at"), F.coalesce("tz", F.lit("UTC"))), "EEE")
    return rows.select(
        "user_id", "position", "case_id", "company", what.alias("what"), when.alias("when"),
        (F.col("status") != "live").alias("closed"),
    )


def next_interview(
    interviews: DataFrame,
    projected: DataFrame,
    companies: DataFrame,
    stage_defs: DataFrame | None,
    now: Column,
) -> DataFrame:
    """The next interview of each tenant, with the rounds its case has behind it."""
    ahead = (
        interviews.filter(F.col("cancelled_at").isNull() & (F.col("starts_at") > now))
        .groupBy("user_id")
        .agg(
            F.min_by(F.struct("case_id", "stage", "starts_at"), F.struct("starts_at", "interview_id"))
            .alias("n")
        )
        .select("user_id", "n.case_id", "n.stage", "n.starts_at")
    )
    held = interviews.filter("held").groupBy(*CASE).agg(F.count("*").alias("rounds_done"))
    rows = ahead.join(_with_company(projected.select(*CASE, "company_id", "role_title"), companies), CASE)
    rows = with_stage(rows.join(held, CASE, "left"), stage_defs, "stage", {"label": "_label"})
    return rows.select(
        "user_id", "case_id", "company", F.col("role_title").alias("role"),
        F.col("_label").alias("stage"), "starts_at",
        F.coalesce("rounds_done", F.lit(0)).alias("rounds_done"),
    )


def today(
    *,
    active: DataFrame,
    log: DataFrame,
    users: DataFrame,
    stage_defs: DataFrame | None,
    open_suggestions: DataFrame,
    upcoming: DataFrame,
    health: DataFrame,
    now: Column,
) -> DataFrame:
    """One row per tenant for the first screen."""
    shown = open_suggestions.groupBy("user_id").agg(F.count("*").alias("suggestions"))
    rows = users.select("user_id", "tz")
    for side in (counters(active), moved_this_week(log, stage_defs, now), shown):
        rows = rows.join(side, "user_id", "left")
    numbers = ["live", "quiet", "interviewing", "offer", "overdue", "closed", "moved", "suggestions"]
    rows = rows.fillna(0, numbers)
    line = D.headline(F.col("moved"), F.col("live"), F.col("suggestions"))
    nxt = upcoming.select(
        "user_id", F.col("case_id").alias("next_case_id"), F.col("starts_at").alias("next_starts_at")
    )
    rows = rows.join(nxt, "user_id", "left").join(
        health.select("user_id", F.col("state").alias("mailbox_state")), "user_id", "left"
    )
    return rows.select(
        "user_id",
        date_eyebrow(now, F.coalesce("tz", F.lit("UTC"))).alias("eyebrow"),
        *[v.alias(k) for k, v in line.items()],
        *numbers,
        "next_case_id",
        iso_z(F.col("next_starts_at")).alias("next_starts_at"),
        "mailbox_state",
    )
