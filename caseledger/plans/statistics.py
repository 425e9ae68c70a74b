"""The statistics report, for every tenant at once.

Each section is a table keyed by tenant. Sections over the same cases share one aggregation.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import metrics as M
from ..functions.clock import days_exact, minus_days
from ..operators.activity import ghosted
from ..operators.reach import period_window
from ..operators.skew import exact_percentiles
from ..operators.stages import with_stage
from ..session import cut_lineage

_FUNNEL = (
    ("Applied", None),
    ("Acknowledged", "reached_acknowledged"),
    ("Screening", "reached_screening"),
    ("Interviewing", "reached_interview"),
    ("Offer", "reached_offer"),
)


def cohort(reach: DataFrame, active: DataFrame, now: Column, period: str | None) -> DataFrame:
    """Reach beside activity, inside a period."""
    kept = period_window(reach, now, period)
    return kept.join(active.select("user_id", "case_id", "activity"), ["user_id", "case_id"])


def funnel(reach: DataFrame, now: Column, period: str | None = None) -> DataFrame:
    """Five ordered counts per tenant and their width against the first."""
    counted = period_window(reach, now, period).groupBy("user_id").agg(
        *[
            (F.count("*") if flag is None else F.count_if(flag)).alias(f"_{i}")
            for i, (_, flag) in enumerate(_FUNNEL)
        ]
    )
    return funnel_steps(counted)


def funnel_steps(counted: DataFrame) -> DataFrame:
    """The steps out of their five counts, `_0` to `_4`, per tenant."""
    steps = F.array(
        *[
            F.struct(F.lit(i + 1).alias("ord"), F.lit(label).alias("label"), F.col(f"_{i}").alias("n"))
            for i, (label, _) in enumerate(_FUNNEL)
        ]
    )
    return counted.select("user_id", "_0", F.explode(steps).alias("s")).select(
        "user_id",
        "s.ord",
        "s.label",
        "s.n",
        F.when(F.col("_0") > 0, F.bround(F.col("s.n") / F.col("_0") * 100)).otherwise(0.0)
        .cast("bigint").alias("width"),
    )


def _counts(now: Column) -> dict[str, Column]:
    closed = F.col("activity") == "closed"
    immature = F.coalesce(
        ~closed & ~F.col("reached_interview")
        & (F.col("applied_at") > minus_days(now, C.MATURITY_DAYS)),
        F.lit(False),
    )
    status = F.col("status")
    return {
        "cases": F.lit(True),
        "closed": closed,
        "immature": immature,
        "mature": ~immature,
        "converted": F.col("reached_interview") & ~immature,
        "offers": F.col("reached_offer"),
        "interviewed_closed": F.col("reached_interview") & closed,
        "ghosted": ghosted(),
        "open": ~closed,
        "accepted": closed & (status == "accepted"),
        "rejected": closed & (status == "rejected"),
        "withdrawn": closed & (status == "withdrawn"),
    }


def tenant_counts(cohort_: DataFrame, now: Column, *keys: str) -> DataFrame:
    """Every count the ratios need, in one pass."""
    return cohort_.groupBy(*(keys or ("user_id",))).agg(
        *[F.count_if(c).alias(name) for name, c in _counts(now).items()]
    )


def conversion(counts: DataFrame) -> DataFrame:
    r = M.ratio(
        F.col("converted"), F.col("mature"), F.col("closed"), F.col("immature"),
        "too recent to count",
    )
    return _metric(counts, r)


def offer_rate(counts: DataFrame) -> DataFrame:
    return _metric(
        counts, M.ratio(F.col("offers"), F.col("interviewed_closed"), F.col("closed"))
    )


def ghost_rate(counts: DataFrame) -> DataFrame:
    return _metric(counts, M.ratio(F.col("ghosted"), F.col("closed"), F.col("closed")))


def _metric(counts: DataFrame, r: dict[str, Column]) -> DataFrame:
    out = counts.select("user_id", *[v.alias(k) for k, v in r.items()])
    return out.withColumn("display", M.format_percent(F.col("value")))


def outcomes(counts: DataFrame) -> DataFrame:
    return counts.select("user_id", "open", "accepted", "rejected", "ghosted", "withdrawn")


def first_response(reach: DataFrame, now: Column, period: str | None = None) -> DataFrame:
    """Median days to the first human reply per tenant, with how many replied."""
    waited = (
        period_window(reach, now, period)
        .filter(F.col("applied_at").isNotNull())
        .withColumn("_days", days_exact(F.col("applied_at"), F.col("first_human_at")))
    )
    n = waited.groupBy("user_id").agg(F.count("first_human_at").alias("replied"))
    median = exact_percentiles(waited, ["user_id"], "_days", {"median_days": 0.5}).drop("n")
    return n.join(median, "user_id", "left").select(
        "user_id",
        "median_days",
        F.col("replied").alias("n"),
        M.format_days(F.col("median_days")).alias("display"),
    )


def channels(sources: DataFrame, reach: DataFrame, active: DataFrame) -> DataFrame:
    """First-touch channels per tenant, best first, with rates where the gate is met."""
    rows = (
        sources.filter("is_first_touch")
        .select("user_id", "case_id", "channel")
        .join(reach.select("user_id", "case_id", "reached_interview", "reached_offer", "status"),
              ["user_id", "case_id"])
        .join(active.select("user_id", "case_id", "activity"), ["user_id", "case_id"])
        .groupBy("user_id", "channel")
        .agg(
            F.count("*").alias("sent"),
            F.count_if("reached_interview").alias("interviews"),
            F.count_if("reached_offer").alias("offers"),
            F.count_if(ghosted()).alias("ghosted"),
        )
    )
    return channel_rates(rows)


def channel_rates(rows: DataFrame) -> DataFrame:
    """Counts per tenant and channel with their rates, where there are enough of them."""
    gate = M.channel_gate(F.col("sent"))
    rate = {
        name: F.when(gate["gate_met"], F.col(n) / F.col("sent"))
        for name, n in (("iv_value", "interviews"), ("of_value", "offers"), ("ghost_value", "ghosted"))
    }
    return rows.select(
        "*",
        gate["gate_met"].alias("gate_met"),
        gate["note"].alias("note"),
        *[v.alias(k) for k, v in rate.items()],
        *[M.format_percent(v).alias(k.removesuffix("_value")) for k, v in rate.items()],
    )


def channel_effectiveness(sources: DataFrame, reach: DataFrame) -> DataFrame:
    """The older form of the channel table: only dormant cases count as ghosted."""
    return (
        sources.filter("is_first_touch")
        .select("user_id", "case_id", "channel")
        .join(reach.select("user_id", "case_id", "reached_interview", "reached_offer", "status"),
              ["user_id", "case_id"])
        .groupBy("channel", "user_id")
        .agg(
            F.count("*").alias("sent"),
            F.count_if("reached_interview").alias("interviews"),
            F.count_if("reached_offer").alias("offers"),
            F.count_if(F.col("status") == "dormant").alias("ghosted"),
        )
    )


def time_in_stage(dwell: DataFrame, stage_defs: DataFrame | None) -> DataFrame:
    """Median days per stage under its label."""
    labelled = with_stage(dwell, stage_defs, "stage", {"label": "label"})
    d = M.dwell_metric(F.col("p50_days"), F.col("n"))
    return labelled.select(
        "user_id",
        F.col("stage").alias("key"),
        F.col("label").alias("stage"),
        F.bround("p50_days", 1).alias("days"),
        M.format_days(F.col("p50_days")).alias("display"),
        "n",
        d["gate_met"].alias("gate_met"),
        d["note"].alias("note"),
    )


def by_month(reach: DataFrame, now: Column, period: str | None = None) -> DataFrame:
    began = F.coalesce("applied_at", "created_at")
    return (
        period_window(reach, now, period)
        .groupBy("user_id", F.date_format(began, "yyyy-MM").alias("month"))
        .agg(
            F.count("*").alias("applied"),
            F.count("first_human_at").alias("replied"),
            F.count_if("reached_interview").alias("interviews"),
            F.count_if("reached_offer").alias("offers"),
        )
        .withColumn("label", F.date_format(F.to_date("month", "yyyy-MM"), "MMM yy"))
    )


def distinct_quarters(projected: DataFrame) -> DataFrame:
    """Quarters with an application, and whether a season can be shown."""
    per_quarter = (
        projected.filter(F.col("applied_at").isNotNull())
        .select("user_id", F.date_trunc("quarter", "applied_at").alias("_q"))
        .distinct()
    )
    n = per_quarter.groupBy("user_id").agg(F.count("*").alias("quarters"))
    gate = M.seasonal_gate(F.col("quarters"))
    return n.select("user_id", "quarters", *[v.alias(k) for k, v in gate.items()])


def compensation(offers: DataFrame, users: DataFrame) -> DataFrame:
    """Every usable amount on one scale per tenant, 0 to 100. Other currencies are counted."""
    own = offers.join(users.select("user_id", "display_currency"), "user_id", "left").withColumn(
        "display_currency", F.coalesce("display_currency", F.lit("EUR"))
    )
    usable = F.col("currency") == F.col("display_currency")
    low_of = F.least("min_minor", "max_minor")
    high_of = F.greatest("min_minor", "max_minor")
    scale = own.groupBy("user_id").agg(
        F.count_if(~usable).alias("dropped"),
        F.min(F.when(usable, low_of)).alias("low"),
        F.max(F.when(usable, high_of)).alias("high"),
    )
    rows = own.filter(usable).join(scale, "user_id")
    span = F.when(F.col("high") == F.col("low"), F.lit(1)).otherwise(F.col("high") - F.col("low"))

    def position(value: Column) -> Column:
        # Nothing and zero both sit at the low end.
        v = F.coalesce(F.nullif(value, F.lit(0)), F.col("low"))
        return F.bround((v - F.col("low")) / span * 100).cast("bigint")

    upper = F.coalesce(F.nullif(F.col("max_minor"), F.lit(0)), F.col("min_minor"))
    money = lambda v: M.format_money(v, F.col("currency"))
    return rows.select(
        "user_id",
        "offer_id",
        "kind",
        "low",
        "high",
        "dropped",
        position(F.col("min_minor")).alias("at"),
        position(upper).alias("to"),
        F.when(
            F.col("kind") == "posted_range",
            F.concat(money(F.col("min_minor")), F.lit("–"), money(upper)),
        ).when(F.col("kind") == "offer", money(F.col("min_minor"))).alias("label"),
    )


def statistics(
    *,
    reach: DataFrame,
    active: DataFrame,
    sources: DataFrame,
    dwell: DataFrame,
    offers: DataFrame,
    users: DataFrame,
    projected: DataFrame,
    stage_defs: DataFrame | None,
    now: Column,
    period: str | None = None,
) -> DataFrame:
    """The whole report as rows (user_id, section, item, measure, value, text)."""

    def rows(df: DataFrame, section: str, item: Column, numbers: list[str], texts: list[str]):
        cells = [
            F.struct(
                F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"),
                F.lit(None).cast("string").alias("text"),
            )
            for c in numbers
        ] + [
            F.struct(
                F.lit(c).alias("measure"), F.lit(None).cast("double").alias("value"),
                F.col(c).cast("string").alias("text"),
            )
            for c in texts
        ]
        return df.select(
            "user_id", F.lit(section).alias("section"), item.alias("item"),
            F.explode(F.array(*cells)).alias("c"),
        ).select("user_id", "section", "item", "c.measure", "c.value", "c.text")

    # Every section reads the same two tables: they are written once, as the report's snapshot.
    reach, active = cut_lineage(reach), cut_lineage(active)
    dwell = cut_lineage(dwell)
    counts = tenant_counts(cohort(reach, active, now, period), now)
    ratio_numbers, ratio_texts = (
        ["value", "numerator", "denominator", "excluded"],
        ["gate_met", "note", "small_sample", "display"],
    )
    none = F.lit(None).cast("string")
    parts = [
        rows(funnel(reach, now, period), "funnel", F.col("label"), ["ord", "n", "width"], []),
        rows(conversion(counts), "ratios", F.lit("Application → interview"), ratio_numbers, ratio_texts),
        rows(offer_rate(counts), "ratios", F.lit("Interview → offer"), ratio_numbers, ratio_texts),
        rows(first_response(reach, now, period), "first_response", none, ["median_days", "n"], ["display"]),
        rows(ghost_rate(counts), "ghost", none, ratio_numbers, ratio_texts),
        rows(channels(sources, reach, active), "channels", F.col("channel"),
             ["sent", "interviews", "offers", "ghosted", "iv_value", "of_value", "ghost_value"],
             ["gate_met", "note", "iv", "of", "ghost"]),
        rows(time_in_stage(dwell, stage_defs), "time_in_stage", F.col("key"), ["days", "n"],
             ["stage", "display", "gate_met"]),
        rows(by_month(reach, now, period), "by_month", F.col("month"),
             ["applied", "replied", "interviews", "offers"], ["label"]),
        rows(outcomes(counts), "outcomes", none,
             ["open", "accepted", "rejected", "ghosted", "withdrawn"], []),
        rows(compensation(offers, users), "compensation", F.col("offer_id").cast("string"),
             ["low", "high", "dropped", "at", "to"], ["kind", "label"]),
        rows(distinct_quarters(projected), "seasonal", none, ["quarters"],
             ["gate_met", "note"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
