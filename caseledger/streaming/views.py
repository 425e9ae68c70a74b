"""Reports kept up to date: what a batch changes of its cases is added to stored totals.

Each case stands for a few additive rows. When a batch touches it, the rows of its old version are taken off and those of its
new version are added, so a total is the sum of all signed rows. What depends on the time of the report (a period, a
case that counts as ghosted from some instant on) is kept per day, and the rows of the one day that the instant cuts are
read one by one.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from .. import constants as C
from ..functions.clock import plus_days
from ..operators.fold import project_cases
from ..operators.log import interviews_from_events, sources_from_events
from ..operators.reach import phase_reach
from ..operators.skew import first_per_key
from ..plans.statistics import channel_rates, funnel_steps
from .commits import Commits

CASE = ["user_id", "case_id"]
_COUNTS = [f"n{i}" for i in range(5)]
_FLAGS = ("acknowledged", "screening", "interview", "offer", "dormant")
#: Before every report.
_ALWAYS = "0001-01-02 00:00:00"


def contributions(cases: DataFrame, log: DataFrame, stage_defs: DataFrame | None) -> DataFrame:
    """What each case that is not merged away stands for in the reports.

    channel: of its first touch; began: where the funnel's period begins to count; ghost_at: the instant from which it counts as
    ghosted, if nothing else happens.
    """
    projected = project_cases(cases, log, F.lit(None).cast("timestamp"), stage_defs=stage_defs)
    reach = phase_reach(projected, log, stage_defs)
    touch = sources_from_events(log).filter("is_first_touch").select(*CASE, "channel")
    ahead = interviews_from_events(log).filter("cancelled_at IS NULL").groupBy(*CASE).agg(F.max("starts_at").alias("_last_interview"))
    state = projected.select(*CASE, "presumed_closed", "current_stage", "last_signal_at")
    rows = reach.join(state, CASE).join(touch, CASE, "left").join(ahead, CASE, "left")
    wait = F.when(F.col("current_phase") == "sent", C.NO_REPLY_CLOSED_DAYS).otherwise(C.PRESUMED_CLOSED_DAYS)
    always = F.lit(_ALWAYS).cast("timestamp")
    # The first instant past the wait.
    silent = plus_days(F.col("last_signal_at"), wait) + F.expr("INTERVAL 0.000001 SECONDS")
    owes = F.col("current_stage").isin(*C.USER_OWES_STAGES)
    closes = F.when(F.coalesce("presumed_closed", F.lit(False)), always).when(~F.coalesce(owes, F.lit(False)), silent)
    ghost_at = F.when(F.col("status") == "dormant", always).when(
        (F.col("status") == "live") & closes.isNotNull(), F.greatest(closes, F.coalesce("_last_interview", always))
    )
    return rows.select(
        *CASE, "channel", F.coalesce("applied_at", "created_at").alias("began"),
        F.col("reached_acknowledged").alias("acknowledged"), F.col("reached_screening").alias("screening"),
        F.col("reached_interview").alias("interview"), F.col("reached_offer").alias("offer"),
        (F.col("status") == "dormant").alias("dormant"), ghost_at.alias("ghost_at"),
    )


_VERSION = StructType([
    StructField("user_id", LongType()), StructField("case_id", LongType()), StructField("channel", StringType()),
    StructField("began", TimestampType()), *[StructField(f, IntegerType()) for f in _FLAGS],
    StructField("ghost_at", TimestampType()), StructField("batch", LongType()), StructField("bucket", IntegerType()),
])
_TOTAL = StructType([
    StructField("view", StringType()), StructField("user_id", LongType()), StructField("channel", StringType()),
    StructField("day", IntegerType()), *[StructField(c, LongType()) for c in _COUNTS],
])
_EDGE = StructType([*_TOTAL.fields[:4], StructField("at", TimestampType()), *_TOTAL.fields[4:]])


def _day(at: Column) -> Column:
    return F.unix_date(F.to_date(at))


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    """The additive rows of cases: view, user_id, channel, at, day, n0 to n4."""
    def row(view: str, channel: Column, at: Column, *counts: Column) -> Column:
        full = [*counts, *[F.lit(0)] * (len(_COUNTS) - len(counts))]
        return F.struct(
            F.lit(view).alias("view"), channel.alias("channel"), at.alias("at"),
            *[(c.cast("long") * sign).alias(n) for n, c in zip(_COUNTS, full, strict=True)],
        )

    one, none, never = F.lit(1), F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    flag, channel = F.col, F.col("channel")
    views = F.array(
        row("funnel", none, F.col("began"), one, flag("acknowledged"), flag("screening"), flag("interview"), flag("offer")),
        F.when(channel.isNotNull(), row("channel", channel, never, one, flag("interview"), flag("offer"), flag("dormant"))),
        F.when(channel.isNotNull() & F.col("ghost_at").isNotNull(), row("ghost", channel, F.col("ghost_at"), one)),
    )
    each = rows.select("user_id", F.explode(views).alias("r")).filter("r IS NOT NULL")
    return each.select("user_id", "r.*").withColumn("day", _day(F.col("at")))


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    summed = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return summed.filter(" OR ".join(f"{c} <> 0" for c in _COUNTS))


def _folders(folder: str) -> dict[str, str]:
    return {name: f"{folder.rstrip('/')}/{name}" for name in ("totals", "edges", "versions")}


def _commits(spark: SparkSession, folder: str) -> Commits:
    return Commits(spark, _folders(folder)["totals"])


def refresh_views(
    spark: SparkSession, cases: DataFrame, log: DataFrame, touched: DataFrame, folder: str, stage_defs: DataFrame | None, number: int
) -> bool:
    """Bring the totals up to date with the batch `number`; False when it has been done before.

    `cases` and `log` hold the touched cases and all their events, `touched` is user_id, case_id, bucket. Only the
    stored versions of the touched buckets are read.
    """
    commits, at = _commits(spark, folder), _folders(folder)
    if commits.holds(number):
        return False
    keys = touched.select(*CASE, "bucket").distinct()
    # At most as many numbers as there are buckets.
    buckets = [r[0] for r in keys.select("bucket").distinct().collect()]
    stored = commits.read(at["versions"], _VERSION).filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    old = first_per_key(stored.join(keys.select(*CASE), CASE, "left_semi"), CASE, F.col("batch"), last=True)
    made = contributions(cases, log, stage_defs)
    # A case that is gone by now, or merged away, keeps a version that stands for nothing.
    new = keys.join(made.withColumn("_there", F.lit(True)), CASE, "left")
    flags = [F.coalesce(F.col(f), F.lit(False)).cast("int").alias(f) for f in _FLAGS]
    new = new.select(
        *CASE, "channel", F.when(F.col("_there"), F.coalesce("began", F.lit(_ALWAYS).cast("timestamp"))).alias("began"),
        *flags, "ghost_at", "bucket",
    ).persist()
    changed = _signed(new.filter("began IS NOT NULL"), 1).unionByName(_signed(old.filter("began IS NOT NULL"), -1))
    edges = _sums(changed, ["view", "user_id", "channel", "day", "at"]).persist()
    done = commits.write(number, {
        at["totals"]: (_sums(edges, ["view", "user_id", "channel", "day"]), []),
        at["edges"]: (edges.filter("at IS NOT NULL"), []),
        at["versions"]: (new, ["bucket"]),
    })
    edges.unpersist()
    new.unpersist()
    return done


def fold_views(spark: SparkSession, folder: str) -> int | None:
    """One row per total, and the newest version of each case, in one commit."""
    at = _folders(folder)
    return _commits(spark, folder).fold(
        {at["totals"]: (_TOTAL, []), at["edges"]: (_EDGE, []), at["versions"]: (_VERSION, ["bucket"])},
        {
            at["totals"]: lambda df: _sums(df, ["view", "user_id", "channel", "day"]),
            at["edges"]: lambda df: _sums(df, ["view", "user_id", "channel", "day", "at"]),
            at["versions"]: lambda df: first_per_key(df, CASE, F.col("batch"), last=True),
        },
    )


def _upto(spark: SparkSession, folder: str, view: str, whole_days: Column, edge_day: Column, edge: Column) -> DataFrame:
    """Rows of a view on whole days, and those of one day at the instants that count."""
    commits, at = _commits(spark, folder), _folders(folder)
    columns = ["user_id", "channel", *_COUNTS]
    days = commits.read(at["totals"], _TOTAL).filter((F.col("view") == view) & whole_days)
    instants = commits.read(at["edges"], _EDGE).filter((F.col("view") == view) & (F.col("day") == edge_day) & edge)
    return days.select(*columns).unionByName(instants.select(*columns))


def channel_effectiveness(spark: SparkSession, folder: str) -> DataFrame:
    """`statistics.channel_effectiveness` out of the totals."""
    rows = _commits(spark, folder).read(_folders(folder)["totals"], _TOTAL).filter("view = 'channel'")
    return _sums(rows, ["channel", "user_id"]).select(
        "channel", "user_id", F.col("n0").alias("sent"), F.col("n1").alias("interviews"), F.col("n2").alias("offers"),
        F.col("n3").alias("ghosted"),
    )


def funnel(spark: SparkSession, folder: str, now: Column, period: str | None = None) -> DataFrame:
    """`statistics.funnel` out of the totals."""
    if period == "all":
        rows = _commits(spark, folder).read(_folders(folder)["totals"], _TOTAL).filter("view = 'funnel'")
    else:
        cut = now - F.expr("INTERVAL 90 DAYS" if period == "90d" else "INTERVAL 12 MONTHS")
        rows = _upto(spark, folder, "funnel", F.col("day") > _day(cut), _day(cut), F.col("at") > cut)
    counted = _sums(rows, ["user_id"])
    return funnel_steps(counted.select("user_id", *[F.col(c).alias(f"_{i}") for i, c in enumerate(_COUNTS)]))


def channels(spark: SparkSession, folder: str, now: Column) -> DataFrame:
    """`statistics.channels` out of the totals."""
    gone = _upto(spark, folder, "ghost", F.col("day") < _day(now), _day(now), F.col("at") <= now)
    gone = _sums(gone, ["user_id", "channel"]).select("user_id", "channel", F.col("n0").alias("ghosted"))
    rows = channel_effectiveness(spark, folder).drop("ghosted").join(gone, ["user_id", "channel"], "left")
    return channel_rates(rows.select(
        "user_id", "channel", "sent", "interviews", "offers", F.coalesce("ghosted", F.lit(0)).alias("ghosted")
    ))
