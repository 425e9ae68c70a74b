"""From signals to cases: company, thread, similarity, merges, and the events that follow."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import names as N
from ..functions import wording as T
from ..functions.clock import iso_z, plus_days
from ..functions.text import domain_label, under_any
from ..session import cut_lineage, kept
from . import similarity as S
from .leaders import greedy_leaders
from .skew import first_per_key, nearest_points, top_per_key

BLOCK = ["user_id", "company_id"]


# --- company -----------------------------------------------------------------------------


def alias_keys(alias: Column, name: Column) -> Column:
    """Spellings to remember: the alias and the key of the name, without blanks."""
    keys = F.array_distinct(F.array(alias, N.company_key(name)))
    return F.array_except(keys, F.array(F.lit(""), F.lit(None).cast("string")))


def canonicalise_company(
    signals: DataFrame, companies: DataFrame, aliases: DataFrame, vendor_domains
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals with company_id, companies to create, aliases to record).

    The sender's own domain decides first, then a spelling the tenant has used, then the name.
    What is left becomes a new company, with an id derived from its name and domain.
    """
    ats = under_any(F.col("sender_domain"), vendor_domains)
    given = F.nullif(F.trim(F.coalesce("company", F.lit(""))), F.lit(""))
    rows = signals.withColumn("_domain", F.when(~ats, F.col("sender_domain"))).withColumn(
        "_alias", F.nullif(N.company_key(given), F.lit(""))
    )
    rows = rows.withColumn(
        "_name", F.coalesce(given, domain_label(F.col("_domain")), F.lit("Unknown"))
    )
    by_domain = companies.filter(F.col("domain").isNotNull()).groupBy(
        F.lower("domain").alias("_domain")
    ).agg(F.min("company_id").alias("_by_domain"))
    by_alias = aliases.groupBy("user_id", F.col("alias").alias("_alias")).agg(
        F.min("company_id").alias("_by_alias")
    )
    # The stored name keeps its legal form here, so a spelling with one differs from one without.
    stored = F.regexp_replace(F.lower("canonical_name"), "[^a-z0-9]+", "")
    by_name = companies.groupBy(stored.alias("_alias")).agg(F.min("company_id").alias("_by_name"))
    rows = (
        rows.join(by_domain, "_domain", "left")
        .join(by_alias, ["user_id", "_alias"], "left")
        .join(by_name, "_alias", "left")
    )
    found = F.coalesce("_by_domain", "_by_alias", "_by_name")
    fresh = F.xxhash64(F.lower("_name"), F.coalesce("_domain", F.lit("")))
    rows = rows.withColumn("company_id", F.coalesce(found, fresh)).withColumn("_new", found.isNull())
    created = rows.filter("_new").groupBy("company_id").agg(
        F.min("_name").alias("canonical_name"), F.min("_domain").alias("domain")
    )
    by_name_only = F.col("_by_domain").isNull() & F.col("_by_alias").isNull() & F.col("_by_name").isNotNull()
    spellings = F.when(F.col("_new"), alias_keys(F.col("_alias"), F.col("_name"))).when(
        by_name_only, F.array("_alias")
    )
    recorded = (
        rows.select("user_id", "company_id", F.explode(spellings).alias("alias"))
        .groupBy("user_id", "alias")
        .agg(F.min("company_id").alias("company_id"))
        .join(aliases.select("user_id", "alias"), ["user_id", "alias"], "left_anti")
        .select("user_id", "company_id", "alias")
    )
    return rows.select(*signals.columns, "company_id"), created, recorded


# --- thread ---------------------------------------------------------------------------------


def identify_by_thread(signals: DataFrame, threads: DataFrame) -> DataFrame:
    """The case of a signal's thread: the hint it carries, else the newest case on the thread."""
    known = threads.select("user_id", "thread_id", F.col("case_id").alias("_on_thread"))
    return signals.join(known, ["user_id", "thread_id"], "left").select(
        *[c for c in signals.columns], F.coalesce("case_hint", "_on_thread").alias("thread_case_id")
    )


# --- attaching to a case -----------------------------------------------------------------------


def _texts(df: DataFrame, text: Column) -> DataFrame:
    """The different texts of each block with their vectors."""
    return S.with_sparse_vector(df.select(*BLOCK, text.alias("vec_id")).distinct(), "vec_id")


def candidate_cases(cases: DataFrame) -> DataFrame:
    """Cases a signal may attach to."""
    return cases.filter(
        F.col("merged_into_id").isNull() & F.col("status").isin("live", "dormant")
    ).withColumn("_text", F.coalesce("role_normalised", "role_title", F.lit("")))


def blocked_similarity(
    signals: DataFrame, cases: DataFrame, t: float = C.ATTACH_SINGLE, per_text: int | None = None
) -> DataFrame:
    """Every signal beside every open case of its company at a cosine of at least t.

    Texts are compared once per block and expanded to their cases: all of them, or the first `per_text`, for a
    caller that needs no more of a text.
    """
    open_ = candidate_cases(cases)
    said = signals.withColumn("_text", _signal_text())
    pairs = S.similar_pairs(
        _texts(said, F.col("_text")), _texts(open_, F.col("_text")), BLOCK, t
    )
    few = open_.select(*BLOCK, F.col("_text").alias("right_id"), "case_id")
    if per_text is not None:
        few = top_per_key(few, [*BLOCK, "right_id"], [F.col("case_id")], per_text, "_n")
    return (
        said.select("signal_id", *BLOCK, F.col("_text").alias("left_id"))
        .join(pairs, [*BLOCK, "left_id"])
        .join(few, [*BLOCK, "right_id"])
        .select("signal_id", *BLOCK, "case_id", "cosine")
    )


def _signal_text() -> Column:
    return F.coalesce(
        F.nullif("role_normalised", F.lit("")), F.nullif("role", F.lit("")), F.lit("unknown")
    )


def _names_role() -> Column:
    return (F.coalesce("role", F.lit("")) != "") & (
        F.trim(F.coalesce("role_normalised", F.lit(""))) != ""
    )


def attach_decision(signals: DataFrame, cases: DataFrame) -> DataFrame:
    """attach, ambiguous or create for every signal.

    `signals`: signal_id, user_id, company_id, role, role_normalised. The answer carries the
    case, its cosine, and for an ambiguous one the three best cases.
    """
    open_ = candidate_cases(cases)
    size = open_.groupBy(*BLOCK).agg(F.count("*").alias("_n"), F.min("case_id").alias("_only"))
    rows = signals.join(size, BLOCK, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rows = rows.withColumn("_named", _names_role())
    scored = blocked_similarity(
        rows.filter(F.col("_named") & (F.col("_n") > 0)), cases, per_text=C.AMBIGUOUS_SHORTLIST
    )
    best = top_per_key(
        scored, ["signal_id"], [F.col("cosine").desc(), F.col("case_id")], C.AMBIGUOUS_SHORTLIST, "_r"
    )
    picked = best.groupBy("signal_id").agg(
        F.max(F.when(F.col("_r") == 1, F.struct("case_id", "cosine"))).alias("_first"),
        F.max(F.when(F.col("_r") == 2, F.col("cosine"))).alias("_second"),
    )
    rows = rows.join(picked, "signal_id", "left")
    cos, n = F.col("_first.cosine"), F.col("_n")
    close = cos - F.coalesce("_second", F.lit(-1.0)) < C.AMBIGUITY_MARGIN
    decision = (
        F.when(n == 0, "create")
        .when(~F.col("_named"), F.when(n == 1, "attach").otherwise("ambiguous"))
        .when(n == 1, F.when(cos >= C.ATTACH_SINGLE, "attach").otherwise("create"))
        .when(cos.isNull() | (cos < C.ATTACH_MULTI), "create")
        .when(close, "ambiguous")
        .otherwise("attach")
    )
    rows = rows.withColumn("decision", decision).withColumn(
        "case_id", F.when(F.col("decision") == "attach", F.coalesce("_first.case_id", "_only"))
    ).withColumn(
        "cosine",
        F.when(F.col("decision") == "attach", F.when(F.col("_named"), cos).otherwise(1.0)),
    )
    return rows.select(*signals.columns, "decision", "case_id", "cosine")


def ambiguous_shortlist(decided: DataFrame, cases: DataFrame) -> DataFrame:
    """The three best cases of each ambiguous signal: (signal_id, position, case_id, cosine).

    Asked only for ambiguous signals, and once per block and text, from the most similar texts downwards.
    """
    open_ = candidate_cases(cases)
    asked = kept(decided.filter(F.col("decision") == "ambiguous").withColumn("_text", _signal_text()))
    few = kept(top_per_key(
        open_.select(*BLOCK, "_text", "case_id"), [*BLOCK, "_text"], [F.col("case_id")],
        C.AMBIGUOUS_SHORTLIST, "_n",
    ))
    texts = kept(_texts(asked, F.col("_text")))
    wanted = few.join(asked.select(*BLOCK).distinct(), BLOCK, "left_semi")
    counts = wanted.groupBy(*BLOCK, F.col("_text").alias("vec_id")).agg(F.count("*").alias("n"))
    known = kept(_texts(wanted, F.col("_text")).join(counts, [*BLOCK, "vec_id"]))
    scored = kept(S.top_pairs(texts, known, BLOCK, C.AMBIGUOUS_SHORTLIST).select(
        *BLOCK, F.col("left_id").alias("_asked"), F.col("right_id").alias("_known"), "cosine"
    ))
    top = top_per_key(
        scored, [*BLOCK, "_asked"], [F.col("cosine").desc(), F.col("_known")],
        C.AMBIGUOUS_SHORTLIST, "_r",
    )
    # Three texts hold at least three cases, or all there are; texts that tie are kept apart by id.
    ties = scored.join(
        top.groupBy(*BLOCK, "_asked").agg(F.min("cosine").alias("_least")), [*BLOCK, "_asked"]
    ).filter(F.col("cosine") >= F.col("_least"))
    expanded = ties.join(few.withColumnRenamed("_text", "_known"), [*BLOCK, "_known"]).select(
        *BLOCK, F.col("_asked").alias("_text"), "case_id", "cosine"
    )
    best = top_per_key(
        expanded, [*BLOCK, "_text"], [F.col("cosine").desc(), F.col("case_id")],
        C.AMBIGUOUS_SHORTLIST, "position",
    )
    return asked.select("signal_id", *BLOCK, "_text").join(best, [*BLOCK, "_text"]).select(
        "signal_id", "position", "case_id", "cosine"
    )


# --- the same job found twice -----------------------------------------------------------------------


def merge_refusal(a: str, b: str, split: Column | None = None) -> Column:
    """Why two cases must stay apart, null when they may merge: the first reason of the one, then of the other, then
    of both. `split` tells whether a person pulled the two apart."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    mode = filled(f"{a}.work_mode") != filled(f"{b}.work_mode")
    country = N.country_of(filled(f"{a}.location")) != N.country_of(filled(f"{b}.location"))
    out = None
    for x in (a, b):
        for test, reason in (
            (F.col(f"{x}.current_stage").isin(*C.UNMERGEABLE_STAGES), T.APART_OFFER),
            (F.col(f"{x}.status") == "accepted", T.APART_ACCEPTED),
            (F.col(f"{x}.manually_created"), T.APART_BY_HAND),
        ):
            out = F.when(test, reason) if out is None else out.when(test, reason)
    out = out.when(mode, T.APART_MODE).when(country, T.APART_COUNTRY)
    return out if split is None else out.when(split, T.APART_SPLIT)


_MODES = ("onsite", "hybrid", "remote")
_WHERE = ("it", "de", "gb", "fr", "es", "nl", "unknown")


def _compatible(value: Column, known: tuple[str, ...]) -> Column:
    """The values a partner may have: nothing, or the same; anything when there is none here."""
    every = F.array(*[F.lit(v) for v in (*known, "")])
    return F.when(value == "", every).otherwise(F.array(value, F.lit("")))


def find_duplicates(cases: DataFrame, splits: DataFrame) -> DataFrame:
    """For each case the case it duplicates: (user_id, company_id, case_id, partner_id, cosine,
    keep, merge).

    Partners are live or dormant, at the same company, with a cosine of 0.93 or more between
    their roles, applied for within fourteen days, and nothing forbids the merge. The best one has
    the highest cosine, then the nearest date, then the smallest id.

    Roles are compared once per text. Within a text, only the instants are compared at which cases of a company that share work
    mode and country were applied for: an instant looks at itself, at the nearest one before and at the nearest one after, and there
    at the two smallest ids, in every group that exists and may merge with its own. All cases of one group and instant see the
    same partners, of which each takes the best that is not itself. So a text that very many cases share is never paired with itself,
    nor ordered in one task.
    Cases that a person has split from others pass over the instants at which there is nobody else.
    """
    mode = F.coalesce("work_mode", F.lit(""))
    land = F.coalesce(N.country_of(F.nullif("location", F.lit(""))), F.lit(""))
    able = candidate_cases(cases).filter(
        ~F.col("current_stage").isin(*C.UNMERGEABLE_STAGES) & ~F.col("manually_created")
        & (F.col("_text") != "")
    ).select(
        *BLOCK, "case_id", F.unix_micros("applied_at").alias("_t"), F.col("_text").alias("text"),
        mode.alias("mode"), land.alias("land"),
    )
    # Read several times below: written once.
    able = kept(able)
    texts = kept(_texts(able, F.col("text")))
    pairs = kept(S.similar_pairs(texts, texts, BLOCK, C.MERGE_COSINE))
    group = [*BLOCK, "text", "mode", "land"]
    # Every group asks in each group there is of a similar text whose mode and country agree with its own.
    seat = ["_text", "_mode", "_land"]
    kinds = kept(able.select(*group).distinct())
    agrees = (
        kinds.join(pairs.withColumnRenamed("left_id", "text"), [*BLOCK, "text"])
        .select(
            *BLOCK, F.col("text").alias("_text"), F.col("mode").alias("_mode"), F.col("land").alias("_land"),
            F.round("cosine", 12).alias("cosine"), F.col("right_id").alias("text"),
            F.explode(_compatible(F.col("mode"), _MODES)).alias("mode"), "land",
        )
        .withColumn("land", F.explode(_compatible(F.col("land"), _WHERE)))
    )
    agrees = kept(agrees.join(kinds, group, "left_semi"))

    def asking(rows: DataFrame) -> DataFrame:
        """Rows of a group, each with the groups it asks in as the group."""
        return rows.withColumnsRenamed(dict(zip(group[len(BLOCK):], seat, strict=True))).join(agrees, [*BLOCK, *seat])

    apart = splits.select("user_id", "case_id", "other_id").unionByName(
        splits.select("user_id", F.col("other_id").alias("case_id"), F.col("case_id").alias("other_id"))
    ).distinct()
    wary = apart.select("user_id", "case_id").distinct()
    plain = able.join(wary, ["user_id", "case_id"], "left_anti")
    careful = kept(asking(able.join(wary, ["user_id", "case_id"], "left_semi")).drop(*seat))
    # The groups and instants of cases nobody has split; one without a date is an instant too.
    spots = kept(asking(plain.select(*group, "_t").distinct()))
    window_us = C.MERGE_WINDOW_DAYS * 86_400_000_000
    dated, undated = able.filter("_t IS NOT NULL"), able.filter("_t IS NULL")
    ids = F.col("case_id").alias("partner_id")
    instants = kept(dated.groupBy(*group, "_t").agg(F.count("*").alias("_n")))
    asked = spots.select(*group, "_t").unionByName(careful.select(*group, "_t")).filter("_t IS NOT NULL").distinct()
    near = kept(nearest_points(asked.unionByName(instants.select(*group, "_t")).distinct(), instants, group, "_t",
                               slice_of=F.floor(F.col("_t") / 3_600_000_000)))

    def told(looks: DataFrame, first: DataFrame) -> DataFrame:
        """Asks with the instant `_at` they look at, beside the ids there."""
        gap = F.abs(F.col("_at") - F.col("_t"))
        there = first.withColumnRenamed("_t", "_at")
        return looks.filter(gap <= window_us).join(there, [*group, "_at"]).withColumn("_gap", gap).drop("_at")

    def without_date(who: DataFrame, anyone: DataFrame, dateless: DataFrame) -> DataFrame:
        """Without a date on either side there is no window to fall outside of."""
        met = who.filter("_t IS NULL").join(anyone, group).unionByName(who.filter("_t IS NOT NULL").join(dateless, group))
        return met.withColumn("_gap", F.lit(None).cast("bigint"))

    def firsts(n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The n smallest ids of each instant, of each group, and of the undated of each group."""
        few = lambda df, keys: top_per_key(df.select(*keys, ids), keys, [F.col("partner_id")], n, "_rank").drop("_rank")
        return few(dated, [*group, "_t"]), few(able, group), few(undated, group)

    at_once, anyone, dateless = firsts(2)
    looks = spots.filter("_t IS NOT NULL").join(near, [*group, "_t"]).withColumn("_at", F.explode(F.array("_t", "before", "after")))
    seen = told(looks.drop("before", "after"), at_once).unionByName(without_date(spots, anyone, dateless))
    far = F.coalesce("_gap", F.lit(2**62))
    order = F.struct((-F.col("cosine")).alias("c"), far.alias("g"))
    # Of a spot the two best partners, as one of them may be the case that asks.
    spot = [*BLOCK, *seat, "_t"]
    once = seen.filter("partner_id IS NOT NULL").groupBy(*spot, "partner_id").agg(
        F.min_by(F.struct("cosine", "_gap"), order).alias("_p")
    ).select(*spot, "partner_id", "_p.*")
    two = top_per_key(once, spot, [-F.col("cosine"), far, F.col("partner_id")], 2, "_rank").drop("_rank")
    columns = [*BLOCK, "case_id", "partner_id", "cosine", "_gap"]

    # No instant lies so far back: it stands for none, so that one join hands the partners back.
    when = F.coalesce("_t", F.lit(-(2**63)))
    back = two.withColumn("_when", when).drop("_t").withColumnsRenamed(dict(zip(seat, group[len(BLOCK):], strict=True)))
    found = plain.withColumn("_when", when).join(back, [*group, "_when"]).filter("case_id <> partner_id").select(*columns)
    most = apart.groupBy("user_id", "case_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if most:
        # Among so many ids one is neither the case nor a case it was split from.
        at_once, anyone, dateless = firsts(most + 2)
        looks = _past_named(careful.filter("_t IS NOT NULL"), apart, dated, instants, near, group, window_us)
        named = apart.withColumnRenamed("other_id", "partner_id")
        careful_found = told(looks, at_once).select(*columns).unionByName(without_date(careful, anyone, dateless).select(*columns))
        careful_found = careful_found.filter("case_id <> partner_id")
        found = found.unionByName(careful_found.join(named, ["user_id", "case_id", "partner_id"], "left_anti"))
    best = first_per_key(
        found, [*BLOCK, "case_id"], F.struct((-F.col("cosine")).alias("c"), far.alias("g"), "partner_id")
    )
    dates = able.select(F.col("case_id").alias("_id"), F.col("_t").alias("_at"), "user_id")
    out = best.join(dates.withColumnsRenamed({"_id": "case_id", "_at": "_mine"}), ["user_id", "case_id"]).join(
        dates.withColumnsRenamed({"_id": "partner_id", "_at": "_theirs"}), ["user_id", "partner_id"]
    )
    rank = lambda at, id_: F.struct(F.col(at).isNull().alias("n"), F.col(at).alias("t"), F.col(id_).alias("i"))
    mine = rank("_mine", "case_id") < rank("_theirs", "partner_id")
    return out.select(
        *BLOCK, "case_id", "partner_id", "cosine",
        F.when(mine, F.col("case_id")).otherwise(F.col("partner_id")).alias("keep"),
        F.when(mine, F.col("partner_id")).otherwise(F.col("case_id")).alias("merge"),
    )


def _past_named(
    asks: DataFrame, apart: DataFrame, dated: DataFrame, instants: DataFrame, near: DataFrame, group: list[str], window_us: int
) -> DataFrame:
    """Asks of split cases with the instants `_at` they look at: their own, and the nearest before and after it with somebody else.

    An instant is passed over when all its cases are the asking one or those it was split from. Every round moves the
    asks that stand on such an instant one further, so there are as many as such instants lie in a row.
    """
    shut = apart.select("user_id", "case_id", "other_id").unionByName(
        asks.select("user_id", "case_id", F.col("case_id").alias("other_id")).distinct()
    )
    places = dated.select("user_id", F.col("case_id").alias("other_id"), *group[1:], F.col("_t").alias("_at"))
    closed = (
        shut.join(places, ["user_id", "other_id"]).groupBy("case_id", *group, "_at").agg(F.count_distinct("other_id").alias("_shut"))
        .join(instants.withColumnRenamed("_t", "_at"), [*group, "_at"]).filter("_shut >= _n").select("case_id", *group, "_at")
    )
    closed = kept(closed.withColumn("_closed", F.lit(True)))
    steps = near.withColumnsRenamed({"_t": "_at", "before": "_down", "after": "_up"})
    start = asks.join(near, [*group, "_t"])
    own = start.withColumn("_at", F.col("_t")).drop("before", "after")
    moving = kept(start.select(*asks.columns, F.explode(F.array(
        F.struct(F.col("before").alias("_at"), F.lit(True).alias("_back")), F.struct(F.col("after").alias("_at"), F.lit(False).alias("_back"))
    )).alias("_m")).select(*asks.columns, "_m.*"))
    looks = own
    while True:
        inside = moving.filter(F.col("_at").isNotNull() & (F.abs(F.col("_at") - F.col("_t")) <= window_us))
        seen = kept(inside.join(closed, ["case_id", *group, "_at"], "left"))
        looks = looks.unionByName(seen.filter("_closed IS NULL").select(*own.columns))
        stuck = seen.filter("_closed")
        if stuck.isEmpty():
            return looks
        moving = kept(stuck.drop("_closed").join(steps, [*group, "_at"]).withColumn(
            "_at", F.when(F.col("_back"), F.col("_down")).otherwise(F.col("_up"))
        ).select(*asks.columns, "_at", "_back"))


def pairwise_duplicates(cases: DataFrame, t: float = C.MERGE_COSINE) -> DataFrame:
    """Pairs of different role texts of a company that say the same: (left_text, right_text)."""
    texts = kept(_texts(candidate_cases(cases).filter(F.col("_text") != ""), F.col("_text")))
    pairs = S.similar_pairs(texts, texts, BLOCK, t).filter(F.col("left_id") < F.col("right_id"))
    return pairs.withColumnsRenamed({"left_id": "left_text", "right_id": "right_text"})


def merge_roots(merges: DataFrame) -> DataFrame:
    """Follow chains of merges to the case that stays: (user_id, merge, keep).

    A case that would go into several goes into the smallest. Every round doubles the distance a
    pointer reaches and is written out, so a chain of a million needs twenty of them.
    """
    step = merges.groupBy("user_id", "merge").agg(F.min("keep").alias("keep"))
    step = cut_lineage(step)
    # No chain is longer than there are merges, so pointers that still move after that many doublings run in a circle.
    for _ in range(step.count().bit_length() + 1):
        onward = step.select("user_id", F.col("merge").alias("keep"), F.col("keep").alias("_next"))
        jumped = step.join(onward, ["user_id", "keep"], "left").select(
            "user_id", "merge", F.coalesce("_next", "keep").alias("keep"),
            F.col("_next").isNotNull().alias("_moved"),
        )
        jumped = cut_lineage(jumped)
        if jumped.filter("_moved").limit(1).count() == 0:
            return jumped.drop("_moved")
        step = jumped.drop("_moved")
    raise RuntimeError("merges form a circle")


def apply_merges(
    cases: DataFrame, sources: DataFrame, duplicates: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases with merged_into_id, sources of the case that stays, undo questions)."""
    roots = merge_roots(duplicates.select("user_id", "merge", "keep").distinct())
    into = roots.select("user_id", F.col("merge").alias("case_id"), F.col("keep").alias("_root"))
    merged = cases.join(into, ["user_id", "case_id"], "left").withColumn(
        "merged_into_id", F.coalesce("_root", "merged_into_id")
    ).drop("_root")
    moved = sources.join(into, ["user_id", "case_id"], "left").withColumn(
        "case_id", F.coalesce("_root", "case_id")
    ).drop("_root")
    undo = into.join(
        duplicates.groupBy("user_id", F.col("merge").alias("case_id")).agg(F.max("cosine").alias("cosine")),
        ["user_id", "case_id"],
    ).select(
        "user_id",
        F.lit("merge_undo").alias("kind"),
        F.col("_root").alias("case_id"),
        F.to_json(F.struct(F.col("case_id").alias("merged"), F.col("_root").alias("kept"), "cosine"))
        .alias("candidates"),
        plus_days(now, C.MERGE_UNDO_DAYS).alias("expires_at"),
    )
    return merged, moved, undo


# --- events and questions -----------------------------------------------------------------------------


def events_for_signals(signals: DataFrame) -> DataFrame:
    """The events a placed signal stands for: none, one or two.

    `signals` carries case_id beside the columns of screening.build_signals.
    """
    intent, invite = F.col("intent"), F.col("invite")
    none = F.lit(None)
    common = {
        "thread_id": F.col("thread_id"), "role_title": F.col("role"), "seniority": F.col("seniority"),
        "location": F.col("location"), "work_mode": F.col("work_mode"), "channel": F.col("channel"),
    }
    kinds = {
        "status": "string", "stage": "string", "note": "string", "ats_vendor": "string",
        "posting_url": "string", "after_stage": "string", "min_minor": "bigint",
        "max_minor": "bigint", "currency": "string", "kind": "string", "due_at": "string",
        "url": "string", "source": "string", "starts_at": "timestamp", "ends_at": "timestamp",
        "calendar_event_id": "string",
    }

    def event(event_type: str, to_stage=none, **facts) -> Column:
        fields = {**common, **{k: none.cast(t) for k, t in kinds.items()}}
        fields.update({k: v.cast(kinds[k]) if k in kinds else v for k, v in facts.items()})
        payload = F.struct(*[v.alias(k) for k, v in fields.items()])
        return F.struct(
            F.lit(event_type).alias("type"), to_stage.cast("string").alias("to_stage"), payload.alias("payload")
        )

    cancelled = intent == "interview_cancelled"
    round_ = F.when(~cancelled, F.coalesce("stage_hint", F.lit(C.UNSPECIFIED_INTERVIEW)))
    meeting = event(
        "interview_scheduled", round_, stage=round_,
        status=F.when(cancelled, "cancelled").otherwise("confirmed"),
        starts_at=invite["starts_at"], ends_at=invite["ends_at"],
        location=F.when(invite.isNotNull(), invite["location"]).otherwise(F.col("location")),
        calendar_event_id=invite["uid"],
    )
    currency = F.coalesce("comp_currency", F.lit("EUR"))
    due = event(
        "deadline_set", kind=F.lit("take_home"), due_at=F.col("deadline"), url=F.col("posting_url"),
        source=F.coalesce("ats_vendor", F.lit("gmail")),
    )
    task = event("stage_advanced", F.lit("take_home"))
    has_due = F.coalesce("deadline", F.lit("")) != ""
    events = (
        F.when(intent == "applied", F.array(
            event("applied", F.lit("applied"), posting_url=F.col("posting_url"))))
        .when(intent == "acknowledged", F.array(
            event("acknowledged", F.lit("acknowledged"), ats_vendor=F.col("ats_vendor"))))
        .when(intent == "schedule_screening", F.array(event(
            "stage_advanced", F.coalesce("stage_hint", F.lit("recruiter_reachout")),
            note=F.lit("availability requested"))))
        .when((intent == "interview_invite") | (cancelled & invite.isNotNull()), F.array(meeting))
        .when((intent == "take_home") & has_due, F.array(task, due))
        .when(intent == "take_home", F.array(task))
        .when(intent == "rejected", F.array(event("rejected", after_stage=F.col("stage_hint"))))
        .when(intent == "offer", F.array(event(
            "offer_received", F.lit("offer"), min_minor=F.col("comp_min_minor"),
            max_minor=F.col("comp_max_minor"), currency=currency)))
        .when(intent == "negotiation", F.array(event(
            "offer_negotiated", F.lit("negotiating"), min_minor=F.col("comp_min_minor"),
            currency=currency)))
    )
    return signals.select(
        "user_id", "case_id", "occurred_at", "confidence", "evidence_ref", "rung",
        F.posexplode(events).alias("ord", "e"),
        F.when(F.coalesce("channel", F.lit("")) != "", F.struct(
            "channel", "posting_url", "ats_vendor", (intent == "applied").alias("claims_first_touch")
        )).alias("source"),
    ).select(
        "user_id", "case_id", "e.type", "occurred_at", "confidence", "e.to_stage", "evidence_ref",
        "rung", "ord", "e.payload", "source",
    )


def review_items(
    readings: DataFrame, decided: DataFrame, cancelled: DataFrame, stored: DataFrame,
    shortlist: DataFrame | None = None, cases: DataFrame | None = None,
) -> DataFrame:
    """Questions to raise, once per open (tenant, kind, evidence).

    `readings`: those a person must look at; `decided`: ambiguous signals; `cancelled`: placed
    cancellations; `stored`: questions so far. With the `shortlist` of ambiguous_shortlist and the `cases`, an
    ambiguous item carries its candidates as JSON, best first: case, role, stage, date and cosine.
    """
    none, no_candidates = F.lit(None).cast("bigint"), F.lit(None).cast("string").alias("candidates")
    unread = readings.filter(F.col("reading") == "review").select(
        "user_id", F.lit("unknown_intent").alias("kind"), F.col("message_id").alias("evidence_ref"),
        none.alias("case_id"), "excerpt", no_candidates,
    )
    torn = decided.filter(F.col("decision") == "ambiguous")
    if shortlist is None:
        torn = torn.withColumn("candidates", no_candidates)
    else:
        told = cases.select("user_id", "case_id", "role_title", F.col("current_stage").alias("stage"), "applied_at")
        # At most as many as the shortlist names for a signal.
        listed = shortlist.join(torn.select("user_id", "signal_id"), "signal_id").join(told, ["user_id", "case_id"]).groupBy(
            "user_id", "signal_id"
        ).agg(
            F.to_json(F.transform(
                F.sort_array(F.collect_list(F.struct("position", "case_id", "role_title", "stage", "applied_at", "cosine"))),
                lambda c: F.struct(
                    c["case_id"].alias("case_id"), c["role_title"].alias("role_title"), c["stage"].alias("stage"),
                    iso_z(c["applied_at"]).alias("applied_at"), c["cosine"].alias("cosine"),
                ),
            )).alias("candidates")
        )
        torn = torn.join(listed, ["user_id", "signal_id"], "left")
    torn = torn.select(
        "user_id", F.lit("ambiguous_match").alias("kind"), "evidence_ref", none.alias("case_id"), "excerpt", "candidates"
    )
    off = cancelled.select(
        "user_id", F.lit("unknown_intent").alias("kind"), "evidence_ref", "case_id",
        F.lit(T.CANCELLED_QUESTION).alias("excerpt"), no_candidates,
    )
    return raise_once(unread.unionByName(torn).unionByName(off), stored)


def raise_once(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items whose question is not already open."""
    key = ["user_id", "kind", "evidence_ref"]
    one = first_per_key(
        items, key, F.struct(F.coalesce("case_id", F.lit(-1)), F.coalesce("excerpt", F.lit("")))
    )
    still_open = stored.filter(F.col("resolved_at").isNull()).select(*key)
    return one.join(still_open, key, "left_anti")


def resolve_review(stored: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions after the answers, events that undo merges).

    `answers`: review_id, choice, learn, at. An answered question keeps its kind and the kind of
    the answer, and no text.
    """
    valid = answers.filter(F.col("choice").isin("application", "new_application", "intent", "undo_merge"))
    first = first_per_key(valid, ["review_id"], F.struct("at", "choice"))
    rows = stored.join(first, "review_id", "left")
    answered = F.col("choice").isNotNull() & F.col("resolved_at").isNull()
    undo = rows.filter(answered & (F.col("choice") == "undo_merge")).select(
        "user_id",
        F.get_json_object("candidates", "$.kept").cast("bigint").alias("case_id"),
        F.lit("human_corrected").alias("type"),
        F.col("at").alias("occurred_at"),
        F.lit(1.0).alias("confidence"),
        F.lit("merge").alias("field"),
        F.lit("split").alias("to"),
        F.get_json_object("candidates", "$.merged").alias("merged_id"),
    ).filter(F.col("case_id").isNotNull() & F.col("merged_id").isNotNull())
    pattern = F.to_json(F.struct("kind", F.col("choice").alias("answer")))
    after = rows.select(
        *[c for c in stored.columns if c not in ("excerpt", "resolved_at", "learned_pattern")],
        F.when(answered, None).otherwise(F.col("excerpt")).alias("excerpt"),
        F.when(answered, F.col("at")).otherwise(F.col("resolved_at")).alias("resolved_at"),
        F.when(answered & F.col("learn"), pattern).alias("learned_pattern"),
    )
    return after, undo


# --- a whole batch ----------------------------------------------------------------------------------------


def _openers(opened: DataFrame) -> DataFrame:
    """Which text each new text joins, itself when it opens a case.

    In the order of their first signal, a text joins the closest earlier one that opened a case,
    or opens one. Openers are the greedy leaders of the close pairs.
    """
    texts = S.with_sparse_vector(
        opened.select(*BLOCK, F.col("_text").alias("vec_id"), "_since"), "vec_id"
    )
    since = texts.select(*BLOCK, F.col("vec_id").alias("_id"), "_since")
    close = (
        S.similar_pairs(texts, texts, BLOCK, C.ATTACH_MULTI)
        .join(since.withColumnsRenamed({"_id": "left_id", "_since": "_l"}), [*BLOCK, "left_id"])
        .join(since.withColumnsRenamed({"_id": "right_id", "_since": "_r"}), [*BLOCK, "right_id"])
        .filter(F.col("_r") < F.col("_l"))
        .select(
            F.struct(*BLOCK, F.col("left_id").alias("_text")).alias("v"), F.struct(*BLOCK, F.col("right_id").alias("_text")).alias("u"),
            "cosine", F.col("_r.occurred_at").alias("_first"),
        )
    )
    close = kept(close)
    led = greedy_leaders(opened.select(F.struct(*BLOCK, "_text").alias("v")), close.select("v", "u"))
    led = kept(led)
    leaders = led.filter("leads").select(F.col("v").alias("u"))
    joins = close.join(leaders, "u").groupBy("v").agg(
        F.max_by("u", F.struct("cosine", (-F.unix_micros("_first")).alias("first"))).alias("_joins")
    )
    return led.join(joins, "v", "left").select(
        *[F.col(f"v.{c}") for c in BLOCK], F.col("v._text").alias("_text"),
        F.when(F.col("leads"), F.col("v._text")).otherwise(F.col("_joins._text")).alias("_leads"),
    )


def place_signals(signals: DataFrame, cases: DataFrame, threads: DataFrame) -> DataFrame:
    """Every signal with the case it belongs to, or the question it raises.

    Signals carry company_id. The thread decides first, then the open cases of the company. What
    matches neither opens new cases: one per company and role text, and a text that is close
    enough to one that opened earlier joins it. The order is that of the events, not of arrival,
    so a replay gives the same cases.
    """
    rows = identify_by_thread(signals, threads)
    on_thread = rows.filter(F.col("thread_case_id").isNotNull())
    rest = rows.filter(F.col("thread_case_id").isNull())
    decided = cut_lineage(attach_decision(rest, cases))
    fresh = decided.filter(F.col("decision") == "create").withColumn("_text", _signal_text())
    opened = fresh.groupBy(*BLOCK, "_text").agg(F.min(F.struct("occurred_at", "signal_id")).alias("_since"))
    led = _openers(opened).select(
        *BLOCK, "_text", F.xxhash64("user_id", "company_id", "_leads").alias("_new_id")
    )
    made = fresh.join(led, [*BLOCK, "_text"])
    columns = [c for c in signals.columns]
    return (
        on_thread.select(*columns, F.lit("thread").alias("decision"), F.col("thread_case_id").alias("case_id"))
        .unionByName(decided.filter(F.col("decision") != "create").select(*columns, "decision", "case_id"))
        .unionByName(made.select(*columns, F.lit("create").alias("decision"), F.col("_new_id").alias("case_id")))
    )
