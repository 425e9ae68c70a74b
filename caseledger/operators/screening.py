"""From messages to readings: screening, vendor templates, phrases, model answers.

Messages carry `sender`, `subject`, `text`, `thread_id`, `list_id`, `list_unsubscribe`,
`precedence`, `invite`, `user_id`, `message_id` and `received_at`.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import names as N
from ..functions import text as X
from ..functions import vocab as V
from ..functions import wording as T
from ..functions.rules import BUILT_IN, Rule, positional, vendor_domains

READING = ("intent", "confidence", "rung", "company", "role", "stage_hint", "deadline")


# --- who writes ------------------------------------------------------------------------------


def vendor_of(messages: DataFrame, domains: DataFrame) -> DataFrame:
    """The vendor a sender belongs to: its domain or any parent of it, first rule wins.

    Every sender domain is expanded into its parents, which makes the suffix test an equality.
    """
    senders = messages.select("sender_domain").filter(F.col("sender_domain").isNotNull()).distinct()
    parents = senders.select("sender_domain", F.explode(X.suffixes(F.col("sender_domain"))).alias("domain"))
    found = parents.join(domains, "domain").groupBy("sender_domain").agg(
        F.min_by("vendor", "ord").alias("vendor")
    )
    return messages.join(found, "sender_domain", "left")


def screen_context(
    cases: DataFrame, companies: DataFrame, log: DataFrame, dropped: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is known about a tenant: (company domains, threads, newsletters)."""
    domains = (
        cases.join(companies.filter(F.col("domain").isNotNull()), "company_id")
        .select("user_id", F.lower("domain").alias("sender_domain"))
        .distinct()
    )
    threads = (
        log.filter(F.col("payload.thread_id").isNotNull())
        .select("user_id", F.col("payload.thread_id").alias("thread_id"))
        .distinct()
    )
    return domains, threads, learned_newsletters(dropped)


def learned_newsletters(dropped: DataFrame) -> DataFrame:
    """Sender domains a tenant has had dropped at least five times."""
    return (
        dropped.filter(F.coalesce("sender_domain", F.lit("")) != "")
        .groupBy("user_id", "sender_domain")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= C.NEWSLETTER_MIN_DROPS)
    )


def self_sent(messages: DataFrame, own: DataFrame) -> DataFrame:
    """Mark messages a tenant wrote. `own`: user_id, address."""
    mine = own.select("user_id", F.lower("address").alias("_address")).distinct().withColumn(
        "self_sent", F.lit(True)
    )
    return (
        messages.withColumn("_address", X.address_of(F.col("sender")))
        .join(mine, ["user_id", "_address"], "left")
        .drop("_address")
        .withColumn("self_sent", F.coalesce("self_sent", F.lit(False)))
    )


def calendar_relevance(events: DataFrame, domains: DataFrame) -> DataFrame:
    """Calendar items with somebody from a known company on them.

    `events`: user_id, event_id, organiser, attendees; `domains`: user_id, domain.
    """
    people = events.select(
        "user_id", "event_id",
        F.explode(
            F.array_distinct(F.concat(F.array("organiser"), F.coalesce("attendees", F.array())))
        ).alias("_who"),
    ).withColumn("domain", X.domain_of_address(F.col("_who")))
    known = people.join(domains.select("user_id", "domain").distinct(), ["user_id", "domain"], "left_semi")
    return events.join(known.select("user_id", "event_id").distinct(), ["user_id", "event_id"], "left_semi")


# --- the score --------------------------------------------------------------------------------


def screen(
    messages: DataFrame,
    *,
    domains: DataFrame,
    company_domains: DataFrame,
    threads: DataFrame,
    newsletters: DataFrame,
    opening_chars: int | None = None,
) -> DataFrame:
    """Score every message and decide whether it is read, read cheaply, or dropped.

    The vocabulary is looked for in the whole text, or in its first `opening_chars`.
    """
    rows = messages.withColumn("sender_domain", X.domain_of_address(F.col("sender")))
    rows = vendor_of(rows, domains)
    rows = rows.join(
        company_domains.select("user_id", "sender_domain").distinct().withColumn("_known", F.lit(True)),
        ["user_id", "sender_domain"], "left",
    ).join(
        threads.select("user_id", "thread_id").distinct().withColumn("_thread", F.lit(True)),
        ["user_id", "thread_id"], "left",
    ).join(
        newsletters.select("user_id", "sender_domain").distinct().withColumn("_news", F.lit(True)),
        ["user_id", "sender_domain"], "left",
    )
    sender, subject, text, domain = (F.col(c) for c in ("sender", "subject", "text", "sender_domain"))
    opening = F.concat(subject, F.lit("\n"), text if opening_chars is None else F.substring(text, 1, opening_chars))
    # Columns of their own: both are looked at again and again.
    rows = rows.withColumn("_opening", opening).withColumn("_low", F.lower("_opening"))
    opening, low = F.col("_opening"), F.col("_low")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    link = F.lit(False)
    for host in V.MEETING_HOSTS:
        link = link | F.contains(text, F.lit(host))
    rows = rows.select(
        *messages.columns, "sender_domain", "vendor",
        F.col("vendor").isNotNull().alias("_ats"),
        (F.col("list_unsubscribe").isNull() & flag("_known")).alias("_company"),
        flag("_thread").alias("_on_thread"),
        X.finds_if(opening, low, V.STRONG_KEYWORDS, V.STRONG_STEMS).alias("_strong"),
        X.finds_if(opening, low, V.WEAK_KEYWORDS, V.WEAK_STEMS).alias("_weak_word"),
        X.finds(subject, V.PLATFORM_NOISE).alias("_noise"),
        (link & ~X.under_any(domain, V.PERSONAL_MAIL)).alias("_link"),
        F.col("invite").isNotNull().alias("_invited"),
        (
            X.finds(F.coalesce("precedence", F.lit("")), V.BULK_PRECEDENCE)
            | F.col("list_id").isNotNull() | flag("_news")
        ).alias("_bulk"),
        X.under_any(domain, V.BULK_WHITELIST).alias("_white"),
        X.finds(F.element_at(F.split(sender, "<"), -1), V.NO_REPLY).alias("_robot"),
        X.under_any(domain, V.SOCIAL_NOISE).alias("_social"),
    )
    col = F.col
    weak = ~col("_strong") & col("_weak_word")
    meets = col("_invited") | col("_link")
    backed = col("_ats") | col("_company") | col("_on_thread") | meets
    waived = (col("_ats") | col("_white")) & ~col("_noise")
    points = (
        (col("_ats"), 3, T.REASON_VENDOR),
        (col("_company"), 3, T.REASON_COMPANY),
        (col("_strong"), 2, T.REASON_STRONG),
        (weak & backed, 2, T.REASON_WEAK_BACKED),
        (weak & ~backed, 1, T.REASON_WEAK),
        (col("_on_thread"), 2, T.REASON_THREAD),
        (col("_invited"), 2, T.REASON_INVITE),
        (~col("_invited") & col("_link"), 2, T.REASON_MEETING),
        (col("_bulk") & ~waived, -4, T.REASON_BULK),
        (col("_bulk") & waived, 0,
         T.REASON_WAIVED),
        (col("_noise"), -4, T.REASON_NOISE),
        (col("_robot") & ~(col("_strong") | weak), -3, T.REASON_ROBOT),
        (col("_social"), -2, T.REASON_SOCIAL),
    )
    score = sum((F.when(test, n).otherwise(0) for test, n, _ in points[1:]),
                F.when(points[0][0], points[0][1]).otherwise(0))
    reasons = F.array_compact(
        F.array(*[F.when(test, f"{n:+d} {why}" if n else why) for test, n, why in points])
    )
    out = rows.withColumn("score", score).withColumn("reasons", reasons)
    outcome = (
        F.when(col("score") >= C.SCREEN_PASS, "pass")
        .when(col("score") >= C.SCREEN_CHEAP_ONLY, "cheap_only")
        .otherwise("drop")
    )
    return out.select(
        *messages.columns, "sender_domain", "vendor", "score", "reasons", outcome.alias("outcome")
    )


# --- the rungs -----------------------------------------------------------------------------------


def _haystack() -> Column:
    return F.concat(F.col("subject"), F.lit("\n"), F.col("text"))


def _with_haystack(messages: DataFrame) -> DataFrame:
    """Subject and text as `_hay`, and in lower case as `_low`: columns of their own, as they are looked at again and again."""
    return messages.withColumn("_hay", _haystack()).withColumn("_low", F.lower("_hay"))


def _header_test(rule: Rule) -> Column:
    ok = F.lit(True)
    for name, wanted in rule.headers:
        key = name.lower().replace("-", "_")
        actual = F.col({"from": "sender"}.get(key, key))
        ok = ok & (actual.isNotNull() if wanted is None else F.contains(actual, F.lit(wanted)))
    return F.coalesce(ok, F.lit(False))


def template_index(rules: tuple[Rule, ...] = BUILT_IN) -> Column:
    """rule * 100 + pattern for the first template of the sender's vendor that fits.

    -1 for a vendor none of whose templates fit; null where no vendor writes. The patterns are
    literals, so each is compiled once and only those of one vendor are tried on a message.
    """
    out = None
    for i, rule in enumerate(rules):
        inner = None
        for j, p in enumerate(rule.patterns):
            hit = F.lit(True)
            if p.subject:
                hit = hit & X.finds(F.col("subject"), positional(p.subject)[0])
            if p.body:
                hit = hit & X.finds(F.col("text"), positional(p.body)[0])
            inner = F.when(hit, i * 100 + j) if inner is None else inner.when(hit, i * 100 + j)
        mine = (F.col("vendor") == rule.vendor) & _header_test(rule)
        chosen = inner.otherwise(-1)
        out = F.when(mine, chosen) if out is None else out.when(mine, chosen)
    return out


def _captured(index: Column, name: str, rules: tuple[Rule, ...]) -> Column:
    """A named field of the template that fits."""
    out = F.when(index.isNull(), None)
    for i, rule in enumerate(rules):
        for j, p in enumerate(rule.patterns):
            value = None
            if p.subject and name in (groups := positional(p.subject)[1]):
                value = X.strip(X.first_group(F.col("subject"), positional(p.subject)[0], groups[name]))
            for key, extractor in p.extract:
                plain, groups = positional(extractor)
                if key == name:
                    found = X.strip(X.first_group(_haystack(), plain, groups.get(name, 1)))
                    value = found if value is None else F.coalesce(F.nullif(found, F.lit("")), value)
            if value is not None:
                out = out.when(index == i * 100 + j, F.nullif(value, F.lit("")))
    return out


def match_templates(messages: DataFrame, rules: tuple[Rule, ...] = BUILT_IN) -> DataFrame:
    """Rung 1: the templates of the sender's vendor, else the phrases. Adds `t_*` columns."""
    ats = vendor_domains(rules)
    rows = _with_haystack(messages).withColumn("_t", template_index(rules)).withColumn(
        "_ph", F.when(F.col("_t") == -1, N.phrase_index(F.col("_hay"), F.col("_low")))
    )
    t = F.col("_t")
    hit = (t >= 0) | F.col("_ph").isNotNull()
    rows = rows.select(
        "*",
        F.when(hit, N.company_from_sender(F.col("sender"), ats)).alias("_by_sender"),
        _captured(t, "company", rules).alias("_named"),
        _captured(t, "role", rules).alias("_role"),
    )
    flat = [(i * 100 + j, p) for i, r in enumerate(rules) for j, p in enumerate(r.patterns)]
    intents = F.expr("map(" + ", ".join(f"{k}, '{p.intent}'" for k, p in flat) + ")")
    sure = F.expr("map(" + ", ".join(f"{k}, {p.confidence}D" for k, p in flat) + ")")
    phrase = N.phrase_facts(F.col("_ph"))
    from_sender, from_domain = (
        [k for k, _ in flat if rules[k // 100].company_from == source]
        for source in ("sender_display_name", "sender_domain")
    )
    company = (
        F.when(t.isin(from_sender), F.coalesce("_by_sender", "_named"))
        .when(
            t.isin(from_domain),
            F.coalesce("_named", N.company_from_domain(F.col("sender_domain"), ats)),
        )
        .when(t >= 0, F.coalesce("_named", "_by_sender"))
        .otherwise(F.col("_by_sender"))
    )
    return rows.select(
        *messages.columns,
        F.when(t >= 0, intents[t]).otherwise(phrase["intent"]).alias("t_intent"),
        F.when(t >= 0, sure[t]).otherwise(phrase["confidence"]).alias("t_confidence"),
        company.alias("t_company"),
        F.when(hit, F.coalesce(F.col("_role"), N.role_from_body(F.col("_hay"), F.col("_low")))).alias("t_role"),
        _captured(t, "deadline", rules).alias("t_deadline"),
    )


def match_heuristics(messages: DataFrame, rules: tuple[Rule, ...] = BUILT_IN) -> DataFrame:
    """Rung 2: an invitation, or a phrase from somebody who is not a vendor. Adds `h_*` columns."""
    ats = vendor_domains(rules)
    invited = F.col("invite").isNotNull()
    cancelled = (F.col("invite.status") == "cancelled") | (F.col("invite.method") == "CANCEL")
    cancelled = F.coalesce(cancelled, F.lit(False))
    abstains = F.col("vendor").isNotNull() | X.under_any(F.col("sender_domain"), V.LEARNING_PLATFORMS)
    rows = _with_haystack(messages).withColumn(
        "_ph", F.when(~invited & ~abstains, N.phrase_index(F.col("_hay"), F.col("_low")))
    )
    phrase = N.phrase_facts(F.col("_ph"))
    return rows.select(
        *messages.columns,
        F.when(invited & cancelled, "interview_cancelled").when(invited, "interview_invite")
        .otherwise(phrase["intent"]).alias("h_intent"),
        F.when(invited & cancelled, V.CANCELLED_CONFIDENCE).when(invited, V.INVITE_CONFIDENCE)
        .when(F.col("_ph").isNotNull(), F.least(phrase["confidence"], F.lit(V.PHRASE_CEILING)))
        .alias("h_confidence"),
        F.when(invited, N.stage_from_title(F.col("invite.summary"))).alias("h_stage_hint"),
        F.when(invited, N.company_from_domain(F.col("invite.organiser"), ats))
        .when(F.col("_ph").isNotNull(), N.company_from_sender(F.col("sender"), ats)).alias("h_company"),
    )


def accept_model_answers(answers: DataFrame) -> DataFrame:
    """Landed model answers (message_id, answer JSON) to readings.

    An answer without a known intent or a number for its confidence, and one that is unclear,
    abstains. Confidence is clamped and discounted.
    """
    schema = (
        "intent string, confidence string, company string, role string, stage_hint string,"
        " deadline string, comp string"
    )
    a = F.from_json("answer", schema)
    number = F.when(
        F.get_json_object("answer", "$.confidence").isNotNull()
        & ~F.col("answer").rlike(r'"confidence"\s*:\s*"'),
        a["confidence"].try_cast("double"),
    )
    comp = lambda key: F.get_json_object("answer", f"$.comp.{key}")
    currency = N.clean_text(comp("currency"))
    minor = lambda key: F.when(
        currency.isNotNull(), N.comp_to_minor(comp(key).try_cast("double"))
    )
    ok = a["intent"].isin(*V.INTENTS) & number.isNotNull()
    return answers.filter(ok).select(
        "message_id",
        a["intent"].alias("intent"),
        (F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)) * C.MODEL_DISCOUNT).alias("confidence"),
        F.lit(3).alias("rung"),
        *[N.clean_text(a[c]).alias(c) for c in ("company", "role", "stage_hint", "deadline")],
        minor("min").alias("comp_min_minor"),
        minor("max").alias("comp_max_minor"),
        F.upper(currency).alias("comp_currency"),
    )


def run_ladder(
    screened: DataFrame,
    *,
    own: DataFrame | None = None,
    answers: DataFrame | None = None,
    rules: tuple[Rule, ...] = BUILT_IN,
) -> DataFrame:
    """One row per message: the first rung that reads it decides.

    Dropped messages are not read. Messages of the tenant are ignored. Without a reading, or
    with an unsure one, a person is asked. Model answers are not used for cheap messages.
    """
    rows = screened.filter(F.col("outcome") != "drop")
    rows = self_sent(rows, own) if own is not None else rows.withColumn("self_sent", F.lit(False))
    # Template and heuristic columns are computed lazily side by side; each is guarded by its own
    # test, so a message a template reads does not run through the phrases again.
    rows = match_heuristics(match_templates(rows, rules), rules)
    if answers is not None:
        model = accept_model_answers(answers).select(
            "message_id",
            *[F.col(c).alias(f"m_{c}") for c in
              ("intent", "confidence", "company", "role", "stage_hint", "deadline",
               "comp_min_minor", "comp_max_minor", "comp_currency")],
        )
        rows = rows.join(model, "message_id", "left")
    else:
        for c in ("intent", "company", "role", "stage_hint", "deadline", "comp_currency"):
            rows = rows.withColumn(f"m_{c}", F.lit(None).cast("string"))
        rows = rows.withColumn("m_confidence", F.lit(None).cast("double"))
        for c in ("comp_min_minor", "comp_max_minor"):
            rows = rows.withColumn(f"m_{c}", F.lit(None).cast("bigint"))
    one, two = F.col("t_intent").isNotNull(), F.col("h_intent").isNotNull()
    three = F.col("m_intent").isNotNull() & (F.col("outcome") != "cheap_only")

    def first(t, h, m) -> Column:
        col = lambda c: F.lit(None) if c is None else F.col(c)
        return F.when(one, col(t)).when(two, col(h)).when(three, col(m))

    rung = F.when(one, 1).when(two, 2).when(three, 3)
    sure = first("t_confidence", "h_confidence", "m_confidence")
    reading = F.when(F.col("self_sent"), "ignored").when(
        rung.isNull() | (sure < C.CONFIDENCE_FLOOR), "review"
    ).otherwise("extracted")
    quoted = X.excerpt(F.concat(F.lit('"'), F.col("text"), F.lit('" — '), F.col("sender")))
    return rows.select(
        *screened.columns,
        reading.alias("reading"),
        rung.alias("rung"),
        first("t_intent", "h_intent", "m_intent").alias("intent"),
        F.coalesce(sure, F.lit(0.0)).alias("confidence"),
        first("t_company", "h_company", "m_company").alias("company"),
        first("t_role", None, "m_role").alias("read_role"),
        first(None, "h_stage_hint", "m_stage_hint").alias("read_stage"),
        first("t_deadline", None, "m_deadline").alias("deadline"),
        *[first(None, None, f"m_{c}").alias(c) for c in ("comp_min_minor", "comp_max_minor", "comp_currency")],
        quoted.alias("excerpt"),
    )


def build_signals(readings: DataFrame, threads: DataFrame | None = None) -> DataFrame:
    """Extracted readings to signals. `threads` (user_id, thread_id, case_id) hints at the case."""
    rows = _with_haystack(readings.filter(F.col("reading") == "extracted"))
    role = F.coalesce("read_role", N.role_from_body(F.col("_hay"), F.col("_low")))
    rows = rows.withColumn("role", role)
    parts = N.normalise_role(F.col("role"))
    stage = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in V.STAGE_FOR_INTENT.items()) + ")")
    if threads is not None:
        rows = rows.join(
            threads.select("user_id", "thread_id", F.col("case_id").alias("case_hint")),
            ["user_id", "thread_id"], "left",
        )
    else:
        rows = rows.withColumn("case_hint", F.lit(None).cast("bigint"))
    return rows.select(
        "user_id", "message_id", "thread_id", F.col("message_id").alias("evidence_ref"),
        "sender_domain", "intent", "company", "role",
        parts["role"].alias("role_normalised"), parts["seniority"].alias("seniority"),
        parts["location"].alias("location"), parts["work_mode"].alias("work_mode"),
        F.coalesce("read_stage", stage[F.col("intent")]).alias("stage_hint"),
        F.coalesce("invite.starts_at", "received_at").alias("occurred_at"),
        "deadline", "comp_min_minor", "comp_max_minor", "comp_currency",
        X.detect_language(F.col("text")).alias("language"),
        "confidence", "rung", F.col("vendor").alias("ats_vendor"),
        N.channel_for_vendor(F.col("vendor"), F.col("sender_domain")).alias("channel"),
        N.posting_url(F.col("text")).alias("posting_url"),
        "invite", "excerpt", "case_hint",
    )


# --- reports over readings ------------------------------------------------------------------------


def replay_summary(screened: DataFrame, readings: DataFrame) -> DataFrame:
    """Counts over a replay: (measure, n)."""
    dropped = screened.agg(
        F.count("*").alias("messages"), F.count_if(F.col("outcome") == "drop").alias("dropped")
    ).select(F.explode(F.create_map(
        F.lit("messages"), F.col("messages"), F.lit("dropped"), F.col("dropped"))).alias("measure", "n"))
    got = F.col("reading") == "extracted"
    tests = {
        "extracted": got,
        "review": F.col("reading") == "review",
        "ignored": F.col("reading") == "ignored",
        "with_company": got & F.col("company").isNotNull(),
        "with_role": got & F.col("role").isNotNull(),
        "rung_1": got & (F.col("rung") == 1),
        "rung_2": got & (F.col("rung") == 2),
    }
    role = F.coalesce("read_role", N.role_from_body(F.col("_hay"), F.col("_low")))
    counted = _with_haystack(readings).withColumn("role", role).agg(*[F.count_if(c).alias(k) for k, c in tests.items()])
    pairs = [x for k in tests for x in (F.lit(k), F.col(k))]
    return dropped.unionByName(counted.select(F.explode(F.create_map(*pairs)).alias("measure", "n")))


def reprocess_selection(
    ledger: DataFrame,
    *,
    outcome: str = "all",
    since: str | None = None,
    until: str | None = None,
    limit: int = 100,
    random_seed: int | None = None,
) -> DataFrame:
    """Ledger rows to read again, newest first or at random."""
    rows = ledger
    if outcome == "none":
        rows = rows.filter(F.col("outcome").isNull())
    elif outcome != "all":
        rows = rows.filter(F.col("outcome") == outcome)
    if since:
        rows = rows.filter(F.col("received_at") >= F.to_timestamp(F.lit(since)))
    if until:
        rows = rows.filter(F.col("received_at") < F.to_timestamp(F.lit(until)))
    if random_seed is not None:
        return rows.orderBy(F.rand(random_seed)).limit(limit)
    return rows.orderBy(F.col("received_at").desc(), "provider_message_id").limit(limit)


def reprocess_compare(ledger: DataFrame, screened: DataFrame, readings: DataFrame) -> DataFrame:
    """How many messages went from one outcome to another: (before, after, n)."""
    now = screened.select("message_id", F.col("outcome").alias("_screen")).join(
        readings.select("message_id", "reading"), "message_id", "left"
    ).select("message_id", F.coalesce("reading", F.lit("dropped")).alias("after"))
    return (
        ledger.select(F.col("provider_message_id").alias("message_id"),
                      F.coalesce("outcome", F.lit("—")).alias("before"))
        .join(now, "message_id")
        .groupBy("before", "after")
        .agg(F.count("*").alias("n"))
    )
