"""Screening and extraction over the documents as mail."""

from pyspark.sql import functions as F

from caseledger.functions import vocab as V
from caseledger.functions.rules import BUILT_IN, positional, rule_tables
from caseledger.operators import screening as ops

from .base import Registry
from .patterns import group, has, under
from .shapes import cte, pick
from .text import EXPECTED_COMPANIES, _PHRASE_VALUES, _strip, phrase_sql, role_sql

REGISTRY = Registry()
add = REGISTRY.add


def _vendor_sql(domain):
    arms = " ".join(f"WHEN {under(domain, r.domains)} THEN '{r.vendor}'" for r in BUILT_IN)
    return f"CASE {arms} END"


cte("drops", """SELECT user_id, regexp_extract(lower(sender), '@([a-z0-9.-]+)', 1) AS d FROM msg WHERE doc_id % 2 = 0""", "msg")
cte("news", "SELECT user_id, d, count(*) AS n FROM drops GROUP BY ALL HAVING count(*) >= 5", "drops")
cte("known_domains", "SELECT DISTINCT user_id, domain AS d FROM cases_ JOIN companies_ USING (company_id)", "cases_ companies_")
cte("flags", f"""SELECT m.*, strong_ AS strong, NOT strong_ AND weak_ AS weak, n.d IS NOT NULL AS news, coalesce(k.d IS NOT NULL, false) AND NOT has_unsubscribe AS company,
    t.thread_id IS NOT NULL AND m.thread_id IS NOT NULL AS threaded FROM (
  SELECT *, {_vendor_sql('dom')} AS vendor, {has('opening', V.STRONG_KEYWORDS)} AS strong_, {has('opening', V.WEAK_KEYWORDS)} AS weak_,
    {has('subject', V.PLATFORM_NOISE)} AS noise, regexp_matches(text, 'meet\\.google\\.com|zoom\\.us|teams\\.microsoft\\.com|teams\\.live\\.com|whereby\\.com|meet\\.jit\\.si|webex\\.com|gotomeeting\\.com|around\\.co') AND NOT {under('dom', V.PERSONAL_MAIL)} AS link,
    {under('dom', V.BULK_WHITELIST)} AS white, {under('dom', V.SOCIAL_NOISE)} AS social,
    regexp_matches(string_split(sender, '<')[-1], '(?i){V.NO_REPLY}') AS robot
  FROM (SELECT *, regexp_extract(lower(sender), '@([a-z0-9.-]+)', 1) AS dom, concat(subject, chr(10), text) AS opening FROM msg) a) m
  LEFT JOIN news n ON n.user_id = m.user_id AND n.d = m.dom
  LEFT JOIN known_domains k ON k.user_id = m.user_id AND k.d = m.dom
  LEFT JOIN (SELECT DISTINCT user_id, p_thread_id AS thread_id FROM ev WHERE p_thread_id IS NOT NULL) t ON t.user_id = m.user_id AND t.thread_id = m.thread_id""",
    "msg news known_domains ev")
cte("scored", """SELECT *, CASE WHEN score >= 3 THEN 'pass' WHEN score >= 1 THEN 'cheap_only' ELSE 'drop' END AS outcome FROM (
  SELECT *, CASE WHEN vendor IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN company THEN 3 ELSE 0 END + CASE WHEN strong THEN 2 ELSE 0 END
    + CASE WHEN weak THEN CASE WHEN vendor IS NOT NULL OR company OR threaded OR invited OR link THEN 2 ELSE 1 END ELSE 0 END
    + CASE WHEN threaded THEN 2 ELSE 0 END + CASE WHEN invited OR link THEN 2 ELSE 0 END
    - CASE WHEN (bulk OR has_list OR news) AND NOT ((vendor IS NOT NULL OR white) AND NOT noise) THEN 4 ELSE 0 END
    - CASE WHEN noise THEN 4 ELSE 0 END - CASE WHEN robot AND NOT (strong OR weak) THEN 3 ELSE 0 END - CASE WHEN social THEN 2 ELSE 0 END AS score
  FROM flags) x""", "flags")


def _template_sql():
    arms = []
    for i, r in enumerate(BUILT_IN):
        inner = " ".join(
            "WHEN " + " AND ".join(has(c, positional(p)[0]) for c, p in (("subject", q.subject), ("text", q.body)) if p) + f" THEN {i * 100 + j}"
            for j, q in enumerate(r.patterns))
        arms.append(f"WHEN vendor = '{r.vendor}' THEN CASE {inner} ELSE -1 END")
    return "CASE " + " ".join(arms) + " END"


_FLAT = [(i * 100 + j, p.intent, p.confidence) for i, r in enumerate(BUILT_IN) for j, p in enumerate(r.patterns)]
_TEMPLATES = ", ".join(f"({k}, '{i}', {c}::DOUBLE)" for k, i, c in _FLAT)
cte("rungs", f"""SELECT s.*, CASE WHEN ti >= 0 THEN tv.intent WHEN ti = -1 THEN pv.intent END AS t_intent,
    CASE WHEN ti >= 0 THEN tv.confidence WHEN ti = -1 THEN pv.confidence END AS t_confidence,
    CASE WHEN invited THEN CASE WHEN cancelled THEN 'interview_cancelled' ELSE 'interview_invite' END
      WHEN vendor IS NULL AND NOT {under('dom', V.LEARNING_PLATFORMS)} THEN pv.intent END AS h_intent,
    CASE WHEN invited THEN CASE WHEN cancelled THEN 0.95::DOUBLE ELSE 0.97::DOUBLE END
      WHEN vendor IS NULL AND NOT {under('dom', V.LEARNING_PLATFORMS)} THEN CASE WHEN pv.confidence IS NOT NULL THEN least(pv.confidence, 0.88::DOUBLE) END END AS h_confidence,
    CASE WHEN invited THEN CASE title WHEN 'Technical interview' THEN 'technical' WHEN 'Intro call' THEN 'hr_call' WHEN 'Chat with the CTO' THEN 'final' WHEN 'Take-home review' THEN 'take_home' END END AS h_stage
  FROM (SELECT *, {_template_sql()} AS ti, {phrase_sql("concat(subject, chr(10), text)")} AS pi FROM scored) s
  LEFT JOIN (VALUES {_TEMPLATES}) tv(k, intent, confidence) ON tv.k = ti
  LEFT JOIN (VALUES {_PHRASE_VALUES}) pv(k, intent, confidence) ON pv.k = pi""", "scored")
# Tenants own the address of every sender whose number is 6; even tenants only.
cte("ladder", """SELECT *, CASE WHEN self THEN 'ignored' WHEN rung IS NULL THEN 'review' ELSE 'extracted' END AS reading,
    CASE rung WHEN 1 THEN t_intent WHEN 2 THEN h_intent END AS intent, CASE rung WHEN 1 THEN t_confidence WHEN 2 THEN h_confidence ELSE 0.0::DOUBLE END AS confidence
  FROM (SELECT *, doc_id % 12 = 6 AND user_id % 2 = 0 AS self, CASE WHEN t_intent IS NOT NULL THEN 1 WHEN h_intent IS NOT NULL THEN 2 END AS rung
  FROM rungs WHERE outcome <> 'drop') x""", "rungs")


def context(t):
    from caseledger.functions.text import domain_of_address

    dropped = t.messages.filter("doc_id % 2 = 0").withColumn("sender_domain", domain_of_address(F.col("sender")))
    return ops.screen_context(t.cases, t.companies, t.log, dropped)


def screened(t):
    domains, threads, news = context(t)
    return ops.screen(
        t.messages, domains=rule_tables(t.spark)[0], company_domains=domains, threads=threads, newsletters=news
    )


def own(t):
    return t.messages.filter("user_id % 2 = 0").select("user_id", F.lit("marco.rossi@gmail.com").alias("address")).distinct()


def readings(t):
    return ops.run_ladder(screened(t), own=own(t))


@add("s06_load_rules", "SELECT * FROM (VALUES " + ", ".join(
    f"('{r.vendor}', {j}::BIGINT, '{p.intent}', {p.confidence}::DOUBLE, (SELECT count(*) FROM documents WHERE doc_id % 12 = {({'greenhouse': 0, 'lever': 1, 'linkedin': 3, 'indeed': 4, 'workable': 9}).get(r.vendor, 99)}))"
    for r in BUILT_IN for j, p in enumerate(r.patterns)) + ") t(vendor, ord, intent, confidence, messages)")
def s06(t):
    """Every template with the number of messages its vendor wrote."""
    domains, patterns = rule_tables(t.spark)
    from caseledger.functions.text import domain_of_address

    rows = ops.vendor_of(t.messages.withColumn("sender_domain", domain_of_address(F.col("sender"))), domains)
    counts = rows.groupBy("vendor").agg(F.count("*").alias("messages"))
    return patterns.join(counts, "vendor", "left").select(
        "vendor", F.col("ord").cast("bigint").alias("ord"), "intent", "confidence", F.coalesce("messages", F.lit(0)).alias("messages"))


@add("j09_vendor_by_suffix", "SELECT message_id, vendor FROM flags", uses="flags")
def j09(t):
    from caseledger.functions.text import domain_of_address

    rows = t.messages.withColumn("sender_domain", domain_of_address(F.col("sender")))
    return ops.vendor_of(rows, rule_tables(t.spark)[0]).select("message_id", "vendor")


@add("m01_screen_context", """SELECT 'domain' AS kind, user_id, d AS value FROM known_domains
  UNION ALL SELECT 'newsletter', user_id, d FROM news
  UNION ALL SELECT DISTINCT 'thread', user_id, p_thread_id FROM ev WHERE p_thread_id IS NOT NULL""", uses="known_domains news ev")
def m01(t):
    domains, threads, news = context(t)
    row = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), "user_id", F.col(c).alias("value"))
    return row(domains, "domain", "sender_domain").unionByName(row(news, "newsletter", "sender_domain")).unionByName(
        row(threads, "thread", "thread_id"))


@add("a20_learned_newsletters", "SELECT user_id, d AS sender_domain, n FROM news", uses="news")
def a20(t):
    return context(t)[2]


@add("m02_screen", "SELECT message_id, CAST(score AS BIGINT) AS score, outcome FROM scored", uses="scored")
def m02(t):
    return screened(t).select("message_id", F.col("score").cast("bigint").alias("score"), "outcome")


@add("m02_screen_reasons", """SELECT message_id, CAST((vendor IS NOT NULL)::INT + company::INT + strong::INT + weak::INT + threaded::INT + (invited OR link)::INT
  + (bulk OR has_list OR news)::INT + noise::INT + (robot AND NOT (strong OR weak))::INT + social::INT AS BIGINT) AS reasons FROM flags""", uses="flags")
def m02_reasons(t):
    return screened(t).select("message_id", F.size("reasons").cast("bigint").alias("reasons"))


@add("m03_match_templates", "SELECT message_id, t_intent, t_confidence FROM rungs", uses="rungs")
def m03(t):
    return ops.match_templates(screened(t)).select("message_id", "t_intent", "t_confidence")


def _field_sql(name):
    """What the template that fits names: the field's own pattern over subject and text, else the group in the subject."""
    arms = []
    for i, r in enumerate(BUILT_IN):
        for j, q in enumerate(r.patterns):
            found = []
            for key, extractor in q.extract:
                plain, groups = positional(extractor)
                if key == name:
                    found.append(_strip(group("concat(subject, chr(10), text)", plain, groups.get(name, 1))))
            if q.subject and name in (groups := positional(q.subject)[1]):
                found.append(_strip(group("subject", positional(q.subject)[0], groups[name])))
            if found:
                arms.append(f"WHEN {i * 100 + j} THEN coalesce({', '.join(f'nullif({f}, {EMPTY})' for f in found)})")
    return f"CASE ti {' '.join(arms)} END" if arms else "NULL::VARCHAR"


EMPTY = "''"
_BY_SENDER = pick("doc_id", tuple("Marco Rossi" if v is None else v for v in EXPECTED_COMPANIES)).replace("'Marco Rossi'", "NULL")
_FROM_SENDER = ", ".join(
    str(i * 100 + j) for i, r in enumerate(BUILT_IN) for j, _ in enumerate(r.patterns) if r.company_from == "sender_display_name")


cte("fields", f"""SELECT message_id, by_sender, body_role,
    CASE WHEN ti IN ({_FROM_SENDER}) THEN coalesce(by_sender, named) WHEN ti >= 0 THEN coalesce(named, by_sender) WHEN ti = -1 AND pi IS NOT NULL THEN by_sender END AS t_company,
    CASE WHEN ti >= 0 OR (ti = -1 AND pi IS NOT NULL) THEN coalesce(said, body_role) END AS t_role, due AS t_deadline
  FROM (SELECT *, {_BY_SENDER} AS by_sender, {_field_sql('company')} AS named, {_field_sql('role')} AS said, {_field_sql('deadline')} AS due,
    {role_sql("concat(subject, chr(10), text)")} AS body_role FROM rungs) x""", "rungs")


@add("m03_template_fields", "SELECT message_id, t_company, t_role, t_deadline FROM fields", uses="fields")
def m03_fields(t):
    return ops.match_templates(screened(t)).select("message_id", "t_company", "t_role", "t_deadline")


@add("m04_match_heuristics", "SELECT message_id, h_intent, h_confidence, h_stage AS h_stage_hint FROM rungs", uses="rungs")
def m04(t):
    return ops.match_heuristics(screened(t)).select("message_id", "h_intent", "h_confidence", "h_stage_hint")


_ANSWER = """(SELECT doc_id, concat('d-', doc_id) AS message_id, (['offer', 'unclear', 'rejected', 'nonsense', 'negotiation'])[doc_id % 5 + 1] AS intent, (doc_id % 150) / 100 AS c FROM documents)"""


def answers(t):
    d = F.col("doc_id")
    answer = F.expr("""concat('{"intent":"', get(array('offer', 'unclear', 'rejected', 'nonsense', 'negotiation'), CAST(doc_id % 5 AS INT)),
      '","confidence":', CASE WHEN doc_id % 7 = 0 THEN 'true' ELSE CAST((doc_id % 150) / 100 AS STRING) END,
      ',"company":" Nova ","role":"  ","comp":{"currency":" eur","min":', doc_id, '}}')""")
    return t.raw("documents").select(F.concat(F.lit("d-"), d).alias("message_id"), answer.alias("answer"))


@add("m05_accept_model_answers", f"""SELECT message_id, intent, round(least(1.0, greatest(0.0, c)) * 0.9::DOUBLE, 6) AS confidence, 'Nova' AS company, NULL::VARCHAR AS role,
  CAST(doc_id * 100 AS BIGINT) AS comp_min_minor, 'EUR' AS comp_currency FROM {_ANSWER} a WHERE intent NOT IN ('unclear', 'nonsense') AND doc_id % 7 <> 0""")
def m05(t):
    out = ops.accept_model_answers(answers(t))
    return out.select("message_id", "intent", F.round("confidence", 6).alias("confidence"), "company", "role", "comp_min_minor", "comp_currency")


@add("m06_run_ladder", "SELECT message_id, reading, CAST(rung AS BIGINT) AS rung, intent, confidence FROM ladder", uses="ladder")
def m06(t):
    return readings(t).select("message_id", "reading", F.col("rung").cast("bigint").alias("rung"), "intent", "confidence")


@add("m06_ladder_with_model", f"""SELECT l.message_id, CASE WHEN self THEN 'ignored' WHEN rung IS NOT NULL THEN 'extracted'
    WHEN a.message_id IS NOT NULL AND l.outcome <> 'cheap_only' AND least(1.0, a.c) * 0.9::DOUBLE >= 0.6 THEN 'extracted' ELSE 'review' END AS reading
  FROM ladder l LEFT JOIN (SELECT * FROM {_ANSWER} x WHERE intent NOT IN ('unclear', 'nonsense') AND doc_id % 7 <> 0) a USING (message_id)""", uses="ladder")
def m06_model(t):
    return ops.run_ladder(screened(t), own=own(t), answers=answers(t)).select("message_id", "reading")


@add("f10_self_sent", "SELECT message_id, doc_id % 12 = 6 AND user_id % 2 = 0 AS self_sent FROM msg", uses="msg")
def f10(t):
    return ops.self_sent(t.messages, own(t)).select("message_id", "self_sent")


_STAGE = "CASE l.intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.STAGE_FOR_INTENT.items()) + " END"


@add("m07_build_signals", f"""SELECT l.message_id, l.intent, l.confidence, coalesce(CASE WHEN rung = 2 THEN h_stage END, {_STAGE}) AS stage_hint, vendor AS ats_vendor, h.case_id AS case_hint
  FROM ladder l LEFT JOIN (SELECT user_id, p_thread_id AS thread_id, arg_max(case_id, occurred_at) AS case_id FROM ev WHERE p_thread_id IS NOT NULL GROUP BY ALL) h
  ON h.user_id = l.user_id AND h.thread_id = l.thread_id WHERE reading = 'extracted'""", uses="ladder ev")
def m07(t):
    from caseledger.operators.log import thread_map

    out = ops.build_signals(readings(t), thread_map(t.log))
    return out.select("message_id", "intent", "confidence", "stage_hint", "ats_vendor", "case_hint")


@add("m07_signal_roles", f"""SELECT message_id, role FROM (SELECT message_id, vendor, doc_id, {role_sql("concat(subject, chr(10), text)")} AS role FROM ladder WHERE reading = 'extracted') x""", uses="ladder")
def m07_roles(t):
    out = ops.build_signals(readings(t))
    return out.select("message_id", "role")


@add("m08_replay_summary", """SELECT 'messages' AS measure, (SELECT count(*) FROM scored) AS n UNION ALL SELECT 'dropped', count(*) FROM scored WHERE outcome = 'drop'
  UNION ALL SELECT 'extracted', count(*) FROM ladder WHERE reading = 'extracted' UNION ALL SELECT 'review', count(*) FROM ladder WHERE reading = 'review'
  UNION ALL SELECT 'ignored', count(*) FROM ladder WHERE reading = 'ignored' UNION ALL SELECT 'rung_1', count(*) FROM ladder WHERE reading = 'extracted' AND rung = 1
  UNION ALL SELECT 'rung_2', count(*) FROM ladder WHERE reading = 'extracted' AND rung = 2
  UNION ALL SELECT 'with_company', count(CASE rung WHEN 1 THEN t_company WHEN 2 THEN CASE WHEN invited THEN 'Company2' ELSE by_sender END END) FROM ladder JOIN fields USING (message_id) WHERE reading = 'extracted'
  UNION ALL SELECT 'with_role', count(CASE WHEN rung = 1 THEN coalesce(t_role, body_role) ELSE body_role END) FROM ladder JOIN fields USING (message_id) WHERE reading = 'extracted'""", uses="scored ladder fields")
def m08(t):
    from caseledger.session import cut_lineage

    s = cut_lineage(screened(t))
    return ops.replay_summary(s, ops.run_ladder(s, own=own(t)))


@add("m09_reprocess_compare", """SELECT before, after, count(*) AS n FROM (SELECT coalesce((['dropped', 'review', NULL])[s.doc_id % 3 + 1], '—') AS before, coalesce(l.reading, 'dropped') AS after
  FROM scored s LEFT JOIN ladder l USING (message_id)) x GROUP BY ALL""", uses="scored ladder")
def m09(t):
    from caseledger.session import cut_lineage

    s = cut_lineage(screened(t))
    ledger = t.messages.select(F.col("message_id").alias("provider_message_id"),
                               F.expr("get(array('dropped', 'review', NULL), CAST(doc_id % 3 AS INT))").alias("outcome"))
    return ops.reprocess_compare(ledger, s, ops.run_ladder(s, own=own(t)))


@add("f08_calendar_relevance", """SELECT DISTINCT m.doc_id AS event_id FROM msg m JOIN known_domains k ON k.user_id = m.user_id
  AND k.d IN (concat('company', m.doc_id % 12, '.com'), concat('company', m.doc_id % 7, '.com'))""", uses="msg known_domains")
def f08(t):
    events = t.messages.select(
        "user_id", F.col("doc_id").alias("event_id"),
        F.concat(F.lit("boss@company"), F.col("doc_id") % 12, F.lit(".com")).alias("organiser"),
        F.array(F.lit("x@sub.company1.com"), F.concat(F.lit("Ann <ann@Company"), F.col("doc_id") % 7, F.lit(".com>"))).alias("attendees"),
    )
    domains = context(t)[0].withColumnRenamed("sender_domain", "domain")
    return ops.calendar_relevance(events, domains).select("event_id")
