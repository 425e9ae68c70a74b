"""Vectors, companies, attaching, merging, events."""

from pyspark.sql import functions as F

from caseledger.functions.rules import BUILT_IN, vendor_domains
from caseledger.operators import log as log_ops
from caseledger.operators import resolution as ops
from caseledger.operators import similarity as S

from caseledger.session import cut_lineage

from .base import Registry, ziso
from .shapes import COMPANY_ID, cte

REGISTRY = Registry()
add = REGISTRY.add

_ROLES = """SELECT DISTINCT p_name AS text FROM part UNION SELECT concat('senior ', p_name, ' engineer') FROM part UNION SELECT 'unknown'"""


def vectors_cte(name, source, uses=""):
    cte(f"{name}_tok", f"""SELECT text, t, count(*) AS n FROM (SELECT text, unnest(list_concat(list_concat(w,
      list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))),
      list_transform(range(1, length(array_to_string(w, ' ')) - 2), lambda i: concat('~', substr(array_to_string(w, ' '), i, 4))))) AS t
      FROM (SELECT text, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9+#]+'), lambda z: z <> '') AS w FROM ({source}) s) a) b GROUP BY ALL""", uses)
    cte(f"{name}_dim", f"""SELECT text, ('0x' || substr(sha1('idx:' || t), 1, 6))::BIGINT % 384 AS dim,
      sum((1 + ln(n)) * CASE WHEN t[1] = '~' THEN 0.4::DOUBLE ELSE 1 END * CASE WHEN ('0x' || substr(sha1('sign:idx:' || t), 1, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS w
      FROM {name}_tok GROUP BY ALL""", f"{name}_tok")
    cte(name, f"SELECT text, dim, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS w FROM {name}_dim", f"{name}_dim")


vectors_cte("vec", _ROLES)
cte("cosines", """SELECT a.text AS a, b.text AS b, sum(a.w * b.w) AS c FROM vec a JOIN vec b USING (dim) GROUP BY ALL""", "vec")
_SIG_COMPANY = COMPANY_ID.replace("case_id % 8", "event_id % 8")
cte("signals_", f"""SELECT event_id AS signal_id, user_id, {_SIG_COMPANY} AS company_id, ts AS occurred_at,
  CASE WHEN event_id % 17 <> 0 THEN CASE WHEN event_id % 4 = 0 THEN concat('senior ', p_name, ' engineer') ELSE p_name END END AS role
  FROM events JOIN part ON p_partkey = event_id % <part> WHERE event_type = 'click'""")
cte("open_cases", """SELECT user_id, case_id, company_id, role_title FROM projected WHERE merged_into_id IS NULL AND status IN ('live', 'dormant')""", "projected")
cte("scored_", """SELECT s.signal_id, s.role, o.case_id, coalesce(c.c, 0) AS c, count(*) OVER (PARTITION BY s.signal_id) AS n,
  row_number() OVER (PARTITION BY s.signal_id ORDER BY coalesce(c.c, 0) DESC, o.case_id) AS rn
  FROM signals_ s JOIN open_cases o ON o.user_id = s.user_id AND o.company_id = s.company_id
  LEFT JOIN cosines c ON c.a = coalesce(s.role, 'unknown') AND c.b = o.role_title""", "signals_ open_cases cosines")
cte("decided_", """SELECT s.signal_id, CASE WHEN b.n IS NULL THEN 'create' WHEN s.role IS NULL THEN CASE WHEN b.n = 1 THEN 'attach' ELSE 'ambiguous' END
    WHEN b.n = 1 THEN CASE WHEN b.c >= 0.72 THEN 'attach' ELSE 'create' END WHEN b.c < 0.82 THEN 'create'
    WHEN b.c - d.c < 0.05 THEN 'ambiguous' ELSE 'attach' END AS decision, b.case_id, b.c, s.role
  FROM signals_ s LEFT JOIN (SELECT * FROM scored_ WHERE rn = 1) b USING (signal_id) LEFT JOIN (SELECT signal_id, c FROM scored_ WHERE rn = 2) d USING (signal_id)""", "signals_ scored_")


def signals(t):
    part = t.raw("part").select("p_partkey", "p_name")
    e = t.raw("events").filter("event_type = 'click'")
    role = F.expr("CASE WHEN event_id % 17 <> 0 THEN CASE WHEN event_id % 4 = 0 THEN concat('senior ', p_name, ' engineer') ELSE p_name END END")
    return e.join(part, F.expr(t.sized("event_id % <part>")) == F.col("p_partkey")).select(
        F.col("event_id").alias("signal_id"), "user_id", F.expr(t.sized(_SIG_COMPANY)).alias("company_id"),
        F.col("ts").cast("timestamp").alias("occurred_at"), role.alias("role"), role.alias("role_normalised"),
    )


def cases(t):
    """The projection as a stored table, which it is to the resolver."""
    return cut_lineage(t.projected.withColumn("role_normalised", F.col("role_title")))


@add("r01_embed_lexical", "SELECT p_partkey, dim, round(w, 6) AS w FROM part JOIN vec ON text = p_name WHERE abs(w) > 1e-9", uses="vec")
def r01(t):
    rows = S.with_sparse_vector(t.raw("part").select("p_partkey", "p_name"), "p_name")
    rows = rows.select("p_partkey", F.explode("vector").alias("p"))
    return rows.filter(F.abs("p.w") > 1e-9).select("p_partkey", F.col("p.dim").cast("bigint").alias("dim"), F.round("p.w", 6).alias("w"))


@add("r02_cosine", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
  FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) b USING (label)""")
def r02(t):
    """Every vector against the first one of its label."""
    e = t.raw("embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"))


@add("j11_blocked_similarity", """SELECT signal_id, case_id, round(c, 6) AS cosine FROM scored_ WHERE c >= 0.72 AND role IS NOT NULL""", uses="scored_")
def j11(t):
    out = ops.blocked_similarity(signals(t).filter("role IS NOT NULL"), cases(t))
    return out.select("signal_id", "case_id", F.round("cosine", 6).alias("cosine"))


@add("r05_attach_decision", """SELECT signal_id, decision, CASE WHEN decision = 'attach' THEN case_id END AS case_id,
  CASE WHEN decision = 'attach' THEN CASE WHEN role IS NULL THEN 1.0::DOUBLE ELSE round(c, 6) END END AS cosine FROM decided_""", uses="decided_")
def r05(t):
    out = ops.attach_decision(signals(t), cases(t))
    return out.select("signal_id", "decision", "case_id", F.round("cosine", 6).alias("cosine"))


@add("o05_ambiguous_shortlist", """SELECT signal_id, rn AS position, case_id, round(c, 6) AS cosine FROM (SELECT s.signal_id, s.case_id, s.c,
    row_number() OVER (PARTITION BY signal_id ORDER BY round(s.c, 12) DESC, s.case_id) AS rn FROM scored_ s JOIN decided_ d USING (signal_id) WHERE d.decision = 'ambiguous') x WHERE rn <= 3""", uses="scored_ decided_")
def o05(t):
    stored = cases(t)
    decided = cut_lineage(ops.attach_decision(signals(t), stored))
    out = ops.ambiguous_shortlist(decided, stored)
    return out.select("signal_id", F.col("position").cast("bigint").alias("position"), "case_id", F.round("cosine", 6).alias("cosine"))


cte("country", """SELECT case_id, user_id, company_id, role_title AS text, applied_at, nullif(work_mode, '') AS work_mode,
  CASE lower(location) WHEN 'milano' THEN 'it' WHEN 'roma' THEN 'it' WHEN 'berlin' THEN 'de' WHEN 'london' THEN 'gb' WHEN '' THEN NULL ELSE CASE WHEN location IS NOT NULL THEN 'unknown' END END AS land
  FROM projected WHERE merged_into_id IS NULL AND status IN ('live', 'dormant') AND current_stage NOT IN ('offer', 'negotiating') AND NOT manually_created AND role_title <> ''""", "projected")
vectors_cte("cvec", "SELECT DISTINCT text FROM country", "country")
cte("dups", """SELECT * FROM (SELECT a.user_id, a.company_id, a.case_id, b.case_id AS partner_id, c.c AS cosine, a.applied_at AS at_a, b.applied_at AS at_b,
    row_number() OVER (PARTITION BY a.case_id ORDER BY round(c.c, 12) DESC, abs(epoch_us(a.applied_at) - epoch_us(b.applied_at)) NULLS LAST, b.case_id) AS rn
  FROM country a JOIN country b ON a.user_id = b.user_id AND a.company_id = b.company_id AND a.case_id <> b.case_id
  JOIN (SELECT x.text AS p, y.text AS q, sum(x.w * y.w) AS c FROM cvec x JOIN cvec y USING (dim) GROUP BY ALL) c ON c.p = a.text AND c.q = b.text
  WHERE c.c >= 0.93 AND (a.applied_at IS NULL OR b.applied_at IS NULL OR abs(epoch_us(a.applied_at) - epoch_us(b.applied_at)) <= 14 * 86400000000)
    AND (a.work_mode IS NULL OR b.work_mode IS NULL OR a.work_mode = b.work_mode) AND (a.land IS NULL OR b.land IS NULL OR a.land = b.land)
    AND NOT EXISTS (SELECT 1 FROM ev s WHERE s.user_id = a.user_id AND s.p_field = 'merge' AND s.p_to = 'split'
      AND ((s.case_id = a.case_id AND s.p_merged_id::BIGINT = b.case_id) OR (s.case_id = b.case_id AND s.p_merged_id::BIGINT = a.case_id)))) x WHERE rn = 1""", "country cvec ev")
cte("dups_kept", """SELECT *, CASE WHEN (at_a IS NULL, coalesce(at_a, TIMESTAMP '1970-01-01'), case_id) < (at_b IS NULL, coalesce(at_b, TIMESTAMP '1970-01-01'), partner_id) THEN case_id ELSE partner_id END AS keep,
  CASE WHEN (at_a IS NULL, coalesce(at_a, TIMESTAMP '1970-01-01'), case_id) < (at_b IS NULL, coalesce(at_b, TIMESTAMP '1970-01-01'), partner_id) THEN partner_id ELSE case_id END AS merge FROM dups""", "dups")


@add("r06_find_duplicates", "SELECT user_id, company_id, case_id, partner_id, round(cosine, 6) AS cosine, keep, merge FROM dups_kept", uses="dups_kept")
def r06(t):
    out = ops.find_duplicates(cases(t), log_ops.split_pairs(t.log))
    return out.withColumn("cosine", F.round("cosine", 6))


_LAND = "CASE lower(location) WHEN 'milano' THEN 'it' WHEN 'roma' THEN 'it' WHEN 'berlin' THEN 'de' WHEN 'london' THEN 'gb' ELSE CASE WHEN location <> '' THEN 'unknown' END END"
_OWN = " ".join(f"""WHEN {x}.current_stage IN ('offer', 'negotiating') THEN 'an offer or negotiation is open'
    WHEN {x}.status = 'accepted' THEN 'one of them was accepted' WHEN {x}.manually_created THEN 'one of them was declared by hand'""" for x in "ab")


@add("r06_merge_refusals", f"""SELECT a.case_id, b.case_id AS other_id, CASE {_OWN}
    WHEN nullif(a.work_mode, '') <> nullif(b.work_mode, '') THEN 'different work mode' WHEN a.land <> b.land THEN 'different country'
    WHEN EXISTS (SELECT 1 FROM ev s WHERE s.p_field = 'merge' AND s.p_to = 'split' AND s.user_id = a.user_id
      AND ((s.case_id = a.case_id AND CAST(s.p_merged_id AS BIGINT) = b.case_id) OR (s.case_id = b.case_id AND CAST(s.p_merged_id AS BIGINT) = a.case_id))) THEN 'a human split them before' END AS refusal
  FROM (SELECT *, {_LAND} AS land FROM projected) a JOIN (SELECT *, {_LAND} AS land FROM projected) b
  ON b.user_id = a.user_id AND b.company_id = a.company_id AND b.case_id > a.case_id""", uses="projected ev")
def r06_refusals(t):
    """Each case against the later ones of its company."""
    pairs = log_ops.split_pairs(t.log)
    apart = pairs.select("user_id", F.least("case_id", "other_id").alias("low"), F.greatest("case_id", "other_id").alias("high")).distinct()
    a, b = t.projected.alias("a"), t.projected.alias("b")
    met = a.join(b, F.expr("b.user_id = a.user_id AND b.company_id = a.company_id AND b.case_id > a.case_id")).join(
        apart.alias("s"), F.expr("s.user_id = a.user_id AND s.low = a.case_id AND s.high = b.case_id"), "left")
    return met.select(F.col("a.case_id").alias("case_id"), F.col("b.case_id").alias("other_id"),
                      ops.merge_refusal("a", "b", F.col("s.low").isNotNull()).alias("refusal"))


vectors_cte("ovec", "SELECT DISTINCT role_title AS text FROM open_cases WHERE role_title <> ''", "open_cases")


@add("j12_pairwise_texts", """SELECT DISTINCT a.user_id, a.company_id, a.role_title AS left_text, b.role_title AS right_text FROM open_cases a JOIN open_cases b USING (user_id, company_id)
  JOIN (SELECT x.text AS p, y.text AS q, sum(x.w * y.w) AS c FROM ovec x JOIN ovec y USING (dim) GROUP BY ALL) c ON c.p = a.role_title AND c.q = b.role_title
  WHERE c.c >= 0.1 AND a.role_title < b.role_title""", uses="open_cases ovec")
def j12(t):
    return ops.pairwise_duplicates(cases(t), 0.1).drop("cosine")


@add("r07_apply_merges", """WITH RECURSIVE up AS (SELECT DISTINCT c_custkey AS merge, CAST(floor(c_custkey / 3) AS BIGINT) AS keep FROM customer WHERE c_custkey > 0),
  roots AS (SELECT merge, keep FROM up UNION ALL SELECT r.merge, u.keep FROM roots r JOIN up u ON u.merge = r.keep)
  SELECT merge, min(keep) AS keep FROM roots GROUP BY merge""")
def r07(t):
    """Every customer merged into a third of its number: chains that all end at zero."""
    c = F.col("c_custkey")
    edges = t.raw("customer").filter("c_custkey > 0").select(
        F.lit(1).alias("user_id"), c.alias("merge"), F.floor(c / 3).alias("keep"))
    return ops.merge_roots(edges).select("merge", "keep")


_ROOTS = """SELECT user_id, merge, min(keep) AS root FROM (WITH RECURSIVE up AS (SELECT user_id, merge, min(keep) AS keep FROM dups_kept GROUP BY ALL),
    roots AS (SELECT * FROM up UNION ALL SELECT r.user_id, r.merge, u.keep FROM roots r JOIN up u ON u.user_id = r.user_id AND u.merge = r.keep) SELECT * FROM roots) q GROUP BY user_id, merge"""


def _merged(t):
    found = ops.find_duplicates(cases(t), log_ops.split_pairs(t.log))
    return ops.apply_merges(t.cases, t.sources, found, t.now)


@add("r07_merged_cases", f"""SELECT c.user_id, c.case_id, coalesce(r.root, c.merged_into_id) AS merged_into_id, u.cosine FROM cases_ c
  LEFT JOIN ({_ROOTS}) r ON r.user_id = c.user_id AND r.merge = c.case_id
  LEFT JOIN (SELECT user_id, merge, round(max(cosine), 6) AS cosine FROM dups_kept GROUP BY ALL) u ON u.user_id = c.user_id AND u.merge = c.case_id""", uses="cases_ dups_kept")
def r07_cases(t):
    """Where each case went, and the cosine that the question to undo it carries."""
    merged, _, undo = _merged(t)
    asked = undo.select("user_id", F.get_json_object("candidates", "$.merged").cast("bigint").alias("case_id"),
                        F.round(F.get_json_object("candidates", "$.cosine").cast("double"), 6).alias("cosine"))
    return merged.select("user_id", "case_id", "merged_into_id").join(asked, ["user_id", "case_id"], "left")


@add("r07_moved_sources", f"""SELECT s.user_id, s.source_id, coalesce(r.root, s.case_id) AS case_id FROM sources_ s LEFT JOIN ({_ROOTS}) r ON r.user_id = s.user_id AND r.merge = s.case_id""", uses="sources_ dups_kept")
def r07_sources(t):
    return _merged(t)[1].select("user_id", "source_id", "case_id")


@add("r03_canonicalise_company", """SELECT doc_id, CASE WHEN NOT vendor AND dom LIKE 'company%' THEN CAST(regexp_extract(dom, '[0-9]+') AS BIGINT)
    WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 20 % 2 = 0 THEN 7 ELSE CAST(NULL AS BIGINT) END WHEN doc_id % 3 = 1 THEN 8 END AS company_id
  FROM (SELECT doc_id, regexp_extract(sender, '@([a-z0-9.-]+)', 1) AS dom, doc_id % 12 IN (0, 1, 3, 4, 9) AS vendor FROM msg) x""", uses="msg")
def r03(t):
    """Known domains, a spelling of even tenants, a stored name, or a new company (no number)."""
    from caseledger.functions.text import domain_of_address

    rows = t.messages.select("doc_id", "user_id", domain_of_address(F.col("sender")).alias("sender_domain"),
                             F.expr("get(array('Big Seven', 'Company 8!', 'Never Seen'), CAST(doc_id % 3 AS INT))").alias("company"))
    aliases = t.messages.filter("user_id % 2 = 0").select("user_id").distinct().select("user_id", F.lit(7).cast("bigint").alias("company_id"), F.lit("bigseven").alias("alias"))
    companies = t.companies.withColumn("canonical_name", F.regexp_replace("canonical_name", "( GmbH| S.p.A.| Ltd| Inc)$", ""))
    out, created, _ = ops.canonicalise_company(rows, companies, aliases, vendor_domains(BUILT_IN))
    known = companies.select("company_id", F.lit(True).alias("_known"))
    return out.join(known, "company_id", "left").select("doc_id", F.when(F.col("_known"), F.col("company_id")).alias("company_id"))


@add("r03_recorded_aliases", """SELECT DISTINCT doc_id % 20 AS user_id, CASE WHEN doc_id % 3 = 0 THEN 'bigseven' WHEN doc_id % 3 = 1 THEN 'company8' ELSE 'neverseen' END AS alias
  FROM msg WHERE doc_id % 12 NOT IN (2, 11) AND NOT (doc_id % 3 = 0 AND doc_id % 20 % 2 = 0)""", uses="msg")
def r03_aliases(t):
    from caseledger.functions.text import domain_of_address

    rows = t.messages.select("doc_id", "user_id", domain_of_address(F.col("sender")).alias("sender_domain"),
                             F.expr("get(array('Big Seven', 'Company 8!', 'Never Seen'), CAST(doc_id % 3 AS INT))").alias("company"))
    aliases = t.messages.filter("user_id % 2 = 0").select("user_id").distinct().select("user_id", F.lit(7).cast("bigint").alias("company_id"), F.lit("bigseven").alias("alias"))
    companies = t.companies.withColumn("canonical_name", F.regexp_replace("canonical_name", "( GmbH| S.p.A.| Ltd| Inc)$", ""))
    return ops.canonicalise_company(rows, companies, aliases, vendor_domains(BUILT_IN))[2].select("user_id", "alias")


@add("r04_identify_by_thread", """SELECT m.message_id, coalesce(CASE WHEN doc_id % 9 = 0 THEN doc_id END, h.case_id) AS thread_case_id FROM msg m
  LEFT JOIN (SELECT user_id, p_thread_id AS thread_id, arg_max(case_id, occurred_at) AS case_id FROM ev WHERE p_thread_id IS NOT NULL GROUP BY ALL) h
  ON h.user_id = m.user_id AND h.thread_id = m.thread_id""", uses="msg ev")
def r04(t):
    rows = t.messages.withColumn("case_hint", F.expr("CASE WHEN doc_id % 9 = 0 THEN doc_id END"))
    return ops.identify_by_thread(rows, log_ops.thread_map(t.log)).select("message_id", "thread_case_id")


_KINDS = ("applied", "acknowledged", "schedule_screening", "interview_invite", "interview_cancelled", "take_home", "rejected", "offer", "negotiation", "other")


def placed(t):
    kind = "get(array(" + ", ".join(f"'{k}'" for k in _KINDS) + "), CAST(doc_id % 10 AS INT))"
    m = t.messages
    text = lambda e, n: F.expr(e).alias(n)
    return m.select(
        "user_id", (F.col("doc_id") % 97).alias("case_id"), F.col("received_at").alias("occurred_at"),
        F.lit(0.9).alias("confidence"), F.col("message_id").alias("evidence_ref"), F.lit(1).alias("rung"),
        text(kind, "intent"), "thread_id", F.lit("Data Engineer").alias("role"), F.lit("senior").alias("seniority"),
        F.lit("Milano").alias("location"), F.lit(None).cast("string").alias("work_mode"),
        text("CASE WHEN doc_id % 4 <> 0 THEN 'recruiter' END", "channel"), text("CASE WHEN doc_id % 3 = 0 THEN 'hr_call' END", "stage_hint"),
        text("CASE WHEN doc_id % 20 = 5 THEN '2024-08-01' END", "deadline"), F.lit(None).cast("string").alias("posting_url"),
        text("CASE WHEN doc_id % 2 = 0 THEN 'lever' END", "ats_vendor"), F.col("doc_id").alias("comp_min_minor"),
        F.lit(None).cast("bigint").alias("comp_max_minor"), text("CASE WHEN doc_id % 7 = 0 THEN 'USD' END", "comp_currency"), "invite",
    )


_TYPES = ("applied", "acknowledged", "stage_advanced", "interview_scheduled", "interview_scheduled", "stage_advanced", "rejected", "offer_received", "offer_negotiated")


@add("r09_events_for_signals", f"""SELECT message_id AS evidence_ref, k.type, 0::BIGINT AS ord, CASE k.type WHEN 'applied' THEN 'applied' WHEN 'acknowledged' THEN 'acknowledged' WHEN 'offer_received' THEN 'offer' WHEN 'offer_negotiated' THEN 'negotiating'
    WHEN 'stage_advanced' THEN CASE WHEN i = 5 THEN 'take_home' WHEN doc_id % 3 = 0 THEN 'hr_call' ELSE 'recruiter_reachout' END
    WHEN 'interview_scheduled' THEN CASE WHEN i = 3 THEN CASE WHEN doc_id % 3 = 0 THEN 'hr_call' ELSE 'interview' END END END AS to_stage,
    CASE WHEN i IN (7, 8) THEN CASE WHEN doc_id % 7 = 0 THEN 'USD' ELSE 'EUR' END END AS currency, CASE WHEN i = 3 THEN 'confirmed' WHEN i = 4 THEN 'cancelled' END AS status
  FROM (SELECT *, doc_id % 10 AS i FROM msg) m JOIN (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(_TYPES))}) k(i, type) USING (i) WHERE i <> 4 OR invited
  UNION ALL SELECT message_id, 'deadline_set', 1, NULL, NULL, NULL FROM msg WHERE doc_id % 20 = 5""", uses="msg")
def r09(t):
    return ops.events_for_signals(placed(t)).select(
        "evidence_ref", "type", F.col("ord").cast("bigint").alias("ord"), "to_stage", "payload.currency", "payload.status")


@add("r10_review_items", f"""SELECT user_id, 'ambiguous_match' AS kind, CAST(signal_id AS VARCHAR) AS evidence_ref, string_agg(concat(case_id, '|', role_title, '|', stage, '|', since, '|', printf('%.4f', c)), ';' ORDER BY place) AS candidates
  FROM (SELECT s.user_id, s.signal_id, s.case_id, p.role_title, p.current_stage AS stage, coalesce({ziso('p.applied_at')}, '-') AS since, round(s.c, 6) AS c,
      row_number() OVER (PARTITION BY s.signal_id ORDER BY round(s.c, 12) DESC, s.case_id) AS place
    FROM (SELECT x.*, y.user_id FROM scored_ x JOIN signals_ y USING (signal_id)) s JOIN decided_ d USING (signal_id) JOIN projected p ON p.user_id = s.user_id AND p.case_id = s.case_id
    WHERE d.decision = 'ambiguous' AND signal_id % 2 = 1) x WHERE place <= 3 GROUP BY user_id, signal_id
  UNION ALL SELECT user_id, 'unknown_intent', message_id, NULL FROM msg WHERE doc_id % 10 = 4 AND invited""", uses="decided_ signals_ scored_ projected msg")
def r10(t):
    """Ambiguous signals with their candidates, and cancellations, where the question is not open already."""
    known = cases(t)
    decided = cut_lineage(ops.attach_decision(signals(t), known)).withColumn("evidence_ref", F.col("signal_id").cast("string")).withColumn("excerpt", F.lit("x"))
    off = placed(t).filter("intent = 'interview_cancelled' AND invite IS NOT NULL")
    none = t.messages.filter("false").select("user_id", "message_id", F.lit("").alias("reading"), F.lit("").alias("excerpt"))
    stored = decided.filter("signal_id % 2 = 0").select("user_id", F.lit("ambiguous_match").alias("kind"), "evidence_ref", F.lit(None).cast("timestamp").alias("resolved_at"))
    items = ops.review_items(none, decided, off, stored, ops.ambiguous_shortlist(decided, known), known)
    listed = F.from_json("candidates", "array<struct<case_id:bigint,role_title:string,stage:string,applied_at:string,cosine:double>>")
    shown = F.transform(listed, lambda c: F.concat_ws(
        "|", c["case_id"], c["role_title"], c["stage"], F.coalesce(c["applied_at"], F.lit("-")), F.format_string("%.4f", F.round(c["cosine"], 6))))
    return items.select("user_id", "kind", "evidence_ref", F.when(F.col("candidates").isNotNull(), F.array_join(shown, ";")).alias("candidates"))


@add("j07_raise_once", """SELECT message_id AS evidence_ref FROM msg WHERE doc_id % 3 <> 0""", uses="msg")
def j07(t):
    none = F.lit(None).cast("bigint")
    items = t.messages.select("user_id", F.lit("unknown_intent").alias("kind"), F.col("message_id").alias("evidence_ref"), none.alias("case_id"), F.lit("x").alias("excerpt"))
    stored = t.messages.filter("doc_id % 3 = 0 OR doc_id % 5 = 0").select(
        "user_id", F.lit("unknown_intent").alias("kind"), F.col("message_id").alias("evidence_ref"),
        F.when(F.col("doc_id") % 3 != 0, F.col("received_at")).alias("resolved_at"))
    return ops.raise_once(items.unionByName(items), stored).select("evidence_ref")


def _stored_reviews(t):
    return t.messages.select(
        F.concat(F.lit("rv-"), "doc_id").alias("review_id"), "user_id", F.lit("merge_undo").alias("kind"), F.col("message_id").alias("evidence_ref"),
        F.lit("some text").alias("excerpt"), F.expr("concat('{\"merged\":', doc_id, ',\"kept\":', doc_id + 1, '}')").alias("candidates"),
        F.lit(None).cast("string").alias("learned_pattern"), F.expr("CASE WHEN doc_id % 11 = 0 THEN received_at END").alias("resolved_at"))


def _answers(t):
    return t.messages.filter("doc_id % 2 = 0").select(
        F.concat(F.lit("rv-"), "doc_id").alias("review_id"),
        F.expr("get(array('undo_merge', 'intent', 'bogus'), CAST(doc_id % 3 AS INT))").alias("choice"),
        (F.col("doc_id") % 4 == 0).alias("learn"), t.now.alias("at"))


@add("r11_resolve_review", """SELECT concat('rv-', doc_id) AS review_id, CASE WHEN NOT done THEN 'some text' END AS excerpt, done OR doc_id % 11 = 0 AS resolved,
  CASE WHEN done AND doc_id % 4 = 0 THEN concat('{"kind":"merge_undo","answer":"', CASE WHEN doc_id % 3 = 0 THEN 'undo_merge' ELSE 'intent' END, '"}') END AS learned_pattern
  FROM (SELECT *, doc_id % 2 = 0 AND doc_id % 3 <> 2 AND doc_id % 11 <> 0 AS done FROM documents) x""")
def r11(t):
    after, _ = ops.resolve_review(_stored_reviews(t), _answers(t))
    return after.select("review_id", "excerpt", F.col("resolved_at").isNotNull().alias("resolved"), "learned_pattern")


@add("r08_undo_events", """SELECT doc_id + 1 AS case_id, CAST(doc_id AS VARCHAR) AS merged_id, 'split' AS to FROM documents WHERE doc_id % 6 = 0 AND doc_id % 11 <> 0""".replace("AS to", 'AS "to"'))
def r08(t):
    return ops.resolve_review(_stored_reviews(t), _answers(t))[1].select("case_id", "merged_id", "to")


cte("placed_", """SELECT s.*, coalesce(s.role, 'unknown') AS text, h.case_id AS on_thread, d.decision, d.case_id AS known_case FROM signals_ s JOIN decided_ d USING (signal_id)
  LEFT JOIN (SELECT user_id, p_thread_id, arg_max(case_id, (occurred_at, seq)) AS case_id FROM ev WHERE p_thread_id IS NOT NULL GROUP BY ALL) h
  ON h.user_id = s.user_id AND h.p_thread_id = CASE WHEN s.signal_id % 5 = 0 THEN concat('t-', s.signal_id % 400) END""", "signals_ decided_ ev")
cte("opened_", """SELECT *, row_number() OVER (PARTITION BY user_id, company_id ORDER BY since, first) AS i FROM (
  SELECT user_id, company_id, text, min(occurred_at) AS since, arg_min(signal_id, (occurred_at, signal_id)) AS first FROM placed_ WHERE on_thread IS NULL AND decision = 'create' GROUP BY ALL) x""", "placed_")
cte("close_", """SELECT a.user_id, a.company_id, a.i, a.text, coalesce(list(b.text ORDER BY c.c DESC, b.since) FILTER (b.text IS NOT NULL), []) AS near FROM opened_ a
  LEFT JOIN (cosines c JOIN opened_ b ON b.text = c.b AND c.c >= 0.82) ON c.a = a.text AND b.user_id = a.user_id AND b.company_id = a.company_id AND b.i < a.i GROUP BY ALL""", "opened_ cosines")
# Text after text of a company: the nearest that opened a case before, or a case of its own.
_LED = """WITH RECURSIVE walk AS (SELECT user_id, company_id, 0::BIGINT AS i, []::VARCHAR[] AS open, NULL::VARCHAR AS text, NULL::VARCHAR AS leads FROM (SELECT DISTINCT user_id, company_id FROM opened_) x
    UNION ALL SELECT user_id, company_id, i, CASE WHEN leads = text THEN list_append(open, text) ELSE open END, text, leads FROM (
      SELECT w.user_id, w.company_id, c.i, w.open, c.text, coalesce(list_filter(c.near, lambda x: list_contains(w.open, x))[1], c.text) AS leads
      FROM walk w JOIN close_ c ON c.user_id = w.user_id AND c.company_id = w.company_id AND c.i = w.i + 1) y)
  SELECT * FROM walk WHERE i > 0"""


@add("r05_place_signals", f"""SELECT p.signal_id, CASE WHEN on_thread IS NOT NULL THEN 'thread' ELSE p.decision END AS decision,
  CASE WHEN on_thread IS NOT NULL THEN on_thread WHEN p.decision = 'attach' THEN known_case WHEN p.decision = 'create' THEN min(CASE WHEN on_thread IS NULL AND p.decision = 'create' THEN p.signal_id END) OVER (PARTITION BY p.user_id, p.company_id, l.leads) END AS case_id
  FROM placed_ p LEFT JOIN ({_LED}) l ON l.user_id = p.user_id AND l.company_id = p.company_id AND l.text = p.text AND p.on_thread IS NULL AND p.decision = 'create'""", uses="placed_ opened_ close_")
def place(t):
    """The whole batch: thread, open cases, then new ones, which are shown by their first signal."""
    rows = signals(t).withColumn("thread_id", F.expr("CASE WHEN signal_id % 5 = 0 THEN concat('t-', signal_id % 400) END")).withColumn("case_hint", F.lit(None).cast("bigint"))
    out = cut_lineage(ops.place_signals(rows, cases(t), log_ops.thread_map(t.log)))
    new = out.filter("decision = 'create'").groupBy("case_id").agg(F.min("signal_id").alias("first"))
    shown = F.when(F.col("decision") == "create", F.col("first")).otherwise(F.col("case_id"))
    return out.join(new, "case_id", "left").select("signal_id", "decision", shown.alias("case_id"))


cte("roles_planted", """SELECT p_partkey % 20 AS user_id, unnest([p_name, upper(p_name), concat(p_name, ' ', p_partkey % 97), concat(p_name, ' ', p_partkey % 97, ' ii')]) AS text FROM part""")
vectors_cte("plvec", "SELECT DISTINCT text FROM roles_planted", "roles_planted")


@add("j12_planted_pairs", """SELECT DISTINCT a.user_id, a.text AS left_text, b.text AS right_text FROM roles_planted a JOIN roles_planted b ON a.user_id = b.user_id AND a.text < b.text
  JOIN (SELECT x.text AS p, y.text AS q, sum(x.w * y.w) AS c FROM plvec x JOIN plvec y ON x.dim = y.dim AND x.text < y.text GROUP BY ALL HAVING sum(x.w * y.w) >= 0.93) c
  ON c.p = a.text AND c.q = b.text""", uses="roles_planted plvec")
def j12_planted(t):
    """Names of all parts with three spellings of each: those that say the same at the threshold of a merge."""
    number = (F.col("p_partkey") % 97).cast("string")
    texts = F.array("p_name", F.upper("p_name"), F.concat_ws(" ", "p_name", number), F.concat_ws(" ", "p_name", number, F.lit("ii")))
    rows = t.raw("part").select((F.col("p_partkey") % 20).alias("user_id"), F.lit(0).alias("company_id"), F.explode(texts).alias("role_title"))
    rows = rows.withColumns({
        "role_normalised": F.lit(None).cast("string"), "merged_into_id": F.lit(None).cast("long"), "status": F.lit("live"),
    })
    return ops.pairwise_duplicates(rows).select("user_id", "left_text", "right_text")


@add("r06_duplicates_of_orders", """SELECT a.case_id, arg_min(b.case_id, [abs(epoch_us(a.at) - epoch_us(b.at)), b.case_id]) AS partner_id
  FROM (SELECT o_orderkey AS case_id, o_custkey % 100 AS user_id, o_orderpriority AS text, o_orderdate AS at FROM orders) a
  JOIN (SELECT o_orderkey AS case_id, o_custkey % 100 AS user_id, o_orderpriority AS text, o_orderdate AS at FROM orders) b
  ON a.user_id = b.user_id AND a.text = b.text AND a.case_id <> b.case_id AND abs(epoch_us(a.at) - epoch_us(b.at)) <= 14 * 86400000000 GROUP BY a.case_id""")
def r06_orders(t):
    """All orders as cases whose text is their priority: groups of many, and of many on one day."""
    none = F.lit(None)
    rows = t.raw("orders").select(
        (F.col("o_custkey") % 100).alias("user_id"), F.lit(0).cast("long").alias("company_id"), F.col("o_orderkey").alias("case_id"),
        F.col("o_orderpriority").alias("role_title"), none.cast("string").alias("role_normalised"), F.lit("live").alias("status"),
        F.lit("applied").alias("current_stage"), none.cast("long").alias("merged_into_id"), F.lit(False).alias("manually_created"),
        none.cast("string").alias("work_mode"), none.cast("string").alias("location"), F.col("o_orderdate").cast("timestamp").alias("applied_at"),
    )
    splits = rows.select("user_id", "case_id", F.col("case_id").alias("other_id")).limit(0)
    return ops.find_duplicates(rows, splits).select("case_id", "partner_id")
