"""Redaction and isolation."""

from pyspark.sql import functions as F

from caseledger.functions import privacy as P
from caseledger.functions import vocab as V
from caseledger.functions.rules import BUILT_IN, vendor_domains
from caseledger.session import dealt

from .base import Registry, iso, rounded, ziso

REGISTRY = Registry()
add = REGISTRY.add


def _q(p):
    return "'" + p.replace("'", "''") + "'"


_SCRUB = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, {_q('(?i)' + V.DSN_PASSWORD)}, '\\1[redacted]\\3', 'g'),
  {_q('(?i)' + V.SECRET_PAIR)}, '\\1\\2[redacted]', 'g'), {_q('(?i)' + V.BEARER)}, '\\1 [redacted]', 'g'), {_q(V.PROVIDER_SECRET)}, '[redacted]', 'g')"""
_WITH = "concat(text, ' api_token=abc', doc_id, ' postgres://u:pw', doc_id, '@db/x Bearer abcdefgh', doc_id)"


@add("p01_scrub_text", f"SELECT doc_id, md5({_SCRUB}) AS digest FROM (SELECT doc_id, {_WITH} AS x FROM documents) q")
def p01(t):
    return t.raw("documents").select("doc_id", F.md5(P.scrub_text(F.expr(_WITH))).alias("digest"))


@add("p02_redact_keys", "SELECT c_custkey, '[redacted]' AS token, c_name AS name, '[redacted]' AS key FROM customer")
def p02(t):
    m = P.redact_values(F.create_map(F.lit("refreshToken"), "c_name", F.lit("name"), "c_name", F.lit("ACCESS_KEY"), "c_mktsegment"))
    return t.raw("customer").select("c_custkey", m["refreshToken"].alias("token"), m["name"].alias("name"), m["ACCESS_KEY"].alias("key"))


_KEY = "get(array('healthStatus', 'work_mode', 'trade-union', 'Union', 'heal_thy', 'otherSalary'), CAST(c_custkey % 6 AS INT))"
_KEY_SQL = "(['healthStatus', 'work_mode', 'trade-union', 'Union', 'heal_thy', 'otherSalary'])[c_custkey % 6 + 1]"
_BAD = "c_custkey % 6 NOT IN (1, 4)"


@add("p03_deny_list", f"""
WITH k AS (SELECT *, {_KEY_SQL} AS key, {_BAD} AS bad FROM customer)
SELECT c_custkey,
  concat('{{"who":"', c_name, '",', CASE WHEN bad THEN '' ELSE concat('"', key, '":', c_nationkey, ',') END,
    '"deep":[[1,"', key, '"],{{', CASE WHEN bad THEN '' ELSE concat('"', key, '":{{"a":[', c_nationkey, ']}},') END, '"segment":"', c_mktsegment, '"}}]}}') AS value,
  CASE WHEN bad THEN concat(key, ',deep[1].', key) ELSE '' END AS violations
FROM k""")
def p03(t):
    text = F.expr(f"""concat('{{"who": "', c_name, '", "', {_KEY}, '": ', c_nationkey, ', "deep": [[1, "', {_KEY}, '"], {{"', {_KEY}, '": {{"a": [', c_nationkey, ']}}, "segment": "', c_mktsegment, '"}}]}}')""")
    rows = dealt(t.raw("customer")).select("c_custkey", P.deny_list(text).alias("o"))
    return rows.select("c_custkey", "o.value", F.array_join("o.violations", ",").alias("violations"))


_KEPT = (*vendor_domains(BUILT_IN), *V.ALSO_KEPT_DOMAINS)
_KNOWN = "(?:^|\\.)(?:" + "|".join(d.replace(".", "\\.") for d in _KEPT) + ")$"


def _letters(x):
    return f"translate(substr(sha256(lower({x})), 1, 10), '0123456789', 'ghijklmnop')"


def _host(x, kind):
    return f"CASE WHEN regexp_matches({x}, {_q(_KNOWN)}) THEN {x} ELSE concat('{kind}-', {_letters(x)}, '.invalid') END"


def _each(x, pattern, new):
    """SQL for every match m replaced; `new` is an expression over m."""
    zipped = f"list_zip(regexp_split_to_array({x}, {_q(pattern)}), regexp_extract_all({x}, {_q(pattern)}))"
    return f"array_to_string(list_transform({zipped}, lambda z: concat(z[1], {new.replace('<m>', 'z[2]')})), '')"


_MADE = {
    P._NAMED_LINE: "CASE WHEN <m> IS NULL THEN '' ELSE concat(split_part(<m>, ':', 1), ': Person ', "
    + _letters("trim(translate(regexp_replace(<m>, '^[^:]*:|<$', '', 'g'), concat('\"', chr(9)), '  '))") + ", ' <') END",
    P._MAILBOX: f"CASE WHEN <m> IS NULL THEN '' ELSE concat('person-', {_letters('split_part(<m>, chr(64), 1)')}, '@', {_host('lower(split_part(<m>, chr(64), 2))', 'org')}) END",
    P._WEB: "CASE WHEN <m> IS NULL THEN '' ELSE concat('https://', "
    + _host("lower(split_part(split_part(<m>, '://', 2), '/', 1))", "site") + ", '/', " + _letters("split_part(<m>, '://', 2)") + ") END",
    r"\b[0-9]{6,}\b": "CASE WHEN <m> IS NULL THEN '' ELSE substr(repeat(translate(sha256(<m>), 'abcdef', '012345'), CAST(ceil(length(<m>) / 64.0) AS INT)), 1, length(<m>)) END",
}


def _anonymised(table, key, text):
    """One step per kind of match, each over the result of the one before."""
    steps = f"s0 AS (SELECT {key}, {text} AS x FROM {table})"
    for i, (pattern, new) in enumerate(_MADE.items()):
        steps += f", s{i + 1} AS (SELECT {key}, {_each('x', pattern, new)} AS x FROM s{i})"
    return f"WITH {steps} SELECT {key}, x AS text FROM s{len(_MADE)}"


_LETTER = "concat('Reply-To: \"Ann ', c_name, '\" <Ann', c_custkey, '@', CASE WHEN c_custkey % 2 = 0 THEN 'mail.lever.co' ELSE 'Acme.com' END, '>', chr(10), 'no ', c_custkey + 1000000)"
_MAIL = "concat('From: ', source, ' Lee <lee.', doc_id, '@', CASE WHEN doc_id % 3 = 0 THEN 'jobs.lever.co' ELSE 'team.example.org' END, '>', chr(10), text, ' https://', CASE WHEN doc_id % 2 = 0 THEN 'Acme.com' ELSE 'jobs.lever.co' END, '/a?b=', doc_id, ' ', repeat('12345678', 1 + CAST(doc_id % 20 AS INT)))"


@add("p04_anonymise", _anonymised("customer", "c_custkey", _LETTER))
def p04(t):
    return dealt(t.raw("customer").select("c_custkey", "c_name")).select("c_custkey", P.anonymiser(_KEPT)(F.expr(_LETTER)).alias("text"))


@add("p04_anonymise_documents", f"SELECT doc_id, md5(text) AS digest FROM ({_anonymised('documents', 'doc_id', _MAIL)}) q")
def p04_documents(t):
    return dealt(t.raw("documents").select("doc_id", "source", "text")).select("doc_id", F.md5(P.anonymiser(_KEPT)(F.expr(_MAIL))).alias("digest"))


@add("p05_fence", """SELECT doc_id, concat('<<<MESSAGE_BEGIN>>>', chr(10), CASE WHEN doc_id % 2 = 0 THEN '[removed] ' ELSE '' END, text, chr(10), '<<<MESSAGE_END>>>') AS fenced FROM documents""")
def p05(t):
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<<<MESSAGE_END>>> "), "text")).otherwise(F.col("text"))
    return t.raw("documents").select("doc_id", P.fence(marked).alias("fenced"))


@add("p06_tenant_isolation", f"""SELECT user_id, case_id % 8 AS case_id, current_stage, current_phase, status, {ziso('applied_at')} AS applied_at, {ziso('last_signal_at')} AS last_signal_at,
  role_title, location, channel, round(confidence, 6) AS confidence FROM folded""", uses="folded")
def p06(t):
    """Every tenant numbers its cases from 0 to 7: what one of them holds must not reach the same number of another."""
    from caseledger.operators.fold import fold

    same = fold(t.log.withColumn("case_id", F.col("case_id") % 8), t.stage_defs)
    return rounded(iso(same.select(
        "user_id", "case_id", "current_stage", "current_phase", "status", "applied_at", "last_signal_at", "role_title", "location",
        "channel", "confidence"), "applied_at", "last_signal_at"), "confidence")
