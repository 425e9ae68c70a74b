"""Text, names, phrases and postings."""

from pyspark.sql import functions as F

from caseledger.functions import names as N
from caseledger.functions import text as X
from caseledger.functions import vocab as V
from caseledger.functions.rules import BUILT_IN, vendor_domains
from caseledger.session import dealt

from .base import Registry
from .patterns import group, has, lit, re2
from .shapes import TITLES, cte, pick, to_spark

REGISTRY = Registry()
add = REGISTRY.add

_HIDDEN = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<head\b[^>]*>.*?</head>|<!--.*?-->"
_ANCHOR = V.ANCHOR.replace("(?s)", "(?is)", 1)
_WS = r"[\s\p{Z}]"


def _strip(x):
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


cte("flat_pages", f"""SELECT page_id, regexp_replace(regexp_replace(body, '(?i)</?(?:p|div|br|tr|li|h[1-6]|table|blockquote|section|article)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS flat
  FROM (SELECT page_id, concat(list_reduce(list_prepend('', list_transform(range(1, len(a) + 1), lambda i: concat(s[i],
      CASE WHEN l[i] <> '' AND NOT regexp_matches(lower(l[i]), '^https?://') THEN concat(l[i], ' (', h[i], ')') ELSE concat(' ', h[i], ' ') END))), lambda x, y: concat(x, y)), s[len(a) + 1]) AS body
    FROM (SELECT *, regexp_extract_all(html, {lit(_ANCHOR)}, 0) AS a, regexp_extract_all(html, {lit(_ANCHOR)}, 1) AS h,
      list_transform(regexp_extract_all(html, {lit(_ANCHOR)}, 2), lambda z: {_strip("regexp_replace(z, '<[^>]+>', '', 'g')")}) AS l,
      regexp_split_to_array(html, {lit(_ANCHOR)}) AS s FROM (
      SELECT page_id, regexp_replace(regexp_replace(html, {lit(_HIDDEN)}, ' ', 'g'), '(?i)<img\\b[^>]*>', ' ', 'g') AS html FROM pages) p0) p1) p2""")


@add("x01_html_to_text", "SELECT page_id, md5(flat) AS digest FROM flat_pages", uses="flat_pages")
def x01(t):
    """Digests of the flattened pages, before entities are resolved."""
    return t.raw("pages").select("page_id", F.md5(X.flatten_html(F.col("html"))).alias("digest"))


def _resolved(x):
    """Named references one after the other, the ampersand last."""
    for name, code in sorted(X._NAMED.items(), key=lambda n: n[0] == "amp"):
        x = f"replace({x}, '&{name};', chr({code}))"
    return x


_MORE = " &#8364;&#x41; &eacute; &nosuch; &amp;lt; &#0; &#x110000; &"


@add("x01_html_unescaped", f"""SELECT page_id, md5(concat({_resolved('flat')}, ' €A é &nosuch; &lt; &#0; &#x110000; &')) AS digest FROM flat_pages""", uses="flat_pages")
def x01_full(t):
    page = F.concat("html", F.lit(_MORE))
    return t.raw("pages").select("page_id", F.md5(X.html_to_text(page)).alias("digest"))


_TAILS = ("", "\nOn Mon, 1 Jan 2024, Ann Example wrote:\n> hi", "\n> one\n > two", "\n--\nAnn", "\nFrom: a@b.c\nSent: today\nx", "\n\n\n\nend \t x")


def _raw_message(engine):
    return f"concat(text, {pick('doc_id', _TAILS)})" if engine == "duck" else f"concat(text, {to_spark(pick('doc_id', _TAILS))})"


def _tail_sql():
    arms = " ".join(f"WHEN {i} THEN '" + v.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for i, v in enumerate(_TAILS))
    return f"concat(text, CASE doc_id % 6 {arms} END)"


def _with_tail(t):
    tails = F.array(*[F.lit(x) for x in _TAILS])
    return dealt(t.raw("documents").select("doc_id", "text")).select("doc_id", F.concat("text", F.get(tails, (F.col("doc_id") % 6).cast("int"))).alias("raw"))


_CUTS = ", ".join(f"regexp_split_to_array(raw, {lit('(?im)' + m)})[1]" for m in V.QUOTE_MARKERS)
_HEADS = f"list_sort(list_transform([{_CUTS}], lambda z: [printf('%09d', length(z)), z]))[1][2]"
cte("quoteless", f"""SELECT doc_id, raw, regexp_replace({_HEADS}, '(?:(?:^|\\n)[^\\S\\n]*>[^\\n]*)+$', '') AS body
  FROM (SELECT doc_id, {_tail_sql()} AS raw FROM documents) q""")


@add("x02_strip_quoted_history", "SELECT doc_id, md5(body) AS digest, length(body) AS n FROM quoteless", uses="quoteless")
def x02(t):
    body = X.strip_quoted_history(F.col("raw"))
    return _with_tail(t).select("doc_id", F.md5(body).alias("digest"), F.length(body).cast("bigint").alias("n"))


@add("x03_normalise_text", f"""SELECT doc_id, md5(b) AS digest, false AS truncated, md5(substr(b, 1, 6000)) AS first, length(b) > 6000 AS more FROM (
  SELECT doc_id, {_strip("regexp_replace(regexp_replace(regexp_replace(regexp_split_to_array(body, '(?m)^\\s*--\\s*$')[1], '\\r\\n?', chr(10), 'g'), '[ \\t' || chr(160) || ']+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS b
  FROM quoteless) x""", uses="quoteless")
def x03(t):
    parts, cut = X.normalise_text(F.col("raw")), X.normalise_text(F.col("raw"), 6000)
    return _with_tail(t).select("doc_id", F.md5(parts["text"]).alias("digest"), parts["truncated"].alias("truncated"), F.md5(cut["text"]).alias("first"), cut["truncated"].alias("more"))


@add("x04_extract_links", """SELECT page_id, array_to_string(list_transform(list_filter(list_zip(u, range(1, len(u) + 1)), lambda z: list_position(u, z[1]) = z[2]), lambda z: z[1]), ' ') AS links
  FROM (SELECT page_id, regexp_extract_all(html, '(?i)https?://[^\\s<>"'')]+') AS u FROM pages) x""")
def x04(t):
    return t.raw("pages").select("page_id", F.array_join(X.extract_links(F.col("html")), " ").alias("links"))


@add("x05_excerpt", f"""SELECT doc_id, CASE WHEN length(f) <= 280 THEN f ELSE concat(CASE WHEN sp > 168 THEN substr(f, 1, sp) ELSE substr(f, 1, 280) END, '…') END AS excerpt
  FROM (SELECT doc_id, f, 280 - nullif(strpos(reverse(substr(f, 1, 280)), ' '), 0) AS sp FROM (
    SELECT doc_id, {_strip(f"regexp_replace(text, '{_WS}+', ' ', 'g')")} AS f FROM documents) x) y""")
def x05(t):
    return t.raw("documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


@add("x06_detect_language", f"""SELECT doc_id, CASE WHEN i = 0 AND e = 0 THEN 'other' WHEN i > e THEN 'it' ELSE 'en' END AS language FROM (
  SELECT doc_id, len(regexp_extract_all(a, {lit('(?i)' + V.ITALIAN_WORDS)})) AS i, len(regexp_extract_all(a, {lit('(?i)' + V.ENGLISH_WORDS)})) AS e
  FROM (SELECT doc_id, regexp_replace(text, '[\\p{{L}}\\p{{N}}--[A-Za-z0-9]]|[^\\x00-\\x7F]', 'z', 'g') AS a FROM documents) x) y""".replace("[\\p{L}\\p{N}--[A-Za-z0-9]]|", ""))
def x06(t):
    return t.raw("documents").select("doc_id", X.detect_language(F.col("text")).alias("language"))


@add("x32_body_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def x32(t):
    return t.raw("documents").select("doc_id", X.body_hash(F.col("text")).alias("hash"))


_FORMS = (" S.r.l.", " GmbH", " Ltd", " S.p.A. Ltd", "", " Inc.", " b.v.", ", LLC")
_NAME = f"concat(c_name, {pick('c_custkey', _FORMS)})"


@add("x07_normalise_company", "SELECT c_custkey, replace(lower(c_name), '#', ' ') AS name FROM customer")
def x07(t):
    return t.raw("customer").select("c_custkey", N.normalise_company(F.expr(to_spark(_NAME))).alias("name"))


@add("x08_company_key", "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS key FROM customer")
def x08(t):
    return t.raw("customer").select("c_custkey", N.company_key(F.expr(to_spark(_NAME))).alias("key"))


@add("x09_normalise_role", """SELECT p_partkey, concat(p_name, (['', ' engineer', ' developer', ' quality assurance'])[p_partkey % 4 + 1]) AS role,
  (['senior', 'junior', NULL, 'lead'])[p_partkey % 4 + 1] AS seniority, (['Remote', 'Milano', 'Berlin', NULL])[p_partkey % 4 + 1] AS location,
  (['remote', NULL, NULL, 'hybrid'])[p_partkey % 4 + 1] AS work_mode FROM part""")
def x09(t):
    raw = F.expr("""get(array(concat('Sr. ', p_name, ' (Remote) - Full-time'), concat('Junior ', p_name, ' Eng, Milano'),
      concat(p_name, ' Dev | Berlin | permanent'), concat('Lead ', p_name, ' QA contract ibrido')), CAST(p_partkey % 4 AS INT))""")
    parts = N.normalise_role(F.regexp_replace(raw, "contract ibrido", "contract"))
    mode = N.normalise_role(raw)["work_mode"]
    return dealt(t.raw("part").select("p_partkey", "p_name")).select("p_partkey", parts["role"].alias("role"), parts["seniority"].alias("seniority"),
                                parts["location"].alias("location"), mode.alias("work_mode"))


@add("x10_addresses", r"""SELECT doc_id, lower(regexp_extract(sender, '<?([^<>\s]+)@([A-Za-z0-9.-]+)>?', 2)) AS domain,
  lower(regexp_extract(sender, '[^\s<>,;]+@[^\s<>,;]+')) AS address FROM msg""", uses="msg")
def x10(t):
    return t.messages.select("doc_id", X.domain_of_address(F.col("sender")).alias("domain"), X.address_of(F.col("sender")).alias("address"))


_DOMAINS = ("acme.com", "a.b.co.uk", "single", "mail.nova-labs.io", "x.y.gov.it", "jobs.example.com")


@add("x11_domain_label", f"SELECT c_custkey, {pick('c_custkey', ('acme', 'b', 'single', 'nova-labs', 'y', 'example'))} AS label FROM customer")
def x11(t):
    return t.raw("customer").select("c_custkey", X.domain_label(F.expr(to_spark(pick("c_custkey", _DOMAINS)))).alias("label"))


@add("x12_country_of", f"SELECT c_custkey, {pick('c_custkey', ('it', 'de', 'gb', 'unknown', None, 'es', 'nl', 'fr'))} AS country FROM customer")
def x12(t):
    places = ("Milano, Italy", "Greater Munich", "UK remote", "Atlantis", None, "BARCELONA", "Amsterdam", "Lyon")
    return t.raw("customer").select("c_custkey", N.country_of(F.expr(to_spark(pick("c_custkey", places)))).alias("country"))


EXPECTED_COMPANIES = ("Acme", "Prima", "Company3", "LinkedIn", "Indeed", "GitHub", None, "Nova", "Example", "Workable", "LeetCode", "Company7")


@add("x13_company_from_sender", f"SELECT doc_id, {pick('doc_id', tuple('Marco Rossi' if v is None else v for v in EXPECTED_COMPANIES))} AS company FROM documents".replace("'Marco Rossi'", "NULL"))
def x13(t):
    """Each of the twelve senders names one company, or none for a person's own mailbox."""
    return t.messages.select("doc_id", N.company_from_sender(F.col("sender"), vendor_domains(BUILT_IN)).alias("company"))


def _clean_sql(x):
    flat = _strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")
    cut = _strip(f"regexp_replace({flat}, {lit(re2(V.SENTENCE_RESUMES).replace('(?i)', '(?i)', 1))}, '', 'g')")
    return _strip(f"regexp_replace({cut}, '[-–—:;,]+$', '')")


def role_sql(text):
    found = ", ".join(group(text, p.replace("(?m)", "")).replace("'(?i)", "'(?im)" if p.startswith("(?m)") else "'(?i)", 1) for p in V.ROLE_PATTERNS)
    cleaned = f"list_transform([{found}], lambda z: {_clean_sql('z')})"
    fits = f"length(z) BETWEEN 3 AND 60 AND NOT {has('z', V.NOT_A_TITLE)} AND len(regexp_split_to_array(z, '\\s+')) <= 6 AND {has('z', V.ROLE_VOCABULARY)}"
    return f"list_filter({cleaned}, lambda z: {fits})[1]"


@add("x14_role_from_body", f"SELECT doc_id, {role_sql('text')} AS role FROM msg", uses="msg")
def x14(t):
    rows = t.messages.withColumn("low", F.lower("text"))
    return rows.select("doc_id", N.role_from_body(F.col("text"), F.col("low")).alias("role"))


def phrase_sql(text):
    arms = " ".join(f"WHEN {has(text, p[3])} THEN {i}" for i, p in enumerate(V.PHRASES, start=1))
    return f"CASE {arms} END"


_PH = "concat(subject, chr(10), text)"
_PHRASE_VALUES = ", ".join(f"({i}, '{p[0]}', {p[1]}::DOUBLE)" for i, p in enumerate(V.PHRASES, start=1))


@add("x15_match_phrase", f"""SELECT doc_id, v.intent, v.confidence FROM (SELECT doc_id, {phrase_sql(_PH)} AS i FROM msg) m
  LEFT JOIN (VALUES {_PHRASE_VALUES}) v(i, intent, confidence) USING (i)""", uses="msg")
def x15(t):
    facts = N.phrase_facts(F.col("_i"))
    rows = t.messages.withColumn("hay", F.concat(F.col("subject"), F.lit("\n"), F.col("text"))).withColumn("low", F.lower("hay"))
    return rows.select("doc_id", N.phrase_index(F.col("hay"), F.col("low")).alias("_i")).select(
        "doc_id", facts["intent"].alias("intent"), facts["confidence"].alias("confidence"))


@add("x16_stage_from_title", f"SELECT doc_id, {pick('doc_id', ('technical', 'hr_call', 'final', None, 'take_home'))} AS stage FROM documents")
def x16(t):
    return t.raw("documents").select("doc_id", N.stage_from_title(F.expr(to_spark(pick("doc_id", TITLES)))).alias("stage"))


@add("x17_channel_for_vendor", f"""SELECT doc_id, {pick('doc_id', ('career_page', 'career_page', 'recruiter', 'linkedin', 'indeed', 'recruiter', None, 'recruiter', 'recruiter', 'career_page', 'recruiter', 'recruiter'))} AS channel FROM documents""")
def x17(t):
    from caseledger.functions.rules import rule_tables
    from caseledger.operators.screening import vendor_of

    rows = vendor_of(t.messages.withColumn("sender_domain", X.domain_of_address(F.col("sender"))), rule_tables(t.spark)[0])
    return rows.select("doc_id", N.channel_for_vendor(F.col("vendor"), F.col("sender_domain")).alias("channel"))


@add("x18_posting_url", f"SELECT doc_id, nullif(regexp_extract(text, {lit('(?i)' + V.POSTING_URL)}), '') AS url FROM msg", uses="msg")
def x18(t):
    return t.messages.select("doc_id", N.posting_url(F.col("text")).alias("url"))


_VENDOR = " ".join(f"WHEN regexp_matches(url, '(?i){p}') OR regexp_matches(html, '(?i){p}') THEN '{v}'" for p, v in V.POSTING_VENDORS)


@add("x19_parse_posting", f"""SELECT page_id, nullif({_strip("regexp_extract(html, '(?i)<title>([^<]+)</title>', 1)")}, '') AS role,
  CASE {_VENDOR} END AS ats_vendor, NULL::VARCHAR AS company FROM pages""")
def x19(t):
    parts = N.parse_posting(F.col("url"), F.col("html"))
    return t.raw("pages").select("page_id", parts["role"].alias("role"), parts["ats_vendor"].alias("ats_vendor"), parts["company"].alias("company"))


@add("x19_structured_posting", """SELECT page_id, concat('Role ', page_id) AS role, CASE WHEN page_id % 2 = 0 THEN concat('Co ', page_id) ELSE 'Site Co' END AS company,
  CASE WHEN page_id % 2 = 0 THEN 'Milano' END AS location, CASE WHEN page_id % 2 = 0 THEN CAST(page_id * 100 AS BIGINT) END AS min_minor,
  CASE WHEN page_id % 4 = 0 AND page_id > 0 THEN CAST(page_id * 200 AS BIGINT) END AS max_minor, CASE WHEN page_id % 2 = 0 THEN 'EUR' END AS currency FROM pages""")
def x19_structured(t):
    """Pages with job data put in front of them: half as structured data, half as open graph."""
    ld = """concat('<script type="application/ld+json">', CASE WHEN page_id % 3 = 0 THEN '[' ELSE '' END, '{"title":"Role ', page_id,
      '","hiringOrganization":{"name":"Co ', page_id, '"},"jobLocation":{"address":{"addressLocality":"Milano"}},"baseSalary":{"value":{"minValue":', page_id,
      CASE WHEN page_id % 4 = 0 THEN concat(',"maxValue":', page_id * 2) ELSE '' END, '}}}', CASE WHEN page_id % 3 = 0 THEN ']' ELSE '' END, '</script>', html)"""
    og = """concat('<meta property="og:title" content="Role ', page_id, '"><meta property="og:site_name" content="Site Co">', html)"""
    html = F.expr(f"CASE WHEN page_id % 2 = 0 THEN {ld} ELSE {og} END")
    parts = N.parse_posting(F.col("url"), html)
    return t.raw("pages").select("page_id", *[parts[c].alias(c) for c in ("role", "company", "location", "min_minor", "max_minor", "currency")])


@add("x33_comp_to_minor", """SELECT o_orderkey, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS minor, nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN '   ' ELSE concat(' ', o_orderpriority, ' ') END), '') AS text FROM orders""")
def x33(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, "   ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    return t.raw("orders").select("o_orderkey", N.comp_to_minor(F.col("o_totalprice")).alias("minor"), N.clean_text(text).alias("text"))


@add("u02_alias_keys", """SELECT c_custkey, a AS alias FROM (SELECT DISTINCT c_custkey, unnest([nullif(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), ''), CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('alias', c_custkey) END]) AS a FROM customer) x WHERE a IS NOT NULL""")
def u02(t):
    from caseledger.operators.resolution import alias_keys

    rows = t.raw("customer").select(
        "c_custkey", F.expr("CASE WHEN c_custkey % 3 <> 0 THEN concat('alias', c_custkey) END").alias("alias"), F.col("c_name").alias("name"))
    return rows.select("c_custkey", F.explode(alias_keys(F.col("alias"), F.col("name"))).alias("alias"))


_HOST = """concat(regexp_extract(url, '://([^/:?#]+)', 1), CASE page_id % 3 WHEN 0 THEN '.uk' WHEN 1 THEN '' ELSE '.' END)"""


@add("x11_domain_labels_of_pages", f"""SELECT page_id, CASE WHEN len(p) < 2 THEN d WHEN len(p) >= 3 AND length(p[-1]) <= 3 AND length(p[-2]) <= 3 THEN p[-3] ELSE p[-2] END AS label
  FROM (SELECT page_id, d, list_filter(string_split(d, '.'), lambda x: x <> '') AS p FROM (
    SELECT page_id, CASE WHEN page_id % 7 = 0 THEN regexp_extract({_HOST}, '^([^.]+)', 1) ELSE {_HOST} END AS d FROM pages) a) b""")
def x11_pages(t):
    """The owners of the hosts of all pages, a third of them below a two-part ending, some of a single label."""
    host = F.concat(
        F.regexp_extract("url", "://([^/:?#]+)", 1), F.expr("CASE page_id % 3 WHEN 0 THEN '.uk' WHEN 1 THEN '' ELSE '.' END")
    )
    host = F.when(F.col("page_id") % 7 == 0, F.regexp_extract(host, "^([^.]+)", 1)).otherwise(host)
    return t.raw("pages").select("page_id", X.domain_label(host).alias("label"))


_PLACES = tuple(p.title() if i % 2 else p.upper() for i, p in enumerate(p for names, _ in V.COUNTRIES for p in names)) + ("Atlantis", "Oslo")
_PLACE_SQL = f"concat(n_name, ' / ', {pick('c_custkey', _PLACES)}, CASE WHEN c_custkey % 5 = 0 THEN ' (remote)' ELSE '' END)"


@add("x12_countries_of_places", "SELECT c_custkey, CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(lower(place), {lit(p)})' for p in names)} THEN '{code}'" for names, code in V.COUNTRIES
) + f" ELSE 'unknown' END AS country FROM (SELECT c_custkey, {_PLACE_SQL} AS place FROM customer JOIN nation ON n_nationkey = c_nationkey) q")
def x12_places(t):
    """A nation and one of all known places for every customer: the first country named in the order of the list."""
    rows = t.raw("customer").join(t.raw("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select("c_custkey", N.country_of(F.expr(to_spark(_PLACE_SQL))).alias("country"))


_SAID = ("Technical interview", "final chat with the CEO", "On-site loop", "System design round", "pair programming", "take home review", "HR intro", "weekly sync")
_TITLE_SQL = f"concat(substr(text, 1 + doc_id % 9, 12 + doc_id % 40), CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE ': ' END, {pick('doc_id', _SAID)}, CASE WHEN doc_id % 3 = 0 THEN substr(text, 20, 30) ELSE '' END)"


@add("x16_stages_of_titles", "SELECT doc_id, CASE WHEN title IS NULL THEN NULL " + " ".join(
    f"WHEN {has('title', pattern)} THEN '{stage}'" for pattern, stage in V.TITLE_STAGES
) + f" END AS stage FROM (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_TITLE_SQL} END AS title FROM documents) q")
def x16_titles(t):
    """Titles made of the documents' own words around the name of a meeting."""
    title = F.expr(to_spark(_TITLE_SQL).replace("doc_id % 9,", "CAST(doc_id % 9 AS INT),").replace("12 + doc_id % 40)", "CAST(12 + doc_id % 40 AS INT))"))
    return t.raw("documents").select("doc_id", N.stage_from_title(F.when(F.col("text").isNotNull(), title)).alias("stage"))
