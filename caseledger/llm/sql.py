"""DuckDB SQL of the queries that SQL can express."""

from . import licenses
from .line_rules import ENDS, PHRASES, Rules

_RULES = Rules()
_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"
_SYMBOL = "[#*$%&|<>]"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


_END = _quoted("[" + "".join("\\" + e if e in ".?])" else e for e in ENDS) + "]" + _SPACE + "*$")
_PHRASES = "|".join(PHRASES)

LINE_RULES = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM docs
),
counted AS (
  SELECT *, {_count("line", _WORD)} AS n,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again
  FROM lines
),
ruled AS (
  SELECT *,
    100 * {_count("line", _SYMBOL)} >= {_RULES.noise_percent} * n
    OR 100 * {_count("line", "!!")} >= {_RULES.noise_percent} * n
    OR ({_count("line", "[|]")} > 1 AND 100 * {_count("line", "[|]")} >= {_RULES.separator_percent} * n)
    OR (n <= {_RULES.label_words} AND NOT regexp_matches(line, '{_END}'))
    OR again
    OR (n <= {_RULES.phrase_words} AND regexp_matches(lower(line), '{_PHRASES}')) AS fails
  FROM counted WHERE n > 0
),
by_line AS (
  SELECT doc_id, count(*) FILTER (again) AS dups, sum(n) FILTER (fails) AS lost FROM ruled GROUP BY doc_id
),
clean AS (
  SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.pos) AS clean_text
  FROM counted c LEFT JOIN ruled r USING (doc_id, pos)
  WHERE NOT coalesce(r.fails, false) GROUP BY c.doc_id
),
words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{_WORD}')) AS w,
         unnest(range(len(regexp_extract_all(text, '{_WORD}')))) AS i
  FROM docs
),
windows AS (
  SELECT doc_id, i, w, lead(w, 1) OVER s AS w1, lead(w, 2) OVER s AS w2 FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY i)
),
often AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AS twice FROM windows WHERE w2 IS NOT NULL
),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often WHERE twice
  ) GROUP BY doc_id
),
base AS (
  SELECT d.doc_id, CAST({_count("text", _WORD)} AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST({_count("text", _SYMBOL)} AS BIGINT) AS n_symbols,
         CAST(coalesce(b.dups, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(b.lost, 0) AS BIGINT) AS n_lost_words,
         md5(coalesce(k.clean_text, '')) AS clean_md5
  FROM docs d LEFT JOIN by_line b USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN clean k USING (doc_id)
),
failed AS (
  SELECT *, n_words < {_RULES.least_words} OR 100 * n_repeat_words > {_RULES.repeat_percent} * n_words AS base_failed FROM base
)
SELECT *, NOT base_failed AND 100 * n_lost_words <= {_RULES.lost_percent} * n_words AS kept FROM failed
"""


def _replaced(column: str, pairs, before: str = "") -> str:
    for one, other in pairs:
        column = f"replace({column}, '{_quoted(before + one)}', '{_quoted(before + other)}')"
    return column


_ALTERNATIVES = " (?:" + "|".join(one for one, _ in licenses.EQUIVALENT) + ")"
_KNOWN = ", ".join(f"('{i}', '{_quoted(t)}')" for i, t in licenses.KNOWN)
_BARE = (
    f"trim(regexp_replace(lower(regexp_replace(line, '{_quoted(licenses.COPYRIGHT_LINE)}', '')),"
    r" '[^\p{L}\p{N}]+', ' ', 'g'))"
)

LICENSE_SCAN = f"""
WITH texts AS (
  SELECT CAST(doc_id AS VARCHAR) AS key, false AS is_known, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT id, true, text FROM (VALUES {_KNOWN}) k(id, text)
),
cut AS (
  SELECT key, is_known, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM texts
),
bare AS (SELECT key, is_known, pos, {_BARE} AS t FROM cut),
units AS (
  SELECT key, is_known, true AS whole, string_agg(t, ' ' ORDER BY pos) AS t FROM bare WHERE t <> '' GROUP BY key, is_known
  UNION ALL SELECT key, is_known, false, t FROM bare WHERE t <> ''
),
digested AS (
  SELECT key, is_known, whole, sha256(CASE WHEN regexp_matches(' ' || t, '{_ALTERNATIVES}')
    THEN ltrim({_replaced("(' ' || t)", licenses.EQUIVALENT, " ")}) ELSE t END) AS digest
  FROM units
),
known AS (SELECT digest, min(key) AS license_id FROM digested WHERE is_known AND whole GROUP BY digest),
found AS (
  SELECT d.key, min(k.license_id) FILTER (d.whole) AS license_id,
         string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) FILTER (NOT d.whole) AS line_licenses
  FROM digested d JOIN known k USING (digest) WHERE NOT d.is_known GROUP BY d.key
)
SELECT doc_id, license_id, line_licenses FROM documents LEFT JOIN found ON key = CAST(doc_id AS VARCHAR)
"""


def _uuid(*parts: str) -> str:
    h = f"md5(concat_ws(chr(31), {', '.join(parts)}))"
    pieces = ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'urn:uuid:' || concat_ws('-', {pieces})"


_CRLF = "chr(13) || chr(10)"
_BLANKS = r"[\x09-\x0D\x20]+"


def _sql_fields(*pairs: tuple[str, str]) -> str:
    return " || ".join(f"coalesce('{name}: ' || {value} || {_CRLF}, '')" for name, value in pairs)


#: References that the test pages may hold, the ampersand last.
_SIGNS = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
    ("&reg;", "®"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&laquo;", "«"),
    ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&"),
)
_BLOCKS = (
    "p div article section header footer nav main aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre form"
    " title body html"
).replace(" ", "|")
_PLAIN = (
    r"regexp_replace(regexp_replace(regexp_replace(markup, '(?is)<head[\s>].*?</head\s*>|<noscript[\s>].*?</noscript\s*>', ' ', 'g'),"
    rf" '{_BLANKS}', ' ', 'g'), '(?i)</?(?:{_BLOCKS})(?:[\s/][^>]*)?>|<[bh]r(?:[\s/][^>]*)?>', chr(10), 'g')"
)
_PLAIN = _replaced(f"regexp_replace({_PLAIN}, '<[^<>]*>', '', 'g')", _SIGNS)
_PLAIN = (
    f"trim(regexp_replace(regexp_replace({_PLAIN}, ' *\\n[ \\n]*', chr(10), 'g'), '^\\n+|\\n+$', '', 'g'))"
)
#: Whole anchors, and the names and values of the attributes of one.
_ANCHOR = _quoted(r"""<[aA][\s/](?:"[^"]*"|'[^']*'|[^"'<>])*>""")
_ATTRIBUTE = _quoted(r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)""")
_HREFS = f"""list_filter(list_transform(regexp_extract_all(markup, '{_ANCHOR}'), lambda tag: list_filter(list_zip(
      list_transform(regexp_extract_all(tag, '{_ATTRIBUTE}', 1), lambda n: lower(n)), regexp_extract_all(tag, '{_ATTRIBUTE}', 2)),
      lambda a: a[1] = 'href')[1][2]), lambda v: v IS NOT NULL)"""
_BARE_VALUE = """CASE WHEN v[1] IN ('"', '''') THEN v[2:-2] ELSE v END"""

WARC_DERIVATIVES = f"""
WITH responses AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS payload,
         {_uuid("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "coalesce(url, '')")} AS refers_to,
         'sha256:' || sha256(coalesce(html, '')) AS payload_digest
  FROM pages
),
cleaned AS (
  SELECT *, regexp_replace(payload, '(?is)<!--.*?-->|<script[\\s>].*?</script\\s*>|<style[\\s>].*?</style\\s*>', ' ', 'g') AS markup FROM responses
),
marked AS (
  SELECT *, {_replaced("regexp_extract(markup, '(?is)<title(?:[^>a-z][^>]*)?>(.*?)</title', 1)", _SIGNS)} AS title FROM cleaned
),
blocks AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS type,
    {_sql_fields(("source-status", "'HTTP/1.1 200 OK'"), ("source-content-type", "'text/html; charset=utf-8'"),
                 ("source-payload-digest", "payload_digest"), ("source-payload-length", "CAST(strlen(payload) AS VARCHAR)"),
                 ("title", f"CASE WHEN title <> '' THEN trim(regexp_replace(title, '{_BLANKS}', ' ', 'g')) END"))}
    || array_to_string(list_transform({_HREFS}, lambda v: 'outlink: ' || {_replaced(f"({_BARE_VALUE})", _SIGNS)} || {_CRLF}), '') AS block
  FROM marked
  UNION ALL SELECT *, 'conversion', 'text/plain', {_PLAIN} FROM marked
),
named AS (SELECT *, {_uuid("record_type", "refers_to")} AS record_id FROM blocks)
SELECT page_id, record_type, record_id, refers_to, target_uri,
  md5('WARC/1.1' || {_CRLF} || {_sql_fields(
      ("WARC-Type", "record_type"), ("WARC-Record-ID", "'<' || record_id || '>'"), ("WARC-Refers-To", "'<' || refers_to || '>'"),
      ("WARC-Target-URI", "target_uri"), ("WARC-Date", "'1970-01-01T00:00:00Z'"), ("WARC-Source-Payload-Digest", "payload_digest"),
      ("WARC-Block-Digest", "'sha256:' || sha256(block)"), ("Content-Type", "type"),
      ("Content-Length", "CAST(strlen(block) AS VARCHAR)"))} || {_CRLF}) AS header_md5,
  md5(block) AS block_md5, CAST(length(block) AS INTEGER) AS block_chars
FROM named
"""

HARD_NEGATIVES = """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
         CAST(CASE WHEN len(a.v) = 0 THEN 0 ELSE list_inner_product(a.v, r.v) END AS BIGINT) AS score
  FROM usable a JOIN usable r ON len(a.v) = len(r.v) AND a.vec_id <> r.vec_id
  WHERE a.vec_id % 50 = 0
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
),
met AS (
  SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS nth
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(nth AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM met WHERE nth <= 3
"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_DIGITS = "'0123456789ABCDEF'"


def _windows(table: str) -> str:
    return f"""
  SELECT rid, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature
  FROM {table}"""


IMPORTANCE = rf"""
WITH polynomial AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS step
),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
items AS (
  SELECT row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
doc_windows AS ({_windows("docs")}),
item_windows AS ({_windows("items")}),
different AS (SELECT feature FROM doc_windows UNION SELECT feature FROM item_windows),
digested AS (
  SELECT feature, hex(encode(feature)) AS h FROM different
),
hashed AS (
  SELECT feature, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(h), 2),
        lambda i: CAST(16 * (strpos({_DIGITS}, substr(h, i, 1)) - 1) + strpos({_DIGITS}, substr(h, i + 1, 1)) - 1 AS BIGINT))),
      lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
  FROM digested, polynomial
),
source AS (SELECT bucket, count(*) AS s FROM doc_windows JOIN hashed USING (feature) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM item_windows JOIN hashed USING (feature) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM source) AS n_source, (SELECT coalesce(sum(t), 0) FROM target) AS n_target),
gain AS (
  SELECT bucket, floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (n_source + 10000) AS DOUBLE)
                                 / CAST((s + 1) * (n_target + 10000) AS DOUBLE))) AS g
  FROM source LEFT JOIN target USING (bucket), totals
),
weighed AS (
  SELECT rid, CAST(sum(g) AS BIGINT) AS weight, count(*) AS n
  FROM doc_windows JOIN hashed USING (feature) JOIN gain USING (bucket) GROUP BY rid
),
scored AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5)
      / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM docs LEFT JOIN weighed USING (rid)
),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= 5 * n // 100 THEN nth END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = _quoted(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_AZ, _09 = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: name, characters, symbols in order, the lower half of the symbols
_ALPHABETS = (
    ("decimal", "0-9", _09, "01234"),
    ("hex", "0-9a-f", _09 + "abcdef", "01234567"),
    ("upper hex", "0-9A-F", _09 + "ABCDEF", "01234567"),
    ("base32", "A-Z2-7", _AZ.upper() + "234567", "A-P"),
    ("base36", "0-9a-z", _09 + _AZ, "0-9a-h"),
    ("base62", "0-9A-Za-z", _09 + _AZ.upper() + _AZ, "0-9A-U"),
    ("base64", "A-Za-z0-9+/", _AZ.upper() + _AZ + _09 + "+/", "A-Za-f"),
    ("base64url", "A-Za-z0-9_-", _AZ.upper() + _AZ + _09 + "-_", "A-Za-f"),
)


def _each_alphabet(value) -> str:
    return "CASE alphabet " + " ".join(f"WHEN '{a[0]}' THEN {value(a)}" for a in _ALPHABETS) + " END"


def _tail(z: str) -> str:
    """Chance of a standard normal value of z or more."""
    t = f"(1 / (1 + abs({z}) / sqrt(2.0) / 2))"
    fit = "0.0"
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        fit = f"({fit} * {t} + {c})"
    far = f"({t} * exp(-({z}) * ({z}) / 2 - 1.26551223 + {t} * {fit}) / 2)"
    return f"greatest(CASE WHEN {z} >= 0 THEN {far} ELSE 1 - {far} END, 1e-300)"


SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
  SELECT rid, 'assign' AS kind, regexp_extract_all(text, '{_ASSIGN}') AS m, regexp_split_to_array(text, '{_ASSIGN}') AS g,
         regexp_extract_all(text, '{_ASSIGN}', 2) AS w FROM docs
  UNION ALL SELECT rid, 'access', regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+'),
         regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL SELECT rid, 'hex', regexp_extract_all(text, '[0-9a-f]{{24,}}'), regexp_split_to_array(text, '[0-9a-f]{{24,}}'),
         regexp_extract_all(text, '[0-9a-f]{{24,}}') FROM docs
  UNION ALL SELECT rid, 'random', regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{20,}}'),
         regexp_split_to_array(text, '[A-Za-z0-9+/_=-]{{20,}}'), regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{20,}}') FROM docs
),
each AS (
  SELECT rid, kind, unnest(m) AS whole, unnest(g[:len(m)]) AS gap, unnest(w) AS what, unnest(range(len(m))) AS nth FROM raw WHERE len(m) > 0
),
placed AS (
  SELECT rid, kind, what, length(whole) AS size,
         CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY rid, kind ORDER BY nth) AS BIGINT) AS e FROM each
),
base AS (
  SELECT rid, kind, e - size AS s, e FROM placed
  WHERE kind = 'hex' OR (kind = 'access' AND size >= 20) OR (kind = 'assign' AND length(what) >= 6)
),
tokens AS (
  SELECT *, CAST(length(body) AS DOUBLE) AS n FROM (
    SELECT rid, e - size AS s, e, regexp_replace(what, '=+$', '') AS body FROM placed p
    WHERE kind = 'random' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = p.rid AND b.s < p.e AND p.e - p.size < b.e)
  )
),
inferred AS (
  SELECT *, CASE {" ".join(f"WHEN regexp_full_match(body, '[{a[1]}]+') THEN '{a[0]}'" for a in _ALPHABETS)} END AS alphabet
  FROM tokens WHERE n >= 20
),
spelled AS (
  SELECT *, CAST(length(symbols) AS DOUBLE) AS k,
    list_transform(string_split(body, ''), lambda c: CAST(strpos(symbols, c) - 1 AS DOUBLE)) AS x,
    list_transform(string_split(symbols, ''), lambda c: n - length(replace(body, c, ''))) AS counts
  FROM (SELECT *, {_each_alphabet(lambda a: f"'{a[2]}'")} AS symbols FROM inferred WHERE alphabet IS NOT NULL)
),
summed AS (
  SELECT *, list_sum(list_transform(counts, lambda c: c * c)) AS squares, list_sum(x) / n AS mean,
    {_each_alphabet(lambda a: f"len(regexp_extract_all(body, '[{a[3]}]+')) + len(regexp_extract_all(body, '[^{a[3]}]+'))")} AS half_runs,
    CAST({_each_alphabet(lambda a: f"length(regexp_replace(body, '[^{a[3]}]', '', 'g'))")} AS DOUBLE) AS low,
    len(regexp_extract_all(body, '[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+')) AS kind_runs
  FROM spelled
),
measured AS (
  SELECT *, k / n * squares - n AS chi, 2 * low * (n - low) / n + 1 AS mean_runs, (squares - n) / 2 AS equal, n * (n - 1) / 2 AS pairs,
    list_sum(list_transform(x, lambda v: (v - mean) * (v - mean))) AS variance,
    list_sum(list_transform(range(1, len(x)), lambda i: (x[i] - mean) * (x[i + 1] - mean))) AS together
  FROM summed
),
z AS (
  SELECT *, (pow(greatest(chi, 0) / (k - 1), 1.0 / 3) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS z_chi,
    abs((half_runs - mean_runs) / sqrt(greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), 1e-9))) AS z_runs,
    abs((together / CASE WHEN variance <= 1e-9 THEN 1 ELSE variance END + 1 / n) * sqrt(n)) AS z_serial,
    (pairs * 0.065 - equal - 0.5) / sqrt(pairs * 0.065 * 0.935 + n * (n - 1) * (n - 2) * (0.0055 - 0.065 * 0.065)) AS z_rarely,
    (kind_runs - 1.5 - (n - 1) * 0.25) / sqrt((n - 1) * 0.25 * 0.75) AS z_often
  FROM measured
),
chances AS (
  SELECT *, {_tail("z_chi")} AS p_chi,
    CASE WHEN low = 0 OR low = n THEN greatest(pow(2.0, 1 - n), 1e-300) ELSE least(2 * {_tail("z_runs")}, 1.0) END AS p_runs,
    CASE WHEN variance <= 1e-9 THEN 1e-300 ELSE least(2 * {_tail("z_serial")}, 1.0) END AS p_serial,
    -ln({_tail("z_rarely")}) - ln({_tail("z_often")}) AS h_text
  FROM z
),
battery AS (
  SELECT rid, s, e, alphabet, CAST(floor(log2(n)) AS INTEGER) AS octave,
    exp(-h) * (1 + h + h * h / 2) AS even,
    CAST(floor(-50 * log10(greatest(least(exp(-h_text) * (1 + h_text), 1.0), 1e-300))) AS INTEGER) AS step
  FROM (SELECT *, -ln(p_chi) - ln(greatest(p_runs, 1e-300)) - ln(greatest(p_serial, 1e-300)) AS h FROM chances)
),
cuts AS (
  SELECT alphabet, octave, min(step) AS cut FROM (
    SELECT alphabet, octave, step, count(*) OVER (PARTITION BY alphabet, octave ORDER BY step DESC) AS reported,
           count(*) OVER (PARTITION BY alphabet, octave) AS n FROM battery
  ) WHERE n * pow(10.0, -step / 50) <= 0.01 * reported GROUP BY alphabet, octave
),
spans AS (
  SELECT rid, kind, s, e FROM base
  UNION ALL SELECT rid, 'random', s, e FROM battery JOIN cuts USING (alphabet, octave) WHERE step >= cut AND even >= 1e-3
),
told AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, list_position(['assign', 'access', 'hex', 'random'], kind)) AS spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, list_position(['assign', 'access', 'hex'], kind)) FILTER (kind <> 'random') AS base
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (rid)
"""

ORACLES: dict[str, str] = {
    "op2_license_scan": LICENSE_SCAN,
    "op3_warc_derivatives": WARC_DERIVATIVES,
    "op9_quality_rules": LINE_RULES,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_importance_resampling": IMPORTANCE,
    "op13_secret_scan": SECRETS,
}
