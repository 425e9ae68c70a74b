"""Operator 3: derived WARC records, metadata and plain text, from response records.

Every response gives a metadata record and a conversion record. Both name the response they refer to and
carry its headers and digests on; their own ids follow from it, so a rerun gives the same records.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseledger.functions.text import unescape

CRLF = "\r\n"
#: Named character references that the SQL twin turns into text, the ampersand last. The operator resolves more. Fixed values.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
    ("&reg;", "®"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&laquo;", "«"),
    ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&"),
)
#: References to blanks, which become plain ones: a page shows them so.
BLANK = r"&(?:nbsp|#0*(?:9|10|12|13|32|160)|#[xX]0*(?:9|[aAcCdD]|20|[aA]0));"
#: A reference that is not one of ENTITIES.
OTHERS = "&(?!(?:" + "|".join(name[1:] for name, _ in ENTITIES) + "))(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"
#: What is no page at all, and what a page does not show.
NO_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
UNSEEN = r"(?is)<noscript\b.*?</noscript\s*>|<head\b.*?</head\s*>"
BREAKS = r"(?i)<(/?(p|div|article|section|header|footer|nav|main|aside|h[1-6]|ul|ol|li|dl|dt|dd|table|tr|td|th|blockquote|pre|form|title|body|html)\b[^>]*|br\b[^>]*|hr\b[^>]*)>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
#: The value of an anchor's own href, its quotes included: attributes before it are passed over whole, up to two hundred of them.
LINK = (
    r"""(?i)<a(?:(?:[\s/]+|(?<=["']))(?!href[\s=])[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?){0,200}+"""
    r"""(?:[\s/]+|(?<=["']))href\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""
)


def record_id(*parts: Column) -> Column:
    """A urn:uuid that follows from the parts."""
    h = F.md5(F.concat_ws("\u001f", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def plain_text(html: Column) -> Column:
    """Visible text, a line per block, without empty lines and runs of blanks."""
    return _signs(_flat(F.regexp_replace(html, NO_MARKUP, " ")))


def _flat(markup: Column) -> Column:
    """Text with a line break per block, without tags, its references as they are."""
    text = F.regexp_replace(markup, UNSEEN, " ")
    text = F.regexp_replace(text, r"[\x09-\x0D\x20]+", " ")
    return F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), r"<[^<>]*>", "")


def _signs(text: Column) -> Column:
    """Flat text with its references resolved and its lines tidied."""
    plain = text
    for name, sign in ENTITIES:
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    # Most texts have no other references; for them this gives what one pass over all references gives, and is cheaper.
    text = F.when(F.rlike(text, F.lit(OTHERS)), unescape(F.regexp_replace(text, BLANK, " "))).otherwise(plain)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" *\n[ \n]*", "\n"), r"^\n+|\n+$", ""))


def _resolved(text: Column) -> Column:
    """References resolved, where there are any."""
    return F.when(F.contains(text, F.lit("&")), unescape(text)).otherwise(text)


def _unquoted(value: Column) -> Column:
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def responses(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Response records of fetched pages: record_id, target_uri, warc_date, status, content_type, payload, payload_digest.

    A null page has an empty payload, a null address none. The id follows from page id and address.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        F.col(id_col).alias("page_id"),
        record_id(F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))).alias("record_id"),
        F.col(url_col).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.lit("HTTP/1.1 200 OK").alias("status"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        payload.alias("payload"),
        F.concat(F.lit("sha256:"), F.sha2(payload, 256)).alias("payload_digest"),
    )


def _fields(*pairs: tuple[str, Column]) -> Column:
    """`name: value` lines; a null value leaves its line out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in pairs])


def derived(records: DataFrame) -> DataFrame:
    """Two rows per response: page_id, record_type, record_id, refers_to, target_uri, header, block.

    header and block, joined, are the record. The metadata block names status, type, payload digest and length of the source,
    its title and every anchor's link in the order of the page, both with their references resolved; the conversion block is the
    plain text. Comments, scripts and styles count for none of them. Texts are
    never cut, repeated responses give repeated records, and an empty payload gives an empty text. A row's
    text is worked on where it is read: nothing is shuffled.
    """
    c = F.col
    # Each step is a column of its own, or what uses it twice would work it out twice.
    records = records.withColumn("_markup", F.regexp_replace("payload", NO_MARKUP, " "))
    records = records.withColumn("_flat", _flat(c("_markup"))).withColumn("_said", F.regexp_extract("_markup", TITLE, 1))
    records = records.withColumn("_links", F.transform(F.regexp_extract_all("_markup", F.lit(LINK), F.lit(1)), _unquoted))
    records = records.withColumn("_said", _resolved(c("_said")))
    title, links = c("_said"), c("_links")
    metadata = F.concat(
        _fields(
            ("source-status", c("status")), ("source-content-type", c("content_type")),
            ("source-payload-digest", c("payload_digest")), ("source-payload-length", F.octet_length("payload").cast("string")),
            ("title", F.when(title != "", F.trim(F.regexp_replace(title, r"[\x09-\x0D\x20]+", " ")))),
        ),
        F.array_join(F.transform(links, lambda x: F.concat(
            F.lit("outlink: "), F.regexp_replace(_resolved(x), r"[\r\n]+", ""), F.lit(CRLF)
        )), ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("type"), _signs(c("_flat")).alias("block")),
    )
    rows = records.withColumn("_kind", F.explode(kinds)).select(
        "page_id", "_kind.record_type", "_kind.type", record_id(c("_kind.record_type"), c("record_id")).alias("record_id"),
        c("record_id").alias("refers_to"), "target_uri", "warc_date", "payload_digest", "_kind.block",
    )
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _fields(
            ("WARC-Type", c("record_type")), ("WARC-Record-ID", F.concat(F.lit("<"), c("record_id"), F.lit(">"))),
            ("WARC-Refers-To", F.concat(F.lit("<"), c("refers_to"), F.lit(">"))), ("WARC-Target-URI", c("target_uri")),
            ("WARC-Date", c("warc_date")), ("WARC-Source-Payload-Digest", c("payload_digest")),
            ("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
            ("Content-Type", c("type")), ("Content-Length", F.octet_length("block").cast("string")),
        ),
        F.lit(CRLF),
    )
    return rows.select("page_id", "record_type", "record_id", "refers_to", "target_uri", header.alias("header"), "block")
