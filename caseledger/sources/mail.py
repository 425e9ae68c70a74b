"""Readers of mail, calendars and labelled files, and the calendar text parser."""

import json
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from email.utils import parsedate_to_datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

_MAIL = (
    "path string, message_id string, sender string, subject string, date string, `to` array<string>,"
    " list_id string, list_unsubscribe string, precedence string, received_us bigint,"
    " plain string, html string, calendar string"
)


def _mime(batches):
    """Bytes of messages to their headers and their first text, HTML and calendar parts."""
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            m = message_from_bytes(bytes(content), policy=policy.default)
            parts = {"text/plain": None, "text/html": None, "text/calendar": None}
            for part in m.walk():
                kind = part.get_content_type().replace("application/ics", "text/calendar")
                if part.is_multipart() or kind not in parts or parts[kind]:
                    continue
                body = part.get_payload(decode=True) or b""
                parts[kind] = body.decode(part.get_content_charset() or "utf-8", errors="replace")
            try:
                moment = parsedate_to_datetime(str(m.get("date")))
                received = int(moment.timestamp() * 1_000_000)
            except (TypeError, ValueError):
                received = None
            one = lambda h: None if m.get(h) is None else str(m.get(h))  # noqa: B023, E731
            rows.append((
                path, one("message-id") or path, one("from") or "", one("subject") or "",
                one("date") or "", [a.strip() for a in (one("to") or "").split(",") if a.strip()],
                one("list-id"), one("list-unsubscribe"), one("precedence"), received, *parts.values(),
            ))
        yield pd.DataFrame(rows, columns=[
            "path", "message_id", "sender", "subject", "date", "to", "list_id", "list_unsubscribe",
            "precedence", "received_us", "plain", "html", "calendar"])


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """A folder of RFC 822 files as messages. HTML is used where there is no plain text."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path)
    mail = raw.select("path", "content").mapInPandas(_mime, _MAIL)
    body = F.coalesce(F.nullif("plain", F.lit("")), X.html_to_text(F.col("html")), F.lit(""))
    rows = mail.withColumn("_raw", body)
    rows = rows.withColumn("text", X.normalise_text(F.col("_raw"))["text"])
    invite = parse_ics(F.col("calendar"))
    return rows.select(
        "message_id", "sender", "subject", "date", "to", "list_id", "list_unsubscribe", "precedence",
        F.timestamp_micros("received_us").alias("received_at"), "text",
        X.body_hash(F.col("text")).alias("body_sha256"), invite.alias("invite"),
    )


#: Levels of parts that are read as columns. What lies deeper, in few messages, is walked through in Python.
LEVELS = 4

_HEADER = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
#: Inner parts stay JSON text until their level is read, so no message decides how deep the schema of the others is.
_PART = "mimeType string, filename string, body struct<data:string>, parts array<string>"
_LEAF = "array<struct<kind:string,name:string,data:string>>"
_PROVIDER = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("id", "threadId", "internalDate")],
    T.StructField("payload", T.StructType([
        T.StructField("headers", T.ArrayType(_HEADER)),
        *[T.StructField(c, T.StringType()) for c in ("mimeType", "filename")],
        T.StructField("body", T.StructType([T.StructField("data", T.StringType())])),
        T.StructField("parts", T.ArrayType(T.StringType())),
    ])),
])


def _text_of(value):
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _deeper(texts: list[str]) -> list[dict]:
    """The parts in some JSON texts, level by level."""
    level, out = [json.loads(t) for t in texts], []
    while level:
        level = [p for p in level if isinstance(p, dict)]
        for p in level:
            body = p.get("body")
            out.append({
                "kind": _text_of(p.get("mimeType")), "name": _text_of(p.get("filename")),
                "data": _text_of(body.get("data")) if isinstance(body, dict) else None,
            })
        level = [q for p in level if isinstance(p.get("parts"), list) for q in p["parts"]]
    return out


def _with_parts(rows: DataFrame) -> DataFrame:
    """Every part of a message as `_parts`, outer ones before the ones inside them, level by level."""
    leaf = lambda p: F.struct(p["mimeType"].alias("kind"), p["filename"].alias("name"), p["body"]["data"].alias("data"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_parts", F.array(leaf(F.col("payload"))).cast(_LEAF)).withColumn(
        "_level", F.coalesce("payload.parts", none)
    )
    for _ in range(LEVELS):
        # Each step is a column of its own: an expression inside a lambda is evaluated again for each element.
        rows = rows.withColumn("_read", F.transform("_level", lambda p: F.from_json(p, _PART)))
        rows = rows.withColumn("_parts", F.concat("_parts", F.transform("_read", leaf).cast(_LEAF))).withColumn(
            "_level", F.flatten(F.transform("_read", lambda p: F.coalesce(p["parts"], none)))
        )
    kind = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("data", pa.string())]))

    @F.arrow_udf(_LEAF)
    def rest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([_deeper(x) if x else [] for x in lists.to_pylist()], kind)

    deep = rest(F.when(F.size("_level") > 0, F.col("_level")))
    return rows.withColumn("_deep", deep).withColumn("_parts", F.concat("_parts", F.coalesce("_deep", F.array().cast(_LEAF))))


def read_provider_json(spark: SparkSession, path: str, user_id=None) -> DataFrame:
    """Provider messages in JSON lines, of one account where `user_id` is given. HTML wins over plain text here, and
    the provider's own time over the Date header. Parts are read at any depth."""
    raw = spark.read.schema(_PROVIDER).json(path)
    header = lambda name: F.try_element_at(F.filter(
        F.coalesce("payload.headers", F.array().cast("array<struct<name:string,value:string>>")),
        lambda h: F.lower(h["name"]) == name), F.lit(-1))["value"]
    rows = _with_parts(raw)

    def decoded(test) -> Column:
        data = F.get(F.filter("_parts", lambda p: test(p) & (F.coalesce(p["data"], F.lit("")) != "")), F.lit(0))["data"]
        return F.decode(F.unbase64(F.translate(data, "-_", "+/")), "utf-8")

    html = decoded(lambda p: p["kind"] == "text/html")
    plain = decoded(lambda p: p["kind"] == "text/plain")
    ics = decoded(lambda p: (p["kind"] == "text/calendar") | F.lower(p["name"]).endswith(".ics"))
    rows = rows.withColumn("_raw", F.coalesce(X.html_to_text(html), plain, F.lit("")))
    rows = rows.withColumn("text", X.normalise_text(F.col("_raw"))["text"])
    mail_date = F.try_to_timestamp(header("date"), F.lit("EEE, d MMM yyyy HH:mm:ss Z"))
    many = lambda name: F.filter(F.transform(F.split(F.coalesce(header(name), F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")
    return rows.select(
        F.lit(user_id).alias("user_id"), F.col("id").alias("message_id"), F.col("threadId").alias("thread_id"),
        F.coalesce(F.timestamp_millis(F.col("internalDate").cast("bigint")), mail_date).alias("received_at"),
        F.coalesce(header("from"), F.lit("")).alias("sender"), F.coalesce(header("subject"), F.lit("")).alias("subject"),
        *[header(h).alias(h.replace("-", "_")) for h in ("list-id", "list-unsubscribe", "precedence", "in-reply-to", "auto-submitted")],
        many("to").alias("to"), many("cc").alias("cc"),
        F.regexp_extract_all(F.coalesce(header("references"), F.lit("")), F.lit(r"<[^<>\s]+>"), F.lit(0)).alias("references"),
        "text", X.body_hash(F.col("text")).alias("body_sha256"), parse_ics(ics).alias("invite"),
    )


_CALENDAR = (
    "id string, iCalUID string, status string, summary string, location string, start struct<dateTime:string,"
    "date:string>, `end` struct<dateTime:string>, organizer struct<email:string>, attendees array<struct<email:string>>"
)


def read_calendar_json(spark: SparkSession, path: str, user_id=None) -> DataFrame:
    """Calendar items in JSON lines as messages that carry an invitation. An item is a thread of its own."""
    raw = spark.read.schema(_CALENDAR).json(path)
    cancelled = F.coalesce(F.col("status") == "cancelled", F.lit(False))
    starts = F.coalesce(
        F.col("start.dateTime").try_cast("timestamp"),
        F.concat(F.col("start.date"), F.lit("T09:00:00Z")).try_cast("timestamp"),
    )
    who = F.filter(F.transform("attendees", lambda a: a["email"]), lambda e: F.coalesce(e, F.lit("")) != "")
    key = F.concat(F.lit("cal:"), "id", F.when(cancelled, ":cancelled").otherwise(""))
    return raw.filter(starts.isNotNull()).select(
        F.lit(user_id).alias("user_id"), key.alias("message_id"), F.concat(F.lit("cal:"), "id").alias("thread_id"),
        F.coalesce("organizer.email", F.lit("")).alias("sender"),
        F.coalesce("summary", F.lit("Calendar event")).alias("subject"), F.coalesce("summary", F.lit("")).alias("text"),
        X.body_hash(key).alias("body_sha256"),
        F.struct(
            F.coalesce("iCalUID", "id").alias("uid"), "summary", starts.alias("starts_at"),
            F.col("end.dateTime").try_cast("timestamp").alias("ends_at"), "location",
            F.col("organizer.email").alias("organiser"), who.alias("attendees"),
            F.when(cancelled, "cancelled").otherwise("confirmed").alias("status"),
            F.when(cancelled, "CANCEL").otherwise("REQUEST").alias("method"),
        ).alias("invite"),
    )


def _ics_moment(line: Column) -> Column:
    """A time with its Z, in the zone it names, or as a bare date."""
    def read(value: Column) -> Column:
        zone = F.nullif(F.regexp_extract(line, r"TZID=([^;:]+)", 1), F.lit(""))
        utc = F.try_to_timestamp(F.regexp_replace(value, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))
        known = zone.rlike(r"^[A-Za-z]+/[A-Za-z_/+-]+[0-9]*$") | (zone == "UTC")
        return (
            F.when(value.rlike("Z$") | (F.instr(value, "T") > 0) & ~F.coalesce(known, F.lit(False)), utc)
            .when(F.instr(value, "T") > 0, F.to_utc_timestamp(utc, zone))
            .otherwise(F.try_to_timestamp(value, F.lit("yyyyMMdd")))
        )

    return _once(F.trim(F.regexp_extract(line, r":([^:]*)$", 1)), read)


def _once(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is worked out once, however often it stands in there."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def parse_ics(text: Column) -> Column:
    """The first event of a calendar text as an invitation, null when it has no start."""
    flat = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n[ \t]", "")
    event = r"(?is)\nBEGIN:VEVENT\s*\n(.*?)(?:\nEND:VEVENT|\z)"
    return _once(flat, lambda f: _once(F.concat(F.lit("\n"), F.regexp_extract(f, event, 1), F.lit("\n")), lambda lines: _invitation(f, lines)))


def _invitation(flat: Column, lines: Column) -> Column:
    before = F.regexp_extract(F.concat(F.lit("\n"), flat), r"(?is)^(.*?)\nBEGIN:VEVENT", 1)
    line = lambda name: F.nullif(F.regexp_extract(lines, rf"(?i)\n({name}(?:;[^:\n]*)?:[^\n]*)", 1), F.lit(""))
    plain = lambda v: F.regexp_replace(F.regexp_replace(v, r"\\[nN]", "\n"), r"\\([,;\\])", "$1")
    said = lambda name: plain(F.trim(F.regexp_extract(lines, rf"(?i)\n{name}(?:;[^:\n]*)?:([^\n]*)", 1)))
    value = lambda name: _once(said(name), lambda v: F.nullif(v, F.lit("")))
    bare = lambda v: F.regexp_replace(v, "^(?:mailto:|MAILTO:)", "")
    people = F.regexp_extract_all(lines, F.lit(r"(?i)\nATTENDEE(?:;[^:\n]*)?:([^\n]*)"), F.lit(1))
    method = F.upper(F.coalesce(value("METHOD"), F.nullif(
        F.trim(F.regexp_extract(before, r"(?i)\nMETHOD(?:;[^:\n]*)?:([^\n]*)", 1)), F.lit(""))))
    moment = lambda name: _once(line(name), _ics_moment)
    known = lambda v, names, other: _once(v, lambda x: F.when(x.isin(*names), x).otherwise(other))
    return _once(moment("DTSTART"), lambda starts: F.when(
        starts.isNotNull(),
        F.struct(
            F.coalesce(value("UID"), F.lit("")).alias("uid"), value("SUMMARY").alias("summary"),
            starts.alias("starts_at"), moment("DTEND").alias("ends_at"),
            value("LOCATION").alias("location"), bare(value("ORGANIZER")).alias("organiser"),
            F.transform(people, lambda p: bare(plain(F.trim(p)))).alias("attendees"),
            known(F.lower(value("STATUS")), ("confirmed", "cancelled", "tentative"), F.lit("confirmed")).alias("status"),
            known(method, ("REQUEST", "CANCEL", "REPLY", "PUBLISH"), F.lit(None)).alias("method"),
        ),
    ))


_LABELLED = (
    "kind string, company_domains array<string>, known_threads array<string>, known_newsletters array<string>,"
    " own_addresses array<string>, ats_vendors array<string>, thread_to_application map<string,string>,"
    " message struct<provider_message_id:string,thread_id:string,received_at:timestamp,text:string,headers:struct<"
    "sender:string,subject:string,list_id:string,list_unsubscribe:string,precedence:string>>,"
    " verdict struct<score:int,outcome:string,intent:string,company:string,role:string,confidence:double,"
    "rung:int,vendor:string,stage_hint:string>"
)


def read_labelled_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(the context line, the cases) of a file of mixed JSON lines."""
    rows = spark.read.schema(_LABELLED).json(path)
    context = rows.filter("kind = 'context'").select(
        "company_domains", "known_threads", "known_newsletters",
        F.transform("own_addresses", F.lower).alias("own_addresses"), "ats_vendors", "thread_to_application")
    cases = rows.filter("kind IS NULL OR kind <> 'context'").filter("message IS NOT NULL").select("message.*", "verdict")
    return context, cases
