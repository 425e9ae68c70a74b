"""Readers of files, over files that are written out of the driver tables."""

import uuid

from pyspark.sql import functions as F

from caseledger.session import shared_folder
from caseledger.sources import mail

from . import text
from .base import Registry, iso, ziso

REGISTRY = Registry()
add = REGISTRY.add


def _written(t, lines):
    """One JSON text per row, as files."""
    path = f"{shared_folder(t.spark)}/json-{uuid.uuid4().hex}"
    lines.toDF("value").write.text(path)
    return path


_NORMALISED = text.REGISTRY.plain["x03_normalise_text"]


@add("s02_provider_json", f"""SELECT concat('d-', doc_id) AS message_id, concat('s', doc_id % 50, '@example.org') AS sender, digest AS text_md5
  FROM ({_NORMALISED}) q""", uses="quoteless")
def s02(t):
    """Every document as a provider message whose text lies up to eleven parts deep, beside parts of other kinds."""
    depth = (F.col("doc_id") % 12).cast("int")
    data = F.translate(F.regexp_replace(F.base64(F.encode("raw", "utf-8")), r"[\r\n]", ""), "+/", "-_")
    leaf = F.concat(F.lit('{"mimeType":"text/plain","body":{"data":"'), data, F.lit('"}}'))
    other = '{"mimeType":"image/png","filename":"a.png"},'
    nested = F.concat(
        F.repeat(F.lit(f'{{"mimeType":"multipart/mixed","parts":[{other}'), depth), leaf, F.repeat(F.lit("]}"), depth)
    )
    headers = F.concat(F.lit('"headers":[{"name":"From","value":"s'), F.col("doc_id") % 50, F.lit('@example.org"}],'))
    payload = F.concat(F.lit("{"), headers, F.substring(nested, F.lit(2), F.length(nested)))
    lines = text._with_tail(t).select(F.concat(F.lit('{"id":"d-'), "doc_id", F.lit('","payload":'), payload, F.lit("}")))
    out = mail.read_provider_json(t.spark, _written(t, lines))
    return out.select("message_id", "sender", F.md5("text").alias("text_md5"))


@add("s03_calendar_json", f"""SELECT concat('cal:', event_id, CASE WHEN event_id % 5 = 0 THEN ':cancelled' ELSE '' END) AS message_id,
  concat('cal:', event_id) AS thread_id, concat('u', user_id, '@example.org') AS sender, event_type AS subject,
  {ziso("CASE WHEN event_id % 3 = 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 9 HOURS ELSE date_trunc('second', ts) END")} AS starts_at,
  CASE WHEN event_id % 5 = 0 THEN 'CANCEL' ELSE 'REQUEST' END AS method, len(['a@b.c', 'x']) - CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS attendees
  FROM events WHERE event_id % 7 <> 0""")
def s03(t):
    """Every event as a calendar item, by the hour or by the day; those without a start are no invitations."""
    ts = F.col("ts").cast("timestamp")
    start = F.when(F.col("event_id") % 7 == 0, None).when(
        F.col("event_id") % 3 == 0, F.struct(F.date_format(ts, "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("dateTime"))
    ).otherwise(F.struct(F.lit(None).cast("string").alias("date"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dateTime")))
    who = F.array(F.struct(F.lit("a@b.c").alias("email")), F.struct(F.when(F.col("event_id") % 2 == 1, "x").alias("email")))
    item = F.struct(
        F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 5 == 0, "cancelled").alias("status"),
        F.col("event_type").alias("summary"), start.alias("start"), who.alias("attendees"),
        F.struct(F.concat(F.lit("u"), "user_id", F.lit("@example.org")).alias("email")).alias("organizer"),
    )
    out = mail.read_calendar_json(t.spark, _written(t, t.raw("events").select(F.to_json(item))))
    return iso(out.select(
        "message_id", "thread_id", "sender", "subject", F.col("invite.starts_at").alias("starts_at"), F.col("invite.method").alias("method"),
        F.size("invite.attendees").cast("bigint").alias("attendees"),
    ), "starts_at")


@add("s05_labelled_jsonl", """SELECT concat('d-', doc_id) AS provider_message_id, lang AS subject, md5(coalesce(text, '')) AS text_md5, quality AS score,
  CASE WHEN toxic = 1 THEN 'drop' ELSE 'pass' END AS outcome, CAST(quality AS DOUBLE) / 2 AS confidence,
  (SELECT count(*) FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) AS known_domains
  FROM documents JOIN labels USING (doc_id)""")
def s05(t):
    """Every labelled document as a line of a labelled file, after the context line."""
    docs = t.raw("documents").join(t.raw("labels"), "doc_id")
    row = F.struct(
        F.struct(
            F.concat(F.lit("d-"), "doc_id").alias("provider_message_id"), "text", F.struct(F.col("lang").alias("subject")).alias("headers")
        ).alias("message"),
        F.struct(
            F.col("quality").alias("score"), F.when(F.col("toxic") == 1, "drop").otherwise("pass").alias("outcome"),
            (F.col("quality").cast("double") / 2).alias("confidence"),
        ).alias("verdict"),
    )
    sources = t.raw("documents").filter("source IS NOT NULL").agg(F.collect_set("source").alias("s"))
    head = sources.select(F.to_json(F.struct(F.lit("context").alias("kind"), F.col("s").alias("company_domains"))))
    context, cases = mail.read_labelled_jsonl(t.spark, _written(t, head.union(docs.select(F.to_json(row)))))
    known = context.select(F.size("company_domains").cast("bigint").alias("known_domains"))
    return cases.join(known).select(
        "provider_message_id", F.col("headers.subject").alias("subject"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
        "verdict.score", "verdict.outcome", "verdict.confidence", "known_domains",
    )
