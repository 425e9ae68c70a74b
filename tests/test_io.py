"""Readers, streams and rule files."""

import json

import pytest
from pyspark.sql import functions as F
from test_operators import HISTORY, log, states

from caseledger.functions.rules import RulesError, load_rules
from caseledger.operators.fold import fold
from caseledger.sources import mail
from caseledger.streaming import jobs


def test_eml(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(
        "From: Ann <ann@acme.com>\nSubject: =?UTF-8?B?w6ggc3RhdGE=?=\nDate: Mon, 1 Jan 2024 10:00:00 +0100\n"
        "Content-Type: text/plain; charset=utf-8\n\nCiao è qui\n\n-- \nAnn\n".encode())
    row = mail.read_eml(spark, str(tmp_path)).first()
    assert (row.subject, row.text, row.received_at.hour) == ("è stata", "Ciao è qui", 9)


def test_provider_json(spark, tmp_path):
    import base64

    data = base64.urlsafe_b64encode("<p>Hi &amp; bye</p>".encode()).decode()
    item = {"id": "1", "threadId": "t", "internalDate": "1704067200000", "payload": {
        "headers": [{"name": "From", "value": "a@b.c"}, {"name": "Subject", "value": "s"}],
        "parts": [{"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/html", "body": {"data": data}}]}]}}
    (tmp_path / "m.json").write_text(json.dumps(item))
    row = mail.read_provider_json(spark, str(tmp_path)).first()
    assert (row.text, row.sender, row.received_at.year) == ("Hi & bye", "a@b.c", 2024)


def test_calendar_json(spark, tmp_path):
    items = [{"id": "x", "status": "cancelled", "start": {"date": "2024-05-01"}}, {"id": "y"}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, items)))
    rows = mail.read_calendar_json(spark, str(tmp_path)).collect()
    assert [r.message_id for r in rows] == ["cal:x:cancelled"] and rows[0].invite.starts_at.hour == 9


def test_labelled(spark, tmp_path):
    lines = [{"kind": "context", "own_addresses": ["A@B.c"]}, {"message": {"provider_message_id": "1"}, "verdict": {"score": 3}}]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, lines)))
    context, cases = mail.read_labelled_jsonl(spark, str(tmp_path))
    assert context.first().own_addresses == ["a@b.c"] and cases.first().verdict.score == 3


def test_rules(tmp_path):
    with pytest.raises(RulesError):
        load_rules(str(tmp_path))
    rule = {"vendor": "v", "match": {"sender_domains": ["v.com"]}, "patterns": [{"intent": "offer", "confidence": 0.9, "subject": "^hi"}]}
    (tmp_path / "v.json").write_text(json.dumps(rule))
    assert load_rules(str(tmp_path))[0].domains == ("v.com",)
    rule["patterns"][0].pop("subject")
    (tmp_path / "v.json").write_text(json.dumps(rule))
    with pytest.raises(RulesError):
        load_rules(str(tmp_path))


def test_projection_stream_equals_batch(spark, tmp_path):
    df = log(spark, HISTORY)
    path = lambda n: str(tmp_path / n)
    for part in (df.filter("seq > 6"), df.filter("seq <= 8")):  # newest first, with repeats
        part.coalesce(1).write.mode("append").parquet(path("in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path("in"))
    jobs.project(stream, path("log"), path("states"), path("cp"), buckets=4).awaitTermination()
    got = jobs.current(spark, path("states"), jobs.CASE)
    want = fold(df)
    assert {r.case_id: r for r in got.select(*want.columns).collect()} == states(df)
    assert spark.read.parquet(path("log")).count() == df.count()


def test_ingest_once(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    m = spark.range(20).select(
        F.lit(1).alias("mailbox_id"), (F.col("id") % 7).cast("string").alias("provider_message_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("received_at"))
    m.write.parquet(path("in"))
    for run in ("a", "b"):  # the second run has no state and relies on the ledger
        stream = spark.readStream.schema(m.schema).parquet(path("in"))
        jobs.ingest(stream, path("ledger"), path("out"), path(f"cp-{run}")).awaitTermination()
    assert spark.read.parquet(path("out")).count() == 7
