"""What used to be cut, dropped or capped: all of it comes through."""

import base64
import json

from pyspark.sql import functions as F

from caseledger.functions import privacy as P
from caseledger.functions import text as X
from caseledger.operators import log as log_ops
from caseledger.operators.similarity import similar_pairs
from caseledger.plans.account import export_csv
from caseledger.sources import mail
from caseledger.streaming import jobs


def test_backfilled_mail_lands(spark, tmp_path):
    """New messages far older than those before them land once, repeats do not."""
    path = lambda n: str(tmp_path / n)
    kind = "mailbox_id long, provider_message_id string, received_at timestamp"
    batches = [
        [(1, "a", "2024-03-01"), (1, "b", "2024-03-02")], [(1, "c", "2024-01-01"), (2, "a", "2024-01-01")],
        [(1, "a", "2024-03-01"), (1, "d", "2024-03-03"), (1, "d", "2024-03-03")], [(1, "c", "2024-01-01")],
    ]
    for rows in batches:
        df = spark.createDataFrame(rows, "m long, p string, r string").select(
            F.col("m").alias("mailbox_id"), F.col("p").alias("provider_message_id"), F.to_timestamp("r").alias("received_at"))
        df.coalesce(1).write.mode("append").parquet(path("in"))
        stream = spark.readStream.schema(kind).parquet(path("in"))
        jobs.ingest(stream, path("ledger"), path("out"), path("cp")).awaitTermination()
    got = sorted((r.mailbox_id, r.provider_message_id) for r in spark.read.parquet(path("out")).collect())
    assert got == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "a")]


def test_dimensions_without_a_bound(spark):
    rows = [(0, i, [(400 + i // 2, 1.0)]) for i in range(6)]
    v = spark.createDataFrame(rows, "b int, vec_id int, vector array<struct<dim:int,w:double>>")
    got = {(x.left_id, x.right_id) for x in similar_pairs(v, v, ["b"], 0.8).collect()}
    assert got == {(i, j) for i in range(6) for j in range(6) if i // 2 == j // 2}


def test_export_of_many_ids(spark):
    cases = spark.range(3000).select(F.col("id").alias("case_id"), F.lit(1).alias("company_id"))
    companies = spark.createDataFrame([(1, "Acme")], "company_id int, canonical_name string")
    assert export_csv(cases, companies, cases.filter("case_id < 1000")).count() == 1000
    assert export_csv(cases, companies, cases.limit(0)).count() == 0 and export_csv(cases, companies).count() == 3000


def test_one_odd_message_changes_nothing_for_the_others(spark, tmp_path):
    """Three hundred parts inside each other, five hundred side by side, and parts that are no parts, among plain messages."""
    data = lambda t: {"mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode(t.encode()).decode()}}
    deep = data("far down")
    for _ in range(300):
        deep = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "image/png", "filename": "x"}, deep]}
    flat = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "multipart/mixed", "parts": []} for _ in range(500)] + [data("at the end")]}
    odd = {"mimeType": "multipart/mixed", "parts": [None, "text", 7, {"parts": {"a": 1}}, {"body": "none"}, data("still there")]}
    lines = [{"id": n, "payload": p} for n, p in (("deep", deep), ("flat", flat), ("odd", odd))]
    lines += [{"id": f"m{i}", "payload": data(f"plain {i}")} for i in range(20)] + [{"id": "bare", "payload": None}]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r.message_id: r.text for r in mail.read_provider_json(spark, str(tmp_path)).collect()}
    assert got == {"deep": "far down", "flat": "at the end", "odd": "still there", "bare": "", **{f"m{i}": f"plain {i}" for i in range(20)}}


def test_parts_at_any_depth(spark, tmp_path):
    part = {"mimeType": "text/plain", "body": {"data": base64.urlsafe_b64encode(b"deep down").decode()}}
    for _ in range(12):
        part = {"mimeType": "multipart/mixed", "parts": [part]}
    head = [{"name": n, "value": v} for n, v in (
        ("To", "a@b.c, d@e.f"), ("References", "<1@x> <2@y>"), ("Auto-Submitted", "auto-replied"))]
    (tmp_path / "m.json").write_text(json.dumps({"id": "1", "payload": {**part, "headers": head}}))
    row = mail.read_provider_json(spark, str(tmp_path), user_id=7).first()
    assert (row.text, row.user_id, row.to, row.references) == ("deep down", 7, ["a@b.c", "d@e.f"], ["<1@x>", "<2@y>"])
    assert row.auto_submitted == "auto-replied"
    (tmp_path / "m.json").write_text(json.dumps({"id": "2", "payload": {"mimeType": "text/plain", "body": part["parts"][0].get("body")}}))
    assert mail.read_provider_json(spark, str(tmp_path)).count() == 1


def test_rejected_events_come_back(spark):
    rows = [(1, "applied", 0.9), (2, "nonsense", 0.9), (3, "applied", 1.5), (4, None, 0.5), (5, "applied", None)]
    df = spark.createDataFrame(rows, "seq int, type string, confidence double")
    assert [r.seq for r in log_ops.valid_events(df).collect()] == [1]
    got = {r.seq: r.reason for r in log_ops.rejected_events(df).collect()}
    assert got == {2: "unknown type", 3: "confidence outside 0 to 1", 4: "unknown type", 5: "confidence outside 0 to 1"}


def test_whole_texts(spark):
    long = " ".join(f"word{i} https://example.com/{i}" for i in range(3000))
    row = spark.createDataFrame([(long,)], "t string").select(
        X.normalise_text(F.col("t"))["text"].alias("text"), F.size(X.extract_links(F.col("t"))).alias("links")).first()
    assert row.text == long and row.links == 3000


def test_deny_list_and_scrubbing_of_odd_texts(spark):
    rows = [('[{"skin":1},[{"k":{"genetic":[1]}}],"race"]',), ("nope",), (None,), ('{"a":"x\\"y, {z","Faith":{"b":[1,{"c":2}]},"d":1}',)]
    out = spark.createDataFrame(rows, "j string").select(P.deny_list(F.col("j")).alias("o")).select("o.*").collect()
    assert [tuple(r) for r in out] == [
        ('[{},[{"k":{}}],"race"]', ["[0].skin", "[1][0].k.genetic"]), (None, []), (None, []), ('{"a":"x\\"y, {z","d":1}', ["Faith"]),
    ]
    texts = ["9-api_token = abc; x", "tokens=1 my-secret-key: 'v'", "a" * 20000 + "_token=z", ""]
    got = [r.o for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.scrub_text(F.col("t")).alias("o")).collect()]
    assert got == ["9-api_token = [redacted]; x", "tokens=1 my-secret-key: '[redacted]'", "a" * 20000 + "_token=[redacted]", ""]


def test_deny_list_of_long_json(spark):
    """What is put out grows run by run: a document of tens of thousands of tokens keeps all that is not denied."""
    doc = {"a": [{f"k{i}": i, "health" if i % 3 == 0 else "x": [i, {"y": None}]} for i in range(3000)]}
    out = spark.createDataFrame([(json.dumps(doc),)], "j string").select(P.deny_list(F.col("j")).alias("o")).first().o
    assert json.loads(out.value) == {"a": [{k: v for k, v in e.items() if k != "health"} for e in doc["a"]]}
    assert out.violations == [f"a[{i}].health" for i in range(0, 3000, 3)]
