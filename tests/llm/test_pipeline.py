import math
from collections import Counter

from conftest import SF
from llm_helpers import awkward, groups, similar, words

import corpus_pipeline
from caseledger.llm.line_rules import Rules, judge
from caseledger.llm.pairwise_quality import quality_scores
from caseledger.llm.shared import prepare, stored


def test_stages_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    prepare(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf), "stage"))
    assert all(t.columns == columns for t in tables[:-1])
    raw, good, clean, single, mixed, packed = [t.collect() for t in tables]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    accepted = {r["doc_id"] for r in quality_scores(docs, labels).collect() if r["predicted"] == 1}
    assert {r["doc_id"] for r in good} == accepted and 0 < len(good) < len(raw)

    verdicts = {r["doc_id"]: judge(r["text"].encode(), Rules()) for r in good}
    assert {r["doc_id"]: r["text"] for r in clean} == {i: v["clean_text"] for i, v in verdicts.items() if v["kept"]}

    texts = {r["doc_id"]: r["text"] for r in clean}
    component = groups(texts, similar(texts, 80))
    assert {r["doc_id"] for r in single} == {i for i in texts if component[i] == i}

    total = sum(len(words(r["text"])) for r in single)
    assert abs(sum(len(words(r["text"])) for r in mixed) - total) <= 20
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in single}

    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
    assert sum(r["piece"] == 0 for r in packed) == len(mixed)
    fills = {}
    for r in packed:
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
    assert max(fills.values()) <= 1024 and len(fills) <= math.ceil(sum(fills.values()) / 1024) * 1.02 + 1


def test_run_of_the_whole(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(rows[0].asDict())


def test_awkward_rows_pass_all_stages(spark):
    """Null and repeated ids, empty and long texts, clashing names: every stage keeps whole rows of what came in, and no others."""
    docs = awkward(prepare(spark))
    columns, before = docs.columns, docs.collect()
    of = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF), "stage")
        rows = docs.collect()
        assert k == 4 or docs.columns == columns
        if k == 0:
            # The labels of these few ids are all of one kind, so there is nothing to learn and all rows stay as they are.
            assert Counter(map(str, rows)) == Counter(map(str, before))
        elif k == 1:
            judged = [(r["doc_id"], judge((r["text"] or "").encode(), Rules())) for r in before]
            assert of(rows) == Counter((i, v["clean_text"]) for i, v in judged if v["kept"])
            assert all(r["n_chars"] == len(r["text"]) for r in rows) and 9 in {r["doc_id"] for r in rows}
        elif k == 2:
            texts = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
            assert not of(rows) - of(before) and len(texts) == sum(r["doc_id"] is not None for r in rows)
            assert not similar(texts, 80)
            assert {r["doc_id"] for r in rows if r["doc_id"] is None} == {r["doc_id"] for r in before if r["doc_id"] is None}
        elif k == 3:
            total = sum(len(words(r["text"])) for r in before)
            assert abs(sum(len(words(r["text"])) for r in rows) - total) <= 20
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before}
        else:
            assert sum(r["piece"] == 0 for r in rows) == len(before) and {r["doc_id"] for r in rows} == {r["doc_id"] for r in before}
            ends = {}
            for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
                assert r["offset"] == ends.get(r["sequence_id"], 0)
                ends[r["sequence_id"]] = r["offset"] + r["length"]
            assert max(ends.values()) <= 1024
        before = rows
    nothing = awkward(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        nothing = stored(stage(spark, nothing, SF), "stage")
    assert nothing.count() == 0
