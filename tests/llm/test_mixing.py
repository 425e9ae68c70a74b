import pytest
from conftest import SF
from llm_helpers import DOCUMENT, awkward, empty, exchanges_of, prose, words
from pyspark.sql import functions as F

from caseledger.llm.mixing import mix, mixed_documents, permuted
from caseledger.llm.queries import QUERIES
from caseledger.llm.shared import prepare


def wanted_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = most * sizes[s]
            free.remove(s)
            left -= target[s]
    return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}


def agrees(rows, texts, key="doc_id"):
    """Sizes, targets and what is taken; `texts` are the input's (source, text)."""
    sizes = {}
    for source, text in texts:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = wanted_targets(sizes)
    taken = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(rows) == len(texts)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutations(spark, n):
    df = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), F.lit("k")).alias("y"))
    rows = df.withColumn("z", permuted(F.col("y"), F.lit(n), F.lit("k"), inverse=True)).collect()
    assert sorted(r["y"] for r in rows) == list(range(n)) and all(r["z"] == r["id"] for r in rows)
    if n == 1000:
        assert sum(abs(r["y"] - r["id"]) < 10 for r in rows) < 100


def test_query_and_rerun(spark):
    rows = QUERIES["op1_source_mix"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    agrees(rows, [(r["source"], r["text"]) for r in docs.collect()])
    again = QUERIES["op1_source_mix"](spark, SF).collect()
    assert sorted(rows) == sorted(again)


def test_slots(spark):
    docs = prepare(spark).read.parquet(f"{SF}/documents.parquet")
    m = mix(docs, block_words=64, shard_slots=50)
    slots = m.slots.collect()
    per = {}
    for r in slots:
        per.setdefault(r["shard"], []).append(r["sid"])
    assert all(len(v) == 50 for k, v in per.items() if k < max(per))
    # Every pass visits a block once; draws mix the sources in each shard.
    seen = [(r["sid"], r["pass_"], r["block"]) for r in slots]
    assert len(set(seen)) == len(seen) and all(len(set(v)) > 5 for k, v in per.items() if k < max(per))


def test_documents_follow_the_mix(spark):
    docs = prepare(spark).read.parquet(f"{SF}/documents.parquet")
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    rows = mix(docs).rows.collect()
    taken = {r["id"]: r["taken"] for r in rows if r["taken"]}
    got, whole = {}, {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words(r["text"]))
        assert r["n_chars"] == len(r["text"]) and set(words(r["text"])) <= set(words(whole[r["doc_id"]]))
    assert got == taken


def test_one_source_holds_most(spark):
    rows = [(i, prose(i, 30 + i), "en", "big" if i % 10 else f"small{i % 3}", 0, "", "", "", "") for i in range(200)]
    docs = prepare(spark).createDataFrame(rows, DOCUMENT)
    agrees(mix(docs, block_words=16, shard_slots=8).rows.collect(), [(r[3], r[1]) for r in rows])


def test_awkward_rows(spark):
    df = awkward(prepare(spark)).withColumnRenamed("v", "taken").withColumnRenamed("nth", "start")
    rows = mix(df).rows.collect()
    agrees(rows, [(r["source"], r["text"]) for r in df.collect()])
    out = mixed_documents(df)
    assert out.columns == df.columns
    total = sum(len(words(r["text"])) for r in out.collect())
    assert total == sum(r["taken"] for r in rows)


def test_no_words(spark):
    assert mix(empty(prepare(spark))).rows.count() == 0 and mixed_documents(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 0, "", "", "", ""), (2, " ", "en", "a", 1, "", "", "", "")], DOCUMENT)
    assert [(r["target"], r["taken"]) for r in mix(blank).rows.collect()] == [(0.0, 0)] * 2


def test_texts_move_once(spark):
    """Where nothing is broadcast, one exchange carries the documents to what is taken from them."""
    prepare(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(exchanges_of(mixed_documents(awkward(spark)), "text|doc")) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_alike_take_their_plans_in_turn(spark):
    """Many equal rows, null ids among them: each takes what one place of theirs in the mix takes."""
    rows = [(i, prose(i, 40), "en", "ab"[i % 2], 0, "", "", "", "") for i in range(40)]
    rows += [(None, prose(99, 30), "en", "a", 0, "", "", "", "")] * 30 + [(7, prose(7, 40), "en", None, 0, "", "", "", "")] * 30
    docs = prepare(spark).createDataFrame(rows, DOCUMENT)
    places = mix(docs, block_words=16, shard_slots=8).rows.filter("taken > 0").collect()
    wanted = sorted((str(r["id"]), str(r["source"]), n) for r in places for n in [r["size"]] * r["passes"] + [sum(s["words"] for s in r["spans"])] if n)
    got = mixed_documents(docs, block_words=16, shard_slots=8).collect()
    assert sorted((str(r["doc_id"]), str(r["source"]), len(words(r["text"]))) for r in got) == wanted


def test_slots_of_a_hot_source_are_many_tasks(spark):
    """Nine of ten words are of one source: its slots are written by many tasks, none with more than its share."""
    prepare(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        docs = spark.range(20_000).select(
            F.col("id").alias("doc_id"), F.expr("repeat('word ', 100)").alias("text"), F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("source")
        )
        slots = mix(docs, block_words=64, shard_slots=256).slots
        per_task = [r["count"] for r in slots.groupBy(F.input_file_name()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(per_task) > 20_000 and max(per_task) < 0.25 * sum(per_task)
