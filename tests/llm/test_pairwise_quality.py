import numpy as np
from conftest import SF
from llm_helpers import awkward, crc_fold, empty, exchanges_of

from caseledger.llm import pairwise_quality
from caseledger.llm.pairwise_quality import FEATURES, features, fit, good_only, learn, quality_scores
from caseledger.llm.queries import QUERIES
from caseledger.llm.shared import prepare


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op10_quality_classifier"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000
    assert all(r["held_out"] == (crc_fold(i) == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in rows.items())
    asked = [(rows[i]["predicted"], y) for i, y in labels.items() if rows[i]["held_out"]]
    assert np.mean([p == y for p, y in asked]) > 0.95
    assert {y for _, y in asked} == {0, 1}


def test_held_out_labels_do_not_matter(spark):
    docs = prepare(spark).read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = [(r["doc_id"], 1 - r["quality"] if crc_fold(r["doc_id"]) == 0 else r["quality"]) for r in labels.collect()]
    one = quality_scores(docs, labels).collect()
    two = quality_scores(docs, spark.createDataFrame(turned, "doc_id long, quality int")).collect()
    assert sorted(one) == sorted(two)


def test_pairs_rank():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - 2 * x[:, 1] + 0.1 * rng.normal(size=400) > -1).astype(int)
    r = fit(x, y)
    s = (x - r.mean) / r.scale @ np.array(r.weights)
    assert ((s >= r.cut) == (y == 1)).mean() > 0.95
    assert fit(x, np.ones(400, int)) is None


def test_features():
    assert len(features(None)) == len(features(b"a b")) == len(FEATURES)
    assert features(b"") == features(b" \n") == features(None)


def test_awkward_rows(spark):
    df = awkward(prepare(spark)).withColumnRenamed("v", "features")
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (3, 1), (7, 0), (7, None), (None, 1), (9, 1), (12, 0), (8, 7)], "doc_id long, quality int"
    )
    rows = quality_scores(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert good_only(df, labels).columns == df.columns
    none = quality_scores(df, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and good_only(df, labels.limit(0)).count() == df.count()


def test_empty(spark):
    labels = prepare(spark).createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality_scores(empty(spark), labels).count() == 0 and good_only(empty(spark), labels).count() == 0


def test_all_rows_and_all_pairs_count(spark):
    """Weights and cut are those of every pair of a 1 and a 0, however rows are dealt out."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, len(FEATURES)))
    y = (x[:, 0] - 2 * x[:, 1] + 0.8 * rng.normal(size=500) > -1).astype(int)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    gap = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, len(FEATURES))
    want = np.zeros(len(FEATURES))
    for _ in range(40):
        p = 1 / (1 + np.exp(gap @ want))
        curve = (gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + 1e-3 * np.eye(len(want))
        want += 0.9 * np.linalg.solve(curve, gap.T @ p / len(gap) - 1e-3 * want)
    known = prepare(spark).createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, features array<double>")
    usable = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id long, label int")
    one, two = learn(known.repartition(5), usable), learn(known.coalesce(1), usable)
    assert one == two
    assert np.abs(np.array(one.weights) - want).max() < 2e-3
    assert abs(one.cut - np.quantile(z @ np.array(one.weights), (y == 0).mean(), method="midpoint")) < 1e-6
    assert np.abs(np.array(fit(x, y).weights) - np.array(one.weights)).max() < 1e-4


def test_texts_do_not_move_to_their_labels(spark, monkeypatch):
    """Where labels are too many to be broadcast, the features meet them, not the texts."""
    prepare(spark)
    asked = []
    monkeypatch.setattr(pairwise_quality, "learn", lambda known, usable, **_: asked.append(known.join(usable, "id")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
        good_only(awkward(spark), labels)
        assert exchanges_of(asked[0], "features") and not exchanges_of(asked[0], "text")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
