import numpy as np
import pytest
from conftest import SF
from llm_helpers import awkward, empty, groups, prose, shingles, similar

from caseledger.llm.components import components
from caseledger.llm.near_duplicates import bands_for, near_duplicates, one_per_group
from caseledger.llm.queries import QUERIES
from caseledger.llm.shared import prepare
from caseledger.llm.superminhash import signatures
from caseledger.llm.superminhash import shingles as hashed


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    other = np.concatenate([base[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    s = signatures([base, other, base[:3], np.empty(0, np.uint64)], 256)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.1
    assert np.isinf(s[3]).all() and np.isfinite(s[2]).all()
    # The same set gives the same signature in any company.
    assert (signatures([base[:3]], 256)[0] == s[2]).all()


def test_each_element_visits_every_place():
    # With one element all steps are taken: step j leaves a value in [j, j + 1) somewhere.
    s = np.sort(signatures([np.array([12345], np.uint64)], 64)[0])
    assert (np.floor(s) == np.arange(64)).all()


def test_bands_reach_the_threshold():
    assert (1 - 0.85**4) ** bands_for(85, 4, 1e-6) <= 1e-6


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op7_minhash_near_dedup"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = groups(texts, similar(texts, 85))
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        r = got[i]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(shingles(text)), want[i], want[i] == i)


def test_large_groups_of_near_copies(spark):
    """More than a few leaders can tell: chains of edits, some of which only meet in the middle."""
    base = prose(5, 120).split()
    texts = {}
    for k in range(60):
        w = list(base)
        for j in range(k % 12):
            w[(k * 7 + j * 9) % len(w)] = f"x{k}y{j}"
        texts[1000 - k] = " ".join(w)
    df = prepare(spark).createDataFrame(list(texts.items()), "doc_id long, text string")
    for percent in (60, 80):
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, percent=percent).collect()}
        assert got == groups(texts, similar(texts, percent))


def test_awkward_rows(spark):
    df = awkward(prepare(spark))
    rows = near_duplicates(df).collect()
    assert len(rows) == df.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2][0]["component_id"] == 1 and not by[2][0]["kept"]
    assert [r["component_id"] for r in by[3]] == [3, 3]
    for i in (4, 5, 6):
        assert (by[i][0]["n_shingles"], by[i][0]["component_id"], by[i][0]["kept"]) == (0, i, True)
    assert by[8][0]["component_id"] == 7 and by[7][0]["n_shingles"] == 1
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert by[11][0]["component_id"] == 10
    kept = one_per_group(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 9, 10, 12, 13] and ids.count(None) == 1


def test_empty(spark):
    assert near_duplicates(empty(prepare(spark))).count() == 0
    assert one_per_group(empty(spark)).count() == 0


@pytest.mark.parametrize("edges", [[], [(5, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)], [(1, None), (2, 3)]])
def test_components(spark, edges):
    df = prepare(spark).createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["component"] for r in components(df).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == groups({x for e in real for x in e}, real)


def test_hashing_matches_words():
    assert len(hashed("A b C d E f".encode())) == 2
    assert (hashed(b"A b") == hashed(b"a  B\n")).all()
