"""Greedy leaders equal the one-by-one answer; a long chain takes few rounds."""

import random

import pytest

from caseledger.operators import leaders
from caseledger.operators.leaders import greedy_leaders


def one_by_one(n, edges):
    before = {v: set() for v in range(n)}
    for v, u in edges:
        before[v].add(u)
    leads = {}
    for v in range(n):
        leads[v] = not any(leads[u] for u in before[v])
    return leads


def run(spark, n, edges):
    nodes = spark.range(n).withColumnRenamed("id", "v")
    df = spark.createDataFrame(edges, "v long, u long") if edges else spark.createDataFrame([], "v long, u long")
    return {r.v: r.leads for r in greedy_leaders(nodes, df).collect()}


@pytest.fixture()
def rounds(monkeypatch):
    """Tables written, five a round."""
    seen = {"n": 0}
    real = leaders.kept

    def kept(df):
        seen["n"] += 1
        return real(df)

    monkeypatch.setattr(leaders, "kept", kept)
    return lambda: (seen["n"] - 2) / 4


def test_a_chain_of_ten_thousand(spark, rounds):
    n = 10_000
    got = run(spark, n, [(v, v - 1) for v in range(1, n)])
    assert got == {v: v % 2 == 0 for v in range(n)} and rounds() <= 17


def test_trees_and_caterpillars(spark, rounds):
    n = 4000
    edges = [(v, v - 1 if v % 3 else v - 3) for v in range(3, n)]
    assert run(spark, n, edges) == one_by_one(n, edges) and rounds() <= 17


@pytest.mark.parametrize("seed", range(3))
def test_any_graph(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(v, u) for v in range(n) for u in range(v) if rng.random() < (0.02, 0.06, 0.3)[seed]]
    edges += edges[:5]
    assert run(spark, n, edges) == one_by_one(n, edges)


def test_without_edges(spark):
    assert run(spark, 5, []) == dict.fromkeys(range(5), True) and run(spark, 0, []) == {}
