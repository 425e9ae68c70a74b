import math

import numpy as np
from llm_helpers import groups

from caseledger.llm.embedding_links import _audited, linked
from caseledger.llm.hnsw import Graph
from caseledger.llm.queries import QUERIES
from caseledger.llm.shared import prepare

KIND = "vec_id long, embedding array<float>, label int, rep long, v string"


def brute(rows, least=0.93):
    """n_links and component per id, for rows of distinct ids."""
    usable = [
        (i, np.array(e, float), y) for i, e, y, *_ in rows
        if i is not None and y is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
    ]
    pairs = []
    for a in range(len(usable)):
        for b in range(a):
            (i, x, p), (j, y, q) = usable[a], usable[b]
            if p == q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                pairs.append((i, j))
    links = {r[0]: 0 for r in rows}
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    return links, groups([r[0] for r in rows], pairs)


def clouds(n, d, seed, spread=0.04, least=0):
    """Loners and groups of near copies of very different sizes."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, d))
    of = rng.integers(0, len(centres), n)
    of[: n // 3] = 0
    v = centres[of] + spread * rng.normal(size=(n, d)) * rng.integers(least, 4, n)[:, None]
    v[n // 2 :: 3] = rng.normal(size=v[n // 2 :: 3].shape)
    return v.astype(np.float32)


def test_shards_equal_brute_force(spark):
    v = clouds(600, 24, 4)
    rows = [(i, [float(x) for x in v[i]], i % 2, 0, "") for i in range(len(v))]
    df = prepare(spark).createDataFrame(rows, KIND)
    got = {r["vec_id"]: r for r in linked(df, shard_rows=90, beam=8).collect()}
    links, component = brute(rows)
    true = sum(links.values())
    found = sum(min(got[i]["n_links"], n) for i, n in links.items())
    assert true > 1000 and found >= 0.99 * true and all(got[i]["n_links"] <= n for i, n in links.items())
    assert np.mean([got[i]["component_id"] == c for i, c in component.items()]) > 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_of_a_graph():
    v = clouds(1500, 32, 7, least=1)  # equal vectors are one node before a graph is built
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    graph = Graph.built(u.astype(float), np.arange(len(u)))
    truth = u @ u.T >= 0.93
    found = graph.within(u.astype(float), 0.93, 16)
    assert sum(map(len, found)) >= 0.98 * truth.sum()
    _, sims = graph.search(u[:100].astype(float), 20)
    tenth = np.sort(u[:100] @ u.T, axis=1)[:, -10]
    assert (sims[:, :10] >= tenth[:, None] - 1e-6).mean() > 0.9


def test_audit_where_links_are_rare():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    nodes = v[:1200]
    graph = Graph.built(nodes, np.arange(len(nodes)), degree=3)
    missed = [i for i, f in enumerate(graph.within(nodes, 0.93, 2)) if not len(f)][:20]
    assert len(missed) == 20
    queries = v[1200:].copy()
    places = np.random.default_rng(len(queries)).permutation(len(queries))[48:68]
    queries[places] = nodes[missed]
    found = _audited(graph, queries, 0.93, 2, 48, 0.995)
    assert sum(m in found[p] for p, m in zip(places, missed, strict=True)) >= 19


def test_nodes_without_incoming_links_are_found():
    v = np.random.default_rng(5).normal(size=(800, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Graph.built(v, np.arange(len(v)))
    apart = [i for i in range(0, 800, 97) if i != graph.entry and graph.levels[i] == 0]
    for links in graph.links:
        links[np.isin(links, apart)] = -1
    assert set(apart) <= set(graph.lost.tolist())
    found = graph.within(v[apart], 0.93, 16)
    assert all(i in f for i, f in zip(apart, found, strict=True))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: r for r in QUERIES["op4_embedding_near_dedup"](spark, sf).collect()}
    links, component = brute(rows)
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["component_id"] for i, r in got.items()} == component


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1),
        (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, 0.0], None), (11, [], 1),
        (12, [1.0, 0.0, 0.0], 1), (13, [3e38, 1e30], 1), (14, [-1.0, 0.0], 1),
    ]
    df = prepare(spark).createDataFrame([(*r, 9, "x") for r in rows], KIND)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in linked(df).collect()}
    links, component = brute(rows)
    assert got == {i: (links[i], component[i], component[i] == i) for i, *_ in rows}
    again = df.union(df.filter("vec_id = 1")).union(spark.createDataFrame([(None, [1.0, 0.0], 1, 0, "")], KIND))
    more = linked(again).collect()
    assert len(more) == len(rows) + 2
    assert [r["n_links"] for r in more if r["vec_id"] == 1] == [3, 3]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in more if r["vec_id"] is None] == [(0, None, True)]


def test_empty(spark):
    assert linked(prepare(spark).createDataFrame([], KIND)).count() == 0
