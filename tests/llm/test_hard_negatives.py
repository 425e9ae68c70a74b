import math

import check
import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from caseledger.llm.hard_negatives import Bucket, Search, candidates, cuts, hard_negatives, lengths
from caseledger.llm.queries import ORACLES, QUERIES
from caseledger.llm.shared import prepare

KIND = "vec_id long, embedding array<float>, label int, score long, uid string"


def brute(rows, anchor, positives=5, negatives=3):
    """Everything by nested loops, in whole numbers."""
    usable = {
        (i, y, tuple(math.floor(256 * float(x)) for x in e)) for i, e, y, *_ in rows
        if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    }
    out = []
    for i, y, v in usable:
        if not anchor(i):
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in usable if len(w) == len(v) and j != i
        )
        for p, j, _ in [s for s in scored if s[2] == y][:positives]:
            fits = [(-s, k) for s, k, z in scored if z != y and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(i, j, n + 1, k, -p, s) for n, (s, k) in enumerate(fits)]
    return sorted(out)


def mixed_lengths(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 20), d))
    v = centres[rng.integers(0, len(centres), n)] + 0.5 * rng.normal(size=(n, d))
    v[: n // 3] = v[0]
    return v * np.exp(rng.normal(size=(n, 1))) / 8


def test_query_equals_sql(spark):
    problem, n = check.compare(QUERIES["op11_hard_negatives"](spark, SF), check.duck(SF), ORACLES["op11_hard_negatives"])
    assert problem is None and n > 0


def test_blocks_equal_brute_force(spark):
    v = mixed_lengths(700, 12, 3)
    rows = [(i, [float(np.float32(x)) for x in v[i]], i % 4, 0, "") for i in range(len(v))]
    df = prepare(spark).createDataFrame(rows, KIND)
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, block_rows=60, search=Search(bucket_rows=16, least_rows=4, focus=3, whole_share=0.6)).collect()
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500 and sorted(map(tuple, got)) == want


def test_lists_hold_every_row_above_the_threshold_and_leave_most_others():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(125, 32))[rng.integers(0, 125, 1000)] + 0.2 * rng.normal(size=(1000, 32))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True) * rng.uniform(0.92, 1, (1000, 1)))
    v = v[np.argsort(-lengths(v))]
    assert cuts(lengths(v), Search())[:2] == [0, 1000]
    bucket = Bucket(v, lengths(v))
    asked = v[::7]
    size = lengths(asked)
    truth = asked @ v.T
    least = np.sort(truth, axis=1)[:, -4]
    unit = asked / size[:, None]
    focus = np.argsort(-np.abs(unit), axis=1)[:, :4]
    whole, listed = candidates(bucket, unit, size, focus, least, Search())
    seen = dict(listed)
    assert len(seen) > len(asked) / 2
    for a, at in seen.items():
        assert set(np.flatnonzero(truth[a] >= least[a])) <= set(at.tolist())
    assert sum(map(len, seen.values())) < 0.1 * len(seen) * len(v)
    assert all(size[a] * bucket.longest < least[a] for a in range(len(asked)) if a not in seen and a not in whole)


def test_buckets_are_neighbours_in_length():
    size = -np.sort(-np.exp(np.random.default_rng(2).normal(size=5000)))
    at = cuts(size, Search())
    assert at[0] == 0 and at[-1] == 5000 and all(0 < b - a <= 1024 for a, b in zip(at, at[1:], strict=False))
    assert all(b - a <= 64 or size[b - 1] >= 0.9 * size[a] for a, b in zip(at, at[1:], strict=False))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 2), (3, [0.75, 0.25], 2), (4, [0.75, 0.25], 2), (5, None, 1),
        (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 2), (10, [1.0, 0.0], None), (11, [], 1),
        (12, [], 2), (13, [1.0, 0.0, 0.0], 1), (14, [-1.0, 0.0], 1), (15, [0.001, 0.9], 3), (50, [0.5, 1.0], 1), (50, [0.5, 1.0], 2),
        (100, [], 1), (150, [0.0, 0.0], 2), (None, [1.0, 0.0], 1),
    ]
    df = prepare(spark).createDataFrame([(*r, 9, "x") for r in rows], KIND)
    df = df.union(df.filter("vec_id < 4"))
    got = sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute(rows, lambda i: i % 50 == 0) and got
    assert any(r[0] == 100 and r[4:] == (0, 0) for r in got)


def test_very_large_components(spark):
    rows = [(i, [3e38, float(i)], i % 2, 0, "") for i in range(6)] + [(50, [1e30, -3e38], 0, 0, ""), (51, [1.0, 2.0], 1, 0, "")]
    got = hard_negatives(prepare(spark).createDataFrame(rows, KIND), F.col("vec_id") % 50 == 0).collect()
    assert all(abs(r["positive_score"]) < 2**63 for r in got)


def test_a_frequent_vector_and_label(spark):
    rows = [(i, [0.5, 0.25], 1, 0, "") for i in range(300)] + [(1000 + i, [0.4, 0.2 + i / 1000], 2, 0, "") for i in range(40)]
    got = hard_negatives(prepare(spark).createDataFrame(rows, KIND), F.col("vec_id") % 50 == 0, block_rows=32).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 50 == 0)


def test_empty(spark):
    empty = prepare(spark).createDataFrame([], KIND)
    assert hard_negatives(empty, F.col("vec_id") % 50 == 0).count() == 0
