"""The best of a block equal brute force, whatever bound settles them."""

import math
import random

import pytest

from caseledger.operators import similarity
from caseledger.operators.similarity import top_pairs

KIND = "b int, vec_id int, n int, vector array<struct<dim:int,w:double>>"


def vectors(n, seed, first):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        base = rng.choice([1, 7, 23, 40])
        dims = {base + rng.randrange(12): rng.choice([1.0, 1.0, -1.0, 0.5]) for _ in range(rng.randrange(0, 7))}
        size = math.sqrt(sum(w * w for w in dims.values())) or 1
        out.append((k % 3 if k % 4 else 0, first + k, rng.randrange(1, 4), [(d, w / size) for d, w in sorted(dims.items())]))
    return out


def best(pairs, items, k):
    """The cosines and ids of the k best items of each left vector."""
    out = {}
    for key, found in pairs.items():
        every = sorted((-round(c, 9), r) for r, c in found.items())
        out[key] = [x for x in every for _ in range(items[x[1]])][:k]
    return out


@pytest.mark.parametrize("bounds", [similarity.BOUNDS, (0.5,), ()])
def test_equals_brute_force(spark, bounds):
    left, right = vectors(60, 1, 0), vectors(150, 2, 1000)
    items = {r[1]: r[2] for r in right}
    every = {}
    for b, i, _, v in left:
        for c, j, _, w in right:
            if b == c:
                w_ = dict(w)
                every.setdefault(i, {})[j] = sum(x * w_.get(d, 0) for d, x in v)
    got = {}
    rows = top_pairs(spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND), ["b"], 3, bounds).collect()
    for r in rows:
        assert r.right_id not in got.get(r.left_id, {})
        got.setdefault(r.left_id, {})[r.right_id] = r.cosine
    assert best(got, items, 3) == best(every, items, 3)
    if bounds:
        assert len(rows) < sum(map(len, every.values()))


def test_empty_sides(spark):
    some, none = spark.createDataFrame(vectors(5, 1, 0), KIND), spark.createDataFrame([], KIND)
    assert top_pairs(none, some, ["b"], 3).count() == 0 and top_pairs(some, none, ["b"], 3).count() == 0
