"""Duplicates equal brute force, with a third of all cases in one group and with cases that a person has split."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseledger.operators import similarity as S
from caseledger.operators.resolution import find_duplicates
from caseledger.operators.skew import nearest_points

KIND = (
    "user_id long, company_id long, case_id long, role_title string, role_normalised string, status string, current_stage string,"
    " merged_into_id long, manually_created boolean, work_mode string, location string, applied_at timestamp"
)
TEXTS = ("data engineer", "senior data engineer platform", "data engineer", "nurse", "data engineers")
LANDS = {"": "", "Berlin": "de", "Milano": "it"}


def cases(n, seed, same_time=False):
    rng = random.Random(seed)
    start, rows = datetime(2024, 3, 1), []
    for k in range(n):
        hot = k % 3 == 0
        at = start + timedelta(minutes=rng.randrange(60 * 24 * 40) // (1 if rng.random() < 0.5 else 1440) * 1)
        if same_time and hot:
            at = start
        rows.append((
            0 if hot else rng.randrange(2), 0 if hot else rng.randrange(2), k, TEXTS[0] if hot else rng.choice(TEXTS), None,
            rng.choice(["live", "live", "dormant", "rejected"]), rng.choice(["applied", "screening", "screening", "offer"]),
            5 if rng.random() < 0.05 else None, rng.random() < 0.05, rng.choice(["", "", "remote", "onsite", None]),
            rng.choice(["", "", "Berlin", "Milano", None]), None if rng.random() < 0.1 else at,
        ))
    return rows


def brute(rows, splits, cosines):
    able = [
        r for r in rows if r[5] in ("live", "dormant") and r[7] is None and r[6] not in ("offer", "negotiating") and not r[8] and r[3]
    ]
    apart = {(u, a, b) for u, a, b in splits} | {(u, b, a) for u, a, b in splits}
    out = {}
    for a in able:
        best = None
        for b in able:
            if a[2] == b[2] or a[:2] != b[:2] or (a[0], a[2], b[2]) in apart:
                continue
            c = 1.0 if a[3] == b[3] else cosines.get((a[3], b[3]), 0)
            modes, lands = (a[9] or "", b[9] or ""), (LANDS[a[10] or ""], LANDS[b[10] or ""])
            if c < 0.93 or any(x and y and x != y for x, y in (modes, lands)):
                continue
            gap = abs(a[11] - b[11]) if a[11] and b[11] else None
            if gap is not None and gap > timedelta(days=14):
                continue
            place = (-round(c, 12), gap is None, gap or timedelta(0), b[2])
            if best is None or place < best[0]:
                best = (place, b)
        if best:
            b = best[1]
            first = (a[11] is None, a[11] or datetime.min, a[2]) < (b[11] is None, b[11] or datetime.min, b[2])
            out[a[2]] = (b[2], *((a[2], b[2]) if first else (b[2], a[2])))
    return out


@pytest.mark.parametrize("seed, same_time", [(1, False), (2, True), (3, False)])
def test_equals_brute_force(spark, seed, same_time):
    rows = cases(240, seed, same_time)
    rng = random.Random(seed)
    # Some cases are split from a whole run of others at one instant or around it.
    splits = [(0, a, b) for a in (0, 3, 6, 30) for b in range(0, 240, 3) if a != b and rng.random() < 0.8]
    splits += [(r[0], r[2], rng.randrange(240)) for r in rng.sample(rows, 30)]
    df = spark.createDataFrame(rows, KIND)
    texts = spark.createDataFrame([(0, 0, t) for t in set(TEXTS)], "user_id long, company_id long, vec_id string")
    vectors = S.with_sparse_vector(texts, "vec_id")
    cosines = {(r.left_id, r.right_id): r.cosine for r in S.similar_pairs(vectors, vectors, ["user_id", "company_id"], 0.5).collect()}
    apart = spark.createDataFrame(splits, "user_id long, case_id long, other_id long")
    got = {r.case_id: (r.partner_id, r.keep, r.merge) for r in find_duplicates(df, apart).collect()}
    want = brute(rows, splits, cosines)
    assert got == want and len(want) > 60
    none = apart.limit(0)
    assert {r.case_id: (r.partner_id, r.keep, r.merge) for r in find_duplicates(df, none).collect()} == brute(rows, [], cosines)


def test_nearest_points(spark):
    rng = random.Random(4)
    points = sorted({(k % 2, rng.randrange(5000)) for k in range(200)})
    asks = sorted({(k % 3, rng.randrange(-100, 5200)) for k in range(300)} | set(points[::3]))
    got = nearest_points(
        spark.createDataFrame(asks, "k int, t long"), spark.createDataFrame(points, "k int, t long"), ["k"], "t",
        slice_of=F.floor(F.col("t") / 100),
    )
    want = {
        (k, t): (max((p for j, p in points if j == k and p < t), default=None), min((p for j, p in points if j == k and p > t), default=None))
        for k, t in asks
    }
    assert {(r.k, r.t): (r.before, r.after) for r in got.collect()} == want


def test_no_window_over_a_group(spark):
    """What is ordered is a slice of an hour, or one row per slice, or the first ids of a key."""
    df, apart = spark.createDataFrame(cases(60, 5), KIND), spark.createDataFrame([], "user_id long, case_id long, other_id long")
    plan = find_duplicates(df, apart)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("_slice" in x or "row_number()" in x for x in windows)


def test_asks_only_where_there_is_a_group(spark, monkeypatch):
    """A case without mode and country may merge with any; it asks in the groups that exist, once per instant."""
    from caseledger.operators import resolution

    looked = []
    real = resolution.nearest_points

    def counted(asks, points, *args, **more):
        looked.append(asks.count())
        return real(asks, points, *args, **more)

    monkeypatch.setattr(resolution, "nearest_points", counted)
    rows = [
        (0, 0, k, "data engineer", None, "live", "applied", None, False, None, None, datetime(2024, 3, 1 + k % 2)) for k in range(40)
    ]
    none = spark.createDataFrame([], "user_id long, case_id long, other_id long")
    got = {r["case_id"]: r["partner_id"] for r in find_duplicates(spark.createDataFrame(rows, KIND), none).collect()}
    assert got == {k: (k % 2 if k > 1 else k + 2) for k in range(40)}
    assert looked == [2]
