import hashlib
import math
import re
import zlib
from collections import Counter

import check
import numpy as np
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import awkward, empty, prose

from caseledger.llm import importance
from caseledger.llm.importance import featured, histogram, resampled, shifted, window_crcs
from caseledger.llm.queries import ORACLES, QUERIES
from caseledger.llm.shared import prepare

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "item_id long, text string, doc_id long, score double"


def windows(text):
    """Every run of one to three words by plain loops."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, targets, buckets=10_000, least_words=20, percent=5):
    """(id, n_features, weight, score, rank) of every row."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source = Counter(bucket(f) for _, t in docs for f in windows(t)[1])
    target = Counter(bucket(f) for t in targets for f in windows(t)[1])
    S, T = sum(source.values()), sum(target.values())
    rows = []
    for i, t in docs:
        words, found = windows(t)
        weight = sum(
            math.floor(1000 * math.log((target[b] + 1) * (S + buckets) / ((source[b] + 1) * (T + buckets)))) for b in map(bucket, found)
        )
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(words)])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_equals_sql(spark):
    problem, n = check.compare(
        QUERIES["op12_importance_resampling"](spark, SF), check.duck(SF), ORACLES["op12_importance_resampling"]
    )
    assert problem is None and n > 0


def test_query_equals_brute_force(spark):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    want = brute(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")])
    assert got(QUERIES["op12_importance_resampling"](spark, SF)) == want and any(r[4] for r in want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.text(alphabet="aB9 .é—\x00İ", max_size=60)), max_size=4))
def test_windows(texts):
    data = [None if t is None else t.encode("utf-8", "ignore") for t in texts]
    for t, (n, crcs) in zip(data, window_crcs(data), strict=True):
        words, want = windows(None if t is None else t.decode())
        assert n == len(words) and crcs.tolist() == [zlib.crc32(f.encode()) for f in want]


def test_long_words_and_pieces(monkeypatch):
    text = ("x" * 5000 + " " + "é" * 40 + " short " + "y" * 129 + " z").encode()
    assert next(window_crcs([text]))[1].tolist() == [zlib.crc32(f.encode()) for f in windows(text.decode())[1]]
    long_text = "\n".join(prose(k, 50) for k in range(60)).encode()
    whole = next(window_crcs([long_text]))
    monkeypatch.setattr(importance, "_PIECE", 97)
    pieces = next(window_crcs([long_text]))
    assert whole[0] == pieces[0] and whole[1].tolist() == pieces[1].tolist()


def test_shifts():
    for n in (0, 1, 5, 64, 65, 1000, 70_000):
        crc = np.array([zlib.crc32(b"head")], np.uint32)
        tail = b"\x07" * n
        assert int(shifted(crc, np.array([n]))[0]) ^ zlib.crc32(tail) == zlib.crc32(b"head" + tail)


def test_awkward_rows(spark):
    df = awkward(prepare(spark))
    items = spark.createDataFrame([(1, prose(3, 40), 5, 0.1), (2, None, 6, None), (None, "", None, 0.2)], ITEM)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute(rows, [prose(3, 40)], percent=50)
    assert got(resampled(df, items, percent=50)) == want
    ranks = sorted(r[4] for r in want if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 3


def test_copies_take_ranks_of_their_own(spark):
    df = spark.createDataFrame([(k % 3, prose(1, 30)) for k in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(1, prose(1, 30), 1, 0.0)], ITEM)
    assert got(resampled(df, items, percent=40)) == brute([(k % 3, prose(1, 30)) for k in range(300)], [prose(1, 30)], percent=40)


def test_empty(spark):
    items = prepare(spark).createDataFrame([], ITEM)
    assert resampled(empty(spark), items).count() == 0
    some = awkward(spark)
    assert got(resampled(some, items)) == brute([(r["doc_id"], r["text"]) for r in some.collect()], [])
    assert sum(histogram(featured(some, id_col="doc_id"))) == sum(len(windows(r["text"])[1]) for r in some.collect())
