import hashlib
import math
import random
import re
import string
from collections import Counter

import check
import pytest
from conftest import SF
from llm_helpers import awkward, empty, prose
from pyspark.sql import functions as F

from caseledger.llm.queries import ORACLES, QUERIES
from caseledger.llm.secrets import ALPHABETS, KINDS, Battery, combined, discovered, judged, secret_digests, upper_tail
from caseledger.llm.shared import prepare

PATTERNS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+"), "token": re.compile(r"[A-Za-z0-9+/_=-]+"),
}
LEAST = {"access": 20, "hex": 24, "token": 20}


def tail(z):
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def chances(body):
    """(alphabet, even, text) of a token by plain loops."""
    n = len(body)
    alphabet, _, symbols, half = next(a for a in ALPHABETS if re.fullmatch(f"[{a[1]}]+", body))
    k, x, counts = len(symbols), [symbols.index(c) for c in body], Counter(body)
    chi = sum((counts[c] - n / k) ** 2 / (n / k) for c in symbols)
    v = 2 / (9 * (k - 1))
    p_chi = tail(((chi / (k - 1)) ** (1 / 3) - (1 - v)) / math.sqrt(v))
    first = [bool(re.match(f"[{half}]", c)) for c in body]
    n1, n2 = sum(first), n - sum(first)
    runs = 1 + sum(a != b for a, b in zip(first, first[1:]))
    mu = 2 * n1 * n2 / n + 1
    sd = math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9))
    p_runs = 2.0 ** (1 - n) if not n1 or not n2 else min(1, 2 * tail(abs(runs - mu) / sd))
    mean = sum(x) / n
    var = sum((a - mean) ** 2 for a in x)
    r = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:]))
    p_serial = 1e-300 if var <= 1e-9 else min(1, 2 * tail(abs(r / var + 1 / n) * math.sqrt(n)))
    h = -sum(map(math.log, (p_chi, p_runs, p_serial)))
    even = math.exp(-h) * (1 + h + h * h / 2)
    pairs, equal = n * (n - 1) / 2, sum(c * (c - 1) // 2 for c in counts.values())
    sd = math.sqrt(pairs * 0.065 * 0.935 + n * (n - 1) * (n - 2) * (0.0055 - 0.065**2))
    kind = lambda c: (c.isupper(), c.islower(), c.isdigit())
    changes = sum(kind(a) != kind(b) for a, b in zip(body, body[1:]))
    p = tail((pairs * 0.065 - equal - 0.5) / sd), tail((changes - 0.5 - (n - 1) / 4) / math.sqrt((n - 1) * 3 / 16))
    h = -sum(map(math.log, p))
    return alphabet, even, max(min(1, math.exp(-h) * (1 + h)), 1e-300)


def brute(texts):
    """The digest columns of every text."""
    base, tokens = [], []
    for i, t in enumerate(texts):
        t, mine = t or "", []
        for kind in ("assign", "access", "hex"):
            for m in PATTERNS[kind].finditer(t):
                if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= LEAST[kind]:
                    mine.append((m.start(), kind, m.end()))
        base.append(mine)
        for m in PATTERNS["token"].finditer(t):
            body = m[0].rstrip("=")
            if len(body) < 20 or not any(re.fullmatch(f"[{a[1]}]+", body) for a in ALPHABETS):
                continue
            if all(e <= m.start() or s >= m.end() for s, _, e in mine):
                alphabet, even, text = chances(body)
                step = math.floor(-50 * math.log10(text))
                tokens.append((alphabet, len(body).bit_length(), step, even, i, m.start(), m.end()))
    cuts = {}
    for family in {t[:2] for t in tokens}:
        steps = [t[2] for t in tokens if t[:2] == family]
        good = [s for s in set(steps) if len(steps) * 10 ** (-s / 50) <= 0.01 * sum(x >= s for x in steps)]
        if good:
            cuts[family] = min(good)
    out = [list(b) for b in base]
    for *family, step, even, i, s, e in tokens:
        if tuple(family) in cuts and step >= cuts[tuple(family)] and even >= 1e-3:
            out[i].append((s, "random", e))
    told = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))))
    return [
        (*(sum(k == kind for _, k, _ in b) for kind in KINDS[:3]), hashlib.sha256(told(b).encode()).hexdigest(), told(o))
        for b, o in zip(base, out, strict=True)
    ]


def rows(df):
    return [tuple(r) for r in df.orderBy("doc_id").select("n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()]


def of(seed, chars, n):
    return "".join(random.Random(seed).choices(chars, k=n))


def test_query_equals_sql_and_brute_force(spark):
    df = QUERIES["op13_secret_scan"](spark, SF)
    problem, n = check.compare(df, check.duck(SF), ORACLES["op13_secret_scan"])
    assert problem is None and n > 0
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert rows(df) == brute(texts)


def planted():
    b62, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    hexa = "0123456789abcdef"
    words = "Request Handler Factory Service Value Object Manager Reader Writer Stream Token Parser Loader Bean Context".split()
    texts = [
        f"a key {of(k, b62, 28 + k % 20)} and more {of(k + 999, b64, 40)}== é𝄞 end" for k in range(40)
    ] + [
        " ".join("".join(random.Random(k * 7 + j).choices(words, k=4)) for j in range(6)) for k in range(60)
    ] + [
        f'PassWord : "abcdef{k}" token=ab api-key=xyzxyz API_KEY="{of(k, hexa, 40)}" 𝄞 apikey:"x_y.z=" secret=token:abcdefgh'
        for k in range(10)
    ] + [
        f"AKIA{of(k, string.ascii_uppercase + string.digits, 16)} AKIA12 xAKIA{of(k, string.ascii_uppercase, 30)} {of(k, hexa, 23)}g{of(k, hexa, 64)}"
        for k in range(10)
    ] + [
        "abcdefghijklmnopqrstuvwxyz0123456789", "XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX", "0123456789" * 5, "a/b_c" * 9, "=" * 40,
        "passwoRd=ſecret ſecret=abcdefgh toKen=abcdefgh", "token\n=abcdefgh", "token =  abcdefgh", None, "",
        "1f3870be-274f-6c49-b3e3-1a0c6728957f", "x" * 19 + "=" * 30,
    ]
    return texts


def test_planted_secrets(spark):
    texts = planted()
    df = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(secret_digests(df))
    assert got == brute(texts)
    # A token that is random may still look regular by chance, once in a thousand per test.
    assert sum(r[4].count("random") for r in got[:40]) >= 78 and not any("random" in r[4] for r in got[40:])
    assert all(r[0] == 3 for r in got[100:110]) and all(r[1] == 2 and r[2] == 1 for r in got[110:120])


def test_words_are_not_taken_for_random(spark):
    rng = random.Random(5)
    syllables = "ein ich der und the ing tion ment aus ver keit heit schaft able con pre que ado cion eur ment".split()
    tokens = [("".join(rng.choices(syllables, k=6)), "word") for _ in range(2000)]
    tokens += [(of(k, string.ascii_letters + string.digits, 32), "key") for k in range(40)]
    df = prepare(spark).createDataFrame([(k, *t) for k, t in enumerate(tokens) if len(t[0]) >= 20], "row long, what string, kind string")
    found = {r["kind"]: r["count"] for r in discovered(judged(df)).groupBy("kind").count().collect()}
    assert found["key"] >= 38 and found.get("word", 0) <= 1
    alone = discovered(judged(df.filter("kind = 'word'"))).count()
    assert alone <= 20


def test_chances(spark):
    values = [-9.0, -3.0, -0.5, 0.0, 0.1, 1.0, 2.5, 6.0, 12.0, 30.0]
    got = prepare(spark).createDataFrame([(v,) for v in values], "z double").select(upper_tail(F.col("z"))).collect()
    assert all(g[0] == pytest.approx(tail(v), rel=1e-6) for v, g in zip(values, got, strict=True))
    one = spark.range(1).select(combined([F.lit(0.2), F.lit(0.03), F.lit(0.5)])).first()[0]
    h = -math.log(0.2 * 0.03 * 0.5)
    assert one == pytest.approx(math.exp(-h) * (1 + h + h * h / 2))


def test_awkward_rows(spark):
    df = awkward(prepare(spark)).withColumnRenamed("v", "row").withColumnRenamed("nth", "spans")
    got = secret_digests(df)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    found = got.collect()
    assert len(found) == df.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in found)


def test_many_matches_in_one_long_text(spark):
    text = " ".join(f"token={of(k, 'abc', 8)} {prose(k, 12)}" for k in range(3000))
    df = prepare(spark).createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = secret_digests(df).collect()
    want = brute([text])[0]
    assert len(got) == 3 and all(tuple(r)[1:] == want and r["n_assign"] == 3000 for r in got)


def test_empty(spark):
    assert secret_digests(empty(prepare(spark))).count() == 0 and Battery().least_length == 20
