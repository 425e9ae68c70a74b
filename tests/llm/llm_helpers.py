"""Small tables with everything that may go wrong, and brute-force twins of the operators."""

import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, bucket string, id string, nth string, v string"


def words(text):
    return WORDS.findall(text or "")


def prose(seed, n):
    """n words that hardly repeat."""
    return " ".join(f"w{zlib.crc32(f'{seed}.{i}'.encode()) % 100003}" for i in range(n)) + "."


def awkward(spark):
    """Null and empty texts, null ids, sources and languages, repeated rows and ids, ties, one long text, clashing names."""
    long_text = "\n".join(prose(k, 60) for k in range(400))
    rows = [
        (1, prose(1, 80)), (2, prose(1, 80)), (3, prose(3, 300)), (3, prose(3, 300)), (4, None), (5, ""), (6, " \t\n "),
        (7, "one two three"), (8, "ONE two Three"), (9, long_text), (None, prose(1, 80)), (10, prose(10, 60)),
        (10, prose(11, 60)), (11, prose(11, 60)), (12, "é" * 50 + " ü"), (13, "<|endoftext|> a\u0085b c"),
    ]
    full = [
        (i, t, None if k == 2 else "en", [None, "", "a", "b"][k % 4], len(t or ""), "x", "y", None, "z")
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, DOCUMENT)


def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


def exchanges_of(df, column):
    """The exchanges of the plan that carry a column of this name (a pattern)."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    plan = plan.split("== Initial Plan ==")[-1]
    return re.findall(rf"\) Exchange\s+Input \[\d+\]: \[[^\n]*\b(?:{column})#", plan)


def shingles(text, width=5):
    ws = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words(text)]
    if not ws:
        return frozenset()
    if len(ws) < width:
        return frozenset([tuple(ws)])
    return frozenset(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1))


def groups(ids, pairs):
    """Smallest id reachable over the pairs."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def similar(texts, percent):
    """Pairs of ids whose shingle sets are alike, every pair compared that shares a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    having = {}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    pairs = set()
    for i, s in sets.items():
        both = {}
        for x in s:
            for j in having[x]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        pairs |= {(j, i) for j, n in both.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)}
    return pairs


def crc_fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5
