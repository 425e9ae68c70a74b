import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from llm_helpers import awkward, empty
from tokenizers import Tokenizer

from caseledger.llm.grouping_genetic import best_fit, crossover, evolve, fresh_packing, mutated
from caseledger.llm.packing import cut, packed
from caseledger.llm.queries import QUERIES
from caseledger.llm.shared import prepare
from caseledger.llm.tokens import token_ids


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def holds(rows, texts, tokenizer, most=1024):
    """Pieces rebuild the ids of every document; sequences are gapless and short enough. The number of sequences."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert len(mine) == 1 or all(r["length"] == most for r in mine[1:])
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= most
    return len(sequences)


def test_query(spark, tokenizer):
    rows = QUERIES["op6_best_fit_packing"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    count = holds(rows, texts, tokenizer)
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert count <= least * 1.02 + 1


def test_many_groups(spark, tokenizer):
    docs = prepare(spark).read.parquet(f"{SF}/documents.parquet")
    rows = packed(docs, group_rows=40, most=256).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    count = holds(rows, texts, tokenizer, 256)
    assert count <= -(-sum(r["length"] for r in rows) // 256) * 1.03 + 1


def test_fast_ids_equal_the_tokenizer(tokenizer, spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    odd = ["<|endoftext|>x", "a\u0085b c", " " * 500 + "x", "日本語 текст", "don't  \n\n  we'll", "ſ 𝒳   x", ""]
    for t in texts + odd:
        assert token_ids(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_cut():
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(4, 4) == [(0, 4)] and cut(1, 4) == [(0, 1)] and cut(8, 4) == [(0, 4), (4, 4)]


def test_genetic_steps_keep_every_item():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 500)
    a, b = fresh_packing(sizes, 100, rng, 0.0), fresh_packing(sizes, 100, rng, 0.3)
    for p in (a, b, crossover(a, b, sizes, 100, rng, 0.1), mutated(a, sizes, 100, rng, 0.1)):
        assert (p.bin_of >= 0).all() and (np.bincount(p.bin_of, weights=sizes) == p.fills).all() and p.fills.max() <= 100
    best = evolve(sizes, 100, seed=1, immigrants=[b.bin_of])
    assert best.cost <= b.cost and (np.bincount(best.bin_of, weights=sizes) == best.fills).all()


def test_best_fit_takes_the_fullest_bin():
    p = best_fit(np.array([6, 5, 4, 5]), np.arange(4), 10, np.full(4, -1, np.int32), np.empty(0, np.int32))
    assert p.bin_of.tolist() == [0, 1, 0, 1]


def test_awkward_rows(spark, tokenizer):
    df = awkward(prepare(spark))
    rows = packed(df).collect()
    starts = [r for r in rows if r["piece"] == 0]
    assert len(starts) == df.count()
    assert [r["length"] for r in rows if r["doc_id"] in (4, 5)] == [1, 1]
    once = {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] not in (3, 10, None)}
    only = df.filter("doc_id NOT IN (3, 10)")
    holds(packed(only).collect(), once, tokenizer)


def test_empty(spark):
    assert packed(empty(prepare(spark))).count() == 0
