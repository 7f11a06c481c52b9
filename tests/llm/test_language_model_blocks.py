"""Blocks of the language model: they give back the rows they were made of, and are no larger than they need to be."""

import numpy as np
import pytest

from cragspan.llm import language_model as lm


def rows(n, seed=3):
    """Runs of three words drawn as in a text, few of them very often, sorted by the key of the first two."""
    r = np.random.default_rng(seed)
    vocabulary = r.integers(0, 2**32, 2_000, dtype=np.uint64)
    one, two, last = (vocabulary[np.minimum(r.zipf(1.3, n), 2_000) - 1] for _ in range(3))
    keys, last = lm.mix((one << np.uint64(32)) | two), last.astype(np.uint32)
    order, first = lm._distinct(keys, last)
    number = r.integers(1, 400, len(first)).astype(np.uint64)
    return keys[order[first]], last[order[first]], number


@pytest.mark.parametrize("least", [1, 10**9])
@pytest.mark.parametrize("n", [1, 2, 500, 30_000])
def test_blocks_give_back_their_rows(monkeypatch, least, n):
    monkeypatch.setattr(lm, "WORDS_FROM", least)
    keys, last, number = rows(n)
    for columns, kinds in (((number,), [np.uint64]), ((last, number), [np.uint32, np.uint64])):
        got = lm._unpack(lm._pack(keys, *columns, pairs=True), kinds)
        order = np.lexsort([number, *([last] if len(columns) > 1 else []), keys])
        back = np.lexsort([got[-1], *([got[1]] if len(columns) > 1 else []), got[0]])
        for x, y in zip((keys, *columns), got, strict=True):
            assert x.dtype == y.dtype and (x[order] == y[back]).all()
    other = lm._pack(keys, keys[::-1], last, number)  # longer runs: contexts of other lengths beside them
    for x, y in zip((keys, keys[::-1], last, number), lm._unpack(other, [np.uint64, np.uint32, np.uint64]), strict=True):
        assert (x == y).all()


def test_blocks_are_small():
    keys, last, number = rows(60_000)
    one = np.ones(len(keys), np.uint64)
    assert len(lm._pack(keys, last, one, pairs=True)) < 4.5 * len(keys)
    assert len(lm._pack(keys, last, one)) < 1.1 * (len(lm._pack(np.unique(keys))) + len(lm._pack(np.zeros(len(keys), np.uint64), last)))


def test_runs_are_counted_alike_by_keys_and_by_words(spark, monkeypatch):
    r = np.random.default_rng(4)
    texts = [(" ".join(f"w{k}" for k in np.minimum(r.zipf(1.2, 40), 300)),) for _ in range(50)] + [("",), (None,)]
    docs = spark.createDataFrame(texts, "text string")
    blocks = {}
    for least in (1, 10**9):
        monkeypatch.setattr(lm, "WORDS_FROM", least)
        token, place, _ = lm._tokens([(t or "").encode() for (t,) in texts])
        runs = lm._counted(lm._contexts(token, place, 3), (token >> np.uint64(32)).astype(np.uint32), np.ones(len(token), np.int64))
        parts = [lm._unpack(b, [np.uint32, np.uint64]) for _, _, b in lm._spread(lm.RUNS + 3, 2, *runs)]
        blocks[least] = lm._counted([np.concatenate([p[0] for p in parts])], *[np.concatenate([p[k] for p in parts]) for k in (1, 2)])
    for x, y in zip(*blocks.values(), strict=True):
        assert (x == y).all()
    model = lm.train(docs)
    assert model["tokens"] == 50 * 41 + 2 and model["texts"] == 52
