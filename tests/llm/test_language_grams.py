"""Grams of language ID: however they are told apart, they are those of a plain walk."""

import numpy as np

from cragspan.llm import languages


def test_distinct_grams(monkeypatch):
    texts = ["Hello, wörld! 12 ab", "", "日本語 テキスト", "x", "aaaa " * 50]
    symbols, doc = languages._symbols([t.encode() for t in texts])
    want = []
    for k in range(len(symbols)):
        if k and doc[k] == doc[k - 1]:
            want.append([int(symbols[k - b]) if k >= b and doc[k - b] == doc[k] else 0 for b in range(languages.ORDER - 1, -1, -1)])
    for table in (1 << 25, 0):
        monkeypatch.setattr(languages, "TABLE_GRAMS", table)
        grams, at = languages._distinct(symbols, doc)
        assert grams[at].tolist() == want
        assert len(np.unique(grams, axis=0)) == len(grams)
