"""The n-gram join on large groups of near copies, against an exact count of all pairs, and its measured recall."""

import collections
import random
import re

import numpy as np
import pytest

from cragspan.llm import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _grams(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _links(texts):
    """All pairs of Jaccard similarity 0.8 or more, by an inverted index."""
    sets, held, out = [_grams(t) for t in texts], collections.defaultdict(list), []
    for i, s in enumerate(sets):
        both = collections.Counter(j for g in s for j in held[g])
        out += [(j, i) for j, n in both.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)]
        for g in s:
            held[g].append(i)
    return out


def _group(r, words, size, most, name):
    """Near copies of one text: single words replaced, ends cut off, and for some a passage of another edition."""
    base = [r.choice(words) for _ in range(120)]
    for _ in range(size):
        t = list(base)
        for _ in range(r.randint(0, most)):
            t[r.randrange(len(t))] = r.choice(words)
        if r.random() < 0.3:
            t = t[: len(t) - r.randint(0, 10)]
        if r.random() < 0.4:
            t[30:45] = [f"{name}{i}" for i in range(5)]
        yield " ".join(t)


def _check(spark, texts):
    got = {x.doc_id: x for x in near_duplicates.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    up, links = list(range(len(texts))), collections.Counter()

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in _links(texts):
        links.update((a, b))
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    assert {i: (x.n_links, x.class_id) for i, x in got.items()} == {i: (links[i], top(i)) for i in range(len(texts))}
    return links


@pytest.mark.parametrize("block", [8, 512])
def test_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "DELTA_BLOCK", 4 * block)
    r = random.Random(block)
    words = [f"w{i}" for i in range(2000)]
    texts = [t for k, n in enumerate((2 * block, block // 2, 5)) for t in _group(r, words, n, 4, f"e{k}x")]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(60)] + [None, "", "a b"] + texts[:4]
    r.shuffle(texts)
    assert _check(spark, texts)


def test_recall_near_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.86, of which a pair is missed with a probability of 0.0001 at most."""
    r = random.Random(11)
    texts = []
    for k in range(400):
        t = [f"p{k}w{r.randrange(9999)}" for _ in range(104)]
        other = list(t)
        for at in r.sample(range(4, 100, 12), 2):
            other[at] = "changed"
        texts += [" ".join(t), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _links(texts)
    found = sum(x.n_links for x in near_duplicates.join(docs).collect()) / 2
    print(f"recall near the threshold: {found / len(want):.4f} of {len(want)} pairs")
    assert len(want) > 300 and 0.99 * len(want) <= found <= len(want)


def test_ids_shared_by_texts_and_null_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, a), (4, None)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.class_id or 0, x.n_links) for x in near_duplicates.join(docs).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0)]


def test_ties_and_common_sets():
    nodes, tops = near_duplicates._ties(np.array([3, 1, 4]), np.array([2, 0, 2]), 6)
    assert dict(zip(nodes.tolist(), tops.tolist(), strict=True)) == {1: 0, 3: 2, 4: 2}
