"""Fingerprints, trees and components against plain versions."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cragspan.llm import queries, simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints):
    """Least place that links lead to, by comparing all pairs."""
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def near_prints(seed, families, size):
    """Fingerprints in families of a few flipped bits, chains among them, and lone ones."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(200)} | {0}
    for _ in range(families):
        at = r.getrandbits(64)
        for _ in range(size):
            x = at
            for b in r.sample(range(64), r.randrange(5)):
                x ^= 1 << b
            out.add(x)
            at = x if r.random() < 0.2 else at
    return sorted(out)


def test_fingerprints():
    r = random.Random(4)
    texts = [None, "", "  \n\t ", "One", "one  TWO\x0bthree", "a b c d", "a b c d a b c d a b c d", "\u00c4b \u00e9\u00a0x y z", " lead and trail \n"]
    texts += [" ".join(r.choice("abcdeXY") for _ in range(n)) for n in (3, 4, 5, 50, 999)]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t), t
    long = " ".join(str(k % 977) for k in range(2 * simhash.UNPACKED + 3))
    assert simhash.fingerprint(long.encode()) == plain_fingerprint(long)


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_blocks_cover_all_links(blocks):
    masks = simhash.masks(blocks)
    r = random.Random(blocks)
    for _ in range(2000):
        flips = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not flips & m for m in masks)
    assert simhash.blocks_for(1) == 5 and simhash.blocks_for(10**10) == 7 and simhash.blocks_for(10**15) == 8


def test_trees_find_all_links():
    fp = np.array(near_prints(1, 12, 40), np.uint64)
    tree = simhash.Forest(fp, np.zeros(len(fp), np.int64))
    pairs = [np.stack(x, 1) for x in tree.near(fp, np.full(len(fp), tree.root[0]))]
    ties = simhash._ties([tree.ties, *pairs], fp)
    want = plain_components([int(x) for x in fp])
    to = dict(zip(ties["a"].to_numpy().view(np.uint64).tolist(), ties["b"].to_numpy().view(np.uint64).tolist(), strict=True))
    assert [to.get(x, x) for x in fp.tolist()] == [int(fp[k]) for k in want]
    assert len(np.concatenate(pairs)) < 40 * len(fp)


@pytest.mark.parametrize(("shard", "held", "blocks"), [(4096, 64_000_000, None), (16, 64_000_000, None), (16, 2_000, None), (4096, 64_000_000, 6)])
def test_components(spark, monkeypatch, shard, held, blocks):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", held)
    prints = near_prints(2, 6, 60)
    fps = np.array(prints, np.uint64).view(np.int64).tolist()
    ties = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), blocks).collect()
    at = {x: k for k, x in enumerate(fps)}
    top = list(range(len(fps)))
    for _ in range(64):
        for t in ties:
            m = min(top[at[t.a]], top[at[t.b]])
            top[at[t.a]] = top[at[t.b]] = m
    assert top == plain_components(prints)


def test_query_on_tables_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    top = plain_components(prints)
    got = {r.doc_id: r for r in queries.op13_simhash(spark, sf).collect()}
    assert len(got) == len(rows)
    for r, fp, k in zip(rows, prints, top, strict=True):
        assert (got[r.doc_id].fingerprint, got[r.doc_id].component_id) == (f"{fp:016x}", rows[k].doc_id)
    assert len(set(top)) < len(top)


def test_odd_rows(spark):
    text = "words of one text " * 5
    rows = [(None, "lone text of a null id here"), (5, text), (3, text.upper()), (3, None), (9, ""), (9, ""), (7, "other words in this one"), (None, text)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, fp long, fingerprint string, root double")
    got = sorted(simhash.near_duplicates(docs).collect(), key=str)
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(False, 3, 3), (False, 3, 3), (False, 5, 3), (False, 7, 7), (False, 9, 3), (False, 9, 3)]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["3", "None"]
    assert {r.fingerprint for r in got if r.doc_id == 9} == {"0" * 16}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_very_long_text_and_many_copies(spark):
    r = np.random.default_rng(5)
    long = " ".join(f"w{k}" for k in r.integers(0, 5000, 300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string").union(spark.range(10, 100_010).select("id", F.lit("a copy of a text")))
    got = simhash.near_duplicates(docs).groupBy("component_id").count().collect()
    assert sorted((x.component_id, x["count"]) for x in got) == [(1, 2), (10, 100_000)]
