"""The registered corpus queries against plain Python versions on a whole small table."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from cragspan.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _crc(i):
    return zlib.crc32(str(i).encode())


def test_language_model_base(spark, docs):
    got = {r.doc_id: r for r in queries.op3_language_model(spark, SF).collect()}
    tokens = {i: [*WORD.findall((r.text or "").translate(LOWER)), None] for i, r in docs.items()}
    count = collections.Counter(t for i, x in tokens.items() if _crc(i) % 7 != 2 for t in x)
    total = sum(count.values())
    assert set(got) == set(docs)
    for i, x in tokens.items():
        base = sum(math.log10((count[t] + 1) / (total + len(count) + 1)) for t in x)
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (_crc(i) % 7 == 2, len(x), sum(count[t] > 0 for t in x), total)
        assert abs(g.base_score - base) < 1e-6 * max(1, -base) and g.score <= 0
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)  # better than the base on texts it hasn't seen


def test_language_held_out(spark, docs):
    got = queries.op4_language(spark, SF).collect()
    held = [g for g in got if g.held_out and docs[g.doc_id].lang and g.lang_pred != "und"]
    assert {g.doc_id for g in got} == set(docs) and all(g.held_out == (_crc(g.doc_id) % 4 == 2) for g in got)
    assert sum(g.lang_pred == docs[g.doc_id].lang for g in held) >= 0.95 * len(held)
    assert all(g.lang_pred == "und" for g in got if not any(c.isalpha() for c in docs[g.doc_id].text or ""))


def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in queries.op5_fingerprints(spark, SF).collect()}
    order = sorted(docs, reverse=True)
    for k, i in enumerate(order):
        text, after = docs[i].text or "", docs[order[(k + 1) % len(order)]].text or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), _sha(edited))
    long = [g for g in got.values() if g.n_chars > 1000]
    assert sum(g.near_edited for g in long) / len(long) > 0.2 + sum(g.near_next for g in long) / len(long)  # half the text is kept


RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def test_secrets(spark, docs):
    got = {r.doc_id: r for r in queries.op6_secrets(spark, SF).collect()}
    for i, r in docs.items():
        found = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, rule, ok) in enumerate(RULES) for m in rule.finditer(r.text or "") if ok(m)]
        each = [sum(f[1] == k for f in found) for k in range(3)]
        spans = [f[2] for f in sorted(found)]
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256] == [*each, _sha(",".join(spans))]
        assert set(spans) <= set(got[i].spans.split(","))


def test_quality_held_out(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op7_quality(spark, SF).collect()
    held = [g for g in got if g.held_out and labels.get(g.doc_id) is not None]
    assert {g.doc_id for g in got} == set(docs) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got)
    assert sum(g.predicted == labels[g.doc_id] for g in held) >= 0.9 * len(held)


def test_shards(spark, docs):
    got = queries.op9_sharding(spark, SF).collect()
    by = collections.defaultdict(list)
    for g in got:
        text = (docs[g.doc_id].text or "").encode()
        assert (g.size, g.text_crc32, g.law, g.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
        by[g.shard].append(g.slot)
    assert sorted(by) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(got) == len(docs)


def test_mixing(spark, docs):
    got = queries.op10_mixing(spark, SF).collect()
    size = {i: len(WORD.findall(r.text or "")) for i, r in docs.items()}
    sums = collections.Counter()
    for i, r in docs.items():
        sums[r.source] += size[i]
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, rest = {}, list(order), float(sum(sums.values()))
    while free:
        unit = rest / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > 3 * sums[s]]
        for s in full or free:
            target[s] = 3.0 * sums[s] if full else weight[s] * unit
        rest -= sum(target[s] for s in full)
        free = [s for s in free if s not in target]
    taken = collections.Counter()
    for g in got:
        s = docs[g.doc_id].source
        assert (g.size, g.source_size) == (size[g.doc_id], sums[s]) and abs(g.target - target[s]) < 1e-6 and 0 <= g.taken <= 3 * g.size
        taken[s] += g.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in order)
