"""The trie of conversation prefixes against a plain one."""

import collections
import hashlib
import random
import zlib

import pytest

from cragspan.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 long, slice string"


def plain(rows, rebuild=True):
    """Nodes by walking every prefix of every rebuilt conversation."""
    held = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    talk = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in held.items()}

    def base(c):
        return c - (c % 100 if c >= 0 else -(-c % 100))

    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in talk}
        talk = {c: talk.get(base(c), [])[: h[c]] + w[h[c] :] for c, w in talk.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, w in talk.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].add(c)
        ends[tuple(w)].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(members[n]) - 1) * len(n[-1][1]) if n else 0
    sha = {n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest() for n in members}
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha[n]) for n, m in members.items())


def run(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = prefix_trie.prefix_trie(table, **options)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()))


def talks(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(-110, -90), *range(0, 12), *range(95, 140), 250, 10**15 + 7, 10**15]:
        for t in range(r.choice([1, 2, 3, 7, 8])):
            rows.append((c, r.choice([None, t, t, t]), r.choice(["user", "user", None, "assistant"]), r.choice(["a", "bb", "", None, "\u00e9\U0001f600", "long text " * 9])))
    return rows + rows[:5] + [(None, 1, "user", "nobody"), (None, None, None, None)]


@pytest.mark.parametrize("rebuild", [True, False])
def test_odd_rows(spark, rebuild):
    rows = talks(3)
    assert run(spark, rows, rebuild=rebuild) == plain(rows, rebuild)


def test_none_and_one(spark):
    assert run(spark, []) == [] == run(spark, [(None, 1, "user", "x")])
    assert run(spark, [(5, 1, "user", "x")]) == plain([(5, 1, "user", "x")])


def test_a_long_conversation_and_many_copies(spark, monkeypatch):
    """A conversation far longer than a run, one met by many copies, and paths that hang from each other."""
    monkeypatch.setattr(prefix_trie, "RUN_BITS", 4)
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 3)
    rows = [(7, t, "user", f"t{t % 3}") for t in range(200)]
    rows += [(c, t, "user", f"t{t}") for c in range(1000, 1500) for t in range(3)]
    rows += [(3000 + c, t, "user", f"s{t}") for c in range(12) for t in range(c + 1)]
    assert run(spark, rows, rebuild=False) == plain(rows, False)
    assert run(spark, rows) == plain(rows)
    with pytest.raises(RuntimeError):
        run(spark, rows, rebuild=False, most_rounds=3)
