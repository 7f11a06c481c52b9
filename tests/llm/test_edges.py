"""Corpus operators on null ids, repeated rows, empty tables, very long texts, hot sources and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cragspan.llm import decontamination, fingerprints, language_model, languages, mixing, near_duplicates, quality, secret_scan, sharding, substrings
from cragspan.llm.words import Words

SCHEMA = "doc_id long, text string, lang string, source string, score double, slot int, key string, b string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0.5, 1, "k", "b") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, an id of two texts, repeated rows, null and empty texts."""
    text = " ".join(f"word{k}" for k in range(60))
    return _frame(spark, [(None, text, None), (1, text, None), (1, "other text here", None), (2, None, None), (3, "", None), (4, text, None), (4, text, None)]).cache()


def test_odd_rows(spark, odd):
    n = odd.count()
    bench = spark.createDataFrame([(7, "word3 word4 word5")], "item_id long, text string")
    assert decontamination.contamination(odd, bench).count() == n
    removed = substrings.dedup(odd).collect()
    assert len(removed) == n and max(r.n_removed for r in removed if r.doc_id == 4) == 60
    assert language_model.score(odd, language_model.train(odd)).count() == n
    prints = fingerprints.compare_with_edits(odd).collect()
    assert len(prints) == n and len({r.fingerprint for r in prints if r.doc_id == 4}) == 1
    assert sharding.shard(odd, 3).count() == n and sharding.place(odd, 3).select("shard", "slot").distinct().count() == n
    near = near_duplicates.join(odd).collect()
    assert len(near) == n and {r.class_id for r in near if r.doc_id == 4} == {1}


def test_one_source_that_is_null(spark, odd):
    got = mixing.taken(odd).collect()
    assert sum(r.taken for r in got) == sum(r.size for r in got) and all(r.target == r.source_size for r in got)


def test_a_mix_cuts_one_document_a_source(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(10 + i % 7)), "abc"[min(2, i % 5)]) for i in range(200)]
    docs = _frame(spark, rows)
    got = mixing.mixed(docs, block=8)
    assert got.columns == docs.columns
    sizes = {r.doc_id: r for r in mixing.taken(docs, block=8).collect()}
    words = got.groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert {r.doc_id: r.n for r in words} == {i: r.taken for i, r in sizes.items() if r.taken}
    whole = dict((i, t) for i, t, _ in rows)
    assert sum(r.text != whole[r.doc_id] for r in got.collect()) <= 3  # at most one for each of three sources


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    fresh, found, paths = secret_scan.scan(none, "doc_id", "text")
    assert secret_scan.by_path(paths, found).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(none, labels)
    assert quality.score(odd.select("doc_id", "text"), model).where("score <> 0.5").count() == 0
    assert mixing.mixed(none).count() == 0 and sharding.place(none, 4).count() == 0


def test_repeated_rows_teach_once(spark):
    """A copy of a text teaches nothing, and leaves the others of its language their share of the sample."""
    r = np.random.default_rng(2)
    texts = [(" ".join("".join(r.choice(list(letters), 3)) for _ in range(12)), lang) for letters, lang in (("abcd", "xx"), ("cdef", "yy")) for _ in range(30)]
    frame = spark.createDataFrame(texts, "text string, lang string")
    once = languages.train(frame, sample=25)
    again = languages.train(frame.union(frame.where("lang = 'xx'").limit(1).crossJoin(spark.range(400)).drop("id")), sample=25)
    assert once["names"] == again["names"] == ["xx", "yy"] and once["slope"] == again["slope"] and once["offset"] == again["offset"]
    assert all((a == b).all() for x, y in zip(once["models"], again["models"], strict=True) for a, b in zip(x, y, strict=True))
    got = {g.text: g for g in languages.identify(frame, once).collect()}
    assert sum(got[t].lang_pred == lang for t, lang in texts) >= 57


def test_many_matches_in_one_text(spark):
    n = 60_000
    text = " ".join(f"token={k:08d}" for k in range(n))
    docs = spark.createDataFrame([(1, text), (2, "token=abc token=abcdef, password: 12345678")], "doc_id long, text string")
    _, found, _ = secret_scan.scan(docs, "doc_id", "text")
    got = found.where("kind = 'assign'").groupBy("blob").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("end").alias("last"), F.sum(F.col("end") - F.col("start")).alias("size")).collect()
    assert sorted((g.n, g.first, g.last, g["size"]) for g in got) == [(2, 10, 42, 30), (n, 0, len(text), 14 * n)]


def test_places_of_very_many_identical_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FEW", 20)
    rows = [(7, "one text", "s")] * 500 + [(k, f"text {k}", "s") for k in range(50)] + [(3, "text 3", "s")] * 5 + [(None, None, None)] * 40
    docs = _frame(spark, rows)
    got = sharding.place(docs, 7)
    assert got.columns == [c for c in docs.columns if c != "slot"] + ["shard", "slot"]
    taken = [(r.shard, r.slot) for r in got.collect()]
    assert len(taken) == len(rows) == len(set(taken))
    assert sorted(got.groupBy("doc_id", "text").count().collect(), key=str) == sorted(docs.groupBy("doc_id", "text").count().collect(), key=str)


def test_texts_of_very_many_lines_teach_nothing(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    rows = [(k, ("good words in a line\n" if k % 2 else "x1 $$ ## 77\n") * 5) for k in range(40)]
    base = spark.createDataFrame(rows[:39], "doc_id long, text string")
    long = spark.createDataFrame([(39, "\n" * 5000)], "doc_id long, text string")
    one, two = (quality.train(d, labels, sample_lines=1000) for d in (base, base.union(long)))
    assert all(np.array_equal(a, b) for a, b in zip(one["field"], two["field"], strict=True))
    scores = {r.doc_id: r.score for r in quality.score(base.union(long), two).collect()}
    assert len(scores) == 40 and all(0 <= x <= 1 for x in scores.values())


def test_stretches_of_a_long_text_agree(monkeypatch):
    r = np.random.default_rng(1)
    text = " ".join(f"w{k}" for k in r.integers(0, 30, 3000)).encode()
    whole = substrings.segments(Words([text, text]))
    monkeypatch.setattr(substrings, "STRETCH", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, substrings.segments(Words([text, text])), strict=True))


def test_a_very_long_text(spark):
    """A text of one line of a few MB beside a short one."""
    r = np.random.default_rng(5)
    long = " ".join(f"w{k}" for k in r.integers(0, 5000, 400_000))
    docs = _frame(spark, [(1, long, "a"), (2, "short text of words", "b"), (3, long[:5000], "a")])
    assert {x.doc_id: x.n_words for x in substrings.dedup(docs).collect()}[1] == 400_000
    prints = {x.doc_id: x for x in fingerprints.compare_with_edits(docs).collect()}
    assert prints[1].n_chars == len(long) and 0 <= prints[1].near_edited <= 1
    assert {x.doc_id: x.n_links for x in near_duplicates.join(docs).collect()} == {1: 0, 2: 0, 3: 0}
    assert sum(x.taken for x in mixing.taken(docs).collect()) > 0
    score = quality.score(docs.select("doc_id", "text"), quality.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")))
    assert all(0 <= x.score <= 1 for x in score.collect())


def test_long_chains_compare_in_blocks(monkeypatch):
    r = np.random.default_rng(3)
    a, b = (r.integers(0, 256, (n, fingerprints.FILTER_BITS // 8)).astype(np.uint8) for n in (7, 30))
    whole = fingerprints.likeness(a, b)
    monkeypatch.setattr(fingerprints, "COMPARED_BYTES", 1)
    assert fingerprints.likeness(a, b) == whole == fingerprints.likeness(b, a)


def test_counts_past_32_bits():
    keys = np.array([1, 2**63], np.uint64)
    (_, _, block), *_ = language_model._spread(0, 1, keys[:1], np.array([5_000_000_000]))
    assert language_model._unpack(block, [np.uint64])[1].tolist() == [5_000_000_000]
