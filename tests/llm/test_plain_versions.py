"""Document scores and mixes of the registered queries' operators against plain versions."""

import collections
import math
from fractions import Fraction

import numpy as np

from cragspan.llm import mixing, quality, queries

SF = "/root/testdata/sf0.001"


def plain_score(model, text):
    """A text's score: lines, their emissions, forward-backward over two labels, the mean by length, the calibration."""
    mean, scale, w, turn = model["field"]
    f, _, size = quality.line_features([(text or "").encode()])
    wide = [np.concatenate([x, np.sqrt(np.abs(x))]) for x in f]
    none = np.zeros_like(wide[0])
    logs = []
    for k, x in enumerate(wide):
        before, after = wide[k - 1] if k else none, wide[k + 1] if k + 1 < len(wide) else none
        e = np.concatenate([x, before, after, [float(k == 0), float(k + 1 == len(wide)), 1.0]]).astype(np.float32)
        logs.append(float(((e - mean) / scale) @ w))

    def onward(scores, way):
        """For each line and label the log weight of all labels on one side of it."""
        at, out = [0.0, 0.0], []
        for s in scores:
            out.append(at)
            here = [at[y] + (s if y else 0.0) for y in (0, 1)]
            at = [np.logaddexp(here[0] + way[0][y], here[1] + way[1][y]) for y in (0, 1)]
        return out

    ahead, back = onward(logs, turn), onward(logs[::-1], turn.T)[::-1]
    p = []
    for s, a, b in zip(logs, ahead, back, strict=True):
        bad, good = a[0] + b[0], a[1] + b[1] + s
        p.append(1 / (1 + math.exp(min(700.0, bad - good))))
    weight = [float(x) + 1.0 for x in size]
    q = min(max(sum(a * b for a, b in zip(p, weight, strict=True)) / sum(weight), 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, model["fit"][0] * math.log(q / (1 - q)) + model["fit"][1]))))


def test_quality_scores(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learned = docs.where(queries._remainder(5) != 0)
    model = quality.train(learned, labels)
    got = {r.doc_id: r.score for r in queries.op7_quality(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert abs(got[r.doc_id] - plain_score(model, r.text)) < 1e-5, r.doc_id
    assert len({round(x, 9) for x in got.values()}) > 20


def test_mixes_are_whole_turns(spark):
    """Sizes and targets exactly; a source's words are taken in turns, so that all but one of its documents are taken as often, or once more."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()
    got = {r.doc_id: r for r in queries.op10_mixing(spark, SF).collect()}
    size = {r.doc_id: len((r.text or "").translate({c: " " for c in range(9, 14)}).split(" ")) - (r.text or "").translate({c: " " for c in range(9, 14)}).split(" ").count("") for r in docs}
    own = collections.Counter()
    for r in docs:
        own[r.source] += size[r.doc_id]
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weigh = {s: 1 + k % 3 for k, s in enumerate(order)}
    goal, free, rest = {}, list(order), Fraction(sum(own.values()))
    while free:
        share = {s: rest * weigh[s] / sum(weigh[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 3 * own[s]]
        goal |= {s: Fraction(3 * own[s]) for s in full} if full else share
        rest -= sum(goal[s] for s in full)
        free = [s for s in free if s not in full] if full else []
    by = collections.defaultdict(list)
    for r in docs:
        g = got[r.doc_id]
        assert (g.size, g.source_size) == (size[r.doc_id], own[r.source]) and abs(g.target - float(goal[r.source])) < 1e-6
        by[r.source].append(g)
    for s, rows in by.items():
        turns = math.floor(goal[s] / own[s]) if own[s] else 0
        assert abs(sum(g.taken for g in rows) - goal[s]) <= Fraction(1, 2)
        assert all(turns * g.size <= g.taken <= (turns + 1) * g.size for g in rows)
        assert sum(g.taken not in (turns * g.size, (turns + 1) * g.size) for g in rows) <= 1
    assert mixing.targets({"a": 10, "b": 0}, [1, 2]) == {"a": 10, "b": 0}
