"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is good or bad.  A line's features are counts over its bytes and words and those of the
lines before and after it; forward-backward gives each line's marginal, and the marginals, weighted
by line length, make the document's quality, calibrated on the labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragspan.llm.session import random_key
from cragspan.llm.words import Words, pieces

#: The bound of the labelled sample that the field is fitted on, in documents.
SAMPLE_DOCS = 4_000
#: Bytes of text that the sample holds in the mean, at most.
SAMPLE_BYTES = 64_000_000
#: Lines of labelled texts that the fit looks at, about; a text of more teaches nothing.
SAMPLE_LINES = 500_000
ROUNDS = 120
PENALTY = 1e-3
FEATURES = 15


def _class(*chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in "".join(chars)]] = True
    return out


_UPPER, _LOWERS, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
_STOP, _CALL, _MARK, _BAR, _TAG, _BLANK = _class(".,;:"), _class("!?"), _class("#$%&*@^~=+"), _class("|\\/_"), _class("<>{}[]()"), _class(" \t\r\x0b\x0c")
_OTHER = np.arange(256) >= 128
_KINDS = np.stack([_UPPER, _LOWERS, _DIGIT, _STOP, _CALL, _MARK, _BAR, _TAG, _BLANK, _OTHER])


def line_features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(features of each line, text of each line, bytes of each line)``; an empty text has one empty line."""
    lines = [r.split(b"\n") for r in raws]
    doc = np.repeat(np.arange(len(raws)), [len(x) for x in lines])
    flat = [line for x in lines for line in x]
    size = np.array([len(x) for x in flat])
    buf = np.frombuffer(b"\n".join(flat) + b"\n", np.uint8)
    start = np.cumsum(size + 1) - size - 1
    share = np.stack([np.add.reduceat(k[buf], start, dtype=np.int32) for k in _KINDS], 1) / np.maximum(size, 1)[:, None]
    words = Words(flat)
    n = np.maximum(words.count, 1)
    order = np.lexsort((words.hash, words.doc))
    h, at = words.hash[order], words.doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    distinct = np.bincount(at[fresh], minlength=len(flat)) / n
    again = np.zeros(len(h), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    stutter = np.bincount(words.doc[again], minlength=len(flat)) / n
    mean = np.minimum(size / n, 40) / 10
    columns = [np.log1p(size) / 5, mean, distinct * (words.count > 0), stutter, np.log1p(words.count) / 5 * (1 - distinct)]
    return np.concatenate([share, np.stack(columns, 1)], 1).astype(np.float32), doc, size


def emissions(features: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A line's own features and its neighbours' (0 beyond the text), each also squared-rooted, with edge marks and a constant."""
    x = np.concatenate([features, np.sqrt(np.abs(features))], 1)
    same = doc[1:] == doc[:-1]
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:] = x[:-1] * same[:, None]
    after[:-1] = x[1:] * same[:, None]
    first, last = np.ones((len(x), 1), np.float32), np.ones((len(x), 1), np.float32)
    first[1:, 0] = ~same
    last[:-1, 0] = ~same
    return np.concatenate([x, before, after, first, last, np.ones_like(first)], 1)


def marginals(score: np.ndarray, turn: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: P(good) of each line and the sum of pair marginals.

    ``score``: a line's log weight of good against bad; ``turn``: log weights of label pairs.
    Lines at the same place of their texts are one step; steps run over the texts that reach them.
    """
    n = len(score)
    count = np.bincount(doc)
    count = count[count > 0]
    first = np.cumsum(count) - count
    by_size = np.argsort(-count, kind="stable")
    first, count = first[by_size], count[by_size]
    w, t = np.stack([np.zeros(n), score], 1), np.exp(turn)
    w = np.exp(w - w.max(1, keepdims=True))
    ahead, back, pairs = np.empty((n, 2)), np.empty((n, 2)), np.zeros((2, 2))
    longest = int(count[0]) if len(count) else 0
    reach = np.searchsorted(-count, -np.arange(longest), "left")  # texts longer than k lines
    for k in range(longest):
        at = first[: reach[k]] + k
        a = w[at] if not k else (ahead[at - 1] @ t) * w[at]
        ahead[at] = a / a.sum(1, keepdims=True)
    back[first + count - 1] = 0.5
    for k in range(longest - 2, -1, -1):
        at = first[: reach[k + 1]] + k
        later = w[at + 1] * back[at + 1]
        b = later @ t.T
        back[at] = b / b.sum(1, keepdims=True)
        both = ahead[at][:, :, None] * t * later[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
    p = ahead * back
    return p[:, 1] / p.sum(1), pairs


def fit_field(x: np.ndarray, doc: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximum likelihood with an L2 penalty by Adam: ``(mean, scale, weights, turn)``.  ``label`` is per line."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    z = ((x - mean) / scale).astype(np.float64)
    each = 1.0 / np.bincount(doc)[doc]  # every text weighs alike, however many lines it has
    want = np.zeros((2, 2))
    same = doc[1:] == doc[:-1]
    np.add.at(want, (label[:-1][same], label[1:][same]), 1.0)
    w, turn = np.zeros(z.shape[1] + 4), None
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, ROUNDS + 1):
        turn = w[-4:].reshape(2, 2)
        p, pairs = marginals(z @ w[:-4], turn, doc)
        texts = max(1.0, each.sum())
        g = np.concatenate([(z.T @ ((p - label) * each)) / texts, ((pairs - want) / max(1, len(z))).ravel()]) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return mean, scale, w[:-4], w[-4:].reshape(2, 2)


def _document(p: np.ndarray, doc: np.ndarray, size: np.ndarray, texts: int) -> np.ndarray:
    weight = size + 1.0
    return np.bincount(doc, p * weight, texts) / np.bincount(doc, weight, texts)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, seed: int = 7, sample_bytes: int = SAMPLE_BYTES, sample_lines: int = SAMPLE_LINES) -> dict:
    """A field fitted on about ``sample`` labelled texts, ``sample_bytes`` of them and ``sample_lines`` of their lines, chosen by a hash of their ids.

    ``docs(doc_id, text)``, ``labels(doc_id, quality)``.  A text's lines take its label; null
    labels and texts, and texts of more than ``sample_lines`` lines, teach nothing and a text with several labels takes their mean, rounded.
    Without any labelled text the score is a constant half.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    part = F.pmod(random_key(seed, "_id"), F.lit(1 << 30)) / float(1 << 30)
    share = sample / max(1, known.count())

    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1

    def drawn(upto: float) -> DataFrame:
        return docs.select("doc_id", "text").where("text is not null").withColumn("_lines", lines).where(F.col("_lines") <= sample_lines).join(F.broadcast(known.where(part < upto)), F.col("doc_id") == F.col("_id"))

    size, count = drawn(share).agg(F.sum(F.octet_length("text")), F.sum("_lines")).first()
    rows = drawn(share * min(1.0, sample_bytes / (size or 1), sample_lines / (count or 1)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j, raws in pieces(b["text"].tolist()):
                f, doc, size = line_features(raws)
                cuts = np.cumsum(np.bincount(doc, minlength=len(raws)))[:-1]
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[i:j], "label": b["label"].to_numpy()[i:j], "lines": [x.tobytes() for x in np.split(f, cuts)], "sizes": [x.astype(np.int64).tobytes() for x in np.split(size, cuts)]})

    seen = rows.mapInPandas(measure, "doc_id long, label int, lines binary, sizes binary").orderBy("doc_id").toPandas()  # bounded by the sample
    if not len(seen):
        return {"field": None}
    parts = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in seen["lines"]]
    doc = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    size = np.concatenate([np.frombuffer(x, np.int64) for x in seen["sizes"]])
    label = seen["label"].to_numpy()
    x = emissions(np.concatenate(parts), doc)
    mean, scale, w, turn = field = fit_field(x, doc, label[doc])
    p, _ = marginals(((x - mean) / scale) @ w, turn, doc)
    q = _logit(_document(p, doc, size, len(parts)))
    line = np.stack([np.concatenate([q, [4.0, -4.0]]), np.ones(len(q) + 2)], 1)  # one document of each label as prior
    y, fit = np.concatenate([label, [1, 0]]), np.array([1.0, 0.0])
    for _ in range(30):
        e = 1 / (1 + np.exp(-np.clip(line @ fit, -30, 30)))
        fit = fit - np.linalg.solve(line.T @ (line * (e * (1 - e))[:, None]) + 1e-2 * np.eye(2), line.T @ (e - y) + 1e-2 * (fit - [1.0, 0.0]))
    return {"field": field, "fit": fit}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the quality score (0 to 1) of every whole text; null texts count as empty, which is one empty line."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        for texts in batches:
            found = [np.zeros(0)]
            for _, _, raws in pieces(texts.tolist()):
                if m["field"] is None:
                    found.append(np.full(len(raws), 0.5))
                    continue
                mean, scale, w, turn = m["field"]
                f, doc, size = line_features(raws)
                p, _ = marginals(((emissions(f, doc) - mean) / scale) @ w, turn, doc)
                q = _logit(_document(p, doc, size, len(raws)))
                found.append(1 / (1 + np.exp(-np.clip(m["fit"][0] * q + m["fit"][1], -30, 30))))
            yield pd.Series(np.concatenate(found))

    return docs.withColumn(out, F.pandas_udf(judge, "double")(F.col(text)))
