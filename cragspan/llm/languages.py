"""Language ID: an interpolated modified Kneser-Ney character model for each language.

Every model is kept as sorted arrays of 64-bit n-gram hashes with log probabilities beside them.
A text goes to the language with the lowest cross-entropy per character; how sure that is comes
from the margin to the next language, calibrated on labelled texts that the counts never saw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragspan.llm.session import random_key, saved
from cragspan.llm.words import mix, pieces

ORDER = 4
#: The bound of the labelled sample: texts of each language that are fitted on, and one more in CALIBRATE for calibration.
SAMPLE_TEXTS = 3_000
#: Bytes of text that the sample holds in the mean, at most for each language.
SAMPLE_BYTES = 64_000_000
CALIBRATE = 6
UNDETERMINED = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    return _LETTER[0]


def _symbols(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with one 0 between words, each text led by a 0; and each symbol's text."""
    texts = [r.decode("utf-8", "surrogatepass").lower() for r in raws]
    counts = [len(t) + 1 for t in texts]
    flat = np.frombuffer("".join("\n" + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    letter = _letters()[np.minimum(flat, 0x10FFFF)]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    return np.where(letter, flat, 0)[keep], doc[keep]


#: Up to so many possible grams of a piece's alphabet they are told apart by a table, else by sorting.
TABLE_GRAMS = 1 << 25


def _distinct(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(grams, at)``: the distinct grams as rows of ORDER symbols, zeros before a text, and for every
    symbol but a text's leading one the row of the gram that ends there."""
    alphabet = np.flatnonzero(np.bincount(symbols))
    number = np.zeros(int(alphabet[-1]) + 1, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    own, base = number[symbols], len(alphabet)  # symbol 0 leads every text, so its number is 0
    rows = []
    for back in range(ORDER - 1, -1, -1):
        part = own.copy()
        if back:
            part[:back] = 0
            part[back:] = np.where(doc[back:] == doc[:-back], own[:-back], 0)
        rows.append(part[~_leading(doc)])
    if base**ORDER >= 2**62:  # tens of thousands of different letters
        grams, at = np.unique(np.stack(rows, 1), axis=0, return_inverse=True)
        return alphabet[grams], at.ravel()
    code = np.zeros(len(rows[0]), np.int64)
    for part in rows:
        code = code * base + part
    if base**ORDER <= TABLE_GRAMS:
        seen = np.zeros(base**ORDER, bool)
        seen[code] = True
        codes = np.flatnonzero(seen)
        place = np.zeros(len(seen), np.int32)
        place[codes] = np.arange(len(codes))
        at = place[code]
    else:
        codes, at = np.unique(code, return_inverse=True)
    return np.stack([alphabet[codes // base ** (ORDER - 1 - k) % base] for k in range(ORDER)], 1), at


def _key(grams: np.ndarray) -> np.ndarray:
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for k in range(grams.shape[1]):
        h = mix(h * np.uint64(31) + grams[:, k].astype(np.uint64) + np.uint64(1))
    return h


def _leading(doc: np.ndarray) -> np.ndarray:
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    return first


def discounts(counts: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    n = [max(1, int((counts == k).sum())) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05)) for k in (1, 2, 3))


def fit(grams: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The arrays of one model: for each order keys and log probabilities, contexts and log back-off weights."""
    tables = [(grams, counts)]
    for n in range(ORDER - 1, 0, -1):  # lower orders count the distinct symbols before
        below, number = np.unique(tables[0][0][:, 1:], axis=0, return_counts=True)
        tables.insert(0, (below, number))
    out: list[np.ndarray] = []
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for g, c in tables:
        d = np.array([0.0, *discounts(c)])
        context, at = np.unique(_key(g[:, :-1]), return_inverse=True)
        total = np.bincount(at, c)
        back = np.bincount(at, d[np.minimum(c, 3)]) / total
        if lower is None:
            base = np.full(len(g), 1.0 / (len(g) + 1))
        else:
            base = lower[1][np.searchsorted(lower[0], _key(g[:, 1:]))]
        p = (c - d[np.minimum(c, 3)]) / total[at] + back[at] * base
        keys = _key(g)
        order = np.argsort(keys)
        lower = (keys[order], p[order])
        out += [keys[order], np.log(p[order]).astype(np.float32), context, np.log(back).astype(np.float32)]
    return out


def log_prob(model: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
    """The log probability of each row's last symbol after the others."""
    out = np.zeros(len(grams), np.float32)
    open_ = np.arange(len(grams))
    for n in range(ORDER, 0, -1):
        keys, logs, context, back = model[4 * (n - 1) : 4 * n]
        part = grams[open_, ORDER - n :]
        k = _key(part)
        i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        hit = keys[i] == k
        out[open_[hit]] += logs[i[hit]]
        open_, part = open_[~hit], part[~hit]
        if not len(open_):
            return out
        k = _key(part[:, :-1])
        i = np.minimum(np.searchsorted(context, k), len(context) - 1)
        out[open_] += np.where(context[i] == k, back[i], 0)
    out[open_] -= np.log(len(model[0]) + 1.0)
    return out


def entropies(models: list[list[np.ndarray]], raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(texts x models cross-entropy per symbol, letters or gaps per text)``; texts without a letter have 0 symbols."""
    symbols, doc = _symbols(raws)
    grams, at = _distinct(symbols, doc)
    doc = doc[~_leading(doc)]
    number = np.bincount(doc, minlength=len(raws))
    found = np.zeros((len(raws), len(models)))
    for m, model in enumerate(models if len(grams) else []):
        found[:, m] = -np.bincount(doc, log_prob(model, grams)[at], len(raws)) / np.maximum(number, 1)
    return found, number


def _logistic(margin: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(right | margin), with one success at the largest margin and one failure at none as prior."""
    x = np.concatenate([margin, [max(0.5, margin.max(initial=0.5)), 0.0]])
    y = np.concatenate([right, [1.0, 0.0]])
    X = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        w -= np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), X.T @ (p - y) + 1e-3 * w)
    return float(w[0]), float(w[1])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE_TEXTS, seed: int = 4, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """Models of every language in ``labelled`` and the calibration of their margins.

    Fits on about ``sample`` different texts of each language and about ``sample_bytes`` of them,
    chosen by a hash of the text; rows with a null text or language and texts without letters teach
    nothing, and a repeated text teaches once.  Languages that fit a text equally well tie, and the
    first by name is taken.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    once = rows.groupBy("lang", F.xxhash64("text").alias("_text")).agg(F.max(F.octet_length("text")).alias("bytes"))  # a repeated text counts once
    number = F.broadcast(once.groupBy("lang").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")))
    part = F.pmod(random_key(seed, "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(number, "lang").where((part * F.col("n") < sample) & (part * F.col("bytes") < sample_bytes)).select("lang", "text").dropDuplicates()
    chosen = saved(drawn.withColumn("apart", F.pmod(random_key(seed + 1, "text"), F.lit(CALIBRATE)) == 0), "language-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, texts in b.groupby("lang")["text"]:
                for _, _, raws in pieces(texts.tolist()):
                    g, at = _distinct(*_symbols(raws))
                    c = np.bincount(at, minlength=len(g))
                    yield pd.DataFrame({"lang": name, "count": c, **{f"s{k}": g[:, k] for k in range(ORDER)}})

    symbols = [f"s{k}" for k in range(ORDER)]
    counted = chosen.where("not apart").mapInPandas(count, "lang string, count long, " + ", ".join(f"{s} long" for s in symbols)).groupBy("lang", *symbols).agg(F.sum("count").alias("count"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = fit(pdf[symbols].to_numpy(), pdf["count"].to_numpy())
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "arrays": [[a.tobytes() for a in arrays]]})

    found = counted.groupBy("lang").applyInPandas(build, "lang string, arrays array<binary>").collect()  # bounded by the sample
    kinds = [np.uint64, np.float32, np.uint64, np.float32] * ORDER
    models = {r["lang"]: [np.frombuffer(a, k) for a, k in zip(r["arrays"], kinds, strict=True)] for r in sorted(found, key=lambda r: r["lang"])}
    names = list(models)
    held = labelled.sparkSession.sparkContext.broadcast(list(models.values()))

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j, raws in pieces(b["text"].tolist()):
                e, n = entropies(held.value, raws)
                best = e.argmin(1)
                gap = np.partition(e, 1, axis=1)[:, 1] - e.min(1) if len(names) > 1 else np.ones(len(e))
                ok = n > 0
                yield pd.DataFrame({"margin": gap[ok], "right": (np.array(names)[best] == b["lang"].to_numpy()[i:j])[ok]})

    seen = chosen.where("apart").mapInPandas(margins, "margin double, right boolean").toPandas() if models else pd.DataFrame({"margin": [], "right": []})
    slope, offset = _logistic(seen["margin"].to_numpy(float), seen["right"].to_numpy(float))
    return {"names": names, "models": list(models.values()), "slope": slope, "offset": offset}


def identify(docs: DataFrame, model: dict, text: str = "text", reject_below: float = 0.0) -> DataFrame:
    """``docs`` with lang_pred and score.  A null text, one without letters, or a score below ``reject_below`` gives ``und``; such texts without letters score 0.

    Only the text is read.  Whole texts are scored, however long.  Columns of these two names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        names = np.array([*m["names"], UNDETERMINED], object)
        for texts in batches:
            found = []
            for _, _, raws in pieces(texts.tolist()):
                if not m["names"]:
                    found.append(pd.DataFrame({"lang_pred": [UNDETERMINED] * len(raws), "score": 0.0}))
                    continue
                e, n = entropies(m["models"], raws)
                gap = np.partition(e, 1, axis=1)[:, 1] - e.min(1) if e.shape[1] > 1 else np.ones(len(e))
                score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(m["slope"] * gap + m["offset"], -30, 30))), 0.0)
                none = (n == 0) | (score < reject_below)
                found.append(pd.DataFrame({"lang_pred": names[np.where(none, len(names) - 1, e.argmin(1))], "score": score}))
            yield pd.concat(found, ignore_index=True) if found else pd.DataFrame({"lang_pred": [], "score": []})

    guess = F.pandas_udf(predict, "lang_pred string, score double")
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*own, guess(F.col(text)).alias("_guess")).select(*own, "_guess.lang_pred", "_guess.score")
