"""Document fingerprints: a digest of improbable features.

Every 64-byte window of a text is a feature.  Windows are ranked by how rare their entropy (the
collision entropy, a function of the number of equal byte pairs) is over the whole corpus; the
windows that are the rarest of their surroundings most often go into a chain of Bloom filters,
and two chains are compared by their bit overlap beyond chance.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragspan.llm.words import mix, pieces

WINDOW = 64
#: Consecutive windows among which the rarest gains a point, and the points that select a window.
SURROUND = 64
POPULAR = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
PAIRS = WINDOW * (WINDOW - 1) // 2
#: Windows with more equal pairs (a collision entropy under two bits) carry too little to be features.
MOST_PAIRS = PAIRS // 4
#: Texts of a range of ids, which a task handles one after the other; past so many ranges, they are longer.
RANGE_BYTES = 8_000_000
SHORT_RANGES = 4_096
LONG_RANGE_BYTES = 128_000_000
#: Bytes of filters that are compared at once.
COMPARED_BYTES = 32_000_000


def _equal_pairs(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, equal pairs of the window from each byte on, text of each byte, whether the window ends in its text)``."""
    buf = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws])
    doc = np.repeat(np.arange(len(raws), dtype=np.int32), sizes)
    n = len(buf) - WINDOW + 1
    if n <= 0:
        return buf, np.zeros(0, np.int32), doc, np.zeros(0, bool)
    before, after = np.zeros(len(buf), np.uint8), np.zeros(len(buf), np.uint8)
    for d in range(1, WINDOW):
        same = (buf[d:] == buf[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    steps = np.empty(n, np.int32)
    steps[0] = before[:WINDOW].sum(dtype=np.int32)
    steps[1:] = before[WINDOW:].astype(np.int32) - after[: n - 1]
    return buf, np.cumsum(steps, dtype=np.int64).astype(np.int32), doc, doc[:n] == doc[WINDOW - 1 :]


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of each number of equal pairs, the rarest over all windows of all texts first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(PAIRS + 1, np.int64)
        for b in batches:
            for _, _, raws in pieces(b["text"].tolist()):
                _, pairs, _, inside = _equal_pairs(raws)
                total += np.bincount(pairs[inside], minlength=PAIRS + 1)
        yield pd.DataFrame({"pairs": np.flatnonzero(total), "windows": total[total > 0]})

    seen = docs.select(F.col(text).alias("text")).mapInPandas(count, "pairs int, windows long").groupBy("pairs").agg(F.sum("windows").alias("windows"))
    number = np.zeros(PAIRS + 1, np.int64)
    for r in seen.collect():  # PAIRS + 1 rows at most
        number[r["pairs"]] = r["windows"]
    rank = np.empty(PAIRS + 1, np.uint64)
    rank[np.lexsort((np.arange(PAIRS + 1), number))] = np.arange(PAIRS + 1, dtype=np.uint64)
    rank[MOST_PAIRS + 1 :] = PAIRS + 1
    return rank


def digests(raws: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """A chain of filters (rows of bytes) for each text.  A text shorter than a window is its own only feature; an empty text has none."""
    buf, pairs, doc, inside = _equal_pairs(raws)
    n, texts = len(pairs), len(raws)
    number, feature, owner = np.uint64(PAIRS + 2), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n:
        key = (np.where(inside, rank[pairs], number) << np.uint64(40)) | np.arange(n, dtype=np.uint64)
        low, width = key, 1
        while width < SURROUND and len(low) > width:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        place = (1 << 40) - 1
        points = np.zeros(n, np.int64)
        if width == SURROUND:
            whole = inside[: len(low)] & inside[SURROUND - 1 :][: len(low)] & (doc[: len(low)] == doc[SURROUND - 1 :][: len(low)])
            points = np.bincount((low[whole] & np.uint64(place)).astype(np.int64), minlength=n)
        fine = (key >> np.uint64(40)) <= np.uint64(PAIRS)
        chosen = (points >= POPULAR) & fine
        starts = np.flatnonzero(inside & np.concatenate([[True], (doc[1:n] != doc[: n - 1])]))  # a text's first window
        bare = starts[np.bincount(doc[:n][chosen], minlength=texts)[doc[starts]] == 0]
        if len(bare):  # too short or too plain to select any: the rarest one
            least = np.minimum.reduceat(key, starts) & np.uint64(place)
            chosen[least[np.searchsorted(starts, bare)].astype(np.int64)] = True
        at = np.flatnonzero(chosen)
        rows = np.ascontiguousarray(buf[at[:, None] + np.arange(WINDOW)]).view(np.uint64)
        feature = np.full(len(at), 1, np.uint64)
        for k in range(rows.shape[1]):
            feature = mix(feature * np.uint64(31) + rows[:, k])
        owner = doc[at].astype(np.int64)
    short = [i for i, r in enumerate(raws) if 0 < len(r) < WINDOW]
    if short:
        whole_text = [int.from_bytes(raws[i].ljust(WINDOW, b"\0"), "little") for i in short]
        extra = np.full(len(short), 2, np.uint64)
        for k in range(WINDOW // 8):
            extra = mix(extra * np.uint64(31) + np.array([(v >> (64 * k)) & (2**64 - 1) for v in whole_text], np.uint64))
        feature, owner = np.concatenate([feature, extra]), np.concatenate([owner, short])
    order = np.lexsort((np.arange(len(feature)), feature, owner))  # a repeated feature counts where it first stands
    first = np.ones(len(order), bool)
    first[1:] = (feature[order][1:] != feature[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    keep = np.sort(order[first]) if not short else order[first]
    feature, owner = feature[keep], owner[keep]
    by_text = np.argsort(owner, kind="stable")
    feature, owner = feature[by_text], owner[by_text]
    count = np.bincount(owner, minlength=texts)
    chains = -(-count // FILTER_FEATURES)
    base = np.cumsum(chains) - chains
    filter_ = base[owner] + (np.arange(len(owner)) - (np.cumsum(count) - count)[owner]) // FILTER_FEATURES
    bits = np.zeros((int(chains.sum()), FILTER_BITS), np.uint8)
    for k in range(HASHES):
        bits[filter_, ((feature >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[b : b + c] for b, c in zip(base, chains, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: for each filter of the shorter chain its best overlap beyond chance, averaged.  Equal chains have 1, one empty chain 0."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    set_a, set_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    rows, best = max(1, COMPARED_BYTES // b.nbytes), []
    for first in range(0, len(a), rows):
        some, own = a[first : first + rows], set_a[first : first + rows, None]
        both = np.bitwise_count(some[:, None, :] & b[None, :, :]).sum(2, dtype=np.int64)
        chance = own * set_b[None, :] / FILTER_BITS
        best.append(np.clip((both - chance) / np.maximum(np.minimum(own, set_b[None, :]) - chance, 1e-9), 0, 1).max(1))
    return float(np.concatenate(best).mean())


def as_text(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def _neighbours(docs: DataFrame, size: int) -> DataFrame:
    """``docs(doc_id, text)`` cut into ranges of ids; rows ``(range, tail, doc_id, text)`` where the
    first document of each range also follows, as ``tail``, the range before it in descending order."""
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = int(max(parts, min(SHORT_RANGES, size / RANGE_BYTES), size / LONG_RANGE_BYTES))
    cuts = np.unique(np.array(docs.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges), np.int64))

    def place(ids: pd.Series) -> pd.Series:
        found = -np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(ids.isna(), 1, found).astype(np.int32))

    placed = docs.withColumn("range", F.pandas_udf(place, "int")("doc_id"))
    heads = sorted((r[0], r[1]) for r in placed.groupBy("range").agg(F.max("doc_id")).collect())  # a row per range
    before = [(r, i, heads[k - 1][0]) for k, (r, i) in enumerate(heads)]
    head = F.broadcast(spark.createDataFrame(before, "_range int, _id long, _before int"))
    joined = placed.join(head, (F.col("range") == F.col("_range")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    own = F.struct(F.col("range"), F.lit(False).alias("tail"))
    also = F.struct(F.col("_before").alias("range"), F.lit(True).alias("tail"))
    spread = joined.withColumn("_to", F.explode(F.when(F.col("_before").isNotNull(), F.array(own, also)).otherwise(F.array(own))))
    return spread.select("_to.range", "_to.tail", "doc_id", "text")


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (the last half of its code points replaced by
    the first as many of the next document in descending order of ids), and their likenesses.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    After the last document comes the first; a lone document follows itself.  Null texts are empty;
    empty texts have an empty fingerprint, like only to another.  Rows that share an id follow each
    other by their text; a null id comes last.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rank = rarity(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def fingerprint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        left: pd.DataFrame | None = None

        def out(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """All rows but the last, each of which has its next document behind it."""
            texts = rows["text"].tolist()
            first = 0
            while first < len(texts) - 1:
                last, held = first + 1, len(texts[first])
                while last < len(texts) - 1 and held < 2_000_000:
                    held += len(texts[last])
                    last += 1
                own = texts[first : last + 1]
                edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(own[:-1], own[1:], strict=True)]
                raws = [t.encode() for t in own + edited]
                chains = digests(raws, rank)
                n = len(own) - 1
                part = rows.iloc[first:last]
                keep = ~part["tail"].to_numpy(bool)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "n_chars": [len(t) for t in own[:-1]], "edited_sha256": [hashlib.sha256(r).hexdigest() for r in raws[n + 1 :]],
                    "fingerprint": [as_text(c) for c in chains[:n]], "edited_fingerprint": [as_text(c) for c in chains[n + 1 :]],
                    "near_edited": [likeness(a, b) for a, b in zip(chains[:n], chains[n + 1 :], strict=True)], "near_next": [likeness(a, b) for a, b in zip(chains[:n], chains[1 : n + 1], strict=True)],
                })[keep]
                first = last

        for b in batches:
            rows = b if left is None else pd.concat([left, b], ignore_index=True)
            yield from out(rows)
            left = rows.tail(1)

    ordered = _neighbours(docs, size).repartition("range").sortWithinPartitions("range", "tail", F.desc_nulls_last("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInPandas(fingerprint, schema)
