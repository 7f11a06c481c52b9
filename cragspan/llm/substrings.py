"""Substring dedup: removal of word runs of a given length that occur earlier in the corpus.

A run ("window") of 20 words is named by its minimiser, the least hash among its 6-word grams, so
equal windows meet under one key.  Consecutive windows with one minimiser form a segment, which is
shuffled once as hashes.  Segments that repeat whole are settled there.  Only segments that differ
but share a minimiser fetch their words: split by the 13 or 14 words around the minimiser, they
make the reference shards.  Each shard's segments stream in corpus order through a suffix automaton
of the segments before them; where the matching statistics reach the window length, the words go.
A shard too large for one automaton is cut into its windows instead, and the least place of each
window is found block by block and then among the blocks, so no task holds the shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragspan.llm.near_duplicates import BROADCAST_ROWS, _groups, _whole_groups
from cragspan.llm.session import saved
from cragspan.llm.words import Words, mix, pieces

WINDOW = 20
GRAM = 6
#: Segments and bytes of words that one automaton holds at most.
BLOCK = 1_000
BLOCK_BYTES = 1_000_000
_SPAN = WINDOW - GRAM  # a minimiser starts at most so far into its window
_BASE = np.uint64(0x9E3779B97F4A7C1B)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C1B, -1, 2**64))
_PLACE = np.uint64((1 << 24) - 1)
#: Windows whose least hashes are looked for at once: their places fit into the bits of _PLACE.
STRETCH = 1 << 23


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Runs:
    """Hashes of any run of words in a piece."""

    def __init__(self, words: Words) -> None:
        n = len(words.hash)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words.hash + np.uint64(5)) * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.back[first] + (last - first).astype(np.uint64))


def _least(gram: np.ndarray) -> np.ndarray:
    """The place of the least of each ``_SPAN + 1`` hashes in turn, by their leading bits, the first of equal ones."""
    low = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= _SPAN + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = _SPAN + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    return (low & _PLACE).astype(np.int64)


def segments(words: Words) -> tuple[np.ndarray, ...]:
    """``(minimiser hash, content hash, text, first window in the text, windows)`` of every segment."""
    n = len(words.hash)
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    run = _Runs(words)
    at = np.arange(n - GRAM + 1)
    gram = run(at, at + GRAM)
    windows = n - WINDOW + 1
    place = np.concatenate([_least(gram[k : min(k + STRETCH, windows) + _SPAN]) + k for k in range(0, windows, STRETCH)])
    inside = words.doc[:windows] == words.doc[WINDOW - 1 :]
    start = np.flatnonzero(inside)
    new = np.ones(len(start), bool)
    new[1:] = (place[start][1:] != place[start][:-1]) | (start[1:] != start[:-1] + 1)
    first = start[new]
    number = np.diff(np.append(np.flatnonzero(new), len(start)))
    doc = words.doc[first]
    return gram[place[first]], run(first, first + number + WINDOW - 1), doc, first - words.first[doc], number


class Automaton:
    """A suffix automaton of several sequences, grown one at a time."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _split(self, p: int, q: int, c: object) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: list) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
                continue
            new = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
            last = new

    def matches(self, sequence: list) -> Iterator[int]:
        """For each place the length of the longest run ending there that a sequence added before holds."""
        state = size = 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if (q := self.next[state].get(c)) is not None:
                state = q
                size += 1
            yield size


def _split(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of shards that one automaton holds, and those of larger shards with the number of their blocks."""
    size = fetched.groupBy(F.col("shard").alias("_shard")).agg(F.count("*").alias("_rows"), F.sum(F.octet_length("words")).alias("_bytes"))
    large = saved(size.where((F.col("_rows") > 1) & ((F.col("_rows") > BLOCK) | (F.col("_bytes") > BLOCK_BYTES))).select("_shard", F.ceil(F.col("_rows") / BLOCK).alias("blocks")), "repeats-large")
    bound = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    same = F.col("shard") == F.col("_shard")
    return fetched.join(bound, same, "left_anti"), fetched.join(bound, same).drop("_shard")


def _later_windows(rows: DataFrame) -> DataFrame:
    """``(doc_id, first, last)`` of the windows of large shards' segments that also start earlier; windows are named by 128-bit digests."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            digests, number = [], []
            for words in b["words"].tolist():
                tokens = words.split()
                number.append(len(tokens) - WINDOW + 1)
                digests += [hashlib.blake2b(b" ".join(tokens[k : k + WINDOW]), digest_size=16).digest() for k in range(number[-1])]
            row = np.repeat(np.arange(len(b)), number)
            place = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            yield pd.DataFrame({"window": digests, "doc_id": b["doc_id"].to_numpy()[row], "first": b["at"].to_numpy()[row] + place, "blocks": b["blocks"].to_numpy()[row]})

    cut = rows.mapInPandas(windows, "window binary, doc_id long, first long, blocks long")
    place = ["doc_id", "first"]  # equal places are one window of a repeated row, and tie
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    ranked = saved(cut.withColumn("_block", block).withColumn("_rank", F.rank().over(Window.partitionBy("window", "_block").orderBy(*place))), "repeats-windows")
    least = ranked.where("_rank = 1").withColumn("_rank", F.rank().over(Window.partitionBy("window").orderBy(*place)))
    return ranked.union(least).where("_rank > 1").select(*place, (F.col("first") + WINDOW).alias("last"))


def repeated(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``: rows ``(doc_id, first, last)``, runs of words whose every window of WINDOW words also starts earlier."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["doc_id"].to_numpy(np.int64)
            for i, _, raws in pieces(b["text"].tolist()):
                key, seg, doc, first, number = segments(Words(raws))
                doc = ids[i + doc]
                order = np.lexsort((first, doc, seg))  # later copies within the piece are settled here and dealt anywhere
                again = np.zeros(len(seg), bool)
                again[1:] = (seg[order][1:] == seg[order][:-1]) & (key[order][1:] == key[order][:-1])
                again[1:] &= (doc[order][1:] != doc[order][:-1]) | (first[order][1:] != first[order][:-1])
                dup = np.zeros(len(seg), bool)
                dup[order] = again
                key = np.where(dup, mix(seg + doc.astype(np.uint64) * _BASE + first.astype(np.uint64)), key)
                yield pd.DataFrame({"key": key.view(np.int64), "seg": seg.view(np.int64), "doc_id": doc, "at": (first << 6) | (number << 1) | dup})

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by key, segment and place: kind 0 a repeated segment, kind 1 a segment that shares its key with another."""
        held: tuple | None = None  # the last first-of-its-segment row, and whether it shared its key
        seen = (None, None, None, None)
        for b in batches:
            key, seg, doc, at = (b[c].to_numpy(np.int64) for c in ("key", "seg", "doc_id", "at"))
            if not len(key):
                continue
            dup = (at & 1) == 1
            out = [(np.zeros(int(dup.sum()), np.int64), key[dup], doc[dup], at[dup])]
            key, seg, doc, at = key[~dup], seg[~dup], doc[~dup], at[~dup]
            if len(key):
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])
                new[0] = (key[0], seg[0]) != seen[:2]
                origin = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
                lead_doc, lead_at = np.where(origin >= 0, doc[origin], seen[2] or 0), np.where(origin >= 0, at[origin], seen[3] or 0)
                later = ~new & ((doc != lead_doc) | ((at >> 6) != (lead_at >> 6)))  # repeated rows are the same place
                out.append((np.zeros(int(later.sum()), np.int64), key[later], doc[later], at[later]))
                seen = (key[-1], seg[-1], lead_doc[-1], lead_at[-1])
                k, d, a = key[new], doc[new], at[new]
                shared_before = np.zeros(len(k), bool)
                if held is not None:
                    k, d, a = np.insert(k, 0, held[0]), np.insert(d, 0, held[1]), np.insert(a, 0, held[2])
                    shared_before = np.insert(shared_before, 0, held[3])
                if len(k):
                    pair = k[1:] == k[:-1]
                    shared = shared_before
                    shared[1:] |= pair
                    shared[:-1] |= pair
                    held = (k[-1], d[-1], a[-1], shared[-1])
                    give = shared.copy()
                    give[-1] = False
                    out.append((np.ones(int(give.sum()), np.int64), k[give], d[give], a[give]))
            whole = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pd.DataFrame({"kind": whole[0], "key": whole[1], "doc_id": whole[2], "at": whole[3] >> 6, "windows": (whole[3] >> 1) & 31})
        if held is not None and held[3]:
            yield pd.DataFrame({"kind": [1], "key": [held[0]], "doc_id": [held[1]], "at": [held[2] >> 6], "windows": [(held[2] >> 1) & 31]})

    known = docs.where("doc_id is not null and text is not null")
    cut_up = known.mapInPandas(cut, "key long, seg long, doc_id long, at long")
    settled = cut_up.repartition("key").sortWithinPartitions("key", "seg", "doc_id", "at").mapInPandas(settle, "kind int, key long, doc_id long, at long, windows int")
    settled = saved(settled, "repeats-settled")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Splits each segment at its minimiser into windows that hold the words before it and windows that hold those after."""
        for b in batches:
            places = b["places"].tolist()
            for i, j, raws in pieces(b["text"].tolist()):
                words, rows = Words(raws), []
                if len(words.hash) < WINDOW:
                    continue
                run = _Runs(words)
                for d in range(i, j):
                    place = places[d]
                    base, count = words.first[d - i], words.count[d - i]
                    key = np.array([p["key"] for p in place], np.int64).view(np.uint64)
                    at = np.array([p["at"] for p in place], np.int64)
                    number = np.array([p["windows"] for p in place], np.int64)
                    ok = at + number + WINDOW - 1 <= count
                    key, at, number = key[ok], at[ok], number[ok]
                    if not len(key):
                        continue
                    tokens = raws[d - i].split()
                    offset = np.arange(_SPAN + 1)
                    spot = base + at[:, None] + offset[None, :]
                    match = (run(spot, spot + GRAM) == key[:, None]) & (offset[None, :] >= (number - 1)[:, None])
                    mid = at + match.argmax(1)
                    half = _SPAN // 2
                    for side, lo, hi, a, z in ((0, at, np.minimum(at + number, mid - half + 1), mid - half, mid + GRAM), (1, np.maximum(at, mid - half + 1), at + number, mid, mid + GRAM + _SPAN - half + 1)):
                        good = match.any(1) & (lo < hi)
                        shard = mix(run(base + a[good], base + z[good]) * np.uint64(2) + np.uint64(side)).view(np.int64)
                        rows += [(s, b["doc_id"].iloc[d], x, b" ".join(tokens[x : y + WINDOW - 1])) for s, x, y in zip(shard, lo[good], hi[good], strict=True)]
                if rows:
                    yield pd.DataFrame(rows, columns=["shard", "doc_id", "at", "words"])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, ["shard"]):
            ids, at, words = frame["doc_id"].to_numpy(), frame["at"].to_numpy(), frame["words"].tolist()
            out = []
            for g in _groups(frame, ["shard"]):
                if g.stop - g.start < 2:
                    continue
                automaton, met = Automaton(), set()
                for r in range(g.start, g.stop):
                    if words[r] in met:  # the same windows, later
                        if (ids[r], at[r]) != (ids[r - 1], at[r - 1]):
                            out.append((ids[r], at[r], at[r] + len(words[r].split())))
                        continue
                    met.add(words[r])
                    tokens = words[r].split()
                    out += [(ids[r], at[r] + e - WINDOW + 1, at[r] + e + 1) for e, size in enumerate(automaton.matches(tokens)) if size >= WINDOW]
                    automaton.add(tokens)
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "first", "last"])

    unsure = settled.where("kind = 1").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("key", "at", "windows")).alias("places"))
    fetched = known.join(unsure, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "places").mapInPandas(fetch, "shard long, doc_id long, at long, words binary")
    few, many = _split(saved(fetched, "repeats-fetched"))
    found = few.repartition("shard").sortWithinPartitions("shard", "doc_id", "at").mapInPandas(stream, "doc_id long, first long, last long")
    sure = settled.where("kind = 0").select("doc_id", F.col("at").alias("first"), (F.col("at") + F.col("windows") + WINDOW - 1).alias("last"))
    return sure.union(found).union(_later_windows(many))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and kept (the kept words joined by one space, UTF-8).

    Words are `[^\\x20\\x09-\\x0D]+`.  A word goes if any window of WINDOW words over it also starts
    earlier: in a smaller doc_id, or earlier in the same text.  Windows are judged on the input.
    Null texts have no words; texts of fewer words than a window keep them all.  Rows that share an
    id are one document and no earlier copies of each other; rows with a null id stay as they are.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spans = repeated(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j, raws in pieces(b["text"].tolist()):
                rows = []
                for raw, first, last in zip(raws, b["first"].iloc[i:j], b["last"].iloc[i:j], strict=True):
                    words = raw.split()
                    total = len(words)
                    if first is not None and total:
                        edge = np.zeros(total + 1, np.int64)
                        np.add.at(edge, np.minimum(np.asarray(first, np.int64), total), 1)
                        np.add.at(edge, np.minimum(np.asarray(last, np.int64), total), -1)
                        words = [w for w, gone in zip(words, np.cumsum(edge[:-1]) > 0, strict=True) if not gone]
                    rows.append((total, total - len(words), b" ".join(words)))
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].to_numpy(), **{c: [r[k] for r in rows] for k, c in enumerate(("n_words", "n_removed", "kept"))}})

    return docs.join(spans, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "first", "last").mapInPandas(drop, "doc_id long, n_words long, n_removed long, kept binary")
