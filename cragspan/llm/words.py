"""Word and shingle arithmetic on whole batches of texts with NumPy.

Used inside Arrow batches of Spark tasks only.  A batch is cut into pieces of a few MB, so the
working arrays stay small however long the texts are; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text whose arrays are held at once (a longer text stands alone).
PIECE_BYTES = 4_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[48:58] = _NOT_ALNUM[97:123] = _NOT_ALNUM[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240101)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C1B)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pieces(texts: Sequence[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs ``(first, last+1, encoded texts)`` of about PIECE_BYTES; nulls count as empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if held and size + len(raw) > PIECE_BYTES:
            yield first, i, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, first + len(held), held


class Words:
    """The words of some texts: ``hash`` (uint64) and ``doc`` of each word, ``first`` word and ``count`` of each text."""

    def __init__(self, raws: list[bytes], lower: bool = False, alnum: bool = False) -> None:
        buf = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        if lower:
            buf = _LOWER[buf]
        gap = (_NOT_ALNUM if alnum else _SPACE)[buf]
        begins = ~gap
        begins[1:] &= gap[:-1]
        starts = np.flatnonzero(begins)
        ends = np.cumsum([len(r) + 1 for r in raws])
        self.count = np.diff(np.searchsorted(starts, ends), prepend=0)
        self.first = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(len(raws)), self.count)
        if not len(starts):
            self.hash = np.zeros(0, np.uint64)
            return
        word = np.cumsum(begins, dtype=np.int32) - 1
        place = np.arange(len(buf), dtype=np.int32) - starts.astype(np.int32)[np.maximum(word, 0)]
        place[gap] = 0
        powers = np.full(int(place.max()) + 1, _STEP, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        part = _BYTE[buf] * powers[place]
        part[gap] = 0
        self.hash = mix(np.add.reduceat(part, starts))

    def shingles(self, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """``(hash, doc)`` of every run of n words; with ``short``, a text of fewer words but not none is one run."""
        h, total = self.hash, len(self.hash)
        out = np.zeros(max(0, total - n + 1), np.uint64)
        for k in range(n if len(out) else 0):  # no run fits into fewer than n words
            out += mix(h[k : k + len(out)] + np.uint64(k + 1))
        ok = self.doc[: len(out)] == self.doc[n - 1 :] if len(out) else np.zeros(0, bool)
        out, doc = mix(out[ok]), self.doc[: len(ok)][ok]
        if short and (few := np.flatnonzero((self.count > 0) & (self.count < n))).size:
            whole = np.array([np.bitwise_xor.reduce(mix(h[a : a + c] + np.arange(1, c + 1, dtype=np.uint64))) for a, c in zip(self.first[few], self.count[few], strict=True)], np.uint64)
            out, doc = np.concatenate([out, mix(whole + np.uint64(77))]), np.concatenate([doc, few])
            order = np.argsort(doc, kind="stable")
            out, doc = out[order], doc[order]
        return out, doc
