"""Shingles of batches of any number of words against a plain version."""

import itertools

import numpy as np
import pytest

from cragspan.llm.words import Words


@pytest.mark.parametrize("n", [1, 4, 5])
def test_every_total_from_none_to_two_runs(n):
    for total in range(2 * n + 1):
        for cuts in itertools.product([0, total // 3, total // 2, total], repeat=2):
            ends = [0, *sorted(cuts), total]
            texts = [[f"w{k % 4}" for k in range(a, b)] for a, b in itertools.pairwise(ends)]
            h, doc = Words([" ".join(t).encode() for t in texts]).shingles(n)
            want = [(d, tuple(run)) for d, t in enumerate(texts) for run in ([t] if 0 < len(t) < n else [t[i : i + n] for i in range(len(t) - n + 1)])]
            assert doc.tolist() == [d for d, _ in want]
            names = {}
            assert all(names.setdefault(run, x) == x for (_, run), x in zip(want, h.tolist(), strict=True))
            assert len(set(names.values())) == len(names) and h.dtype == np.uint64
