"""Exact ranks: infinite values, NaN, repeats, and intervals that are cut before they are sorted."""

import math
import random

import numpy as np
import pytest

from cragspan.operators import ranks


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


@pytest.mark.parametrize("bucket", [100_000, 40])
def test_quantiles(spark, monkeypatch, bucket):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", bucket)
    r = random.Random(3)
    values = [r.gauss(0, 1) for _ in range(1500)] + [7.5] * 600 + [1e308, -1e308, 5e-324]
    shares = [0.0, 0.05, 0.25, 0.5, 0.7, 0.95, 1.0]
    got = ranks.quantiles(table(spark, [*values, None, math.nan]), "v", shares)
    assert np.allclose(got, np.quantile(values, shares), rtol=1e-12)


def test_infinite_values_end(spark):
    values = [float(k) for k in range(5000)] + [math.inf, -math.inf, math.nan]
    got = ranks.quantiles(table(spark, values), "v", [0.0, 0.5, 1.0])
    assert got == [-math.inf, 2499.5, math.inf]
    assert ranks.quantiles(table(spark, [math.inf] * 3), "v", [0.5]) == [math.inf]
    assert ranks.quantiles(table(spark, [None, math.nan]), "v", [0.5]) == [None]
    with pytest.raises(ValueError):
        ranks.order_statistics(table(spark, values), "v", [5002])
