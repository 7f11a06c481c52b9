"""Exact order statistics and exact samples without a task that holds or sorts the table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from cragspan.plans.storage import materialise

#: Parts into which an interval of values is cut in each pass.
PARTS = 1_024
#: Rows whose order one task settles.
BUCKET_ROWS = 100_000


def _values(table: DataFrame, column: str) -> tuple[DataFrame, Row]:
    """The values ``v`` that are neither null nor NaN, and of the finite ones the ends, with the numbers of all, of -inf and of +inf."""
    values = table.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    known = values.agg(F.min(finite).alias("low"), F.max(finite).alias("high"), F.count("*").alias("n"), F.count_if(F.col("v") == float("-inf")).alias("below"), F.count_if(F.col("v") == float("inf")).alias("above"))
    return values, known.first()


def _found(values: DataFrame, known: Row, ranks: list[int]) -> dict[int, float]:
    if any(not 0 <= r < known["n"] for r in ranks):
        raise ValueError("a rank is out of range")
    found = {r: float("-inf") for r in ranks if r < known["below"]} | {r: float("inf") for r in ranks if r >= known["n"] - known["above"]}
    rest = sorted(set(ranks) - set(found))
    if not rest:
        return found
    todo = {(known["low"], known["high"], known["below"], known["n"] - known["below"] - known["above"]): rest}
    values = values.where(F.abs("v") < float("inf"))
    if known["n"] > BUCKET_ROWS:
        values = materialise(values, "ranks")

    def inside(some: list[tuple]) -> DataFrame:
        each = [F.struct(F.lit(k).alias("k"), F.lit(low).alias("low"), F.lit(high).alias("high")) for k, (low, high, *_) in enumerate(some)]
        return values.withColumn("i", F.explode(F.filter(F.array(*each), lambda s: F.col("v").between(s["low"], s["high"])))).select("v", "i.*")

    while todo:
        few = [t for t in todo if t[3] <= BUCKET_ROWS]
        if few:
            placed = inside(few).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("v")))
            due = [F.struct(F.lit(k).alias("k"), F.lit(w - t[2] + 1).alias("r")) for k, t in enumerate(few) for w in todo[t]]
            for k, r, v in placed.where(F.struct("k", "r").isin(*due)).select("k", "r", "v").collect():  # a row a rank
                found[few[k][2] + r - 1] = v
        many = [t for t in todo if t[3] > BUCKET_ROWS]
        following: dict[tuple, list[int]] = {}
        if many:
            share = F.try_divide(F.col("v") / PARTS - F.col("low") / PARTS, F.col("high") / PARTS - F.col("low") / PARTS)
            part = F.coalesce(F.least(F.floor(share * PARTS), F.lit(PARTS - 1)), F.lit(0))
            counted = inside(many).groupBy("k", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k", "part").collect()
            for k, t in enumerate(many):
                before = t[2]
                for r in (r for r in counted if r["k"] == k):
                    for w in (w for w in todo[t] if before <= w < before + r["n"]):
                        if w == before or r["lo"] == r["hi"]:
                            found[w] = r["lo"]
                        elif w == before + r["n"] - 1:
                            found[w] = r["hi"]
                        else:
                            following.setdefault((r["lo"], r["hi"], before, r["n"]), []).append(w)
                    before += r["n"]
            if set(following) & set(many):
                raise ArithmeticError("the values lie too close together to be told apart by 64 bits")
        todo = following
    return found


def order_statistics(table: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at ``ranks`` (from 0) of a numeric column, nulls and NaN left out; infinite values stand at the ends.

    A pass counts the values of PARTS equal parts of the intervals that hold a wanted rank, with every part's least
    and greatest value, and the next one looks at these parts alone.  Intervals of at most BUCKET_ROWS values are
    sorted, so a thousand times more values take a pass more.  At most PARTS rows a rank reach the driver.
    """
    values, known = _values(table, column)
    return _found(values, known, ranks)


def quantiles(table: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbouring values; nulls for an empty column."""
    values, known = _values(table, column)
    if not known["n"]:
        return [None] * len(shares)
    at = [s * (known["n"] - 1) for s in shares]
    value = _found(values, known, [f(a) for a in at for f in (math.floor, math.ceil)])
    low, high = [[value[f(a)] for a in at] for f in (math.floor, math.ceil)]
    return [x if x == y else x + (y - x) * (a - math.floor(a)) for a, x, y in zip(at, low, high, strict=True)]


def least_hashes(table: DataFrame, key: str, wanted: int, seed: int) -> DataFrame:
    """Exactly ``wanted`` rows (or all): those of the least hashes of ``key``, equal hashes by key.

    Counts by the hash's leading bits name the bucket where the number is reached; buckets below it come whole, and only that one is sorted.
    """
    hashed = table.withColumn("_h", F.xxhash64(key, F.lit(seed)))
    total = table.count()
    if wanted >= total:
        return table
    bits = min(16, max(1, math.ceil(total / BUCKET_ROWS)).bit_length())
    bucket = F.shiftrightunsigned(F.col("_h"), 64 - bits)
    low = hashed.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    before, cut = 0, None
    for r in low.orderBy("b").toLocalIterator():
        if before + r["n"] >= wanted:
            cut = r["b"]
            break
        before += r["n"]
    last = hashed.where(bucket == cut).orderBy("_h", key).limit(wanted - before)
    return hashed.where(bucket < cut).union(last).drop("_h")
