"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragspan.plans.storage import materialise


def components(edges: DataFrame, name: str = "components", most_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node on an edge.

    The root is the component's least node; nodes may be of any type that has an order.  Each round
    gives a node the neighbour that was drawn lowest (or itself) and merges it there: edges are
    renamed, and loops and repeated edges go, so that the tables shrink from round to round.  The
    rounds' renamings, written as they arise, are then followed from the last back to the first.
    """

    def distinct(a: Column, b: Column, of: DataFrame) -> DataFrame:
        return of.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()

    def drawn(node: str) -> Column:
        return F.struct(F.xxhash64(node).alias("draw"), F.col(node).alias("to"))

    left = materialise(distinct(F.col("a"), F.col("b"), edges), f"{name}-edges")
    merges: list[DataFrame] = []
    while not left.isEmpty():
        if len(merges) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(drawn("b")).alias("near"))
        merge = materialise(near.select("node", F.least("near", drawn("node")).getField("to").alias("to")), f"{name}-merge")
        merges.append(merge)
        one, two = merge.select(F.col("node").alias("a"), F.col("to").alias("p")), merge.select(F.col("node").alias("b"), F.col("to").alias("q"))
        left = materialise(distinct(F.col("p"), F.col("q"), left.join(one, "a").join(two, "b")), f"{name}-edges")
    if not merges:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    ends = merges.pop()
    for merge in reversed(merges):
        ends = merge.join(ends.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    ends = materialise(ends, f"{name}-ends")
    return ends.join(ends.groupBy("to").agg(F.min("node").alias("root")), "to").select("node", "root")
