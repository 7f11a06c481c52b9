"""Shared folders, written tables and exact ranks for the corpus operators, and the library's components.

Everything here is plain DataFrame work.  Intermediate tables go to the folder that the
cluster names in ``spark.checkpoint.dir``; they are whole Parquet tables, so a lost executor
costs a re-read and never a recomputation of the lineage behind them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cragspan.operators.components import components

__all__ = ["components", "new_path", "random_key", "saved", "shared_folder", "shuffled_rank"]

#: Rows (of narrow keys) that one slice of a two-level rank should hold, and how many slices a group may have.
SLICE_ROWS = 2_000
MOST_SLICES = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see.  A local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] == "local":
            folder = "file://" + tempfile.mkdtemp(prefix="cragspan-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir") + "/_cragspan"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def random_key(seed: int, *columns: Column | str) -> Column:
    """A 64-bit value that looks uniform and depends on the columns and the seed only."""
    return F.xxhash64(F.lit(seed), *columns, F.lit(seed ^ 0x5DEECE66D))


def shuffled_rank(df: DataFrame, groups: list[str], order: list[str], total: int, out: str, weight: str | None = None, slice_by: Column | None = None) -> DataFrame:
    """Adds ``out``: the 0-based place of each row in its group under a pseudo-random order.

    With ``weight``, ``out`` is the sum of the weights before the row instead.  ``order`` must
    start with a uniform 64-bit key.  Two levels keep any group from meeting in one task: the
    key's high bits cut each group into slices, the slices' totals are added up over a small
    table, and rows are ranked inside their slice only.  ``slice_by`` gives other slices, which must
    rise with the order.
    """
    slices = max(1, min(MOST_SLICES, -(-total // SLICE_ROWS)))
    cut = df.withColumn("_slice", slice_by if slice_by is not None else F.pmod(F.shiftrightunsigned(F.col(order[0]), 32), F.lit(slices)))
    amount = F.col(weight) if weight else F.lit(1)
    sums = cut.groupBy(*groups, "_slice").agg(F.sum(amount).cast("long").alias("_sum"))
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    by_group = Window.partitionBy(*groups).orderBy("_slice")
    before = sums.select(*keys, F.col("_slice").alias("_s"), (F.sum("_sum").over(by_group) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy(*groups, "_slice").orderBy(*order)
    if weight:
        place = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    else:
        place = F.row_number().over(inside) - 1
    same = F.col("_slice") == F.col("_s")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    placed = cut.withColumn("_inside", place)
    return placed.join(before, same).withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_slice", "_s", "_before", "_inside", *[f"_g{i}" for i in range(len(groups))])
