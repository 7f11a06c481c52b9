"""Materialised intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again, which ends its lineage.

    The folder is ``spark.checkpoint.dir``; only a local session without one gets a temporary folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.split("[")[0] == "local"
        folder = "file://" + tempfile.mkdtemp(prefix="cragspan-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_cragspan"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
