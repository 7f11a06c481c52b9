"""Sharding by a hypergeometric communication matrix.

Rows fall into blocks by a hash.  How many rows of each block go to each shard is drawn at once
and exactly: a multivariate hypergeometric matrix whose row sums are the block sizes and whose
column sums are the shard sizes.  Each block permutes its rows and deals them out along its row
of the matrix, and each shard permutes what it got.  The result is a uniformly random
permutation with shard sizes that differ by one at most.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragspan.llm.session import random_key, saved, shuffled_rank

#: Rows of a block, unless that made more than MOST_BLOCKS; the matrix has MOST_BLOCKS rows at most.
BLOCK_ROWS = 2_000
MOST_BLOCKS = 4_096
#: Rows of one id and text whose places may be held in one list.
FEW = 1_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows are good ones.  Past NumPy's range of 1e9 it inverts the distribution around its mode."""
    if not good or not drawn:
        return 0
    if not bad or drawn == good + bad:
        return min(good, drawn)
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    mean = drawn * good / total
    spread = math.sqrt(max(1.0, mean * (bad / total) * ((total - drawn) / max(1, total - 1))))
    low, high = max(0, drawn - bad, int(mean - 12 * spread)), min(good, drawn, int(mean + 12 * spread) + 1)
    x = np.arange(low, high, dtype=np.float64)  # log of p(x+1) / p(x)
    steps = np.log((good - x) * (drawn - x)) - np.log((x + 1) * (bad - drawn + x + 1))
    p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(p - p.max()))
    return low + int(np.searchsorted(p, rng.random() * p[-1]))


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows sum to ``blocks``, columns to ``shards``; drawn as a uniform shuffle would deal them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = [int(x) for x in shards]
    out = np.zeros((len(blocks), len(shards)), np.int64)
    for b, rows in enumerate(blocks):
        rest, rows = sum(left), int(rows)
        for k, room in enumerate(left):
            rest -= room
            out[b, k] = n = hypergeometric(rng, room, rest, rows)
            rows -= n
        left = [a - int(n) for a, n in zip(left, out[b], strict=True)]
    return out


def shard(docs: DataFrame, shards: int = 40, seed: int = 9, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes + 16), text_crc32, shard and slot.

    Shard sizes in rows differ by one at most; slots run from 0 without gaps and order a shard's
    rows at random.  A null text counts as empty.  Repeated rows are rows like any other; reruns
    agree but for which of several identical rows has which place.  An empty table gives none.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(content) + 16).cast("long").alias("size"), F.crc32(content.cast("binary")).cast("long").alias("text_crc32"))
    rows = saved(rows.withColumn("_key", random_key(seed, "doc_id")), "shard-rows")
    total = rows.count()
    n_blocks = max(1, min(MOST_BLOCKS, -(-total // BLOCK_ROWS)))
    blocked = rows.withColumn("_block", F.pmod(F.shiftrightunsigned("_key", 32), F.lit(n_blocks)).cast("int"))
    sizes = {r[0]: r[1] for r in blocked.groupBy("_block").count().collect()}  # MOST_BLOCKS rows at most
    room = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([sizes.get(b, 0) for b in range(n_blocks)], room, seed)
    dealt = rows.sparkSession.createDataFrame([(b, [int(x) for x in row]) for b, row in enumerate(np.cumsum(matrix, axis=1))], "_block int, _upto array<long>")
    placed = shuffled_rank(blocked.withColumn("_in", random_key(seed + 1, "doc_id", "text_crc32")), ["_block"], ["_in", "doc_id"], 1, "_place")
    placed = placed.join(F.broadcast(dealt), "_block").withColumn("shard", F.size(F.filter("_upto", lambda x: x <= F.col("_place"))).cast("int"))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", random_key(seed + 2, "doc_id", "text_crc32").alias("_out"))
    return shuffled_rank(placed, ["shard"], ["_out", "doc_id"], total // shards, "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def place(docs: DataFrame, shards: int = 40, seed: int = 9) -> DataFrame:
    """``docs`` with shard and slot (columns of these names are replaced).  Identical rows each get a place of their own.

    Up to FEW rows of one id and text take their places from a list; more of them are numbered in slices, as their places are.
    Rows and places are read from written tables where their numbers must agree.
    """
    content = F.coalesce("text", F.lit(""))
    keys = ["_key", "_crc", "_size"]
    kept = [c for c in docs.columns if c not in ("shard", "slot")]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", F.xxhash64("doc_id", "_crc", "_size"))

    places = keyed(shard(docs, shards, seed).withColumnsRenamed({"text_crc32": "_crc", "size": "_size"}))
    places = saved(places.select(*keys, "shard", "slot"), "shard-places")
    many = saved(places.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW), "shard-many")
    any_many = not many.isEmpty()
    of_few = places.join(many.drop("_n"), keys, "left_anti") if any_many else places
    listed = of_few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("_places"))
    own = docs.drop("shard", "slot").withColumns({"_crc": F.crc32(content.cast("binary")).cast("long"), "_size": (F.octet_length(content) + 16).cast("long")})
    own = keyed(own)
    few = own.join(many.drop("_n"), keys, "left_anti") if any_many else own
    few = few.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("_key")))
    found = few.join(listed, keys).withColumn("_place", F.element_at("_places", F.col("_nth"))).select(*kept, "_place.shard", "_place.slot")
    if not any_many:
        return found
    rest = saved(own.join(many.drop("_n"), keys, "left_semi").withColumn("_row", F.monotonically_increasing_id()), "shard-repeated")
    rest = shuffled_rank(rest, keys, ["_row"], 1, "_nth", slice_by=F.shiftrightunsigned("_row", 33))
    due = shuffled_rank(places.join(many.drop("_n"), keys, "left_semi"), keys, ["shard", "slot"], 1, "_nth", slice_by=F.col("shard"))
    return found.union(rest.join(due, [*keys, "_nth"]).select(*kept, "shard", "slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 9) -> None:
    """The documents in folders ``shard=K``, each in the order of its slots."""
    placed = place(docs, shards, seed)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
