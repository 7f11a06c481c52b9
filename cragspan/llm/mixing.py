"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule sits at the golden-ratio point of i; the point, looked up in the sources'
cumulative targets, names the slot's source, so that every stretch of the schedule holds each
source in its share.  A source's documents form one shuffled stream of words, read round and
round; its slots, ranked, take equal blocks of that stream in turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragspan.llm.session import random_key, saved, shuffled_rank

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block.
BLOCK_WORDS = 1024
#: Slots of the schedule that are ranked together.
RUN_SLOTS = 4_096


def targets(sizes: dict[str | None, int], weights: list[int], most: int = 3) -> dict[str | None, Fraction]:
    """The words to take of each source: shares of all words by weight, up to ``most`` times the source's own, the excess reshared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    found: dict[str | None, Fraction] = {}
    free, rest = list(order), Fraction(sum(sizes.values()))
    while free:
        unit = rest / sum(weigh[s] for s in free)
        if not (full := [s for s in free if weigh[s] * unit > most * sizes[s]]):
            return found | {s: weigh[s] * unit for s in free}
        for s in full:
            found[s] = Fraction(most * sizes[s])
            rest -= found[s]
        free = [s for s in free if s not in found]
    return found


def schedule(spark, wanted: list[int], block: int) -> DataFrame:
    """Rows ``(slot, src, k)``: the k-th block of source ``src`` is due at ``slot``.

    The golden-ratio sequence runs over all words; where it leaves a source a block or a few
    short of its target, those blocks follow at the end, and blocks past a target are left out.
    """
    total = sum(wanted)
    slots = -(-total // block)
    edges = np.cumsum(np.array(wanted, np.float64)) / max(1, total)

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            turn = b["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            src = np.searchsorted(edges, turn.astype(np.float64) / 2.0**64, "right")
            yield pd.DataFrame({"slot": b["id"], "src": np.minimum(src, len(wanted) - 1).astype(np.int32)})

    named = spark.range(slots).mapInPandas(name, "slot long, src int")
    ranked = shuffled_rank(named, ["src"], ["slot"], 1, "k", slice_by=F.floor(F.col("slot") / RUN_SLOTS))
    have = {r[0]: r[1] for r in named.groupBy("src").count().collect()}  # one row per source, as the caller's weights
    short = [(i, have.get(i, 0), -(-w // block)) for i, w in enumerate(wanted) if have.get(i, 0) * block < w]
    late = spark.createDataFrame(short, "src int, low long, high long").select("src", F.explode(F.sequence("low", F.col("high") - 1)).alias("k"))
    return ranked.select("slot", "src", "k").union(late.select((F.lit(slots) + F.col("k")).alias("slot"), "src", "k"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = BLOCK_WORDS, seed: int = 10, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """``(spans, rows)``.  ``rows``: one row per row of ``docs`` with its size in words, its source's
    size and target, its place in the source's stream and ``key``, a hash of its text.  ``spans``:
    (slot, src, doc_id, key, size, at, epoch, first, last) - at ``slot`` the mix takes words
    first..last-1 of that row, for the epoch-th time.

    Weights repeat over the sources in code-point order, null last; a null source is a source.  A
    null or empty text has no words and is never taken.  Each source's taken words equal its target
    rounded to a whole word.  Repeated rows are rows of their own.  The table of sources (name,
    words) is held by the driver, like the weights that callers give by source; nothing else is.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("key"), random_key(seed, F.col(doc_id)).alias("_key"))
    rows = saved(rows, "mix-rows")
    per_source = {r[0]: (r[1], r[2]) for r in rows.groupBy("source").agg(F.sum("size"), F.count("*")).collect()}
    sizes = {s: v[0] for s, v in per_source.items()}
    goal = targets(sizes, list(weights), most)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = [int(goal[s] + Fraction(1, 2)) for s in order]
    known = spark.createDataFrame([(i, s, sizes[s], float(goal[s]), wanted[i]) for i, s in enumerate(order)], "src int, _source string, source_size long, target double, wanted long")
    rows = rows.join(F.broadcast(known), rows.source.eqNullSafe(F.col("_source"))).drop("_source")
    rows = saved(shuffled_rank(rows, ["src"], ["_key", "doc_id", "size", "key"], max([n for _, n in per_source.values()], default=0), "at", "size").drop("_key"), "mix-places")

    whole = F.col("source_size")
    due = schedule(spark, wanted, block).join(F.broadcast(known.drop("target", "_source")), "src")
    due = due.select("slot", "src", "source_size", (F.col("k") * block).alias("low"), F.least((F.col("k") + 1) * block, "wanted").alias("high")).where("low < high")
    due = due.withColumn("epoch", F.explode(F.sequence(F.expr("low div source_size"), F.expr("(high - 1) div source_size"))))
    due = due.select("slot", "src", "epoch", F.greatest(F.col("low") - F.col("epoch") * whole, F.lit(0)).alias("low"), F.least(F.col("high") - F.col("epoch") * whole, whole).alias("high"))
    cells = due.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {block}"), F.expr(f"(high - 1) div {block}"))))
    parts = rows.where("size > 0").select("doc_id", "key", "src", "at", "size", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("cell"))
    first = F.greatest(F.col("at"), F.col("low"), F.col("cell") * block)
    last = F.least(F.col("at") + F.col("size"), F.col("high"), (F.col("cell") + 1) * block)
    spans = parts.join(cells, ["src", "cell"]).where(first < last).select("slot", "src", "doc_id", "key", "size", "at", "epoch", (first - F.col("at")).alias("first"), (last - F.col("at")).alias("last"))
    return spans, rows


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: each document as often as the mix takes it.

    A source's stream is read from its start, so every turn takes whole documents up to the source's
    target; the one document that the target falls into comes with its words up to there, joined by
    one space.  Documents without words are never taken; rows of one id and text are alike, and come as often
    as all of them are taken.
    """
    spans, _ = mix(docs, doc_id=doc_id, text=text, source=source, **options)
    turns = spans.groupBy("doc_id", "key", "size", "src", "at", "epoch").agg(F.max("last").alias("_last"))
    turns = turns.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("size").alias("_size"), "_last")
    own = docs.withColumn("_own", F.xxhash64(F.col(text))).dropDuplicates([doc_id, "_own"])
    met = own.join(turns, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")))
    words = F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), F.col("_last").cast("int"))
    return met.withColumn(text, F.when(F.col("_last") < F.col("_size"), F.array_join(words, " ")).otherwise(F.col(text))).select(*docs.columns)


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target and taken, the words of it that the mix takes, repeats counted."""
    spans, rows = mix(docs, **options)
    sums = spans.groupBy("src", "at", "doc_id").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    sums = sums.select(F.col("src").alias("_src"), F.col("at").alias("_at"), "taken")
    same = (F.col("src") == F.col("_src")) & (F.col("at") == F.col("_at")) & (F.col("size") > 0)
    return rows.join(sums, same, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
