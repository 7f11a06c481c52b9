"""The trie of conversation prefixes, with totals of its subtrees by leaf-peeling message passing.

A node is a distinct sequence of first turns and is named by two 64-bit sums (exclusive or) of hashes of its placed
turns, so the prefixes of a conversation are running sums, whatever its length.  The nodes whose smallest member is
one conversation form a path straight down from where that conversation leaves those of smaller ids.  Totals
are passed on by paths: a path holds a counter of the paths that hang from it and have not reported; complete paths
send their totals to the node that they hang from, and go, until only the root's path finishes.  A node's subtree
is then what its path holds from it down.

No conversation is gathered: rows are sorted by ranges, and ranks and running sums are taken inside slices and then
over the slices' totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragspan.llm.session import saved, shuffled_rank

#: Members that end at a node whose ids are joined to one piece, as a power of two of consecutive ids.
PIECE_BITS = 10
#: Depths of a path that are added up together, as a power of two.
RUN_BITS = 12
#: The most turns of another conversation that ``rebuilt`` puts in front.
MOST_LENT = 5


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows ``(conv_id, slice, pos, role, name, chars)``: each turn's place from 0 in its conversation.

    Turns are ordered by ``turn``, nulls first, equal ones by role and then by the text's MD5; a null role or text is
    empty and a row with a null conv_id belongs to no conversation.  Repeated rows are turns of their own.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    name = F.md5(content.cast("binary"))
    narrow = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), name.alias("name"), F.length(content).cast("long").alias("chars")
    )
    order = ["turn", "role", "name"]
    cut = saved(narrow.repartitionByRange("conv_id", *order).withColumn("slice", F.spark_partition_id()), "trie-turns")
    return shuffled_rank(cut, ["conv_id"], order, 1, "pos", slice_by=F.col("slice")).select("conv_id", "slice", "pos", "role", "name", "chars")


def lent(conv_id: Column) -> Column:
    """How many turns ``rebuilt`` takes from another conversation: the CRC-32 of the decimal id, modulo 6."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_LENT + 1))


def rebuilt(rows: DataFrame) -> DataFrame:
    """``turns`` with the first h = ``lent`` turns of each conversation c replaced by those of c - c % 100.

    All of them if there are fewer, and none if there is no such conversation; turns of c after its first h follow.
    Adds a row without a place (``pos`` null) for every conversation, so that those left without turns are known.
    """
    base = F.col("conv_id") - F.col("conv_id") % 100
    known = rows.select("conv_id").distinct()
    heads = rows.where((F.col("conv_id") % 100 == 0) & (F.col("pos") < MOST_LENT)).select(F.col("conv_id").alias("base"), "pos", "role", "name", "chars")
    heads = saved(heads, "trie-heads")
    lends = heads.groupBy("base").agg(F.count("*").alias("most"))  # of a base at most MOST_LENT
    each = known.select("conv_id", base.alias("base"), lent(F.col("conv_id")).alias("h")).join(lends, "base", "left").withColumn("given", F.least(F.col("h"), F.coalesce("most", F.lit(0))))
    each = saved(each.select("conv_id", "base", "h", "given"), "trie-given")
    taken = each.join(heads, "base").where("pos < given").select("conv_id", F.lit(-1).alias("slice"), "pos", "role", "name", "chars")
    own = rows.where(F.col("pos") >= lent(F.col("conv_id"))).join(each.select("conv_id", "h", "given"), "conv_id")
    own = own.select("conv_id", "slice", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "role", "name", "chars")
    none = each.select("conv_id", F.lit(-2).alias("slice"), F.lit(None).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("name"), F.lit(0).cast("long").alias("chars"))
    return taken.unionByName(own).unionByName(none)


def prefixes(rows: DataFrame) -> DataFrame:
    """A row ``(conv_id, depth, k1, k2, p1, p2, chars, last)`` for every first ``depth`` turns of every conversation:
    the name (k1, k2) of the prefix and (p1, p2) of that without its last turn, and whether it is all of the conversation."""
    placed = [F.when(F.col("pos").isNotNull(), F.xxhash64(F.lit(seed), "pos", "name", "role")).otherwise(F.lit(0)).alias(k) for k, seed in (("x1", 1), ("x2", 2))]
    rows = saved(rows.select("conv_id", "slice", "pos", "chars", *placed), "trie-placed")
    total = rows.groupBy("conv_id", "slice").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"), F.max("pos").alias("upto"))
    whole = Window.partitionBy("conv_id")
    past = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = total.select("conv_id", "slice", *[F.bit_xor(f"s{k}").over(past).bitwiseXOR(F.col(f"s{k}")).alias(f"b{k}") for k in (1, 2)], F.max("upto").over(whole).alias("end"))
    inside = Window.partitionBy("conv_id", "slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.join(before, ["conv_id", "slice"]).withColumns({f"k{k}": F.bit_xor(f"x{k}").over(inside).bitwiseXOR(F.col(f"b{k}")) for k in (1, 2)})
    depth = F.coalesce(F.col("pos") + 1, F.lit(0)).cast("long")
    end = F.coalesce(F.col("end") + 1, F.lit(0)).cast("long")
    return run.select("conv_id", depth.alias("depth"), "k1", "k2", *[F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)], "chars", (depth == end).alias("last"))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's pieces in their order, comma-joined: one running hash, whatever a node's size."""
    node, state = None, None
    for b in batches:
        out = []
        for d, k1, k2, ids in zip(b["depth"].tolist(), b["k1"].tolist(), b["k2"].tolist(), b["ids"].tolist(), strict=True):
            if node == (d, k1, k2):
                state.update(b",")
            else:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (d, k1, k2), hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=["depth", "k1", "k2", "ends"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["depth", "k1", "k2", "ends"])


def _ends(found: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends)`` of nodes at which a conversation ends: the hash of the ids of those that do, ascending."""
    key = ["depth", "k1", "k2"]
    pieces = found.where("last").groupBy(*key, F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return pieces.repartition(*key).sortWithinPartitions(*key, "piece").mapInPandas(_hashed, "depth long, k1 long, k2 long, ends string")


def nodes(found: DataFrame) -> DataFrame:
    """The trie's nodes from ``prefixes``: conv_id (smallest member), depth, parent (its conv_id), n_convs, n_children, chars, ends."""
    key = ["depth", "k1", "k2"]
    made = found.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("chars").alias("chars"))
    made = saved(made, "trie-nodes")
    children = made.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    above = made.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    ends = F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))
    told = made.join(children, key, "left").join(_ends(found), key, "left").join(above, ["depth", "p1", "p2"], "left")
    return told.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "chars", ends.alias("ends"))


def _received(paths: DataFrame, most_rounds: int | None) -> DataFrame:
    """What nodes get from the paths that hang from them, ``(conv_id, depth, leaves, saved)``, by peeling ``paths(conv_id, parent, at, leaves, saved)``."""
    hung = paths.where("parent is not null").groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("left"))
    active = saved(paths.join(hung, "conv_id", "left").withColumn("left", F.coalesce("left", F.lit(0))), "trie-paths")
    sent, rounds = [], 0
    while not active.isEmpty():
        if most_rounds is not None and rounds == most_rounds:
            raise RuntimeError(f"paths hang from each other more than {most_rounds} deep")
        rounds += 1
        done = active.where("left = 0 and parent is not null")
        sent.append(done.select(F.col("parent").alias("conv_id"), F.col("at").alias("depth"), "leaves", "saved"))
        news = done.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("_told"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        rest = active.where("left > 0").join(news, "conv_id", "left")
        added = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "_leaves"), ("saved", "_saved"))]
        active = saved(rest.select("conv_id", "parent", "at", *added, (F.col("left") - F.coalesce("_told", F.lit(0))).alias("left")), "trie-paths")
    every = sent[0] if sent else paths.select("conv_id", F.col("at").alias("depth"), "leaves", "saved").limit(0)
    for s in sent[1:]:
        every = every.union(s)
    return every.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def totals(trie: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """``nodes`` with n_leaves (childless nodes of the subtree) and saved_tokens (the sum of (n_convs - 1) * chars over it)."""
    own = trie.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    own = saved(own, "trie-own")
    top = F.min(F.struct("depth", "parent"))
    paths = own.groupBy("conv_id").agg(top.alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    paths = paths.select("conv_id", F.col("top.parent").alias("parent"), (F.col("top.depth") - 1).alias("at"), "leaves", "saved")
    got = _received(saved(paths, "trie-paths"), most_rounds).withColumnsRenamed({"leaves": "_leaves", "saved": "_saved"})
    held = own.join(got, ["conv_id", "depth"], "left").withColumns({a: F.col(a) + F.coalesce(f"_{a}", F.lit(0)) for a in ("leaves", "saved")}).drop("_leaves", "_saved")
    held = saved(held.withColumn("run", F.shiftright("depth", RUN_BITS)), "trie-held")
    # a node's subtree is its path from it down: the runs below its own, and its own run from it on
    sums = held.groupBy("conv_id", "run").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select("conv_id", "run", *[(F.sum(a).over(below) - F.col(a)).alias(f"under_{a}") for a in ("l", "s")])
    down = Window.partitionBy("conv_id", "run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {out: (F.col(f"under_{u}") + F.sum(a).over(down)).cast("long") for out, u, a in (("n_leaves", "l", "leaves"), ("saved_tokens", "s", "saved"))}
    return held.join(sums, ["conv_id", "run"]).withColumns(added)


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = True, most_rounds: int | None = None) -> DataFrame:
    """One row per node of the trie of all conversations' prefixes: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    With ``rebuild``, conversations are ``rebuilt`` first.  Texts are told apart by their MD5 and prefixes by 128 bits.
    A conversation without turns is a member of the root.  Rows with a null conv_id are left out; of turns with
    the same number the lesser role goes first, then the lesser MD5 of the text.  Repeated rows are turns of their
    own.  An empty table has no node.  Rounds of peeling are at most the greatest depth plus one;
    ``most_rounds`` raises beyond it.  Other columns, whatever their names, are ignored.
    """
    rows = saved(turns(conversations, conv_id, turn, role, text), "trie-ordered")
    if not rebuild:
        none = rows.select("conv_id").distinct().select("conv_id", F.lit(-2).alias("slice"), F.lit(None).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("name"), F.lit(0).cast("long").alias("chars"))
    placed = rebuilt(rows) if rebuild else rows.unionByName(none)
    told = totals(nodes(saved(prefixes(placed), "trie-prefixes")), most_rounds)
    return told.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
