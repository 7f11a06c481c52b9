"""SimHash near-duplicates by BK-trees.

A document's fingerprint has a bit where more than half of its shingles' hashes do.  Fingerprints at most
``RADIUS`` bits apart are linked.  Two such fingerprints agree in all but RADIUS of some blocks of bits, so
each fingerprint is a member of one bucket for every choice of the blocks that agree, and only members of one
bucket are compared: a BK-tree of the bucket, children keyed by their Hamming distance to the parent, is
searched along the edges within the radius.

What stands below an edge of at most RADIUS is linked to the parent.  A search that meets a node within the
radius therefore leaves those edges out: the node speaks for them, and large groups of near copies cost
about their size.  Links are returned as ties that hold the same components together, not as all pairs.

A bucket is dealt to a task, which grows its tree and searches it.  Buckets of more than ``SHARD`` members
are cut into shards; their trees, of bounded size, are broadcast a bounded group at a time, and all members
of such buckets are streamed past.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cragspan.llm.near_duplicates import _whole_groups
from cragspan.llm.session import components, saved
from cragspan.llm.words import pieces

WORDS = 4
RADIUS = 4
SEED = 42
BITS = 64
#: Fingerprints in a bucket that one tree holds; a larger bucket is cut into shards.
SHARD = 4_096
#: Fingerprints that a bucket should hold in the mean.
MEAN_BUCKET = 256
#: Bytes of shard trees that are broadcast at once.
BROADCAST_BYTES = 64_000_000
#: Hashes whose bits are unpacked at once.
UNPACKED = 65_536
#: Visits of nodes that a search holds at once.
VISITS = 250_000

#: A-Z become a-z, and what separates words.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _spaced(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text joined by single spaces, and the first and last+1 byte of each."""
    buf = _LOWER[np.frombuffer(raw, np.uint8)]
    gap = _SPACE[buf]
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    buf, gap = np.where(gap[keep], 32, buf[keep]).astype(np.uint8), gap[keep]
    if len(gap) and gap[0]:
        buf, gap = buf[1:], gap[1:]
    if len(gap) and gap[-1]:
        buf, gap = buf[:-1], gap[:-1]
    if not len(buf):
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(gap)
    return buf.tobytes(), np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(buf)]])


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    """The fingerprint of a text: a bit is 1 if over half of its shingles' XXH64 have it; without words it is 0."""
    text, first, last = _spaced(raw)
    n = len(first) - words + 1
    if not len(first):
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(text, SEED)
    digest, view = xxhash.xxh64_intdigest, memoryview(text)
    held = np.zeros(BITS, np.int64)
    for at in range(0, n, UNPACKED):
        upto = min(n, at + UNPACKED)
        h = [digest(view[a:b], SEED) for a, b in zip(first[at:upto].tolist(), last[at + words - 1 : upto + words - 1].tolist(), strict=True)]
        held += np.unpackbits(np.array(h, ">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * held > n).tobytes(), "big")


def blocks_for(fingerprints: int, radius: int = RADIUS, mean: int = MEAN_BUCKET) -> int:
    """The fewest blocks of which those that must agree, all but ``radius``, leave ``mean`` fingerprints to a bucket."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if fingerprints >> (BITS * (blocks - radius) // blocks) <= mean:
            return blocks
    return 2 * radius


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """For every choice of ``blocks - radius`` of the blocks of 64 bits, the bits in it."""
    ends = [BITS * k // blocks for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(ends)]
    return [sum(some) for some in itertools.combinations(block, blocks - radius)]


class Forest:
    """BK-trees over groups of fingerprints, as arrays.

    ``fp`` holds the nodes, ``root`` the node each group starts from; the node at place i of ``child`` hangs from node
    ``key[i] // 65`` at distance ``key[i] % 65``, and ``key`` is sorted.  Equal fingerprints hang at distance 0.
    ``ties`` lists the pairs of a node and a node above it within the radius that the building met.
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> None:
        self.fp = fp
        todo, at = np.arange(len(fp)), group.astype(np.int64)
        parent, edge = np.full(len(fp), -1, np.int64), np.zeros(len(fp), np.int64)
        keys, children, ties = [], [], [np.zeros((0, 2), np.int64)]
        self.root: dict[int, int] = {}
        while len(todo):  # one level of all trees at a time: the first of each set becomes its node
            _, first, of = np.unique(at, return_index=True, return_inverse=True)
            head = todo[first]
            if not keys and not self.root:
                self.root = dict(zip(at[first].tolist(), head.tolist(), strict=True))
            else:
                keys.append(parent[head] * (BITS + 1) + edge[head])
                children.append(head)
            mine = head[of]
            rest = todo != mine
            todo, mine = todo[rest], mine[rest]
            d = np.bitwise_count(fp[todo] ^ fp[mine]).astype(np.int64)
            near = d <= radius
            ties.append(np.stack([todo[near], mine[near]], 1))
            parent[todo], edge[todo] = mine, d
            at = mine * (BITS + 1) + d
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], np.concatenate([np.zeros(0, np.int64), *children])[order]
        self.ties = np.concatenate(ties)

    def near(self, fp: np.ndarray, node: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(query, node)`` within the radius for searches of ``fp[i]`` from node ``node[i]`` down, enough of them to
        hold the components together: below a node that is met, edges within the radius are left out."""
        stack = [(np.arange(len(fp)), node)]
        while stack:
            q, v = stack.pop()
            if len(q) > VISITS:
                stack += [(q[k : k + VISITS], v[k : k + VISITS]) for k in range(0, len(q), VISITS)]
                continue
            d = np.bitwise_count(fp[q] ^ self.fp[v]).astype(np.int64)
            met = d <= radius
            yield q[met], v[met]
            low = np.where(met, radius + 1, d - radius)
            a = np.searchsorted(self.key, v * (BITS + 1) + np.maximum(low, 0))
            b = np.searchsorted(self.key, v * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            n = b - a
            if n.any():
                q = np.repeat(q, n)
                stack.append((q, self.child[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(len(q))]))


def _ties(pairs: list[np.ndarray], fp: np.ndarray) -> pd.DataFrame:
    """Links among ``fp`` as (a, b): every linked fingerprint to the least-placed one that its links lead to here."""
    both = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
    up = np.arange(len(fp))
    while len(both):  # hook the larger top to the smaller, then shorten all paths
        a, b = up[both[:, 0]], up[both[:, 1]]
        both = both[a != b]
        a, b = a[a != b], b[a != b]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    tied = np.flatnonzero(up != np.arange(len(fp)))
    return pd.DataFrame({"a": fp.view(np.int64)[tied], "b": fp.view(np.int64)[up[tied]]})


def _search_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trees and searches of whole buckets, as many at once as a batch holds."""
    for frame in _whole_groups(batches, ["mask", "bucket"]):
        k = frame[["mask", "bucket"]].to_numpy()
        group = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(1))])
        fp = frame["fp"].to_numpy().view(np.uint64)
        trees = Forest(fp, group)
        start = np.array([trees.root[g] for g in group.tolist()], np.int64)
        yield _ties([trees.ties, *(np.stack(x, 1) for x in trees.near(fp, start))], fp)


def _shard_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tree of each shard as arrays in a row, with the ties that growing it met."""
    for frame in _whole_groups(batches, ["mask", "bucket", "shard"]):
        for (mask, bucket, _), one in frame.groupby(["mask", "bucket", "shard"], sort=False):
            fp = one["fp"].to_numpy().view(np.uint64)
            tree = Forest(fp, np.zeros(len(fp), np.int64))
            ties = _ties([tree.ties], fp)
            yield pd.DataFrame({"mask": [mask], "bucket": [bucket], "fp": [fp.tobytes()], "key": [tree.key.tobytes()], "child": [tree.child.tobytes()], "root": [tree.root[0]], "a": [ties["a"].tolist()], "b": [ties["b"].tolist()]})


def _pairs(spark: SparkSession, large: DataFrame) -> DataFrame:
    """Ties within the large buckets ``(mask, bucket, shard, fp)``: shard trees, broadcast group by group."""
    keys = ["mask", "bucket", "shard"]
    trees = large.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInPandas(_shard_trees, "mask int, bucket long, fp binary, key binary, child binary, root long, a array<long>, b array<long>")
    size = F.octet_length("fp") + F.octet_length("key") + F.octet_length("child")
    trees = saved(trees.withColumn("size", size.cast("long")), "simhash-trees")
    found = trees.select(F.explode(F.arrays_zip("a", "b")).alias("t")).select("t.a", "t.b")
    groups = -(-2 * trees.agg(F.sum("size")).first()[0] // BROADCAST_BYTES)
    group = F.pmod(F.xxhash64("mask", "bucket"), F.lit(groups))
    for g in range(groups):
        queries, held, weight = large.where(group == g).select("mask", "bucket", "fp"), [], 0
        for r in trees.where(group == g).drop("a", "b").toLocalIterator():
            if held and weight + r["size"] > BROADCAST_BYTES:  # a bucket's shards may pass the bound: they come in turns
                found, held, weight = found.union(_streamed(spark, queries, held)), [], 0
            held.append(r)
            weight += r["size"]
        found = found.union(_streamed(spark, queries, held)) if held else found
    return found


def _streamed(spark: SparkSession, queries: DataFrame, rows: list) -> DataFrame:
    """Members of the buckets of ``rows`` streamed past these shard trees, which are broadcast."""
    at: dict[tuple[int, int], list] = {}
    for r in rows:
        at.setdefault((r["mask"], r["bucket"]), []).append((bytes(r["fp"]), bytes(r["key"]), bytes(r["child"]), r["root"]))
    sent = spark.sparkContext.broadcast(at)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, one in b.groupby(["mask", "bucket"], sort=False):
                own = one["fp"].to_numpy().view(np.uint64)
                for fp, key, child, root in sent.value.get(where, []):
                    tree = Forest.__new__(Forest)
                    tree.fp, tree.key, tree.child = np.frombuffer(fp, np.uint64), np.frombuffer(key, np.int64), np.frombuffer(child, np.int64)
                    pairs = [np.stack([q, v + len(own)], 1) for q, v in tree.near(own, np.full(len(own), root, np.int64))]
                    ties = _ties(pairs, np.concatenate([own, tree.fp]))
                    yield ties[ties["a"] != ties["b"]]

    return saved(queries.mapInPandas(search, "a long, b long"), "simhash-large")


def _keyed(prints: DataFrame, blocks: int) -> DataFrame:
    """Each fingerprint once for every choice of blocks: ``(mask, bucket, fp)``."""
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks(blocks)]
    each = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("mask", "bucket")
    return prints.select("fp", each).select("mask", "bucket", "fp")


def links(prints: DataFrame, blocks: int | None = None) -> DataFrame:
    """Ties ``(a, b)`` among distinct fingerprints ``prints(fp)``: they lead from one to the other where links do."""
    spark = prints.sparkSession
    blocks = blocks or blocks_for(prints.count())
    keyed = _keyed(prints, blocks)
    sizes = keyed.groupBy("mask", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = saved(sizes, "simhash-buckets")
    small, large = sizes.where(F.col("n") <= SHARD).drop("n"), sizes.where(F.col("n") > SHARD)
    met = keyed.join(small, ["mask", "bucket"])
    ties = met.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket", "fp").mapInPandas(_search_buckets, "a long, b long")
    ties = saved(ties, "simhash-ties")
    if not large.isEmpty():
        shard = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / SHARD)).cast("int")
        ties = ties.union(_pairs(spark, saved(keyed.join(large, ["mask", "bucket"]).select("mask", "bucket", shard.alias("shard"), "fp"), "simhash-members")))
    return ties.where("a <> b").distinct()


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits) and component_id, the least
    doc_id that links lead to, its own included.

    A-Z count as a-z; words are ``[^\\x20\\x09-\\x0D]+``; shingles are runs of ``words`` of them joined by a space, repeats
    included, and a text of fewer is one shingle.  A bit that exactly half of the hashes have is 0.  Null and empty
    texts have no words and fingerprint 0, which links like any other.  Rows that share an id, and repeated rows, are
    rows of their own; a row with a null id links like any other, and a component of such rows alone has a null id.
    An empty table gives none.  Other columns, whatever their names, are ignored.
    """

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [fingerprint(raw, words) for _, _, raws in pieces(texts.tolist()) for raw in raws]
            yield pd.Series(np.array(found, np.uint64).view(np.int64))

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.pandas_udf(sign, "long")(F.col(text)).alias("fp"))
    signed = saved(own, "simhash-signed")
    prints = saved(signed.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-prints")
    rooted = components(links(prints.select("fp")), "simhash-components").withColumnRenamed("node", "fp")
    told = saved(prints.join(rooted, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    least = told.groupBy("root").agg(F.min("id").alias("component_id"))
    named = told.join(least, "root").select("fp", "component_id")
    return signed.join(named, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")
