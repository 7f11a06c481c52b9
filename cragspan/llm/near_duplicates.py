"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Texts with equal n-gram sets form a class and only its representative (the least id) is joined.
Bands and rows follow from the recall wanted at the threshold.  Representatives that share a band
hash and whose signatures agree are tied to the least of them (those of a very large bucket are all
tied to its least); within each component of these ties all pairs are verified on n-gram sets.

A large component is verified against its common set m, the n-grams that most members hold.  A
member x that lacks h of them and holds o others has g(x) = 5h + 4o, and 9 |x & y| - 4 (|x| + |y|) is
|m| - g(x) - g(y) + 9 |dx & dy|, with dx and dy the symmetric differences to m.  So x and y are linked
for sure if g(x) + g(y) <= |m|: such links are counted by running sums over g, without pairs.  Other
pairs need a shared difference, and meet in blocks of differences only.  Pairs live inside a task's
arrays; what tasks return is one row per document and its ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragspan.llm.session import components, saved
from cragspan.llm.words import Words, mix, pieces

NGRAM = 5
THRESHOLD = (4, 5)  # a Jaccard similarity of 4/5
#: The share of pairs at the threshold that banding must bring together, and the hashes that may be spent on it.
RECALL = 0.9999
MOST_HASHES = 128
#: Members, and n-grams of them, whose sets are compared at once; a larger group is verified against its common set.
BLOCK = 512
BLOCK_NGRAMS = 1_000_000
#: Differences to the common set that are compared at once: a pair of blocks at a time.
DELTA_BLOCK = 2_048
#: Rows of (document, component) up to which they are broadcast, and bytes of common sets.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64_000_000


def banding(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """``(bands, rows)``: the most rows for which enough bands for the recall fit into ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def signatures(raws: list[bytes], bands: int, rows: int) -> dict[str, object]:
    """For each text: number of distinct n-grams, two sums that name its n-gram set, band hashes and a byte of each minimum."""
    h, doc = Words(raws).shingles(NGRAM)
    texts = len(raws)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    n = np.bincount(doc, minlength=texts)
    held = np.flatnonzero(n)
    start = (np.cumsum(n) - n)[held]
    minima = np.zeros((texts, bands * rows), np.uint64)
    s1, s2 = np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
    if len(h):
        seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for k, seed in enumerate(seeds):
            x = h * seed
            x ^= x >> np.uint64(32)
            minima[held, k] = np.minimum.reduceat(x, start)
        s1[held], s2[held] = np.add.reduceat(mix(h), start), np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5)), start)
    band = np.full((texts, bands), 7, np.uint64)
    for k in range(rows):
        band = mix(band * np.uint64(31) + minima[:, k::rows])
    bytes_ = (mix(minima) >> np.uint64(56)).astype(np.uint8)
    return {"n": n, "s1": s1.view(np.int64), "s2": s2.view(np.int64), "bands": list(band.view(np.int64)), "bytes": [x.tobytes() for x in bytes_]}


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from sorted batches.  What is carried over is one group, whose size blocks bound."""
    left: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if left and (left[-1][keys].to_numpy()[-1] != k[0]).any():
            yield pd.concat(left, ignore_index=True)
            left = []
        if len(cuts):
            yield pd.concat([*left, b.iloc[: cuts[-1]]], ignore_index=True)
            left = [b.iloc[cuts[-1] :]]
        else:
            left.append(b)
    if left:
        yield pd.concat(left, ignore_index=True)


def _groups(frame: pd.DataFrame, keys: list[str]) -> Iterator[slice]:
    k = frame[keys].to_numpy()
    cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(k)]
    yield from map(slice, cuts[:-1], cuts[1:])


def _ties(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b among n nodes: each linked node, and the first node that its links lead to, but for those first ones."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        up[max(p, q)] = min(p, q)
    tops = np.array([top(x) for x in range(n)], np.int64)
    tied = np.flatnonzero(tops != np.arange(n))
    return tied, tops[tied]


def _in_blocks(rows: DataFrame, group: list[str], blocks: str) -> DataFrame:
    """Each row once for every pair of blocks (low, high) of its group that its own block, ``mine``, is in."""
    mine = F.pmod(F.xxhash64(*group, "id", "s"), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))
    return rows.withColumn("mine", mine).withColumn("_other", other).withColumn("low", F.least("mine", "_other")).withColumn("high", F.greatest("mine", "_other")).drop("_other")


def _pairs_due(low: int, high: int, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right members of a pair of blocks."""
    if low == high:
        every = np.arange(len(mine))
        return every, every
    return np.flatnonzero(mine == low), np.flatnonzero(mine == high)


def _node(id_: str, s: str) -> Column:
    return F.struct(F.col(id_).alias("id"), F.col(s).alias("s"))


def _edges(rows: DataFrame) -> DataFrame:
    return rows.select(_node("a", "as").alias("a"), _node("b", "bs").alias("b"))


def _fewer(ties: DataFrame) -> DataFrame:
    """Ties of the same components: each node to the least that it is tied to, and that least to the others (a few a node: bands)."""
    to = ties.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("to"))
    ends = F.array_union(F.array(F.col("a")), F.slice("to", 2, F.size("to")))
    return to.select(F.col("to")[0].alias("b"), F.explode(ends).alias("a")).select("a", "b").distinct()


def _promising(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """Ties ``(a, b)`` among representatives: whatever pair shares a band hash and agrees in its signatures is held together by them."""
    banded = reps.select("id", "s", F.posexplode("bands").alias("band", "hash"))
    shared = banded.groupBy("band", "hash").agg(F.count("*").alias("members"), F.min(_node("id", "s")).alias("least")).where("members > 1")
    met = saved(banded.join(shared, ["band", "hash"]), "near-met")
    large = met.where(F.col("members") > BLOCK).select(_node("id", "s").alias("a"), F.col("least").alias("b")).where("a <> b")
    small = met.where(F.col("members") <= BLOCK).select("id", "s", "band", "hash").join(reps.select("id", "s", "bytes"), ["id", "s"])
    least = (THRESHOLD[0] / THRESHOLD[1] - 5 * np.sqrt(0.16 / (bands * rows))) * bands * rows
    keys = ["band", "hash"]

    def promise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, keys):
            ids, s = frame["id"].to_numpy(), frame["s"].to_numpy()
            signs = np.frombuffer(b"".join(frame["bytes"]), np.uint8).reshape(len(frame), -1)
            found = [np.zeros((0, 2), np.int64)]
            for g in _groups(frame, keys):
                sign = signs[g]
                a, b = [], []
                for x in range(len(sign) - 1):
                    near = x + 1 + np.flatnonzero((sign[x + 1 :] == sign[x]).sum(1) >= least)
                    a.append(np.full(len(near), x))
                    b.append(near)
                if a:
                    found.append(np.stack(_ties(np.concatenate(a), np.concatenate(b), len(sign)), 1) + g.start)
            a, b = np.concatenate(found).T
            if len(a):
                yield pd.DataFrame({"a": ids[a], "as": s[a], "b": ids[b], "bs": s[b]})

    tied = small.repartition(*keys).sortWithinPartitions(*keys, "id", "s").mapInPandas(promise, "a long, as long, b long, bs long")
    return _fewer(large.union(_edges(tied)).distinct())


def _differences(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``sets(id, s, root, rs, copies, members, grams)`` of large components: each member's difference
    to its component's common set, in blocks of those that need pairs; and its links that are sure without."""

    def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = [np.frombuffer(x, np.int64) for x in b["grams"]]
            size = [len(x) for x in held]
            for first in range(0, len(b), 64):
                part = slice(first, first + 64)
                yield pd.DataFrame({**{c: np.repeat(b[c].to_numpy()[part], size[part]) for c in ("root", "rs", "members")}, "gram": np.concatenate(held[part])})

    grams = sets.select("root", "rs", "members", "grams").mapInPandas(exploded, "root long, rs long, members long, gram long")
    most = grams.groupBy("root", "rs", "gram").agg(F.count("*").alias("n"), F.first("members").alias("members")).where("2 * n > members")
    common = saved(most.groupBy("root", "rs").agg(F.sort_array(F.collect_list("gram")).alias("common")), "near-common")
    size = common.agg(F.sum(8 * F.size("common"))).first()[0] or 0
    bound = F.broadcast(common) if size <= BROADCAST_BYTES else common

    part, of = THRESHOLD

    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for grams, m in zip(b["grams"], b["common"], strict=True):
                m = np.asarray(m if m is not None else [], np.int64)
                delta = np.setxor1d(np.frombuffer(grams, np.int64), m, assume_unique=True)
                lacking = np.intersect1d(delta, m, assume_unique=True).size
                out.append((of * lacking + part * (len(delta) - lacking), (of - part) * len(m), len(delta), delta.tobytes()))
            yield b.drop(columns=["grams", "common", "members"]).assign(**{c: [x[k] for x in out] for k, c in enumerate(("g", "m", "d", "delta"))})

    row = "id long, s long, root long, rs long, copies long"
    deltas = saved(sets.join(bound, ["root", "rs"], "left").select("id", "s", "root", "rs", "copies", "members", "grams", "common").mapInPandas(differ, f"{row}, g long, m long, d long, delta binary"), "near-differences")
    known = deltas.groupBy("root", "rs", "m", "g").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"), F.min(_node("id", "s")).alias("least"))
    whole = Window.partitionBy("root", "rs")
    known = saved(known.withColumn("most", F.max("g").over(whole)).withColumn("centre", F.min(F.struct("g", "least")).over(whole)), "near-known")
    due = known.select("root", "rs", "g", F.col("g").alias("v"), F.lit(0).alias("asked"), "copies", "n")
    due = due.union(known.select("root", "rs", "g", (F.col("m") - F.col("g")).alias("v"), F.lit(1), F.lit(0), F.lit(0)))
    upto = whole.orderBy("v", "asked").rowsBetween(Window.unboundedPreceding, 0)
    sums = due.select("root", "rs", "g", "asked", F.sum("copies").over(upto).alias("sure"), F.sum("n").over(upto).alias("partners")).where("asked = 1").drop("asked")
    told = deltas.join(known.select("root", "rs", "g", "most", "centre").join(sums, ["root", "rs", "g"]), ["root", "rs", "g"])
    itself = 2 * F.col("g") <= F.col("m")
    tied = (F.col("g") + F.col("centre.g") <= F.col("m")) & (_node("id", "s") != F.col("centre.least"))
    to = F.when(tied, F.col("centre.least"))
    sure = told.select(F.col("id").alias("a"), F.col("s").alias("as"), to["id"].alias("b"), to["s"].alias("bs"), (F.col("sure") - F.when(itself, F.col("copies")).otherwise(0)).alias("links"), (F.col("partners") - itself.cast("int")).alias("partners"))
    unsure = told.where((F.col("g") + F.col("most") > F.col("m")) & (F.col("d") > 0))
    blocks = unsure.groupBy("root", "rs").agg(F.greatest(F.ceil(F.count("*") / DELTA_BLOCK), F.ceil(F.sum("d") / BLOCK_NGRAMS)).alias("blocks"))
    return unsure.select("id", "s", "root", "rs", "copies", "g", "m", "delta").join(blocks, ["root", "rs"]), sure


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows grouped by (root, rs, low, high): each member's links and partners across the pair of blocks, and its tie."""
    keys = ["root", "rs", "low", "high"]
    for frame in _whole_groups(batches, keys):
        out = []
        for at_ in _groups(frame, keys):
            f = frame.iloc[at_]
            copies, mine, g, m = (f[c].to_numpy() for c in ("copies", "mine", "g", "m"))
            low, high = int(f["low"].iloc[0]), int(f["high"].iloc[0])
            held = [np.frombuffer(x, np.int64) for x in f["delta"]]
            size = np.array([len(x) for x in held])
            gram, at = np.unique(np.concatenate(held), return_inverse=True)
            by_gram = np.repeat(np.arange(len(held)), size)[np.argsort(at, kind="stable")]
            begin = np.searchsorted(np.sort(at), np.arange(len(gram) + 1))
            first = np.cumsum(size) - size
            left, right = _pairs_due(low, high, mine)
            allowed = np.zeros(len(held), bool)
            allowed[right] = True
            links, partners = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x in left:
                own = at[first[x] : first[x] + size[x]]
                count = begin[own + 1] - begin[own]
                place = np.repeat(begin[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                both = np.bincount(by_gram[place], minlength=len(held))
                missing = g + g[x] - m
                ok = allowed & (missing > 0) & ((THRESHOLD[0] + THRESHOLD[1]) * both >= missing)
                if low == high:
                    ok[: x + 1] = False
                near = np.flatnonzero(ok)
                links[x] += copies[near].sum()
                partners[x] += len(near)
                links[near] += copies[x]
                partners[near] += 1
                a.append(np.full(len(near), x))
                b.append(near)
            tie = np.arange(len(held))
            tied, to = _ties(np.concatenate(a), np.concatenate(b), len(held))
            tie[tied] = to
            some, ids, s = np.flatnonzero(partners), f["id"].to_numpy(), f["s"].to_numpy()
            out.append(pd.DataFrame({"a": ids[some], "as": s[some], "b": ids[tie[some]], "bs": s[tie[some]], "links": links[some], "partners": partners[some]}))
        yield pd.concat(out, ignore_index=True)


def _classed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (a hash of its text), s1 (which names its n-gram set) and n, what ``join``
    returns of its class, and root: the (id, s) that its links lead to."""
    bands, rows = banding(THRESHOLD[0] / THRESHOLD[1])
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("key"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j, raws in pieces(b["text"].tolist()):
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[i:j], "key": b["key"].to_numpy()[i:j], **signatures(raws, bands, rows)})

    signed = saved(docs.mapInPandas(sign, "doc_id long, key long, n long, s1 long, s2 long, bands array<long>, bytes binary"), "near-signed")
    classes = saved(signed.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "near-classes")
    reps = signed.join(classes.withColumnRenamed("id", "doc_id"), ["s1", "s2", "n", "doc_id"]).dropDuplicates(["doc_id", "s1"]).select(F.col("doc_id").alias("id"), F.col("s1").alias("s"), "bands", "bytes")

    rooted = components(_promising(reps, bands, rows), "near-promising")
    rooted = rooted.select("node.id", "node.s", F.col("root.id").alias("root"), F.col("root.s").alias("rs"))
    about = saved(rooted.join(classes.select("id", F.col("s1").alias("s"), "n", "copies"), ["id", "s"]), "near-about")
    sizes = about.groupBy("root", "rs").agg(F.count("*").alias("members"), F.sum("n").alias("ngrams"))
    large = (F.col("members") > BLOCK) | (F.col("ngrams") > BLOCK_NGRAMS)
    members = saved(about.join(sizes, ["root", "rs"]).select("id", "s", "root", "rs", "copies", "members", large.alias("large")), "near-members")
    bound = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j, raws in pieces(b["text"].tolist()):
                h, doc = Words(raws).shingles(NGRAM)
                held = [np.unique(x) for x in np.split(h, np.searchsorted(doc, np.arange(1, len(raws))))]
                part = b.iloc[i:j].drop(columns="text").assign(grams=[x.tobytes() for x in held])
                yield part[part["s"].to_numpy() == np.array([mix(x).sum(dtype=np.uint64) for x in held], np.uint64).view(np.int64)]

    row = "id long, s long, root long, rs long, copies long"
    whole = docs.drop("key").join(bound, F.col("doc_id") == F.col("id")).select("id", "s", "root", "rs", "copies", "members", "large", "text")
    whole = saved(whole.mapInPandas(sets, f"{row}, members long, large boolean, grams binary").dropDuplicates(["id", "s"]), "near-sets")
    size = THRESHOLD[0] * F.octet_length("grams") / 8
    few = whole.where("not large").select("id", "s", "root", "rs", "copies", size.cast("long").alias("g"), F.lit(0).cast("long").alias("m"), F.col("grams").alias("delta"), F.lit(1).cast("long").alias("blocks"))
    many, sure = _differences(whole.where("large").drop("large"))
    keys = ["root", "rs", "low", "high"]
    met = _in_blocks(few.unionByName(many), ["root", "rs"], "blocks")
    verified = met.repartition(*keys).sortWithinPartitions(*keys, "id", "s").mapInPandas(_verify, "a long, as long, b long, bs long, links long, partners long")
    linked = saved(verified.union(sure), "near-links")
    counts = linked.groupBy(F.col("a").alias("id"), F.col("as").alias("s1")).agg(F.sum("links").alias("links"), F.sum("partners").alias("partners"))
    ties = _edges(linked.where("b is not null")).where("a <> b").distinct()
    group = components(_fewer(ties), "near-classes-of").select("node.id", F.col("node.s").alias("s1"), "root")
    of_class = classes.join(counts.join(group, ["id", "s1"], "left"), ["id", "s1"], "left").select("s1", "s2", "n", F.col("id").alias("rep"), "copies", "links", "partners", "root")
    narrow = signed.select("doc_id", "key", "s1", "s2", F.when(F.col("doc_id").isNotNull(), F.col("n")).alias("n"))
    own = F.struct(F.coalesce("rep", "doc_id").alias("id"), F.col("s1").alias("s"))
    return narrow.join(of_class, ["s1", "s2", "n"], "left").withColumn("root", F.coalesce("root", own))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the least id that links lead to), n_links (other
    documents of Jaccard similarity 0.8 or more, copies included), copy_id (the least id of an equal
    n-gram set) and n_partners (linked documents that are no copies, copies of one counted once).

    N-grams are runs of five words `[^\\x20\\x09-\\x0D]+`; a text of fewer words, but not none, is one
    n-gram.  Texts without words (null, empty) link to none and are their own class.  Repeated rows
    count as copies, also of themselves; rows that share an id but not their n-grams are documents of
    their own.  A row with a null id links to none and has no class.
    """
    found = _classed(docs, doc_id, text)
    return found.select(
        "doc_id",
        F.col("root.id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("rep", "doc_id").alias("copy_id"),
        F.coalesce("partners", F.lit(0)).cast("long").alias("n_partners"),
    )


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one of each class does: the class' least id, with the n-gram set that
    the class is named by, and among equal ones of these the text of the least hash.

    Exact repeats of that row (id and text) count as one and any of them stays.  Texts without words are
    classes of their own, one for each id and text; rows with a null id all stay.
    """
    found = _classed(docs, doc_id, text).where("doc_id is not null and (coalesce(n, 0) = 0 or (doc_id = root.id and s1 = root.s))")
    texts = found.groupBy("doc_id", "s1", F.when(F.coalesce("n", F.lit(0)) == 0, F.col("key")).alias("_word"), "key").agg(F.count("*").alias("rows"))
    kept = texts.groupBy("doc_id", "s1", "_word").agg(F.min(F.struct("key", "rows")).alias("_kept"))
    kept = saved(kept.select(F.col("doc_id").alias("_id"), "_kept.key", "_kept.rows").withColumnsRenamed({"key": "_key", "rows": "_rows"}), "near-kept")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("own"))

    def among(some: DataFrame) -> DataFrame:
        return keyed.join(some, (F.col("id") == F.col("_id")) & (F.col("own") == F.col("_key")), "left_semi")

    alone = among(kept.where("_rows = 1")).union(keyed.where("id is null")).select("row.*")
    repeated = kept.where("_rows > 1")
    if repeated.isEmpty():
        return alone
    return alone.union(among(repeated).dropDuplicates(["id", "own"]).select("row.*"))
