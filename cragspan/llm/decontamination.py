"""Benchmark decontamination: a prefix-filtered set join, native DataFrame operations only.

Every item is cut into windows of ``window`` consecutive words.  A window is a set of placed
shingles (``GRAM`` words each), and a document contains it only if it contains all of them, so
one shingle is a sufficient prefix: the window's rarest.  Shingles are ranked by how often they
occur in the documents; documents join on the prefix shingle, the length bound and the
positional bound discard what can't fit, and the rest is verified shingle by shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragspan.llm.session import saved

#: What is lower-cased, and what separates words: ASCII other than digits and letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "".join(chr(c) for first, last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)) for c in range(first, last + 1))
#: Stands for a text as a whole among its shingles; no word holds it.
WHOLE = "\x00"
#: Words in a shingle (a shorter window is a single shingle).
GRAM = 3
#: Rows of distinct benchmark shingles (about 100 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Bytes of text in a table up to which it is broadcast.
BROADCAST_BYTES = 64_000_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none of a null text.  Separators become spaces in the pass that lower-cases."""
    spaced = F.translate(text, UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


def _grams(column: str, n: int) -> Column:
    """The n-word shingle from each word on; the last n - 1 are short and equal no n-word shingle."""
    return F.transform(F.col(column), lambda w, i: F.concat_ws(" ", w, *[F.get(F.col(column), i + k) for k in range(1, n)]))


def _placed(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """``docs(doc, th, words)``: rows ``(doc, th, n, pos, gram)`` of every shingle, and one of each text as a whole at -1, in one pass."""
    rest = [F.slice("words", k, F.greatest(F.size("words"), F.lit(1))).alias(f"w{k}") for k in range(1, GRAM)]
    zipped = F.arrays_zip(F.concat(F.array(F.lit(WHOLE)), F.col("words")).alias("w0"), *rest)
    each = docs.select("doc", "th", F.size("words").alias("n"), F.posexplode(zipped).alias("pos", "w")).withColumn("pos", F.col("pos") - 1)

    def gram(n: int) -> Column:
        return F.when(F.col("pos") + n <= F.col("n"), F.concat_ws(" ", *[F.col(f"w.w{k}") for k in range(n)]))

    whole = F.when(F.col("pos") < 0, F.lit(WHOLE))
    if len(sizes) == 1:
        return each.select("doc", "th", "n", "pos", F.coalesce(whole, gram(sizes[0])).alias("gram"))
    grams = F.when(F.col("pos") < 0, F.array(whole)).otherwise(F.array_compact(F.array(*[gram(n) for n in sizes])))
    return each.select("doc", "th", "n", "pos", F.explode(grams).alias("gram"))


def text_key(text: Column) -> Column:
    """Tells texts of one id apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_hit (words in any occurrence of an
    item's window), items (sorted ids as strings), contaminated (20 * n_hit >= n_words > 0 hits)
    and text_key (``text_key`` of its text).

    Null and empty texts have no words and no hits.  An item of fewer than ``window`` words, but
    not none, is one window; items without words and null items never occur.  Items with equal
    windows are all reported.  Rows that share an id are told apart by their text; repeated rows
    give repeated results.  Other columns, whatever their names, are ignored.
    """
    docs = documents.select(F.col(doc_id).alias("doc"), text_key(F.col(text)).alias("th"), words(F.col(text)).alias("words"))
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("words")).where("item is not null and size(words) > 0")
    window_of = items.select("item", "words", F.least(F.size("words"), F.lit(window)).alias("len"))
    windows = window_of.select("item", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at"), "words").select("item", "len", F.slice("words", F.col("at"), F.col("len")).alias("words")).withColumn("win", F.array_join("words", " "))
    windows = saved(windows, "decon-windows")
    held = windows.select("item", "win").distinct()
    shape = windows.dropDuplicates(["win"])
    sizes = sorted(r[0] for r in windows.select(F.least("len", F.lit(GRAM))).distinct().collect())  # at most GRAM values
    parts = [shape.where(F.least("len", F.lit(GRAM)) == n).select("win", "len", F.posexplode(F.slice(_grams("words", n), F.lit(1), F.col("len") - n + 1)).alias("off", "gram")) for n in sizes]
    no_grams = shape.select("win", "len", F.lit(0).alias("off"), "win").toDF("win", "len", "off", "gram").where("false")
    grams = no_grams
    for p in parts:
        grams = grams.union(p)
    grams = saved(grams, "decon-grams")
    whole = documents.sparkSession.createDataFrame([(WHOLE,)], "gram string")
    known = grams.select("gram").distinct()
    # each side by its own rows and bytes: the shingles (of which those known and the prefixes are parts), and the windows by item
    size = grams.agg(F.coalesce(F.sum(F.octet_length("win") + F.octet_length("gram") + 24), F.lit(0))).first()[0]
    small = known.count() <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    of_items = held.agg(F.coalesce(F.sum(F.octet_length("item") + F.octet_length("win") + 24), F.lit(0))).first()[0]

    def bound(df: DataFrame, fits: bool = small) -> DataFrame:
        return F.broadcast(df) if fits else df

    placed = _placed(docs, sizes or [GRAM])
    # a shuffled join must not gather every text's row for itself under one key
    met = placed.join(F.broadcast(known.union(whole)), "gram") if small else placed.join(known, "gram").union(placed.where(F.col("gram") == WHOLE).select("gram", "doc", "th", "n", "pos"))
    met = saved(met.select("gram", "doc", "th", "n", "pos"), "decon-met")
    counted = met.where(F.col("gram") == WHOLE).select("doc", "th", F.col("n").cast("long").alias("n_words"))
    hits = saved(met.where(F.col("gram") != WHOLE).distinct(), "decon-hits")

    rarity = hits.groupBy("gram").agg(F.count("*").alias("occurs"))
    ranked = grams.join(rarity, "gram").groupBy("win", "len").agg(F.min(F.struct("occurs", "gram", "off")).alias("least"), F.count("*").alias("found"))
    prefix = ranked.where(F.col("found") == F.greatest(F.col("len") - GRAM + 1, F.lit(1))).select("win", "len", F.col("least.gram").alias("gram"), F.col("least.off").alias("off"))
    start = F.col("pos") - F.col("off")
    candidates = hits.join(bound(prefix), "gram").where((start >= 0) & (start + F.col("len") <= F.col("n"))).select("doc", "th", "win", "len", start.alias("start"))
    needed = candidates.join(bound(grams.drop("len")), "win").select("doc", "th", "win", "len", "start", (F.col("start") + F.col("off")).alias("pos"), "gram")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("doc", "th", "pos", "gram")]
    verified = needed.alias("x").join(hits.alias("y"), same[0] & same[1] & same[2] & same[3], "left_semi").groupBy("doc", "th", "win", "len", "start").agg(F.count("*").alias("found")).where(F.col("found") == F.greatest(F.col("len") - GRAM + 1, F.lit(1)))
    verified = saved(verified.select("doc", "th", "win", "len", "start"), "decon-verified")

    covered = verified.select("doc", "th", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("doc", "th").agg(F.count("*").alias("n_hit"))
    listed = verified.select("doc", "th", "win").distinct().join(bound(held, small and of_items <= BROADCAST_BYTES), "win").groupBy("doc", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = covered.join(listed, covered.doc.eqNullSafe(listed.doc) & (covered.th == listed.th)).select(covered.doc.alias("d"), covered.th.alias("t"), "n_hit", "items")
    return (
        counted.join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
        .select(F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("th").alias("text_key"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )
