"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cragspan.llm import clustering, decontamination, fingerprints, language_model, languages, mixing, near_duplicates, prefix_trie, quality, secret_scan, sharding, simhash, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _sha(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, findings, paths = secret_scan.scan(_table(spark, sf_dir, "documents"), "doc_id", "text")
    found = secret_scan.by_path(paths, findings)

    def joined(column: Column) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["rank"] < len(secret_scan.BASE_RULES))
    ranks = F.transform("found", lambda s: s["rank"])
    counts = [(F.size("found") - F.size(F.array_remove(ranks, k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE_RULES)]
    return found.select(F.col("path").alias("doc_id"), *counts, _sha(joined(base)).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(_remainder(7) == 2, F.lit(False)).alias("held_out"))
    model = language_model.train(docs.where("not held_out"))
    scored = language_model.score(docs, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"))
    model = languages.train(docs.where("not held_out"))
    return languages.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"))
    model = quality.train(docs.where("not held_out"), _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_substrings": op2_substrings,
    "op3_language_model": op3_language_model,
    "op4_language": op4_language,
    "op5_fingerprints": op5_fingerprints,
    "op6_secrets": op6_secrets,
    "op7_quality": op7_quality,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_clusters": op11_clusters,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_simhash": op13_simhash,
}

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _lloyd_round(k: int) -> str:
    """SQL of one round: the assignment A{k} to the centroids C{k}, and the centroids C{k + 1} that follow."""
    return f"""
A{k} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS n FROM
       (SELECT r, c, list_sum(list_transform(list_zip(V.q, C{k}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM V CROSS JOIN C{k})) WHERE n = 1),
C{k + 1} AS MATERIALIZED (SELECT c, coalesce(m.q, C{k}.q) AS q FROM C{k} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM
       (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM A{k} JOIN V USING (r)) GROUP BY c, i) GROUP BY c) m USING (c))"""


ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
iw AS (SELECT item, list_slice(w, p, p + least(len(w), 13) - 1) AS win
       FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, item, p, n FROM dw JOIN iw USING (win)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS pos FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op2_substrings": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
v AS (SELECT doc_id, p, md5(list_aggregate(list_slice(w, p, p + 19), 'string_agg', ' ')) AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM v) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS pos FROM r),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d) x ANTI JOIN g USING (doc_id, pos) GROUP BY x.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_clusters": f"""
WITH V AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
C0 AS MATERIALIZED (SELECT c, q FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, q) - 1 AS c, q FROM V) WHERE c < 16),{",".join(map(_lloyd_round, range(4)))},
I AS (SELECT c, sum(d) AS inertia FROM A3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(I.inertia AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM A3) AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(C3.q, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM A3 JOIN V USING (r) JOIN I USING (c) JOIN C3 USING (c)""",
    "op12_prefix_trie": r"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p,
                  {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(t ORDER BY p) AS w FROM o GROUP BY conv_id),
b AS (SELECT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes, w FROM l),
h AS (SELECT conv_id, w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
        lambda a, c: list_reduce(list_prepend(xor(a, c), list_transform(range(8), lambda i: CAST(i AS BIGINT))), lambda x, i: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT)) % 6 AS h FROM b),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(l.w, 1, h), []), coalesce(list_slice(h.w, h + 1, len(h.w)), [])) AS w FROM h LEFT JOIN l ON l.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, d, list_slice(w, 1, d) AS pre, d = len(w) AS last FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM r)),
n AS (SELECT d, pre, min(conv_id) AS c, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends,
             CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(pre[d].text) END AS saved FROM m GROUP BY d, pre),
k AS (SELECT d - 1 AS d, list_slice(pre, 1, d - 1) AS pre, count(*) AS children FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k USING (d, pre)),
s AS (SELECT u.d, u.pre, sum(CASE WHEN f.children = 0 THEN 1 ELSE 0 END) AS leaves, sum(f.saved) AS saved
      FROM (SELECT d, pre, unnest(range(0, d + 1)) AS a, children, saved FROM f) f JOIN n u ON u.d = f.a AND u.pre = list_slice(f.pre, 1, f.a) GROUP BY u.d, u.pre)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, p.c AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(children AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN s USING (d, pre) LEFT JOIN n p ON p.d = f.d - 1 AND p.pre = list_slice(f.pre, 1, f.d - 1)""",
}
