"""Secret scans: an incremental ledger of content-addressed blobs, native DataFrame operations only.

Each version of a path is addressed by the SHA-256 of its content.  The ledger holds one row per
(blob, rule, rule version) that was scanned; a scan reads only pairs that the ledger lacks, adds
them, and joins all findings back to every path that ever held the blob.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragspan.llm.session import saved


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``part`` (a pattern within the match, or the whole) has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1


#: The base rules, in the order of their listing, then the rules that this operator adds.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("urlpass", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{3,64}@"),
)
RULES = BASE_RULES + ADDED_RULES
LEDGER = "blob string, kind string, version int"
FINDINGS = "blob string, kind string, version int, start int, end int"


def blob_id(text: Column) -> Column:
    """The content's address; null and empty content share one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _quick(rule: Rule) -> str:
    """What any text with a finding of the rule matches, cheap to look for."""
    return {"access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}.get(rule.kind, rule.pattern)


def _running(sizes: Column) -> Column:
    """Running sums of an array, by doubling: each pass adds what stands twice as far back, so n sizes take log2(n) passes."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(1)))).cast("int"))
    return F.aggregate(passes, sizes, lambda sums, k: F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, (i - F.pow(F.lit(2), k)).cast("int")), F.lit(0))))


def spans(text: Column, rule: Rule) -> Column:
    """The rule's leftmost non-overlapping matches as an array of (start, end) in code points.

    What lies between the matches and the matches themselves alternate, so running lengths of
    the two lists give every place.
    """
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    empty = F.array().cast("array<struct<start:int,end:int>>")
    pairs = F.zip_with(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, f: F.struct(F.length(b).alias("gap"), F.length(f).alias("size"))), measured, lambda p, m: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), F.length(m).alias("part")))
    ends = _running(F.transform(pairs, lambda p: p["gap"] + p["size"]))
    placed = F.zip_with(pairs, ends, lambda p, e: F.struct((e - p["size"]).cast("int").alias("start"), e.cast("int").alias("end"), p["part"].alias("part")))
    kept = F.transform(F.filter(placed, lambda s: s["part"] >= rule.least), lambda s: F.struct(s["start"], s["end"]))

    return F.when(text.rlike(_quick(rule)), kept).otherwise(empty)


def _finding(rule: Rule) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), s["start"].alias("start"), s["end"].alias("end"))


def scan(versions: DataFrame, path: str = "path", content: str = "content", ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scans what the ledger lacks.  Returns ``(new ledger rows, all findings, paths)``.

    ``versions`` has a row for every historical version of every path.  ``paths`` has one row per
    row of ``versions``: path, blob.  Append the first to the ledger and the second's rows of this
    run to the findings; ``by_path`` joins findings to paths.  A blob that a rule of the same
    version has seen is never read again; a blob occurs once however many versions hold it.
    Null content is an empty blob without findings.  Columns other than the two are ignored.
    """
    spark = versions.sparkSession
    ledger = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    findings = findings if findings is not None else spark.createDataFrame([], FINDINGS)
    kept = versions.select(F.col(path).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content")).withColumn("blob", blob_id(F.col("content")))
    pairs = [(r.kind, r.version) for r in rules]
    wanted = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version")) for k, v in pairs])
    # per blob the rule versions that have seen it: rows per blob are bounded by the rules' history
    seen = ledger.where(F.struct("kind", "version").isin(*[F.struct(F.lit(k), F.lit(v)) for k, v in pairs])).groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("_seen"))
    unseen = kept.select("blob", "content").dropDuplicates(["blob"]).join(seen, "blob", "left").withColumn("_todo", F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<struct<kind:string,version:int>>")))).where(F.size("_todo") > 0)
    columns = []
    for r in rules:
        todo = F.array_contains(F.col("_todo"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")))
        columns.append(F.transform(F.when(todo, spans(F.col("content"), r)), _finding(r)))
    empty = F.array().cast("array<struct<kind:string,version:int,start:int,end:int>>")
    scanned = saved(unseen.select("blob", "_todo", F.concat(*[F.coalesce(c, empty) for c in columns]).alias("found")), "secret-scan")
    fresh = scanned.select("blob", F.explode("_todo").alias("p")).select("blob", "p.kind", "p.version")
    new = scanned.select("blob", F.explode("found").alias("f")).select("blob", "f.kind", "f.version", "f.start", "f.end")
    return fresh, findings.select("blob", "kind", "version", "start", "end").union(new), kept.select("path", "blob")


def by_path(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``paths``: path, blob and ``found``, its spans of the rules' versions sorted by start and then as the rules are listed."""
    rank = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))]), F.concat_ws(":", "kind", "version"))
    listed = findings.withColumn("rank", rank).where("rank is not null").distinct().groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("found"))
    return paths.join(listed, "blob", "left").select("path", "blob", F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")).alias("found"))
