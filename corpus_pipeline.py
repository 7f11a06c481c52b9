"""From raw documents to training shards: filter, dedup, decontaminate, mix, shard.

Each stage works on all that the stage before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragspan.llm import decontamination, mixing, near_duplicates, quality, sharding
from cragspan.llm.session import saved

#: A document is kept if the classifier's score is at least this.
LEAST_QUALITY = 0.3
SHARDS = 40


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it, such that ``docs`` has no such column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; labels of a fifth of the ids are never learned.

    A null or empty text is one empty line and has a score like any other; a row with a null id is scored, not
    learned.  Repeated rows share their score.  Without labels every score is a half, and all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    model = quality.train(learned, labels)
    score = _unused(docs, "score")
    return quality.score(docs, model, out=score).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similarity 0.8 or more hold together, the least id stays.

    Rows that share an id but not their words are documents of their own; of exact repeats (id and text) one row
    stays.  Texts without words stay, one for each id; rows with a null id all stay.
    """
    return near_duplicates.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more of the words is benchmark text.

    A row goes by its own id (null too) and text: another text of the same id stays if it is clean.  Texts without
    words are clean.
    """
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where("contaminated").select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_text")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("row"))  # no name of docs can clash
    same = F.col("row.doc_id").eqNullSafe(F.col("_gone")) & (decontamination.text_key(F.col("row.text")) == F.col("_gone_text"))
    return own.join(gone, same, "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each source up to its target: every document whole, as often as the mix takes it, and one cut at the target."""
    mixed = mixing.mixed(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    return sharding.place(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Fitted models, banding and a drawn matrix are not SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
