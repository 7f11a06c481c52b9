"""The pipeline's stages keep their contract: columns, whole effects, clean documents."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = spark.read.parquet(str(tmp_path / "quality")).join(labels, "doc_id")
    assert good.where("quality = 0").count() == 0
    assert good.where("quality = 1").count() == labels.where("quality = 1").count()
    assert kept["near_duplicates"] < kept["quality"] and kept["sharding"] == kept["mixing"]
    sizes = collections.Counter(r.shard for r in docs.select("shard").collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    times = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert times <= 3


ROW = "doc_id long, text string, lang string, source string, n_chars int, _gone long, score double, _own string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 0.5, "x") for i, t, s in rows], ROW)


def _texts(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


def _tables(spark, folder, labels=(), items=()):
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


A, B, C = (" ".join(f"{w}{k}" for k in range(30)) for w in "abc")


def test_near_duplicates_tell_rows_apart(spark, tmp_path):
    docs = _docs(spark, [(0, A, "s"), (1, A, "s"), (1, B, "s"), (2, C, "s"), (2, C, "s"), (None, A, "s"), (None, A, "s"), (3, None, "s"), (4, "", None), (4, "", None)])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert _texts(got) == sorted([(False, 0, A), (False, 1, B), (False, 2, C), (True, 0, A), (True, 0, A), (False, 3, ""), (False, 4, "")])


def test_decontamination_tells_rows_apart(spark, tmp_path):
    sf = _tables(spark, tmp_path, items=[(7, " ".join(A.split()[3:18]))])
    docs = _docs(spark, [(1, A, "s"), (1, B, "s"), (1, A, "s"), (None, A, "s"), (None, C, "s"), (2, None, "s"), (3, "", "s")])
    got = corpus_pipeline.decontaminate(spark, docs, sf)
    assert got.columns == docs.columns
    assert _texts(got) == sorted([(False, 1, B), (True, 0, C), (False, 2, ""), (False, 3, "")])


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    sf = _tables(spark, tmp_path, labels=[(1, 1, 0), (2, 0, 0)], items=[(7, A)])
    for rows in ([], [(None, None, None)], [(1, "a", None), (2, "b c", "s"), (2, "b c", "s"), (None, "", "s")]):
        docs = _docs(spark, rows)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs, sf)
            assert got.columns == (docs.columns if k < 4 else [*docs.columns, "shard", "slot"]), name
            got.write.parquet(str(tmp_path / f"{name}-{len(rows)}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{len(rows)}"))
        assert docs.count() <= 3 * len(rows)
