"""All stages of the pipeline, one after the other, on small tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.data import documents, nothing, prose, texts


def folder(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def labelled(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string")


def test_run_on_nulls_repeats_and_copies(spark, tmp_path):
    docs = documents(spark)
    toxic = [(1000 + i, f"{prose(i, 30)} vile{i % 3} scumbags {prose(i + 500, 30)}", "en", "a", 1, 0, "", "") for i in range(60)]
    docs = docs.unionByName(spark.createDataFrame(toxic, docs.schema))
    labels = labelled(spark, [(i, None, 1, "t") for i in range(1000, 1060)] + [(i, 1, 0, None) for i in range(25)])
    where = folder(spark, tmp_path / "some", docs, labels)
    after = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        rows = after[name] = stage(spark, rows, where)
        assert rows.columns == docs.columns
    kept = after["toxicity"]
    assert kept.filter("doc_id >= 1000").count() < 10
    assert kept.filter("doc_id < 1000 or doc_id is null").count() == docs.filter("doc_id < 1000 or doc_id is null").count()
    held = [r.text for r in after["minhash"].filter("doc_id < 1000").collect()]
    longest = max((t for t in texts() if t), key=len)
    assert sum(t is not None and t.startswith(longest[:1000]) for t in held) == 1  # one of two near copies
    done = corpus_pipeline.run(spark, where)
    assert done.filter(~F.col("is_text")).count() == 0
    assert done.filter(F.size("ids") != F.col("n_tokens")).count() == 0
    assert {"doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256", "is_text"} <= set(done.columns)
    assert 0 < done.count()


@pytest.mark.parametrize("with_labels", [False, True])
def test_run_without_rows(spark, tmp_path, with_labels):
    labels = labelled(spark, [(1, 0, 1, "x")] if with_labels else [])
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "none", nothing(spark), labels)).count() == 0
