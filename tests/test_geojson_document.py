"""One document written and read by many tasks, against the reader that takes a file whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kerbside.sources import geojson
from kerbside.sources.geojson_document import read_document, write_document
from tests.test_scale import settings

TEXTS = ['a "quoted" text', "brace } and { brace", 'back\\slash', 'ends with \\', '{"type":"Feature"}', "línea\nnueva", "", None]


def signs(spark, n):
    draw = random.Random(n)
    rows = [
        (i, draw.uniform(-74, -73), draw.uniform(45, 46), draw.choice(["permitted", "other", None]), i % 2 == 0,
         draw.choice(TEXTS), draw.choice(TEXTS))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "sign_id long, longitude double, latitude double, category string, is_reserved boolean, "
        "arrondissement string, description string"
    )


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 400])
def test_document_of_several_files_reads_back(spark, tmp_path, n):
    frame = signs(spark, n)
    path = str(tmp_path / "document")
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        write_document(frame, geojson.sign_feature(), path, ["sign_id"])
    files = sorted((tmp_path / "document").glob("part-*"))
    whole = json.loads("".join(f.read_text(encoding="utf-8") for f in files))
    assert [f["properties"]["sign_id"] for f in whole["features"]] == list(range(n))
    assert n < 400 or len(files) > 2
    assert rows_of(read_document(spark, path, geojson.SIGN_PROPERTIES)) == rows_of(frame)


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("sort_keys", [False, True])
def test_any_layout_is_read_in_pieces(spark, tmp_path, indent, sort_keys):
    frame = signs(spark, 120)
    features = [json.loads(r[0]) for r in frame.select(geojson.sign_feature()).collect()]
    document = {
        "type": "FeatureCollection", "name": 'x"{', "crs": {"type": "name", "properties": {"name": "}"}},
        "features": features, "zlast": {"a": ["{", "]"]},
    }
    path = tmp_path / "one.geojson"
    path.write_text(json.dumps(document, indent=indent, sort_keys=sort_keys, ensure_ascii=False), encoding="utf-8")
    expected = rows_of(geojson.read_collections(spark, str(path), geojson.SIGN_PROPERTIES))
    assert len(expected) == 120
    with settings(spark, spark__sql__files__maxPartitionBytes="2k", spark__sql__files__openCostInBytes="1"):
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 8
        found = read_document(spark, str(path), geojson.SIGN_PROPERTIES)
        assert rows_of(found) == expected


def test_several_documents_below_a_folder(spark, tmp_path):
    frame = signs(spark, 30)
    features = [json.loads(r[0]) for r in frame.select(geojson.sign_feature()).collect()]
    for part in range(3):
        document = {"type": "FeatureCollection", "features": features[part::3]}
        (tmp_path / f"{part}.json").write_text(json.dumps(document, indent=part or None) + "\n" * part, encoding="utf-8")
    assert rows_of(read_document(spark, str(tmp_path), geojson.SIGN_PROPERTIES)) == rows_of(frame)


def test_a_failed_task_leaves_no_document(spark, tmp_path):
    path = tmp_path / "broken"
    feature = F.when(F.col("sign_id") == 7, F.raise_error(F.lit("stop"))).otherwise(geojson.sign_feature())
    with pytest.raises(Exception, match="stop"):
        write_document(signs(spark, 20), feature, str(path), ["sign_id"])
    assert not list(path.glob("part-*")) and not (path / "_SUCCESS").exists()
