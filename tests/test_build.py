import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kerbside import schemas
from kerbside.__main__ import main
from kerbside.plans import build as B
from kerbside.plans import signs as S
from kerbside.plans import spots as SP
from kerbside.plans.requests import SignQuery, SpotQuery
from kerbside.sources import curated, delimited, geojson

FILES = {
    "signalisation_stationnement.csv": """CODE_RPA,DESCRIPTION_RPA,Longitude,Latitude,NOM_ARROND,FLECHE_PAN
B1,\\P 9h-17h LUN A VEN,-73.56,45.50,Côte-des-Neiges,2
A1,"\\A ""EN"" TOUT, TEMPS",-73.561,45.501,,0
,\\P X,-73.561,45.501,Z,0
B1,\\P 9h-17h LUN A VEN,,45.501,Z,0
C1,,-73.562,45.502,Québec,3
D1,\\P un,-73.563,45.503,Z,0
D1,\\A deux,-73.564,45.504,Z,0
B1,\\P 9h-17h LUN A VEN,-73.56,45.50,Côte-des-Neiges,2
""",
    "Places.csv": """sNoPlace,nPositionCentreLongitude,nPositionCentreLatitude,nTarifHoraire,sType,sNomRue
S1,-73.56,45.50,300,Normal,Rue Sainte-Thérèse
S2,-73.57,45.51,gratuit,Normal,
S3,,45.51,100,Normal,X
S4,-73.58,45.52,,,Rue Y
""",
    "EmplacementReglementation.csv": """sNoEmplacement,sCodeAutocollant
S1,R1
S1,R1
S1,R2
S2,R9
S4,R2
S9,R1
""",
    "ReglementationPeriode.csv": """sCode,noPeriode,sDescription
R1,25,Jour
R1,10,Nuit
R2,25,Jour
R2,99,Perdu
R3,10,Autre
""",
    "Periodes.csv": """nID,dtHeureDebut,dtHeureFin,bLun,bMar,bMer,bJeu,bVen,bSam,bDim
25,09:00:00,18:00:00,1,1,1,1,1,0,0
10,22:00:00,23:59:59,0,0,0,0,0,1,1
""",
    "Reglementations.csv": """Name,Type,DateDebut,DateFin,maxHeures
R1,U,0101,3112,2
""",
}


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, content in FILES.items():
        (folder / name).write_bytes(content.encode("cp1252"))
    return B.read_raw(spark, str(folder))


@pytest.fixture(scope="module")
def tables(spark, raw, tmp_path_factory):
    return B.build(spark, raw, str(tmp_path_factory.mktemp("curated")))


def test_codes(tables):
    rows = {(r["code_id"], r["code_rpa"], r["description"]) for r in tables.codes.collect()}
    assert rows == {
        (0, "A1", '\\A "EN" TOUT, TEMPS'),
        (1, "B1", "\\P 9h-17h LUN A VEN"),
        (2, "C1", ""),
        (3, "D1", "\\A deux"),
        (4, "D1", "\\P un"),
    }


def test_signs_fan_out_over_the_descriptions_of_a_code(tables):
    rows = tables.signs.collect()
    assert sorted(r["sign_id"] for r in rows) == list(range(8))
    assert Counter(r["code_id"] for r in rows) == {0: 1, 1: 2, 2: 1, 3: 2, 4: 2}
    names = {r["code_id"]: r["arrondissement"] for r in rows}
    assert names[1] == "Côte-des-Neiges" and names[2] == "Québec" and names[0] is None


def test_spots(tables):
    rows = {r["place_id"]: r for r in tables.spots.collect()}
    assert set(rows) == {"S1", "S2", "S4"}
    assert [tuple(p) for p in rows["S1"]["periods"]] == [
        (22.0, 23 + 59 / 60.0, 0b1100000, "Nuit", 2),
        (9.0, 18.0, 0b0011111, "Jour", 3),
    ]
    assert rows["S2"]["periods"] is None and rows["S2"]["tariff_hourly"] is None
    assert rows["S4"]["tariff_hourly"] is None and len(rows["S4"]["periods"]) == 1
    assert rows["S1"]["street"] == "Rue Sainte-Thérèse"


def test_links_are_counted(tables):
    found = {
        (r["place_id"], r["description"]): (r["first_period"], r["n_links"])
        for r in tables.spot_periods.collect()
    }
    assert found == {
        ("S1", "Jour"): (25, 3),
        ("S1", "Nuit"): (10, 2),
        ("S4", "Jour"): (25, 1),
        ("S9", "Jour"): (25, 1),
        ("S9", "Nuit"): (10, 1),
    }


def test_via_regulations(raw):
    found = {
        (r["place_id"], r["description"], r["n_links"], r["end_hour"])
        for r in B.build_spot_periods(raw, via_regulations=True, keep_seconds=True).collect()
    }
    night = 23 + 59 / 60.0 + 59 / 3600.0
    assert found == {
        ("S1", "Jour", 2, 18.0), ("S1", "Nuit", 2, night),
        ("S9", "Jour", 1, 18.0), ("S9", "Nuit", 1, night),
    }


def test_build_via_regulations(spark, raw, tmp_path):
    built = B.build(spark, raw, str(tmp_path), via_regulations=True, keep_seconds=True)
    rows = built.spots.collect()
    assert [r["place_id"] for r in rows] == ["S1"]
    assert rows[0]["periods"][0]["end_hour"] == 23 + 59 / 60.0 + 59 / 3600.0


def test_split_spots_survive_the_build(spark, raw, tables, tmp_path):
    split = B.build(spark, raw, str(tmp_path), periods_per_row=1)
    assert split.spots.where("n_parts > 1").count() >= 1
    box = (-74.0, 45.0, -73.0, 46.0)
    for hour, day in (((10, 11), (1, 5)), ((22.5, 23), (6, 6)), ((3, 4), (1, 1))):
        answers = []
        for built in (split, tables):
            rows = SP.query_spots(built.spots, SpotQuery(box, hour=hour, day=day)).select(
                "place_id", "is_currently_free", F.explode_outer("periods").alias("text")
            )
            answers.append(sorted(map(repr, rows.collect())))
        assert answers[0] == answers[1]


def test_command(spark, raw, tmp_path, tmp_path_factory, capsys):
    folder = tmp_path_factory.mktemp("raw-command")
    for name, content in FILES.items():
        (folder / name).write_bytes(content.encode("cp1252"))
    main([str(folder), str(tmp_path)])
    printed = capsys.readouterr().out
    assert "permitted" in printed and "spots_with_periods" in printed
    assert curated.load(spark, str(tmp_path)).codes.count() == 5


def test_labels(tables):
    found = {r["place_id"]: r["label"] for r in SP.spot_labels(tables.spot_periods).collect()}
    assert found["S1"] == "mon,tue,wed,thu,fri: 09:00:00-18:00:00 | sat,sun: 22:00:00-23:59:59"


def test_queries_over_the_built_tables(tables):
    box = (-74.0, 45.0, -73.0, 46.0)
    found = S.query_signs(tables.signs, tables.codes, SignQuery(box, hour=(20, 21)))
    assert {r["description"] for r in found.collect()} == {"\\P un"}
    free = {
        r["place_id"]: r["is_currently_free"]
        for r in SP.query_spots(tables.spots, SpotQuery(box, hour=(10, 11), day=(1, 5))).collect()
    }
    assert free == {"S1": False, "S2": True, "S4": False}


def test_bad_coordinate_fails_the_job(spark):
    rows = [("C", "", "west", "45.5", None, None)]
    signs = spark.createDataFrame(rows, schemas.RAW_SIGNS)
    codes = spark.createDataFrame([], schemas.CODES)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        B.build_signs(signs, codes).count()


def test_typed_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(FILES["Reglementations.csv"].encode("cp1252"))
    typed = "Name string, Type string, DateDebut string, DateFin string, maxHeures int"
    df = delimited.read_csv(spark, str(tmp_path / "r.csv"), spark.createDataFrame([], typed).schema)
    assert df.first()["maxHeures"] == 2


def test_geojson_files(spark, tables, tmp_path):
    found = S.query_signs(
        tables.signs, tables.codes, SignQuery((-74.0, 45.0, -73.0, 46.0), categories=("prohibited",))
    )
    lines, whole = str(tmp_path / "lines"), tmp_path / "whole.json"
    geojson.write_features(found, geojson.sign_feature(), lines)
    expected = {tuple(r[c] for c in sorted(found.columns)) for r in found.collect()}
    back = geojson.read_features(spark, lines, geojson.SIGN_PROPERTIES)
    assert {tuple(r[c] for c in sorted(back.columns)) for r in back.collect()} == expected

    document = geojson.collections(
        found.withColumn("query_id", F.lit(1)), geojson.sign_feature, "query_id", 100
    ).first()["collection"]
    assert len(json.loads(document)["features"]) == len(expected)
    whole.write_text(json.dumps(json.loads(document), indent=1), encoding="utf-8")
    again = geojson.read_collections(spark, str(whole), geojson.SIGN_PROPERTIES)
    assert {tuple(r[c] for c in sorted(again.columns)) for r in again.collect()} == expected


def test_spot_features_read_back(spark, tables, tmp_path):
    answered = SP.query_spots(tables.spots, SpotQuery((-74.0, 45.0, -73.0, 46.0)))
    geojson.write_features(answered, geojson.spot_feature(), str(tmp_path / "spots"))
    back = geojson.read_features(spark, str(tmp_path / "spots"), geojson.SPOT_PROPERTIES)
    assert {r["place_id"]: r["periods"] for r in back.collect()} == {
        "S1": ["Nuit", "Jour"], "S2": [], "S4": ["Jour"],
    }
    document = geojson.collections(
        answered.withColumn("query_id", F.lit(1)), geojson.spot_feature, "query_id", 100
    ).first()["collection"]
    lines = answered.select(geojson.spot_feature()).collect()
    expected = sorted((json.loads(r[0]) for r in lines), key=lambda f: f["properties"]["place_id"])
    assert json.loads(document) == {"type": "FeatureCollection", "features": expected}


def test_rebuild_overwrites(spark, raw, tmp_path):
    for _ in range(2):
        B.build(spark, raw, str(tmp_path))
    assert curated.load(spark, str(tmp_path)).signs.count() == 8
