"""Windows-1252 files without a setting of the session."""

from pyspark.sql import functions as F

from kerbside import schemas
from kerbside.sources.delimited import from_latin, read_csv, to_latin

NAMES = schemas.strings("a", "b")


def test_all_assigned_characters(spark, tmp_path):
    raw = bytes(b for b in range(0x80, 0x100) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    (tmp_path / "t.csv").write_bytes(b"a,b\n" + raw + b",x\n\x81,\n")
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    rows = read_csv(spark, str(tmp_path / "t.csv"), NAMES).collect()
    assert [tuple(r) for r in rows] == [(raw.decode("cp1252"), "x"), ("�", None)]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before


def test_there_and_back(spark):
    text = "".join(chr(i) for i in range(0x20, 0x7F)) + "€šœž é ÿ"
    frame = spark.createDataFrame([(text,)], "t string")
    latin = frame.select(to_latin(F.col("t")).alias("t"))
    assert latin.first()[0].encode("latin-1").decode("cp1252") == text
    assert latin.select(from_latin(F.col("t"))).first()[0] == text


def test_other_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_text("a,b\né€,x\n", encoding="utf-8")
    assert read_csv(spark, str(tmp_path / "u.csv"), NAMES, encoding="utf-8").first()["a"] == "é€"
