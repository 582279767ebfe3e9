"""Municipal CSV files: Windows-1252 text with a header line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODING = "windows-1252"

# Characters of Windows-1252 where ISO-8859-1 has the controls U+0080 to U+009F, in that order
# (five of them are not assigned).
_WINDOWS = "€\ufffd‚ƒ„…†‡ˆ‰Š‹Œ\ufffdŽ\ufffd\ufffd‘’“”•–—˜™š›œ\ufffdžŸ"
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))


def from_latin(text: Column) -> Column:
    """Windows-1252 text that was read as ISO-8859-1."""
    return F.translate(text, _CONTROLS, _WINDOWS)


def to_latin(text: Column) -> Column:
    """Text to be written as ISO-8859-1, so that the file is Windows-1252."""
    assigned = [(w, c) for w, c in zip(_WINDOWS, _CONTROLS) if w != "\ufffd"]
    return F.translate(text, "".join(w for w, _ in assigned), "".join(c for _, c in assigned))


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    encoding: str = ENCODING,
    multi_line: bool = False,
) -> DataFrame:
    """Lazy scan under a declared schema; empty fields are null.

    The raw schemas are all strings, so casts are later projections. With a typed schema a
    malformed row fails the job. ``multi_line`` allows line breaks inside quoted fields, at
    the price of one task per file. Windows-1252, which Spark's readers do not know by themselves, is read
    as ISO-8859-1 and mapped; no setting of the session is touched.
    """
    windows = encoding.lower() in ("windows-1252", "cp1252")
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", "iso-8859-1" if windows else encoding)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    if not windows:
        return rows
    texts = {f.name for f in schema if isinstance(f.dataType, T.StringType)}
    return rows.select(*[from_latin(F.col(c)).alias(c) if c in texts else F.col(c) for c in schema.names])
