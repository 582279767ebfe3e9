"""One FeatureCollection document, written by many tasks and read by many tasks.

Writing sorts the features, puts the head before the first and the tail behind the last, and lets each task
write its stretch: the files of the folder, in the order of their names, are the document.

Reading cuts the text at every ``}``, wherever lines end, which any task can do from the middle of a file.
Whether a piece begins inside a string follows from the number of quotes before it, and its depth from the
braces outside of strings before it. Both are sums: over runs of pieces (a row per run) by a small window, and
inside a run by a window in the order of the text. The runs' sums come first, of numbers only; then the text is
shuffled once, by run, where depths are found and members put together. A brace that
closes depth 2 ends a member of the collection; only members that lie in two runs or more are put together
across tasks. No assumption is made about line ends, indentation, the order of keys, or braces and quotes inside of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.sources.geojson import feature_schema, flat_features
from kerbside.storage import written

HEAD, TAIL = '{"type":"FeatureCollection","features":[', "]}"

# What may stand between strings and in one, without backtracking.
_IN_STRING = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_PLAIN_STRINGS = r'"[^"]*+(?:"|\z)'  # of a text without escaped characters
_BEFORE_BRACE = rf'(?s)\A[^"{{]*+(?:"{_IN_STRING}"[^"{{]*+)*+'


def write_document(rows: DataFrame, feature: Column, path: str, order: list[str]) -> None:
    """All rows as one document, in the order of the columns ``order``, which tell the rows apart."""
    spark = rows.sparkSession
    key = F.struct(*order)
    first = rows.agg(F.min(key).alias("first"))
    body = (
        rows.select(key.alias("key"), feature.alias("feature"))
        .join(F.broadcast(first), F.col("key") == F.col("first"), "left")  # one row
        .select(
            F.lit(1).alias("part"),
            "key",
            F.when(F.col("first").isNull(), F.concat(F.lit(","), "feature")).otherwise(F.col("feature")).alias("value"),
        )
    )
    no_key = F.lit(None).cast(body.schema["key"].dataType).alias("key")
    ends = spark.createDataFrame([(0, HEAD), (2, TAIL)], "part int, value string").select("part", no_key, "value")
    lines = body.unionByName(ends)
    lines.repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("value").write.mode(
        "overwrite"
    ).text(path)


def _count_of(text: Column, character: str) -> Column:
    """Of a plain character: as many bytes as go without it."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(character), F.lit("")))


# A task's pieces are numbered without gaps; so many of them are at most one run.
_RUN_BITS = 16


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, run, place, value and, of the text between braces, what holds at either side of a quote:
    the quotes in it, and the braces it opens if it begins outside of a string or inside of one."""
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    value = F.col("value")
    plain = F.when(F.contains(value, F.lit("\\")), F.regexp_replace(value, r"(?s)\\.", "")).otherwise(value)
    counted = (
        text.withColumn("plain", plain)
        .withColumn("braces", _count_of(F.col("plain"), "{"))
        .withColumn("bare", F.when(F.col("braces") > 0, F.regexp_replace("plain", _PLAIN_STRINGS, "")).otherwise(""))
        .withColumn("opened_outside", _count_of(F.col("bare"), "{"))
    )
    return written(
        counted.select(
            *text.columns,
            F.shiftright("place", _RUN_BITS).alias("run"),
            _count_of(F.col("plain"), '"').alias("quotes"),
            "opened_outside",
            # what a quote before the piece would turn around
            (F.col("braces") - F.col("opened_outside")).alias("opened_inside"),
        ),
        "pieces",
    )


_RUN = ["file", "block", "run"]


def _before(column: str) -> Column:
    """The sum of a column over all earlier runs. There is a row per run of some ten thousand pieces."""
    earlier = Window.orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def _runs(pieces: DataFrame) -> DataFrame:
    """A row per run: its number in the order of the text, the quotes before it, and the place of a piece that
    has no brace behind it: the last of a file, unless the file ends with one."""
    runs = pieces.groupBy(*_RUN).agg(
        F.max("place").alias("last"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.max("size").alias("size"),
        F.sum("quotes").alias("quotes"),
    )
    file = Window.partitionBy("file")
    is_last = F.struct("block", "run") == F.max(F.struct("block", "run")).over(file)
    is_open = is_last & (F.sum("bytes").over(file) > F.col("size"))
    numbered = runs.withColumn("open", F.when(is_open, F.col("last"))).withColumn(
        "run_no", F.row_number().over(Window.orderBy(*_RUN))
    )
    return written(numbered.select(*_RUN, "run_no", "open", _before("quotes").alias("quotes_before")), "runs")


def _earlier(column: str) -> Column:
    """The sum of a column over the earlier pieces of the run."""
    before = Window.partitionBy("run_no").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(before), F.lit(0))


def _marked(pieces: DataFrame, runs: DataFrame, *columns: str) -> DataFrame:
    """Adds whether each piece's brace closes one, and by how much the depth changes from before the piece to
    behind its brace. The runs meet the pieces in the one shuffle that this module's windows and groups share."""
    numbered = pieces.join(F.broadcast(runs), _RUN).select(
        *columns,
        *[name for name in runs.columns if name not in _RUN + ["open"]],
        "place",
        "quotes",
        "opened_outside",
        "opened_inside",
        (F.col("open").isNull() | (F.col("open") != F.col("place"))).alias("closed"),
    )
    quoted = numbered.withColumn("quotes_before", F.col("quotes_before") + _earlier("quotes"))
    inside = F.col("quotes_before") % 2 == 1
    closes = F.col("closed") & ((F.col("quotes_before") + F.col("quotes")) % 2 == 0)
    opened = F.when(inside, F.col("opened_inside")).otherwise(F.col("opened_outside"))
    return quoted.withColumn("closes", closes).withColumn("change", opened - F.col("closes").cast("int"))


def _members(pieces: DataFrame, runs: DataFrame) -> DataFrame:
    """The text of each member of a collection within each run, whole or the stretch of it that lies there."""
    changes = _marked(pieces, runs).groupBy("run_no").agg(F.sum("change").alias("change"))
    depths = changes.select("run_no", _before("change").alias("depth_before"))
    runs = written(runs.join(depths, "run_no"), "depths")
    deep = _marked(pieces, runs, "value").withColumn("depth", F.col("depth_before") + _earlier("change"))
    deep = deep.withColumn("depth_after", F.col("depth") + F.col("change"))
    # members of the collection end at depth 1, and the collection itself at depth 0
    ends = (F.col("closes") & (F.col("depth_after") <= 1)).cast("int")
    text = F.concat("value", F.when(F.col("closed"), "}").otherwise(""))
    stretches = (
        deep.withColumn("ends", ends)
        .withColumn("member", _earlier("ends"))
        .withColumn("text", text)
        .groupBy("run_no", "member")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", "text"))).alias("texts"),
            F.min_by("depth", "place").alias("depth"),
            F.max_by("depth_after", "place").alias("depth_after"),
            F.max("ends").alias("ends"),
        )
    )
    return written(stretches.withColumn("text", F.array_join("texts.text", "")).drop("texts"), "members")


def read_document(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """Rows of the Point features of one or several FeatureCollection documents below a path."""
    pieces = _pieces(spark, path)
    stretches = _members(pieces, _runs(pieces))
    # the first stretch of a run may end, and one without an end begin, a member that lies in several runs
    is_whole = (F.col("member") > 0) & (F.col("ends") == 1)
    ends = stretches.groupBy("run_no").agg(F.sum("ends").alias("ends"))
    starts = ends.select("run_no", _before("ends").alias("members_before"))
    divided = (
        stretches.where(~is_whole)
        .join(F.broadcast(starts), "run_no")
        .groupBy((F.col("members_before") + F.col("member")).alias("member"))
        .agg(
            F.sort_array(F.collect_list(F.struct("run_no", "text"))).alias("texts"),
            F.min_by("depth", "run_no").alias("depth"),
            F.max_by("depth_after", "run_no").alias("depth_after"),
            F.max("ends").alias("ends"),
        )
        .withColumn("text", F.array_join("texts.text", ""))
    )
    columns = ["text", "depth", "depth_after", "ends"]
    members = stretches.where(is_whole).select(*columns).unionByName(divided.select(*columns))
    own = F.regexp_replace("text", _BEFORE_BRACE, "")
    # the first member of a document has the document's own brace before it
    inner = F.regexp_replace(F.substring(own, 2, 2**31 - 1), _BEFORE_BRACE, "")
    parsed = (
        members.where("ends = 1 and depth_after = 1")
        .select(F.when(F.col("depth") == 0, inner).otherwise(own).alias("text"))
        # as rows of a list of one, so that the test of the geometry does not parse the text a second time
        .select(F.inline(F.array(F.from_json("text", feature_schema(properties)))))
    )
    return flat_features(parsed)
