"""Request logs in text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgelake.functions.keys import route
from edgelake.operators.scale import lookup_join
from edgelake.session import new_table_path

# Separators and the positions of the columns in the two layouts.
REQUEST_SEPARATOR = r"[,\s]+"
SIMPLE_SEPARATOR = r"\s+"
REQUEST_MIN_COLUMNS = 6
SIMPLE_MIN_COLUMNS = 5
KEY_COLUMN = 1
NUMBER_COLUMN = 4
OPERATION_COLUMN = 5

PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def _split_once(lines: DataFrame, keep: list[str], separator: str) -> DataFrame:
    """Lines with their ``_fields``; blanks and control characters around a line and separators at its
    end make no fields.

    The array goes through a generator, which filters on it are not pushed below: as a plain column
    the split would run again for every field and condition that reads it.
    """
    text = F.regexp_replace("value", rf"^[\x00-\x20]+|(?:{separator}|[\x00-\x20])+$", "")
    return lines.select(*keep, F.explode(F.array(F.split(text, separator))).alias("_fields"))


def _is_whole(text: Column) -> Column:
    return text.rlike(r"^[+-]?[0-9]+$")


def number_lines(lines: DataFrame, file: str = "file", block: str = "block", row: str = "row") -> DataFrame:
    """Add ``line_no``, from 1 over all files in the order of their names, and ``file_line``, from 1 in every file.

    Within a block the row tag grows in reading order but starts anywhere, so the number is the distance to the
    smallest tag of the block plus the lines of earlier blocks. The table of blocks has a row per split of the
    input, not per line.
    """
    blocks = lines.groupBy(file, block).agg(
        F.count(F.lit(1)).alias("_lines"), F.min(row).alias("_start")
    )
    earlier = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        file,
        block,
        "_start",
        F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_lines").over(of_file), F.lit(0)).alias("_before_here"),
    )
    place = F.col(row) - F.col("_start") + 1
    return (
        lookup_join(lines, offsets, [file, block])
        .withColumns({"line_no": place + F.col("_before"), "file_line": place + F.col("_before_here")})
        .drop("_start", "_before", "_before_here")
    )


def read_lines(spark: SparkSession, path: str, land: str | None = None) -> DataFrame:
    """Lines of text files as ``(file, line_no, file_line, value)``; see ``number_lines``.

    Plain text is read in splits, twice. A packed file is one task, so the tagged lines of packed input are landed
    once as a columnar table, at ``land`` or a path of the run, and numbered and parsed from there in parallel. The
    caller deletes the table when the result is used up.
    """
    tagged = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    if any(name.endswith(PACKED) for name in spark.read.text(path).inputFiles()):
        landed = land or new_table_path(spark, "lines")
        tagged.write.parquet(landed)
        tagged = spark.read.parquet(landed)
    return number_lines(tagged).select("file", "line_no", "file_line", "value")


def parse_request_lines(lines: DataFrame) -> DataFrame:
    """``(line_no, value)`` to ``(line_no, object_key, node_number, operation)``.

    Dropped: blank lines, a first line of a file that starts with a non-digit, lines of fewer than six fields,
    lines whose fifth field is no whole number.
    """
    keep = [c for c in lines.columns if c != "value"]
    fields = F.col("_fields")
    header = (F.col("file_line" if "file_line" in lines.columns else "line_no") == 1) & ~fields[0].rlike(r"^\p{Nd}")
    return (
        _split_once(lines, keep, REQUEST_SEPARATOR)
        .where((F.size(fields) >= REQUEST_MIN_COLUMNS) & ~header & _is_whole(fields[NUMBER_COLUMN]))
        .select(
            *keep,
            fields[KEY_COLUMN].alias("object_key"),
            fields[NUMBER_COLUMN].try_cast("bigint").alias("node_number"),
            F.lower(fields[OPERATION_COLUMN]).alias("operation"),
        )
        .where(F.col("node_number").isNotNull())
    )


def parse_simple_lines(lines: DataFrame, n_nodes: int) -> DataFrame:
    """White-space separated lines; the fifth field is the object id and routes the request."""
    keep = [c for c in lines.columns if c != "value"]
    fields = F.col("_fields")
    return (
        _split_once(lines, keep, SIMPLE_SEPARATOR)
        .where((F.size(fields) >= SIMPLE_MIN_COLUMNS) & _is_whole(fields[NUMBER_COLUMN]))
        .select(*keep, fields[NUMBER_COLUMN].try_cast("bigint").alias("object_id"))
        .where(F.col("object_id").isNotNull())
        .withColumn("node_id", route(F.col("object_id"), n_nodes))
    )


def read_request_log(spark: SparkSession, path: str, land: str | None = None) -> DataFrame:
    return parse_request_lines(read_lines(spark, path, land))


def read_simple_log(spark: SparkSession, path: str, n_nodes: int, land: str | None = None) -> DataFrame:
    return parse_simple_lines(read_lines(spark, path, land), n_nodes)


def follow_simple_log(spark: SparkSession, folder: str, n_nodes: int, **options: str) -> DataFrame:
    """Stream of the requests in files that arrive in a folder."""
    lines = spark.readStream.options(**options).text(folder)
    return parse_simple_lines(lines.select("value"), n_nodes)
