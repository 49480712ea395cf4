"""Course files as documents (SRC1-SRC7): texts and notebooks of the course_files source, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import path_part, strip
from larkspur.sources import coursefiles


def files(spark: SparkSession, root: str) -> DataFrame:
    """SRC1, SRC4: (source_path, file_name, file_type, week, day, content) of each file below a folder."""
    path = F.col("source_path")
    return coursefiles.read(spark, root).select(
        path, F.substring_index(path, "/", -1).alias("file_name"), F.lower(F.substring_index(path, ".", -1)).alias("file_type"), path_part(path, "week").alias("week"), path_part(path, "day").alias("day"), "content"
    )


def decoded(content: Column) -> Column:
    """SRC2: UTF-8, invalid bytes dropped, line ends as LF. Every character that the bytes hold stays, replacement characters and private ones as well.

    Bytes that are whole are read as they are. Others are cut at the bytes of a replacement character, which no other character contains; what Spark puts
    for invalid bytes in between is then told from those that were there.
    """
    raw = content.cast("string")
    pieces = F.split(F.decode(content, "ISO-8859-1"), "\u00ef\u00bf\u00bd", -1)
    loose = F.array_join(F.transform(pieces, lambda p: F.replace(F.make_valid_utf8(F.encode(p, "ISO-8859-1").cast("string")), F.lit("\ufffd"), F.lit(""))), "\ufffd")
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(raw), loose), r"\r\n?", "\n")


def notebook(text: Column) -> Column:
    """SRC3: cells of a notebook, one after the other; a source is a string or a list of strings."""
    v = F.try_parse_json(text)
    cells = F.try_variant_get(v, "$.cells", "array<variant>")

    def one(c: Column) -> Column:
        kind = F.coalesce(F.try_variant_get(c, "$.cell_type", "string"), F.lit("unknown"))
        lines = F.try_variant_get(c, "$.source", "array<string>")
        source = F.coalesce(F.array_join(lines, ""), F.try_variant_get(c, "$.source", "string"), F.lit(""))
        return F.concat(F.lit("\n["), kind, F.lit(" cell]\n"), source)

    return F.array_join(F.transform(cells, one), "\n")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """SRC5: documents with their stripped text."""
    text = decoded(F.col("content"))
    rows = files(spark, root).withColumn("text", F.when(F.col("file_type") == "ipynb", notebook(text)).otherwise(text))
    return rows.select(F.col("source_path").alias("id"), strip(F.col("text")).alias("text"), "source_path", "file_name", "file_type", "week", "day")


def write_json(df: DataFrame, path: str, text: str = "text") -> None:
    """SRC6, SRC7: rows with a text, as JSON lines."""
    df.where(F.coalesce(F.col(text), F.lit("")) != "").write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)
