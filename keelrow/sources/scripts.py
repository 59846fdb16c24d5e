"""Change scripts: text files with a forward and a backward part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelrow.functions.text import checksum, script_down, script_error, script_up


def read_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """Name and content of every .sql file of a folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.sql")
    # the metadata column keeps the plain file name
    return files.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def script_sections(scripts: DataFrame) -> DataFrame:
    """Both parts, the checksum of the forward part, and what is missing."""
    content = F.col("content")
    return scripts.select(
        "name", script_up(content).alias("up"), script_down(content).alias("down"),
        checksum(script_up(content)).alias("checksum"), script_error(content).alias("error"),
    )
