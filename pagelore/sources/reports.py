"""Reports as folders: each part as lines of JSON, and one row of facts about them that is written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(path: str, head: DataFrame, **parts: DataFrame) -> None:
    """``parts`` under their names, then ``head``, one row. A report that was cut off has no head, so it isn't read as whole;
    one that is there isn't overwritten."""
    for name, rows in parts.items():
        rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/{name}")
    head.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/head")


def read_head(spark: SparkSession, path: str) -> dict:
    return spark.read.json(f"{path}/head").first().asDict(recursive=True)


def read_part(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A part of a whole report; an error where the report has no head."""
    read_head(spark, path)
    return spark.read.schema(schema).json(f"{path}/{name}")
