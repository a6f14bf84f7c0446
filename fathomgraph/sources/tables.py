"""Parquet tables by name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingTable(FileNotFoundError):
    """A folder lacks a table that a question needs."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise MissingTable(f"{folder} has no table {name}") from e
        raise


def metadata_value(metadata: DataFrame, key: str) -> str | None:
    """The value of a key of metadata(key, value); the greatest, should it stand there several times; None without it."""
    return metadata.filter(F.col("key") == key).agg(F.max("value")).first()[0]


def extraction_coverage(rows: DataFrame) -> DataFrame:
    """(file, language, gaps) of rows(file_path, language, payload_json): gaps is the array of kinds of what could not be read; empty for broken payloads."""
    gaps = F.from_json("payload_json", "struct<gaps:array<struct<kind:string,line:int>>>")["gaps"]
    return rows.select(F.col("file_path").alias("file"), "language", F.coalesce(F.transform(gaps, lambda g: g["kind"]), F.array().cast("array<string>")).alias("gaps"))
