"""Delimited text: no quoting, ``#`` comments, empty fields are missing, ragged rows fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", comment: str | None = "#", skip_header: bool = False) -> DataFrame:
    options = {"sep": sep, "header": skip_header, "mode": "FAILFAST", "quote": "", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "enforceSchema": True}
    if comment:
        options["comment"] = comment
    return spark.read.options(**options).schema(schema).csv(path)


def write(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.options(sep=sep, quote="", emptyValue="", nullValue="").csv(path)
