"""LIBSVM text: ``label index:value ...`` with 1-based indexes; zeros are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, dims: int, label: str = "target", vector: str = "v") -> DataFrame:
    """``label, vector`` (dense array of ``dims``); blank lines are skipped."""
    line = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p"))
    pairs = F.map_from_entries(F.transform(F.slice("p", 2, F.size("p")), lambda x: F.struct(F.split(x, ":")[0].cast("int"), F.split(x, ":")[1].cast("double"))))
    made = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0.0)))
    return line.select(F.col("p")[0].cast("double").alias(label), pairs.alias("m")).select(label, made.alias(vector))


def write(df: DataFrame, path: str, label: str, vector: str) -> None:
    pairs = F.zip_with(F.sequence(F.lit(1), F.size(vector)), F.col(vector), lambda i, x: F.when(x != 0, F.concat(i.cast("string"), F.lit(":"), x.cast("string"))))
    df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_compact(pairs)).alias("value")).write.text(path)
