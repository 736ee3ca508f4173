"""Text corpora as tables: folders of files, labelled by folder, and their weighted or hashed vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.text import tokens

#: Most hashed columns whose frequencies are broadcast.
COLUMNS = 1 << 20


def read_files(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    """``path, text`` of every file below a folder; with ``labelled`` the file's own folder is ``label``."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.withColumn("label", F.element_at(F.split("path", "/"), -2)) if labelled else df


def vocabulary(docs: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """``token, at, df``: every token in at least ``least`` documents, numbered in order of its hash and name."""
    words = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    from statloom.operators.dataset import ordered_position

    return ordered_position(words, "token", 0).select("token", F.col("__at").alias("at"), "df")


def vectors(docs: DataFrame, key: str, words: DataFrame, text: str = "text") -> DataFrame:
    """``key, vec``: counts of known tokens as a map from number to count."""
    counts = docs.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").cast("double").alias("n"))
    return counts.join(words, "token").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("vec"))


def bucket(token: Column, size: int) -> Column:
    """A token's number among ``size`` by hash."""
    return F.pmod(F.xxhash64(token), F.lit(size)).cast("int")


def hashed_vectors(docs: DataFrame, key: str, size: int = 1 << 18, text: str = "text", idf: bool = False) -> DataFrame:
    """``key, vec``: counts of hashed tokens (those of one number add up); ``idf`` multiplies by ln(documents / documents with it). Documents without tokens have an empty one."""
    token = F.col("token")
    counts = docs.select(key, text).repartition(key).select(key, F.explode_outer(tokens(F.col(text))).alias("token")).groupBy(key, F.when(token.isNotNull(), bucket(token, size)).alias("at")).agg(F.count("*").cast("double").alias("n"))
    if idf:
        total = docs.count()
        df = counts.where("at is not null").groupBy("at").agg(F.count("*").alias("df"))
        counts = counts.join(F.broadcast(df) if size <= COLUMNS else df, "at", "left").select(key, "at", (F.col("n") * F.log(total / F.col("df"))).alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "n")))).alias("vec"))
