"""A typed container of a data set: Parquet with the smallest exact number types, category names and roles.

``manifest`` beside the data (one row a column) tells each column's role
(numeric, category, target or weight) and a category's names in code order.
Numbers are stored as bytes, shorts, floats or doubles: by ``auto`` the
smallest type that holds all values exactly, or the one asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORAGE = {"byte": "tinyint", "short": "smallint", "fp32": "float", "fp64": "double"}


def _smallest(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The smallest type that holds each column, from one aggregation over all rows."""
    if not columns:
        return {}
    test = []
    for c in columns:
        x = F.col(c).cast("double")
        whole = F.coalesce(F.min(F.when(F.isnan(x), False).otherwise(x == F.floor(x)).cast("int")), F.lit(1))
        short = F.coalesce(F.min(F.when(F.isnan(x), True).otherwise(x.cast("float").cast("double") == x).cast("int")), F.lit(1))
        test += [whole.alias(f"w_{c}"), short.alias(f"f_{c}"), F.min(x).alias(f"lo_{c}"), F.max(x).alias(f"hi_{c}")]
    r = df.agg(*test).first()
    out = {}
    for c in columns:
        low, high = r[f"lo_{c}"] or 0, r[f"hi_{c}"] or 0
        if r[f"w_{c}"] and -128 <= low and high <= 127:
            out[c] = "byte"
        elif r[f"w_{c}"] and -32768 <= low and high <= 32767:
            out[c] = "short"
        else:
            out[c] = "fp32" if r[f"f_{c}"] else "fp64"
    return out


def write(df: DataFrame, path: str, numeric: Sequence[str], categories: Sequence[str] = (), target: str | None = None, weight: str | None = None, storage: str = "auto") -> None:
    """Writes the named columns; others are left out."""
    numbers = [*numeric, *([target] if target and target not in categories else []), *([weight] if weight else [])]
    kinds = _smallest(df, numbers) if storage == "auto" else dict.fromkeys(numbers, storage)
    names = {c: [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).toLocalIterator()] for c in categories}
    role = lambda c: "target" if c == target else "weight" if c == weight else "category" if c in names else "numeric"
    code = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(v) for v in names[c]]), F.col(c)) - 1, F.lit(-1)).cast("int") if names[c] else F.lit(-1)
    columns = [code(c).alias(c) if c in names else F.col(c).cast(STORAGE[kinds[c]]).alias(c) for c in df.columns if c in names or c in kinds]
    df.select(*columns).write.option("compression", "zstd").parquet(f"{path}/data")
    rows = [(i, c, role(c), kinds.get(c, ""), [str(v) for v in names.get(c, [])]) for i, c in enumerate(c for c in df.columns if c in names or c in kinds)]
    df.sparkSession.createDataFrame(rows, "at int, name string, role string, storage string, names array<string>").coalesce(1).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest").orderBy("at")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table with doubles and category names; a missing category is null."""
    data, columns = spark.read.parquet(f"{path}/data"), []
    for r in manifest(spark, path).collect():  # a row a column
        if r.names or r.role == "category":
            columns.append((F.get(F.array(*[F.lit(v) for v in r.names]), F.when(F.col(r["name"]) >= 0, F.col(r["name"]))) if r.names else F.lit(None).cast("string")).alias(r["name"]))
        else:
            columns.append(F.col(r["name"]).cast("double").alias(r["name"]))
    return data.select(*columns)
