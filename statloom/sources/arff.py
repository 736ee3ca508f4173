"""ARFF: attributes of kind real, numeric or integer, else nominal; ``%`` comments, ``?`` missing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMERIC = ("real", "numeric", "integer")


def read(spark: SparkSession, path: str, weight: str | None = None) -> DataFrame:
    """Numeric attributes as doubles, nominal ones as lower-case strings, both null where missing.

    With ``weight`` a row's ``{number}`` at its end becomes that column (1 if
    there is none). Only header lines come to the driver.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''").where(~F.col("line").startswith("%"))
    head = [r.line for r in lines.where(F.lower("line").startswith("@attribute")).toLocalIterator()]  # in file order
    names, kinds = [], []
    for line in head:
        m = re.match(r"@attribute\s+('[^']*'|\S+)\s+(\{.*\}|\S+)", line, re.I)
        names.append(m[1].strip("'"))
        kinds.append("double" if m[2].lower() in _NUMERIC else "string")
    parts = F.split("line", ",")
    data = lines.where(~F.col("line").rlike(r"(?i)^@(relation|attribute|data)\b"))
    mark = r",?\s*\{\s*([0-9.eE+-]+)\s*\}\s*$"
    given = F.regexp_extract("line", mark, 1)
    data = data.select(F.regexp_replace("line", mark, "").alias("line"), F.when(given != "", given.try_cast("double")).otherwise(1.0).alias("__w"))
    value = lambda i: F.when(F.trim(parts[i]) != "?", F.trim(parts[i]))
    own = [F.col("__w").alias(weight)] if weight else []
    return data.select(*own, *[(value(i).cast("double") if k == "double" else F.lower(value(i))).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])


def write(df: DataFrame, path: str, relation: str, weight: str | None = None) -> None:
    """A folder with a header part and data parts; nominal values are those that occur, ``weight`` names a column of row weights."""
    header = [f"@relation {relation}"]
    for name, kind in df.dtypes:
        if name == weight:
            continue
        if kind == "string":
            values = [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).toLocalIterator()]
            header.append(f"@attribute {name} {{{','.join(values)}}}")
        else:
            header.append(f"@attribute {name} real")
    header.append("@data")
    spark = df.sparkSession
    spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1).write.text(path)
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in df.columns if c != weight], *([F.concat(F.lit("{"), F.col(weight).cast("string"), F.lit("}"))] if weight else []))
    df.select(row.alias("value")).write.mode("append").text(path)
