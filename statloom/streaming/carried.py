"""Folds and learners over streams, whose state is stored with the number of its batch.

A batch begins from the state stored by the batch before and stores its own
beside its results, both under its number. A batch that is run again, after a failure or a
restart, begins from the same state and replaces what it wrote, so each row counts once.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.models.base import Model
from statloom.models.online import OnlineLinear
from statloom.plans.lineage import cut, shared_dir
from statloom.streaming.drift import ADWIN, DDM


class DdmFold:
    """Warnings and drifts of outcomes; a null outcome is a miss."""

    schema = "state string"

    def __init__(self, **options) -> None:
        self.detector = DDM(**options)

    def add(self, x: object) -> list[tuple]:
        state = self.detector.add(bool(x))
        if state == "drift":
            self.detector.reset()
        return [] if state == "ok" else [(state,)]


class AdwinFold:
    """Cuts of a window of values and its width then; nulls are no values."""

    schema = "width long"

    def __init__(self, delta: float = 0.002) -> None:
        self.detector = ADWIN(delta)

    def add(self, x: object) -> list[tuple]:
        return [(self.detector.n,)] if x is not None and self.detector.add(float(x)) else []


class EmaFold:
    """Exponential moving mean and variance of values; nulls are no values."""

    schema = "mean double, variance double"

    def __init__(self, smoothing: float = 0.1) -> None:
        self.smoothing, self.mean, self.variance = smoothing, None, 0.0

    def add(self, x: object) -> list[tuple]:
        if x is None:
            return []
        if self.mean is None:
            self.mean = float(x)
        else:
            d = float(x) - self.mean
            self.mean += self.smoothing * d
            self.variance = (1 - self.smoothing) * (self.variance + self.smoothing * d * d)
        return [(self.mean, self.variance)]


def _ran(stream: DataFrame, path: str, step: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over what is there now, batch by batch, from where the last run under ``path`` ended."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def _place(spark: SparkSession, path: str | None) -> str:
    return path.rstrip("/") if path else f"{shared_dir(spark)}/carried-{uuid.uuid4().hex}"


def fold(stream: DataFrame, key: str, order: Sequence[str], value: str, make: Callable[[], object], schema: str, path: str | None = None) -> DataFrame:
    """``key, at`` and the columns of ``schema`` from folding each key's values, as a table of all batches so far.

    ``make()`` gives a fold as those of this module: ``add(value)`` returns rows, and the
    object is the state of a key. ``at`` counts the key's rows from 1 over all batches. In a batch rows go by
    ``order``; rows that come in a later batch count there. With ``path`` a
    later call goes on where the last one ended. A task holds one key's state and one Arrow
    batch, whatever a key's length; rows of a null key are a key of their own.
    """
    spark, path = stream.sparkSession, _place(stream.sparkSession, path)
    kind = stream.schema[key].dataType.simpleString()
    names = [part.split()[0] for part in schema.split(", ")]
    result = f"key {kind}, at long, {schema}"

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none, here, held, at, count = object(), object(), None, 0, 0
        here = none

        def kept() -> list[tuple]:
            return [] if here is none else [(here, at, *[None] * len(names), pickle.dumps(held))]

        for batch in batches:
            out = []
            keys, values = (batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in ("key", "value"))
            for k, x, saved, since in zip(keys, values, batch["saved"], batch["since"].tolist()):
                if here is none or k != here:
                    out += kept()
                    here, held, at = k, make(), 0
                if saved is not None:
                    held, at = pickle.loads(saved), int(since)
                    continue
                at += 1
                out += [(k, at, *row, None) for row in held.add(x)]
            count += len(batch)
            if out:
                yield pd.DataFrame(out, columns=["key", "at", *names, "saved"])
        if count:
            yield pd.DataFrame(kept(), columns=["key", "at", *names, "saved"])

    def step(batch: DataFrame, number: int) -> None:
        own = batch.select(F.col(key).alias("key"), F.col(value).alias("value"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
        rows = own.withColumns({"saved": F.lit(None).cast("binary"), "since": F.lit(0).cast("long"), "kind": F.lit(1)})
        if number:
            before = spark.read.schema(f"key {kind}, at long, saved binary").parquet(f"{path}/state/{number - 1}")
            blank = {c: F.lit(None).cast(own.schema[c].dataType) for c in own.columns if c != "key"}
            rows = rows.unionByName(before.select("key", "saved", F.col("at").alias("since")).withColumns(blank).withColumn("kind", F.lit(0)))
        rows = rows.repartition("key").sortWithinPartitions("key", "kind", *[f"o{i}" for i in range(len(order))])
        made = cut(rows.select("key", "value", "saved", "since").mapInPandas(task, f"{result}, saved binary"))
        made.where("saved is null").drop("saved").write.mode("overwrite").parquet(f"{path}/rows/{number}")
        made.where("saved is not null").select("key", "at", "saved").write.mode("overwrite").parquet(f"{path}/state/{number}")

    _ran(stream, path, step)
    if not _numbers(spark, f"{path}/rows"):  # no batch yet
        return spark.createDataFrame([], result).withColumnRenamed("key", key)
    out = spark.read.schema(result).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    return out.withColumnRenamed("key", key)


def ddm(stream: DataFrame, key: str, order: Sequence[str], ok: str, path: str | None = None) -> DataFrame:
    """``drift.ddm`` of a stream."""
    return fold(stream, key, order, ok, DdmFold, DdmFold.schema, path)


def adwin(stream: DataFrame, key: str, order: Sequence[str], value: str, delta: float = 0.002, path: str | None = None) -> DataFrame:
    """``drift.adwin`` of a stream."""
    return fold(stream, key, order, value, lambda: AdwinFold(delta), AdwinFold.schema, path)


def ema(stream: DataFrame, key: str, order: Sequence[str], value: str, smoothing: float = 0.1, path: str | None = None) -> DataFrame:
    """``drift.ema`` of a stream."""
    return fold(stream, key, order, value, lambda: EmaFold(smoothing), EmaFold.schema, path)


def learn(stream: DataFrame, learner: OnlineLinear, path: str | None = None) -> Model:
    """The model of an online learner after the batches so far, one pass over each; with ``path`` later calls go on.

    Each batch is learned as ``learner.update`` does: dealt to its workers and mixed.
    """
    spark, path = stream.sparkSession, _place(stream.sparkSession, path)

    def read(number: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        got = spark.read.schema("i int, w double, s double, t long").parquet(f"{path}/model/{number}").orderBy("i").collect()  # a row a dimension
        return (np.array([r.w for r in got if r.w is not None]), np.array([r.s for r in got]), got[0].t) if got else None

    def step(batch: DataFrame, number: int) -> None:
        state = learner.update(batch, read(number - 1) if number else None)
        both = zip_longest(state[0].tolist(), state[1].tolist()) if state else []
        rows = [(i, a, b, int(state[2])) for i, (a, b) in enumerate(both)]
        spark.createDataFrame(rows, "i int, w double, s double, t long").coalesce(1).write.mode("overwrite").parquet(f"{path}/model/{number}")

    _ran(stream, path, step)
    numbers = [int(n) for n in _numbers(spark, f"{path}/model")]
    return learner.model(read(max(numbers)) if numbers else None)


def _numbers(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
