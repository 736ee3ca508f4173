"""Ordered and streaming operators: drift detectors and event-time windows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.plans.lineage import shared_dir


class DDM:
    """Drift by error rate: warns at two deviations above the least, drifts at three."""

    def __init__(self, warn: float = 2.0, drift: float = 3.0, least: int = 30) -> None:
        self.warn_at, self.drift_at, self.least = warn, drift, least
        self.reset()

    def reset(self) -> None:
        self.n = self.bad = 0
        self.low_p = self.low_s = math.inf

    def add(self, ok: bool) -> str:
        """``ok``, ``warning`` or ``drift`` after one more outcome."""
        self.n += 1
        self.bad += not ok
        p = self.bad / self.n
        s = math.sqrt(p * (1 - p) / self.n)
        if self.n < self.least:
            return "ok"
        if p + s < self.low_p + self.low_s:
            self.low_p, self.low_s = p, s
        if p + s > self.low_p + self.drift_at * self.low_s:
            return "drift"
        return "warning" if p + s > self.low_p + self.warn_at * self.low_s else "ok"


class ADWIN:
    """Drift of a mean by an adaptive window of exponential buckets."""

    def __init__(self, delta: float = 0.002, most: int = 5) -> None:
        self.delta, self.most = delta, most
        self.buckets: list[list[tuple[float, float]]] = [[]]  # level -> (sum, sum of squares) of 2**level values
        self.n, self.total, self.squares = 0, 0.0, 0.0

    def add(self, x: float) -> bool:
        """Whether the window was cut."""
        self.n, self.total, self.squares = self.n + 1, self.total + x, self.squares + x * x
        self.buckets[0].append((x, x * x))
        for level in range(len(self.buckets)):
            if len(self.buckets[level]) <= self.most:
                break
            (a, aa), (b, bb) = self.buckets[level][:2]
            del self.buckets[level][:2]
            if level + 1 == len(self.buckets):
                self.buckets.append([])
            self.buckets[level + 1].append((a + b, aa + bb))
        found = False
        while self._cut():
            found = True
        return found

    def _cut(self) -> bool:
        if self.n < 2:
            return False
        var = max(self.squares / self.n - (self.total / self.n) ** 2, 0.0)
        d = math.log(2 * math.log(max(self.n, 3)) / self.delta)
        n0, s0 = 0, 0.0
        for level in range(len(self.buckets) - 1, -1, -1):
            for s, _ in self.buckets[level]:
                n0, s0 = n0 + 2**level, s0 + s
                n1 = self.n - n0
                if n0 < 5 or n1 < 5:
                    continue
                m = 1 / (1 / n0 + 1 / n1)
                if abs(s0 / n0 - (self.total - s0) / n1) > math.sqrt(2 / m * var * d) + 2 / (3 * m) * d:
                    top = max(i for i, b in enumerate(self.buckets) if b)
                    a, aa = self.buckets[top].pop(0)
                    self.n, self.total, self.squares = self.n - 2**top, self.total - a, self.squares - aa
                    return True
        return False


def _folded(df: DataFrame, key: str, order: Sequence[str], value: str, schema: str, start: Callable[[], Callable[[int, object], list[tuple]]]) -> DataFrame:
    """Folds each key's values in order: ``start()`` makes a function of (place, value) that returns rows.

    Rows are sorted by Spark and stream through; a task holds a key's state and
    one batch, whatever the key's length.
    """
    own = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = rows.repartition("key").sortWithinPartitions("key", *[f"o{i}" for i in range(len(order))]).select("key", "value")
    names = ["key", *[part.split()[0] for part in schema.split(", ")]]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step, i = object(), None, 0
        for batch in batches:
            out = []
            keys, values = (batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in ("key", "value"))
            for k, x in zip(keys, values):
                if k != at:
                    at, step, i = k, start(), 0
                i += 1
                out += [(k, i, *row) for row in step(i, x)]
            if out:
                yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(task, f"key {own}, {schema}").withColumnRenamed("key", key)


def ddm(df: DataFrame, key: str, order: Sequence[str], ok: str) -> DataFrame:
    """``key, at, state`` for every warning and drift; ``at`` counts the key's rows from 1. A null outcome is a miss."""

    def start() -> Callable:
        detector = DDM()

        def step(_: int, x: object) -> list[tuple]:
            state = detector.add(bool(x))
            if state == "drift":
                detector.reset()
            return [] if state == "ok" else [(state,)]

        return step

    return _folded(df, key, order, ok, "at long, state string", start)


def adwin(df: DataFrame, key: str, order: Sequence[str], value: str, delta: float = 0.002) -> DataFrame:
    """``key, at, width``: where the window was cut and how wide it is then; nulls are no values but count in ``at``."""

    def start() -> Callable:
        detector = ADWIN(delta)
        return lambda _, x: [(detector.n,)] if x is not None and detector.add(float(x)) else []

    return _folded(df, key, order, value, "at long, width long", start)


def ema(df: DataFrame, key: str, order: Sequence[str], value: str, smoothing: float = 0.1) -> DataFrame:
    """``key, at, mean, variance``: exponential moving statistics of each key's rows that have a value."""

    def start() -> Callable:
        state = [None, 0.0]

        def step(_: int, x: object) -> list[tuple]:
            if x is None:
                return []
            if state[0] is None:
                state[0] = float(x)
            else:
                d = float(x) - state[0]
                state[0] += smoothing * d
                state[1] = (1 - smoothing) * (state[1] + smoothing * d * d)
            return [tuple(state)]

        return step

    return _folded(df, key, order, value, "at long, mean double, variance double", start)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream."""
    table = spark.read.parquet(path)
    files = table.inputFiles()
    folder, name = path.rstrip("/").rsplit("/", 1)
    source = spark.readStream.schema(table.schema)
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # a stream reads folders
        return source.option("pathGlobFilter", name).parquet(folder)
    return source.parquet(path)


def finished(out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into a table of the shared folder, and reads it.

    In complete mode each batch's whole result replaces the one before.
    """
    spark = out.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "complete":
        q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    else:
        q = writer.format("parquet").option("path", path).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def tumbling(spark: SparkSession, path: str, width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of an events stream by type and event-time window, with what is there now.

    State and result are in the shared folder; complete mode gives the open
    windows too.
    """
    events = read_stream(spark, path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    sums = events.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return finished(sums, "complete").select("event_type", F.col("window.start").alias("start"), "n", "total")
