"""Kernel least squares over a dictionary that grows only by rows it cannot express.

A row joins the dictionary if its image in the kernel's space is further than the tolerance
from every combination of those held (approximate linear dependence). Tasks make
dictionaries of their own rows, which are merged by the same test in groups of bounded number;
all rows are then sums over the dictionary's coordinates. These sums are what an
update adds to: rows seen before keep their coordinates, with nothing on newer entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.models.base import ArrayModel, Learner, Model
from statloom.models.linear import array_sum
from statloom.plans.lineage import cut

#: Dictionaries that one task merges, and the most entries (the sums take their square).
TOGETHER, MOST = 16, 4096

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Dictionary:
    """Rows of which none is, within the tolerance, a combination of those before it."""

    def __init__(self, kernel: Kernel, tolerance: float, rows: np.ndarray | None = None) -> None:
        self.kernel, self.tolerance = kernel, tolerance
        self.rows = rows if rows is not None and len(rows) else None
        self.inverse = np.linalg.inv(kernel(rows, rows)) if self.rows is not None else np.zeros((0, 0))

    def take(self, x: np.ndarray) -> bool:
        """Whether the row was not expressed by the others and joined."""
        own = float(self.kernel(x[None, :], x[None, :])[0, 0])
        if self.rows is None:
            if own <= self.tolerance:
                return False
            self.rows, self.inverse = x[None, :].copy(), np.array([[1 / own]])
            return True
        k = self.kernel(self.rows, x[None, :])[:, 0]
        a = self.inverse @ k
        left = own - k @ a
        if left <= self.tolerance:
            return False
        n = len(self.rows)
        bigger = np.empty((n + 1, n + 1))
        bigger[:n, :n] = self.inverse + np.outer(a, a) / left
        bigger[:n, n] = bigger[n, :n] = -a / left
        bigger[n, n] = 1 / left
        self.rows, self.inverse = np.vstack((self.rows, x)), bigger
        return True

    def take_all(self, x: np.ndarray) -> None:
        """Adds rows in order; those that the entries so far express are passed over together."""
        at = 0
        while at < len(x):
            some = x[at : at + 256]
            if self.rows is not None:
                k = self.kernel(some, self.rows)
                own = np.array([self.kernel(r[None, :], r[None, :])[0, 0] for r in some])
                some = some[own - ((k @ self.inverse) * k).sum(axis=1) > self.tolerance]
            for r in some:
                self.take(r)
            at += 256


class KernelRls(Learner):
    """Recursive kernel least squares; ``penalty`` is that of kernel ridge regression.

    With a tolerance of nothing it is kernel ridge regression itself. The
    dictionary has ``most`` entries at most, beyond which a larger tolerance must be asked
    for. ``update`` goes on with more rows. Rows without features or label take no part.
    """

    def __init__(self, kernel: Kernel, tolerance: float = 1e-3, penalty: float = 1e-3, most: int = MOST) -> None:
        self.kernel, self.tolerance, self.penalty, self.most = kernel, tolerance, penalty, most
        self.dictionary, self.products, self.targets = None, np.zeros((0, 0)), np.zeros(0)

    def _grown(self, df: DataFrame) -> np.ndarray:
        """The dictionary after the rows of a table, which tasks and then groups of tasks reduce."""
        kernel, tolerance, held, most = self.kernel, self.tolerance, self.dictionary, self.most

        def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine = Dictionary(kernel, tolerance, held)
            old = 0 if held is None else len(held)
            for batch in batches:
                if len(batch):
                    mine.take_all(np.stack(batch["features"]).astype(float))
                if mine.rows is not None and len(mine.rows) > most:
                    raise ValueError(f"more than {most} rows are no combination of others: raise the tolerance")
            new = [] if mine.rows is None else list(mine.rows[old:])
            if new:
                yield pd.DataFrame({"features": new})

        some = cut(df.select("features").mapInPandas(reduce, "features array<double>").withColumn("task", F.spark_partition_id()))
        tasks = some.select("task").distinct().count()
        while tasks > 1:
            tasks = -(-tasks // TOGETHER)
            merged = some.withColumn("grp", F.col("task") % tasks).repartition(tasks, "grp").sortWithinPartitions("grp", "task", "features")
            some = cut(merged.select("features").mapInPandas(reduce, "features array<double>").withColumn("task", F.spark_partition_id()))
        rows = np.array([r.features for r in some.select("features").orderBy("features").limit(most + 1).collect()], dtype=float)
        out = Dictionary(kernel, tolerance, held)
        out.take_all(rows)
        if out.rows is not None and len(out.rows) > most:
            raise ValueError(f"more than {most} rows are no combination of others: raise the tolerance")
        return out.rows

    def fit(self, df: DataFrame) -> Model:
        self.dictionary, self.products, self.targets = None, np.zeros((0, 0)), np.zeros(0)
        return self.update(df)

    def update(self, df: DataFrame) -> Model:
        """The model after more rows."""
        rows = df.where("features is not null and label is not null").select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"))
        held = self._grown(rows)
        if held is None:
            return ArrayModel(lambda x: np.zeros(len(x)))
        n, kernel = len(held), self.kernel
        gram = kernel(held, held)
        inverse = np.linalg.inv(gram)

        def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            a = kernel(x, held) @ inverse
            return np.concatenate(((a.T @ a).ravel(), a.T @ y))

        new = array_sum(rows, sums, n * n + n)
        products, targets = new[: n * n].reshape(n, n), new[n * n :]
        old = len(self.targets)
        products[:old, :old] += self.products
        targets[:old] += self.targets
        self.dictionary, self.products, self.targets = held, products, targets
        weights = inverse @ np.linalg.solve(products + self.penalty * inverse, targets)
        return ArrayModel(lambda x: kernel(x, held) @ weights)
