"""Folds and learners over streams against the same over whole tables, with restarts and batches that run again."""

import os

import numpy as np
import pytest

from statloom.models.online import OnlineLinear, arow, passive_aggressive
from statloom.streaming import carried, drift


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ["a", "b", None][i % 5 % 3], float(rng.normal() + (3 if i % 1200 >= 700 else 0)) if i % 11 else None) for i in range(2400)]
    return spark.createDataFrame(rows, "i long, k string, x double")


def parts(df, folder, start, stop):
    """Files of 400 rows each, the later rows in later files."""
    for n in range(start, stop):
        df.where(f"i >= {400 * n} and i < {400 * n + 400}").coalesce(1).write.mode("append").parquet(f"file://{folder}")
        newest = max((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + 60 * n, 1_700_000_000 + 60 * n))


def stream(spark, df, folder):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kind", ["adwin", "ema", "ddm"])
def test_folds_equal_those_of_the_whole_table(spark, events, tmp_path, kind):
    src, path = f"{tmp_path}/s", f"file://{tmp_path}/state"
    df = events.selectExpr("i", "k", "x > 1 as x") if kind == "ddm" else events
    run = lambda: getattr(carried, kind)(stream(spark, df, src), "k", ["i"], "x", path=path)
    parts(df, src, 0, 3)
    run()
    parts(df, src, 3, 6)
    got = rows(run())
    want = rows(getattr(drift, kind)(df, "k", ["i"], "x"))
    assert want and got == want
    os.remove(f"{tmp_path}/state/progress/commits/5")  # as if the last batch had failed after it wrote
    crc = f"{tmp_path}/state/progress/commits/.5.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert rows(run()) == want


def test_learners_go_on(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1600, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.2 > 0).astype(float)
    df = spark.createDataFrame([(i, i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "i long, id long, features array<double>, label double")
    src = f"{tmp_path}/s"
    for rule in (passive_aggressive(), arow()):
        learner, path = OnlineLinear(rule, workers=2), f"file://{tmp_path}/{id(rule)}"
        if not os.path.exists(src):
            parts(df, src, 0, 2)
            carried.learn(stream(spark, df, src), learner, path)
            parts(df, src, 2, 4)
        model = carried.learn(stream(spark, df, src), learner, path)
        state = None
        for n in range(4):
            state = learner.update(df.where(f"i >= {400 * n} and i < {400 * n + 400}"), state)
        want = learner.model(state)
        assert [r.prediction for r in model.transform(df).orderBy("i").collect()] == [r.prediction for r in want.transform(df).orderBy("i").collect()]
        right = model.transform(df).where("prediction = label").count()
        assert right > 0.93 * 1600


def test_streams_without_rows(spark, events, tmp_path):
    events.limit(0).write.parquet(f"file://{tmp_path}/s")
    assert carried.ema(stream(spark, events, f"{tmp_path}/s"), "k", ["i"], "x", path=f"file://{tmp_path}/state").count() == 0
