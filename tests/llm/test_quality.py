"""The rule ensemble: compiled scores equal the model's, and held-out accuracy."""

import math
import zlib

import numpy as np
import regex
from pyspark.sql import functions as F

from statloom.llm import quality
from tests.llm import nasty


def test_held_out_accuracy_and_compiled_rules(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    stats = quality.statistics(F.col("text"))
    got = quality.score(docs, model).select("doc_id", "score", "predicted", quality.held_out(F.col("doc_id")).alias("out"), *[c.cast("double").alias(k) for k, c in stats.items()]).toPandas()
    assert np.allclose(model.predict(got[model.names].to_numpy(float)), got["score"])
    assert (got["out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    test = got[got["out"]].merge(labels.toPandas(), on="doc_id")
    assert (test["predicted"] == test["quality"]).mean() > 0.95
    assert len(model.rules) < 200


def test_awkward_documents_and_labels(spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, 1), (6, None), (9, 0), (12, 1), (15, 0), (None, 1), (18, 0), (33, 1)], "doc_id long, quality int")
    model = quality.train(nasty.docs(spark), labels)
    got = quality.score(nasty.docs(spark), model)
    assert set(nasty.docs(spark).columns) == set(got.columns)
    rows = got.collect()
    assert len(rows) == len(nasty.rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(nasty.docs(spark), none)
    assert model.rules == []
    assert quality.score(nasty.none(spark), model).count() == 0


def brute(text):
    """The statistics again, over Python strings."""
    t = text or ""
    n = len(t)
    count = lambda cls: n - len(regex.sub(f"[{cls}]+", "", t))
    words, lines = regex.sub(r"[\x20\x09-\x0D]+", " ", t.lower()).split(" "), t.split("\n")
    chars, kinds = max(n, 1), set(words)
    return {
        "log_chars": math.log1p(n), "log_words": math.log1p(len(words)), "word_length": n / len(words), "upper": count(r"\p{Lu}") / chars, "letters": count(r"\p{L}") / chars, "digits": count("0-9") / chars,
        "space": count(r"\x20\x09-\x0D") / chars, "stops_dots": count(".,;:?") / chars, "signs": count(r"#$%&*+<=>@\\^_`|~{}\[\]/") / chars, "bangs": count("!") / chars, "distinct_words": len(kinds) / len(words),
        "stop_kinds": len(kinds & set(quality.STOP_WORDS)) / math.sqrt(len(words)), "distinct_lines": len(set(lines)) / len(lines), "line_words": math.log1p(len(words) / len(lines)), "log_lines": math.log1p(len(lines)),
    }


def test_statistics_and_scores_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(nasty.docs(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = quality.score(docs, model).select("text", "score", "predicted", *[c.cast("double").alias(k) for k, c in quality.statistics(F.col("text")).items()]).collect()
    for r in rows:
        want = brute(r.text)
        assert all(abs(r[k] - v) < 1e-9 for k, v in want.items()), {k: (r[k], v) for k, v in want.items() if abs(r[k] - v) >= 1e-9}
        z = model.bias
        for path, w in zip(model.rules, model.weights):
            z += w * all(want[model.names[j]] <= c if low else want[model.names[j]] > c for j, low, c in path)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.7)
