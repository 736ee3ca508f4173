"""The audit against a loop over documents, orders and steps."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from statloom.llm import audit
from tests.llm import nasty


def failed(rows):
    """``part, letters, doc_id`` of ``(doc_id, text, lang)``."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
        fails += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (d is not None and least[t] < d)
        out.append((lang or "", fails, d))
    return out


def brute(rows, good, toxic):
    known, out, totals = failed(rows), {}, {}
    for part in {p for p, _, _ in known}:
        mine = [(f, d) for p, f, d in known if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                redundant = sum(letter in f for f, _ in mine) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(f == letter for f, _ in mine), sum(d in good for _, d in gone), sum(d in toxic for _, d in gone)]
                totals[part, letter] = totals.get((part, letter), 0) + len(gone)
    return {(p, o, s): (*x, totals[p, o[s - 1]]) for (p, o, s), x in out.items()}


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def texts():
    long = nasty.sentence(1, 6000)
    return [*nasty.texts(), "", None, long, long[:-1] + "x", "X" + long[1:], "ABC DEF", "a # b", "$", "é" * 64, "é" * 65, "é" * 64, "x" * 64 + "y", "x" * 64 + "z", "x" * 64 + "y", "A\x0bB\x0cC"]


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, n int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(docs, marks).collect()
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in NAMES) for r in got} == brute(rows, good, toxic)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


LABELS = [(0, 1, 0), (3, 0, 1), (6, 1, 1), (6, None, 0), (9, 1, None), (12, 0, 1), (None, 1, 1), (15, 1, 0), (999, 1, 1), (60, 1, 1), (63, 1, 1)]


def test_awkward_documents(spark):
    rows = [(i * 3, t, [None, "en", "de", ""][i % 4]) for i, t in enumerate(texts())]
    rows += [rows[0], (rows[1][0], "another text of a repeated id", "en"), (None, rows[0][1], "en"), (None, None, None), (-5, "", "fr")]
    check(spark, rows, LABELS)


def test_equal_hashes_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(audit, "_hash", lambda before, block: F.lit(7).cast("long"))
    rows = [(i * 3, t, "en") for i, t in enumerate(texts())]
    assert audit.repeated(spark.createDataFrame(rows, "doc_id long, text string, lang string"))[1]
    check(spark, rows, LABELS)


@pytest.mark.parametrize("copies", [1, 40])
def test_copies_and_lengths(spark, copies):
    rows = [(1000 + i, "same words here " * 30, "en") for i in range(copies)] + [(i, "q" * i, "en") for i in range(1, 90)]
    check(spark, rows, LABELS)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect() == []
