"""Substring deduplication against brute force over all windows."""

import re

from pyspark.sql import functions as F

from statloom.llm.substrings import remove_repeats
from tests.llm import nasty


def brute(rows, span):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - span + 1):
            first.setdefault(tuple(words[i][j : j + span]), i)
    out = {}
    for i, w in words.items():
        stay = [True] * len(w)
        for j in range(len(w) - span + 1):
            if first[tuple(w[j : j + span])] < i:
                stay[j : j + span] = [False] * span
        out[i] = (len(w), stay.count(False), " ".join(x for x, s in zip(w, stay) if s))
    return out


def test_awkward_documents(spark):
    got = remove_repeats(nasty.docs(spark), 50).collect()
    assert len(got) == len(nasty.rows())
    want = brute([(r[0], r[1]) for r in nasty.rows() if r[0] is not None], 50)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got if r.doc_id is not None} == want
    assert [r.n_removed for r in got if r.doc_id is None] == [0]


def test_shared_passages_and_repeats_inside(spark):
    passage = nasty.sentence(50, 64)
    rows = [(i, f"{nasty.sentence(100 + i, 30)} {passage} {nasty.sentence(200 + i, 20)} {passage if i % 2 else ''}") for i in range(20)]
    rows.append((40, nasty.sentence(50, 64).replace(" ", "  ")))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 50)


def test_tables_without_rows_or_text(spark):
    assert remove_repeats(nasty.none(spark)).count() == 0
    empty = remove_repeats(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))).collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in empty] == [(0, 0, "")] * 3


def test_full_planes_pass_only_windows_of_shared_anchors(spark, monkeypatch):
    from statloom.llm import substrings

    counts = []

    def seen(df):
        made = cut(df)
        if "w1" in df.columns:
            counts.append(made.count())
        return made

    cut = substrings.cut
    monkeypatch.setattr(substrings, "cut", seen)
    monkeypatch.setattr(substrings, "LEAST_CELLS", 1 << 9)
    monkeypatch.setattr(substrings, "MOST_CELLS", 1 << 9)
    passage = nasty.sentence(50, 60)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(500)) + (f" {passage}" if i < 2 else "")) for i in range(40)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 50)
    assert len(counts) == 1 and 22 <= counts[0] <= 40 * 451 // 10  # two texts of far more anchors than cells


def test_sketches_never_estimate_too_low():
    """Counts of partitions, merged: an anchor of two documents is estimated at two or more, in a sketch of any size."""
    import numpy as np

    from statloom.llm import substrings

    rng = np.random.default_rng(1)
    for width in (1 << 4, 1 << 12):
        parts = [[np.unique(rng.integers(0, 5000, 60).astype(np.uint64)) for _ in range(10)] for _ in range(6)]
        merged, counts = np.zeros((substrings.DEPTH, 2, width), dtype=np.uint8), {}
        for docs in parts:
            own = np.zeros_like(merged)
            for lot in (docs[:4], docs[4:]):
                substrings._count(own, np.concatenate(lot))
            merged = substrings._add(merged, own)
            for doc in docs:
                for a in doc.tolist():
                    counts[a] = counts.get(a, 0) + 1
        keys = np.array(sorted(counts), dtype=np.uint64)
        twice = substrings._marked(merged[:, 1], keys)
        assert all(twice[[counts[k] > 1 for k in keys.tolist()]])
        if width == 1 << 12:
            assert twice.mean() < 0.75 and not twice.all()
        once = substrings._marked(merged[:, 0], keys)
        assert once.all()


def test_only_windows_estimated_repeated_are_grouped(spark, monkeypatch):
    from statloom.llm import substrings

    sizes = []
    merged = substrings._sketch.merged

    def seen(df, *rest):
        sizes.append((df.columns, df.count()))
        return merged(df, *rest)

    monkeypatch.setattr(substrings._sketch, "merged", seen)
    passage = nasty.sentence(50, 60)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(400)) + (f" {passage}" if i < 2 else "")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs).collect()}
    assert got == brute(rows, 50)
    assert [c for c, _ in sizes] == [["doc_id", "text"], ["a"]]  # documents are counted first, what the sketch lets through next
    assert 1 <= sizes[1][1] <= 12  # anchors of one passage
