"""Substring deduplication behind a count-min sketch.

A window is ``span`` consecutive words of one document. Its anchor is the least
hash among the short word runs inside it: equal windows have equal anchors, so
the number of documents with an anchor is at least that with any of its windows, and
there are only some ``2 / (span - GRAM + 2)`` anchors a word to count.

Every partition counts its documents' anchors in a count-min sketch whose
counters stay at two; the sketches are merged by addition and estimate, never too
low, in how many documents a window is. Windows estimated at one are
done with. Of the others, first the anchors are grouped exactly, those of two documents
are marked in bit planes, and then a second pass groups exactly the windows
under a marked anchor. A sketch too small for a corpus, and planes, let more through,
which costs rows and never a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import _sketch
from statloom.llm._memory import release, trimmed
from statloom.llm._words import distinct, grams, hashes, mix, windows, words
from statloom.plans.lineage import cut, small, sweep

#: Words of the runs that anchors are chosen from.
GRAM = 8
#: Rows of the sketch, and bit planes of shared anchors; the least and most cells of each (a sketch has two bits a cell).
DEPTH, LEAST_CELLS, MOST_CELLS = 2, 1 << 18, 1 << 26


def _anchors(h: np.ndarray, span: int) -> np.ndarray:
    """The anchor of every window; equal windows have equal ones."""
    g = grams(h, min(GRAM, span))
    reach = span - min(GRAM, span) + 1
    return sliding_window_view(g, reach).min(axis=1) if len(h) >= span else g[:0]


def _cell(anchors: np.ndarray, row: int, cells: int) -> np.ndarray:
    return mix(anchors, 21 + row) % np.uint64(cells)


def _cells_for(n_anchors: int) -> int:
    """Sixteen cells an anchor, within the fixed bounds."""
    return int(min(MOST_CELLS, max(LEAST_CELLS, 1 << max(1, 16 * n_anchors - 1).bit_length())))


def _count(own: np.ndarray, anchors: np.ndarray) -> None:
    """Adds anchors, each once a document: ``own[row]`` has a plane of counters of one or more and one of two or more."""
    for row in range(DEPTH):
        cells, n = np.unique(_cell(anchors, row, 8 * own.shape[2]), return_counts=True)
        _sketch.put(own[row, 1], cells[(n > 1) | _sketch.has(own[row, 0], cells)])
        _sketch.put(own[row, 0], cells)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two sketches, counters staying at two."""
    a[:, 1] |= b[:, 1] | (a[:, 0] & b[:, 0])
    a[:, 0] |= b[:, 0]
    return a


def _marked(planes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Which anchors have their bit in every plane."""
    out = np.ones(len(anchors), dtype=bool)
    for row in range(DEPTH):
        out &= _sketch.has(planes[row], _cell(anchors, row, 8 * planes.shape[1]))
    return out


def remove_repeats(docs: DataFrame, span: int = 50) -> DataFrame:
    """``docs`` with ``n_words, n_removed, kept`` for every row.

    A word goes if a window covers it whose words also start in a document with
    a smaller doc_id; windows are those of the input. ``kept`` are the words
    left, joined by one space. Null and empty texts have no words and keep the
    empty string; texts of fewer than ``span`` words keep all words. Copies
    within one document, and rows that repeat a doc_id, are no smaller
    document, so they remove nothing. Rows with a null doc_id are neither
    judged nor a source for others. Other columns stay; those of the three new
    names are replaced.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tag"))
    spark = docs.sparkSession

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, tag in zip(batch["doc_id"], batch["text"], batch["tag"]):
                h = hashes(text)
                s = [int(np.add.reduce(mix(h, k) * (2 * np.arange(len(h), dtype=np.uint64) + np.uint64(1)), dtype=np.uint64).astype(np.int64)) for k in (31, 32)]
                out.append((doc_id, tag, len(h), *s))
            yield pd.DataFrame(out, columns=["doc_id", "tag", "n_words", "s1", "s2"])

    known = src.where("doc_id is not null")
    seqs = cut(known.mapInPandas(trimmed(sequences), "doc_id long, tag long, n_words long, s1 long, s2 long"))
    long = seqs.where(F.col("n_words") >= span)
    same = ["n_words", "s1", "s2"]
    firsts = long.groupBy(same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    # a later copy of a whole text goes as a whole, and takes no part below
    copies = cut(long.join(firsts, same).where("doc_id > first").select("doc_id", "tag", "n_words").distinct())
    sole = known.join(small(copies.select("doc_id", "tag")), ["doc_id", "tag"], "left_anti")

    words_left = seqs.where(F.col("n_words") >= span).agg(F.sum("n_words")).first()[0] or 0
    width = _cells_for(2 * words_left // (span - min(GRAM, span) + 2)) // 8
    texts = sole.select("doc_id", "text")

    def count(own: np.ndarray, batch: pd.DataFrame) -> None:
        _count(own, np.concatenate([distinct(_anchors(hashes(text), span)) for text in batch["text"]] or [np.zeros(0, dtype=np.uint64)]))

    sketch = spark.sparkContext.broadcast(_sketch.merged(texts, (DEPTH, 2, width), "uint8", count, _add, lambda counts: counts[:, 1]))

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        twice = _sketch.held(sketch, "uint8").reshape(DEPTH, -1)
        for batch in batches:
            found = [distinct(_anchors(hashes(text), span)) for text in batch["text"]]
            found = [a[_marked(twice, a)] for a in found]
            ids = np.repeat(batch["doc_id"].to_numpy(dtype=np.int64), [len(a) for a in found])
            yield pd.DataFrame({"a": np.concatenate([*found, np.zeros(0, dtype=np.uint64)]).view(np.int64), "doc_id": ids})

    met = texts.mapInPandas(trimmed(anchors), "a long, doc_id long")
    shared = cut(met.groupBy("a").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("a"))
    sweep(spark)
    cells = _cells_for(shared.count())

    def mark(own: np.ndarray, batch: pd.DataFrame) -> None:
        a = batch["a"].to_numpy(dtype=np.int64).view(np.uint64)
        for row in range(DEPTH):
            _sketch.put(own[row], _cell(a, row, cells))

    repeated = spark.sparkContext.broadcast(_sketch.merged(shared, (DEPTH, cells // 8), "uint8", mark, lambda a, b: np.bitwise_or(a, b, out=a), lambda marked: marked))

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = _sketch.held(repeated, "uint8").reshape(DEPTH, -1)
        for batch in batches:
            out = []
            for doc_id, text, tag in zip(batch["doc_id"].to_numpy(), batch["text"], batch["tag"].to_numpy()):
                h = hashes(text)
                a = _anchors(h, span)
                if not len(a):
                    continue
                pos = np.flatnonzero(_marked(bits, a))
                if not len(pos):
                    continue
                w1 = windows(h, span, 41)[pos]
                w1, at = np.unique(w1, return_index=True)  # once a document, at its first start
                pos = pos[at]
                w2 = windows(h, span, 43)[pos]
                out.append(pd.DataFrame({"w1": w1.view(np.int64), "w2": w2.view(np.int64), "doc_id": doc_id, "tag": tag, "pos": pos.astype(np.int32)}))
                if len(out) >= 500:
                    yield pd.concat(out, ignore_index=True)
                    out = []
            if out:
                yield pd.concat(out, ignore_index=True)

    found = cut(sole.mapInPandas(trimmed(suspects), "w1 long, w2 long, doc_id long, tag long, pos int"))
    least = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    late = found.join(least, ["w1", "w2"]).where("doc_id > first")
    starts = late.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list("pos")).alias("pos"))
    whole = copies.select("doc_id", "tag", F.array(F.lit(0), (F.col("n_words") - span + 1).cast("int")).alias("runs"))

    def to_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = []
            for pos in batch["pos"]:
                p = np.asarray(pos, dtype=np.int32)
                new = np.flatnonzero(np.diff(p, prepend=-2) != 1)
                runs.append(np.stack((p[new], np.diff(np.append(new, len(p)))), axis=1).ravel().astype(np.int32))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tag": batch["tag"], "runs": runs})

    runs = cut(starts.mapInPandas(trimmed(to_runs), "doc_id long, tag long, runs array<int>").unionByName(whole))
    sweep(spark)

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def keep(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for text, run in zip(texts, found):
            w = words(text)
            if run is None or not len(w):
                rows.append((len(w), 0, b" ".join(w).decode("utf-8", "surrogatepass")))
                continue
            start = np.zeros(len(w) + 1, dtype=bool)
            for first, n in np.asarray(run).reshape(-1, 2):
                start[first : first + n] = True
            hit = windows(hashes(text), span, 41)
            start = np.isin(hit, hit[np.flatnonzero(start[: len(hit)])])  # every start of these windows here
            edge = np.zeros(len(w) + 1, dtype=np.int32)
            edge[: len(start)] += start
            edge[span : span + len(start)] -= start
            stay = np.cumsum(edge)[: len(w)] == 0
            kept = b" ".join([x for x, s in zip(w, stay) if s])
            rows.append((len(w), len(w) - int(stay.sum()), kept.decode("utf-8", "surrogatepass")))
        made = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
        rows.clear()
        release()
        return made

    own = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept")]
    tagged = docs.select(*own, F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__tag"))
    runs = small(runs.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("runs").alias("__runs")))
    judged = tagged.join(runs, ["__id", "__tag"], "left").select(*own, keep(F.col("text").cast("string"), "__runs").alias("__made"))
    return judged.select(*own, "__made.n_words", "__made.n_removed", "__made.kept")
