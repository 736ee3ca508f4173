"""Audit of how filters of documents interact, in every order they may be applied.

Equal texts are found by refining a partition: classes of one length are split
by hashes of their successive blocks, each block longer than the one before,
and classes of one document are dropped on the way. What is refined are rows
of (length, hashes, count), to which equal texts fall together before anything
is shuffled, so a text that a third of all documents share is one row. Texts
of the surviving classes are then compared as a whole.

Each document fails a set of filters. The sets are counted by part, and every
order and step of the audit is a sum over the sets of a part (32 at most for
five filters).
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.plans.lineage import cut

#: Code points of the first block and how many times longer each next one is; nine blocks hold a billion.
FIRST, TIMES, BLOCKS = 64, 8, 9
_KEYS = [f"k{i}" for i in range(BLOCKS)]
# White space between words, and signs of the fourth filter.
SPACES, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"


def _hash(before: Column, block: Column) -> Column:
    return F.xxhash64(before, block)


def _described(docs: DataFrame) -> DataFrame:
    """``doc_id, part, text, n`` and the chained hashes of its blocks, null beyond its end, the last one as ``last``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    x = x.withColumn("n", F.length("text"))
    start, before = 0, F.col("n").cast("long")
    for i, key in enumerate(_KEYS):
        x = x.withColumn(key, F.when(F.col("n") > start, _hash(before, F.substring("text", start + 1, FIRST * TIMES**i))))
        start, before = start + FIRST * TIMES**i, F.col(key)
    return x.withColumn("last", F.coalesce(*reversed(_KEYS), F.lit(0).cast("long")))


def _surviving(rows: DataFrame) -> DataFrame:
    """``n, last`` of the classes that hold more than one row after all blocks."""
    alive = cut(rows.groupBy("n", *_KEYS, "last").agg(F.count("*").alias("rows")))
    longest = alive.agg(F.max("n")).first()[0] or 0
    for i, key in enumerate(["n", *_KEYS]):
        if i and longest <= FIRST * (TIMES ** (i - 1) - 1) // (TIMES - 1):
            break
        more = alive.where(F.col(key).isNotNull())
        kept = more.groupBy(key).agg(F.sum("rows").alias("in_class")).where("in_class > 1").select(key)
        alive = cut(alive.where(F.col(key).isNull()).unionByName(more.join(kept, key, "left_semi").select(*alive.columns)))
    return alive.groupBy("n", "last").agg(F.sum("rows").alias("rows")).where("rows > 1").select("n", "last")


def repeated(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Classes of equal texts: ``n, last, least`` (smallest doc_id), and whether texts are needed to tell them apart.

    They are where different texts have equal hashes; then the rows have the
    ``text`` too.
    """
    x = _described(docs)
    texts = x.join(cut(_surviving(x.drop("text"))), ["n", "last"], "left_semi").groupBy("n", "last", "text").agg(F.min("doc_id").alias("least"))
    classes = cut(texts.groupBy("n", "last").agg(F.count("*").alias("texts"), F.min("least").alias("least")))
    if classes.where("texts > 1").isEmpty():
        return classes.select("n", "last", "least"), False
    return cut(texts), True


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, part, a, b, c, d, e, good, toxic`` for every row of ``docs``.

    ``a``: under 100 words; ``b``: under four fifths of the words distinct;
    ``c``: over a tenth of the code points are A to Z; ``d``: holds one of
    ``#$%&*|``; ``e``: the text is also that of a smaller doc_id. Null texts
    and languages are empty; rows without a doc_id never fail ``e`` and have no
    labels; a doc_id with several labels has each mark that one of them has;
    rows that repeat a doc_id are judged each. Other columns are ignored.
    """
    x = _described(docs)
    words = F.array_remove(F.split("text", SPACES), "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.col("n") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    least, by_text = repeated(docs)
    x = x.select("doc_id", "part", "n", "last", *(["text"] if by_text else []), counts.alias("w"), (100 * capitals > 10 * F.col("n")).alias("c"), F.col("text").rlike(SIGNS).alias("d"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    x = x.join(least, ["n", "last", *(["text"] if by_text else [])], "left").join(marks, "doc_id", "left")
    no = F.lit(False)
    return x.select(
        "doc_id", "part", (F.col("w.all") < 100).alias("a"), (100 * F.col("w.distinct") < 80 * F.col("w.all")).alias("b"), "c", "d",
        F.coalesce(F.col("doc_id") > F.col("least"), no).alias("e"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"),
    )


def interactions(judged: DataFrame, filters: dict[str, str], part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """For every part, order of the filters and step: what the step's filter does there.

    ``filters`` gives each boolean column of ``judged`` a letter. Result:
    ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``. Null marks are false. An empty table has no
    parts and no rows.
    """
    letters = list(filters.values())
    bits = {letter: 1 << i for i, letter in enumerate(letters)}
    mask = sum((F.when(F.col(c), bits[letter]).otherwise(0) for c, letter in filters.items()), F.lit(0))
    ones = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    sets = judged.groupBy(F.col(part).alias("part"), mask.alias("mask")).agg(F.count("*").alias("n"), ones(good).alias("good"), ones(toxic).alias("toxic"))
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))  # a row for each subset of the filters at most
    orders = ",".join("".join(p) for p in itertools.permutations(letters))
    x = parts.select("part", "sets", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    x = x.select("part", "sets", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    at = lambda letter: F.locate(letter, F.col("filter_order"))
    x = x.withColumn("own", sum((F.when(at(c) == F.col("step"), b).otherwise(0) for c, b in bits.items()), F.lit(0)))
    x = x.withColumn("before", sum((F.when(at(c) < F.col("step"), b).otherwise(0) for c, b in bits.items()), F.lit(0)))

    def added(of: str, where) -> Column:
        value = lambda s: s["n"] * F.lit(math.factorial(len(letters))) / F.bit_count(s["mask"]) if of == "share" else s[of]
        return F.aggregate("sets", F.lit(0).cast("long"), lambda acc, s: acc + F.when(where(s["mask"]), value(s)).otherwise(0).cast("long"))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    return x.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        added("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        added("n", lambda m: fails(m) & ~gone(m)).alias("removed"),
        added("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        added("n", lambda m: m == F.col("own")).alias("unique_fails"),
        added("good", lambda m: fails(m) & ~gone(m)).alias("good_lost"),
        added("toxic", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        added("share", fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the five filters of ``failures``, A to E, by language."""
    return interactions(failures(docs, labels), {c: c.upper() for c in "abcde"})
