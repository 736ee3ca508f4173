"""Mixing sources to target weights by hierarchical budgeting.

A tree of levels (say domain, language, source) has a weight for every node
among its siblings. The token budget flows from the root: at each node it is
shared among the children by weight, and what a child cannot use (its leaves
have too few tokens, even repeated ``epochs`` times) goes to its siblings; only
what all children together cannot use was never given to their parent. Each
leaf then takes whole epochs of its documents and a prefix of one more; every
epoch has its own seeded order.

DataFrame operations only. Documents are aggregated to one row a leaf, and to
at most ``2**12`` rows a leaf to find the bucket of the seeded order in which
the prefix ends; only that bucket's rows are ordered one by one. A leaf with a
third of all documents is spread over these buckets, and texts never shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.plans.lineage import cut, small

#: Hexadecimal digits of the order key that make a bucket: 16**3 buckets a leaf.
DIGITS = 3


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    one = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(one == "", F.lit(0)).otherwise(F.length(one) - F.length(F.translate(one, " ", "")) + 1).cast("long")


def _key(epoch: Column, doc_id: Column, seed: int) -> Column:
    """Place of a document in the seeded order of an epoch."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    given = weights.get(level, {})
    if not given:
        return F.lit(1.0)
    table = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.element_at(table, F.col(level)), F.lit(float(given.get("*", 0.0))))


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], share: float, epochs: int) -> DataFrame:
    """``*levels, have, quota``: tokens each leaf has and should give.

    ``leaves`` has one row a leaf, with ``have``. The budget is ``share`` of all
    tokens, at most what the leaves can give. A weight of 0 gives nothing.
    """
    tree = leaves.select(*levels, "have", *[_weight(c, weights).alias(f"w_{c}") for c in levels])
    live = F.lit(1.0)
    for c in levels:
        live = live * F.when(F.col(f"w_{c}") > 0, 1.0).otherwise(0.0)
    tree = tree.withColumn("cap_leaf", F.col("have") * F.lit(float(epochs)) * live)
    everything = W.partitionBy(F.lit(1))
    tree = tree.withColumn("given", F.least(F.floor(F.sum("have").over(everything) * F.lit(float(share))).cast("double"), F.sum("cap_leaf").over(everything)))
    for i, c in enumerate(levels):
        above, path = list(levels[:i]), list(levels[: i + 1])
        nodes = tree.groupBy(*path).agg(F.sum("cap_leaf").alias("cap"), F.max(f"w_{c}").alias("w"), F.max("given").alias("budget")).where("w > 0 and cap > 0")
        order = W.partitionBy(*above, F.lit(1)).orderBy((F.col("cap") / F.col("w")).asc(), F.col(c).asc())
        before = order.rowsBetween(W.unboundedPreceding, -1)
        onward = order.rowsBetween(0, W.unboundedFollowing)
        level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
        filled = nodes.withColumn("level", level)
        filled = filled.withColumn("level", F.max("level").over(W.partitionBy(*above, F.lit(1))))
        filled = filled.select(*path, F.least("cap", F.col("w") * F.col("level")).alias("given"))
        tree = tree.drop("given").join(filled, path, "left").withColumn("given", F.coalesce("given", F.lit(0.0)))
    return tree.select(*levels, "have", F.floor(F.col("given") + F.lit(1e-6)).cast("long").alias("quota"))


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, float]],
    share: float,
    epochs: int = 1,
    seed: int = 42,
    tokens: Column | None = None,
) -> DataFrame:
    """``docs`` with ``tokens`` and ``copies``, how often each row is taken.

    ``levels`` name the tree's levels from the top, each an expression over
    ``docs``; null counts as the empty name. ``weights[level][name]`` is a
    weight among siblings ("*": any other name, else 0; a level without weights
    weighs all alike). ``tokens`` are words by default. A leaf's rows come in
    the order of md5(seed/epoch/doc_id); rows that repeat a doc_id are taken
    together. The prefix never exceeds the
    leaf's quota, and an empty prefix takes no document, not even empty ones. An empty table gives
    no rows; rows with ``copies`` 0 are returned too. Other columns stay; those
    named tokens or copies are replaced, names with two leading underscores are
    the operator's own.
    """
    names = list(levels)
    inner = {c: f"__level_{c}" for c in names}
    path = list(inner.values())
    expr = {inner[c]: F.coalesce(levels[c].cast("string"), F.lit("")) for c in names}
    size = word_count(F.col("text")) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    sizes = cut(docs.select("doc_id", *[e.alias(c) for c, e in expr.items()], size.alias("tokens")))
    leaves = sizes.groupBy(*path).agg(F.sum("tokens").alias("have"))
    given = leaf_budgets(leaves, path, {inner[c]: weights.get(c, {}) for c in names}, share, epochs)
    plan = cut(
        given.withColumn("whole", F.when(F.col("have") > 0, F.floor(F.col("quota") / F.col("have"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("quota") - F.col("whole") * F.col("have"))
    )
    keyed = sizes.join(small(plan), path).withColumn("key", _key(F.col("whole"), F.col("doc_id"), seed)).withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = keyed.groupBy(*path, "bucket").agg(F.sum("tokens").alias("n"), F.max("rest").alias("rest"))
    running = sums.withColumn("upto", F.sum("n").over(W.partitionBy(*path).orderBy("bucket")))
    ends = running.where("upto > rest").groupBy(*path).agg(F.min(F.struct("bucket", F.expr("upto - n").alias("base"))).alias("end"))
    ends = cut(ends.select(*path, F.col("end.bucket").alias("bucket"), F.col("end.base").alias("base")))
    last = keyed.join(small(ends), [*path, "bucket"])
    last = last.withColumn("upto", F.col("base") + F.sum("tokens").over(W.partitionBy(*path).orderBy("key")))
    stops = last.where("upto <= rest").groupBy(*path).agg(F.max("key").alias("stop"))
    rule = plan.join(ends.drop("base"), path, "left").join(stops, path, "left")
    rule = cut(rule.select(*path, *[F.col(c).alias(f"__{c}") for c in ("whole", "rest", "bucket", "stop")]))
    taken = docs.select("*", *[e.alias(c) for c, e in expr.items()], size.alias("__tokens")).join(small(rule), path, "left")
    key = _key(F.col("__whole"), F.col("doc_id"), seed)
    reached = F.when(F.col("__bucket").isNull() | (F.substring(key, 1, DIGITS) < F.col("__bucket")) | (key <= F.col("__stop")), 1).otherwise(0)
    part = F.when(F.col("__rest") > 0, reached).otherwise(0)
    own = [F.col(c) for c in docs.columns if c.lower() not in ("tokens", "copies")]
    return taken.select(*own, F.col("__tokens").alias("tokens"), (F.coalesce("__whole", F.lit(0)) + part).cast("long").alias("copies"))
