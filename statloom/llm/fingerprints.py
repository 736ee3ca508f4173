"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint is the sorted array of the ``k`` least distinct hashes of a
text's word shingles. Fingerprints of parts merge into that of the whole, and
two of them estimate resemblance, containment and the number of distinct
shingles. Everything here is a native column expression.

A hash is the first 16 hexadecimal digits of the MD5 of the shingle's words
joined by one space: fixed-width text, so its order is that of the numbers and
other engines can make the same fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.plans.lineage import cut

#: Hashes in a fingerprint, words in a shingle, and hexadecimal digits of a hash.
K, WORDS, DIGITS = 256, 5, 16
#: Documents of a block on average, and the most blocks that ranges of doc_id make.
BLOCK, MOST_BLOCKS = 400, 1 << 14


def words_of(text: Column) -> Column:
    """Words between ASCII white space, A-Z lower-cased; null has none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, r"[\x20\x09-\x0D]+"), "")


def _hash(run: Column) -> Column:
    return F.substring(F.md5(F.array_join(run, " ").cast("binary")), 1, DIGITS)


def shingle_hashes(w: Column, words: int = WORDS) -> Column:
    """Hashes of an array's word shingles in order; fewer words than one: the sequence is one; none: empty."""
    many = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - words + 1), lambda i: _hash(F.slice(a, i, words)))
    some = lambda a: F.when(F.size(a) >= words, many(a)).when(F.size(a) > 0, F.array(_hash(a))).otherwise(F.array().cast("array<string>"))
    # one lambda variable binds the word array, so that it is made once
    return F.element_at(F.transform(F.array(w), some), 1)


def sketch_of(hashes: Column, k: int = K) -> Column:
    """The ``k`` least distinct hashes, sorted."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def fingerprint(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The fingerprint of a text."""
    return sketch_of(shingle_hashes(words_of(text), words), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of both parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated shared share of the shingles of either; two empty ones: 1."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds; a without shingles: 1."""
    r = resemblance(a, b, k)
    both = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * both / distinct_shingles(a, k)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    # the first 13 digits are an exact double
    last = F.conv(F.substring(F.element_at(a, -1), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / last)


def _blocks(docs: DataFrame) -> Column:
    """A block number that rises with doc_id, with about as many documents in each.

    Only the bounds (at most MOST_BLOCKS numbers) come to the driver; a row
    finds its block by binary search over them.
    """
    n = docs.count()
    want = max(2, min(MOST_BLOCKS, n // BLOCK + 1))
    marks = [i / want for i in range(1, want)]
    bounds = docs.agg(F.percentile_approx("doc_id", marks, 10 * want)).first()[0]
    bounds = sorted(set(bounds or []))
    steps, size = [], 1
    while size <= len(bounds):
        size *= 2
    padded = bounds + [2**63 - 1] * (size - 1 - len(bounds))
    while size > 1:
        size //= 2
        steps.append(size)
    if not steps:
        return F.lit(0)
    table = F.array(*[F.lit(b).cast("long") for b in padded]) if len(padded) < 64 else F.expr(f"from_json('{padded}', 'array<bigint>')")
    halves = F.array(*[F.lit(s) for s in steps])
    return F.aggregate(halves, F.lit(0), lambda at, s: F.when(F.element_at(table, at + s) <= F.col("doc_id"), at + s).otherwise(at))


def edited_pairs(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Every document with its edited text, its successor and all fingerprints.

    Returns ``doc_id, text, edited, sketch, edited_sketch, next_sketch``. The
    edited text replaces the last floor(n / 4) code points by the first as many
    (or all) of the next document by ascending doc_id; after the last comes the
    first. Null texts count as empty. Rows that repeat a doc_id follow each
    other by text. A row without a doc_id has no successor: its edited text
    only loses the tail, and its next sketch is null. One table of one row
    succeeds itself. Other columns are ignored.

    One shuffle deals the texts out by blocks of doc_id of like size; the
    successor of a block's last document is in a table with one row a block.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = src.where("doc_id is not null")
    block = _blocks(known.select("doc_id"))
    dealt = known.withColumn("block", block)
    least = cut(dealt.groupBy("block").agg(F.min("doc_id").alias("doc_id")))  # at most MOST_BLOCKS rows
    heads = cut(known.join(F.broadcast(least), "doc_id").groupBy("block").agg(F.min("text").alias("text")))
    along = W.orderBy("block")  # the successor of the last block's last document is the first block's first
    chain = heads.select("block", F.coalesce(F.lead("text").over(along), F.first("text").over(along)).alias("head_text"))
    order = W.partitionBy("block").orderBy("doc_id", "text")
    after = cut(chain)
    hashed = dealt.repartition("block").select("*", shingle_hashes(words_of(F.col("text")), words).alias("hashes"))
    sketched = hashed.select("*", sketch_of(F.col("hashes"), k).alias("sketch"))
    ahead = sketched.select("*", F.lead(F.struct("text", "sketch")).over(order).alias("next"))
    last = F.col("next").isNull()
    joined = ahead.join(after, "block").select(
        "doc_id", "text", "hashes", "sketch",
        F.when(last, F.col("head_text")).otherwise(F.col("next.text")).alias("next_text"),
        F.col("next.sketch").alias("next_sketch"),
    )
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edit = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), tail))
    rest = src.where("doc_id is null").select("doc_id", "text", shingle_hashes(words_of(F.col("text")), words).alias("hashes"), fingerprint(F.col("text"), k, words).alias("sketch"), F.lit(None).cast("string").alias("next_text"), F.lit(None).cast("array<string>").alias("next_sketch"))
    whole = joined.unionByName(rest).withColumn("edited", edit)
    whole = whole.withColumn("next_sketch", F.when(F.col("next_sketch").isNull() & F.col("next_text").isNotNull(), fingerprint(F.col("next_text"), k, words)).otherwise(F.col("next_sketch")))
    # shingles that end before the last word of the part kept are the text's own, in order
    whole = whole.select("*", F.greatest(F.lit(0), F.size(words_of(F.substring(F.col("text"), F.lit(1), n - tail))) - words).alias("same"), words_of(F.col("edited")).alias("edited_words"))
    fresh = shingle_hashes(F.slice("edited_words", F.col("same") + 1, F.greatest(F.size("edited_words"), F.lit(1))), words)
    edited_sketch = sketch_of(F.concat(F.slice("hashes", F.lit(1), F.col("same")), fresh), k)
    return whole.select("doc_id", "text", "edited", "sketch", edited_sketch.alias("edited_sketch"), "next_sketch")
