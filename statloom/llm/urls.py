"""URL filters by a sort-merge range join.

The reversed host of a url ("com.example.blog.") is its canonical key, so the
keys that a rule's host covers are those from the rule's key on that start with
it: an interval, and two such intervals are nested or apart. Rules and urls are
dealt out by ranges of keys, a rule to every range that its interval meets, and
sorted. One sweep over a range keeps the stack of active nested rules; each url
asks only the rules on the stack, by the starts of its path.

Range bounds are quantiles of the urls' keys. A key that fills several ranges
(one host with a third of all urls) has several equal bounds, and its urls are
spread over all of these, each of which has the rules for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Urls of a range on average, and the most ranges.
RANGE, MOST_RANGES = 20_000, 1 << 12


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """The reversed host, each label followed by a dot: prefixes are parent domains."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _count_below(table: Column, halves: Column, key: Column, equal: bool) -> Column:
    """How many of the sorted bounds are below ``key`` (or equal to it): binary search."""
    less = (lambda b: b <= key) if equal else (lambda b: b < key)
    return F.aggregate(halves, F.lit(0), lambda at, s: F.when((at + s <= F.size(table)) & less(F.get(table, at + s - 1)), at + s).otherwise(at))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``urls(id_col, url)``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if
    the url's path starts with the rule's. The longest rule (host and path
    together) wins, then the longer host, then the lesser verdict by name.
    ``rule`` is its host and path, null if none fits; the verdict is then
    ``default``. Null urls and such without ``://`` have an empty host and path
    and no rule. Rules with a null or empty host fit nothing; a null path is
    empty. Hosts of rules are lower-cased. Repeated rows and other columns of
    either table do no harm.
    """
    spark = urls.sparkSession
    host = host_of(F.col("url"))
    read = urls.select(F.col(id_col).cast("string").alias("__id"), host.alias("host"), path_of(F.col("url")).alias("path"))
    read = read.withColumn("key", key_of(F.col("host")))
    clean = rules.where("host is not null and host <> ''").select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    clean = clean.withColumn("key", key_of(F.col("host"))).distinct()
    n = urls.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE))
    # quantiles of keys: the first bytes as a number choose where a bound is, every bound is a whole key
    bounds: list[str] = []
    if ranges > 1:
        step = max(1, n // (ranges * 64))
        picked = read.where(F.pmod(F.xxhash64("__id", "key"), F.lit(step)) == 0).groupBy("key").count()
        total = picked.agg(F.sum("count")).first()[0] or 0
        seen, due = 0, total / ranges
        for row in picked.orderBy("key").toLocalIterator():
            seen += row["count"]
            while len(bounds) + 1 < ranges and seen >= due * (len(bounds) + 1):
                bounds.append(row["key"])
    size = 1
    while size <= len(bounds):
        size *= 2
    halves = F.array(*[F.lit(size >> i) for i in range(1, size.bit_length())]) if bounds else F.array().cast("array<int>")
    table = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<string>")
    at = lambda key, equal: _count_below(table, halves, key, equal)
    low, high = at(F.col("key"), False), at(F.col("key"), True)
    dealt = read.withColumn("low", low).withColumn("high", high)
    dealt = dealt.withColumn("part", (F.col("low") + F.pmod(F.xxhash64("__id", "path"), F.col("high") - F.col("low") + 1)).cast("int"))
    dealt = dealt.select("part", "key", F.lit(1).alias("kind"), "__id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    reach = clean.withColumn("low", at(F.col("key"), False)).withColumn("high", at(F.concat("key", F.lit("\U0010ffff")), True))
    reach = reach.select(F.explode(F.sequence("low", "high")).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("__id"), "host", "path", "verdict")
    rows = reach.unionByName(dealt).repartition("part").sortWithinPartitions("part", "key", "kind", "path", "verdict")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, stack = None, []  # of [key, host, {path: verdict}, lengths of paths]
        for batch in batches:
            out = []
            for p, key, kind, i, host, path, verdict in zip(*(batch[c].tolist() for c in ("part", "key", "kind", "__id", "host", "path", "verdict"))):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, set()))
                    stack[-1][2].setdefault(path, verdict)  # sorted: the lesser verdict comes first
                    stack[-1][3].add(len(path))
                    continue
                best = None
                for _, rule_host, paths, lengths in stack:
                    for n in sorted(lengths, reverse=True):
                        if n <= len(path) and path[:n] in paths:
                            found = (len(rule_host) + n, len(rule_host), rule_host + path[:n], paths[path[:n]])
                            best = max(best, found) if best else found
                            break
                out.append((i, host, path, best[2] if best else None, best[3] if best else default))
            if out:
                yield pd.DataFrame(out, columns=["__id", "host", "path", "rule", "verdict"])

    judged = rows.mapInPandas(sweep, "`__id` string, host string, path string, rule string, verdict string")
    kind = urls.schema[id_col].dataType
    return judged.select(F.col("__id").cast(kind).alias(id_col), "host", "path", "rule", "verdict")
