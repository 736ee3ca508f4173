"""Text to tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, shortest: int = 1) -> Column:
    """Lower-cased runs of letters and digits, in order; null gives an empty array."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+", " "))
    return F.filter(F.split(plain, " "), lambda t: F.length(t) >= shortest)


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` tokens joined by one space; fewer tokens give none."""
    many = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, many).otherwise(F.array().cast("array<string>"))


def all_ngrams(words: Column, most: int) -> Column:
    """Tokens, then all runs of two up to ``most``."""
    return F.concat(*[words if n == 1 else ngrams(words, n) for n in range(1, most + 1)])


def without(words: Column, stop_words: list[str]) -> Column:
    return F.filter(words, lambda t: ~t.isin(stop_words))
