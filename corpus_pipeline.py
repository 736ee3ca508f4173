"""A training-data pipeline over ``documents``: classify, deduplicate, mix, pack.

Each stage works on all its predecessor kept; stages are written as Parquet in
between. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import queries as q
from statloom.llm.jaccard import keep_first_of_group
from statloom.llm.mixing import mix
from statloom.llm.packing import pack
from statloom.llm.quality import score, train
from statloom.llm.substrings import remove_repeats
from statloom.plans.lineage import cut, ship, sweep_executors

#: Share of the words that pass the earlier stages which the mixture keeps.
SHARE = 0.8


def _apart(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stage`` makes of ``docs``, with the columns of ``docs``: those of the stage's own names stay as they were."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    done = stage(docs.withColumnsRenamed(own))
    return done.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.7) go.

    Null and empty texts are scored as empty texts; rows of equal text share
    their fate, with or without a doc_id; an empty table stays empty. All
    columns stay as they are, also those named score or predicted.
    """
    ship(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _apart(docs, ("score", "predicted"), lambda x: score(x, model, at=0.7).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id: five-word shingles, likeness 0.8 or more.

    Null and empty texts are like nothing and stay; so do rows without a
    doc_id; rows that repeat a kept doc_id stay with it; an empty table stays
    empty. All columns stay as they are.
    """
    ship(spark)
    return keep_first_of_group(docs, words=5, num=80, den=100)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows seen in a smaller doc_id go, and documents that lose all.

    A document that loses nothing keeps its text as it is, null and empty ones
    too; one that loses words keeps the others joined by one space, and
    n_chars is their length. Rows without a doc_id lose nothing; rows that
    repeat a doc_id are treated alike; an empty table stays empty. All other
    columns stay as they are, also those named n_words, n_removed or kept.
    """
    ship(spark)

    def shortened(x: DataFrame) -> DataFrame:
        done = remove_repeats(x, span=50).where("n_removed = 0 or n_removed < n_words")
        text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
        n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
        return done.withColumn("n_chars", n_chars).withColumn("text", text)

    return _apart(docs, ("n_words", "n_removed", "kept"), shortened)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to the budgets of domains, languages and sources, each once.

    A null language or source counts as the empty name; rows that repeat a
    doc_id, and rows without one, are taken together; null and empty texts have
    no words and go with the prefix around them; an empty table stays empty.
    All columns stay as they are, also those named tokens or copies.
    """
    ship(spark)
    return _apart(docs, ("tokens", "copies"), lambda x: mix(x, q.mix_levels(), q.MIX_WEIGHTS, SHARE, epochs=1, seed=q.MIX_SEED).where("copies > 0"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids, of every row.

    Null and empty texts are one id, rows without a doc_id and repeated rows
    are packed each, other columns are ignored, an empty table has no pieces.
    """
    ship(spark)
    sweep_executors(spark)  # the tokenizers' words need what earlier stages left to the heaps
    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("substring dedup", repeated_substrings),
    ("mixing", mixture),
    ("packing", packing),
]

#: Learned rules and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
