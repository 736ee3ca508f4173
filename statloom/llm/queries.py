"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Parameters of the registered queries; tests reuse them.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DOMAINS = ("web", "books", "code")
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1, "*": 1}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 2, 42


def mix_levels() -> dict:
    """Domain (by the source's number), language, source."""
    number = F.coalesce(F.regexp_extract("source", r"([0-9]+)$", 1).try_cast("long"), F.lit(0))
    domain = F.when(number % 3 == 0, DOMAINS[0]).when(number % 3 == 1, DOMAINS[1]).otherwise(DOMAINS[2])
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.fingerprints import edited_pairs, resemblance

    out = edited_pairs(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"),
        F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.quality import held_out, score, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.html import extract

    return extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.mixing import mix

    levels = mix_levels()
    out = mix(_table(spark, sf_dir, "documents"), levels, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return out.select("doc_id", levels["domain"].alias("domain"), "lang", "source", "tokens", "copies")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.neighbours import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, top=5)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from statloom.llm.packing import pack

    out = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.licences import scan

    return scan(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.urls import judge

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(_table(spark, sf_dir, "pages"), rules)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.substrings import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), span=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from statloom.llm.alignment import align_documents

    out = align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.encode("groups", "utf-8"), 256))
    return out.withColumn("groups_sha256", digest).drop("groups")


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.impact import top_products

    return top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, top=5)


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_quality_classifier,
        op3_html_extraction,
        op4_mix_sources,
        op5_nearest_neighbours,
        op6_packing,
        op7_licence_scan,
        op8_url_filter,
        op9_ngram_jaccard_join,
        op10_substring_dedup,
        op11_cross_tokenizer_alignment,
        op12_filter_interaction_audit,
        op13_exact_topk_search,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_document_fingerprints": oracles.fingerprints(),
    "op4_mix_sources": oracles.mixture(DOMAINS, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED),
    "op7_licence_scan": oracles.licence_scan(),
    "op8_url_filter": oracles.url_filter(URL_RULES),
    "op9_ngram_jaccard_join": oracles.jaccard(3, 90, 100),
    "op10_substring_dedup": oracles.repeats(50),
    "op12_filter_interaction_audit": oracles.filter_audit(),
    "op13_exact_topk_search": oracles.top_products(50, 5, 256),
}
