"""Thin queries over the driver's tables, one for each operator; SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import prefixtrie, veccodes
from .common import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import repeat_digests

    return repeat_digests(_table(spark, sf_dir, "documents"))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op3_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import media_column

    return media_column(_table(spark, sf_dir, "documents"), keep=False)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: (host, path, verdict) of op7; `com/en/` is any host below com whose path starts with /en/.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlgbt import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .kmtree import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives_of_pages

    return derivatives_of_pages(_table(spark, sf_dir, "pages"), blocks=False)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import new_path
    from .sharding import ShardTable

    table = ShardTable(spark, new_path(spark, "shards"))
    docs = _table(spark, sf_dir, "documents")
    table.append_arrivals(docs.withColumn("arrival", F.pmod("doc_id", F.lit(8)).cast("int")), "arrival")
    table.compact()
    table.vacuum()
    kept = table.read()
    return kept.select("doc_id", "arrival", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixtrie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytecnn import languages

    return languages(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .veccodes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_mixing_sources": op2_mixing_sources,
    "op3_matroska_media": op3_matroska_media,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_sharding": op10_sharding,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_language_id": op12_language_id,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op10_sharding": """
        SELECT doc_id, CAST(doc_id % 8 AS INTEGER) AS arrival, lang, source,
               CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256
        FROM documents
    """,
    "op11_prefix_trie": prefixtrie.SQL,
    "op13_vector_codes": veccodes.SQL,
}
