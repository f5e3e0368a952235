"""Corpus pipeline: toxicity, near-duplicates, repeated strings, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of
`documents`. Nulls, empty texts, ties, repeated rows and empty tables are treated as each operator's
module says; a document of empty text is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import fresh, new_path, ship
from tabulon.llm.minhash import near_duplicates
from tabulon.llm.mixing import mix
from tabulon.llm.packing import in_order, pack
from tabulon.llm.queries import tokenizer_path
from tabulon.llm.suffix import without_repeats
from tabulon.llm.toxicity import held_out, score, train

#: No stage but mixing could be put in SQL (trained scores, near-duplicate graphs, byte-level repeats).
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is predicted go; a null or empty text stays."""
    ship(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    return score(docs, model, keep_below=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays; rows that share an id stay or go together."""
    ship(spark)
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that stand earlier in the corpus are cut from the texts; n_chars follows."""
    ship(spark)
    out = without_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixing schedule: files and rows follow the slots, and packing follows the files.

    Rows that share an id stand together; other columns are handed on, whatever their names.
    """
    ship(spark)
    key, at = fresh(docs, "mix_id"), fresh(docs, "mix_at")
    order = mix(docs).select(F.col("doc_id").alias(key), "slot", "place").groupBy(key).agg(F.min(F.struct("slot", "place")).alias(at))
    joined = docs.join(order.hint("merge"), docs["doc_id"].eqNullSafe(F.col(key)), "left")
    return joined.repartitionByRange(F.col(f"{at}.slot")).sortWithinPartitions(f"{at}.slot", f"{at}.place").select(*(F.col(f"`{c}`") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of at most 4096 tokens.

    Sequences are numbered in the mixed order: by the first place that one of their documents has in the
    files of the stage before (file number, row). Rows that no file holds have no place; their sequences
    come first.
    """
    ship(spark)
    packed = pack(docs, tokenizer_path())
    if not docs.inputFiles():
        return packed
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return in_order(packed, docs.select("doc_id", F.struct(part.alias("part"), F.col("_metadata.row_index").alias("row")).alias("place")))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
