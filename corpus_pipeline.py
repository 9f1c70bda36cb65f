"""From raw documents to packed training sequences; each stage calls one operator of shoal.llm.

Every stage gets the documents its predecessor kept and returns the same columns, the last
one packed pieces. Columns that a stage doesn't read pass through it unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm import language_id, mixing, registry, sequence_packing, substring_dedup, superminhash
from shoal.llm.spread import text_key
from shoal.session import reachable


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or no language likely enough) go.

    Where no document has a label there is nothing to tell languages by: those with letters stay.
    """
    reachable(spark)
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # A row's id, source and text decide alone, so rows alike in them share a decision.
    text_hash = text_key(F.col("text"))
    rows = docs.withColumn("_shoal_row", F.struct("doc_id", text_hash.alias("h")))
    found = language_id.fused(language_id.document_records(rows, id_col="_shoal_row"), model)
    rejected = found.where(~F.col("accepted")).select(F.col("id.doc_id").alias("_shoal_id"), F.col("id.h").alias("_shoal_h"), F.col("host").alias("_shoal_source")).distinct()
    same = (docs["doc_id"].eqNullSafe(F.col("_shoal_id"))) & (text_key(docs["text"]) == F.col("_shoal_h")) & (docs["source"].cast("string").eqNullSafe(F.col("_shoal_source")))
    return docs.join(rejected, same, "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, directly or through others, one of the smallest id stays."""
    reachable(spark)
    return superminhash.without_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier are cut out; a document of which nothing is left goes."""
    reachable(spark)
    return substring_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gives the words that the mix takes; a second pass is a row of its own."""
    reachable(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    reachable(spark)
    return sequence_packing.pack_documents(docs, registry.tokenizer_file())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]
#: The stages' models, hashes and tokens are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
