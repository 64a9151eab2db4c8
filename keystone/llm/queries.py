"""Registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystone.llm.ann import nearest_neighbours
from keystone.llm.bpe import bpe_round_trip
from keystone.llm.embedding_dedup import near_duplicate_vectors
from keystone.llm.exact_dedup import exact_duplicates
from keystone.llm.hard_negatives import hard_negatives
from keystone.llm.jaccard_join import jaccard_components
from keystone.llm.language_id import language_predictions
from keystone.llm.oracles import oracle_sql
from keystone.llm.packing import pack_documents
from keystone.llm.secrets import find_secrets
from keystone.llm.spelling import spelling_variants
from keystone.llm.substring_dedup import passage_digest
from keystone.llm.suffix_dedup import string_digest
from keystone.llm.token_files import token_file_index


__all__ = ["oracle_sql", "queries"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def anchored(embeddings: DataFrame) -> DataFrame:
    """Every 50th vector is an anchor; every 7th gets the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", "embedding", moved.alias("label"), (F.col("vec_id") % 50 == 0).alias("anchor"))


def queries():
    docs = lambda spark, d: table(spark, d, "documents")
    return {
        "op1_embedding_near_dedup": lambda spark, d: near_duplicate_vectors(table(spark, d, "embeddings")),
        "op2_bpe_round_trip": lambda spark, d: bpe_round_trip(docs(spark, d)),
        "op3_secret_scan": lambda spark, d: find_secrets(docs(spark, d), least_documents=3, max_documents=1000).drop("all_spans", "copies"),
        "op4_token_files": lambda spark, d: token_file_index(docs(spark, d)),
        "op5_ngram_jaccard_join": lambda spark, d: jaccard_components(docs(spark, d), words=3, percent=90),
        "op6_language_id": lambda spark, d: language_predictions(docs(spark, d)),
        "op7_substring_dedup": lambda spark, d: passage_digest(docs(spark, d), window=35),
        "op8_nearest_neighbours": lambda spark, d: nearest_neighbours(table(spark, d, "embeddings")),
        "op9_sequence_packing": lambda spark, d: pack_documents(docs(spark, d)),
        "op10_suffix_array_dedup": lambda spark, d: string_digest(docs(spark, d), length=200),
        "op11_hard_negatives": lambda spark, d: hard_negatives(anchored(table(spark, d, "embeddings"))),
        "op12_exact_dedup": lambda spark, d: exact_duplicates(docs(spark, d)),
        "op13_spelling_variants": lambda spark, d: spelling_variants(docs(spark, d), divisor=97),
    }
