"""A corpus from quality filter to packed sequences; each stage reads what the one before has written.

Null texts count as empty throughout. Stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import exact, minhash, packing, pii, quality
from docengine.llm.store import shared_dir
from docengine.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, by a model of the labels outside the held-out fold."""
    ship(spark)
    model = quality.train(docs.where(~quality.held_out(F.col("doc_id"))), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; rows that repeat the one that stays are dropped too.

    Rows are told by doc_id and text: null or repeated ids of unlike texts do not stand for each other.
    """
    ship(spark)
    stay = exact.deduplicate(docs).where("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_text")).distinct()
    marked = docs.withColumn("text_sha256", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    same = F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("text_sha256") == F.col("stay_text"))
    return marked.join(stay, same, "left_semi").dropDuplicates(["doc_id", "text_sha256"]).select(*COLUMNS)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, similarity 0.8)."""
    ship(spark)
    stay = minhash.near_duplicates(docs, shingle=5, percent=80).where("kept").select("doc_id").distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi").select(*COLUMNS)


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates for personal data."""
    ship(spark)
    return pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of at most 4096 tokens."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=4096)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", keep_distinct),
    ("near_dedup", keep_one_of_near),
    ("pii", replace_personal),
    ("packing", pack_sequences),
]

#: Neither the classifier nor packing can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents of sf_dir, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
