"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import counts, embedding, exact, licenses, minhash, packing, pii, quality, segment, tokenfile
from docengine.llm.store import shared_dir
from docengine.session import ship

WORD_BPE, BYTE_BPE, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embedding.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.95)


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sample(_documents(spark, sf_dir), public_tokenizers.path(PIECES), k=3)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs.where(~quality.held_out(F.col("doc_id"))), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    target = f"{shared_dir(spark)}/tables/tokens-{uuid.uuid4().hex}"
    tokenfile.write(docs, target, public_tokenizers.path(WORD_BPE), end_id=2)
    return tokenfile.read(spark, target)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.by_section(_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), end_id=1, size=4096)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), shingle=3, percent=85)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_sentencepiece_sampling, op3_pii_surrogates, op4_quality_classifier, op5_license_scan,
    op6_token_files, op7_token_counts, op8_best_fit_packing, op9_minhash_near_dedup, op10_exact_dedup,
)}

SQL = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
}
