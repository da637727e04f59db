"""Exact dedup by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.store import table

#: A chunk ends at the first end of a sentence or line after LEAST characters; where there is none up to MOST, after the first
#: doubled character; where there is none either, after MOST.
LEAST, MOST = 1024, 8192
_END = r"[.!?\n。．！？।॥؟۔։።]"


def chunks(text, least: int = LEAST, most: int = MOST):
    """The text's chunks in order; together they are the text. Where they end follows from what they hold, so an
    insertion changes chunks near it and the rest falls into step again."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?{_END}|.{{{least},{most - 1}}}?(.)\1|.{{1,{most}}}"), F.lit(0))


def deduplicate(docs: DataFrame, least: int = LEAST, most: int = MOST, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the largest doc_id stays; kept is
    whether a row has it, so rows that repeat that doc_id stay together, a null doc_id stays only in a group without any
    other, and group_size counts every row. An empty table gives no rows; other columns are ignored.

    A chunk's identifier is `identify` of it, a 64-bit hash. Identifiers are verified: every chunk's content
    moves once, pre-aggregated where it is read, and an identifier that stands for two contents is
    set aside; documents with such a chunk are told apart by the SHA-256 of their text as well. Documents are then
    grouped by their ordered lists of identifiers; their texts do not move. The group's
    largest doc_id and size are pre-aggregated and stored, so that the join that brings them back is of two plain shuffles, which
    Spark can split where one group holds many rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), chunks(text, least, most).alias("chunks"))
    base = table(
        cut.select("doc_id", F.transform("chunks", lambda c: identify(c)).alias("recipe"), F.sha2("text", 256).alias("text_sha256")), "recipes"
    )
    contents = cut.select(F.explode("chunks").alias("chunk")).groupBy(identify(F.col("chunk")).alias("id"), "chunk").count()
    unclear = table(contents.groupBy("id").count().where("count > 1").select("id"), "unclear")
    extra = F.lit("")
    if not unclear.isEmpty():
        bad = base.select("recipe", F.explode("recipe").alias("id")).join(unclear, "id", "left_semi").select("recipe").distinct().withColumn("bad", F.lit(True))
        base = base.join(bad, "recipe", "left")
        extra = F.when(F.col("bad"), F.col("text_sha256")).otherwise("")
    base = base.withColumn("extra", extra)
    groups = table(base.groupBy("recipe", "extra").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return base.join(groups, ["recipe", "extra"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
