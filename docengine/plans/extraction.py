"""The whole extraction: classified pages to one nested result for each document, and views of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import classify, clean, validate
from docengine.operators.tables import with_tables

TABLE = "struct<page:int,table_index:int,headers:array<string>,rows:array<array<string>>,extraction_method:string>"


def table_models(tables: DataFrame) -> DataFrame:
    """doc_id, page, table_index, headers, rows, extraction_method with defaults for what is missing; other columns, as accuracy, go."""
    have = set(tables.columns)
    default = {
        "table_index": F.lit(0), "headers": F.array().cast("array<string>"), "rows": F.array().cast("array<array<string>>"), "extraction_method": F.lit("unknown"),
    }
    return tables.select("doc_id", F.col("page").cast("int").alias("page"), *[(F.coalesce(c, d) if c in have else d).alias(c) for c, d in default.items()])


def extract(pages: DataFrame, near: bool = True, tables: DataFrame | None = None, ocr_language: str = "english") -> DataFrame:
    """Results of pages (doc_id, page, text, confidence, pdf_type, and warnings if there are any): cleaned across pages, stitched, flagged, scored and put together, with their tables.

    Pages are made once; windows and aggregates are by document, so one exchange on doc_id serves most of them.
    """
    done = validate.all_warnings(validate.stitch(clean.clean_pages(pages, near)))
    if tables is None:
        done = done.withColumn("tables", F.array().cast(f"array<{TABLE}>"))
    else:
        models = table_models(tables)
        done = with_tables(done, models).withColumn(
            "tables", F.transform("tables", lambda t: F.struct(F.col("page").cast("int").alias("page"), *[t[c].alias(c) for c in ("table_index", "headers", "rows", "extraction_method")]))
        )
    own = F.transform("warnings", lambda w: F.format_string("Page %d: %s", F.col("page"), w))
    known = F.coalesce("confidence", F.when(F.col("text") != "", 0.95).otherwise(0.0))
    out = done.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "text", "tables", "confidence", "warnings", own.alias("own")))).alias("pages"),
        F.round(F.avg(known), 4).alias("confidence"),
        F.count_if(F.col("pdf_type") == "digital").alias("digital"),
        F.count_if(F.col("pdf_type") == "scanned").alias("scanned_page_count"),
        F.count("*").alias("total_pages"),
    )
    warned = F.flatten(F.transform("pages", lambda p: p["own"]))
    solid = F.filter("pages", lambda p: T.strip(p["text"]) != "")
    marked = F.array_join(F.transform(solid, lambda p: F.format_string("[Page %d]\n%s", p["page"], T.strip(p["text"]))), "\n\n---\n\n")
    sample = F.array_join(F.transform("pages", lambda p: F.substring(p["text"], 1, 500)), " ")
    kind = F.when(F.col("digital") == F.col("total_pages"), "digital").when(F.col("scanned_page_count") == F.col("total_pages"), "scanned").otherwise("mixed")
    out = out.select(
        "doc_id", "confidence", "scanned_page_count", "total_pages", kind.alias("pdf_type"), validate.quality(F.col("confidence")).alias("quality"), marked.alias("text"),
        T.detect_language(sample).alias("detected"), warned.alias("warned"), F.flatten(F.transform("pages", lambda p: p["tables"])).alias("tables"),
        F.transform("pages", lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"), p["tables"].alias("tables"), F.coalesce(p["confidence"], F.lit(0.0)).alias("confidence"), p["warnings"].alias("warnings"))).alias("pages"),
    )
    out = clean.clean_block(out, "text", near)
    scanned = F.col("scanned_page_count")
    return out.select(
        "doc_id", F.lit("done").alias("status"), "text", F.col("text").alias("full_text"), "confidence", classify.document_language(scanned, F.col("detected"), ocr_language).alias("language"), "tables", "pages",
        F.struct(
            "total_pages", F.col("pdf_type").alias("overall_type"), "quality", F.col("confidence").alias("confidence_score"), F.array("detected").alias("languages_detected"),
            classify.engine_label(scanned, ocr_language).alias("ocr_engine"), F.slice("warned", 1, validate.MOST_WARNINGS).alias("warnings"),
            (F.size("warned") > validate.MOST_WARNINGS).alias("warnings_truncated"), F.size("warned").alias("total_warning_count"),
        ).alias("metadata"),
    )


def status_view(results: DataFrame) -> DataFrame:
    return results.select("doc_id", "status", "confidence")


def text_view(results: DataFrame) -> DataFrame:
    return results.select("doc_id", "text", "language")


def tables_view(results: DataFrame) -> DataFrame:
    """doc_id and one row for each table, in page order."""
    return results.select("doc_id", F.posexplode("tables").alias("position", "t")).select("doc_id", "position", "t.*")
