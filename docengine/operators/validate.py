"""Stitching, page flags, confidence, table checks and the document report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators.layout import pair_up

HIGH, MEDIUM, LOW = 0.85, 0.65, 0.40
MOST_WARNINGS = 50


def stitch(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text, ...) with those that break off joined to the next, whose text becomes empty; stitched tells which.

    stitch_warnings holds a stitched page's warning, which names the next page by its place among the document's.
    """
    w = Window.partitionBy("doc_id").orderBy("page")
    nxt = pages.withColumn("_next", F.lead("text").over(w))
    open_ = (T.strip(F.col("text")) != "") & (T.strip(F.col("_next")) != "") & ~T.sentence_ends(T.strip(F.col("text"))) & T.strip(F.col("_next")).rlike(r"^\p{Ll}")
    marked = pair_up(nxt, open_, ["doc_id"], "page")
    joined = F.concat(T.strip(F.col("text")), F.lit(" "), T.strip(F.col("_next")))
    text = F.when(F.col("merges"), joined).when(F.col("merged"), "").otherwise(F.col("text"))
    place = F.row_number().over(w) + 1
    warning = F.when(F.col("merges"), F.array(F.format_string("Page boundary stitch: merged with page %d", place))).otherwise(F.array().cast("array<string>"))
    return marked.withColumns({"stitch_warnings": warning, "text": text}).withColumnRenamed("merges", "stitched").drop("_next", "merged")


def all_warnings(pages: DataFrame) -> DataFrame:
    """Stitched pages with warnings: their own, if they have any, that of stitching, and flags."""
    own = [F.coalesce("warnings", F.array().cast("array<string>"))] if "warnings" in pages.columns else []
    return pages.withColumn("warnings", F.concat(*own, "stitch_warnings", page_flags(F.col("text"), F.col("confidence")))).drop("stitch_warnings")


def valid_confidence(c: Column) -> Column:
    """Whether a confidence is one: between 0 and 1, not null, not NaN."""
    return F.coalesce((c >= 0) & (c <= 1) & ~F.isnan(c.cast("double")), F.lit(False))


def invalid_tables(tables: DataFrame) -> DataFrame:
    """doc_id, table_issues (page, table_index, issues) of the tables that have any, in order."""
    issues = tables.select("doc_id", "page", "table_index", table_issues(F.col("headers"), F.col("rows")).alias("issues")).where(F.size("issues") > 0)
    return issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "table_index", "issues"))).alias("table_issues"))


def page_flags(text: Column, confidence: Column) -> Column:
    """Warnings of a page, in order; unknown confidence counts as full."""
    c = F.coalesce(confidence, F.lit(1.0))
    # counted once, as the one element of an array
    few = F.transform(
        F.array(T.word_count(text)),
        lambda n: F.when((n > 0) & (n < 10), F.format_string("Very little text extracted (%d words). Possible blank/decorative page.", n)),
    )[0]
    found = F.array(
        F.when(text == "", "No text extracted from this page."),
        F.when(c < LOW, F.format_string("Very low OCR confidence (%.2f). Page may be too blurry or low resolution.", c)).when(
            c < MEDIUM, F.format_string("Low OCR confidence (%.2f). Review recommended.", c)
        ),
        few,
    )
    return F.filter(found, lambda x: x.isNotNull())


def document_confidence(pages: DataFrame) -> DataFrame:
    """doc_id, confidence, quality: mean of page confidences; an unknown one is 0.95 with text, 0 without."""
    c = F.coalesce("confidence", F.when(F.col("text") != "", 0.95).otherwise(0.0))
    out = pages.groupBy("doc_id").agg(F.round(F.avg(c), 4).alias("confidence"))
    return out.withColumn("quality", quality(F.col("confidence")))


def quality(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def warnings_rollup(pages: DataFrame, most: int = MOST_WARNINGS) -> DataFrame:
    """doc_id, warnings (the first `most`, with their page), warnings_truncated, total_warning_count of pages with a warnings array."""
    own = F.transform("warnings", lambda w: F.format_string("Page %d: %s", F.col("page"), w))
    ordered = F.array_sort(F.collect_list(F.struct("page", own.alias("own"))))
    all_ = pages.groupBy("doc_id").agg(F.flatten(F.transform(ordered, lambda x: x["own"])).alias("all"))
    return all_.select("doc_id", F.slice("all", 1, most).alias("warnings"), (F.size("all") > most).alias("warnings_truncated"), F.size("all").alias("total_warning_count"))


def table_issues(headers: Column, rows: Column) -> Column:
    """What is wrong with a table; empty if nothing is."""
    none_h, none_r = F.coalesce(F.size(headers) < 1, F.lit(True)), F.coalesce(F.size(rows) < 1, F.lit(True))
    ragged = F.filter(
        F.transform(rows, lambda r, i: F.when(F.size(r) != F.size(headers), F.format_string("Row %d has %d cells, expected %d.", i + 1, F.size(r), F.size(headers)))),
        lambda x: x.isNotNull(),
    )
    first = F.filter(F.array(F.when(none_h, "Table has no headers."), F.when(none_r, "Table has no data rows.")), lambda x: x.isNotNull())
    return F.when(none_h | none_r, first).otherwise(ragged)


def fill_rate(headers: Column, rows: Column) -> Column:
    """Share of cells, headers included, that are not blank; 0 without cells."""
    cells = F.concat(F.coalesce(headers, F.array().cast("array<string>")), F.flatten(F.coalesce(rows, F.array().cast("array<array<string>>"))))
    full = F.size(F.filter(cells, lambda c: T.strip(F.coalesce(c, F.lit(""))) != ""))
    return F.when(F.size(cells) == 0, F.lit(0.0)).otherwise(F.round(full / F.size(cells), 4))


def report(pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """One row per document: pages, stitched pages, confidence, quality, language, warnings, table issues. Stitching comes before flags, so a page emptied by it is flagged.

    One exchange by doc_id serves the windows and the aggregate.
    """
    done = all_warnings(stitch(pages))
    own = F.transform("warnings", lambda w: F.format_string("Page %d: %s", F.col("page"), w))
    known = F.coalesce("confidence", F.when(F.col("text") != "", 0.95).otherwise(0.0))
    rows = F.array_sort(F.collect_list(F.struct("page", F.substring("text", 1, 500).alias("t"), own.alias("own"))))
    out = done.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("stitched").alias("stitched"), F.round(F.avg(known), 4).alias("confidence"), rows.alias("rows"))
    sample, warned = F.array_join(F.transform("rows", lambda x: x["t"]), " "), F.flatten(F.transform("rows", lambda x: x["own"]))
    out = out.select(
        "doc_id", "pages", "stitched", "confidence", quality(F.col("confidence")).alias("quality"), T.detect_language(sample).alias("language"),
        F.slice(warned, 1, MOST_WARNINGS).alias("warnings"), (F.size(warned) > MOST_WARNINGS).alias("warnings_truncated"), F.size(warned).alias("total_warning_count"),
    )
    none = F.array().cast("array<struct<page:int,table_index:int,issues:array<string>>>")
    if tables is None:
        return out.withColumn("table_issues", none)
    bad = invalid_tables(tables).withColumn("table_issues", F.col("table_issues").cast("array<struct<page:int,table_index:int,issues:array<string>>>"))
    return out.join(bad, "doc_id", "left").withColumn("table_issues", F.coalesce("table_issues", none))
