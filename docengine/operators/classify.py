"""Page and document classes, coverage, and settings that depend on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as T


def text_coverage(blocks: DataFrame, keys: list[str], page_area: Column) -> DataFrame:
    """keys, coverage: the rectangle around all blocks as a share of the page, 1 at most; 0 for a page without area."""
    box = (F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0"))
    area = F.max(page_area)
    return blocks.groupBy(*keys).agg(F.when(area > 0, F.least(box / area, F.lit(1.0))).otherwise(0.0).alias("coverage"))


def char_count(text: Column, block_text: Column, word_text: Column, fallback: Column) -> Column:
    """Characters of the text, or while they are few of what other readings give."""
    n = [F.length(T.strip(F.coalesce(c, F.lit("")))) for c in (text, block_text, word_text, fallback)]
    a = F.when(n[0] < 20, F.greatest(n[0], n[1])).otherwise(n[0])
    b = F.when(a < 20, F.greatest(a, n[2])).otherwise(a)
    return F.when(b < 5, F.greatest(b, n[3])).otherwise(b)


def page_type(chars: Column, coverage: Column, gujarati: Column, threshold: float = 0.01) -> Column:
    digital = ((chars >= 20) & (coverage > 0.005)) | (coverage > threshold) | (gujarati & ((chars >= 5) | (coverage > 0.002)))
    return F.when(digital, "digital").otherwise("scanned")


def single_page(pages: DataFrame) -> DataFrame:
    """A document's only page is digital if another reading has text or it has no images; char_count is then the larger."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    rescue = F.length(T.strip(F.coalesce("rescue_text", F.lit(""))))
    ok = (n == 1) & ((rescue > 0) | ~F.col("has_images"))
    out = pages.withColumn("pdf_type", F.when(ok, "digital").otherwise(F.col("pdf_type")))
    return out.withColumn("char_count", F.when(n == 1, F.greatest("char_count", rescue)).otherwise(F.col("char_count")))


def classify_pages(pages: DataFrame, threshold: float = 0.01) -> DataFrame:
    """pages (doc_id, page, text, block_text, word_text, rescue_text, has_images, coverage) with char_count and pdf_type, the single-page rule applied."""
    chars = char_count(F.col("text"), F.col("block_text"), F.col("word_text"), F.col("rescue_text"))
    counted = pages.withColumns({"char_count": chars, "coverage": F.coalesce("coverage", F.lit(0.0))})
    gujarati = F.coalesce(*[F.when(T.has_gujarati(F.col(c)), True) for c in ("text", "block_text", "word_text", "rescue_text")], F.lit(False))
    return single_page(counted.withColumn("pdf_type", page_type(F.col("char_count"), F.col("coverage"), gujarati, threshold)))


def with_fallback(pages: DataFrame, fallback: DataFrame) -> DataFrame:
    """pages with rescue_text of `fallback` (doc_id, page, text), empty where it has none."""
    other = fallback.select("doc_id", "page", F.col("text").alias("rescue_text"))
    return pages.join(other, ["doc_id", "page"], "left").withColumn("rescue_text", F.coalesce("rescue_text", F.lit("")))


def document_type(pages: DataFrame) -> DataFrame:
    """doc_id, overall_type, digital_page_count, scanned_page_count, total_pages."""
    g = pages.groupBy("doc_id").agg(F.count_if(F.col("pdf_type") == "digital").alias("digital_page_count"), F.count_if(F.col("pdf_type") == "scanned").alias("scanned_page_count"), F.count("*").alias("total_pages"))
    kind = F.when(F.col("digital_page_count") == F.col("total_pages"), "digital").when(F.col("scanned_page_count") == F.col("total_pages"), "scanned").otherwise("mixed")
    return g.withColumn("overall_type", kind)


def dpi(pages: Column, wanted: Column) -> Column:
    return F.when(pages <= 10, F.least(wanted, F.lit(150))).when(pages <= 30, F.least(wanted, F.lit(120))).otherwise(F.least(wanted, F.lit(100)))


def render_dpi(wanted: Column, ocr_language: str) -> Column:
    """What pages are rendered with: no less than 150 for Gujarati, 300 for others, whatever the tier."""
    return F.greatest(wanted, F.lit(150 if ocr_language == "gujarati" else 300))


def display_language(language: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    return F.when(low.isin("gu", "guj", "gujarati"), "gujarati").when(low.isin("en", "eng", "english"), "english").when(low == "", "unknown").otherwise(low)


def engine_label(scanned: Column, ocr_language: str) -> Column:
    """The engine that read scanned pages; null if there are none."""
    return F.when(scanned > 0, "Tesseract" if ocr_language == "gujarati" else "Paddle")


def document_language(scanned: Column, detected: Column, ocr_language: str) -> Column:
    """Gujarati where scanned pages were read as such, else the detected language's name."""
    return F.when((scanned > 0) & F.lit(ocr_language == "gujarati"), "gujarati").otherwise(display_language(detected))


def route(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digital and scanned pages; both are narrow filters of one scan."""
    return pages.where("pdf_type = 'digital'"), pages.where("pdf_type = 'scanned'")


def unite(digital: DataFrame, scanned: DataFrame) -> DataFrame:
    return digital.unionByName(scanned, allowMissingColumns=True)


_GUJARATI, _ENGLISH = ("gu", "guj", "gujarati"), ("en", "eng", "english")


def resolve_ocr_language(language: str | None, engine: str | None, languages: list[str] | None = None) -> str:
    """What scanned pages are read as: gujarati for the engine tesseract, english for paddle, else gujarati where the language or the
    first of the list, even under another language, asks for it, else english."""
    low = lambda x: (x or "").strip().lower()
    own = {"tesseract": "gujarati", "paddle": "english"}.get(low(engine) or "hybrid")
    first = languages[0] if languages else None
    return own or ("gujarati" if low(language) in _GUJARATI or low(first) in _GUJARATI else "english")


def resolve_engine_language(language: str | None, engine: str | None, configured: str | None = None) -> str:
    """What an engine called on its own reads: the language given, the engine's own, the configured one, english."""

    def named(x: str | None) -> str | None:
        v = (x or "").strip().lower()
        return "gujarati" if v in _GUJARATI else "english" if v in _ENGLISH else None

    own = {"tesseract": "gujarati", "paddle": "english"}.get((engine or "hybrid").strip().lower())
    return named(language) or own or named(configured) or "english"


def best_of(texts: list[Column]) -> Column:
    """ord, text, score of the column with the highest text score; the first of equals. No row is moved."""
    each = [F.struct(T.text_score(t).alias("score"), F.lit(-i).alias("o"), t.alias("text")) for i, t in enumerate(texts)]
    return F.transform(F.array(F.array_max(F.array(*each))), lambda b: F.struct((-b["o"]).alias("ord"), b["text"].alias("text"), b["score"].alias("score")))[0]
