"""What is done with the tokens and passes of an OCR engine. Tokens: doc_id, page, ord, box (array of corners x, y), text, conf, and dpi where it matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import layout, validate

# fixed values: thresholds of the published rules
KEEP, BLANK_BELOW, WARN_BELOW = 0.3, 0.15, 0.25
SEGMENTATION = {"primary": 6, "retry": 11, "english": 6}


def placed(tokens: DataFrame) -> DataFrame:
    """tokens with x0, y0 (least of the corners), cx, cy (their mean); malformed ones, without corners, text or confidence, go."""
    solid = tokens.where((F.size("box") > 0) & F.col("text").isNotNull() & F.col("conf").isNotNull())
    mean = lambda c: F.aggregate("box", F.lit(0.0), lambda a, p: a + p[c]) / F.size("box")
    least = lambda c: F.array_min(F.transform("box", lambda p: p[c]))
    return solid.withColumns({"x0": least("x"), "y0": least("y"), "cx": mean("x"), "cy": mean("y")})


def kept(tokens: DataFrame, least: float = KEEP) -> DataFrame:
    return tokens.where(F.col("conf") >= least)


def page_confidence(tokens: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, confidence of every page: the mean of its tokens', 0 without any."""
    mean = tokens.groupBy(*keys).agg(F.avg("conf").alias("confidence"))
    return pages.select(*keys).distinct().join(mean, keys, "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def mean_confidence(confs: Column) -> Column:
    """Mean of an array of readings: negative ones say nothing, those over 1 are hundredths; 0 without any."""
    good = F.transform(F.filter(confs, lambda c: c >= 0), lambda c: F.when(c > 1, c / 100.0).otherwise(c.cast("double")))
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, c: a + c) / F.size(good)).otherwise(0.0)


def lines(tokens: DataFrame, keys: list[str], dpi: Column) -> DataFrame:
    """keys, line (from 0), text of placed tokens in reading order.

    A new line begins further than the tolerance from the y of its line's first token, the leftmost of its row, so that
    rows close to each other may share a line. The fold carries where lines begin, not tokens.
    """
    tolerance = layout.ocr_tolerance(dpi)
    ordered = layout.reading_order(tokens.select(*keys, "x0", "y0", "ord", "text", tolerance.cast("double").alias("tol")), keys, F.col("tol"))
    page = ordered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "y0", "text"))).alias("items"), F.max("tol").alias("tol"))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<int>").alias("first"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["y"].isNull() | (F.abs(x["y0"] - acc["y"]) > F.col("tol"))
        return F.struct(F.when(new, x["y0"]).otherwise(acc["y"]).alias("y"), F.when(new, F.array_append(acc["first"], x["position"])).otherwise(acc["first"]).alias("first"))

    cut = page.withColumn("first", F.aggregate("items", start, step, lambda acc: acc["first"]))
    ends = cut.withColumn("next", F.concat(F.slice("first", F.lit(2), F.size("first")), F.array(F.size("items") + 1)))
    texts = F.transform(F.arrays_zip("first", "next"), lambda r: F.array_join(F.transform(F.slice("items", r["first"], r["next"] - r["first"]), lambda x: x["text"]), " "))
    return ends.select(*keys, F.posexplode(texts).alias("line", "text"))


def page_text(tokens: DataFrame, keys: list[str], dpi: Column) -> DataFrame:
    """keys, text of pages: lines, hyphenated ones joined, one under the other."""
    found = lines(tokens, keys, dpi).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("lines"))
    return layout.merge_hyphens_in(found, "lines").select(*keys, F.array_join("lines", "\n").alias("text"))


def page_results(tokens: DataFrame, pages: DataFrame, keys: list[str], dpi: Column, least: float = KEEP) -> DataFrame:
    """keys, text, confidence of every page of `pages` out of its tokens: filtered by confidence, averaged, put in lines."""
    good = kept(placed(tokens), least)
    text = page_text(good, keys, dpi)
    return page_confidence(good, pages, keys).join(text, keys, "left").withColumn("text", F.coalesce("text", F.lit("")))


def best_pass(passes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, text, conf, score of the best of passes (ord, text, conf): a later one has to be strictly better."""
    scored = passes.withColumn("score", T.ocr_score(F.col("text"), F.col("conf")))
    top = F.max_by(F.struct("ord", "text", "conf", "score"), F.struct(F.col("score"), -F.col("ord")))
    return scored.groupBy(*keys).agg(top.alias("b")).select(*keys, "b.*")


def ladder(pages: DataFrame, language: str = "guj+eng") -> DataFrame:
    """pages (doc_id, page, primary, retry, english: each a struct of text and conf, null if it was not read) with text, confidence, segmentation, warnings.

    The retry counts only where the primary pass is blank, the English one only where both are and the language is not English already; each
    has to be strictly better. A best score under BLANK_BELOW blanks the text, one under WARN_BELOW warns.
    """
    score = lambda c: F.coalesce(T.ocr_score(F.col(f"{c}.text"), F.col(f"{c}.conf")), F.lit(0.0))
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    one = lambda c: F.struct(F.coalesce(F.col(f"{c}.text"), F.lit("")).alias("text"), score(c).alias("score"), F.lit(SEGMENTATION[c]).alias("psm"))
    out = pages.withColumn("_best", one("primary"))
    for c, allowed in (("retry", F.lit(True)), ("english", F.lit(language != "eng"))):
        better = allowed & blank(F.col("_best.text")) & F.col(c).isNotNull() & (score(c) > F.col("_best.score"))
        out = out.withColumn("_best", F.when(better, one(c)).otherwise(F.col("_best")))
    best, text = F.col("_best.score"), F.when(F.col("_best.score") < BLANK_BELOW, "").otherwise(F.col("_best.text"))
    warnings = F.array(
        F.when((best < WARN_BELOW) & (text != ""), F.format_string("Low OCR confidence (%.2f)", best)),
        F.when(blank(text), F.format_string("Page %d: Tesseract returned no usable text.", F.col("page"))),
    )
    return out.withColumns({"text": text, "confidence": best, "segmentation": F.col("_best.psm"), "warnings": F.filter(warnings, lambda x: x.isNotNull())}).drop("_best")


def fast_or_heavy(pages: DataFrame) -> DataFrame:
    """pages (fast, heavy: structs of text and confidence, null if not read) with path, text, confidence.

    A fast reading that looks good is taken at once where there is no heavy one; against a heavy one it also needs at least its score, length and a hundred times the confidence.
    """
    score = lambda c: F.when(F.col(c).isNotNull(), F.length(f"{c}.text") + F.col(f"{c}.confidence") * 100.0).otherwise(-1.0)
    good = F.coalesce(F.col("fast").isNotNull() & T.ocr_good(F.col("fast.text"), F.col("fast.confidence")), F.lit(False))
    fast = good & (F.col("heavy").isNull() | (score("fast") >= score("heavy")))
    pick = lambda f: F.when(fast, F.col(f"fast.{f}")).otherwise(F.col(f"heavy.{f}"))
    return pages.withColumns({
        "path": F.when(fast, "fast").when(F.col("heavy").isNotNull(), "heavy").otherwise("none"),
        "text": F.coalesce(pick("text"), F.lit("")), "confidence": F.coalesce(pick("confidence"), F.lit(0.0)),
    })


def language_pack(packs: list[str], default: str = "guj+eng") -> str:
    """What an engine is asked for: Gujarati with English, either alone, or the default where neither is installed."""
    found = [p for p in ("guj", "eng") if p in packs]
    return "+".join(found) or default


def scanned_tables(grids: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, table_index, headers, rows, extraction_method, accuracy of grids (keys, row_ys, col_xs) filled with placed tokens.

    Rows of a grid part where a gap is over TABLE_GAP; a part needs two boundaries and then two rows of cells.
    """
    from docengine.operators.tables import MIN_ROWS, split_by_gap, to_cells

    parts = split_by_gap(grids.select(*keys, F.explode(F.transform("row_ys", lambda y: y.cast("double"))).alias("y")), keys)
    ys = parts.groupBy(*keys, "part").agg(F.sort_array(F.collect_list("y")).alias("row_ys")).where(F.size("row_ys") > MIN_ROWS)
    bounds = ys.join(grids.select(*keys, F.transform("col_xs", lambda x: x.cast("double")).alias("col_xs")), keys)
    each = tokens.select(*keys, "cx", "cy", "ord", "text").join(bounds.select(*keys, "part"), keys)
    cells = to_cells(each, bounds, [*keys, "part"])
    filled = cells.groupBy(*keys, "part").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "text"))).alias("cells"))
    whole = bounds.join(filled, [*keys, "part"], "left")
    at = lambda r, c: F.coalesce(F.try_element_at("cells", F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"))), F.lit(""))
    grid = F.transform(F.sequence(F.lit(0), F.size("row_ys") - 2), lambda r: F.transform(F.sequence(F.lit(0), F.size("col_xs") - 2), lambda c: at(r, c)))
    made = whole.where(F.size("col_xs") > 1).select(*keys, F.col("part").cast("int").alias("table_index"), grid.alias("grid"))
    split = made.select(*keys, "table_index", F.element_at("grid", 1).alias("headers"), F.slice("grid", F.lit(2), F.size("grid")).alias("rows"), F.lit("ocr-grid").alias("extraction_method"))
    return split.withColumn("accuracy", validate.fill_rate(F.col("headers"), F.col("rows")))


def zip_images(numbers: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, image: a document's wanted page numbers in order, and its images in theirs, paired by place; what is left over on either side goes."""
    n = numbers.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("page")))
    i = images.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))
    return n.join(i, [*keys, "_n"]).select(*keys, "page", "image")
