"""Tables: candidates, grids from row and column positions, and tokens put into cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_ROWS, MIN_COLUMNS, CLUSTER_GAP, TABLE_GAP = 2, 2, 10, 30


def digital_tables(raw: DataFrame) -> DataFrame:
    """Tables of raw cells (..., cells array<array<string>>) with enough rows and columns: headers, rows; null cells are empty."""
    clean = F.transform("cells", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    big = (F.size("cells") >= MIN_ROWS) & (F.size(F.element_at("cells", 1)) >= MIN_COLUMNS)
    return raw.where(big).withColumn("cells", clean).withColumns({"headers": F.element_at("cells", 1), "rows": F.slice("cells", F.lit(2), F.size("cells"))}).drop("cells")


def table_pages(pages: DataFrame, total: str | None = None) -> DataFrame:
    """doc_id, page of the distinct pages to be searched for tables: those with text, and within 1 to `total` if that column is given."""
    from docengine.functions.text import strip

    solid = pages.where(strip(F.coalesce("text", F.lit(""))) != "")
    solid = solid.where(F.col("page").between(F.lit(1), F.col(total))) if total else solid
    return solid.select("doc_id", "page").distinct()


def page_tables(pages: DataFrame, raw: DataFrame) -> DataFrame:
    """pages with their tables out of raw cells (doc_id, page, table_index, cells); raw tables of blank pages are not looked at."""
    found = digital_tables(raw.join(table_pages(pages), ["doc_id", "page"], "left_semi")).withColumn("extraction_method", F.lit("pdfplumber"))
    return with_tables(pages, found)


def document_tables(pages: DataFrame) -> DataFrame:
    """doc_id, tables of all pages in page order."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "tables")))
    return pages.groupBy("doc_id").agg(F.flatten(F.transform(ordered, lambda x: x["tables"])).alias("tables"))


def cluster(positions: Column, gap: float = CLUSTER_GAP) -> Column:
    """Of sorted distinct positions, those further than `gap` from the last one kept."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(F.array_distinct(positions)), start, lambda acc, p: F.when((F.size(acc) == 0) | (p - F.element_at(acc, -1) > gap), F.array_append(acc, p)).otherwise(acc))


def split_by_gap(lines: DataFrame, keys: list[str], gap: float = TABLE_GAP) -> DataFrame:
    """Row positions (keys, y) with part (from 0): a new table begins after a gap of more than `gap`."""
    w = Window.partitionBy(*keys).orderBy("y")
    new = F.coalesce((F.col("y") - F.lag("y").over(w) > gap).cast("int"), F.lit(0))
    return lines.withColumn("new", new).withColumn("part", F.sum("new").over(w)).drop("new")


def to_cells(tokens: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col, text: tokens (cx, cy, ord, text) in the half-open cells of bounds (row_ys, col_xs), joined in order; others are dropped.

    The bands of a page are arrays beside its tokens, so the range join is an equi-join and a search.
    """

    def band(edges: Column, v: Column) -> Column:
        n = F.size(F.filter(edges, lambda e: e <= v))
        return F.when((n >= 1) & (n < F.size(edges)), n - 1)

    placed = tokens.join(bounds, keys).select(*keys, "ord", "text", band(F.col("row_ys"), F.col("cy")).alias("row"), band(F.col("col_xs"), F.col("cx")).alias("col"))
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    return placed.where("row IS NOT NULL AND col IS NOT NULL").groupBy(*keys, "row", "col").agg(one.alias("text"))


def with_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages with the array of their tables in order, empty where there is none. Blank pages are to be left out of the table scan before."""
    columns = [c for c in tables.columns if c not in ("doc_id", "page")]
    grouped = tables.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("table_index", *[c for c in columns if c != "table_index"]))).alias("tables"))
    joined = pages.join(grouped, ["doc_id", "page"], "left")
    return joined.withColumn("tables", F.coalesce("tables", F.array().cast(grouped.schema["tables"].dataType)))
