"""Reading order, lines, paragraphs and columns of positioned text. Input rows carry `ord`, their place in the source, to break ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_TOLERANCE, PAGE_WIDTH, BALANCE = 5.0, 612.0, 0.3


def ocr_tolerance(dpi: Column) -> Column:
    return F.greatest(F.lit(2), F.bround(8 * dpi / 300).cast("int"))


def anchors(values: Column, gap: Column) -> Column:
    """Of ascending values, the first of each group: a new one begins further than `gap` from its group's first.

    What a group's first is depends on all before it, so this is a fold, not a lag; it carries groups, not items.
    """
    start = F.array().cast("array<double>")
    return F.aggregate(values, start, lambda acc, y: F.when((F.size(acc) == 0) | (y - F.element_at(acc, -1) > gap), F.array_append(acc, y)).otherwise(acc))


def reading_order(blocks: DataFrame, keys: list[str], tolerance: Column | None = None) -> DataFrame:
    """blocks with row (from 0) and position (from 1): rows of like y0 from the top, each from left to right."""
    gap = F.lit(ROW_TOLERANCE) if tolerance is None else tolerance.cast("double")
    columns = [c for c in blocks.columns if c not in keys]
    grouped = blocks.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("items"), F.array_sort(F.collect_set("y0")).alias("ys"), F.max(gap).alias("gap"))
    rows = grouped.withColumn("tops", anchors(F.col("ys"), F.col("gap")))
    of = F.transform("items", lambda b: F.struct((F.size(F.filter("tops", lambda t: t <= b["y0"])) - 1).alias("row"), b["x0"].alias("x"), b["y0"].alias("y"), b["ord"].alias("o"), b.alias("b")))
    placed = rows.select(*keys, F.posexplode(F.array_sort(of)).alias("p", "i"))
    return placed.select(*keys, *[F.col(f"i.b.{c}").alias(c) for c in columns], F.col("i.row").alias("row"), (F.col("p") + 1).alias("position"))


def columns_of(blocks: DataFrame, keys: list[str], width: float = PAGE_WIDTH) -> DataFrame:
    """keys, n_columns: two if the lesser half has more than BALANCE of the other's blocks."""
    mid = (F.col("x0") + F.col("x1")) / 2
    left, right = F.count_if(mid < width / 2), F.count_if(mid >= width / 2)
    two = (F.least(left, right) > 0) & (F.least(left, right) / F.greatest(left, right) > BALANCE)
    return blocks.groupBy(*keys).agg(F.when(two, 2).otherwise(1).alias("n_columns"))


def reading_order_columns(blocks: DataFrame, keys: list[str], width: float = PAGE_WIDTH, force: int | None = None) -> DataFrame:
    """As reading_order, the left column of a two-column page before the right one."""
    n = F.lit(force) if force else F.col("n_columns")
    split = blocks if force else blocks.join(columns_of(blocks, keys, width), keys)
    split = split.withColumn("col", F.when((n == 2) & ((F.col("x0") + F.col("x1")) / 2 >= width / 2), 1).otherwise(0)).drop("n_columns")
    placed = reading_order(split, [*keys, "col"]).drop("position")
    return placed.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("col", "row", "x0", "y0", "ord")))


def upper_median(c: Column) -> Column:
    s = F.sort_array(F.collect_list(c))
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def word_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """words with line (from 0): a word joins while it begins above the line's running bottom plus a tolerance."""
    h = words.groupBy(*keys).agg(upper_median(F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))).alias("height"))
    w = Window.partitionBy(*keys).orderBy("y0", "x0", "ord")
    bottom = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    tol = F.greatest(F.lit(3.0), F.col("height") * 0.7)
    out = words.join(h, keys).withColumn("new", F.coalesce((F.col("y0") > bottom + tol).cast("int"), F.lit(0)))
    return out.withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def word_paragraphs(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, paragraph, text: lines of words, parted where the gap to the line before is over 1.4 median heights (8 at least)."""
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "ord", "text"))), lambda x: x["text"]), " ")
    lines = word_lines(words, keys).groupBy(*keys, "line").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.max("height").alias("height"), one.alias("text"))
    w = Window.partitionBy(*keys).orderBy("line")
    new = F.coalesce((F.col("top") - F.lag("bottom").over(w) > F.greatest(F.lit(8.0), F.col("height") * 1.4)).cast("int"), F.lit(0))
    marked = lines.withColumn("new", new).withColumn("paragraph", F.sum("new").over(w))
    return _texts(marked, keys, "line")


def _texts(marked: DataFrame, keys: list[str], order: str) -> DataFrame:
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")
    return marked.groupBy(*keys, "paragraph").agg(one.alias("text"))


def block_paragraphs(blocks: DataFrame, keys: list[str], gap: float = 15.6, order: str = "position") -> DataFrame:
    """keys, paragraph, text of ordered blocks, parted where one begins more than `gap` below the end of the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    solid = blocks.where(F.trim("text") != "")
    new = F.coalesce((F.col("y0") - F.lag("y1").over(w) > gap).cast("int"), F.lit(0))
    return _texts(solid.withColumn("new", new).withColumn("paragraph", F.sum("new").over(w)), keys, order)


def blank_paragraphs(lines: DataFrame, keys: list[str], gap: int = 2) -> DataFrame:
    """keys, paragraph, text: stripped lines, parted by at least `gap` blank ones."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    solid = lines.withColumn("text", F.regexp_replace("line", r"^\s+|\s+$", "")).where("text <> ''")
    # lines between two that are not blank are blank
    new = F.coalesce((F.col("line_no") - F.lag("line_no").over(w) > gap).cast("int"), F.lit(0))
    return _texts(solid.withColumn("new", new).withColumn("paragraph", F.sum("new").over(w)), keys, "line_no")


def pair_up(df: DataFrame, eligible: Column, keys: list[str], order: str) -> DataFrame:
    """df with merges and merged: rows that greedy pairing from the top joins to the next, and those next ones.

    They are at the odd places of each run of eligible rows, counted from the last row that is not; all in windows of one order.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumns({"_ok": F.coalesce(eligible, F.lit(False)), "_n": F.row_number().over(w)})
    marked = marked.withColumn("_stop", F.coalesce(F.max(F.when(~F.col("_ok"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    marked = marked.withColumn("merges", F.col("_ok") & ((F.col("_n") - F.col("_stop")) % 2 == 1))
    return marked.withColumn("merged", F.coalesce(F.lag("merges").over(w), F.lit(False))).drop("_ok", "_n", "_stop")


def merge_hyphens_in(df: DataFrame, lines: str) -> DataFrame:
    """df with the array column `lines` after `merge_hyphens`, row by row.

    A line of flags, one a line, is paired by one replacement from the left, which is what greedy pairing does.
    """
    flags = F.transform(lines, lambda x, i: F.when(x.endswith("-") & (i < F.size(lines) - 1), "E").otherwise("N"))
    marks = F.split(F.regexp_replace(F.array_join(flags, ""), "E.", "MX"), "")
    after = F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit(None).cast("string")))
    both = F.arrays_zip(F.col(lines).alias("a"), after.alias("b"), marks.alias("m"))
    joined = lambda x: F.concat(F.left(x["a"], F.length(x["a"]) - 1), F.regexp_replace(x["b"], r"^\s+", ""))
    out = F.transform(F.filter(both, lambda x: (x["m"] != "X") & x["a"].isNotNull()), lambda x: F.when(x["m"] == "M", joined(x)).otherwise(x["a"]))
    return df.withColumn(lines, out)


def merge_hyphens(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with those that end in a hyphen joined to the next; a joined line is not tested again."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    nxt = F.lead("line").over(w)
    marked = pair_up(lines.withColumn("_next", nxt), F.col("line").endswith("-") & F.col("_next").isNotNull(), keys, "line_no")
    joined = F.concat(F.expr("left(line, length(line) - 1)"), F.regexp_replace("_next", r"^\s+", ""))
    return marked.where("NOT merged").withColumn("line", F.when(F.col("merges"), joined).otherwise(F.col("line"))).drop("_next", "merges", "merged")
