"""Line cleaning: noise, repeated headers and footers, exact and near duplicates, and texts put together again."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docengine.functions import text as T

HEADER_SHARE, HEADER_WORDS = 0.6, 12
LONG_KEY, SIMILAR, RECENT, LENGTH_GAP, EDGE = 40, 0.92, 10, 12, 12


def to_lines(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, line_no (from 0), line, after NFKC."""
    return df.select(*keys, F.posexplode(T.split_lines(T.nfkc(F.col(text)))).alias("line_no", "line"))


def solid_lines(lines: Column) -> Column:
    """Of an array of lines, those that are no noise, cleaned."""
    return F.filter(F.transform(lines, lambda x: T.clean_line(x)), lambda x: (x != "") & ~T.is_noise(x, stripped=True))


def first_of_equal(df: DataFrame, lines: str, key: Callable[[Column], Column] = T.casefold) -> DataFrame:
    """df with the array column `lines` without lines equal to an earlier one by `key`.

    Sorted by key and place, the first of equals is the one whose neighbour has another key; no line leaves its row.
    """
    order = F.array_sort(F.transform(lines, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("line"))))
    marked = df.withColumn("_s", order)
    one = F.array(F.struct(F.lit(None).cast("string").alias("k"), F.lit(-1).alias("i"), F.lit(None).cast("string").alias("line")))
    before = F.concat(one, F.slice("_s", F.lit(1), F.greatest(F.size("_s") - 1, F.lit(0))))
    kept = F.zip_with("_s", before, lambda a, b: F.when(a.isNotNull() & ~a["k"].eqNullSafe(b["k"]), F.struct(a["i"].alias("i"), a["line"].alias("line"))))
    return marked.withColumn(lines, F.transform(F.array_sort(F.filter(kept, lambda x: x.isNotNull())), lambda x: x["line"])).drop("_s")


def some_lines(df: DataFrame, lines: str) -> DataFrame:
    """Rows of df whose array `lines` is not empty.

    A filter would be pushed below what makes the lines, which would then be done twice; as an array of one it is done once.
    """
    one = F.explode(F.filter(F.array(lines), lambda x: F.size(x) > 0)).alias(lines)
    return df.select(*[one if c == lines else F.col(c) for c in df.columns])


@F.pandas_udf(ArrayType(StringType()))
def _near_lines(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: [line for line, new in zip(x, _fresh(x)) if new], na_action="ignore")


def without_near(lines: Column) -> Column:
    """An array of lines without those nearly equal to an earlier one. What is kept depends on what was kept before, hence an Arrow function, on rows as they are."""
    return _near_lines(lines)


def drop_exact(lines: DataFrame, keys: list[str], order: list[str], key: Column | None = None) -> DataFrame:
    """The first of lines that are equal within `keys` but for case."""
    k = T.casefold(T.clean_line(F.col("line"))) if key is None else key
    w = Window.partitionBy(*keys, "_key").orderBy(*order)
    return lines.withColumn("_key", k).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def _fresh(lines) -> list[bool]:
    seen: set = set()
    prints: set = set()
    recent: deque = deque(maxlen=RECENT)
    keep = []
    for line in lines:
        key = line.strip().casefold()
        new = bool(key) and key not in seen
        if new and len(key) > LONG_KEY:
            mark = (len(key), key[:EDGE], key[-EDGE:])
            new = mark not in prints and not any(abs(len(key) - len(p)) <= LENGTH_GAP and SequenceMatcher(None, key, p).ratio() >= SIMILAR for p in recent)
            if new:
                prints.add(mark)
                recent.append(key)
        if new:
            seen.add(key)
        keep.append(new)
    return keep


def _near(frame: pd.DataFrame) -> pd.DataFrame:
    return frame[pd.Series(_fresh(frame["line"]), index=frame.index, dtype=bool)]


def drop_near(lines: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """The first of equal or nearly equal lines within `keys`, in order. A dropped line is not remembered.

    What is kept depends on what was kept before, so each group is one pass of an Arrow function; groups are pages or
    documents, not the corpus.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*keys[1:], order], kind="stable")
        return _near(frame) if len(keys) == 1 else pd.concat([_near(part) for _, part in frame.groupby(keys[1:], sort=False)])

    return lines.groupBy(keys[0]).applyInPandas(run, lines.schema)


def clean_text(df: DataFrame, *keys: str, near: bool = True) -> DataFrame:
    """keys, text, n_lines of each text cleaned as one block, after NFKC, without a shuffle. Texts without a line left are not returned; join them back where needed."""
    lines = df.select(*keys, solid_lines(T.split_lines(T.nfkc(F.col("text")))).alias("lines"))
    kept = lines.withColumn("lines", without_near(F.col("lines"))) if near else first_of_equal(lines, "lines")
    return some_lines(kept, "lines").select(*keys, T.normalize_whitespace(F.array_join("lines", "\n")).alias("text"), F.size("lines").cast("long").alias("n_lines"))


def clean_block(df: DataFrame, text: str, near: bool = True) -> DataFrame:
    """df with the column `text`, which has NFKC behind it, cleaned as one block; an empty text where no line is left."""
    lines = df.withColumn("_lines", solid_lines(T.split_lines(F.col(text))))
    kept = lines.withColumn("_lines", without_near(F.col("_lines"))) if near else first_of_equal(lines, "_lines")
    return kept.withColumn(text, T.normalize_whitespace(F.array_join("_lines", "\n"))).drop("_lines")


def without_heads(df: DataFrame, lines: str = "lines", share: float = HEADER_SHARE, most_words: int = HEADER_WORDS) -> DataFrame:
    """Pages (doc_id, and an array `lines` of distinct lines, among others) without headers and footers: short lines on at least `share` of a document's
    pages that have lines, where those are two or more.

    Lines stay in their page's row; what is shuffled are the short lines that may be headers, counted by document. A null line stands for the page itself.
    """
    short = F.concat(F.filter(lines, lambda x: T.word_count(x) <= most_words), F.array(F.lit(None).cast("string")))
    counted = some_lines(df, lines).select("doc_id", F.explode(short).alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("df"))
    of = counted.groupBy("doc_id").agg(F.max(F.when(F.col("line").isNull(), F.col("df"))).alias("pages"), F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line", "df"))).alias("ls"))
    often = F.filter("ls", lambda x: x["df"] / F.col("pages") >= share)
    heads = of.where("pages >= 2").select("doc_id", F.transform(often, lambda x: x["line"]).alias("_heads"))
    body = df.join(heads, "doc_id", "left").withColumn("_heads", F.coalesce("_heads", F.array().cast("array<string>")))
    return body.withColumn(lines, F.filter(lines, lambda x: ~F.array_contains("_heads", x))).select(*df.columns)


def clean_pages(pages: DataFrame, near: bool = True) -> DataFrame:
    """The rows of `pages` (doc_id, page, text and others) with texts cleaned; in documents of two pages and more, headers and footers go first."""
    rest = [c for c in pages.columns if c != "text"]
    cut = pages.select(*rest, F.filter(F.transform(T.split_lines(T.nfkc(F.col("text"))), lambda x: T.clean_line(x)), lambda x: x != "").alias("lines"))
    body = without_heads(first_of_equal(cut, "lines", lambda x: x))
    kept = body.withColumn("lines", F.filter("lines", lambda x: ~T.is_noise(x, stripped=True)))
    kept = kept.withColumn("lines", without_near(F.col("lines"))) if near else first_of_equal(kept, "lines")
    return kept.select(*[T.normalize_whitespace(F.array_join("lines", "\n")).alias("text") if c == "text" else F.col(c) for c in pages.columns])


def full_text(pages: DataFrame) -> DataFrame:
    """doc_id, text: non-blank pages with their marks, in order."""
    page = F.struct("page", F.format_string("[Page %d]\n%s", F.col("page"), F.col("text")).alias("line"))
    ordered = F.array_sort(F.collect_list(page))
    return pages.where(T.strip(F.col("text")) != "").groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n---\n\n").alias("text"))
