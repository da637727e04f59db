"""Every query of the engine's own operators over the driver's tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import classify, clean, jobs, layout, ocr, tables, validate
from docengine.plans import stand_ins as S
from docengine.plans.extraction import extract
from docengine.session import ship
from docengine.sources import documents as sources
from docengine.sources.documents import literal_stream, literal_text, upload_error

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_RUN = "len(list_filter(range(1, length({0}) - 3), lambda i: substr({0}, i, 5) = repeat(substr({0}, i, 1), 5))) > 0"
_S = _STRIP.format("line")
_REASON = rf"""CASE WHEN {_S} = '' THEN 'blank'
  WHEN regexp_matches({_S}, '^[^\p{{L}}\p{{N}}_\s]{{3,}}$') THEN 'symbols'
  WHEN length({_S}) >= 5 AND (lower(substr({_S}, 1, 5)) = repeat(lower(substr({_S}, 1, 1)), 5) OR {_RUN.format(_S)}) THEN 'run'
  WHEN regexp_matches({_S}, '^\s*[-_=*#]{{5,}}\s*$') THEN 'separator'
  WHEN regexp_matches({_S}, '(?i)^Page\s+\d+\s+of\s+\d+$') THEN 'page mark'
  WHEN NOT regexp_matches({_S}, '[\p{{L}}\p{{N}}]') THEN 'no letters' END"""
_WORDS = "len(list_filter(string_split_regex({}, '[ \\t\\n\\r]+'), lambda x: x <> ''))"


@query(f"""WITH {S.DOC_LINES},
k AS (SELECT doc_id, line_no, {_S} AS line, {_REASON} AS reason FROM doc_lines),
r AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id, replace(lower(line), 'ß', 'ss') ORDER BY line_no) AS n FROM k WHERE reason IS NULL)
SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM r WHERE n = 1 GROUP BY doc_id""")
def doc_line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    lines = S.read(spark, sf_dir, "documents").select("doc_id", clean.solid_lines(F.split(T.nfkc(F.col("text")), "\n", -1)).alias("lines"))
    out = clean.some_lines(clean.first_of_equal(lines, "lines"), "lines").select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "\n").alias("text"))
    return out.select("doc_id", "n_lines", (F.length("text") - F.col("n_lines") + 1).cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"WITH {S.PAGE_LINES_SQL} SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n, sum(length(line))::BIGINT AS n_chars FROM page_lines GROUP BY ALL")
def line_noise_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.page_lines(spark, sf_dir).select(F.explode("lines").alias("line"))
    return lines.groupBy(F.coalesce(T.noise_reason(F.col("line")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("n_chars"))


@query(f"""WITH {S.PAGE_LINES_SQL},
o AS (SELECT doc_id, page, line, min(line_no) AS line_no FROM page_lines GROUP BY doc_id, page, line),
p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM o GROUP BY doc_id),
rep AS (SELECT o.doc_id, line FROM o JOIN p USING (doc_id) GROUP BY o.doc_id, line, pages HAVING count(DISTINCT page) / pages >= 0.6 AND pages >= 2 AND {_WORDS.format('line')} <= 12)
SELECT doc_id, page, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM o ANTI JOIN rep USING (doc_id, line) GROUP BY doc_id, page""")
def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = clean.first_of_equal(S.page_lines(spark, sf_dir), "lines", lambda x: x)
    out = clean.some_lines(clean.without_heads(once), "lines")
    return out.select("doc_id", "page", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


_STITCH = r"""
x AS (SELECT doc_id, page, text, confidence, lead(text) OVER (PARTITION BY doc_id ORDER BY page) AS nx FROM page_conf),
e AS (SELECT *, coalesce(text <> '' AND nx <> '' AND NOT regexp_matches(text, '[.!?।॥]$') AND regexp_matches(nx, '^\p{Ll}'), false) AS ok FROM x),
r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM e),
m AS (SELECT *, ok AND row_number() OVER (PARTITION BY doc_id, run, ok ORDER BY page) % 2 = 1 AS merges FROM r),
g AS (SELECT *, coalesce(lag(merges) OVER (PARTITION BY doc_id ORDER BY page), false) AS merged FROM m),
stitched AS (SELECT doc_id, page, confidence, merges, CASE WHEN merges THEN text || ' ' || nx WHEN merged THEN '' ELSE text END AS text FROM g)
"""


@query(f"WITH {S.PAGE_CONF}, {_STITCH} SELECT doc_id, page, merges AS stitched, length(text)::INT AS n_chars, md5(text) AS digest FROM stitched")
def page_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.stitch(S.page_conf(spark, sf_dir)).select("doc_id", "page", "stitched", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"""WITH {S.FIXED_LINES},
x AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nx FROM fixed_lines),
e AS (SELECT *, coalesce(line LIKE '%-' AND nx IS NOT NULL, false) AS ok FROM x),
r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM e),
m AS (SELECT *, ok AND row_number() OVER (PARTITION BY doc_id, run, ok ORDER BY line_no) % 2 = 1 AS merges FROM r),
g AS (SELECT *, coalesce(lag(merges) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS merged FROM m)
SELECT doc_id, count(*) AS n_lines, count_if(merges)::BIGINT AS n_merged,
       md5(string_agg(CASE WHEN merges THEN left(line, length(line) - 1) || regexp_replace(nx, '^\\s+', '') ELSE line END, chr(10) ORDER BY line_no)) AS digest
FROM g WHERE NOT merged GROUP BY doc_id""")
def hyphen_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.fixed_texts(spark, sf_dir).withColumn("before", F.size("lines"))
    out = layout.merge_hyphens_in(lines, "lines")
    n = F.size("lines")
    return out.select("doc_id", n.cast("long").alias("n_lines"), (F.col("before") - n).cast("long").alias("n_merged"), F.md5(F.array_join("lines", "\n")).alias("digest"))


_FLAGS = f"""array_to_string(list_filter([
  CASE WHEN text = '' THEN 'No text extracted from this page.' END,
  CASE WHEN coalesce(confidence, 1) < 0.4 THEN printf('Very low OCR confidence (%.2f). Page may be too blurry or low resolution.', confidence)
       WHEN coalesce(confidence, 1) < 0.65 THEN printf('Low OCR confidence (%.2f). Review recommended.', confidence) END,
  CASE WHEN {_WORDS.format('text')} BETWEEN 1 AND 9 THEN printf('Very little text extracted (%d words). Possible blank/decorative page.', {_WORDS.format('text')}) END
], lambda x: x IS NOT NULL), ' | ')"""


@query(f"WITH {S.PAGE_CONF}, {_STITCH} SELECT doc_id, page, {_FLAGS} AS warnings FROM stitched")
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = validate.stitch(S.page_conf(spark, sf_dir))
    return pages.select("doc_id", "page", F.array_join(validate.page_flags(F.col("text"), F.col("confidence")), " | ").alias("warnings"))


@query(f"""WITH {S.PAGE_CONF}, c AS (SELECT doc_id, round(avg(coalesce(confidence, CASE WHEN text <> '' THEN 0.95 ELSE 0 END)), 4) AS confidence FROM page_conf GROUP BY doc_id)
SELECT doc_id, confidence, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS quality FROM c""")
def doc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.document_confidence(S.page_conf(spark, sf_dir))


_COVER = "cov AS (SELECT page, least((max(x1) - min(x0)) * (max(y1) - min(y0)) / 484704.0, 1.0) AS coverage FROM blocks GROUP BY page)"


@query(f"WITH {S.BLOCKS}, {_COVER} SELECT page, round(coverage, 6) AS coverage FROM cov")
def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.text_coverage(S.blocks(spark, sf_dir), ["page"], F.lit(612.0 * 792.0))
    return out.select("page", F.round("coverage", 6).alias("coverage"))


_CLASSIFIED = f"""{S.WORD_PAGES}, {S.BLOCKS}, {_COVER},
cls AS (SELECT doc_id, word_pages.page, length(text)::INT AS chars, coalesce(coverage, 0) AS coverage FROM
        (SELECT doc_id, page, CASE WHEN (doc_id + page) % 4 = 0 THEN '' ELSE text END AS text FROM word_pages) word_pages LEFT JOIN cov ON cov.page = doc_id * 3 + word_pages.page),
typed AS (SELECT doc_id, page, chars, round(coverage, 6) AS coverage, CASE WHEN (chars >= 20 AND coverage > 0.005) OR coverage > 0.01 THEN 'digital' ELSE 'scanned' END AS pdf_type FROM cls)"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when((F.col("doc_id") + F.col("page")) % 4 == 0, "").otherwise(F.col("text"))
    cover = classify.text_coverage(S.blocks(spark, sf_dir), ["page"], F.lit(612.0 * 792.0)).withColumnRenamed("page", "at")
    pages = S.word_pages(spark, sf_dir).withColumn("text", text).withColumn("at", F.col("doc_id") * 3 + F.col("page")).join(cover, "at", "left")
    chars, coverage = classify.char_count(F.col("text"), F.lit(None), F.lit(None), F.lit(None)), F.coalesce("coverage", F.lit(0.0))
    return pages.select("doc_id", "page", "text", chars.alias("chars"), coverage.alias("coverage"), classify.page_type(chars, coverage, T.has_gujarati(F.col("text"))).alias("pdf_type"))


@query(f"WITH {_CLASSIFIED} SELECT doc_id, page, chars, coverage, pdf_type FROM typed")
def page_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("doc_id", "page", "chars", F.round("coverage", 6).alias("coverage"), "pdf_type")


@query(f"""WITH {_CLASSIFIED} SELECT doc_id, count_if(pdf_type = 'digital')::BIGINT AS digital_page_count, count_if(pdf_type = 'scanned')::BIGINT AS scanned_page_count, count(*) AS total_pages,
CASE WHEN bool_and(pdf_type = 'digital') THEN 'digital' WHEN bool_and(pdf_type = 'scanned') THEN 'scanned' ELSE 'mixed' END AS overall_type FROM typed GROUP BY doc_id""")
def doc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.document_type(_typed(spark, sf_dir))


@query(f"""WITH {S.BLOCKS}, n AS (SELECT page, count_if((x0 + x1) / 2 < 306) AS l, count_if((x0 + x1) / 2 >= 306) AS r FROM blocks GROUP BY page)
SELECT page, CASE WHEN least(l, r) > 0 AND least(l, r) / greatest(l, r) > 0.3 THEN 2 ELSE 1 END AS n_columns FROM n""")
def column_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.columns_of(S.blocks(spark, sf_dir), ["page"])


_TOTAL = f"WITH RECURSIVE {S.BLOCKS}, "
_FOLD = """
s AS (SELECT {part}, x0, y0, ord, text, row_number() OVER (PARTITION BY {part} ORDER BY y0, ord, x0) AS k FROM {src}),
f AS (SELECT {part}, x0, y0, ord, text, k, y0 AS anchor, 0 AS grp FROM s WHERE k = 1
      UNION ALL SELECT {sp}, s.x0, s.y0, s.ord, s.text, s.k, CASE WHEN abs(s.y0 - f.anchor) > 5 THEN s.y0 ELSE f.anchor END, f.grp + CASE WHEN abs(s.y0 - f.anchor) > 5 THEN 1 ELSE 0 END
      FROM f JOIN s ON {on} AND s.k = f.k + 1)
"""


@query(_TOTAL + _FOLD.format(part="page", sp="s.page", src="blocks", on="s.page = f.page") + " SELECT page, (max(grp) + 1)::INT AS n_rows, string_agg(text || ord, ' ' ORDER BY grp, x0, y0, ord) AS reading FROM f GROUP BY page")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = layout.reading_order(S.blocks(spark, sf_dir), ["page"])
    return _reading(placed, (F.max("row") + 1).cast("int").alias("n_rows"))


def _reading(placed: DataFrame, *more: Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("position", F.concat("text", F.col("ord").cast("string")).alias("t"))))
    return placed.groupBy("page").agg(*more, F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("reading"))


@query(
    _TOTAL
    + """n AS (SELECT page, count_if((x0 + x1) / 2 < 306) AS l, count_if((x0 + x1) / 2 >= 306) AS r FROM blocks GROUP BY page),
c AS (SELECT blocks.*, CASE WHEN least(l, r) > 0 AND least(l, r) / greatest(l, r) > 0.3 AND (x0 + x1) / 2 >= 306 THEN 1 ELSE 0 END AS col FROM blocks JOIN n USING (page)),"""
    + _FOLD.format(part="page, col", sp="s.page, s.col", src="c", on="s.page = f.page AND s.col = f.col")
    + " SELECT page, string_agg(text || ord, ' ' ORDER BY col, grp, x0, y0, ord) AS reading FROM f GROUP BY page"
)
def reading_order_2col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reading(layout.reading_order_columns(S.blocks(spark, sf_dir), ["page"]))


_LINES = """
h AS (SELECT page, list_sort(list(greatest(y1 - y0, 0)))[(count(*) // 2 + 1)::INT] AS height FROM blocks GROUP BY page),
b AS (SELECT blocks.*, height, max(y1) OVER (PARTITION BY page ORDER BY y0, x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bottom FROM blocks JOIN h USING (page)),
l AS (SELECT *, sum(CASE WHEN y0 > bottom + greatest(3, height * 0.7) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, x0, ord ROWS UNBOUNDED PRECEDING) AS line FROM b),
ln AS (SELECT page, line, min(y0) AS top, max(y1) AS bottom, max(height) AS height, string_agg(text, ' ' ORDER BY x0, y0, ord, text) AS text FROM l GROUP BY page, line)
"""


@query(f"WITH {S.BLOCKS}, {_LINES} SELECT page, line::BIGINT AS line, round(top, 4) AS top, round(bottom, 4) AS bottom, text FROM ln")
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = layout.word_lines(S.blocks(spark, sf_dir), ["page"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "ord", "text"))), lambda x: x["text"]), " ")
    return w.groupBy("page", "line").agg(F.round(F.min("y0"), 4).alias("top"), F.round(F.max("y1"), 4).alias("bottom"), text.alias("text"))


@query(f"""WITH {S.BLOCKS}, {_LINES},
g AS (SELECT *, top - lag(bottom) OVER (PARTITION BY page ORDER BY line) > greatest(8, height * 1.4) AS new FROM ln),
p AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line) AS paragraph FROM g)
SELECT page, paragraph::BIGINT AS paragraph, string_agg(text, ' ' ORDER BY line) AS text FROM p GROUP BY page, paragraph""")
def word_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.word_paragraphs(S.blocks(spark, sf_dir), ["page"])


@query(f"""WITH {S.BLOCKS},
g AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY page ORDER BY y0, x0, ord) > 15.6 AS new FROM blocks),
p AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, x0, ord) AS paragraph FROM g)
SELECT page, paragraph::BIGINT AS paragraph, string_agg(text, ' ' ORDER BY y0, x0, ord) AS text FROM p GROUP BY page, paragraph""")
def block_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.blocks(spark, sf_dir).withColumn("position", F.struct("y0", "x0", "ord"))
    return layout.block_paragraphs(b, ["page"])


@query(f"""WITH {S.DOC_LINES},
t AS (SELECT doc_id, line_no, {_S} AS line FROM (SELECT doc_id, line_no, CASE WHEN line_no % 5 IN (2, 3) THEN '' ELSE line END AS line FROM doc_lines)),
g AS (SELECT *, line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) > 2 AS new FROM t WHERE line <> ''),
p AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS paragraph FROM g)
SELECT doc_id, paragraph::BIGINT AS paragraph, md5(string_agg(line, ' ' ORDER BY line_no)) AS digest FROM p GROUP BY doc_id, paragraph""")
def blank_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.doc_lines(spark, sf_dir).withColumn("line", F.when((F.col("line_no") % 5).isin(2, 3), "").otherwise(F.col("line")))
    return layout.blank_paragraphs(lines, ["doc_id"]).select("doc_id", "paragraph", F.md5("text").alias("digest"))


_CLUSTER = """
d AS (SELECT DISTINCT page, y0 AS y FROM blocks), s AS (SELECT page, y, row_number() OVER (PARTITION BY page ORDER BY y) AS k FROM d),
f AS (SELECT page, y, k, y AS kept FROM s WHERE k = 1 UNION ALL SELECT s.page, s.y, s.k, CASE WHEN s.y - f.kept > 10 THEN s.y ELSE f.kept END FROM f JOIN s ON s.page = f.page AND s.k = f.k + 1),
dx AS (SELECT DISTINCT page, x0 AS y FROM blocks), sx AS (SELECT page, y, row_number() OVER (PARTITION BY page ORDER BY y) AS k FROM dx),
fx AS (SELECT page, y, k, y AS kept FROM sx WHERE k = 1 UNION ALL SELECT sx.page, sx.y, sx.k, CASE WHEN sx.y - fx.kept > 10 THEN sx.y ELSE fx.kept END FROM fx JOIN sx ON sx.page = fx.page AND sx.k = fx.k + 1)
"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.blocks(spark, sf_dir).groupBy("page").agg(F.collect_set("y0").alias("ys"), F.collect_set("x0").alias("xs"))
    return g.select("page", tables.cluster(F.col("ys")).alias("row_ys"), tables.cluster(F.col("xs")).alias("col_xs"))


@query(f"WITH RECURSIVE {S.BLOCKS}, {_CLUSTER}, c AS (SELECT DISTINCT page, kept AS y FROM f), p AS (SELECT page, y, y - lag(y) OVER (PARTITION BY page ORDER BY y) > 30 AS new FROM c) SELECT page, y, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y)::BIGINT AS part FROM p")
def grid_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.split_by_gap(_grid(spark, sf_dir).select("page", F.explode("row_ys").alias("y")), ["page"])


@query(f"""WITH RECURSIVE {S.BLOCKS}, {_CLUSTER},
r AS (SELECT page, y AS lo, lead(y) OVER (PARTITION BY page ORDER BY y) AS hi, row_number() OVER (PARTITION BY page ORDER BY y) - 1 AS "row" FROM (SELECT DISTINCT page, kept AS y FROM f)),
c AS (SELECT page, y AS lo, lead(y) OVER (PARTITION BY page ORDER BY y) AS hi, row_number() OVER (PARTITION BY page ORDER BY y) - 1 AS col FROM (SELECT DISTINCT page, kept AS y FROM fx))
SELECT b.page, "row"::INT AS "row", col::INT AS col, string_agg(text, ' ' ORDER BY ord, text) AS text FROM blocks b
JOIN r ON r.page = b.page AND (y0 + y1) / 2 >= r.lo AND (y0 + y1) / 2 < r.hi JOIN c ON c.page = b.page AND (x0 + x1) / 2 >= c.lo AND (x0 + x1) / 2 < c.hi GROUP BY ALL""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = S.blocks(spark, sf_dir).select("page", "ord", "text", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return tables.to_cells(tokens, _grid(spark, sf_dir), ["page"])


_CELLS = """cells AS (SELECT o_custkey AS tbl, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN [o_orderstatus, ' '] WHEN o_orderkey % 7 = 0 THEN [o_orderstatus]
  ELSE [o_orderstatus, o_orderpriority] END AS r FROM orders), t AS (SELECT tbl, list(r ORDER BY k) AS rs, count(*) AS n FROM cells GROUP BY tbl)"""


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    row = F.when(k % 5 == 0, F.array(s, F.lit(" "))).when(k % 7 == 0, F.array(s)).otherwise(F.array(s, F.col("o_orderpriority")))
    t = S.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("tbl")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("r")))), lambda x: x["r"]).alias("rs"))
    return t.select("tbl", F.when(F.col("tbl") % 9 != 0, F.array(F.lit("status"), F.lit("priority"))).alias("headers"), F.when(F.col("tbl") % 10 != 0, F.col("rs")).alias("rows"))


@query(f"""WITH {_CELLS}, c AS (SELECT tbl, list_concat(CASE WHEN tbl % 9 <> 0 THEN ['status', 'priority'] ELSE [] END, CASE WHEN tbl % 10 <> 0 THEN flatten(rs) ELSE [] END) AS cs FROM t)
SELECT tbl, CASE WHEN len(cs) = 0 THEN 0.0 ELSE round(len(list_filter(cs, lambda x: trim(x) <> '')) / len(cs), 4) END AS fill_rate FROM c""")
def table_fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select("tbl", validate.fill_rate(F.col("headers"), F.col("rows")).alias("fill_rate"))


@query(f"""WITH {_CELLS}, x AS (SELECT tbl, CASE WHEN tbl % 9 = 0 OR tbl % 10 = 0 THEN
  list_filter([CASE WHEN tbl % 9 = 0 THEN 'Table has no headers.' END, CASE WHEN tbl % 10 = 0 THEN 'Table has no data rows.' END], lambda x: x IS NOT NULL)
  ELSE list_transform(list_filter(range(1, n + 1), lambda i: len(rs[i]) <> 2), lambda i: 'Row ' || i || ' has ' || len(rs[i]) || ' cells, expected 2.') END AS issues FROM t)
SELECT tbl, len(issues) = 0 AS valid, array_to_string(issues, ' ') AS issues FROM x""")
def table_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = validate.table_issues(F.col("headers"), F.col("rows"))
    return _tables(spark, sf_dir).select("tbl", (F.size(issues) == 0).alias("valid"), F.array_join(issues, " ").alias("issues"))


@query(f"""WITH {S.PAGE_CONF}, {_STITCH}
SELECT doc_id, md5(string_agg('[Page ' || page || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page)) AS digest FROM stitched WHERE text <> '' GROUP BY doc_id""")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.full_text(validate.stitch(S.page_conf(spark, sf_dir))).select("doc_id", F.md5("text").alias("digest"))


@query(f"""WITH {S.PAGE_CONF}, {_STITCH}, ww AS (SELECT doc_id, page, unnest(string_split({_FLAGS}, ' | ')) AS warning, generate_subscripts(string_split({_FLAGS}, ' | '), 1) AS i FROM stitched),
a AS (SELECT doc_id, list('Page ' || page || ': ' || warning ORDER BY page, i) FILTER (warning <> '') AS ws FROM ww GROUP BY doc_id)
SELECT doc_id, md5(array_to_string(coalesce(ws, [])[1:50], ' | ')) AS digest, coalesce(len(ws), 0) > 50 AS warnings_truncated, coalesce(len(ws), 0)::INT AS total_warning_count FROM a""")
def warnings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = validate.stitch(S.page_conf(spark, sf_dir)).withColumn("warnings", validate.page_flags(F.col("text"), F.col("confidence")))
    return validate.warnings_rollup(pages).select("doc_id", F.md5(F.array_join("warnings", " | ")).alias("digest"), "warnings_truncated", "total_warning_count")


_RESULTS = "res AS (SELECT doc_id AS job_id, sha256(text) AS sha256, CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'done' END AS status, doc_id % 3 <> 0 AS fresh FROM documents WHERE doc_id % 2 = 0)"


@query(f"""WITH {_RESULTS}, f AS (SELECT sha256, min(job_id) AS cached FROM res WHERE fresh AND status = 'done' GROUP BY sha256)
SELECT doc_id AS job_id, CASE WHEN cached < doc_id THEN cached END AS cached_job, CASE WHEN cached < doc_id THEN 'reuse' ELSE 'process' END AS action FROM documents LEFT JOIN f ON f.sha256 = sha256(text)""")
def upload_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.sha2("text", 256).alias("sha256"))
    as_of = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    until = F.when(F.col("job_id") % 3 != 0, as_of + F.expr("INTERVAL 1 HOUR")).otherwise(as_of - F.expr("INTERVAL 1 HOUR"))
    results = d.where("job_id % 2 = 0").withColumns({"status": F.when(F.col("job_id") % 4 == 0, "failed").otherwise("done"), "expires_at": until})
    return jobs.reuse(d, results, as_of).select("job_id", "cached_job", "action")


_STATUS = """j AS (SELECT job_id, u.job_id IS NOT NULL AS up, r.status AS r_status, s.state AS w_status,
  CASE WHEN r.job_id IS NULL THEN NULL WHEN expires_at IS NOT NULL THEN expires_at <= as_of ELSE floor(epoch(as_of)) - floor(epoch(r.modified)) > 7200 END AS gone
  FROM uploads u FULL JOIN results r USING (job_id) FULL JOIN states s USING (job_id) CROSS JOIN clock),
st AS (SELECT job_id, CASE WHEN gone THEN 'expired' WHEN r_status IS NOT NULL THEN r_status WHEN NOT up THEN 'unknown' WHEN w_status IS NOT NULL THEN w_status ELSE 'processing' END AS status,
  CASE WHEN gone THEN 0.0 WHEN r_status IS NOT NULL THEN 100.0 WHEN NOT up THEN 0.0 WHEN w_status IS NOT NULL THEN 40.0 ELSE 5.0 END::DOUBLE AS progress FROM j)"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads, states, results = S.jobs(spark, sf_dir)
    clock = S.read(spark, sf_dir, "events").agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("as_of")).first().as_of
    return jobs.status(uploads, states, results, F.lit(clock).cast("timestamp_ntz"))


@query(f"WITH {S.JOBS}, {_STATUS} SELECT job_id, status, progress FROM st")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


@query(f"""WITH {S.JOBS}, {_STATUS} SELECT job_id, CASE status WHEN 'unknown' THEN 404 WHEN 'expired' THEN 410 WHEN 'done' THEN 200 WHEN 'processing' THEN 202 WHEN 'pending' THEN 202 ELSE 500 END AS http_status FROM st""")
def job_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select("job_id", jobs.http_status(F.col("status")).alias("http_status"))


@query(f"WITH {S.JOBS} SELECT job_id, floor(epoch(as_of))::BIGINT - floor(epoch(modified))::BIGINT AS age FROM uploads CROSS JOIN clock WHERE floor(epoch(as_of))::BIGINT - floor(epoch(modified))::BIGINT > 3600")
def ttl_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.lit(S.read(spark, sf_dir, "events").agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("as_of")).first().as_of).cast("timestamp_ntz")
    age = F.unix_timestamp(clock.cast("timestamp")) - F.unix_timestamp(F.col("modified").cast("timestamp"))
    return jobs.stale_uploads(S.jobs(spark, sf_dir)[0], clock).select("job_id", age.alias("age"))


@query(f"WITH {S.WORD_PAGES}, n AS (SELECT doc_id, count(*) AS pages FROM word_pages GROUP BY doc_id) SELECT doc_id, pages, least(150, CASE WHEN pages <= 10 THEN 150 WHEN pages <= 30 THEN 120 ELSE 100 END)::INT AS dpi FROM n")
def dpi_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.word_pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("pages"))
    return n.withColumn("dpi", classify.dpi(F.col("pages"), F.lit(150)))


@query(f"WITH {_CLASSIFIED} SELECT doc_id, page, pdf_type, CASE WHEN pdf_type = 'digital' THEN 0.95::DOUBLE END AS confidence FROM typed")
def union_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    digital, scanned = classify.route(_typed(spark, sf_dir).select("doc_id", "page", "pdf_type"))
    return classify.unite(digital.withColumn("confidence", F.lit(0.95)), scanned)


_W = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'))"
_A = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}]'))"


@query(rf"""WITH c AS (SELECT doc_id, 0 AS ord, text FROM documents UNION ALL SELECT doc_id, 1, lower(text) FROM documents UNION ALL SELECT doc_id, 2, replace(text, ' ', chr(10)) FROM documents),
s AS (SELECT doc_id, ord, {_STRIP.format('text')} AS t FROM c), l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: {_STRIP.format('x')} <> '') AS ls FROM s),
k AS (SELECT doc_id, ord, length(t) AS n, CASE WHEN t = '' THEN -1e9 ELSE {_A.format('t')} + {_W.format('t')} * 2.0 + len(ls) * 3.0
  - len(list_filter(ls, lambda x: {_WORDS.format('x')} = 1)) * 2.5 - len(list_filter(ls, lambda x: length(x) <= 2)) * 4.0 - len(regexp_extract_all(t, '  ')) * 0.5 END::DOUBLE AS score FROM l)
SELECT doc_id, arg_max(ord, {{'s': score, 'o': -ord}})::INT AS ord, round(max(score), 2) AS score FROM k GROUP BY doc_id""")
def text_candidate_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    best = classify.best_of([text, F.lower(text), F.replace(text, F.lit(" "), F.lit("\n"))])
    return S.read(spark, sf_dir, "documents").select("doc_id", best.alias("b")).select("doc_id", "b.ord", F.round("b.score", 2).alias("score"))


@query(rf"""WITH {S.PAGE_CONF}, n AS (SELECT doc_id, page, coalesce(confidence, 0.2) AS c, text, length(regexp_replace(text, '\s', '', 'g')) AS n, len(regexp_extract_all(text, '[A-Za-z]')) + len(regexp_extract_all(text, '\p{{Nd}}')) AS r FROM page_conf)
SELECT doc_id, page, round(least(greatest(c * 0.5 + r / n * 0.35, 0), 1) + 1e-9, 4) AS score, c >= 0.25 AND (length(text) >= 8 OR {_WORDS.format('text')} >= 2) AS good FROM n""")
def ocr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.coalesce("confidence", F.lit(0.2))
    return S.page_conf(spark, sf_dir).select("doc_id", "page", T.ocr_score(F.col("text"), c).alias("score"), T.ocr_good(F.col("text"), c).alias("good"))


@query(rf"""WITH s AS (SELECT doc_id, {_STRIP.format('text')} AS t FROM documents), l AS (SELECT *, len(list_filter(string_split(t, chr(10)), lambda x: {_STRIP.format('x')} <> '')) AS n, {_W.format('t')} AS w, {_A.format('t')} AS a FROM s)
SELECT doc_id, t <> '' AND (a >= 10 OR w >= 3 OR length(t) >= 20) AS reasonable, t <> '' AND (a >= 10 OR w >= 3 OR length(t) >= 20) AND n <= 6 AND w >= 5 AS fast_accept FROM l""")
def accept_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "documents").select("doc_id", T.looks_reasonable(F.col("text")).alias("reasonable"), T.fast_accept(F.col("text")).alias("fast_accept"))


@query()
def near_dup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    lines = S.read(spark, sf_dir, "documents").select("doc_id", clean.solid_lines(F.split(T.nfkc(F.col("text")), "\n", -1)).alias("lines"))
    out = clean.some_lines(lines.withColumn("lines", clean.without_near(F.col("lines"))), "lines")
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@query()
def nfkc_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    d = S.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.normalize_whitespace(T.clean_line(F.col("text"), unicode=True))).alias("digest"))


@query()
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "documents").select("doc_id", "lang", T.detect_language(F.col("text")).alias("detected"))


@query()
def pdf_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts put into a minimal content stream and read back."""
    d = S.read(spark, sf_dir, "documents").select("doc_id", "text", literal_stream(F.col("text")).alias("content"))
    same = F.encode(literal_text(F.col("content")), "ISO-8859-1") == F.col("text").cast("binary")
    return d.select("doc_id", same.alias("same"), upload_error(F.lit("x.pdf"), F.length("content"), F.col("content")).alias("error"))


@query()
def document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every document's pages cleaned, stitched, scored and put together."""
    ship(spark)
    pages = S.page_conf(spark, sf_dir).withColumn("pdf_type", F.when(F.col("confidence") < 0.5, "scanned").otherwise("digital"))
    r = extract(pages)
    return r.select("doc_id", "status", "confidence", "language", F.size("pages").alias("n_pages"), F.md5("text").alias("digest"), "metadata.overall_type", "metadata.quality", "metadata.total_warning_count")


# --- OCR tokens and passes: order lines as tokens with corners and a confidence, documents as what several passes have read

_TOKENS = """tok AS (SELECT l_orderkey AS page, l_extendedprice / 200 AS x0, l_quantity * 3 AS y0, l_returnflag || l_linestatus AS text, trunc(l_extendedprice / 200 * 1000)::BIGINT AS ord, 1 - l_discount * 9 AS conf FROM lineitem)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    b = S.blocks(spark, sf_dir).select("page", "ord", "text", F.array(corner("x1", "y1"), corner("x0", "y1"), corner("x1", "y0"), corner("x0", "y0")).alias("box"), ((F.col("y1") - F.col("y0")) / 100).alias("d"))
    # blocks carry the discount as their height, a hundred times
    return b.withColumn("conf", 1 - F.round("d", 4) * 9).drop("d")


@query(f"""WITH RECURSIVE {_TOKENS},
s AS (SELECT page, x0, y0, ord, text, row_number() OVER (PARTITION BY page ORDER BY y0, ord, x0) AS k FROM tok WHERE conf >= 0.3),
f AS (SELECT page, x0, y0, ord, text, k, y0 AS anchor, 0 AS grp FROM s WHERE k = 1
      UNION ALL SELECT s.page, s.x0, s.y0, s.ord, s.text, s.k, CASE WHEN abs(s.y0 - f.anchor) > 4 THEN s.y0 ELSE f.anchor END, f.grp + CASE WHEN abs(s.y0 - f.anchor) > 4 THEN 1 ELSE 0 END FROM f JOIN s ON s.page = f.page AND s.k = f.k + 1),
p AS (SELECT page, y0, text, row_number() OVER (PARTITION BY page ORDER BY grp, x0, y0, ord) AS k FROM f),
l AS (SELECT page, k, text, y0 AS anchor, 0 AS line FROM p WHERE k = 1
      UNION ALL SELECT p.page, p.k, p.text, CASE WHEN abs(p.y0 - l.anchor) > 4 THEN p.y0 ELSE l.anchor END, l.line + CASE WHEN abs(p.y0 - l.anchor) > 4 THEN 1 ELSE 0 END FROM l JOIN p ON p.page = l.page AND p.k = l.k + 1)
SELECT page, line, string_agg(text, ' ' ORDER BY k) AS text FROM l GROUP BY page, line""")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.lines(ocr.kept(ocr.placed(_tokens(spark, sf_dir))), ["page"], F.lit(150))


@query(f"""WITH {_TOKENS}, a AS (SELECT page, avg(conf) AS c FROM tok WHERE conf >= 0.3 GROUP BY page), b AS (SELECT DISTINCT page FROM tok)
SELECT page, round(coalesce(c, 0), 6) AS confidence FROM b LEFT JOIN a USING (page)""")
def ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir)
    return ocr.page_confidence(ocr.kept(ocr.placed(t)), t, ["page"]).select("page", F.round("confidence", 6).alias("confidence"))


_GU = "ગુજરાતી લખાણ "
_SCORE = r"""CASE WHEN n = 0 THEN 0 ELSE round(least(greatest(conf * 0.5 + (g + len(regexp_extract_all(text, '[A-Za-z]')) + len(regexp_extract_all(text, '\p{Nd}'))) / n * 0.35 + g / n * 0.15, 0), 1) + 1e-9, 4) END"""
_N = r"length(regexp_replace(text, '\s', '', 'g')) AS n, len(regexp_extract_all(text, '[\x{0A80}-\x{0AFF}]')) AS g"


@query(rf"""WITH c AS (SELECT doc_id, 0 AS ord, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END AS text, 0.2 + doc_id % 4 / 10 AS conf FROM documents
  UNION ALL SELECT doc_id, 1, reverse(text), 0.2 + doc_id % 4 / 10 FROM documents UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 5 = 0 THEN '{_GU}' || text ELSE '...' END, 0.3 FROM documents),
n AS (SELECT *, {_N} FROM c), s AS (SELECT doc_id, ord, ({_SCORE})::DOUBLE AS score FROM n)
SELECT doc_id, arg_max(ord, {{'s': score, 'o': -ord}})::INT AS ord, max(score) AS score FROM s GROUP BY doc_id""")
def best_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = S.read(spark, sf_dir, "documents"), F.col("doc_id")
    conf, text = F.lit(0.2) + i % 4 / 10, F.col("text")
    one = lambda n, t, c: F.struct(F.lit(n).alias("ord"), t.alias("text"), c.alias("conf"))
    three = F.array(
        one(0, F.when(i % 3 == 0, " ").otherwise(text), conf), one(1, F.reverse(text), conf), one(2, F.when(i % 5 == 0, F.concat(F.lit(_GU), text)).otherwise("..."), F.lit(0.3)),
    )
    return ocr.best_pass(d.select("doc_id", F.explode(three).alias("p")).select("doc_id", "p.*"), ["doc_id"]).select("doc_id", "ord", "score")


@query(rf"""WITH c AS (SELECT doc_id, unnest([
  {{'k': 0, 'text': CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE text END, 'conf': doc_id % 10 / 10}},
  {{'k': 1, 'text': CASE WHEN doc_id % 6 = 0 THEN '' ELSE lower(text) END, 'conf': doc_id % 7 / 10}},
  {{'k': 2, 'text': CASE WHEN doc_id % 12 = 0 THEN '' WHEN doc_id % 18 = 0 THEN '%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%' ELSE replace(text, ' ', '  ') END, 'conf': doc_id % 3 / 10}}], max_depth := 2) FROM documents),
n AS (SELECT *, {_N} FROM c), s AS (SELECT doc_id, k, text, ({_SCORE})::DOUBLE AS score FROM n),
w AS (SELECT a.doc_id, CASE WHEN trim(a.text) = '' AND b.score > a.score THEN b ELSE a END AS t, c FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.k = 1 JOIN s c ON c.doc_id = a.doc_id AND c.k = 2 WHERE a.k = 0),
v AS (SELECT doc_id, CASE WHEN trim(t.text) = '' AND c.score > t.score THEN c ELSE t END AS t FROM w)
SELECT doc_id, CASE WHEN t.k = 1 THEN 11 ELSE 6 END AS segmentation, t.score AS confidence, md5(CASE WHEN t.score < 0.15 THEN '' ELSE t.text END) AS digest,
  array_to_string(list_filter([CASE WHEN t.score < 0.25 AND t.score >= 0.15 AND t.text <> '' THEN printf('Low OCR confidence (%.2f)', t.score) END,
    CASE WHEN t.score < 0.15 OR trim(t.text) = '' THEN 'Page 1: Tesseract returned no usable text.' END], lambda x: x IS NOT NULL), ' | ') AS warnings FROM v""")
def ocr_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text = F.col("doc_id"), F.col("text")
    one = lambda t, c: F.struct(t.alias("text"), c.alias("conf"))
    symbols = F.lit("%" * 30)
    pages = S.read(spark, sf_dir, "documents").select(
        "doc_id", F.lit(1).alias("page"), one(F.when(i % 2 == 0, " ").otherwise(text), i % 10 / 10).alias("primary"), one(F.when(i % 6 == 0, "").otherwise(F.lower(text)), i % 7 / 10).alias("retry"),
        one(F.when(i % 12 == 0, "").when(i % 18 == 0, symbols).otherwise(F.replace(text, F.lit(" "), F.lit("  "))), i % 3 / 10).alias("english"),
    )
    return ocr.ladder(pages).select("doc_id", "segmentation", "confidence", F.md5("text").alias("digest"), F.array_join("warnings", " | ").alias("warnings"))


@query(f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN lower(text) END AS ft, 0.1 + doc_id % 7 / 10 AS fc, CASE WHEN doc_id % 5 <> 0 THEN replace(text, ' ', '') END AS ht, doc_id % 5 / 5 AS hc FROM documents),
g AS (SELECT *, ft IS NOT NULL AND {_STRIP.format('ft')} <> '' AND fc >= 0.25 AND (length({_STRIP.format('ft')}) >= 8 OR {_WORDS.format('ft')} >= 2) AS good FROM c),
p AS (SELECT *, CASE WHEN good AND (ht IS NULL OR length(ft) + fc * 100 >= length(ht) + hc * 100) THEN 'fast' WHEN ht IS NOT NULL THEN 'heavy' ELSE 'none' END AS path FROM g)
SELECT doc_id, path, md5(CASE path WHEN 'fast' THEN ft WHEN 'heavy' THEN ht ELSE '' END) AS digest, CASE path WHEN 'fast' THEN fc WHEN 'heavy' THEN hc ELSE 0 END::DOUBLE AS confidence FROM p""")
def ocr_fast_or_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text = F.col("doc_id"), F.col("text")
    one = lambda t, c: F.struct(t.alias("text"), c.alias("confidence"))
    pages = S.read(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 4 != 0, one(F.lower(text), F.lit(0.1) + i % 7 / 10)).alias("fast"), F.when(i % 5 != 0, one(F.replace(text, F.lit(" "), F.lit("")), i % 5 / 5)).alias("heavy")
    )
    return ocr.fast_or_heavy(pages).select("doc_id", "path", F.md5("text").alias("digest"), "confidence")


# --- pages and their tables as a decoder gives them

_READ_PAGES = f"""{S.WORD_PAGES}, rp AS (SELECT doc_id, page, CASE WHEN page % 3 = 0 THEN ' ' ELSE text END AS text, CASE WHEN page % 6 <> 0 THEN 'block of ' || text END AS b, CASE WHEN page % 12 <> 0 THEN 'words of ' || text END AS w FROM word_pages)"""


def _readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, n = S.word_pages(spark, sf_dir), F.col("page")
    parts = lambda first, ok: p.where(ok).select("doc_id", "page", F.posexplode(F.array(F.lit(f"{first} of"), F.lit("  "), F.col("text"))).alias("ord", "text"))
    return p.withColumn("text", F.when(n % 3 == 0, " ").otherwise(F.col("text"))), parts("block", n % 6 != 0), parts("words", n % 12 != 0)


@query(f"""WITH {_READ_PAGES}, t AS (SELECT doc_id, page, CASE WHEN trim(text) <> '' THEN text WHEN b IS NOT NULL THEN replace(b, 'block of ', 'block of' || chr(10)) ELSE coalesce(w, '') END AS text FROM rp)
SELECT doc_id, md5(coalesce(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) FILTER (text <> ''), '')) AS digest FROM t GROUP BY doc_id""")
def fallback_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = sources.fallback_map(*_readings(spark, sf_dir))
    return sources.fallback_document(text).select("doc_id", F.md5("text").alias("digest"))


@query(f"""WITH {S.WORD_PAGES}, n AS (SELECT DISTINCT doc_id, page FROM (SELECT doc_id, unnest([1, 3, 999, 3]) AS page FROM documents WHERE doc_id % 2 = 0)),
t AS (SELECT doc_id, page, CASE WHEN page % 7 = 0 THEN 'broken page' END AS error, text FROM word_pages WHERE doc_id % 2 <> 0 OR (doc_id, page) IN (SELECT (doc_id, page) FROM n))
SELECT doc_id, page, md5(CASE WHEN error IS NULL THEN text ELSE '' END) AS digest, CASE WHEN error IS NOT NULL THEN 'Extraction failed: ' || error ELSE '' END AS warnings FROM t""")
def digital_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.word_pages(spark, sf_dir).withColumn("error", F.when(F.col("page") % 7 == 0, "broken page"))
    wanted = S.read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.explode(F.array(*[F.lit(i) for i in (1, 3, 999, 3)])).alias("page"))
    out = sources.selected_pages(pages, wanted)
    return out.select("doc_id", "page", F.md5("text").alias("digest"), F.array_join("warnings", " | ").alias("warnings"))


@query(f"""WITH {_CELLS.replace("SELECT o_custkey AS tbl", "SELECT o_custkey * 4 + o_orderkey % 3 + 1 AS tbl")},
p AS (SELECT DISTINCT o_custkey AS doc_id, g AS page FROM orders, (SELECT unnest([1, 2, 3]) AS g)),
k AS (SELECT doc_id, page, CASE WHEN (doc_id + page) % 4 <> 0 AND n >= 2 AND len(rs[1]) >= 2 THEN 1 ELSE 0 END AS n, rs FROM p LEFT JOIN t ON tbl = doc_id * 4 + page)
SELECT doc_id, page, n AS n_tables, md5(CASE WHEN n = 1 THEN array_to_string(rs[1], '|') || chr(10) || array_to_string(list_transform(rs[2:], lambda r: array_to_string(r, '|')), chr(10)) ELSE '' END) AS digest FROM k""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    row = F.when(k % 5 == 0, F.array(s, F.lit(" "))).when(k % 7 == 0, F.array(s)).otherwise(F.array(s, F.col("o_orderpriority")))
    orders = S.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (k % 3 + 1).cast("int").alias("page"), k.alias("k"), row.alias("r"))
    raw = orders.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("cells")).withColumn("table_index", F.lit(0))
    pages = orders.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("page"))
    pages = pages.withColumn("text", F.when((F.col("doc_id") + F.col("page")) % 4 == 0, " ").otherwise("text"))
    lines = lambda t: F.concat_ws("\n", F.array_join(t["headers"], "|"), F.array_join(F.transform(t["rows"], lambda r: F.array_join(r, "|")), "\n"))
    out = tables.page_tables(pages, raw)
    return out.select("doc_id", "page", F.size("tables").alias("n_tables"), F.md5(F.array_join(F.transform("tables", lines), "")).alias("digest"))


@query(f"WITH {S.PAGE_CONF}, {_STITCH}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM stitched) SELECT doc_id, page, 'Page boundary stitch: merged with page ' || (i + 1) AS warning FROM n WHERE merges")
def stitch_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.stitch(S.page_conf(spark, sf_dir)).select("doc_id", "page", F.explode("stitch_warnings").alias("warning"))


_CLASSES = f"""{S.WORD_PAGES}, {S.BLOCKS}, {_COVER}, r AS (SELECT doc_id, word_pages.page, CASE WHEN word_pages.page % 5 = 0 THEN '' WHEN word_pages.page % 7 = 0 THEN 'ગુજરાતી' ELSE text END AS a, CASE WHEN word_pages.page % 10 = 0 THEN '' ELSE 'block ' || text END AS b,
  CASE WHEN word_pages.page % 20 = 0 THEN 'ab' ELSE text || ' word' END AS w, CASE WHEN doc_id % 3 = 0 THEN 'rescued' ELSE '' END AS f, doc_id % 2 = 0 AS img, coalesce(coverage, 0) AS coverage FROM word_pages LEFT JOIN cov ON cov.page = doc_id * 3 + word_pages.page),
q1 AS (SELECT *, CASE WHEN length(a) < 20 THEN greatest(length(a), length(b)) ELSE length(a) END AS n1, regexp_matches(a, '[\\x{{0A80}}-\\x{{0AFF}}]') AS gu, count(*) OVER (PARTITION BY doc_id) AS pages FROM r),
q2 AS (SELECT *, CASE WHEN n1 < 20 THEN greatest(n1, length(w)) ELSE n1 END AS n2 FROM q1), q3 AS (SELECT *, CASE WHEN n2 < 5 THEN greatest(n2, length(f)) ELSE n2 END AS n3 FROM q2)"""


@query(f"""WITH {_CLASSES} SELECT doc_id, page, (CASE WHEN pages = 1 THEN greatest(n3, length(f)) ELSE n3 END)::INT AS char_count,
CASE WHEN pages = 1 AND (f <> '' OR NOT img) THEN 'digital' WHEN (n3 >= 20 AND coverage > 0.005) OR coverage > 0.01 OR (gu AND (n3 >= 5 OR coverage > 0.002)) THEN 'digital' ELSE 'scanned' END AS pdf_type FROM q3""")
def classify_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = F.col("page"), F.col("text")
    cover = classify.text_coverage(S.blocks(spark, sf_dir), ["page"], F.lit(612.0 * 792.0)).withColumnRenamed("page", "at")
    p = S.word_pages(spark, sf_dir).select(
        "doc_id", "page", (F.col("doc_id") * 3 + n).alias("at"), F.when(n % 5 == 0, "").when(n % 7 == 0, "ગુજરાતી").otherwise(t).alias("text"), F.when(n % 10 == 0, "").otherwise(F.concat(F.lit("block "), t)).alias("block_text"),
        F.when(n % 20 == 0, "ab").otherwise(F.concat(t, F.lit(" word"))).alias("word_text"), (F.col("doc_id") % 2 == 0).alias("has_images"),
    ).join(cover, "at", "left").drop("at")
    fallback = S.read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit("rescued").alias("text"))
    fallback = p.select("doc_id", "page").join(fallback, "doc_id")
    return classify.classify_pages(classify.with_fallback(p, fallback)).select("doc_id", "page", "char_count", "pdf_type")


_STATE = "CASE WHEN doc_id % 4 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'processing' ELSE 'done' END"


@query(f"""WITH res AS (SELECT doc_id AS job_id, sha256(text) AS sha256, {_STATE} = 'done' AND doc_id % 3 <> 0 AS fresh FROM documents),
f AS (SELECT sha256, min(job_id) FILTER (fresh) AS cached, min(job_id) FILTER (NOT fresh) AS stale FROM res GROUP BY sha256)
SELECT doc_id AS job_id, CASE WHEN cached < doc_id THEN 'reuse' ELSE 'process' END AS action, CASE WHEN cached < doc_id THEN doc_id WHEN stale <> doc_id THEN stale END AS delete_job FROM documents JOIN f ON f.sha256 = sha256(text)""")
def upload_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.sha2("text", 256).alias("sha256"))
    as_of, j = F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.col("job_id")
    until = F.when(j % 3 != 0, as_of + F.expr("INTERVAL 1 HOUR")).otherwise(as_of - F.expr("INTERVAL 1 HOUR"))
    results = d.withColumns({"status": F.when(j % 4 == 0, "failed").when(j % 5 == 0, "processing").otherwise("done"), "expires_at": until})
    return jobs.reuse(d, results, as_of).select("job_id", "action", "delete_job")


@query(f"""WITH {S.JOBS}, {_STATUS} SELECT job_id, CASE status WHEN 'unknown' THEN 404 WHEN 'expired' THEN 410 WHEN 'done' THEN 200 ELSE 202 END AS text_status, CASE status WHEN 'unknown' THEN 404 ELSE 200 END AS state_status FROM st""")
def view_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select("job_id", jobs.view_status(F.col("status"), "text").alias("text_status"), jobs.view_status(F.col("status"), "status").alias("state_status"))
