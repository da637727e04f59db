"""Pages, lines, blocks and jobs derived from the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.sources.documents import spread

PAGE_WORDS, PAGE_LINES, CUT = 40, 5, 60


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # long texts are worth dealing out, short rows meet their shuffle soon enough
    return spread(df) if name == "documents" else df


def word_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, text: forty words a page."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != "").alias("ws")).where(F.size("ws") > 0)
    first = F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / PAGE_WORDS).cast("int"))
    texts = F.transform(first, lambda p: F.array_join(F.slice("ws", p * PAGE_WORDS + 1, PAGE_WORDS), " "))
    return d.select("doc_id", F.posexplode(texts).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text")


WORD_PAGES = f"""
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, ws, unnest(range(0, len(ws), {PAGE_WORDS})) AS i FROM w),
word_pages AS (SELECT doc_id, (i // {PAGE_WORDS} + 1)::INT AS page, array_to_string(ws[i + 1 : i + {PAGE_WORDS}], ' ') AS text FROM u)
"""


def page_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word_pages with confidence: by the document's label and page, unknown without a label."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    c = F.when(F.col("quality") == 1, 0.95).when(F.col("quality") == 0, F.when(F.col("page") % 3 == 0, 0.3).otherwise(0.55))
    return word_pages(spark, sf_dir).join(labels, "doc_id", "left").withColumn("confidence", c).drop("quality")


PAGE_CONF = WORD_PAGES + """,
page_conf AS (SELECT w.doc_id, page, text, CASE WHEN quality = 1 THEN 0.95::DOUBLE WHEN quality = 0 THEN CASE WHEN page % 3 = 0 THEN 0.3::DOUBLE ELSE 0.55::DOUBLE END END AS confidence
              FROM word_pages w LEFT JOIN labels l USING (doc_id))
"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


DOC_LINES = """
sl AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
sk AS (SELECT doc_id, source, ls, unnest(range(len(ls))) AS i FROM sl),
doc_lines AS (SELECT doc_id, source, i::INT AS line_no, ls[i + 1] AS line FROM sk)
"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, lines: five lines a page, with a header, a separator, a mark of one's own and a page mark put in. All of a document comes from its row."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n", -1).alias("ls"))
    d = d.withColumn("total", F.ceil(F.size("ls") / PAGE_LINES).cast("int"))
    own = lambda p: F.slice("ls", p * PAGE_LINES + 1, PAGE_LINES)
    marks = lambda p: F.array(F.format_string("body mark %d", p + 1), F.format_string("Page %d of %d", p + 1, F.col("total")))
    pages = F.transform(F.sequence(F.lit(0), F.col("total") - 1), lambda p: F.concat(F.array(F.col("source"), F.lit("-----")), own(p), marks(p)))
    return d.select("doc_id", F.posexplode(pages).alias("p", "lines")).select("doc_id", (F.col("p") + 1).alias("page"), "lines")


PAGE_LINES_SQL = DOC_LINES + f""",
pg AS (SELECT doc_id, source, line_no // {PAGE_LINES} + 1 AS page, line_no % {PAGE_LINES} + 2 AS n, line FROM doc_lines),
tot AS (SELECT doc_id, any_value(source) AS source, max(page) AS total FROM pg GROUP BY doc_id),
one AS (SELECT DISTINCT doc_id, page FROM pg),
page_lines AS (
  SELECT doc_id, page, n AS line_no, line FROM pg
  UNION ALL SELECT doc_id, page, 0, source FROM one JOIN tot USING (doc_id)
  UNION ALL SELECT doc_id, page, 1, '-----' FROM one
  UNION ALL SELECT doc_id, page, 7, 'body mark ' || page FROM one
  UNION ALL SELECT doc_id, page, 8, 'Page ' || page || ' of ' || total FROM one JOIN tot USING (doc_id))
"""


def fixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines: texts cut every sixty characters, with a hyphen where that parts two letters."""
    flat = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("t")).where(F.length("t") > 0)
    cut = flat.select("doc_id", F.regexp_extract_all("t", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)).alias("s"))
    after = F.concat(F.slice("s", F.lit(2), F.size("s")), F.array(F.lit("")))
    parts = lambda a, b: F.right(a, F.lit(1)).rlike(r"\p{L}") & F.left(b, F.lit(1)).rlike(r"\p{L}")
    return cut.select("doc_id", F.zip_with("s", after, lambda a, b: F.when(parts(a, b), F.concat(a, F.lit("-"))).otherwise(a)).alias("lines"))


FIXED_LINES = f"""
fl AS (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents),
fk AS (SELECT doc_id, t, unnest(range(0, (length(t) + {CUT} - 1) // {CUT})) AS k FROM fl WHERE length(t) > 0),
fixed_lines AS (SELECT doc_id, k::INT AS line_no, substr(t, k * {CUT} + 1, {CUT}) ||
  CASE WHEN regexp_matches(right(substr(t, k * {CUT} + 1, {CUT}), 1), '\\p{{L}}') AND regexp_matches(substr(t, (k + 1) * {CUT} + 1, 1), '\\p{{L}}') THEN '-' ELSE '' END AS line FROM fk)
"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as blocks of a page: quantity is the top, price the left edge."""
    x0 = F.col("l_extendedprice") / 200
    y0 = F.col("l_quantity") * 3
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.xxhash64("l_quantity", "l_extendedprice").alias("_"), x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"),
        (y0 + F.col("l_discount") * 100).alias("y1"), F.concat("l_returnflag", "l_linestatus").alias("text"),
    ).drop("_").withColumn("ord", (F.col("x0") * 1000).cast("long"))


BLOCKS = """
blocks AS (SELECT l_orderkey AS page, l_extendedprice / 200 AS x0, l_quantity * 3 AS y0, l_extendedprice / 200 + 40 AS x1, l_quantity * 3 + l_discount * 100 AS y1,
           l_returnflag || l_linestatus AS text, trunc(l_extendedprice / 200 * 1000)::BIGINT AS ord FROM lineitem)
"""


def jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """uploads, worker states and results of users as jobs: each one's last event of a kind."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_type", "ts")
    last = e.groupBy("job_id", "event_type").agg(F.max("ts").alias("modified"))
    uploads = last.where("event_type = 'signup'").select("job_id", "modified")
    states = last.where("event_type IN ('view', 'click')").groupBy("job_id").agg(F.max_by("event_type", F.struct("modified", "event_type")).alias("e"))
    states = states.where("job_id % 7 <> 0").select("job_id", F.when(F.col("e") == "view", "processing").otherwise("PENDING").alias("state"), F.lit(40.0).alias("progress"))
    done = last.where("event_type IN ('purchase', 'error')").groupBy("job_id").agg(F.max_by(F.struct("event_type", "modified"), F.struct("modified", "event_type")).alias("e"))
    done = done.where("job_id % 3 <> 0").select("job_id", F.when(F.col("e.event_type") == "purchase", "done").otherwise("failed").alias("status"), F.col("e.modified").alias("modified"))
    return uploads.where("job_id % 11 <> 0"), states, done.withColumn("expires_at", F.when(F.col("job_id") % 5 != 0, F.col("modified") + F.expr("INTERVAL 2 HOURS")))


JOBS = """
last AS (SELECT user_id AS job_id, event_type, max(ts) AS modified FROM events GROUP BY ALL),
uploads AS (SELECT job_id, modified FROM last WHERE event_type = 'signup' AND job_id % 11 <> 0),
states AS (SELECT job_id, CASE WHEN e = 'view' THEN 'processing' ELSE 'pending' END AS state FROM
  (SELECT job_id, arg_max(event_type, {'m': modified, 'e': event_type}) AS e FROM last WHERE event_type IN ('view', 'click') GROUP BY job_id) WHERE job_id % 7 <> 0),
results AS (SELECT job_id, CASE WHEN e = 'purchase' THEN 'done' ELSE 'failed' END AS status, modified, CASE WHEN job_id % 5 <> 0 THEN modified + INTERVAL 2 HOUR END AS expires_at FROM
  (SELECT job_id, arg_max(event_type, {'m': modified, 'e': event_type}) AS e, max(modified) AS modified FROM last WHERE event_type IN ('purchase', 'error') GROUP BY job_id) WHERE job_id % 3 <> 0),
clock AS (SELECT max(ts) - INTERVAL 1 DAY AS as_of FROM events)
"""
