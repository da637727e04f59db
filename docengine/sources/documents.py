"""Sources and sinks: raw files, results, and PDF text by what is at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions.text import strip

MOST_BYTES = 100 * 1024 * 1024
# fixed values: what uploads are accepted as, the shortest text of a block, what parts pages of a fallback text
MIME_TYPES, ANY_TYPE = ("application/pdf", "application/x-pdf"), "application/octet-stream"
BLOCK_CHARS, PAGE_BREAK = 3, "\n\n---\n\n"
#: A literal string of a content stream; possessive, as Java would otherwise need a stack frame for each character.
LITERAL = r"\((?:\\.|[^\\)])*+\)"
RESULT_SCHEMA = "job_id string, status string, text string, confidence double, language string, warnings array<string>, expires_at timestamp, written_at timestamp"


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores where it is read in fewer parts, as a small file of one row group is; a large table is left as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def raw_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modified, length, content, sha256, error of every file; a file that would be refused has an error instead of being dropped."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.col("modificationTime").alias("modified"), "length", "content", F.sha2("content", 256).alias("sha256"), upload_error(F.col("path"), F.col("length"), F.col("content")).alias("error"))


def upload_error(path: Column, length: Column, content: Column, most: int = MOST_BYTES) -> Column:
    """Why a file is refused, null if it is not. The bytes are read as text once, and only where name, size and first bytes are right."""
    read = F.when(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.decode(content, "ISO-8859-1"))
    # one expression for both, as each would decode the file for itself
    inside = F.regexp_extract(read, r"/(Encrypt)\b|/(Count)\s+0\b", 0)
    return (
        F.when(~F.lower(path).endswith(".pdf"), "not a .pdf file")
        .when(length == 0, "empty file")
        .when(length > most, "too large")
        .when(F.substring(content, 1, 4) != F.lit(b"%PDF"), "not a PDF")
        .otherwise(F.when(inside.startswith("/Encrypt"), "encrypted").when(inside.startswith("/Count"), "zero pages"))
    )


def upload_status(media_type: Column, path: Column, length: Column, content: Column, most: int = MOST_BYTES) -> Column:
    """What an upload is answered: 415 for another media type, 413 for too many bytes, 400 for a file that is no PDF, 200."""
    return (
        F.when(~F.coalesce(media_type, F.lit("")).isin(*MIME_TYPES, ANY_TYPE), 415)
        .when(path.isNotNull() & (path != "") & ~F.lower(path).endswith(".pdf"), 400)
        .when(length > most, 413)
        .when((length < 4) | (F.substring(content, 1, 4) != F.lit(b"%PDF")), 400)
        .otherwise(200)
    )


def missing_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, error of those of `paths` that are not there; a job that names one gets an error row instead of ending the rest."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    return spark.createDataFrame([(p, f"FileNotFoundError: {p}") for p in paths if not exists(p)], "path string, error string")


def literal_text(content: Column) -> Column:
    """Text of uncompressed content streams: their literal strings, unescaped, one a line."""
    found = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(LITERAL), F.lit(0))
    # escaped backslashes first become a character that ISO-8859-1 does not have, so that what follows them is left alone
    steps = (("\\\\", "\ue000"), ("\\n", "\n"), ("\\r", "\r"))

    def plain(s: Column) -> Column:
        s = F.substring(s, F.lit(2), F.length(s) - 2)
        for escape, char in steps:
            s = F.replace(s, F.lit(escape), F.lit(char))
        return F.replace(F.regexp_replace(s, r"\\(.)", "$1"), F.lit("\ue000"), F.lit("\\"))

    return F.array_join(F.transform(found, plain), "\n")


def literal_stream(text: Column) -> Column:
    """A minimal content stream of the whole text as one literal string of UTF-8 bytes, as ISO-8859-1 lacks most letters."""
    body = F.regexp_replace(text, r"([\\()])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.concat(F.lit("%PDF-1.4\nBT /F1 12 Tf ("), body, F.lit(") Tj ET\n%%EOF")).cast("binary")


def fallback_text(*readings: Column) -> Column:
    """The first reading that is not blank, stripped, else an empty text."""
    return F.coalesce(*[F.when(strip(r) != "", strip(r)) for r in readings], F.lit(""))


def solid_blocks(blocks: DataFrame, least: int = BLOCK_CHARS) -> DataFrame:
    """Blocks with stripped texts, those under `least` characters dropped."""
    return blocks.withColumn("text", strip(F.col("text"))).where(F.length("text") >= least)


def solid_words(words: DataFrame) -> DataFrame:
    """Words with stripped texts, blank ones dropped; a word is at least one point high."""
    return words.withColumns({"text": strip(F.col("text")), "height": F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))}).where("text <> ''")


def _joined(parts: DataFrame, name: str, sep: str) -> DataFrame:
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", strip(F.col("text")).alias("t")))), lambda x: x["t"]), sep)
    return parts.where(strip(F.col("text")) != "").groupBy("doc_id", "page").agg(one.alias(name))


def fallback_map(pages: DataFrame, blocks: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, page, text of every page: its plain text, else its blocks one a line, else its words."""
    out = pages.select("doc_id", "page", "text").join(_joined(blocks, "_b", "\n"), ["doc_id", "page"], "left").join(_joined(words, "_w", " "), ["doc_id", "page"], "left")
    return out.select("doc_id", "page", fallback_text(F.col("text"), F.col("_b"), F.col("_w")).alias("text"))


def fallback_document(pages: DataFrame, page: int | None = None) -> DataFrame:
    """doc_id, text: pages that are not blank, in order, parted by PAGE_BREAK; or of each document the one `page`, empty where it has none."""
    t = strip(F.coalesce("text", F.lit("")))
    if page is not None:
        return pages.groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("page") == page, t)), F.lit("")).alias("text"))
    solid = F.array_sort(F.collect_list(F.when(t != "", F.struct("page", t.alias("t")))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(solid, lambda x: x["t"]), PAGE_BREAK).alias("text"))


def selected_pages(pages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, page, text, warnings of decoded pages (and error, if a page failed): all of a document, or those that `wanted` (doc_id, page) names
    for it. Numbers that a document does not have are skipped; a page that failed has an empty text and a warning."""
    out = pages
    if wanted is not None:
        named = wanted.select("doc_id", "page").distinct()
        some = named.select("doc_id").distinct().withColumn("_some", F.lit(True))
        out = pages.join(named.withColumn("_hit", F.lit(True)), ["doc_id", "page"], "left").join(some, "doc_id", "left").where("_hit OR _some IS NULL").drop("_hit", "_some")
    none = F.array().cast("array<string>")
    own = F.coalesce("warnings", none) if "warnings" in pages.columns else none
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    said = F.when(error.isNotNull(), F.array(F.concat(F.lit("Extraction failed: "), error))).otherwise(none)
    return out.select("doc_id", "page", F.when(error.isNotNull(), "").otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.concat(own, said).alias("warnings"))


#: Takes a file's bytes, returns (page, text, warnings, error) rows.
PageDecoder = Callable[[bytes], list[tuple[int, str, list[str], str | None]]]


def decode(files: DataFrame, decoder: PageDecoder, key: str = "path") -> DataFrame:
    """key, page, text, warnings, error by a decoder of one's own, one file at a time; what it raises becomes that file's error row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame[key], frame["content"]):
                try:
                    rows = [(name, *r) for r in decoder(bytes(content))]
                except Exception as e:  # a broken file must not end the job
                    rows = [(name, None, "", [], f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=[key, "page", "text", "warnings", "error"]).astype({"page": "Int32"})

    return files.select(key, "content").mapInPandas(run, f"{key} string, page int, text string, warnings array<string>, error string")


def image_pages(images: DataFrame, work: Callable[[bytes], tuple[str, float]], keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """keys, text, confidence of page images by an OCR engine of one's own; images are never shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [work(bytes(x)) for x in frame["image"]]
            yield frame[list(keys)].assign(text=[t for t, _ in got], confidence=[c for _, c in got])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.select(*keys).schema)
    return images.select(*keys, "image").mapInPandas(run, fields + ", text string, confidence double")


def write_results(results: DataFrame, path: str, as_of: Column, seconds: int | None = 7200, fmt: str = "json") -> None:
    """Results with their expiry and the time of writing; the writer's commit makes them appear as a whole. A job's later result replaces its
    earlier one when results are read. seconds=None leaves expires_at null: such a result expires by its age."""
    at = as_of.cast("timestamp")
    until = F.lit(None).cast("timestamp") if seconds is None else at + F.make_interval(secs=F.lit(seconds))
    results.withColumns({"expires_at": until, "written_at": at}).write.format(fmt).mode("append").save(path)


def delete_results(jobs: DataFrame, path: str, as_of: Column, fmt: str = "json") -> None:
    """Marks the results of `jobs` (job_id) as deleted; whether there are any does not matter. `compact` takes them out of the files."""
    gone = jobs.select("job_id", F.lit("deleted").alias("status"), F.lit("").alias("text"), F.lit(0.0).alias("confidence"), F.lit("unknown").alias("language"), F.array().cast("array<string>").alias("warnings"))
    write_results(gone, path, as_of, None, fmt)


def current_results(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Each job's last result, expired or not; of several of one time a deletion counts."""
    df = spark.read.schema(RESULT_SCHEMA).format(fmt).load(path)
    last = df.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in df.columns if c != "job_id"]), F.struct("written_at", F.col("status") == "deleted", "status", "text")).alias("r"))
    return last.select("job_id", "r.*").where("status <> 'deleted'").select(*df.columns)


def read_results(spark: SparkSession, path: str, as_of: Column, fmt: str = "json", seconds: int = 7200) -> DataFrame:
    """Each job's last result, if it has not expired: before expires_at, or without one not older than `seconds`."""
    at = as_of.cast("timestamp")
    age = F.unix_timestamp(at) - F.unix_timestamp("written_at")
    return current_results(spark, path, fmt).where(F.when(F.col("expires_at").isNull(), age <= seconds).otherwise(F.col("expires_at") > at))


def compact(spark: SparkSession, path: str, target: str, as_of: Column, fmt: str = "json") -> None:
    """Writes what `read_results` gives to another folder, without replaced, deleted and expired results."""
    read_results(spark, path, as_of, fmt).write.format(fmt).save(target)


def failed(jobs: DataFrame, message: Column) -> DataFrame:
    """Result rows of jobs that failed."""
    return jobs.select("job_id", F.lit("failed").alias("status"), F.lit("").alias("text"), F.lit(0.0).alias("confidence"), F.lit("unknown").alias("language"), F.array(message).alias("warnings"))


def failed_report(jobs: DataFrame, message: Column) -> DataFrame:
    """Whole results of jobs that failed: error, no pages or tables, zeroed metadata."""
    none = F.array().cast("array<string>")
    return jobs.select(
        "job_id", F.lit("failed").alias("status"), message.alias("error"), F.lit("").alias("text"), none.alias("tables"), none.alias("pages"),
        F.struct(
            F.lit(0).alias("pages"), F.lit("unknown").alias("pdf_type"), F.lit(0.0).alias("confidence_score"), F.lit(0.0).alias("processing_time_seconds"),
            none.alias("warnings"), F.lit(False).alias("warnings_truncated"), F.lit(0).alias("total_warning_count"),
        ).alias("metadata"),
    )
