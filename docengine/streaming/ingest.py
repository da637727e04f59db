"""Uploads as a stream: new files, each content once, results appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docengine.sources.documents import upload_error


def uploads(spark: SparkSession, folder: str, keep: str = "2 hours") -> DataFrame:
    """Accepted files of a landing folder, each content once within `keep`; older state is forgotten by the watermark."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").load(folder)
    ok = files.where(upload_error(F.col("path"), F.col("length"), F.col("content")).isNull())
    return ok.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", keep).dropDuplicatesWithinWatermark(["sha256"])


def run(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch extracted and written to a folder of its own in `target`, which a replay of the batch overwrites; stops when nothing is left."""

    def batch(df: DataFrame, n: int) -> None:
        extract(df).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
