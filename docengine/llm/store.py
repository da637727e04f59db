"""Shared-folder tables that cut lineage, and session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: long texts in one batch have to fit a Python worker.
BATCH_ROWS = 1000
#: Bits of the map that `among` broadcasts: 2 MB, whatever the number of ids.
MAP_BITS = 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="docengine-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it again.

    The copy outlives executors, and what reads it neither repeats the work nor carries its plan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame, key: str) -> DataFrame:
    """`df`, an aggregate by a long `key`, with the key worked out anew, so that a join by it deals it out once more.

    A join of rows with their own aggregate would take the aggregate where it lies; Spark splits the rows of a hot key
    only if both sides of the join come straight from a shuffle. What moves again are the few rows of the aggregate.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `df` whose id is in `ids`.

    A broadcast bitmap of hashed ids drops most others before the shuffle of the exact semi-join. Its size is
    fixed; once it is full, that is from some ten million ids on, the semi-join alone decides.
    """
    per = 32768  # bits in a bitmap of bitmap_construct_agg
    place = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    maps = ids.select(place.alias("p")).groupBy(F.expr(f"p div {per}").alias("part")).agg(F.bitmap_construct_agg(F.expr(f"p % {per}")).alias("bits"))
    marked = df.withColumn("p", place).join(F.broadcast(maps.withColumnRenamed("part", "part_")), F.expr(f"p div {per} = part_"))
    byte = f"cast(conv(hex(substring(bits, cast((p % {per}) div 8 as int) + 1, 1)), 16, 10) as bigint)"
    # an inner join: Catalyst would push a semi-join below the bitmap's join
    return marked.where(f"getbit({byte}, cast(p % 8 as int)) = 1").select(*df.columns).join(ids.select("id").distinct(), "id")


def fresh(name: str, taken: list[str]) -> str:
    """`name`, or with underscores put before it until no column of `taken` clashes (any case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name
