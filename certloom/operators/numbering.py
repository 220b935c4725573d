"""Dense row numbers in a total order, without a single-task window."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a row group, which a Parquet writer keeps until it writes them and a reader takes at once. Spark does not count them as a task's
#: memory: with Parquet's own size, 128 MB, the tasks of a process may take all but a twentieth of its heap once their rows are many.
ROW_GROUP = 16 << 20


def scratch(spark: SparkSession) -> str:
    """The folder of checkpoints; a local session without spark.checkpoint.dir gets a temporary one."""
    import tempfile

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df; a local session without spark.checkpoint.dir gets a temporary folder."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table under the folder of checkpoints, of which a reader takes only the columns it needs."""
    path = f"{scratch(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("stored-"):
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def together(spark: SparkSession, *work: Callable) -> list:
    """The results of calls that run jobs of their own, side by side: small jobs wait for their plans more than for cores."""
    with ThreadPoolExecutor(len(work)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(w)) for w in work]]


def pieces(df: DataFrame, rows: int, least: int) -> int:
    """In how many partitions so many rows keep all cores busy: of `least` rows at least, few rows are not torn."""
    spark = df.sparkSession
    most = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(most, math.ceil(rows / least)))


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 1, partitions: int | None = None) -> DataFrame:
    """df in order with a column of consecutive numbers.

    Rows are dealt to ranges of the order and sorted there; each range's numbers start after the
    rows of those before it, known from one count a range. The ranges are checkpointed, so that
    counts and numbers see the same rows.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # n rows at most
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy("__at")
    return (
        ranged.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.row_number().over(inside) + F.col("__before") + (first - 1))
        .drop("__part", "__at", "__before")
    )
