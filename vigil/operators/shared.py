"""Tables that an operator reads more than once, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none and runs on one machine, a folder made here."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="vigil_shared")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str = "step", rows_per_file: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, with a short lineage. Large rows want few to a file."""
    path = f"{shared_dir(df.sparkSession)}/vigil-{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/vigil-" in f}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """``df`` with each row's position from 0 in an order, whatever its size: rows are dealt by ranges of the order and sorted there.

    A row's position is its place in its range and the number of rows of the ranges before (one row each). The dealt rows are
    stored, so places and numbers are of one run; the files stay for whoever reads the result. Equal rows of the order take any turn.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inner = (1 << 33) - 1  # Spark's increasing ids hold the partition above 33 bits and the place below
    kept = cut(dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit(inner)).alias("_place")), "numbered")
    sizes = kept.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    return kept.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")
