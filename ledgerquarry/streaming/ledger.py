"""New files into a ledger of items as they arrive; each content enters once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "sha256 string, path string, length bigint, modificationTime timestamp"


def follow_folder(spark: SparkSession, folder: str, ledger: str, checkpoint: str) -> StreamingQuery:
    """Start (or go on) reading ``folder``; ``ledger`` is a parquet folder with one row per content.

    A repeated micro-batch adds nothing: what is known is taken out by an anti-join on the hash before appending.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    hashed = files.select(F.sha2("content", 256).alias("sha256"), "path", "length", "modificationTime")

    def add(batch: DataFrame, _epoch: int) -> None:
        known = batch.sparkSession.read.schema(SCHEMA).parquet(ledger).select("sha256") if _exists(batch.sparkSession, ledger) else None
        first = batch.groupBy("sha256").agg(F.min_by(F.struct("path", "length", "modificationTime"), "path").alias("f")).select("sha256", "f.*")
        new = first if known is None else first.join(known, "sha256", "left_anti")
        new.write.mode("append").parquet(ledger)

    return hashed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
