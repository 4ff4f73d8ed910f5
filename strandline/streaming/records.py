"""Incremental ingestion of generation records (an extension: the batch library has only
resumption by keys, see strandline.sources.publish.append_cells)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.tables import remaining

KEYS = ["gene", "condition", "sample"]


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def ingest(records: DataFrame, folder: str, checkpoint: str, delay: str = "1 hour", time: str = "ts") -> StreamingQuery:
    """Appends records not yet in the folder: repeats within the delay are dropped by
    watermark, older ones by an anti-join with what is stored."""
    fresh = records.withWatermark(time, delay).dropDuplicatesWithinWatermark(KEYS)

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        (remaining(batch, spark.read.parquet(folder), KEYS) if known else batch).write.mode("append").parquet(folder)

    return fresh.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(records: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Records by condition and window of event time."""
    return records.withWatermark(time, delay).groupBy(F.window(time, width), "condition").agg(F.count("*").alias("n"))
