"""Batches and the answers to them, as tables that meet without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.text import remove, shared_dir


class Tables:
    """Tables in the shared folder, bucketed by batch: batches and the answers to them meet
    without another shuffle, however often they are read."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.made = spark, max(1, buckets), {}

    def put(self, df: DataFrame) -> DataFrame:
        name = f"strandline_{uuid.uuid4().hex}"
        self.made[name] = shared_dir(self.spark)
        df.write.format("parquet").option("compression", "zstd").option("path", self.made[name]).bucketBy(self.buckets, "batch").saveAsTable(name)
        return self.spark.table(name)

    def put_answers(self, df: DataFrame) -> DataFrame:
        return self.put(df.repartition(self.buckets, "batch"))

    def drop(self) -> None:
        for name, path in self.made.items():
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, path)


def with_answers(batches: DataFrame, answers: list[DataFrame], fields: list[str]) -> DataFrame:
    """Batches with the fields of all answers so far; only the first frame has some for each."""
    held = []
    for i, part in enumerate(answers):
        lists = part.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(f"answers{i}"))
        batches = batches.join(lists.hint("merge"), "batch", "left" if i else "inner")
        held.append(F.coalesce(f"answers{i}", F.array().cast(lists.schema[f"answers{i}"].dataType)))
    return batches.withColumn("answers", F.concat(*held)).drop(*[f"answers{i}" for i in range(len(answers))])
