"""Incremental load of new links as a stream: a master in folders by key, of which a batch reads only what it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import first_by

def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def touched(spark: SparkSession, master_path: str, buckets: list[int]) -> DataFrame:
    """The master's rows in these buckets; other folders are not read."""
    return spark.read.parquet(master_path).where(F.col("bucket").isin(buckets))


def append_new(batch: DataFrame, master_path: str, key: str = "url", buckets: int | None = None) -> None:
    """foreachBatch body: append the batch's rows whose key the master lacks; a batch that is run again adds nothing.

    With `buckets` the master lies in so many folders by key (column `bucket`), and a batch reads those that its keys fall
    into only; a master keeps the number it began with. Without, all of its keys are read. Of equal keys in a batch the
    first row by all columns stays. A null key is a key like any other.
    """
    spark = batch.sparkSession
    fresh = first_by(batch, [key], *(batch[c] for c in batch.columns))
    if buckets:
        fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if exists(spark, master_path):
        if buckets:
            known = touched(spark, master_path, [r.bucket for r in fresh.select("bucket").distinct().collect()])  # at most `buckets` numbers
        else:
            known = spark.read.parquet(master_path)
        fresh = fresh.join(known.select(F.col(key).alias("_known")).distinct(), F.col(key).eqNullSafe(F.col("_known")), "left_anti")
    if buckets:
        fresh.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(master_path)
    else:
        fresh.write.mode("append").parquet(master_path)


def master(spark: SparkSession, master_path: str) -> DataFrame:
    """All rows of a master."""
    return spark.read.parquet(master_path).drop("bucket")


def load_links(stream: DataFrame, master_path: str, checkpoint: str, key: str = "url", buckets: int | None = None):
    """The started query that keeps the master at master_path up to date with the stream."""
    return stream.writeStream.foreachBatch(lambda df, _: append_new(df, master_path, key, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
