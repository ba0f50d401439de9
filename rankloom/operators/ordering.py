"""Places of rows in a global order, without a window over all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that spark.checkpoint.dir names (in tests without one, in one of our own)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="rankloom-"))
    return df.checkpoint()


def numbered(df: DataFrame, *order: Column, place: str = "ord") -> DataFrame:
    """df with `place`, the number (from 1) of each row in the given order.

    Rows are dealt by ranges and sorted within tasks; only each task's count goes through a window. The dealt rows are
    checkpointed, as ranges are drawn anew whenever they are computed. df should be narrow (join wide columns afterwards)
    and the order should be total: rows that tie are numbered as they lie.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    runs = checkpointed(dealt.withColumns({"_part": F.shiftright("_row", 33), "_row": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}))
    # a row for each task
    counts = runs.groupBy("_part").agg(F.count("*").alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return runs.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").select(*df.columns, (F.col("_row") + F.col("_before") + 1).alias(place))
