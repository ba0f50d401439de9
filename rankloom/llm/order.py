"""Places of rows in a global order, without any window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, fresh


def numbered(df: DataFrame, keys: list[str], order: list[Column], place: str, total: str | None = None) -> DataFrame:
    """df with `place`, the number (from 0) of each row in the given order within its keys, and `total`, the rows of its keys.

    Rows are dealt by ranges and sorted within tasks; what each task holds of each key is counted, and the counts are
    added up in the order of tasks. So a key of any size is spread over many tasks, and only counts meet. Keys must not
    be null. df is read twice, so it should be a written table.
    """
    part, row, first, held, base = fresh(df, "part", "row", "first", "held", "base")
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(row, F.monotonically_increasing_id())
    runs = cut(dealt.withColumns({part: F.shiftright(row, 33), row: F.col(row).bitwiseAND(F.lit((1 << 33) - 1))}))
    # a row for each task, and one for each key; Spark broadcasts them only while they are small
    own = Window.partitionBy(*keys)
    counts = runs.groupBy(part, *keys).agg(F.count("*").alias(held), F.min(row).alias(first))
    before = F.coalesce(F.sum(held).over(own.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = cut(counts.select(part, *keys, (before - F.col(first)).alias(base), F.sum(held).over(own).alias(total or held)))
    out = cut(runs.join(bases, [part, *keys]).select(*df.columns, (F.col(row) + F.col(base)).alias(place), *([total] if total else [])))
    forget(runs, bases)
    return out
