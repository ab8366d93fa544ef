"""Numbers without gaps over a whole table."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from weftgraph.storage import durable

_PLACE_BITS = 33  # of monotonically_increasing_id(): the row's place in its partition


def numbered(df: DataFrame, name: str, *order, start: int = 1) -> DataFrame:
    """df with `name` as start, start + 1, ... in the given order, which has to tell rows apart for the numbers to be fixed.

    Two passes without a task that sees all rows: ranges of rows are written with each row's range and place in it; then the
    ranges' sizes, one number for each range, give where each begins. Nulls come first. An empty table gives an empty one.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    held = durable(dealt.withColumns({"__range": F.spark_partition_id(), "__place": place}), "numbered")
    sizes = sorted(held.groupBy("__range").count().collect())
    if not sizes:
        return df.withColumn(name, F.lit(None).cast("long"))
    begins = accumulate((size for _, size in sizes[:-1]), initial=start)
    where = spark.createDataFrame([(k, first) for (k, _), first in zip(sizes, begins, strict=True)], "__range int, __first long")
    joined = held.join(F.broadcast(where), "__range")  # a row for each range
    return joined.withColumn(name, F.col("__first") + F.col("__place")).drop("__range", "__place", "__first")
