"""Places within a key, whatever the size of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in `order` within `keys`; a null key is a key; rows that are equal in both are in any order.

    A range sort deals a key with all rows over all tasks. A row's place is what lies before it in its part of the sort, and what earlier
    parts hold of its key: one row a key and part, so the table of sums has fewer rows than keys and parts together.
    """
    held = written(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_k", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_k", 33)
    runs = held.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], part.alias("_part")).agg(F.min("_k").alias("_first"), F.count("*").alias("_n"))
    mine = [f"_key{i}" for i in range(len(keys))]
    before = F.sum("_n").over(Window.partitionBy(*mine).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*mine, "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    same = part == F.col("_part")
    for k, m in zip(keys, mine):
        same &= F.col(k).eqNullSafe(F.col(m))
    return held.join(runs, same).select(*rows.columns, (F.col("_k") - F.col("_first") + F.col("_before") + 1).alias(name))
