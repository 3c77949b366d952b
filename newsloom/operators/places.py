"""Ordinal places in groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize


def places(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place in the group, from 0, in an order without ties. Rows are sorted by range, and a part's places go on from those of the parts before it."""
    keys = [f"__o{i}" for i in range(len(order))]
    dealt = rows.withColumns(dict(zip(keys, order))).repartitionByRange(*by, *keys).sortWithinPartitions(*by, *keys)
    put = materialize(dealt.drop(*keys).select("*", F.monotonically_increasing_id().alias("__at"), F.spark_partition_id().alias("__part")))
    counts = put.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    starts = counts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__p"), (before - F.col("__first")).alias("__start"))
    same = F.col("__part") == F.col("__p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return put.join(starts, same).withColumn(name, F.col("__at") + F.col("__start")).drop("__at", "__part", "__p", "__start", *(f"__{c}" for c in by))
