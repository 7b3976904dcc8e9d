"""Row numbers and running sums over a whole ordered table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


def running(df: DataFrame, order: list[str], sums: dict[str, Column | None]) -> DataFrame:
    """df with a column for each of sums: its value's sum (of rows, where it is None) over all rows before this one in the order.

    Rows are range-partitioned by the order and written once; only sums per partition are gathered to place them. The order
    should be total, else rows that tie take their places in an unspecified order.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    values = {f"__value_{k}": F.lit(1) if v is None else v for k, v in sums.items()}
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({**values, "__part": F.spark_partition_id()})
    placed = materialize(placed, "ordered")
    parts = placed.groupBy("__part").agg(*[F.sum(v).alias(v) for v in values])
    # one row per partition of the range exchange
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = {v: F.lit(0).cast(placed.schema[v].dataType) for v in values}
    parts = parts.select(F.col("__part"), *[F.coalesce(F.sum(v).over(before), zero[v]).alias(f"__before{v}") for v in values])
    inside = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    own = {f"__own{v}": F.coalesce(F.sum(v).over(inside), zero[v]) for v in values}
    out = {k: F.col(f"__before__value_{k}") + F.col(f"__own__value_{k}") for k in sums}
    return placed.withColumns(own).join(F.broadcast(parts), "__part").select(*df.columns, *[v.alias(k) for k, v in out.items()])


def first_of(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group, with their places from 1. Rows of a group meet in 64 parts before they meet in one, and
    each task leaves at most n of a group, so that no task sees more of a group than 64 times n rows, but for the first step's."""
    spread = Window.partitionBy(*by, "__deal").orderBy(*order)
    dealt = df.withColumn("__deal", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    some = dealt.withColumn("__place", F.row_number().over(spread)).where(F.col("__place") <= n).drop("__deal", "__place")
    return some.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
