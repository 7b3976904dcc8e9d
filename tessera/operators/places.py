"""Places and neighbours of rows inside a key, also where one key has a large part of all rows.

A window by key is one task a key. Beyond MOST_ROWS of one key, rows are range-partitioned by (key, order) and written once; each
(key, part) is numbered by itself, and what must go over a part's border (counts, the row before) is carried by a table of at most
two rows a part that have more than one part of their key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import written

#: Rows of one key that a task numbers.
MOST_ROWS = 1 << 22

#: Rows that a task sorts or gathers where `spread` deals them; small rows shrink so much in a shuffle that its bytes don't tell this.
TASK_ROWS = 1 << 19

#: Rows of a table that is sent to all tasks.
MOST_SENT = 1 << 18

PART = "__part"


def spread(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """df, n rows in all, by hash of `by` in as many parts as keep about TASK_ROWS rows or fewer in each, if no key has more."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-n // TASK_ROWS)), *by)


def bounded(df: DataFrame, rows: int = MOST_SENT) -> DataFrame:
    """df, for a join: sent to all tasks if it has at most so many rows, counted before, else left to Spark. Spark itself knows the size
    of a derived table only when the other side has been shuffled, too."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def largest(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the key that has most."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _same(by: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}"))
    return out


def parted(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], rows: int) -> DataFrame:
    """df with the part that each row is in: parts follow the order inside a key, none has many more than `rows` rows."""
    n = max(1, -(-df.count() // rows))
    return written(df.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn(PART, F.spark_partition_id()), "parted")


def _borders(rows: DataFrame, by: Sequence[str], values: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """(by, part, carried...) of the keys with more than one part; values are aggregated by key and part, carried come from windows
    over them, in order of parts. At most two rows for each part: a part's first and last key are all that others can have."""
    parts = rows.groupBy(*by, PART).agg(*[v.alias(k) for k, v in values.items()])
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    several = F.count("*").over(Window.partitionBy(*by)).alias("__parts")
    return parts.select(*by, PART, several, *[v.over(before).alias(k) for k, v in carried.items()]).where("__parts > 1").drop("__parts")


def _carried(rows: DataFrame, borders: DataFrame, by: Sequence[str]) -> DataFrame:
    names = [c for c in borders.columns if c not in (*by, PART)]
    a, b = rows.alias("__a"), F.broadcast(borders).alias("__b")
    return a.join(b, _same([*by, PART]), "left").select("__a.*", *[F.col(f"__b.{c}") for c in names])


def place(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str, rows: int = MOST_ROWS) -> DataFrame:
    """df with each row's place from 1 in its key, by order (which should be total). Null keys are keys."""
    if largest(df, by) <= rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    cut = parted(df, by, order, rows)
    inside = F.row_number().over(Window.partitionBy(*by, PART).orderBy(*order))
    borders = _borders(cut, by, {"__n": F.count("*")}, {"__before": F.sum("__n")})
    out = _carried(cut.withColumn("__inside", inside), borders, by)
    return out.select(*df.columns, (F.col("__inside") + F.coalesce("__before", F.lit(0))).cast("long").alias(name))


def previous(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], columns: Sequence[str], name: str, rows: int = MOST_ROWS) -> DataFrame:
    """df with a struct of `columns` of the row before in the key, null for the first."""
    row = F.struct(*columns)
    if largest(df, by) <= rows:
        return df.withColumn(name, F.lag(row).over(Window.partitionBy(*by).orderBy(*order)))
    cut = parted(df, by, order, rows)
    w = Window.partitionBy(*by, PART).orderBy(*order)
    marked = cut.withColumns({"__lag": F.lag(row).over(w), "__next": F.lead(F.lit(1)).over(w)})
    borders = _borders(marked, by, {"__last": F.first(F.when(F.col("__next").isNull(), F.struct(row.alias("row"))), ignorenulls=True)}, {"__carried": F.last("__last")})
    out = _carried(marked, borders, by)
    return out.select(*df.columns, F.coalesce("__lag", F.col("__carried.row")).alias(name))


def last_known(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], column: str, rows: int = MOST_ROWS) -> DataFrame:
    """df with nulls of a column replaced by the last value before them in the key."""
    if largest(df, by) <= rows:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(column, F.last(column, ignorenulls=True).over(w))
    cut = parted(df, by, order, rows)
    w = Window.partitionBy(*by, PART).orderBy(*order)
    marked = cut.withColumns({"__known": F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__next": F.lead(F.lit(1)).over(w)})
    borders = _borders(marked, by, {"__last": F.first(F.when(F.col("__next").isNull() & F.col("__known").isNotNull(), F.struct("__known")), ignorenulls=True)}, {"__carried": F.last("__last", ignorenulls=True)})
    out = _carried(marked, borders, by)
    return out.select(*[F.coalesce("__known", F.col("__carried.__known")).alias(c) if c == column else F.col(c) for c in df.columns])
