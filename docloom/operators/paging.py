"""Places in a total order and deep pages, without a window over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import settle


def ranked(df: DataFrame, order: list[tuple[str, bool]], name: str = "rank") -> DataFrame:
    """``df`` with each row's place from 1 in the order of (column, descending) pairs; nulls come last.

    Rows are dealt into ranges and sorted there; what lies before a range is a prefix sum over the ranges, which are as
    few as the partitions. Rows that are equal in all columns named take the order in which they are read."""
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    tie, part, at = _free(df, "tie"), _free(df, "part"), _free(df, "at")
    spread = df.withColumn(tie, F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*keys, F.col(tie)).sortWithinPartitions(*keys, F.col(tie)).drop(tie)
    placed = settle(spread.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    runs = placed.groupBy(part).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(part, (before - F.col("first") + 1).alias(name))  # a row for each partition
    return placed.join(F.broadcast(starts), part).withColumn(name, F.col(at) + F.col(name)).drop(part, at)


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def page_after(df: DataFrame, order: list[tuple[str, bool]], last: dict | None, size: int = 20) -> DataFrame:
    """The next ``size`` rows after the row with the values ``last`` (None: the first page), in a total order; see ``ranked``.

    The place is a filter that reaches the scan, so a deep page costs what the first one does."""
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    if last is not None:
        df = df.filter(_after(order, last))
    return df.orderBy(*keys).limit(size)


def _after(order: list[tuple[str, bool]], last: dict) -> Column:
    tests, same = [], F.lit(True)
    for c, down in order:
        v = last[c]
        if v is None:
            same &= F.col(c).isNull()
            continue
        beyond = (F.col(c) < F.lit(v)) if down else (F.col(c) > F.lit(v))
        tests.append(same & (beyond | F.col(c).isNull()))
        same &= F.col(c) == F.lit(v)
    return reduce(lambda a, b: a | b, tests, F.lit(False))
