"""Counts that are kept small and added up: distinct terms by HyperLogLog, frequent terms by bounded counters.

A batch gives a row of sketches for each base. Rows of several batches merge into what one pass over all would give, within
the stated errors, so a report over a year reads a row for each base and day and no text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers: the standard error of a distinct count is 1.04 / sqrt(2^14), below one per cent.
LG_K = 14
#: Counters of a frequency sketch. A term that makes up more than 1 / COUNTERS of all is in it.
COUNTERS = 2048


def sketch(tokens: DataFrame, by: list[str], token: str = "token", lg_k: int = LG_K, counters: int = COUNTERS) -> DataFrame:
    """``by``, tokens (exact), bytes (exact), distinct and frequent (sketches): one row for each group of rows of ``tokens``."""
    return tokens.filter(F.col(token).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("tokens"),
        F.sum(F.octet_length(token)).alias("bytes"),
        F.hll_sketch_agg(token, F.lit(lg_k)).alias("distinct"),
        F.expr(f"approx_top_k_accumulate({token}, {counters})").alias("frequent"),
    )


def merged(sketches: DataFrame, by: list[str], counters: int = COUNTERS) -> DataFrame:
    """Sketches of coarser groups, or of several batches, from finer ones."""
    return sketches.groupBy(*by).agg(
        F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"),
        F.hll_union_agg("distinct").alias("distinct"), F.expr(f"approx_top_k_combine(frequent, {counters})").alias("frequent"),
    )


def distinct_count(column: str = "distinct") -> Column:
    return F.hll_sketch_estimate(column)


def frequent_terms(k: int, column: str = "frequent") -> Column:
    """At most k of (item, count), the most frequent first."""
    return F.expr(f"approx_top_k_estimate({column}, {k})")
