"""What belongs together in the corpus: terms for query expansion, segments of similar sentences, and indexes of tables by size."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import sentences
from docloom.operators.retrieval import tokens, top_k


def expansions(units: DataFrame, text_col: str, terms: DataFrame, window: int = 5, support: int = 5, least: int = 4, k: int = 5, stop_words: tuple = ()) -> DataFrame:
    """term, other, n, score, rank: for each of ``terms`` (term, a stated list) the k words that stand near it more than chance.

    ``n`` counts pairs of places at most ``window`` apart in one unit; pairs below ``support`` are left out, as are words
    below ``least`` letters and stop words. The score is n^2 / (count of term * count of other). Only places of the terms
    are unfolded, each with 2 * window others, so the work grows with the text and not with its square."""
    words = units.select(tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    counts = words.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("count"))
    asked = terms.select("term").distinct()
    places = words.select("words", F.posexplode("words").alias("i", "term")).join(asked, "term", "left_semi")
    first = F.greatest(F.col("i") - window, F.lit(0))
    around = F.concat(F.slice("words", first + 1, F.col("i") - first), F.slice("words", F.col("i") + 2, window))
    pairs = places.select("term", F.explode(around).alias("other")).filter((F.length("other") >= least) & (F.col("other") != F.col("term")) & ~F.col("other").isin(list(stop_words)))
    n = pairs.groupBy("term", "other").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    met = n.join(counts.select(F.col("w").alias("term"), F.col("count").alias("a")), "term").join(counts.select(F.col("w").alias("other"), F.col("count").alias("b")), "other")
    scored = met.withColumn("score", F.round(F.col("n") * F.col("n") / (F.col("a") * F.col("b")).cast("double"), 9))
    return top_k(scored, ["term"], F.desc("score"), "other", k).select("term", "other", "n", "score", "rank")


#: Buckets of a sentence's byte pairs, and sentences whose vectors a task holds at once.
DIMENSIONS, BLOCK = 257, 4096


def sentence_similarity(units: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, sentence, near: the sentences of each unit (from 0) and the cosine of each with the one before, null for the first.

    A sentence's vector counts its pairs of neighbouring bytes in DIMENSIONS buckets. The sentences of a unit stand in one
    row, so neighbours are compared where it is read, BLOCK vectors at a time."""
    rows = units.select(F.col(id_col).alias("id"), sentences(F.col(text_col)).alias("s"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            size = pa.compute.fill_null(pa.compute.list_value_length(b.column(1)), 0).to_numpy()
            unit = np.repeat(np.arange(b.num_rows), size)
            number = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
            said, last = b.column(1).flatten().cast(pa.binary()), np.zeros((1, DIMENSIONS), np.int64)
            for i in range(0, len(said), BLOCK):
                counts = np.concatenate((last, _pair_counts(said[i : i + BLOCK])))
                last = counts[-1:]
                norms = (counts * counts).sum(axis=1)
                dots, norm = (counts[1:] * counts[:-1]).sum(axis=1), np.sqrt((norms[1:] * norms[:-1]).astype(np.float64))
                near = np.divide(dots, norm, out=np.zeros(len(dots)), where=norm > 0)
                at = slice(i, i + BLOCK)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(unit[at])), pa.array(number[at], pa.int32()), pa.array(near)], names=["id", "sentence", "near"])

    met = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, sentence int, near double")
    return met.select(F.col("id").alias(id_col), "sentence", F.when(F.col("sentence") > 0, F.round("near", 9)).alias("near"))


def _pair_counts(said: pa.Array) -> np.ndarray:
    """For each binary value how many of its pairs of neighbouring bytes fall into each bucket."""
    raw = np.frombuffer(b"".join(said.to_pylist()), np.uint8).astype(np.int64)
    size = pa.compute.binary_length(said).to_numpy()
    of = np.repeat(np.arange(len(said)), size)
    inside = np.flatnonzero(of[1:] == of[:-1])
    bucket = (raw[inside] * 256 + raw[inside + 1]) % DIMENSIONS
    return np.bincount(of[inside] * DIMENSIONS + bucket, minlength=len(said) * DIMENSIONS).reshape(len(said), DIMENSIONS)


def similarity_segments(units: DataFrame, id_col: str, text_col: str, depth: float = 0.2, reach: int = 3) -> DataFrame:
    """id_col, sentence, near, segment: sentences cut where similarity has a deep valley.

    The depth of a gap is how far it lies below the highest similarities among it and ``reach`` gaps on either side, added
    up. A gap is a border if that is at least ``depth`` and no gap beside it is lower, of equal ones the first."""
    near = sentence_similarity(units, id_col, text_col)
    w = Window.partitionBy(id_col).orderBy("sentence")
    left, right = F.max("near").over(w.rowsBetween(-reach, 0)), F.max("near").over(w.rowsBetween(0, reach))
    deep = F.round(left + right - 2 * F.col("near"), 9) >= depth
    lowest = (F.col("near") < F.coalesce(F.lag("near").over(w), F.lit(2.0))) & (F.col("near") <= F.coalesce(F.lead("near").over(w), F.lit(2.0)))
    border = F.when(deep & lowest & F.col("near").isNotNull(), 1).otherwise(0)
    return near.withColumn("border", border).withColumn("segment", F.sum("border").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(id_col, "sentence", "near", "segment")


def table_tiers(rows: DataFrame, table: str, small: int = 10, medium: int = 100) -> DataFrame:
    """table, n, tier: a small table is indexed whole, a medium one by rows and columns, a large one also by its cells."""
    n = rows.groupBy(table).agg(F.count("*").alias("n"))
    return n.withColumn("tier", F.when(F.col("n") <= small, "small").when(F.col("n") <= medium, "medium").otherwise("large"))


def cells(rows: DataFrame, table: str, row: str, columns: list[str]) -> DataFrame:
    """table, row, column, value: the cells of ``rows``; null and blank ones are left out."""
    texts = rows.select(table, row, *[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([table, row], columns, "column", "value").filter(F.trim("value") != "")


def column_index(cell_rows: DataFrame, table: str, row: str) -> DataFrame:
    """table, column, value, rows, first: how many rows of a table have a value in a column, and the least of them."""
    return cell_rows.groupBy(table, "column", "value").agg(F.count("*").alias("rows"), F.min(row).alias("first"))


def cell_links(cell_rows: DataFrame, table: str, row: str) -> DataFrame:
    """table, a, b, rows: two steps in the graph of rows and cells: cells of different columns that share rows, and how many.

    A row has as many cells as the table has columns, so the pairs of a row are bounded by these."""
    name = F.concat("column", F.lit("="), "value")
    in_row = cell_rows.groupBy(table, row).agg(F.sort_array(F.collect_set(name)).alias("cells"))
    pairs = F.flatten(F.transform("cells", lambda a, i: F.transform(F.slice("cells", i + 2, F.size("cells")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return in_row.select(table, F.inline(pairs)).groupBy(table, "a", "b").agg(F.count("*").alias("rows"))
