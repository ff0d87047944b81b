"""What the operators on embeddings share: validity, classes of equal vectors, random splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_valid(vec: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    big = F.lit(float("inf"))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def keyed(df: DataFrame, id_col: str, vec_col: str, label_col: str | None) -> DataFrame:
    """id, label, vec and h (a hash of the vector) of the rows that take part."""
    label = F.col(label_col) if label_col else F.lit(0)
    rows = df.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vec_col).alias("vec"))
    rows = rows.filter(is_valid(F.col("vec")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    return rows.withColumn("h", F.xxhash64("vec"))


def unit_rows(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as unit vectors in double precision."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(col), -1) if len(col) else x.reshape(0, 1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def random_leaves(x: np.ndarray, seed: int, limit: int, spill: float, dense: float) -> list[np.ndarray]:
    """Recursive random splits at the median; the share ``spill`` next to it goes to both sides.

    A node is a leaf when it has at most ``limit`` rows, or when most of it lies within ``dense``
    (a cosine) of its centre: splitting a lump of near copies would only tear links apart."""
    rng, todo, leaves = np.random.default_rng(seed), [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= limit:
            leaves.append(at)
            continue
        centre = x[at].mean(axis=0)
        size = np.linalg.norm(centre)
        if size > 0 and np.median(x[at] @ centre) / size >= dense:
            leaves.append(at)
            continue
        p = x[at] @ rng.standard_normal(x.shape[1])
        order = np.argsort(p, kind="stable")
        half, over = len(at) // 2, int(len(at) * spill)
        todo += [at[order[: half + over]], at[order[half - over :]]]
    return leaves


#: Components of integer vectors are held within this bound, beyond which no product of theirs fits a long.
_MOST = 2.0**62


def is_finite(vec: Column) -> Column:
    """Not null, without null or non-finite components. Zero and empty vectors pass."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False))


def integers(vec: Column, scale: int) -> Column:
    """floor(scale * x) of every component x, taken as double, as a long between -2^62 and 2^62."""
    return F.transform(vec, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-_MOST)), F.lit(_MOST))))


def padded_rows(col: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of integers, filled up with zeros to ``width``."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = col.flatten().to_numpy()
    return out
