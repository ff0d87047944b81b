"""Vectors as short codes: one byte for each part of a vector, nearest entries found by an integer Walsh-Hadamard transform."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import add_columns, materialize
from docloom.llm.vectors import integers, is_finite, padded_rows

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
_LONG = (1 << 63) - 1


def walsh(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform over the last axis, zero-padded to a power of two, coefficients by number of sign
    changes. It keeps integers, and a squared distance becomes exactly that power of two times as large."""
    n = x.shape[-1]
    size = 1 << max(n - 1, 0).bit_length()
    y = np.zeros((*x.shape[:-1], size), x.dtype)
    y[..., :n] = x
    return _butterflies(y)[..., _sequency(size)]


def _butterflies(y: np.ndarray) -> np.ndarray:
    size, half = y.shape[-1], 1
    while half < size:
        z = y.reshape(*y.shape[:-1], size // (2 * half), 2, half)
        a, b = z[..., 0, :], z[..., 1, :]
        y = np.stack((a + b, a - b), axis=-2).reshape(y.shape)
        half *= 2
    return y


def _sequency(size: int) -> np.ndarray:
    signs = _butterflies(np.eye(size, dtype=np.int64))  # symmetric: row i is function i
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the index of the nearest entry (ties to the lower) and its squared distance, exactly.

    Differences add up coefficient by coefficient. The entry that the first coefficient puts nearest gives a bound;
    an entry goes as soon as its sum exceeds it. Numbers that might overflow a long are computed as Python integers.
    """
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    size = 1 << max(x.shape[1] - 1, 0).bit_length()
    if 4 * most**2 * size**3 >= 1 << 62:
        x, entries = x.astype(object), entries.astype(object)
    a, c = walsh(x), walsh(entries)
    sums = (a[:, :1] - c[None, :, 0]) ** 2
    bound = ((a - c[sums.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero((sums <= bound[:, None]).astype(bool))
    part = sums[row, entry]
    for s in range(1, size):
        part = part + (a[row, s] - c[entry, s]) ** 2
        live = (part <= bound[row]).astype(bool)
        row, entry, part = row[live], entry[live], part[live]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(part, first) if len(row) else part
    hit = np.flatnonzero((part == least[row]).astype(bool))
    hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
    return entry[hit], least // size


@dataclass
class Codebooks:
    """Entries by part, entry and place within the part; ``scale`` is the factor that made vectors integers."""

    entries: np.ndarray
    scale: int

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Codes (a row for each vector, a column for each part) and whole errors."""
        parts, _, width = self.entries.shape
        found = [nearest(x[:, p * width : (p + 1) * width], self.entries[p]) for p in range(parts)]
        error = sum(d.astype(object) for _, d in found)
        return np.stack([i for i, _ in found], axis=1), list(error)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, coded: DataFrame, code_col: str = "code") -> DataFrame:
        """``coded`` with the column ``decoded``, the integer vector that a code stands for; null for a null code."""
        parts = np.arange(self.entries.shape[0])

        def read(cols: list[pa.Array]) -> list[pa.Array]:
            codes = [None if c is None else list(bytes.fromhex(c)) for c in cols[0].to_pylist()]
            return [pa.array([None if c is None else self.entries[parts, c].ravel().tolist() for c in codes], pa.list_(pa.int64()))]

        return add_columns(coded, [code_col], "decoded array<bigint>", read, text_input=None)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label and the integer vector v of the rows that are coded."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    return rows.filter(is_finite(F.col("vec"))).select("id", "label", integers(F.col("vec"), scale).alias("v"))


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of the integer vectors of ``rows`` (id, v), or None where there are none.

    They start as the parts of the ``entries`` smallest ids (null ids last, ties by vector). In a round every vector
    counts: a task sends one row for each part, entry and place, and the driver gets their sums, which are as many as
    the codebooks have numbers.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for a part, so 1 to 256 entries")
    start = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not start:
        return None
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-longest // parts))
    first = np.zeros((len(start), parts * width), np.int64)
    for i, r in enumerate(start):
        first[i, : len(r.v)] = r.v
    books = Codebooks(first.reshape(len(start), parts, width).transpose(1, 0, 2).copy(), scale)

    for _ in range(rounds):

        def add_up(batches, books=books):
            shape = books.entries.shape
            n, total = np.zeros(shape[:2], np.int64), np.zeros(shape, object)
            for b in batches:
                x = padded_rows(b.column(0), parts * width)
                codes, _ = books.assign(x)
                exact = np.int64 if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else object
                for p in range(parts):
                    here = np.zeros(shape[1:], exact)
                    np.add.at(here, codes[:, p], x[:, p * width : (p + 1) * width].astype(exact))
                    total[p] += here.astype(object)
                    n[p] += np.bincount(codes[:, p], minlength=shape[1])
            p, e = np.nonzero(n)
            place = np.tile(np.arange(width), len(p))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(p, width)), pa.array(np.repeat(e, width)), pa.array(place), pa.array(np.repeat(n[p, e], width)), pa.array([str(t) for t in total[p, e].ravel()], pa.string())],
                names=["part", "entry", "place", "n", "total"],
            )

        sums = rows.select("v").mapInArrow(add_up, "part bigint, entry bigint, place bigint, n bigint, total string")
        moved = books.entries.copy()
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            moved[r.part, r.entry, r.place] = int(r.total) // r.n
        books = Codebooks(moved, scale)
    return books


def encode(rows: DataFrame, books: Codebooks | None) -> DataFrame:
    """id, label, code (two hex digits a part) and error of ``rows`` (id, label, v); an error beyond a long is the largest long."""
    kinds = dict(rows.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    if books is None:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).limit(0)

    def run(batches):
        for b in batches:
            codes, error = books.assign(padded_rows(b.column(2), books.entries.shape[0] * books.entries.shape[2]))
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([min(e, _LONG) for e in error], pa.int64())], names=["id", "label", "code", "error"])

    return rows.select("id", "label", "v").mapInArrow(run, schema)


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """One row per coded row: id_col, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component are dropped. A component x counts as
    floor(scale * x), held within 2^62 either way. Vectors shorter than the longest, or than the next multiple of
    ``parts``, count as filled up with zeros. Repeated rows count and are coded each. Fewer rows than ``entries`` make
    smaller codebooks. ``label_error`` is the sum over rows of one label, nulls together. No rows give no rows.
    """
    rows = integer_vectors(vectors, id_col, vec_col, label_col, scale)
    books = fit_codebooks(rows, parts, entries, rounds, scale)
    coded = materialize(encode(rows, books))
    sums = coded.groupBy(F.col("label").alias("l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG)).cast("bigint").alias("label_error"))
    met = coded.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return met.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors of the table."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round(k: int) -> str:
    return f"""
near{k} as (
  select r, part, min(d * {ENTRIES} + entry) best from (
    select r, x.part, entry, sum((x.v - b.v) * (x.v - b.v)) d from x join book{k} b on x.part = b.part and x.place = b.place group by r, x.part, entry
  ) group by r, part
),
book{k + 1} as (
  select b.part, b.entry, b.place, coalesce((s - ((s % n) + n) % n) // n, b.v) v from book{k} b left join (
    select x.part, best % {ENTRIES} entry, place, sum(v) s, count(*) n from x join near{k} using (r, part) group by all
  ) using (part, entry, place)
),"""


ORACLE_SQL = f"""
with kept as (
  select row_number() over (order by vec_id) - 1 r, vec_id, label, embedding, len(embedding) // {PARTS} width from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda c: c is not null and isfinite(c)))
),
x as (
  select r, (i - 1) // width part, (i - 1) % width place, floor({SCALE} * embedding[i]::double)::hugeint v
  from kept, unnest(range(1, len(embedding) + 1)) u(i)
),
book0 as (select part, r entry, place, v from x where r < {ENTRIES}),{"".join(_round(k) for k in range(ROUNDS + 1))}
coded as (
  select vec_id, label, string_agg(format('{{:02x}}', (best % {ENTRIES})::int), '' order by part) code, sum(best // {ENTRIES})::bigint error
  from near{ROUNDS} join kept using (r) group by r, vec_id, label
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error,
  (select sha256(string_agg(v::varchar, ',' order by part, entry, place)) from book{ROUNDS}) codebooks_sha256
from coded
"""
