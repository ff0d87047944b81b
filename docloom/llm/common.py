"""Helpers that several operators of this subpackage share.

Heavy text work runs in Arrow batches inside tasks. Data that must meet across
tasks travels as packed binary rows (``bucket``, ``payload``), so that a shuffle
carries a few large rows instead of one row per word.
"""

from __future__ import annotations

import ctypes
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Aimed-at bytes of raw text in one block of documents, or in one bucket of routed text.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, each query's shuffle files go as soon as the query has ended. Else they stay until the driver
    happens to collect its garbage, and iterations pile them up. For code that reads only materialized rows again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release() -> None:
    """Give freed memory back at the end of a task: Python workers live on, and hold what they once took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name1, name2, ... that is no column of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in range(len(taken) + 1) if (n := f"{name}{i or ''}") not in taken)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def crc_fold(col: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the text ``null``."""
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("null")).cast("binary")) % F.lit(folds)).cast("int")


def pack(data: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data.tobytes() if isinstance(data, np.ndarray) else data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def unpack_array(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(unpack(data), dtype=dtype)


def zigzag_deltas(values: np.ndarray) -> bytes:
    return pack(np.diff(np.asarray(values, np.int64), prepend=np.int64(0)))


def from_deltas(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_array(data, "<i8"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


# --- words of many texts at once -------------------------------------------------

#: A step of eight bytes within a word's hash. Any odd number does.
_STEP = np.uint64(0x9E3779B97F4A7C55)
#: Keeps the first n bytes of eight.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG_WORD = 256
#: Bytes of text whose words are hashed at once, and words compared at once; bounds the temporary arrays.
_CHUNK, _AT_ONCE = 2 << 20, 1 << 18


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many texts: byte spans in ``buf``, text ordinal and 64-bit hash."""

    buf: bytes  # with eight bytes to spare at the end
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the words i and the words j are the same, byte for byte."""
        cuts = range(0, len(i), _AT_ONCE)
        return np.concatenate([self._same(i[k : k + _AT_ONCE], j[k : k + _AT_ONCE]) for k in cuts] or [np.zeros(0, bool)])

    def _same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        eight = _eights(self.buf)
        size = self.end[i] - self.start[i]
        out = size == self.end[j] - self.start[j]
        live, k = np.flatnonzero(out), 0
        while len(live):
            keep = _MASKS[np.minimum(size[live] - k, 8)]
            a, b = eight[self.start[i[live]] + k], eight[self.start[j[live]] + k]
            differ = (a & keep) != (b & keep)
            out[live[differ]] = False
            k += 8
            live = live[~differ & (size[live] > k)]
        return out

    def codes(self) -> np.ndarray:
        """A number for each word, the same for the same words only: hashes propose, bytes decide."""
        order = np.argsort(self.hash)
        ordered = self.hash[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(order)]
        del ordered
        first, code = order[new], np.empty(len(order), np.int64)  # one word of each hash, and each word's place among hashes
        code[order] = np.cumsum(new) - 1
        del order, new
        if not all(self.same(np.arange(k, min(k + _AT_ONCE, len(code))), first[code[k : k + _AT_ONCE]]).all() for k in range(0, len(code), _AT_ONCE)):
            table: dict[bytes, int] = {}
            code = np.array([table.setdefault(self.buf[a:z], len(table)) for a, z in zip(self.start.tolist(), self.end.tolist(), strict=True)])
        return code


def _eights(buf: bytes) -> np.ndarray:
    """The eight bytes from every place of ``buf`` on, as numbers."""
    return np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, strides=(1,))


def words_of(texts: list[bytes]) -> Words:
    """Find and hash all words of the texts with array operations only.

    A word's hash chains a mixing step over its eight-byte parts. Two words of one hash are taken as
    equal, which is wrong for about one pair in 1.8e19; who cannot accept that asks ``same``.
    """
    buf = b" ".join([*texts, b" " * 8])
    n = len(buf) - 9
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    place = np.int32 if len(buf) < 1 << 31 else np.int64
    eight = _eights(buf)
    parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    at = 0
    while at < n:
        stop = min(at + _CHUNK, n)
        while stop < n and not (buf[stop] == 32 or 9 <= buf[stop] <= 13):
            stop += 1  # never inside a word
        raw = np.frombuffer(buf, np.uint8, stop - at, at)
        solid = (raw != 32) & (raw - np.uint8(9) > 4)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8))) + at
        start, end = edge[0::2], edge[1::2]
        size = end - start
        value = mix64((eight[start] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * _STEP)
        live, k = np.flatnonzero((size > 8) & (size <= _LONG_WORD)), 8
        while len(live):
            more = eight[start[live] + k] & _MASKS[np.minimum(size[live] - k, 8)]
            value[live] = mix64(value[live] * _STEP + more)
            k += 8
            live = live[size[live] > k]
        for i in np.flatnonzero(size > _LONG_WORD).tolist():
            value[i] = xxhash.xxh3_64_intdigest(memoryview(buf)[start[i] : end[i]])
        doc = np.searchsorted(ends_of_texts, start, side="right")
        parts.append((start.astype(place), end.astype(place), doc.astype(np.int32), value))
        at = stop
    columns = list(zip(*(parts[1:] or parts), strict=True))
    del parts
    made = []
    while columns:  # a column's parts go as soon as they are joined
        made.append(np.concatenate(columns.pop()))
    return Words(buf, *made[::-1])


def sliced(batches: Iterable[pa.RecordBatch], text: int, limit: int = BLOCK_BYTES) -> Iterable[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of the text column, one row at least."""
    for b in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield b.slice(i, j - i)
    release()


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (document borders are the caller's concern)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix64(out)


# --- documents as blocks ----------------------------------------------------------


def blocks_of(docs: DataFrame, id_col: str, text_col: str, size: int | None = None) -> DataFrame:
    """All columns of ``docs`` under the neutral names c0, c1, ... with the text zstd-packed,
    dealt by a hash of the id into blocks of about BLOCK_BYTES of text (column ``block``).

    The block of a row depends on its id only, so a later join by block meets the same rows.
    ``size``: the bytes of all texts, where known. There
    are several blocks to a partition, so the hash of the block deals them out evenly.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    n = max(4 * parts, -(-(text_bytes(docs, text_col) if size is None else size) // BLOCK_BYTES))
    cols = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    it, tt = f"c{cols.index(id_col)}", f"c{cols.index(text_col)}"
    block = F.pmod(F.xxhash64(it, F.lit(7)), F.lit(n)).cast("int")
    schema = ", ".join(["block int", *(f"{c} {'binary' if c == tt else k}" for c, k in plain.dtypes)])

    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(tt)
            z = [None if t is None else pack(t) for t in b.column(k).cast(pa.binary()).to_pylist()]
            arrays = [pa.array(z, pa.binary()) if i == k else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    packed = plain.select(block.alias("block"), *plain.columns).mapInArrow(squeeze, schema)
    return packed.repartition(parts, "block")


def block_order(ids: list, texts: list[bytes | None]) -> list[int]:
    """One order of a block's rows for every pass: by id, then text; null ids last, null texts first."""
    return sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or b""))


def crc_bucket(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % n


def add_columns(df: DataFrame, inputs: list[str], outputs: str, fn, text_input: int | None = 0) -> DataFrame:
    """Append columns that ``fn`` makes, batch by batch, from the input columns; rows and all other
    columns stay. ``outputs`` is a DDL list of fields; existing columns of those names are replaced.

    ``fn`` takes the Arrow arrays of ``inputs`` and returns one Arrow array per output. With
    ``text_input``, the ordinal of a text among the inputs, batches are bounded in bytes.
    """
    new = [x.strip().split(" ")[0] for x in outputs.split(";")]
    kept = [c for c in df.columns if c.lower() not in {x.lower() for x in new}]
    ins = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], *[F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(inputs)])
    n = len(kept)
    schema = ", ".join([f"{c} {k}" for c, k in ins.dtypes[:n]] + [f"o{i} {x.strip().split(' ', 1)[1]}" for i, x in enumerate(outputs.split(";"))])
    names = [f"c{i}" for i in range(n)] + [f"o{i}" for i in range(len(new))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in sliced(batches, n + text_input) if text_input is not None else batches:
            made = fn([b.column(n + i) for i in range(len(inputs))])
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n)] + list(made), names=names)

    return ins.mapInArrow(run, schema).toDF(*kept, *new)
