"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, mix64, pack, shuffle_partitions, unpack_array
from docloom.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Documents of one batch are cut into runs of about so many shingles for the bit counts.
_CHUNK = 200_000


def _fingerprint(text: bytes | None, shingle: int) -> int:
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), ">u8", len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row (id, fp bigint) per document: the 64-bit SimHash over its word shingles.

    Fewer words than a shingle count as one shingle; a text without words, or null, has 0.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.array([_fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp bigint")


def _ball(bits: int, reach: int) -> np.ndarray:
    """Masks with at most ``reach`` bits set."""
    masks = {0}
    for _ in range(reach):
        masks |= {m ^ (1 << i) for m in masks for i in range(bits)}
    return np.array(sorted(masks), np.uint64)


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct ``fp`` values -> edges (u, v) that connect all fingerprints at ``radius`` bits or fewer.

    Every fingerprint emits all variants within half the radius (rounded up), each routed by its
    hash. Two fingerprints within the radius share a variant. Those that share one are sorted, and
    each is verified against the least one and against its neighbours in the run; a star and a path
    connect the run. A variant has at most as many fingerprints as its own ball, so no run is long.
    """
    spark = fps.sparkSession
    n = shuffle_partitions(spark)
    masks = _ball(64, (radius + 1) // 2)

    def scatter(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            all_fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(all_fp), 50_000):
                fp = all_fp[i : i + 50_000]
                variant = (fp[:, None] ^ masks[None, :]).ravel()
                bucket = (mix64(variant) % np.uint64(n)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                which, at = (order // len(masks)), (order % len(masks)).astype(np.uint16)
                cuts = np.searchsorted(bucket[order], np.arange(n + 1))
                rows = [(k, cuts[k], cuts[k + 1]) for k in range(n) if cuts[k] < cuts[k + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _, _ in rows], pa.int32()),
                        pa.array([fp[which[a:z]].tobytes() for _, a, z in rows], pa.binary()),
                        pa.array([pack(at[a:z]) for _, a, z in rows], pa.binary()),
                    ],
                    names=["bucket", "fp", "mask"],
                )

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        fps, ats = [], []
        for b in batches:
            fps += [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            ats += [unpack_array(x, "<u2") for x in b.column(2).to_pylist()]
        if not fps:
            return
        fp = np.concatenate(fps)
        variant = fp ^ masks[np.concatenate(ats)]
        order = np.lexsort((fp, variant))
        fp, variant = fp[order], variant[order]
        new = np.concatenate(([True], variant[1:] != variant[:-1]))
        least = fp[np.flatnonzero(new)[np.cumsum(new) - 1]]
        before = np.concatenate((fp[:1], fp[:-1]))
        u = np.concatenate((fp[~new], fp[~new]))
        v = np.concatenate((least[~new], before[~new]))
        near = (np.bitwise_count(u ^ v) <= radius) & (u != v)
        pairs = np.unique(np.stack((u[near], v[near]), axis=1), axis=0).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

    packed = fps.mapInArrow(scatter, "bucket int, fp binary, mask binary")
    return packed.repartitionById(n, F.col("bucket")).mapInArrow(gather, "u bigint, v bigint").distinct()


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row (id column, fingerprint, component_id) per row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; component_id is the
    smallest id reachable. Equal fingerprints are one class from the start, so copies are never
    paired. Texts without words share fingerprint zero and are linked like any other. A null id
    never names a component unless all its members are null. No rows give no rows.
    Radius above 2 verifies less than all pairs of a run and is refused.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    marks = materialize(fingerprints(docs, id_col, text_col, shingle))
    classes = materialize(marks.groupBy("fp").agg(F.min("id").alias("least")))
    linked = components(fingerprint_links(classes.select("fp"), radius))
    joined = classes.join(linked, classes.fp == linked.node, "left").withColumn("root", F.coalesce("component", "fp"))
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marks.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document of the table."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
