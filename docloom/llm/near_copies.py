"""Near copies by the Jaccard similarity of word shingles. SimHash with ball hashing proposes, and MinHash bands
propose what lies beyond its radius; the shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import free_name, gram_hash, materialize, mix64, shuffle_partitions, shuffles_dropped, sliced, words_of
from docloom.llm.components import components
from docloom.llm.simhash import fingerprint_links

SHINGLE, SIMILARITY = 5, 0.8
#: Two texts of similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS: at 0.8 all but 5e-5.
BANDS, ROWS = 25, 5
#: Classes of a band that are all compared with each other, and rounds in which larger bands are compared.
SMALL, ROUNDS = 8, 3


def _shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of SHINGLE words; fewer words are one run, no words none."""
    w = words_of([t.lower() for t in texts])  # bytes: A-Z only
    cuts = np.searchsorted(w.doc, np.arange(len(texts) + 1)).tolist()
    grams = gram_hash(w.hash, SHINGLE)
    return [
        np.unique(grams[a : z - SHINGLE + 1]) if z - a >= SHINGLE else gram_hash(w.hash[a:z], z - a) if z > a else np.zeros(0, np.uint64)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True)
    ]


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each shingle set, none of which may be empty."""
    x = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    draws = np.random.default_rng(11).integers(0, 1 << 64, (BANDS, ROWS, 2), np.uint64)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for flip, times in draws[band]:
            key = mix64(key + np.minimum.reduceat((x ^ flip) * (times | np.uint64(1)), starts))
        keys[:, band] = key
    return keys


def _fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The 64-bit SimHash of each shingle set, none of which may be empty: a bit is 1 if over half the hashes have it."""
    x = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.zeros(len(sets), np.uint64)
    for bit in np.arange(64, dtype=np.uint64):
        ones = np.add.reduceat((x >> bit) & np.uint64(1), starts).astype(np.int64)
        out |= (ones * 2 > sizes).astype(np.uint64) << bit
    return out


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns; rows of one hash are taken as the same row twice."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def _marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, cls, n, fp, bands): cls names the shingle set and is null without words; n is its size, fp its SimHash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in sliced(batches, 2):
            sets = _shingles([t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()])
            some = [i for i, s in enumerate(sets) if len(s)]
            cls, fp, bands = ([None] * len(sets) for _ in range(3))
            full = [sets[i] for i in some]
            for i, f, keys in zip(some, _fingerprints(full).view(np.int64).tolist(), _bands(full), strict=True) if some else []:
                fp[i], cls[i], bands[i] = f, int(np.array(xxhash.xxh64_intdigest(sets[i].tobytes()), np.uint64).view(np.int64)), keys.tobytes()
            arrays = [b.column(0), b.column(1), pa.array(cls, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "cls", "n", "fp", "bands"])

    rows = docs.select(row_key(docs).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row bigint, id {dict(docs.dtypes)[id_col]}, cls bigint, n bigint, fp bigint, bands binary")


def _spread(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keys = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.repeat(b.column(i).to_numpy(), BANDS)) for i in (0, 1))], names=["key", "cls", "n"])


def _columns(batches: Iterable[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    return {c: t.column(c).to_numpy() for c in t.column_names}


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Only keys that several classes have."""
    if got := _columns(batches):
        order = np.argsort(got["key"], kind="stable")
        key = got["key"][order]
        same = key[1:] == key[:-1]
        keep = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        yield pa.RecordBatch.from_arrays([pa.array(got[c][keep]) for c in ("key", "cls", "n")], names=["key", "cls", "n"])


def _meet(batches: Iterable[pa.RecordBatch], turn: int) -> Iterable[pa.RecordBatch]:
    """Pairs of classes (key, cls, n, root) of one key and different roots: all of them where a key has
    at most SMALL classes; else each class with the first and with the one before it, in an order
    that ``turn`` decides. So a key gives a bounded number of pairs for each of its classes."""
    if not (got := _columns(batches)):
        return
    place = got["cls"] if turn == 0 else mix64(got["cls"].view(np.uint64) + np.uint64(turn))
    order = np.lexsort((place, got["key"]))
    key, cls, n, root = (got[c][order] for c in ("key", "cls", "n", "root"))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    first, size = np.repeat(first, size), np.repeat(size, size)
    at = np.arange(len(key))
    us, vs = [first], [at]
    for step in range(1, SMALL):
        u = at - step
        near = (u >= first) & ((size <= SMALL) | (step == 1))
        us.append(u[near]), vs.append(at[near])
    u, v = np.concatenate(us), np.concatenate(vs)
    fit = (root[u] != root[v]) & (np.minimum(n[u], n[v]) / np.maximum(n[u], n[v]) >= SIMILARITY)
    p = np.unique(np.sort(np.stack((cls[u[fit]], cls[v[fit]]), axis=1), axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["u", "v"])


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The pairs (u, v, a, b) whose shingle sets a and b are as similar as asked."""
    for b in batches:
        near = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            near.append(both / (len(p) + len(q) - both) >= SIMILARITY)
        keep = pa.array(near, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])


def _near_fingerprints(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """classes (cls, fp) -> pairs (u, v) of classes that ball hashing links: for each link of two fingerprints
    their least classes, and each class with the least one of its own fingerprint. With them the fingerprints (fp) that
    have another one near or several classes: the pairs that this leaves out are among their classes, see _rest."""
    fps = materialize(classes.groupBy("fp").agg(F.min("cls").alias("least"), F.count("*").alias("classes")))
    near = materialize(fingerprint_links(fps.select("fp")))
    a = fps.select(F.col("fp").alias("u"), F.col("least").alias("a"))
    b = fps.select(F.col("fp").alias("v"), F.col("least").alias("b"))
    across = near.join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = classes.join(fps, "fp").filter("cls <> least").select(F.col("least").alias("u"), F.col("cls").alias("v"))
    crowded = near.select(F.col("u").alias("fp")).union(near.select("v")).union(fps.filter("classes > 1").select("fp")).distinct()
    return materialize(across.unionByName(same)), materialize(crowded)


def _across(groups: DataFrame, meet: DataFrame) -> DataFrame:
    """groups (key, cls, n, root), meet (a, b: keys, a = b among them) -> all pairs (u, v) of classes of keys that meet, of
    different roots and like sizes. Classes are gathered by key and root first, so those that are linked make no pair."""
    held = groups.groupBy("key", "root").agg(F.collect_list(F.struct("cls", "n")).alias("all"))
    a = held.select(F.col("key").alias("a"), F.col("root").alias("p"), F.col("all").alias("x"))
    b = held.select(F.col("key").alias("b"), F.col("root").alias("q"), F.col("all").alias("y"))
    met = meet.join(a, "a").join(b, "b").filter("p <> q and (a <> b or p < q)")
    pairs = met.select("y", F.explode("x").alias("u")).select("u", F.explode("y").alias("v"))
    like = F.least("u.n", "v.n") / F.greatest("u.n", "v.n") >= SIMILARITY
    return pairs.filter(like).select(F.least("u.cls", "v.cls").alias("u"), F.greatest("u.cls", "v.cls").alias("v")).distinct()


def _rest(classes: DataFrame) -> DataFrame:
    """classes (cls, n, fp, root) -> all pairs (u, v) of classes whose fingerprints differ in at most two bits and whose roots
    differ: such fingerprints share a variant of one bit or none, of which no more than 65 do."""
    variants = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(x)) for x in (1 << np.arange(64, dtype=np.uint64)).view(np.int64).tolist()])
    balls = classes.select("fp").distinct().select("fp", F.explode(variants).alias("variant"))
    meet = balls.select(F.col("fp").alias("a"), "variant").join(balls.select(F.col("fp").alias("b"), "variant"), "variant").filter("a <= b").select("a", "b").distinct()
    return _across(classes.select(F.col("fp").alias("key"), "cls", "n", "root"), meet)


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, cls, root) per row of ``docs``: rows of one root are linked by near copies.

    Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or
    more; every link is verified on the sets. Equal sets are one class from the start. Classes whose
    SimHash fingerprints differ in at most two bits are the first candidates, found by ball hashing as in
    op7. At 0.8 about ten bits differ, so classes not linked yet that share a MinHash band are
    candidates, too. In a band of more than SMALL classes each is compared with two
    others a round, in another order each time, unless they are linked already; rounds end when one
    brings no link, or after ROUNDS. Then all candidates that are not linked yet, of near fingerprints and of
    shared bands, are compared, so no candidate is left out. Texts without words, or null, have a null cls and root."""
    n = shuffle_partitions(docs.sparkSession)
    with shuffles_dropped(docs.sparkSession):
        marks = materialize(_marks(docs, id_col, text_col))
        classes = marks.filter("cls is not null").groupBy("cls").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("row").alias("row"))
        classes = materialize(classes)
        keyed = classes.select("cls", "n", "bands").mapInArrow(_spread, "key bigint, cls bigint, n bigint")
        shared = materialize(keyed.repartition(n, "key").mapInArrow(_shared, "key bigint, cls bigint, n bigint"))

        def sets(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for b in sliced(batches, 1):
                made = [s.tobytes() for s in _shingles(b.column(1).cast(pa.binary()).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["cls", "set"])

        close, crowded = _near_fingerprints(classes.select("cls", "fp"))
        some = close.select(F.col("u").alias("cls")).union(close.select("v")).union(shared.select("cls")).distinct()
        wanted = classes.select("cls", "row").join(some, "cls", "left_semi")
        texts = docs.select(row_key(docs).alias("row"), F.col(text_col).alias("text")).join(wanted, "row").select("cls", "text")
        known = materialize(texts.mapInArrow(sets, "cls bigint, set binary").dropDuplicates(["cls"]))

        def verified(pairs: DataFrame) -> DataFrame:
            a = known.select(F.col("cls").alias("u"), F.col("set").alias("a"))
            b = known.select(F.col("cls").alias("v"), F.col("set").alias("b"))
            return materialize(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_confirm, "u bigint, v bigint"))

        def stars(linked: DataFrame) -> DataFrame:
            return linked.select(F.col("node").alias("u"), F.col("component").alias("v"))

        linked = components(verified(close))
        for turn in range(ROUNDS):
            rooted = shared.join(linked, shared.cls == linked.node, "left").select("key", "cls", "n", F.coalesce("component", "cls").alias("root"))
            met = rooted.repartition(n, "key").mapInArrow(lambda batches, turn=turn: _meet(batches, turn), "u bigint, v bigint").distinct()
            new = verified(met)
            if turn and new.isEmpty():
                break
            linked = components(stars(linked).unionByName(new))
        root = F.coalesce("component", "cls").alias("root")
        alike = classes.join(crowded, "fp", "left_semi").join(linked, classes.cls == linked.node, "left").select("cls", "n", "fp", root)
        large = shared.groupBy("key").count().filter(F.col("count") > SMALL).select("key")
        banded = materialize(shared.join(large, "key", "left_semi").join(linked, shared.cls == linked.node, "left").select("key", "cls", "n", root))
        torn = banded.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p <> q").select(F.col("key").alias("a"), F.col("key").alias("b"))
        left = materialize(_rest(materialize(alike)).unionByName(_across(banded, torn)).distinct())
        if not left.isEmpty():
            linked = components(stars(linked).unionByName(verified(left)))
    return marks.join(linked, marks.cls == linked.node, "left").select("row", "id", "cls", F.coalesce("component", "cls").alias("root"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without later near copies: of each group one row, that of the smallest id.

    Rows are decided one by one: null ids come last, and rows of one id go by a hash of the row, so a
    null id is kept where no other row is before it and one id can keep several texts. Rows without
    words, or with a null text, are nobody's copies and all stay."""
    row, nth = free_name(docs, "row_hash"), free_name(docs, "nth_of_row")
    groups = near_copy_groups(docs, id_col, text_col).filter("cls is not null")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    first = groups.groupBy("root").agg(F.min(place).alias("first")).select(F.col("first.row").alias(row))
    words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.filter(words).withColumn(row, row_key(docs)).join(first, row)
    once = Window.partitionBy(row).orderBy(row)  # the same row twice
    kept = kept.withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1).select(*docs.columns)
    return kept.unionByName(docs.filter(~words))
