"""Repeated passages by prefix-partitioned suffixes over words.

A suffix takes part with its first 13 words, a window. Windows are dealt to trees by a prefix that
each finds in itself: the word 5-gram of least hash among its nine. Equal windows have equal
prefixes, so all that can share a passage meet in one tree, and neighbouring windows mostly have the
same, so they travel as one run. The bytes that each prefix draws are counted over all documents;
one that draws more than a tree may hold is lengthened word by word, up to the 13 words of the
window, until what it draws fits. Prefixes are dealt to groups of a bounded size, one task each.

In its group, words are numbered and suffixes are sorted by their words, so that the common prefixes of
neighbours, 0 to 13 words, describe the suffix tree down to the depth of a window. Its nodes of that
depth with several leaves are the repeats: their least document keeps the words. Windows that follow
each other in a document join to maximal repeats when words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import (
    BUCKET_BYTES,
    Words,
    block_order,
    blocks_of,
    from_deltas,
    gram_hash,
    mix64,
    pack,
    release,
    shuffle_partitions,
    sliced,
    text_bytes,
    unpack,
    unpack_array,
    words_of,
    zigzag_deltas,
)

WINDOW = 13
PREFIX = 5
#: A prefix that draws more bytes than this is lengthened; there are at most (bytes drawn) / limit of those.
PREFIX_BYTES = 16 << 20
#: Bytes of routed text per byte of input, as measured; it only sets the number of groups.
_SPREAD = 3.5
_SHORT = np.uint64((1 << 40) - 1)


@dataclass
class Runs:
    """Consecutive windows with one anchor: word ordinal of the first, number of windows, group key."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray


def _windows(w: Words, window: int) -> np.ndarray:
    n = len(w.hash) - window + 1
    return w.doc[:n] == w.doc[window - 1 :] if n > 0 else np.zeros(0, bool)


@dataclass
class Lengths:
    """Prefixes that are lengthened: their 5-gram hashes in order, and the length of each in words."""

    gram: np.ndarray
    words: np.ndarray

    def of(self, grams: np.ndarray) -> np.ndarray:
        out = np.full(len(grams), PREFIX, np.int64)
        if len(self.gram):
            at = np.minimum(np.searchsorted(self.gram, grams), len(self.gram) - 1)
            hit = self.gram[at] == grams
            out[hit] = self.words[at[hit]]
        return out


def no_lengths() -> Lengths:
    return Lengths(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _prefixes(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window, the least hash of its 5-grams and the place of that in the window."""
    n = len(w.hash) - window + 1
    grams = gram_hash(w.hash, PREFIX)
    key, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - PREFIX + 1):
        other = grams[j : j + n]
        less = other < key
        np.copyto(key, other, where=less)
        at[less] = j
    return key, at


def _lengthened(w: Words, window: int, at: np.ndarray, which: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` words that hold the 5-gram, as far to its right as the window goes."""
    start = which + np.minimum(at[which], window - length)
    return mix64(gram_hash(w.hash, length)[start] + np.uint64(length))


def anchored_runs(w: Words, window: int, longer: Lengths) -> Runs:
    none = Runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if len(w.hash) < window:
        return none
    ok = np.flatnonzero(_windows(w, window))
    if not len(ok):
        return none
    key, at = _prefixes(w, window)
    length = longer.of(key)
    for k in np.unique(length[length > PREFIX]).tolist():
        which = np.flatnonzero(length == k)
        key[which] = _lengthened(w, window, at, which, k)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(ok) != 1) | (key[ok[1:]] != key[ok[:-1]]))))
    return Runs(ok[new], np.diff(np.concatenate((new, [len(ok)]))), key[ok[new]])


@dataclass
class Plan:
    """A block's distinct runs in routing order, and for each run of the block its place among them."""

    runs: Runs
    distinct: np.ndarray
    place: np.ndarray
    bucket: np.ndarray


def plan_block(w: Words, window: int, longer: Lengths, buckets: int) -> Plan:
    runs = anchored_runs(w, window, longer)
    if not len(runs.start):
        e = np.zeros(0, np.int64)
        return Plan(runs, e, e, e)
    whole = gram_hash(w.hash, window)
    same = mix64(whole[runs.start] * np.uint64(3) + whole[runs.start + runs.count - 1] + runs.count.astype(np.uint64))
    _, first, inverse = np.unique(same, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[inverse] != np.arange(len(inverse)))
    size = runs.count[again] + window - 1
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    one, other = np.repeat(runs.start[again], size) + step, np.repeat(runs.start[first[inverse[again]]], size) + step
    if (runs.count[again] != runs.count[first[inverse[again]]]).any() or not w.same(one, other).all():  # two runs of one hash
        text = [w.buf[w.start[a] : w.end[a + n + window - 2]].split() for a, n in zip(runs.start.tolist(), runs.count.tolist(), strict=True)]
        table: dict[bytes, int] = {}
        inverse = np.array([table.setdefault(b" ".join(x), len(table)) for x in text])
        _, first, inverse = np.unique(inverse, return_index=True, return_inverse=True)
    bucket = (runs.key[first] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((first, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Plan(runs, first[order], rank[inverse], bucket[order])


def _block_texts(table: pa.Table, id_name: str, text_name: str) -> tuple[pa.Table, list, list[bytes | None]]:
    ids = table.column(id_name).to_pylist()
    texts = [None if z is None else unpack(z) for z in table.column(text_name).to_pylist()]
    order = block_order(ids, texts)
    return table.take(pa.array(order, pa.int64())), [ids[i] for i in order], [texts[i] for i in order]


_NO_ID = np.iinfo(np.int64).max


def _counted(batches: Iterable[pa.RecordBatch], count, groups: int) -> Iterable[pa.RecordBatch]:
    """``count`` (words -> keys, bytes) over batches, as packed rows of one group of keys each."""
    for b in sliced(batches, 0):
        w = words_of([t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()])
        keys, size = count(w)
        keys, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, size, len(keys)).astype(np.int64)
        group = (keys >> np.uint64(8)).astype(np.int64) % groups
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order], prepend=-1)).tolist()
        spans = list(zip(cuts, [*cuts[1:], len(order)], strict=True)) if cuts else []
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(group[order[i]]) for i, _ in spans], pa.int32()),
                pa.array([zigzag_deltas(keys[order[i:j]].view(np.int64)) for i, j in spans], pa.binary()),
                pa.array([pack(total[order[i:j]].astype("<u4")) for i, j in spans], pa.binary()),
            ],
            names=["grp", "keys", "bytes"],
        )


def _summed(table: pa.Table, limit: int) -> pa.Table:
    """The keys of one group that draw more than ``limit`` bytes."""
    keys = np.concatenate([from_deltas(x) for x in table.column("keys").to_pylist()])
    size = np.concatenate([unpack_array(x, "<u4") for x in table.column("bytes").to_pylist()])
    keys, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, size, len(keys))
    much = total > limit
    return pa.table({"key": pa.array(keys[much]), "size": pa.array(total[much].astype(np.int64))})


def _run_bytes(w: Words, runs: Runs, window: int) -> np.ndarray:
    return w.end[runs.start + runs.count + window - 2] - w.start[runs.start]


def prefix_lengths(docs: DataFrame, text_col: str, window: int = WINDOW, limit: int = PREFIX_BYTES, groups: int = 64) -> Lengths:
    """The prefixes that draw more than ``limit`` bytes, counted over all documents, with the length at
    which none of their longer forms does, or else the whole window.

    The first pass counts all prefixes (in 40 bits of their hashes: to meet there can only lengthen
    one too many). Only where some are too frequent, a second one counts their longer forms."""
    texts = docs.select(text_col)

    def over(count) -> list:
        rows = texts.mapInArrow(lambda batches: _counted(batches, count, groups), "grp int, keys binary, bytes binary")
        return rows.groupBy("grp").applyInArrow(lambda t: _summed(t, limit), "key bigint, size bigint").collect()  # at most all bytes / limit

    def short(w: Words) -> tuple[np.ndarray, np.ndarray]:
        runs = anchored_runs(w, window, no_lengths())
        return runs.key & _SHORT, _run_bytes(w, runs, window)

    hot = np.sort(np.array([r["key"] for r in over(short)], np.int64).view(np.uint64))
    if not len(hot):
        return no_lengths()

    def longer(w: Words) -> tuple[np.ndarray, np.ndarray]:
        """For windows of hot prefixes: keys of (prefix, length) with what the longer prefix draws, summed
        where two long forms share 40 bits; a key holds the length in its low bits."""
        if len(w.hash) < window:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        key, at = _prefixes(w, window)
        which = np.flatnonzero(_windows(w, window) & np.isin(key & _SHORT, hot))
        size = w.end[which + window - 1] - w.start[which]
        made = [(_lengthened(w, window, at, which, k) & ~np.uint64(15)) | np.uint64(k) for k in range(PREFIX + 1, window)]
        return np.concatenate(made) if made else np.zeros(0, np.uint64), np.tile(size, len(made))

    too_long = np.sort(np.array([r["key"] for r in over(longer)], np.int64).view(np.uint64))

    def needed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """The longest form of each hot prefix that is still too frequent, in this batch."""
        for b in sliced(batches, 0):
            w = words_of([t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()])
            if len(w.hash) < window:
                continue
            key, at = _prefixes(w, window)
            which = np.flatnonzero(_windows(w, window) & np.isin(key & _SHORT, hot))
            most = np.full(len(which), PREFIX, np.int64)
            for k in range(PREFIX + 1, window):
                made = (_lengthened(w, window, at, which, k) & ~np.uint64(15)) | np.uint64(k)
                most[np.isin(made, too_long)] = k
            keys, back = np.unique(key[which], return_inverse=True)
            top = np.full(len(keys), PREFIX, np.int64)
            np.maximum.at(top, back, most)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(top)], names=["key", "words"])

    rows = texts.mapInArrow(needed, "key bigint, words bigint").groupBy("key").agg(F.max("words").alias("words")).toPandas()  # as many as hot ones
    gram = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return Lengths(gram[order], np.minimum(rows["words"].to_numpy(np.int64)[order] + 1, window))


def suffix_array(code: np.ndarray, leaf: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``leaf`` by the numbers of their first ``window`` words, and how many
    words each shares with the one before it there (0 to ``window``)."""
    bits = max(int(code.max(initial=0)).bit_length(), 1)
    per = 63 // bits  # words whose numbers fit one key
    keys = []
    for i in range(0, window, per):
        key = np.zeros(len(leaf), np.int64)
        for j in range(i, min(i + per, window)):
            key = key << bits | code[leaf + j]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    array, common = leaf[order], np.zeros(len(leaf), np.int64)
    live = np.arange(1, len(leaf))
    for depth in range(window):
        live = live[code[array[live] + depth] == code[array[live - 1] + depth]]
        common[live] += 1
    return order, common


def _repeats(w: Words, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes with at least ``window`` words, and for each whether a smaller owner has its window.

    Words are numbered (one number for the same bytes only), the suffix array sorts suffixes by these
    numbers, and common prefixes of neighbours give the tree: suffixes between two places where fewer
    than d words are shared hang under one node of depth d or more. The nodes of depth ``window`` with
    several leaves are the repeats; a leaf yields to the least owner under its node."""
    leaf = np.flatnonzero(_windows(w, window))
    who = owner[w.doc[leaf]]
    order, common = suffix_array(w.codes(), leaf, window)
    begins = common < window
    least = np.minimum.reduceat(who[order], np.flatnonzero(begins))[np.cumsum(begins) - 1] if len(order) else who
    repeated = np.zeros(len(leaf), bool)
    repeated[order] = least < who[order]
    return leaf, repeated


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    out_text: bool = True,
    digests: bool = False,
    prefix_bytes: int = PREFIX_BYTES,
) -> DataFrame:
    """Remove every word that a repeated passage covers, keeping the copy of the smallest id.

    A window is ``window`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one document. A word goes if a
    window over it has a word sequence that also starts in a document with a smaller id; windows are
    judged on the input. All rows and columns of ``docs`` are returned, with n_words, n_removed and,
    on demand, the new text (``out_text``) and kept_sha256 (``digests``: SHA-256 of the kept words
    joined by one space) in place of columns of these names. A text without removed words is returned
    as it was; else the removed words go with the white space after them. Null and empty texts, and
    texts below ``window`` words, lose nothing; null stays null and has no words. Rows with a null id
    come after all others and yield to them, but not to each other; nor do rows of one id. The id is
    an integer. Passages are compared word by word, so equal hashes of different words do no harm.
    """
    spark = docs.sparkSession
    clash = [c for c in docs.columns if c.lower() in ("n_words", "n_removed", "kept_sha256")]
    docs = docs.drop(*clash)
    cols = docs.columns
    it, tt = f"c{cols.index(id_col)}", f"c{cols.index(text_col)}"
    size = text_bytes(docs, text_col)
    buckets = max(shuffle_partitions(spark), int(_SPREAD * size) // BUCKET_BYTES + 1)
    longer = prefix_lengths(docs, text_col, window, prefix_bytes, max(shuffle_partitions(spark), size // (32 << 20) + 1))
    blocks = blocks_of(docs, id_col, text_col, size)

    def scatter(table: pa.Table) -> pa.Table:
        _, ids, texts = _block_texts(table, it, tt)
        w = words_of([t or b"" for t in texts])
        plan = plan_block(w, window, longer, buckets)
        first = plan.runs.start[plan.distinct]
        last = first + plan.runs.count[plan.distinct] + window - 2
        owner = np.array([_NO_ID if i is None else i for i in ids], np.int64)[w.doc[first]] if len(first) else first
        a, z = w.start[first], w.end[last] if len(first) else first
        cuts = np.flatnonzero(np.diff(plan.bucket, prepend=-1)).tolist()
        rows = plan.bucket[cuts].tolist()
        spans = [slice(i, j) for i, j in zip(cuts, [*cuts[1:], len(plan.bucket)], strict=True)] if cuts else []
        join = lambda s: b"".join(w.buf[i:j] for i, j in zip(a[s].tolist(), z[s].tolist(), strict=True))
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(rows), pa.int32()),
                "bucket": pa.array(rows, pa.int32()),
                "text": pa.array([pack(join(s)) for s in spans], pa.binary()),
                "size": pa.array([pack((z[s] - a[s]).astype("<i4")) for s in spans], pa.binary()),
                "owner": pa.array([zigzag_deltas(owner[s]) for s in spans], pa.binary()),
            }
        )

    def trees(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        release()  # what this worker's earlier tasks left
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["bucket"], r["block"]))
        if not rows:
            return
        texts, owners, sent = [], [], []
        for r in rows:
            body, sizes = unpack(r.pop("text")), unpack_array(r.pop("size"), "<i4")
            ends = np.cumsum(sizes)
            texts += [body[i:j] for i, j in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            owners.append(from_deltas(r.pop("owner")))
            sent.append(len(sizes))
        del body, sizes, ends
        w = words_of(texts)
        del texts
        release()
        owner = np.concatenate(owners)
        leaf, repeated = _repeats(w, owner, window)
        # back to the sender: ordinals, among the windows it sent, of those that an earlier document has
        sender = np.repeat(np.arange(len(rows)), sent)[w.doc[leaf]]
        cuts = np.searchsorted(sender, np.arange(len(rows) + 1))
        out = [(r["block"], r["bucket"], np.flatnonzero(repeated[i:j])) for r, i, j in zip(rows, cuts[:-1], cuts[1:], strict=True)]
        out = [(b, k, zigzag_deltas(x)) for b, k, x in out if len(x)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())],
            names=["block", "bucket", "found"],
        )
        release()

    fields = [(c, k) for c, k in docs.dtypes]
    plain = [f"c{i}" for i in range(len(cols))]
    schema = [f"{p} {'string' if p == tt else k}" for p, (_, k) in zip(plain, fields, strict=True) if out_text or p != tt]
    schema += ["n_words bigint", "n_removed bigint"] + ["kept_sha256 string"] * digests
    names = [s.split(" ")[0] for s in schema]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        table, _, texts = _block_texts(left, it, tt)
        w = words_of([t or b"" for t in texts])
        plan = plan_block(w, window, longer, buckets)
        n_docs = len(texts)
        gone = np.zeros(len(w.hash) + 1, np.int64)
        if len(plan.distinct):
            size = plan.runs.count[plan.distinct]
            base = np.cumsum(size) - size
            elsewhere = np.zeros(int(size.sum()), bool)
            for k, z in zip(right.column("bucket").to_pylist(), right.column("found").to_pylist(), strict=True):
                elsewhere[from_deltas(z) + base[np.searchsorted(plan.bucket, k)]] = True
            # an id is older than another only if it differs: documents of one id share an ordinal
            ids = table.column(it).to_pylist()
            rank = np.cumsum([0] + [a != b for a, b in zip(ids[1:], ids[:-1], strict=True)])
            owner = rank[w.doc[plan.runs.start[plan.distinct]]]
            repeats = rank[w.doc[plan.runs.start]] > owner[plan.place]
            run = np.repeat(np.arange(len(plan.runs.start)), plan.runs.count)
            step = np.arange(len(run)) - np.repeat(np.cumsum(plan.runs.count) - plan.runs.count, plan.runs.count)
            at = plan.runs.start[run] + step
            bad = repeats[run] | elsewhere[base[plan.place[run]] + step]
            np.add.at(gone, at[bad], 1)
            np.add.at(gone, at[bad] + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
        n_words = np.bincount(w.doc, minlength=n_docs)
        n_removed = np.bincount(w.doc[gone], minlength=n_docs)
        first = np.cumsum(n_words) - n_words
        new, sha = [], []
        for i, t in enumerate(texts):
            s = slice(first[i], first[i] + n_words[i])
            if n_removed[i] == 0:
                new.append(t)
                if digests:
                    sha.append(hashlib.sha256(b" ".join((t or b"").split())).hexdigest())
                continue
            kept = ~gone[s]
            a, z = w.start[s], w.end[s]
            if digests:
                words = [w.buf[x:y] for x, y in zip(a[kept].tolist(), z[kept].tolist(), strict=True)]
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            if out_text:
                until = np.concatenate((a[1:], z[-1:]))
                new.append(b"".join(w.buf[x:y] for x, y in zip(a[kept].tolist(), until[kept].tolist(), strict=True)).rstrip())
        data = {p: table.column(p) for p in plain if p != tt}
        if out_text:
            data[tt] = pa.array(new, pa.binary()).cast(pa.string())
        data |= {"n_words": pa.array(n_words), "n_removed": pa.array(n_removed)}
        if digests:
            data["kept_sha256"] = pa.array(sha, pa.string())
        return pa.table([data[x] for x in names], names=names)

    sent = blocks.groupBy("block").applyInArrow(
        scatter, "block int, bucket int, text binary, size binary, owner binary"
    )
    found = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(trees, "block int, bucket int, found binary")
    result = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, ", ".join(schema))
    back = {p: c for p, c in zip(plain, cols, strict=True)}
    return result.toDF(*[back.get(x, x) for x in names])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts and the digest of the kept words of every document of the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, out_text=False, digests=True)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
