"""Document likelihoods: a lattice of subword pieces and of words with their context, summed over all paths."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import (
    Words,
    block_order,
    blocks_of,
    crc_bucket,
    crc_fold,
    materialize,
    mix64,
    pack,
    shuffle_partitions,
    text_bytes,
    unpack,
    unpack_array,
    words_of,
)

FOLDS, HELD_OUT = 7, 2
#: a and b of the weight a * n ** b that the shorter run has against n sightings of what stands before.
#: These and the vocabulary's two constants are the best of a grid on a fold of training documents; earlier
#: trials, which set the grid, looked at the held-out fold of the bench's documents (see the README).
PAIRS, TRIPLES = (30.0, 0.7), (1.0, 0.9)
#: Runs of about so many bytes of text are summed in one group.
RANGE_BYTES = 16 << 20
#: The vocabulary file ranks its pieces; a piece of rank r weighs (r + _ZIPF) ** -_POWER, and a word has
#: _PER_WORD pieces in the mean.
_ZIPF, _POWER, _PER_WORD = 10.0, 1.0, 4.0
#: Fewer words of one length are advanced one by one.
_FEW = 64
_BASE = 0x9E3779B97F4A7C55
_FILTER_BITS = 22
#: The vocabulary's own weights count as much as the pieces of so many training words.
_PRIOR = 1000.0
#: Shares of pieces are summed as integers of this unit, so that the sum has one value in any order.
_UNIT = 1 << 16
#: Stand for the end of a document and for the marks around it, among the hashes of words.
_END, _OPEN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces as byte strings: those that begin a word, those within one, and single bytes.

    Substrings are looked up by polynomial hashes; a bit table answers most misses.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        self.rank = np.zeros(n)
        self.byte = np.full(256, -1, np.int64)
        first, inner, self.bare = {}, {}, -1
        for i in range(n):
            self.rank[i] = -sp.get_score(i)
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = sp.id_to_piece(i)
                rest = text.removeprefix("▁")
                if rest == "" and text == "▁":
                    self.bare = i
                elif "▁" not in rest and rest:
                    (inner if rest == text else first)[rest.encode()] = i
        if self.bare < 0 or (self.byte < 0).any():
            raise ValueError("the vocabulary must have the bare word mark and all bytes")
        self.starts_word = np.zeros(n, bool)
        self.starts_word[[self.bare, *first.values()]] = True
        self.tables = [self._table(first), self._table(inner)]
        self.longest = max(map(len, [*first, *inner]), default=1)
        self.rank[self.byte] = n  # single bytes have no score of their own: they come last
        self.first, self.inner, self.sizes = first, inner, sorted({len(x) for x in inner})

    @staticmethod
    def _table(pieces: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.array([_hash(p) for p in pieces], np.uint64)
        order = np.argsort(h)
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[h >> np.uint64(64 - _FILTER_BITS)] = True
        return h[order], np.array(list(pieces.values()), np.int64)[order], bits

    def find(self, h: np.ndarray, inner: bool) -> np.ndarray:
        """Piece ids of substring hashes; -1 for none."""
        keys, ids, bits = self.tables[inner]
        out = np.full(len(h), -1, np.int64)
        hit = np.flatnonzero(bits[h >> np.uint64(64 - _FILTER_BITS)])
        if len(hit) and len(keys):
            at = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
            out[hit] = np.where(keys[at] == h[hit], ids[at], -1)
        return out


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * _BASE + b + 1) % (1 << 64)
    return h


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


@dataclass
class Weights:
    """Log-probabilities of the pieces that begin a word (among themselves) and of the others, and
    the log-probabilities of ending a word after a piece, or of going on."""

    log: np.ndarray
    stop: float
    more: float


def vocabulary_weights(p: Pieces) -> Weights:
    """The vocabulary's own scores as probabilities: they are ranks, so a power of the rank."""
    share = (np.maximum(p.rank, 0) + _ZIPF) ** -_POWER
    log = np.empty(p.size)
    for side in (p.starts_word, ~p.starts_word):
        log[side] = np.log(share[side] / share[side].sum())
    return Weights(log, float(np.log(1 / _PER_WORD)), float(np.log1p(-1 / _PER_WORD)))


def gathered_weights(p: Pieces, units: np.ndarray, words: int) -> Weights:
    """The vocabulary's weights moved towards the pieces (``expected_pieces``) of ``words`` training words."""
    own, seen = np.exp(vocabulary_weights(p).log), units / _UNIT
    log = np.empty(p.size)
    for side in (p.starts_word, ~p.starts_word):
        log[side] = np.log((seen[side] + _PRIOR * own[side]) / (seen[side].sum() + _PRIOR))
    per_word = (seen.sum() + _PRIOR * _PER_WORD) / (words + _PRIOR)
    return Weights(log, float(np.log(1 / per_word)), float(np.log1p(-1 / per_word)))


def expected_pieces(words: list[bytes], p: Pieces, w: Weights) -> np.ndarray:
    """How often each piece is used, in units of 1 / _UNIT: over all segmentations of each word, by their probability.

    Forward sums as in ``lattice``, then backward sums; an arc's share of its word is what passes through it."""
    out = np.zeros(p.size, np.int64)
    for which, n in _by_length(words):
        if n is None:
            _share_one(words[which[0]], p, w, out)
        else:
            _share_same_length([words[k] for k in which], n, p, w, out)
    return out


def _by_length(words: list[bytes]) -> Iterable[tuple[list[int], int | None]]:
    """Places of words of one length, in parts of bounded size, with the length; single places with None
    where few words have a length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(words)], strict=True):
        if z - a < _FEW:
            yield from (([k], None) for k in order[a:z].tolist())
            continue
        n = int(lengths[order[a]])
        step = max(_FEW, 400_000 // (n + 1))
        yield from ((order[i : min(i + step, z)].tolist(), n) for i in range(a, z, step))


def lattice(words: list[bytes], p: Pieces, w: Weights) -> np.ndarray:
    """Natural-log probabilities of words, summed over all their segmentations in log space.

    Words of one length are advanced together: at every end position, each piece that ends there
    adds to the forward sum. Where few words have a length, each is advanced by itself.
    """
    out = np.zeros(len(words))
    for which, n in _by_length(words):
        if n is None:
            out[which] = _forward(words[which[0]], p, w)[-1] + w.stop
        else:
            out[which] = _forward_same_length([words[k] for k in which], n, p, w)[0][n] + w.stop
    return out


def _arcs(word: bytes, j: int, p: Pieces) -> list[tuple[int, int]]:
    """Where the pieces that end at j start, and their numbers; -1 stands for pieces with the word mark."""
    out = [(j - 1, int(p.byte[word[j - 1]]))]  # a byte is always an arc; where a piece is that byte, both count
    if j <= p.longest and (piece := p.first.get(word[:j])) is not None:
        out.append((-1, piece))
    for k in p.sizes:
        if k > j:
            break
        if (piece := p.inner.get(word[j - k : j])) is not None:
            out.append((j - k, piece))
    return out


def _forward(word: bytes, p: Pieces, w: Weights) -> list[float]:
    """Forward sums of one word; linear in its length, so that texts without spaces stay in bounds."""
    log, more = w.log, w.more
    forward = [float(log[p.bare])]
    for j in range(1, len(word) + 1):
        paths = [float(log[x]) if i < 0 else forward[i] + more + float(log[x]) for i, x in _arcs(word, j, p)]
        top = max(paths)
        forward.append(top + math.log(sum(math.exp(x - top) for x in paths)))
    return forward


def _share_one(word: bytes, p: Pieces, w: Weights, out: np.ndarray) -> None:
    forward = _forward(word, p, w)
    backward, total = [-math.inf] * (len(word) + 1), forward[-1] + w.stop
    backward[-1] = w.stop
    for j in range(len(word), 0, -1):
        for i, x in _arcs(word, j, p):
            step = float(w.log[x]) + backward[j]
            if i >= 0:
                step += w.more
                backward[i] = float(np.logaddexp(backward[i], step))
                step += forward[i]
            out[x] += round(math.exp(step - total) * _UNIT)
    out[p.bare] += round(math.exp(forward[0] + backward[0] - total) * _UNIT)


def _forward_same_length(words: list[bytes], n: int, p: Pieces, w: Weights) -> tuple[np.ndarray, list[tuple]]:
    """Forward sums by end position, and the arcs in the order of their use: start, end, which words, pieces."""
    raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n).T
    prefix = np.zeros((n + 1, len(words)), np.uint64)
    for j in range(n):
        prefix[j + 1] = prefix[j] * np.uint64(_BASE) + (raw[j].astype(np.uint64) + np.uint64(1))
    forward = np.full((n + 1, len(words)), -np.inf)
    forward[0] = w.log[p.bare]  # the bare mark, then pieces within the word
    power = [1]
    for _ in range(p.longest):
        power.append(power[-1] * _BASE % (1 << 64))
    arcs, every = [], np.arange(len(words))
    for j in range(1, n + 1):
        if j <= p.longest:
            piece = p.find(prefix[j], False)
            who = np.flatnonzero(piece >= 0)
            if len(who):
                forward[j, who] = w.log[piece[who]]
                arcs.append((-1, j, who, piece[who]))
        for i in range(max(0, j - p.longest), j):
            piece = p.find(prefix[j] - prefix[i] * np.uint64(power[j - i]), True)
            if i == j - 1:  # a byte is always an arc; where a piece is that byte, both count
                forward[j] = np.logaddexp(forward[j], forward[i] + w.more + w.log[p.byte[raw[i]]])
                arcs.append((i, j, every, p.byte[raw[i]]))
            who = np.flatnonzero(piece >= 0)
            if len(who):
                forward[j, who] = np.logaddexp(forward[j, who], forward[i, who] + w.more + w.log[piece[who]])
                arcs.append((i, j, who, piece[who]))
    return forward, arcs


def _share_same_length(words: list[bytes], n: int, p: Pieces, w: Weights, out: np.ndarray) -> None:
    forward, arcs = _forward_same_length(words, n, p, w)
    backward, total = np.full(forward.shape, -np.inf), forward[n] + w.stop
    backward[n] = w.stop
    for i, j, who, piece in reversed(arcs):
        step = w.log[piece] + backward[j, who]
        if i >= 0:
            step += w.more
            backward[i, who] = np.logaddexp(backward[i, who], step)
            step += forward[i, who]
        np.add.at(out, piece, np.rint(np.exp(step - total[who]) * _UNIT).astype(np.int64))
    out[p.bare] += int(np.rint(np.exp(forward[0] + backward[0] - total) * _UNIT).sum())


@dataclass
class Counts:
    """Sums over the training documents: tokens, distinct tokens, those seen once and twice, documents."""

    tokens: int
    types: int
    once: int
    twice: int
    docs: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once else 0.5


def _table_words(table: pa.Table, held_out: int | None) -> tuple[list, Words, np.ndarray, list[int]]:
    """Ids, lower-cased words and training flags of a block's rows, in the block's fixed order."""
    ids = table.column("id").to_pylist()
    texts = [None if z is None else unpack(z) for z in table.column("t").to_pylist()]
    order = block_order(ids, texts)
    ids = [ids[i] for i in order]
    words = words_of([(texts[i] or b"").lower() for i in order])
    fold = [zlib.crc32(("null" if i is None else str(i)).encode()) % FOLDS for i in ids]
    return ids, words, np.array([f != held_out for f in fold], bool), order


def _distinct(w: Words) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number, and the distinct words by number."""
    code = w.codes()
    first = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, [w.buf[a:z] for a, z in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]


def token_runs(w: Words, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of three tokens: a hash of the first two (56 bits), one of the third (32 bits), and the document.

    A document's tokens, its end included, stand after two opening marks and before a closing one; a run
    belongs to each token and to the closing mark."""
    size = np.bincount(w.doc, minlength=docs) + 4
    stop = np.cumsum(size)
    h = np.full(int(stop[-1]), _OPEN)
    h[np.arange(len(w.doc)) + 4 * w.doc.astype(np.int64) + 2] = w.hash
    h[stop - 2] = _END
    real = np.ones(len(h), bool)
    real[stop - size] = real[stop - size + 1] = False
    two = mix64(np.roll(h, 2) * np.uint64(_BASE) + np.roll(h, 1))
    return two[real] >> np.uint64(8), (mix64(h) >> np.uint64(32)).astype(np.uint32)[real], np.repeat(np.arange(docs), size)[real]


def planes(values: np.ndarray) -> bytes:
    """Packed by byte planes: first the lowest byte of every value, then the next, so that empty high bytes cost nothing."""
    values = np.ascontiguousarray(values)
    return pack(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T))


def from_planes(data: bytes, dtype: str) -> np.ndarray:
    raw = unpack_array(data, "u1").reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


def distinct_runs(two: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of runs by key, where each distinct one begins in that order, and each run's place among them."""
    order = np.lexsort((last, two))
    a, b = two[order], last[order]
    new = np.concatenate((np.ones(min(len(order), 1), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def run_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """The range, of n, that a hash of 56 bits falls into; rises with the hash."""
    return ((keys >> np.uint64(24)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def mixed(count: np.ndarray, after: np.ndarray, log: np.ndarray, weight: tuple[float, float]) -> np.ndarray:
    """Log10 of (count + k p) / (after + k), where log is log10 p and k = weight[0] * after ** weight[1]."""
    k = weight[0] * np.maximum(after, 1.0) ** weight[1]
    return np.where(count > 0, np.log10(count + k * 10**log), np.log10(k) + log) - np.log10(after + k)


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: int | None = HELD_OUT,
    vocabulary: str | None = None,
) -> DataFrame:
    """Log10 marginal likelihood of every document over all paths of its lattice.

    Tokens are the words of the lower-cased text (A-Z) and one end per document. Between two word
    borders the lattice has every sequence of pieces of an existing vocabulary. The vocabulary's own
    scores weight all segmentations of the distinct training words; the pieces' shares there, with the
    vocabulary's weights as a prior, weight the pieces (one pass, ``gathered_weights``). Besides, there are arcs that cross the whole word, weighted by what the training
    documents hold. As pieces end at word borders, the forward sum of a document is the product of
    the sums between its borders. There, pieces and the word's count come together by absolute
    discounting: p1 = (count - D) / N + (D V / N) * (sum over segmentations into pieces). Arcs that
    know the word before, and the two before, refine it: p2 = (count(u w) + k p1) / (count(u) + k),
    p3 = (count(t u w) + k p2) / (count(t u) + k), with k = a * (count of what stands before) ** b
    and (a, b) of PAIRS or TRIPLES. Every step sums to one over all words and the end.

    Returns per row of ``docs``: the id, held_out, n_tokens, n_known, train_tokens, base_score (with
    add-one counts), score, and unseen_score, the part of the score that tokens without a training count
    have. Null and empty texts consist of the end alone. A null id falls in
    the fold of the text ``null``. Repeated rows are scored, and counted, each for itself. Without
    training documents the lattice alone decides. No rows give no rows.

    Each block of documents sends its distinct words, with counts, to groups by hash; a group sums
    them, and answers each block. Runs of three tokens go the same way as 88-bit keys, in ranges of the
    key; the runs that begin with the same two tokens meet in one group, so pairs need not be sent. A key
    has 56 bits for the first two tokens and 32 for the third: a run meets another's count, which touches
    ``score`` alone, with a chance of (distinct pairs) / 7.2e16 + (what follows its pair) / 4.3e9. No count
    table of the corpus passes through the driver, only sums and the shares of the vocabulary's pieces.
    """
    spark = docs.sparkSession
    path = vocabulary or public_vocabulary()
    kind = dict(docs.dtypes)[id_col]
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    size = text_bytes(named, "t")
    blocks = blocks_of(named, "id", "t", size).withColumnsRenamed({"c0": "id", "c1": "t"})
    n = max(shuffle_partitions(spark), size // (64 << 20) + 1)

    def scatter(table: pa.Table) -> pa.Table:
        _, words, train, _ = _table_words(table, held_out)
        code, distinct = _distinct(words)
        count = np.bincount(code[train[words.doc]], minlength=len(distinct))
        bucket = crc_bucket(distinct, n)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
        rows = [(int(bucket[order[i]]), order[i:j]) for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True)] if cuts else []
        return pa.table(
            {
                "block": pa.array([table.column("block")[0].as_py()] * len(rows), pa.int32()),
                "bucket": pa.array([k for k, _ in rows], pa.int32()),
                "words": pa.array([pack(b" ".join(distinct[i] for i in x.tolist())) for _, x in rows], pa.binary()),
                "counts": pa.array([pack(count[x].astype("<i8")) for _, x in rows], pa.binary()),
            }
        )

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """One row per group with its words and sums (block -1), and one per sender with its words' places."""
        index: dict[int, dict[bytes, int]] = {}
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for row in b.to_pylist():
                k = row["bucket"]
                table = index.setdefault(k, {})
                words = unpack(row["words"]).split(b" ")
                at = np.fromiter((table.setdefault(x, len(table)) for x in words), np.int64, len(words))
                parts.setdefault(k, []).append((at, unpack_array(row["counts"], "<i8")))
                yield _row(row["block"], k, pack(at.astype("<i4")), b"", (0, 0, 0, 0))
        for k, table in index.items():
            total = np.zeros(len(table), np.int64)
            for at, c in parts[k]:
                total[at] += c  # a block's words are distinct
            sums = (int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum()))
            yield _row(-1, k, pack(b" ".join(table)), pack(total.astype("<i8")), sums)

    def _row(block: int, bucket: int, data: bytes, counts: bytes, sums: tuple) -> pa.RecordBatch:
        names = ["block", "bucket", "data", "counts", "tokens", "types", "once", "twice"]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()] + [pa.int64()] * 4
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([block, bucket, data, counts, *sums], kinds, strict=True)], names=names)

    sent = blocks.groupBy("block").applyInArrow(scatter, "block int, bucket int, words binary, counts binary")
    merged = materialize(
        sent.repartitionById(n, F.col("bucket")).mapInArrow(
            merge, "block int, bucket int, data binary, counts binary, tokens bigint, types bigint, once bigint, twice bigint"
        )
    )
    known = merged.filter("block = -1")
    sums = known.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "once", "twice")]).first()
    fold = crc_fold(F.col("id"), FOLDS)
    ends = named.filter(fold != held_out).count() if held_out is not None else named.count()
    c = Counts(sums[0] + ends, sums[1] + (ends > 0), sums[2], sums[3], ends)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """What each piece is used in the distinct training words of a group."""
        p = _pieces(path)
        for b in batches:
            for row in b.to_pylist():
                seen = unpack_array(row["counts"], "<i8") > 0
                found = expected_pieces([x for x, y in zip(unpack(row["data"]).split(b" "), seen.tolist(), strict=True) if y], p, vocabulary_weights(p))
                some = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some])], names=["piece", "units"])

    uses = known.select("data", "counts").mapInArrow(gather, "piece int, units bigint").groupBy("piece").agg(F.sum("units").alias("units")).collect()
    units = np.zeros(_pieces(path).size, np.int64)  # as many rows as the vocabulary has pieces, at most
    units[[r["piece"] for r in uses]] = [r["units"] for r in uses]

    def answer(table: pa.Table) -> pa.Table:
        p = _pieces(path)
        rows = table.to_pylist()
        own = next(r for r in rows if r["block"] == -1)
        words, count = unpack(own["data"]).split(b" "), unpack_array(own["counts"], "<i8")
        sub = lattice(words, p, gathered_weights(p, units, sums[1]))
        if c.tokens:
            d = c.discount
            prob = np.maximum(count - d, 0) / c.tokens + d * c.types / c.tokens * np.exp(sub)
            log = np.where(prob > 0, np.log10(np.maximum(prob, 1e-300)), sub / np.log(10) + np.log10(d * c.types / c.tokens))
        else:
            log = sub / np.log(10) + np.log10(0.5)
        asked = [(r["block"], unpack_array(r["data"], "<i4")) for r in rows if r["block"] != -1]
        return pa.table(
            {
                "block": pa.array([b for b, _ in asked], pa.int32()),
                "bucket": pa.array([own["bucket"]] * len(asked), pa.int32()),
                "counts": pa.array([pack(count[x]) for _, x in asked], pa.binary()),
                "logs": pa.array([pack(log[x]) for _, x in asked], pa.binary()),
            }
        )

    answers = (
        merged.select("block", "bucket", "data", "counts")
        .groupBy("bucket")
        .applyInArrow(answer, "block int, bucket int, counts binary, logs binary")
    )

    def runs(table: pa.Table) -> pa.Table:
        """Each block's distinct runs of three tokens with their training counts, cut by range of key."""
        _, words, train, _ = _table_words(table, held_out)
        two, last, doc = token_runs(words, len(train))
        order, start, _ = distinct_runs(two, last)
        count = np.add.reduceat(train[doc][order].astype(np.int64), start)
        two, last = two[order[start]], last[order[start]]
        used, begin = np.unique(run_bucket(two, ranges), return_index=True)
        spans = list(zip(used.tolist(), begin.tolist(), [*begin[1:].tolist(), len(two)], strict=True))
        return pa.table(
            {
                "block": pa.array([table.column("block")[0].as_py()] * len(spans), pa.int32()),
                "bucket": pa.array([k for k, _, _ in spans], pa.int32()),
                "twos": pa.array([planes(np.diff(two[i:j], prepend=np.uint64(0))) for _, i, j in spans], pa.binary()),
                "lasts": pa.array([planes(last[i:j].astype("<u4")) for _, i, j in spans], pa.binary()),
                "counts": pa.array([planes(count[i:j].astype("<i4")) for _, i, j in spans], pa.binary()),
            }
        )

    def sum_runs(table: pa.Table) -> pa.Table:
        """For each block's runs: how often they are (counts), and how often their first two tokens (logs)."""
        twos = [np.cumsum(from_planes(x, "<u8")) for x in table.column("twos").to_pylist()]
        ends = np.cumsum([len(x) for x in twos]).tolist()
        two = np.concatenate(twos)
        last = np.concatenate([from_planes(x, "<u4") for x in table.column("lasts").to_pylist()])
        count = np.concatenate([from_planes(x, "<i4") for x in table.column("counts").to_pylist()]).astype(np.int64)
        del twos
        order, start, place = distinct_runs(two, last)
        total = np.add.reduceat(count[order], start)
        heads = two[order[start]]
        begin = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
        alike = np.repeat(np.add.reduceat(total, begin), np.diff(np.append(begin, len(total))))
        spans = list(zip([0, *ends[:-1]], ends, strict=True))
        return pa.table(
            {
                "block": table.column("block"),
                "bucket": pa.array(-1 - table.column("bucket").to_numpy(), pa.int32()),
                "counts": pa.array([planes(total[place[i:j]]) for i, j in spans], pa.binary()),
                "logs": pa.array([planes(alike[place[i:j]]) for i, j in spans], pa.binary()),
            }
        )

    ranges = max(shuffle_partitions(spark), size // RANGE_BYTES + 1)
    run_rows = blocks.groupBy("block").applyInArrow(runs, "block int, bucket int, twos binary, lasts binary, counts binary")
    summed = run_rows.groupBy("bucket").applyInArrow(sum_runs, "block int, bucket int, counts binary, logs binary")
    answers = answers.unionByName(summed)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, words, train, order = _table_words(left, held_out)
        code, distinct = _distinct(words)
        bucket = crc_bucket(distinct, n)
        by_bucket = np.argsort(bucket, kind="stable")
        dealt = bucket[by_bucket]
        count, log = np.zeros(len(distinct), np.int64), np.zeros(len(distinct))
        two, last, run_doc = token_runs(words, len(ids))
        closing = np.diff(run_doc, append=len(ids)) > 0
        doc = run_doc[~closing]
        token = np.full(len(doc), len(distinct), np.int64)  # the end: one past the words
        token[np.arange(len(code)) + words.doc] = code
        by_key, start, place = distinct_runs(two, last)
        in_range = run_bucket(two[by_key[start]], ranges)
        whole_run, first_two = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for r in right.to_pylist():
            k = r["bucket"]
            if k < 0:
                x = slice(*np.searchsorted(in_range, [-1 - k, -k]))
                whole_run[x], first_two[x] = from_planes(r["counts"], "<i8"), from_planes(r["logs"], "<i8")
                continue
            x = by_bucket[slice(*np.searchsorted(dealt, [k, k + 1]))]
            count[x], log[x] = unpack_array(r["counts"], "<i8"), unpack_array(r["logs"], "<f8")
        base = np.log10(count + 1.0)
        end = np.log10((c.docs - c.discount) / c.tokens) if c.docs else np.log10(0.5)
        whole = np.log10(c.tokens + c.types + 1.0)
        size = np.bincount(doc, minlength=len(ids))
        n_three, after_two = whole_run[place[~closing]], first_two[place[~closing]]
        n_two = first_two[np.roll(place, -1)[~closing]]  # what the next run begins with
        opens = np.diff(doc, prepend=-1) > 0  # the first token of each document
        after = np.where(opens, c.docs, np.append(count, 0)[np.roll(token, 1)])
        own = mixed(n_three, after_two, mixed(n_two, after, np.append(log, end)[token], PAIRS), TRIPLES)
        return pa.table(
            {
                "id": left.column("id").take(pa.array(order, pa.int64())),
                "held_out": pa.array(~train),
                "n_tokens": pa.array(size),
                "n_known": pa.array(np.bincount(doc, np.append(count, c.docs)[token] > 0, len(ids)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(ids), c.tokens, np.int64)),
                "base_score": pa.array(np.bincount(doc, np.append(base, np.log10(c.docs + 1.0))[token], len(ids)) - size * whole),
                "score": pa.array(np.bincount(doc, own, len(ids))),
                "unseen_score": pa.array(np.bincount(doc, np.where(np.append(count, c.docs)[token] > 0, 0.0, own), len(ids))),
            }
        )

    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        finish, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, unseen_score double"
    )
    return out.withColumnRenamed("id", id_col)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and scores of every document of the table."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
