"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import add_columns, crc_fold, mix64, release, sliced, words_of

#: Bounds of the fitted sample: labelled documents of each class, chosen by a hash of their ids, and
#: bytes of their texts; a document that would pass the latter, and those behind it, are not fitted.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 64 << 20
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Bytes of text whose tokens are held at once, and tokens of one step of the fit.
_FIT_BYTES, _FIT_TOKENS = 2 << 20, 1 << 17

#: A-Z to lower case and ASCII signs to spaces, byte for byte, so that offsets hold in the text.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256)
)
_STOPS = np.zeros(256, bool)
_STOPS[[10, 13, 33, 46, 63]] = True  # line ends and . ! ? end a sequence


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    shout: np.ndarray
    seq: np.ndarray  # ordinal of the token's sequence


def tokens_of(texts: list[bytes]) -> Tokens:
    """Lower-cased tokens between white space and ASCII signs; sequences are sentences and lines."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    w = words_of([t.translate(_TABLE) for t in texts])
    if not len(w.hash):
        e = np.zeros(0, np.int64)
        return Tokens(e, e, e, w.hash, np.zeros(0, bool), e)
    stops = np.searchsorted(np.flatnonzero(_STOPS[raw]), w.start)  # how many stand before the token
    new = np.concatenate(([True], (np.diff(stops) != 0) | (np.diff(w.doc) != 0)))
    first = raw[w.start]
    return Tokens(w.start, w.end, w.doc, w.hash, (first >= 65) & (first <= 90) & (w.end - w.start > 1) & (raw[w.end - 1] >= 65) & (raw[w.end - 1] <= 90), np.cumsum(new) - 1)


@dataclass
class Chain:
    """Weights of the two-state chain: a token's score for the toxic state, and the transitions."""

    words: np.ndarray  # sorted hashes
    weight: np.ndarray  # of each word; the last is that of all other words
    shout: float
    step: np.ndarray  # 2 x 2, from state to state
    doc: np.ndarray  # logistic weights of the document features
    scale: np.ndarray

    def index(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, len(self.words))


def forward_backward(odds: np.ndarray, seq: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of the toxic state before and after each token's own evidence, over all sequences at once.

    ``odds``: exp of the tokens' scores. Returns (forward odds, backward odds, next token or -1).
    With two states one ratio per token holds a whole message, so a pass is one rational function
    per position; sequences are advanced together, longest first.
    """
    n = len(odds)
    c = np.exp(step)
    first = np.flatnonzero(np.concatenate(([True], np.diff(seq) != 0))) if n else np.zeros(0, np.int64)
    length = np.diff(np.concatenate((first, [n])))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    fwd, bwd = np.empty(n), np.ones(n)
    clip = lambda x: np.clip(x, 1e-12, 1e12)
    fwd[first] = odds[first]
    live = np.searchsorted(-length, -np.arange(1, (length[0] if n else 0) + 1), side="right")
    for t in range(1, len(live)):
        at = first[: live[t]] + t
        o = fwd[at - 1]
        fwd[at] = clip(odds[at] * (c[0, 1] + o * c[1, 1]) / (c[0, 0] + o * c[1, 0]))
    for t in range(len(live) - 2, -1, -1):
        at = first[: live[t + 1]] + t
        o = clip(odds[at + 1] * bwd[at + 1])
        bwd[at] = (c[1, 0] + o * c[1, 1]) / (c[0, 0] + o * c[0, 1])
    return fwd, bwd


def marginals(chain: Chain, t: Tokens) -> np.ndarray:
    if not len(t.hash):
        return np.zeros(0)
    odds = np.exp(chain.weight[chain.index(t.hash)] + chain.shout * t.shout)
    fwd, bwd = forward_backward(odds, t.seq, chain.step)
    o = fwd * bwd
    return o / (1 + o)


def document_features(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: 1, highest marginal, log of 1 + expected toxic tokens, their share, log of length."""
    total, size = np.bincount(doc, p, n), np.bincount(doc, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, doc, p)
    return np.stack([np.ones(n), top, np.log1p(total), total / np.maximum(size, 1), np.log1p(size) / 10], axis=1)


def _blocks(texts: list[bytes]) -> Iterable[tuple[int, int]]:
    """Ranges of texts of about _FIT_BYTES, one text at least, so that the fit's arrays stay small."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _FIT_BYTES):
            size, end = size + len(texts[end]), end + 1
        yield at, end
        at = end


def _document_counts(texts: list[bytes], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted word hashes, and in how many toxic and clean documents each occurs."""
    words, d1, d0 = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in _blocks(texts):
        t = tokens_of(texts[i:j])
        w, at = np.unique(t.hash, return_inverse=True)
        at, doc = np.divmod(np.unique(at * (j - i) + t.doc), j - i)
        bad = toxic[i:j][doc]
        words.append(w)
        d1.append(np.bincount(at[bad], minlength=len(w)))
        d0.append(np.bincount(at[~bad], minlength=len(w)))
    w, at = np.unique(np.concatenate(words), return_inverse=True)
    return w, np.bincount(at, np.concatenate(d1), len(w)), np.bincount(at, np.concatenate(d0), len(w))


def _sequence_hashes(code: np.ndarray, length: np.ndarray) -> np.ndarray:
    first = np.cumsum(length) - length
    place = np.arange(len(code)) - np.repeat(first, length)
    h = np.add.reduceat(mix64(mix64(code.astype(np.uint64)) + place.astype(np.uint64)), first)
    return mix64(h + length.astype(np.uint64))


def _picked(code: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The codes of the sequences that begin at ``first`` and have ``n`` tokens, one after the other."""
    return code[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _sequences(texts: list[bytes], toxic: np.ndarray, chain: Chain, labelled: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct sequences of all texts, longest first, in parts of about _FIT_TOKENS tokens: codes
    (4 word + 2 label + shout), lengths, counts."""
    kind = np.int32 if 4 * len(chain.words) + 4 < 1 << 31 else np.int64
    found = [(np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for i, j in _blocks(texts):
        t = tokens_of(texts[i:j])
        if not len(t.seq):
            continue
        y = np.isin(t.hash, labelled) & toxic[i:j][t.doc]
        code, length = (4 * chain.index(t.hash) + 2 * y + t.shout).astype(kind), np.bincount(t.seq)
        h, one, times = np.unique(_sequence_hashes(code, length), return_index=True, return_counts=True)
        found.append((_picked(code, (np.cumsum(length) - length)[one], length[one]), length[one], h, times))
    code, length, h, times = (np.concatenate([f[k] for f in found]) for k in range(4))
    _, one, at = np.unique(h, return_index=True, return_inverse=True)
    order = np.argsort(-length[one], kind="stable")
    one, times = one[order], np.bincount(at, times).astype(np.int64)[order]
    first, length = (np.cumsum(length) - length)[one], length[one]
    cuts = np.flatnonzero(np.diff((np.cumsum(length) - length) // _FIT_TOKENS)) + 1
    return [(_picked(code, f, n), n, k) for f, n, k in zip(*(np.split(x, cuts) for x in (first, length, times)), strict=True) if len(n)]


def _tokens_of_part(code: np.ndarray, length: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each token's word, label, shout, sequence and count, and the tokens that have a successor in their sequence."""
    seq = np.repeat(np.arange(len(length)), length)
    return code >> 2, code >> 1 & 1, code & 1, seq, np.repeat(times, length), np.flatnonzero(np.diff(seq) == 0)


def fit_tokens(texts: list[bytes], toxic: np.ndarray, share: float, rounds: int = 150) -> Chain:
    """Fit the chain and the document weights on labelled texts; ``share``: of toxic ones among all.

    Token labels come from the document labels: words that occur in several times more toxic than
    clean documents, significantly so, are toxic where they stand in a toxic document. A sequence
    that the chain cannot tell from another counts as that one again, which gives the same gradient.
    The gradient is added up part by part, so that only one part's arrays are held.
    """
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    words, d1, d0 = _document_counts(texts, toxic)
    r1, r0 = d1 / n1, d0 / n0
    gain = r1 - r0 - 3 * np.sqrt((r1 + 1 / n1) / n1 + (r0 + 1 / n0) / n0)
    labelled = (d1 >= 5) & (gain > 0) & (r1 > 6 * r0 + 2 / n0)
    chosen = np.flatnonzero((d1 >= 3) & (r1 > 2 * r0))  # words with a weight of their own
    chain = Chain(np.sort(words[chosen]), np.full(len(chosen) + 1, -2.0), 0.0, np.zeros((2, 2)), np.zeros(5), np.ones(5))
    chain.weight[-1] = -6.0
    if not len(words):
        return _fit_documents(chain, texts, toxic, share)
    parts = _sequences(texts, toxic, chain, words[labelled])
    kinds = len(chain.weight)
    has, seen, pairs = np.zeros(kinds), np.zeros(kinds), np.zeros(4)
    shouts, shouted, inners = 0, 0.0, 0
    for part in parts:
        idx, y, shout, _, n, inner = _tokens_of_part(*part)
        has += np.bincount(idx, n * y, kinds)
        seen += np.bincount(idx, n, kinds)
        pairs += np.bincount(y[inner] * 2 + y[inner + 1], n[inner], 4)
        shouts, shouted, inners = shouts + (n * shout).sum(), shouted + float((n * y * shout).sum()), inners + n[inner].sum()
    theta = np.concatenate((chain.weight, [0.0], np.zeros(4)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):  # Adam on the log-likelihood, each gradient scaled by its own count
        w, step = theta[:kinds], theta[kinds + 1 :].reshape(2, 2)
        c = np.exp(step)
        mass, loud, joint = np.zeros(kinds), 0.0, np.zeros(4)
        for part in parts:
            idx, _, shout, seq, n, inner = _tokens_of_part(*part)
            odds = np.exp(w[idx] + theta[kinds] * shout)
            fwd, bwd = forward_backward(odds, seq, step)
            a, b = fwd[inner], odds[inner + 1] * bwd[inner + 1]
            q = n[inner] / (c[0, 0] + b * c[0, 1] + a * c[1, 0] + a * b * c[1, 1])
            joint += [c[0, 0] * q.sum(), c[0, 1] * (b * q).sum(), c[1, 0] * (a * q).sum(), c[1, 1] * (a * b * q).sum()]
            p = n * (fwd * bwd / (1 + fwd * bwd))
            mass += np.bincount(idx, p, kinds)
            loud += float((p * shout).sum())
        grad = np.concatenate(
            (
                (has - mass) / (seen + 1) - 1e-3 * w,
                [(shouted - loud) / (shouts + 1)],
                (pairs - joint) / (inners + 1) - 1e-3 * step.ravel(),
            )
        )
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.2 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    chain.weight, chain.shout, chain.step = theta[:kinds], float(theta[kinds]), theta[kinds + 1 :].reshape(2, 2)
    return _fit_documents(chain, texts, toxic, share)


def _fit_documents(chain: Chain, texts: list[bytes], toxic: np.ndarray, share: float) -> Chain:
    """Logistic weights by Newton steps; the classes are weighted to their share of all labels."""
    if not len(toxic):
        return chain
    parts = []
    for i, j in _blocks(texts):
        t = tokens_of(texts[i:j])
        parts.append(document_features(marginals(chain, t), t.doc, j - i))
    x = np.concatenate(parts)
    chain.scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / chain.scale
    y = toxic.astype(float)
    weight = np.where(toxic, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * b)
        b = np.clip(b, -40, 40)
    chain.doc = b
    return chain


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held_out: int | None = HELD_OUT,
    sample_docs: int = SAMPLE_DOCS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Chain:
    """Fit on at most ``sample_docs`` labelled documents of each class and ``sample_bytes`` of text, in
    the order of a hash of their ids (documented bounds).

    Rows whose crc32 of the id, modulo 4, is ``held_out`` are never read for fitting. Null labels and
    ids are ignored. The sample is chosen from the small label table alone, by a hash of the id, so
    only its texts are gathered. Without labels every score is one half of the empty model.
    """
    l = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).dropna()
    if held_out is not None:
        l = l.filter(crc_fold(F.col("id"), FOLDS) != held_out)
    counts = {bool(r["y"]): r["count"] for r in l.groupBy((F.col("y") > 0).alias("y")).count().collect()}
    parts = [
        l.filter(F.col("y") > 0 if one else F.col("y") <= 0).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
        for one in (False, True)
    ]
    ids = parts[0].unionByName(parts[1])
    share = counts.get(True, 0) / max(sum(counts.values()), 1)

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows, room = [], sample_bytes
        for b in sliced(batches, 1):  # in the order of the hash
            for r in b.to_pylist():
                text = (r["t"] or "").encode()
                room -= len(text)
                if room >= 0:
                    rows.append((r["id"], text, r["y"] > 0))
        rows.sort()
        chain = fit_tokens([t for _, t, _ in rows], np.array([y for *_, y in rows], bool), share)
        rows.clear()
        release()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], names=["model"])

    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(ids), "id")
    # at most 2 * sample_docs rows and sample_bytes, fitted in one task; the driver gets the weights only
    sample = sample.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")
    row = sample.mapInArrow(fit, "model binary").first()
    return pickle.loads(row["model"]) if row else fit_tokens([], np.zeros(0, bool), share)


def score_texts(chain: Chain, texts: list[bytes], threshold: float = THRESHOLD) -> list[pa.Array]:
    """Scores, decisions and spans of the texts."""
    parts: list[list[pa.Array]] = []
    for i, j in list(_blocks(texts)) or [(0, 0)]:
        block = texts[i:j]
        t = tokens_of(block)
        p = marginals(chain, t)
        x = document_features(p, t.doc, j - i) / chain.scale
        score = 1 / (1 + np.exp(-x @ chain.doc))
        hit = np.flatnonzero(p >= 0.5)
        doc = t.doc[hit]
        base = np.cumsum([0] + [len(a) + 1 for a in block])[doc]
        fields = {"start": pa.array(t.start[hit] - base, pa.int64()), "end": pa.array(t.end[hit] - base, pa.int64()), "p": pa.array(p[hit])}
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
        parts.append([pa.array(score), pa.array((score >= threshold).astype(np.int32)), spans])
    return [pa.concat_arrays([x[k] for x in parts]) for k in range(3)]


def score_toxicity(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score``, ``predicted`` and ``spans`` (start, end in UTF-8 bytes, and marginal) to all rows.

    Spans are tokens whose marginal is at least one half. Null and empty texts have no spans and the
    score of a text without tokens. Only the text is looked at. Columns of these names are replaced.
    """

    def run(arrays: list[pa.Array]) -> list[pa.Array]:
        return score_texts(chain, [x or b"" for x in arrays[0].cast(pa.binary()).to_pylist()], threshold)

    return add_columns(
        docs, [text_col], "score double; predicted int; spans array<struct<start: bigint, end: bigint, p: double>>", run
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, decision and offending spans of every document of the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, chain).select(
        "doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted", "spans"
    )
