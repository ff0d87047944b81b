"""Sum-of-squares online packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import release, sliced

CAPACITY = 2048
END_ID = 1
#: Bytes of text tokenized at once.
_BATCH = 2 << 20
#: Tokens that a task holds in open sequences; beyond it they are emptied as at its end.
_OPEN = 2 << 20
#: Bytes of words, and of word parts, whose ids a worker remembers; longer ones than _WORD are not.
_WORDS, _PARTS_KEPT, _WORD = 144 << 20, 72 << 20, 64
#: The vocabulary's own pattern for word parts, a fixed value, and the space between words.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| ")
#: White space that str.split() knows beyond the six ASCII bytes, a fixed value.
_OTHER_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0                　"
_ASCII_SPACE = regex.compile("[\x20\x09-\x0d]+")
#: Stands for the space between words; no vocabulary of 16-bit ids has it.
_GAP = b"\xff\xff"


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memory:
    """Ids (16 bits each) by string, bounded in bytes. When the young half is full it becomes the old
    one, and what is asked for again moves to the new young half, so frequent strings stay."""

    #: What a dictionary entry takes with its short string and ids.
    ENTRY = 170

    def __init__(self, limit: int) -> None:
        self.half, self.used = limit // 2, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that are not remembered; all others are in the young half when it returns."""
        if self.used > self.half:
            self.young, self.old, self.used = {}, self.young, 0
        rest = keys - self.young.keys()
        if self.old and (again := rest & self.old.keys()):
            self.put(zip(again, map(self.old.__getitem__, again), strict=True))
            rest -= again
        return list(rest)

    def put(self, entries: Iterable[tuple[str, bytes]]) -> None:
        before = len(self.young)
        self.young.update(entries)
        self.used += (self.ENTRY) * (len(self.young) - before)


class Encoder:
    """Ids of whole texts, the same as the tokenizer gives, with each remembered word done once.

    This vocabulary never joins across white space, and its last piece of a word part is marked, so
    the ids of a text are those of its parts in order. Long words, and words that hold a special
    token or white space beyond ASCII, are left to the tokenizer itself and not remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() >= (1 << 16) - 1:
            raise ValueError("ids are remembered in 16 bits")
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        for piece, i in self.tok.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # the same model for parts of printable ASCII, which its normalizer and byte coding leave alone
        bare = {k: None for k in ("normalizer", "post_processor", "truncation", "padding")} | {"added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.bare = Tokenizer.from_str(json.dumps(json.loads(self.tok.to_str()) | bare))
        self.words, self.parts = Memory(_WORDS), Memory(_PARTS_KEPT)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [_ascii_split(t) for t in texts]
        flat = list(chain.from_iterable(split))
        got = list(map(self.words.young.get, flat))
        miss = [i for i, v in enumerate(got) if v is None]
        if miss:
            lost = [flat[i] for i in miss]
            fresh, alone = self.words.missing(set(lost)), {}
            joined = " ".join(fresh)
            if len(joined) > _WORD or len(joined.split()) != len(fresh) or any(s in joined for s in self.special):
                alone = {w: self._alone(w) for w in fresh if len(w) > _WORD or len(w.split()) != 1 or any(s in w for s in self.special)}
                fresh = [w for w in fresh if w not in alone]
            self._learn(fresh)
            known = self.words.young
            for i, w in zip(miss, lost, strict=True):
                got[i] = known[w] if w in known else alone[w]
        cuts = [0, *accumulate(map(len, split))]
        return [np.frombuffer(b"".join(got[i:j]), "<u2") for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of fresh words, which are joined by single spaces and split at once."""
        narrow, wide = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
        lowered = " ".join(narrow).lower()
        if wide:
            normal = self.tok.normalizer.normalize_str(" ".join(wide))
            if normal.count(" ") != len(wide) - 1:
                normal = " ".join(self.tok.normalizer.normalize_str(w).replace(" ", "") for w in wide)
            lowered = f"{lowered} {normal}" if narrow else normal
        parts = _PARTS.findall(lowered)
        distinct = set(parts)
        distinct.discard(" ")
        self._learn_parts(self.parts.missing(distinct))
        known = self.parts.young
        known[" "] = _GAP
        data = b"".join(map(known.__getitem__, parts))
        gaps = np.flatnonzero(np.frombuffer(data, "<u2") == 0xFFFF)
        starts, ends = [0, *(2 * gaps + 2).tolist()], [*(2 * gaps).tolist(), len(data)]
        self.words.put(zip(narrow + wide, [data[i:j] for i, j in zip(starts, ends, strict=True)], strict=bool(words)))

    def _learn_parts(self, parts: list[str]) -> None:
        plain, other = [p for p in parts if p.isascii()], [p for p in parts if not p.isascii()]
        if not "".join(plain).isprintable():
            plain, other = [p for p in plain if p.isprintable()], other + [p for p in plain if not p.isprintable()]
        for tok, some in ((self.bare, plain), (self.tok, other)):
            for i in range(0, len(some), 1000):
                chunk = some[i : i + 1000]
                ids = np.array(tok.encode_batch_fast([" ".join(chunk)], add_special_tokens=False)[0].ids, np.int64)
                cut = np.flatnonzero(self.ends[ids]) + 1
                if len(cut) == len(chunk):
                    data, at = ids.astype("<u2").tobytes(), (2 * cut).tolist()
                    self.parts.put(zip(chunk, [data[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)], strict=True))
                else:
                    self.parts.put([(p, self._alone(p)) for p in chunk])

    def _alone(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _ascii_split(text: str) -> list[str]:
    """Words between ASCII white space; other white space stays inside words."""
    other = any(c in text for c in _OTHER_SPACE[: 4 if text.isascii() else None])
    return [w for w in _ASCII_SPACE.split(text) if w] if other else text.split()


class Levels:
    """Open sequences by fill level. ``count[h]`` is how many are filled to h; each level is a stack.

    A piece goes to the level, or to a new sequence, that leaves the least sum of squared counts:
    taking from level h changes it by 1 - 2 count[h], adding to level h + s by 1 + 2 count[h + s];
    a full sequence leaves the array. Ties go to the fullest level.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int, new: int) -> tuple[int, int]:
        """(sequence, offset) for a piece; ``new`` names the sequence to open if none is chosen."""
        top = self.capacity - size
        gain = 1 + 2 * self.count[size:].copy()
        gain[top] = 0  # becomes full
        cost = gain - 2 * self.count[: top + 1] + 1
        cost[self.count[: top + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = gain[0]
        level = top - int(np.argmin(cost[::-1]))
        seq = self.stacks[level].pop() if level else new
        self.count[level] -= level > 0
        if level + size < self.capacity:
            self.count[level + size] += 1
            self.stacks[level + size].append(seq)
        return seq, level

    def open(self) -> list[int]:
        """The open sequences, fullest first."""
        return [s for h in range(self.capacity - 1, 0, -1) for s in self.stacks[h]]


#: A piece: (document, start, ids, tokens of the document).
Piece = tuple[object, int, np.ndarray, int]


class Packer:
    """Places documents one by one; full sequences are handed out at once, open ones are held."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next, self.levels = capacity, first, Levels(capacity)
        self.held: dict[int, list[Piece]] = {}
        self.tokens = 0

    def add(self, doc: object, ids: np.ndarray) -> list[tuple[int, list[Piece]]]:
        """Cut off whole windows, place the rest; returns the sequences (number, pieces) that are full."""
        total = len(ids)
        whole = total // self.capacity * self.capacity
        out = []
        for at in range(0, whole, self.capacity):
            out.append((self._number(), [(doc, at, ids[at : at + self.capacity], total)]))
        if whole < total:
            rest = ids[whole:].astype("<u2")
            seq, fill = self.levels.place(len(rest), self.next)
            if fill == 0:
                self.held[self._number()] = []
            self.held[seq].append((doc, whole, rest, total))
            self.tokens += len(rest)
            if fill + len(rest) == self.capacity:
                self.tokens -= self.capacity
                out.append((seq, self.held.pop(seq)))
            if self.tokens > _OPEN:
                out += self.finish()
        return out

    def finish(self) -> list[tuple[int, list[Piece]]]:
        """Empty the open sequences, fullest first, into full ones, cutting pieces where one ends; what
        remains is cut into powers of two, which need no padding."""
        stream = [p for s in self.levels.open() for p in self.held[s]]
        total = sum(len(p[2]) for p in stream)
        full, rest = divmod(total, self.capacity)
        room = [self.capacity] * full + [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if rest >> b & 1]
        out, i, used = [], 0, 0
        for size in room:
            seq, fill = [], 0
            while fill < size:
                doc, start, ids, n = stream[i]
                take = min(len(ids) - used, size - fill)
                seq.append((doc, start + used, ids[used : used + take], n))
                fill, used = fill + take, used + take
                if used == len(ids):
                    i, used = i + 1, 0
            out.append((self._number(), seq))
        self.levels, self.held, self.tokens = Levels(self.capacity), {}, 0
        return out

    def _number(self) -> int:
        self.next += 1
        return self.next - 1


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are those of its text (null: empty) and one end id, so every row of
    ``docs``, repeated or with a null id, has at least one piece. ``capacity`` is a power of two.
    Each partition is packed as it is read, in one pass and without a shuffle. A task holds the open
    sequences only, of a bounded number of tokens; when it ends, or reaches that bound, they are
    emptied by cutting. Sequence ids hold the partition in their upper bits, so a recomputed task
    gives the same ids. Other columns are not read. An empty table gives no rows.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = vocabulary or public_vocabulary()
    kind = dict(docs.dtypes)[id_col]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        packer, id_type = Packer(capacity, TaskContext.get().partitionId() << 40), None

        def rows(sequences: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            out = []
            for seq, pieces in sequences:
                at = 0
                for doc, start, ids, n in pieces:
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, seq, at))
                    at += len(ids)
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

        end = np.array([END_ID], "<u2")
        for b in sliced(batches, 1, _BATCH):
            id_type, full = b.column(0).type, []
            encoded = encoder(path).encode([t or "" for t in b.column(1).to_pylist()])
            for doc, ids in zip(b.column(0).to_pylist(), encoded, strict=True):
                full += packer.add(doc, np.concatenate((ids, end)))
            yield rows(full)
        if id_type is not None:
            yield rows(packer.finish())
        release()

    out = docs.select(id_col, text_col).toDF("id", "t").mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))
    return out.withColumnRenamed("id", id_col)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document of the table, in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
