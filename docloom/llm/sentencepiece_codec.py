"""Best segmentation of texts into the pieces of an existing vocabulary, and back."""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import add_columns
from docloom.llm.lm_scoring import public_vocabulary

MARK = "▁"
#: Distinct units whose segmentation a worker remembers; beyond it the table starts anew.
_MEMORY = 1_200_000
#: Units are segmented together in groups of so many bytes; a longer unit goes by itself.
_GROUP, _LONG = 1 << 17, 512
#: A unit is a run of spaces with what follows it, up to the next space or line end.
_UNITS = re.compile(" +[^ \n]*|[^ \n]+|\n")


class Automaton:
    """Aho-Corasick over byte strings as one transition table, filled level by level.

    ``first[s]`` is the longest word that ends in state s, ``link[s]`` the next shorter one after
    it; words are named by their states, and 0 is none."""

    def __init__(self, words: list[bytes]) -> None:
        prefixes = sorted({w[:i] for w in words for i in range(1, len(w) + 1)}, key=lambda p: (len(p), p))
        self.state = {p: i for i, p in enumerate(prefixes, 1)}
        n = len(prefixes) + 1
        parent = np.array([0] + [self.state.get(p[:-1], 0) for p in prefixes])
        byte = np.array([0] + [p[-1] for p in prefixes])
        depth = np.array([0] + [len(p) for p in prefixes])
        ends = np.zeros(n, bool)
        ends[[self.state[w] for w in words]] = True
        fail, self.link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.step = np.zeros((n, 256), np.int32)
        for level in range(1, int(depth[-1]) + 1):
            s = np.flatnonzero(depth == level)
            if level > 1:
                fail[s] = self.step[fail[parent[s]], byte[s]]
            self.step[parent[s], byte[s]] = s
            self.step[s] = self.step[fail[s]]
            self.link[s] = np.where(ends[fail[s]], fail[s], self.link[fail[s]])
        self.first = np.where(ends, np.arange(n, dtype=np.int32), self.link)


class Codec:
    """An automaton over the pieces, with marks as spaces. A piece of rank r scores -log(r + 2); a
    byte, which stands in where no piece reaches, scores less than any piece. A mark that a text
    itself holds is in no piece and goes out as bytes, so that decoding tells it from a space."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.text, self.byte, pieces = [b""] * size, np.zeros(256, np.uint16), {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.text[i] = bytes([int(piece[3:5], 16)])
                self.byte[self.text[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in piece.lstrip(MARK) or " " in piece or "\n" in piece:
                    raise ValueError("a piece reaches over the start of a word")
                self.text[i] = piece.replace(MARK, " ").encode()
                pieces[self.text[i]] = i
        self.auto = Automaton(list(pieces))
        self.size = np.array([len(t) for t in self.text])
        self.piece = np.zeros(len(self.auto.first), np.uint16)
        self.score = np.zeros(len(self.auto.first))
        for t, i in pieces.items():
            self.piece[self.auto.state[t]] = i
            self.score[self.auto.state[t]] = -np.log(2.0 - sp.get_score(i))
        self.byte_score = -float(np.log(2.0 + size)) * 2
        self.known: dict[str, bytes] = {}

    def group(self, units: list[bytes]) -> list[bytes]:
        """Ids (16 bits each) of the best segmentation of every unit; all move on a byte at a time.

        At every position the output links list all pieces that end there; each relaxes the best
        score of its end. Ties go to the longer last piece. No piece crosses a unit's border, so
        the best of a text is the best of its units. ``units`` come longest first."""
        n = np.array([len(u) for u in units])
        base = np.cumsum(n + 1) - (n + 1)
        raw = np.frombuffer(b"\0".join(units) + b"\0", np.uint8)
        best, back, state = np.zeros(len(raw)), np.zeros(len(raw), np.uint16), np.zeros(len(n), np.int32)
        for t in range(1, int(n[0]) + 1):
            m = int(np.searchsorted(-n, -t, side="right"))
            at = base[:m] + t
            byte = raw[at - 1]
            state = self.auto.step[state[:m], byte]
            score, via = best[at - 1] + self.byte_score, self.byte[byte]
            found = self.auto.first[state]
            live = np.flatnonzero(found)
            found = found[live]
            while len(live):
                piece = self.piece[found]
                total = best[at[live] - self.size[piece]] + self.score[found]
                better = total > score[live]
                score[live[better]], via[live[better]] = total[better], piece[better]
                found = self.auto.link[found]
                more = np.flatnonzero(found)
                live, found = live[more], found[more]
            best[at], back[at] = score, via
        return self._trace(n, base, back)

    def _trace(self, n: np.ndarray, base: np.ndarray, back: np.ndarray) -> list[bytes]:
        """The ids on the best way to each unit's end."""
        unit, at, steps = np.arange(len(n)), n.copy(), []
        while len(unit):
            ids = back[base[unit] + at]
            steps.append((unit, ids))
            at = at - self.size[ids]
            unit, at = unit[at > 0], at[at > 0]
        units = np.concatenate([u for u, _ in steps][::-1])
        data = np.concatenate([i for _, i in steps][::-1])[np.argsort(units, kind="stable")].astype("<u2").tobytes()
        ends = (2 * np.cumsum(np.bincount(units, minlength=len(n)))).tolist()
        return [data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def single(self, unit: bytes) -> bytes:
        """The same for one long unit, in plain steps."""
        step, first, link = self.auto.step, self.auto.first, self.auto.link
        best, back, state = np.zeros(len(unit) + 1), np.zeros(len(unit) + 1, np.uint16), 0
        for at, b in enumerate(unit, 1):
            state = step[state, b]
            score, via, found = best[at - 1] + self.byte_score, self.byte[b], first[state]
            while found:
                if (total := best[at - self.size[self.piece[found]]] + self.score[found]) > score:
                    score, via = total, self.piece[found]
                found = link[found]
            best[at], back[at] = score, via
        return self._trace(np.array([len(unit)]), np.zeros(1, np.int64), back)[0]

    def learn(self, units: list[str]) -> None:
        """Remember the segmentation of units not known yet."""
        coded = [u.encode() for u in units]
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        order = np.argsort(-n, kind="stable").tolist()
        sizes = np.concatenate(([0], np.cumsum(n[order])))
        i = int((n > _LONG).sum())
        self.known.update((units[k], self.single(coded[k])) for k in order[:i])
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + _GROUP)))
            done = self.group([coded[k] for k in order[i:j]])
            self.known.update(zip(map(units.__getitem__, order[i:j]), done, strict=True))
            i = j

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; one space is put before it. An empty text has none."""
        units = [_UNITS.findall(" " + t) if t else [] for t in texts]
        distinct = {u for x in units for u in x}
        fresh = distinct - self.known.keys()
        if len(self.known) + len(fresh) > _MEMORY:
            self.known.clear()
            fresh = distinct
        self.learn(list(fresh))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, x)), "<u2") for x in units]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text again, without the space put before it; a byte stands for itself. Ids that are
        no encoding of a text may give broken characters, which are replaced."""
        return b"".join(map(self.text.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_pieces(df: DataFrame, text_col: str = "text", out: str = "pieces", vocabulary: str | None = None) -> DataFrame:
    """Add the ids of each text as an array of int. Null gives null, an empty text no ids; all rows
    and columns stay, but for one of the new name. Line ends and characters in no piece are coded
    as bytes."""
    path = vocabulary or public_vocabulary()

    def run(arrays: list[pa.Array]) -> list[pa.Array]:
        c = codec(path)
        texts = arrays[0].to_pylist()
        rows = [None if t is None else x.astype(np.int32) for t, x in zip(texts, c.encode_all([t or "" for t in texts]), strict=True)]
        return [pa.array(rows, pa.list_(pa.int32()))]

    return add_columns(df, [text_col], f"{out} array<int>", run)


def decode_pieces(df: DataFrame, pieces_col: str = "pieces", out: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Add the text of each array of ids; the inverse of encode_pieces. Null gives null."""
    path = vocabulary or public_vocabulary()

    def run(arrays: list[pa.Array]) -> list[pa.Array]:
        c = codec(path)
        return [pa.array([None if x is None else c.decode(np.array(x, np.int64)) for x in arrays[0].to_pylist()], pa.string())]

    return add_columns(df, [pieces_col], f"{out} string", run, None)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, a crc32 of their ids, and whether decoding gives the text back."""
    path = public_vocabulary()

    def run(arrays: list[pa.Array]) -> list[pa.Array]:
        c = codec(path)
        n, crc, same = [], [], []
        texts = [t or "" for t in arrays[0].to_pylist()]
        for t, ids in zip(texts, c.encode_all(texts), strict=True):
            n.append(len(ids))
            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            same.append(c.decode(ids) == t)
        return [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = add_columns(docs, ["text"], "n_pieces bigint; ids_crc32 bigint; round_trip boolean", run)
    return out.select("doc_id", "n_pieces", "ids_crc32", "round_trip")
