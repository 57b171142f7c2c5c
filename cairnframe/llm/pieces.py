"""SentencePiece encoding and decoding as a weighted finite-state transducer.

`Transducer` compiles a SentencePiece model file into three parts, composed lazily with each input:

* the normaliser N rewrites characters by longest match (the model's precompiled character map), handles blanks and the dummy
  prefix, and writes blanks as U+2581;
* the piece transducer P is a trie of the vocabulary whose arcs write piece ids;
* the fallback B leads a character that is no piece of its own to its bytes' pieces, or to <unk>.

The result is the shortest path in the tropical semiring. In a unigram model an arc weighs minus its piece's score. In a BPE model the
weights lie on pairs: a BPE segmentation is the one path each of whose neighbours (a, b) are what merging makes of a + b, so a pair's
arc weighs 0 if it is and infinity if it isn't (and so for the first piece alone). The order in which merges happen within two
neighbours is their order within the whole, hence a path of finite weight is what merging makes of the whole, and there is only one.

Where no piece holds U+2581 after another character, no path crosses there, and the parts between are composed and
searched once each and remembered (in bounded memory).

Decoding goes the other way: pieces are read as bytes, U+2581 as a blank, and the dummy prefix is taken off; bytes that are not UTF-8
become U+FFFD.

Defined results: a null text has null ids and a null decoded text; an empty text has no ids; repeated rows are separate rows; other
columns are ignored. A U+2581 in a text is read as a blank, as the model format demands.
"""

from __future__ import annotations

import re
import struct
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import mapped, slices, unused

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
INFINITE = float("inf")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return value, i


def _message(b: bytes):
    """(field, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        else:
            n = {1: 8, 5: 4}.get(tag & 7)
            if n is None:
                n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Normaliser:
    """N: characters to characters."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.dummy_prefix, self.squeeze, self.mark = dummy_prefix, squeeze, MARK if escape else " "
        self.units, self.written = [], b""
        if charsmap:
            n = struct.unpack("<I", charsmap[:4])[0]
            self.units = struct.unpack(f"<{n // 4}I", charsmap[4 : 4 + n])
            self.written = charsmap[4 + n :]

    def _longest(self, b: bytes, i: int) -> tuple[int, int]:
        """Length and output position of the longest rule at b[i:], in the map's double array."""
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        at, best = offset(self.units[0]), (0, 0)
        for k in range(i, len(b)):
            at ^= b[k]
            unit = self.units[at] if at < len(self.units) else 0
            if unit & 0x800000FF != b[k]:
                break
            at ^= offset(unit)
            if unit >> 8 & 1:
                best = k + 1 - i, self.units[at] & 0x7FFFFFFF
        return best

    def __call__(self, text: str) -> str:
        if self.units:
            b, out, i = text.encode("utf-8", "replace"), [], 0
            while i < len(b):
                n, at = self._longest(b, i)
                if n:
                    out.append(self.written[at : self.written.index(b"\0", at)])
                else:
                    n = 1 + (b[i] >= 0xC0) + (b[i] >= 0xE0) + (b[i] >= 0xF0)
                    out.append(b[i : i + n])
                i += n
            text = b"".join(out).decode("utf-8", "replace")
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (" " + text if self.dummy_prefix else text).replace(" ", self.mark)


class Transducer:
    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for field, value in _message(model):
            if field == 1:
                piece = dict(_message(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_message(value))
            elif field == 3:
                normaliser = dict(_message(value))
        self.kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))
        if not self.kind or any(kind in (USER_DEFINED, UNUSED) for _, _, kind in self.pieces):
            raise ValueError("only unigram and BPE models without user-defined or unused pieces are supported")
        self.normalise = Normaliser(normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)))
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.score = {p: self.pieces[i][1] for p, i in self.ids.items()}
        self.unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE} if trainer.get(35) else {}
        self.unknown_cost = 10 - min(self.score.values(), default=0.0)
        self.trie: dict = {}
        for p in self.ids:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.part = self._parts()
        self.merged: dict[str, list[str]] = {}
        self.pairs: dict[tuple[str, str], float] = {}
        self.remembered: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        read = [b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        self.read = np.array(read, dtype=object)

    def _parts(self) -> re.Pattern:
        """Matches the parts between which no piece lies across: before U+2581, and where letters and marks meet, if so in this vocabulary."""
        inner = lambda x, y: any(re.search(f"[{x}][{y}]", p) for p in self.ids)
        if inner(f"^{MARK}", MARK):
            return re.compile("(?s).+")
        letters, marks = "A-Za-zÀ-ɏ", "".join(re.escape(c) for c in ",.;:!?\n%#*$&|" if not inner("A-Za-zÀ-ɏ", re.escape(c)) and not inner(re.escape(c), "A-Za-zÀ-ɏ"))
        if not marks:
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        # Letters and the free marks never share a piece, so a part is a run of either, or (with U+2581 before) of anything else.
        return re.compile(f"{MARK}*[{letters}]+(?=[{marks}{MARK}]|\\Z)|(?<=[{letters}])[{marks}]+(?=[{letters}])|{MARK}*[^{MARK}]+?(?=(?<=[{marks}])[{letters}]|(?<=[{letters}])[{marks}]|{MARK}|\\Z)|{MARK}+")

    def merge(self, text: str) -> list[str]:
        """What BPE makes of a short text: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def weight(self, before: str | None, piece: str) -> float:
        """Of the arc that writes `piece` after `before` (None: at the start)."""
        if self.kind == "unigram":
            return -self.score[piece] if piece in self.score else self.unknown_cost
        found = self.pairs.get((before, piece))
        if found is None:
            if len(self.pairs) > 250_000:
                self.pairs.clear()
            right = self.merge(piece) == [piece] if before is None else self.merge(before + piece) == [before, piece]
            self.pairs[before, piece] = found = 0.0 if right else INFINITE
        return found

    def arcs(self, text: str, i: int) -> list[str]:
        """What the composed transducer can write from position i, the shortest first."""
        out, node = [], self.trie
        if text[i] not in self.ids:
            out.append(text[i])
        for k in range(i, len(text)):
            node = node.get(text[k])
            if node is None:
                break
            if "" in node:
                out.append(node[""])
        return out

    def shortest(self, text: str) -> list[str]:
        """The pieces (or single unknown characters) of the shortest path over normalised text."""
        return self._cheapest(text) if self.kind == "unigram" else self._finite(text)

    def _cheapest(self, text: str) -> list[str]:
        n = len(text)
        cost, last = [0.0] + [INFINITE] * n, [""] * (n + 1)
        for i in range(n):
            for piece in self.arcs(text, i):
                j, total = i + len(piece), cost[i] + self.weight(last[i], piece)
                if total < cost[j]:
                    cost[j], last[j] = total, piece
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def _finite(self, text: str) -> list[str]:
        """At most one path of finite weight leads to each position, so none is expanded twice: depth first, long pieces first."""
        n, path, at = len(text), [], 0
        reached, open_arcs, known = {0}, [self.arcs(text, 0)] if text else [], self.pairs
        while at < n:
            if not open_arcs[-1]:
                open_arcs.pop()
                at -= len(path.pop())
                continue
            piece, before = open_arcs[-1].pop(), path[-1] if path else None
            if at + len(piece) in reached:
                continue
            weight = known.get((before, piece))
            if (self.weight(before, piece) if weight is None else weight) < INFINITE:
                path.append(piece)
                at += len(piece)
                reached.add(at)
                if at < n:
                    open_arcs.append(self.arcs(text, at))
        return path

    def written(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.byte:
                out += [self.byte[b] for b in p.encode("utf-8", "replace")]
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part in self.part.findall(self.normalise(text)):
            ids = self.remembered.get(part)
            if ids is None:
                ids = self.older.get(part)
                if ids is None:
                    ids = np.array(self.written(self.shortest(part)), np.int32).tobytes()
                if len(part) <= 64:
                    if len(self.remembered) >= 120_000:  # what was used since the last time stays
                        self.older, self.remembered = self.remembered, {}
                    self.remembered[part] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        b = b"".join(self.read[ids].tolist())
        return (b[1:] if self.normalise.dummy_prefix and b[:1] == b" " else b).decode("utf-8", "replace")


def compiled(model: bytes) -> Transducer:
    """The transducer of a model, compiled once for each Python worker."""
    kept = sys.__dict__.setdefault("_cairnframe_transducers", {})
    key = hash(model)
    if key not in kept:
        kept.clear()
        kept[key] = Transducer(model)
    return kept[key]


def encode(spark: SparkSession, docs: DataFrame, model: bytes, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` of docs (doc_id alone if None), n_pieces, ids and the text decoded from them, for every row of docs."""
    sent = spark.sparkContext.broadcast(model)
    keep = ["doc_id"] if keep is None else keep
    source = docs.select(*keep, docs[text].cast("string").alias(unused(docs, "encoded_text")))
    added = [unused(docs.select(*keep), n) for n in ("n_pieces", "ids", "decoded")]

    def run(batches):
        fst = compiled(sent.value)
        for b in slices(batches, text=b_text):
            ids = [None if t is None else fst.encode(t) for t in b.column(b.num_columns - 1).to_pylist()]
            lengths = [0 if x is None else len(x) for x in ids]
            flat = pa.array(np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)]), pa.int32())
            none = np.array([x is None for x in ids])
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.int32(), mask=np.append(none, False))
            decoded = pa.array([None if x is None else fst.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, flat), decoded], names=[*b.schema.names[:-1], *added])

    b_text = source.columns[-1]
    schema = source.select(*source.columns[:-1]).schema.add(added[0], T.LongType()).add(added[1], T.ArrayType(T.IntegerType())).add(added[2], T.StringType())
    return mapped(source, run, schema)
