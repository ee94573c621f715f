"""SentencePiece encoding and decoding as shortest paths of a weighted transducer.

``compile_model`` reads a SentencePiece model file and builds the transducer:

* the normaliser arcs (white space to U+2581, optional dummy prefix, optional
  collapsing of spaces; models with another character map are refused),
* a trie of the pieces, whose final states emit the piece id, and
* byte-fallback arcs, a character that is no piece emitting its bytes' ids.

A text is composed with it position by position, and the path of least weight
in the tropical semiring (weights add along a path, the least path wins) is its
encoding. For a unigram model a piece weighs minus its log-probability. A BPE
model has no additive weights: its merges decide. There the state remembers the
last piece, and an arc weighs zero if merging the two pieces' characters by the
model's priorities gives these two pieces back, and infinity otherwise; the one
path of finite weight is the merge result.

Pieces never run across some places (a space after another character, or a
character that is in no longer piece, such as a line end); the compiler finds
out which, every path passes a single state there, and the stretches between
them are solved separately and remembered, within a bound.

Defined results: null text gives null ids and null decoded text; the empty text
gives no ids; decoding turns byte sequences that are not UTF-8 into U+FFFD, one
for each byte that cannot be read, and raises for ids outside the model.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MAX_PIECES = 1 << 20
REMEMBERED = 400_000
PAIRS = 4_000_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Transducer:
    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    merges: bool            # BPE
    dummy_prefix: bool
    collapse: bool
    unknown: int
    trie: dict = field(default_factory=dict)
    byte_ids: list[int] = field(default_factory=list)
    cuts: str = ""

    def __post_init__(self):
        self.rank = {p: s for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True) if k == _NORMAL}
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == _NORMAL:
                node = self.trie
                for c in p:
                    node = node.setdefault(c, {})
                node[0] = i  # the key 0 marks a final state
        self.unknown_cost = 10.0 - min(self.rank.values(), default=0.0)  # the library's penalty
        by_name = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        if by_name:
            self.byte_ids = [by_name[f"<0x{b:02X}>"] for b in range(256)]
        longer = [p for p in self.rank if len(p) > 1]
        one_word = not any(SPACE in p.lstrip(SPACE) for p in longer)
        if self.byte_ids and one_word and not any("\n" in p for p in longer):
            self.cuts = f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"

    # --- encoding -------------------------------------------------------
    def normalise(self, text: str) -> str:
        if self.collapse:
            text = re.sub(" +", " ", text.strip(" "))
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", SPACE)

    def merges_of(self, piece: str) -> tuple[bool, list, list]:
        """The merges that build a piece out of its characters, best score first,
        then leftmost. Whether they end in the piece itself, and after each
        merge its score with the first, or the last, part of that moment."""
        parts = list(piece)
        first, last = [(0.0, parts[0])], [(0.0, parts[-1])]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return len(parts) == 1, first, last
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            first.append((best, parts[0]))
            last.append((best, parts[-1]))

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]


class Encoder:
    """A transducer with what it has worked out so far (bounded)."""

    def __init__(self, fst: Transducer):
        self.fst, self.allowed, self.built = fst, {}, {}
        self.split = re.compile(fst.cuts, re.S).findall if fst.cuts else lambda text: [text]
        self.lengths = list(map(len, fst.pieces))
        self.solved = _Solved(self.solve)

    def encode(self, text: str) -> bytes:
        """Ids of one text, as packed int32."""
        return b"".join(map(self.solved.__getitem__, self.split(self.fst.normalise(text))))

    def solve(self, text: str) -> bytes:
        """Ids on the shortest path over one stretch."""
        arc = self._by_merges(text) if self.fst.merges else self._by_weight(text)
        ids, i, size = [], len(text), len(self.fst.pieces)
        while i:
            piece = arc[i]
            if piece >= size:
                char = reversed(self.fst.fallback(chr(piece - size)))
                ids.extend(c for c in char if not (ids and c == ids[-1] == self.fst.unknown))  # unknown runs are one id
                i -= 1
            else:
                ids.append(piece)
                i -= self.lengths[piece]
        ids.reverse()
        return array("i", ids).tobytes()

    def _by_merges(self, text: str) -> list:
        """The piece that enters each state on the one path of weight zero (the
        number of pieces + code point for a character that is no piece)."""
        trie, allowed, size, n = self.fst.trie, self.allowed, len(self.fst.pieces), len(text)
        arc = [None] * (n + 1)
        last = -1
        for j in range(n):
            if j:
                last = arc[j]
                if last is None:
                    continue
            node = trie.get(text[j])
            if node is None or 0 not in node:
                if arc[j + 1] is None:
                    arc[j + 1] = size + ord(text[j])
                if node is None:
                    continue
            pair, i = (last + 1) * size, j + 1
            while True:
                piece = node.get(0)
                if piece is not None and arc[i] is None:
                    fits = allowed.get(pair + piece)
                    if fits is None:
                        if len(allowed) >= PAIRS:
                            allowed.clear()
                        fits = allowed[pair + piece] = self._fits(last, self.fst.pieces[piece])
                    if fits:
                        arc[i] = piece
                if i == n:
                    break
                node = node.get(text[i])
                if node is None:
                    break
                i += 1
        return arc

    def _by_weight(self, text: str) -> list:
        """The same for the path of least weight, minus the sum of the scores."""
        fst, size, n = self.fst, len(self.fst.pieces), len(text)
        cost, arc = [0.0] + [np.inf] * n, [None] * (n + 1)
        for j in range(n):
            node, i, lone = fst.trie.get(text[j]), j + 1, True
            while node is not None:
                piece = node.get(0)
                if piece is not None:
                    lone = lone and i > j + 1
                    if cost[j] - fst.scores[piece] < cost[i]:
                        cost[i], arc[i] = cost[j] - fst.scores[piece], piece
                node = node.get(text[i]) if i < n else None
                i += 1
            if lone and cost[j] + fst.unknown_cost < cost[j + 1]:
                cost[j + 1], arc[j + 1] = cost[j] + fst.unknown_cost, size + ord(text[j])
        return arc

    def _fits(self, last: int, piece: str) -> bool:
        """Do the merges of both pieces' characters together end in these two?
        The merges inside each are known; they alternate by score until one
        across the border would come first."""
        whole, first, _ = self._merges(piece)
        if last < 0 or not whole:
            return whole
        size = len(self.fst.pieces)
        _, _, ends = self._merges(self.fst.pieces[last] if last < size else chr(last - size))
        rank, i, j = self.fst.rank, 1, 1
        while True:
            left = ends[i][0] if i < len(ends) else None
            right = first[j][0] if j < len(first) else None
            across = rank.get(ends[i - 1][1] + first[j - 1][1])
            if across is not None and (left is None or across > left) and (right is None or across >= right):
                return False
            if left is None and right is None:
                return True
            if right is None or (left is not None and left >= right):
                i += 1
            else:
                j += 1

    def _merges(self, piece: str) -> tuple[bool, list, list]:
        known = self.built.get(piece)
        if known is None:
            known = self.built[piece] = self.fst.merges_of(piece)
        return known


class _Solved(dict):
    """Ids by stretch, in two generations: a full one becomes the old one, from
    which stretches that occur again are taken over."""

    def __init__(self, solve):
        super().__init__()
        self.solve, self.old = solve, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.pop(text, None) or self.solve(text)
        if len(text) <= 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Decoder:
    def __init__(self, fst: Transducer):
        self.fst = fst
        texts = {_NORMAL: lambda p: p.replace(SPACE, " ").encode(), _CONTROL: lambda p: b"",
                 _UNKNOWN: lambda p: " ⁇ ".encode(), _BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.controls = {i for i, k in enumerate(fst.kinds) if k == _CONTROL}
        self.bytes_of = [texts[k](p) for p, k in zip(fst.pieces, fst.kinds, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of packed ids. The space that the first piece of text begins
        with is the dummy prefix; bytes do not join across control pieces."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.bytes_of)):
            raise ValueError("an id is outside the model")
        ids, kinds, out = ids.tolist(), self.fst.kinds, []
        control = [i for i, k in enumerate(ids) if k in self.controls] if self.controls.intersection(ids) else []
        for a, b in zip([0, *(i + 1 for i in control)], [*control, len(ids)], strict=True):
            if a < b:
                raw = b"".join(map(self.bytes_of.__getitem__, ids[a:b]))
                if not out and self.fst.dummy_prefix and kinds[ids[a]] == _NORMAL and raw[:1] == b" ":
                    raw = raw[1:]
                out.append(_readable(raw))
        return "".join(out)


def _readable(raw: bytes) -> str:
    """UTF-8 text with U+FFFD for each byte that is not part of a character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def compile_model(path: str) -> Transducer:
    """Transducer of a SentencePiece model file (unigram or BPE)."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    spec, trainer = model.normalizer_spec, model.trainer_spec
    if spec.precompiled_charsmap or trainer.treat_whitespace_as_suffix or not spec.escape_whitespaces:
        raise ValueError("the model's normaliser is not supported")
    if trainer.model_type not in (1, 2):
        raise ValueError("unigram and BPE models are supported")
    kinds = [p.type for p in model.pieces]
    if len(kinds) > MAX_PIECES or {_USER, _UNUSED} & set(kinds):
        raise ValueError("the model's pieces are not supported")
    return Transducer([p.piece for p in model.pieces], kinds, [p.score for p in model.pieces], trainer.model_type == 2,
                      spec.add_dummy_prefix, spec.remove_extra_whitespaces, kinds.index(_UNKNOWN))


#: Encoders and decoders of this worker process, by the broadcast's number.
_HERE: dict[int, tuple[Encoder, Decoder]] = {}


def _apply(rows: DataFrame, fst: Transducer, encoding: bool, decoding: bool, column: str) -> DataFrame:
    """Map ``column`` (text, or ids); the other columns of ``rows`` pass through."""
    shared = rows.sparkSession.sparkContext.broadcast(fst)  # MAX_PIECES pieces at most
    number = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = _HERE.get(id(shared.value))
        if here is None:
            _HERE.clear()
            here = _HERE[id(shared.value)] = Encoder(shared.value), Decoder(shared.value)
        encoder, decoder = here
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                if encoding:
                    packed = [None if t is None else encoder.encode(t) for t in b.column(number).to_pylist()]
                else:
                    packed = [None if x is None else np.array(x, "<i4").tobytes() for x in b.column(number).to_pylist()]
                columns, names = list(b.columns), list(b.schema.names)
                if encoding:
                    cut = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in packed])]).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(x or b"" for x in packed), "<i4"))
                    nulls = np.array([x is None for x in packed])
                    ids = pa.ListArray.from_arrays(pa.array(cut), flat, mask=pa.array(nulls) if nulls.any() else None)
                    columns.append(ids)
                    names.append("ids")
                if decoding:
                    columns.append(pa.array([None if x is None else decoder.decode(np.frombuffer(x, "<i4")) for x in packed],
                                            pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInArrow(run, ", ".join([*ddl, *["ids array<int>"] * encoding, *["decoded string"] * decoding]))


def encode(docs: DataFrame, fst: Transducer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row."""
    return _apply(docs.select(F.col(key), F.col(text).alias("_text")), fst, True, False, "_text").drop("_text")


def decode(tokens: DataFrame, fst: Transducer, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of every row of ids."""
    return _apply(tokens.select(F.col(key), F.col(ids).alias("_ids")), fst, False, True, "_ids").drop("_ids")


def round_trip(docs: DataFrame, fst: Transducer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded, same): encoding, decoding, and whether the text came back."""
    out = _apply(docs.select(F.col(key), F.col(text).alias("_text")), fst, True, True, "_text")
    return out.select(key, "ids", "decoded", F.col("decoded").eqNullSafe(F.col("_text")).alias("same"))
