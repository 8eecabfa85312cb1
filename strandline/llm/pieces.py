"""SentencePiece encoding and decoding of whole texts with a given model.

An Aho-Corasick automaton over the pieces reads a text once; at each position its output
links name every piece that ends there, and each relaxes the best score of that position
(a Viterbi search for the segmentation with the greatest sum of piece scores). Characters
that no piece covers fall back to byte pieces, so decoding gives the text back exactly.

The search needs log probabilities, which unigram models hold. A BPE model holds ranks of merges: they
are turned into log probabilities by Zipf's law, and the ids are then those of the likeliest
segmentation, not those that the merges in order would give.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: What an uncovered character costs below the least score of a piece.
UNKNOWN = 10.0
#: The piece of rank r of a BPE model counts as having a probability in proportion to 1 / (r + ZIPF).
ZIPF = 100
#: Segments whose ids a worker remembers.
REMEMBERED = 250_000


class Pieces:
    """A model's pieces and scores with the automaton over them.

    Of equal totals, the one whose last piece is longest wins. A space mark in a text itself is
    encoded as bytes, since as a piece it stands for a space. With `prefix` the text gets one space
    in front, as the model's training texts had; decoding takes it off.
    """

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], normal: list[bool], prefix: bool = True):
        self.byte_ids, self.front = byte_ids, " " if prefix else ""
        self.automaton = ahocorasick.Automaton()
        usable = [(p, scores[i], i) for i, p in enumerate(pieces) if normal[i] and p]
        self.unknown = min((s for _, s, _ in usable), default=0.0) - UNKNOWN
        for p, s, i in usable:
            self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        # Where pieces hold space marks only as their first characters, and no line end, the
        # best segmentation of a text is that of its segments, one after the other.
        crossing = any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _, _ in usable)
        self.segment = re.compile(r"(?s).+" if crossing else r" *[^ \n]+| +|\n")
        self.raw = [p.replace(SPACE, " ").encode() for p in pieces]
        for value, i in enumerate(byte_ids):
            self.raw[i] = bytes([value])
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        """Reads a model of kind unigram or BPE with byte pieces; one whose normaliser rewrites texts is refused."""
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        with open(model_file, "rb") as file:
            model = ModelProto.FromString(file.read())
        kind, rules = model.trainer_spec.model_type, model.normalizer_spec
        if kind not in (model.trainer_spec.UNIGRAM, model.trainer_spec.BPE):
            raise ValueError("only unigram and BPE models have a segmentation to search for")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("the model's normaliser rewrites texts, so that pieces don't give them back")
        one = type(model.pieces[0])
        scores = [p.score if kind == model.trainer_spec.UNIGRAM else -math.log(max(0.0, -p.score) + ZIPF) for p in model.pieces]
        most = max(s for p, s in zip(model.pieces, scores) if p.type == one.NORMAL)
        # pieces that a user defined are to win over what else covers the same characters
        scores = [len(p.piece) * most - 0.1 if p.type == one.USER_DEFINED else s for p, s in zip(model.pieces, scores)]
        byte_ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == one.BYTE}
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte pieces for characters that it doesn't know")
        usable = [p.type in (one.NORMAL, one.USER_DEFINED) for p in model.pieces]
        return cls([p.piece for p in model.pieces], scores, [byte_ids[f"<0x{b:02X}>"] for b in range(256)], usable, rules.add_dummy_prefix)

    def best(self, segment: str) -> list[int]:
        """Ids of the best segmentation of one segment."""
        # a space mark of the text itself must not match a piece's
        marked = segment.replace(SPACE, "\0").replace(" ", SPACE)
        n, unknown = len(marked), self.unknown
        score, size, piece = [0.0] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
        done = 0  # positions up to here have a score
        for end, (length, gain, i) in self.automaton.iter(marked):
            end += 1
            while done < end:
                score[done + 1] = score[done] + unknown
                done += 1
            total = score[end - length] + gain
            if total > score[end]:
                score[end], size[end], piece[end] = total, length, i
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out += [self.byte_ids[b] for b in reversed(segment[n - 1].encode())]
            n -= size[n]
        out.reverse()
        return out

    def ids_of(self, segment: str) -> bytes:
        """The ids as 32-bit integers, from memory where the segment was met before."""
        found = self.known.get(segment)
        if found is None:
            found = array("i", self.best(segment)).tobytes()
            if len(self.known) < REMEMBERED and len(segment) <= 64:
                self.known[segment] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        ids_of, known = self.ids_of, self.known
        return np.frombuffer(b"".join([known.get(s) or ids_of(s) for s in self.segment.findall(self.front + text)]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()]).decode()[len(self.front) :]


_loaded: dict[str, Pieces] = {}


def pieces_of(model_file: str) -> Pieces:
    """One automaton for each Python worker and model."""
    if model_file not in _loaded:
        _loaded[model_file] = Pieces.load(model_file)
    return _loaded[model_file]


def encode_texts(df: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `ids` (the pieces of the whole text), `n_pieces` and `decoded` (the text got back from the ids).

    `model_file` is a path that every executor can read. A null text has null ids and stays null;
    an empty one has the single piece of the leading space. Repeated rows come out as often as they went in.
    A text is held whole by one worker, with about 20 bytes a character for the segment in hand, whatever its
    length. Columns of `keep` (default: all) that clash with a new one are replaced by it.
    """
    new = ("ids", "n_pieces", "decoded")
    keep = [c for c in (keep or df.columns) if c.lower() not in new]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(model_file)
        for whole in it:
            at = 0
            while at < whole.num_rows:  # about a million characters at once
                stop, seen = at, 0
                texts: list[str | None] = []
                while stop < whole.num_rows and seen < 1 << 20:
                    texts.append(whole.column(0)[stop].as_py())
                    seen += len(texts[-1] or "")
                    stop += 1
                found = [None if t is None else own.encode(t) for t in texts]
                sizes = [0 if f is None else len(f) for f in found]
                values = np.concatenate([f for f in found if f is not None] or [np.zeros(0, np.int32)])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                missing = pa.array([f is None for f in found], pa.bool_())
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=missing)
                counts = pa.array([None if f is None else len(f) for f in found], pa.int32())
                decoded = pa.array([None if f is None else own.decode(f) for f in found], pa.string())
                part = whole.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids, counts, decoded], names=[*keep, *new])
                at = stop

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>, n_pieces int, decoded string"])
    return df.select(F.col(text).alias("_text"), *keep).mapInArrow(batches, schema)
