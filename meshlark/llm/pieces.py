"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once; at each end position its output links give all pieces that end there, and each relaxes
the best score of a segmentation up to that position.  On equal scores the longest last piece wins.  A character that is
no piece costs more than any piece and becomes the pieces of its bytes, so decoding gives every text back exactly.

Spaces become U+2581 with one more ahead of a text, as the model asks for.  No piece has U+2581 behind another character,
so the text falls into units (runs of U+2581 and what follows them) whose best segmentations are independent; a bounded
memory of units saves repeated work and changes no result.

Cases: null and empty texts have no pieces.  A literal U+2581 is encoded by its bytes.  Very long texts are encoded in
runs of units.  Repeated rows are encoded each; columns that clash with outputs are replaced; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meshlark.llm._common import portions, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
#: How much worse than the lowest score a character outside the pieces is.
UNKNOWN_COST = 10.0
#: Units remembered by a worker, and the longest of them.
REMEMBERED, LONGEST = 250_000, 48


@dataclass
class Vocabulary:
    """Pieces, scores and kinds (normal, byte, other) by id: of a fixed size, so it can be sent to every worker."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    dummy_prefix: bool = True
    skip: set[int] = field(default_factory=set)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        byte_ids = [-1] * 256
        skip = set()
        for i in range(n):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
                skip.add(i)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                skip.add(i)
        if min(byte_ids) < 0:
            raise ValueError("a model without all 256 byte pieces can't give every text back")
        return cls([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], byte_ids, bool(model.normalize("a").startswith(META)), skip)


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        usable = [(p, i) for i, p in enumerate(v.pieces) if i not in v.skip and p]
        for piece, i in usable:
            self.automaton.add_word(piece, (len(piece), i, v.scores[i]))
        self.automaton.make_automaton()
        self.single = {p for p, _ in usable if len(p) == 1}
        self.unknown = min(s for i, s in enumerate(v.scores) if i not in v.skip) - UNKNOWN_COST
        if any(META in p.lstrip(META) for p, _ in usable):
            raise ValueError("a piece has U+2581 behind another character")
        apart = {c for c in "\n\t\r" if not any(c in p for p, _ in usable)}
        odd = re.escape("".join(sorted(apart)))
        self.units = re.compile(f"{META}*[^{META}{odd}]+|{META}+" + (f"|[{odd}]" if odd else "")).findall
        self.bytes = [p.replace(META, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            self.bytes[i] = bytes([b])
        self.literal = [v.byte_ids[b] for b in META.encode()]
        self.memory: dict[str, tuple[int, ...]] = {}

    def viterbi(self, unit: str) -> list[int]:
        """Ids of the best segmentation of a unit; -1 for a character outside the pieces."""
        n, single, unknown = len(unit), self.single, self.unknown
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        came: list = [None] * (n + 1)
        closed = 0  # positions up to here have their final score
        for end, (length, i, score) in self.automaton.iter(unit):
            while closed < end:  # no more pieces end at closed + 1
                if unit[closed] not in single and best[closed] + unknown > best[closed + 1]:
                    best[closed + 1], came[closed + 1] = best[closed] + unknown, (1, -1)
                closed += 1
            end += 1
            score += best[end - length]
            if score > best[end]:  # longer pieces come first
                best[end], came[end] = score, (length, i)
        while closed < n:
            if unit[closed] not in single and best[closed] + unknown > best[closed + 1]:
                best[closed + 1], came[closed + 1] = best[closed] + unknown, (1, -1)
            closed += 1
        out = []
        while n:
            length, i = came[n]
            out.append(i)
            n -= length
        return out[::-1]

    def unit_ids(self, unit: str) -> tuple[int, ...]:
        found = self.memory.get(unit)
        if found is None:
            found = self.viterbi(unit)
            if -1 in found:
                at, ids = 0, []
                for i in found:
                    ids += [i] if i >= 0 else [self.vocabulary.byte_ids[b] for b in unit[at].encode()]
                    at += len(self.vocabulary.pieces[i]) if i >= 0 else 1
                found = ids
            found = tuple(found)
            if len(unit) <= LONGEST:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[unit] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        parts = []
        for k, piece in enumerate(text.split(META)):  # a literal U+2581 stands between two pieces of the text
            if k:
                parts.append(np.array(self.literal, np.int32))
            lead = META if self.vocabulary.dummy_prefix and not k else ""
            units = self.units(lead + piece.replace(" ", META))
            for at in range(0, len(units), 1 << 16):
                parts.append(np.fromiter(chain.from_iterable(map(self.unit_ids, units[at : at + (1 << 16)])), np.int32))
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw[1 if self.vocabulary.dummy_prefix and len(ids) else 0 :].decode()


_CODECS: dict[int, Codec] = {}


def codec(vocabulary: Vocabulary) -> Codec:
    """A worker's codec of this vocabulary, made once."""
    mark = hash((tuple(vocabulary.pieces), tuple(vocabulary.scores)))
    if mark not in _CODECS:
        _CODECS.clear()
        _CODECS[mark] = Codec(vocabulary)
    return _CODECS[mark]


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, n_pieces, n_byte_pieces, round_trip); round_trip: decoding the ids gave the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        is_byte = np.zeros(len(own.bytes), bool)
        is_byte[own.vocabulary.byte_ids] = True
        for batch in batches:
            for part in portions(batch, 1):
                texts = part.column(1).to_pylist()
                ids = [own.encode(t) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                        pa.array([own.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]),
                    ],
                    [key, "ids", "n_pieces", "n_byte_pieces", "round_trip"],
                )

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>, n_pieces long, n_byte_pieces long, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """(key, text) of rows (key, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(encoded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            texts = [None if x is None else own.decode(np.asarray(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), Vocabulary.load())


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLES: dict[str, str] = {}
