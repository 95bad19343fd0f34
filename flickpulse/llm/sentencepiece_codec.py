"""SentencePiece encoding and decoding with the tokenizers library as backend.

``read_model`` parses the model file's protobuf. ``backend`` rebuilds it for the tokenizers library: normaliser (character
map, white-space rules, the metaspace marker and dummy prefix), unigram scores or, for BPE models, merges in the order of
the scores, and byte fallback. Batches are encoded multithreaded. Where the model provably can't join text over the start
of a run of spaces or over a line feed (no piece does, and nothing is normalised), texts are cut there and each distinct
segment is encoded once per task; else texts are encoded whole. Tests hold both ways against the sentencepiece library.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flickpulse.llm import batches as B
from flickpulse.llm.frames import extended, map_batches, without

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
SEGMENTS_KEPT, DECODED_ROWS = 200_000, 128


@dataclass
class Model:
    """What of a model file matters for encoding: pieces with scores and types, and the normaliser's settings."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    unk_surface: str = " ⁇ "

    @property
    def unk_id(self) -> int:
        return self.types.index(UNKNOWN)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            value = data[i:i + size]
            i += size
        yield tag >> 3, value


def read_model(data: bytes) -> Model:
    """Parse a serialized model."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            m.pieces.append(piece.get(1, b"").decode())
            m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            m.types.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(_fields(value))
            m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            m.unk_surface = spec[44].decode() if 44 in spec else m.unk_surface
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.squeeze_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, in the order in which the scores apply them."""
    rank = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types)) if t in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, i in rank.items():
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in rank and b in rank:
                found.append((-m.scores[i], rank[a], rank[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def backend(m: Model, prefix: bool = True):
    """The model as a tokenizers-library tokenizer; without ``prefix``, for segments that have their spaces."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    hidden = [p if t in (NORMAL, USER_DEFINED, BYTE, UNKNOWN) else f"﷐{i}﷐"
              for i, (p, t) in enumerate(zip(m.pieces, m.types))]  # text never makes control or unused pieces
    if m.kind == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram(list(zip(hidden, m.scores)), m.unk_id, m.byte_fallback))
    else:
        tokenizer = Tokenizer(models.BPE({p: i for i, p in enumerate(hidden)}, _merges(m), unk_token=m.pieces[m.unk_id],
                                         fuse_unk=True, byte_fallback=m.byte_fallback))
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if prefix and m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    own = [AddedToken(p, normalized=False, special=False) for p, t in zip(m.pieces, m.types) if t == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    strip = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return tokenizer


def _cuttable(m: Model) -> bool:
    """Whether the model works on each run of spaces with what follows it, and on each line feed, apart."""
    crossing = any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in m.pieces)
    return not (m.charsmap or m.squeeze_spaces or crossing or USER_DEFINED in m.types)


class Encoder:
    """Ids of the texts of blocks; distinct segments are remembered, ``SEGMENTS_KEPT`` of them at most."""

    def __init__(self, model: Model):
        self.model, self.cuttable = model, _cuttable(model)
        self.whole = backend(model)
        self.apart = backend(model, prefix=False) if self.cuttable else None
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    @staticmethod
    def _flat(encodings: list) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in encodings]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size

    def encode(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and where each text's ids start and end."""
        if self.cuttable and not _holds(block.data, MARK.encode()):
            return self._by_segments(block)
        texts = [block.text(i).decode("utf-8", "replace") for i in range(len(block))]
        flat, size = self._flat(self.whole.encode_batch_fast(texts, add_special_tokens=False))
        return flat, np.concatenate(([0], np.cumsum(size)))

    def _by_segments(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(block.offsets)
        extra = (sizes > 0) & self.model.dummy_prefix
        data = np.insert(block.data, block.offsets[:-1][extra], 0x20)
        offsets = block.offsets + np.concatenate(([0], np.cumsum(extra)))
        first = np.zeros(len(data) + 1, bool)
        space, feed = data == 0x20, data == 0x0A
        first[:-1] = space | feed
        first[1:-1] &= ~(space[1:] & space[:-1])
        first[1:] |= feed
        first[offsets[:-1][sizes > 0]] = True
        starts = np.flatnonzero(first[:-1])
        spans = B.Spans(starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets))
        h = B.span_hashes(data, spans)
        unique, where, of = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > SEGMENTS_KEPT:
            self._forget()
        new = ~np.isin(unique, self.known, assume_unique=True)
        if new.any():
            texts = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(spans.starts[where[new]], spans.ends[where[new]])]
            flat, size = self._flat(self.apart.encode_batch_fast(texts, add_special_tokens=False))
            known = np.concatenate((self.known, unique[new]))
            order = np.argsort(known, kind="stable")
            self.at = np.concatenate((self.at, np.cumsum(size) - size + len(self.ids)))[order]
            self.size, self.known = np.concatenate((self.size, size))[order], known[order]
            self.ids = np.concatenate((self.ids, flat))
        if not len(h):
            return self.ids[:0], np.zeros(len(block) + 1, np.int64)
        place = np.searchsorted(self.known, unique)[of]
        size = self.size[place]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.at[place] - (ends - size), size) + np.arange(int(size.sum()))]
        return flat, np.concatenate(([0], ends))[spans.of]


def _holds(data: np.ndarray, sequence: bytes) -> bool:
    n = len(data) - len(sequence) + 1
    return n > 0 and bool(np.logical_and.reduce([data[j:j + n] == b for j, b in enumerate(sequence)]).any())


class Decoder:
    """Texts of id sequences: pieces' bytes side by side, the marker as a space, byte pieces as their byte."""

    def __init__(self, m: Model):
        parts = []
        for piece, kind in zip(m.pieces, m.types):
            if kind == BYTE:
                parts.append(bytes([int(piece[3:5], 16)]))
            elif kind == UNKNOWN:
                parts.append(m.unk_surface.encode())
            else:
                parts.append(b"" if kind == CONTROL else piece.replace(MARK, " ").encode())
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.prefix = m.dummy_prefix

    def decode(self, flat: np.ndarray, bounds: np.ndarray) -> list[str]:
        """One text per part of ``flat`` between ``bounds``; bytes that are no UTF-8 become replacement characters."""
        size = self.size[flat]
        ends = np.cumsum(size)
        data = self.bytes[np.repeat(self.start[flat] - (ends - size), size) + np.arange(int(size.sum()))].tobytes()
        cuts = np.concatenate(([0], ends))[bounds]
        out = [data[s:e].decode("utf-8", "replace") for s, e in zip(cuts[:-1], cuts[1:])]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in out]


@lru_cache(maxsize=2)
def _made(kind: type, model: bytes):
    """One encoder or decoder per Python worker, used by its tasks one after another."""
    return kind(read_model(model))


def encode(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``ids_`` (array of int).

    Defined cases: null and empty texts have no ids; no other column is read, so null ids and repeated rows are no cases
    of their own; columns named ``ids_`` or ``text_`` are replaced. An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        encoder = _made(Encoder, model)
        for batch in batches:
            own = [i for i, n in enumerate(batch.schema.names) if n != "text_"]
            for block in B.blocks(batch.column("text_")):
                flat, bounds = encoder.encode(block)
                part = batch.slice(block.rows.start, len(block))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in own] + [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))],
                    names=[batch.schema.names[i] for i in own] + ["ids_"])

    docs = without(docs, "ids_ text_")
    return map_batches(docs.withColumn("text_", F.coalesce(F.col(text_col), F.lit(""))), run, extended(docs, "ids_ array<int>"))


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids_") -> DataFrame:
    """All rows and columns of ``rows`` with ``decoded_``; null or empty ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _made(Decoder, model)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            for start in range(0, len(batch), DECODED_ROWS):  # a few rows at a time: their bytes are indexed one by one
                part = ids.slice(start, DECODED_ROWS)
                sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = decoder.decode(part.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))))
                piece = batch.slice(start, DECODED_ROWS)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())],
                                                 names=[*batch.schema.names, "decoded_"])

    rows = without(rows, "decoded_")
    return map_batches(rows, run, extended(rows, "decoded_ string"))
