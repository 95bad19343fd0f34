"""Texts of Arrow batches as numpy arrays: words, word hashes and windows of many documents at once.

A batch is cut into blocks of whole texts, about ``BLOCK_BYTES`` each, so memory follows the longest text, not the batch.
Words are ``[^\\x20\\x09-\\x0D]+``. All of it works on UTF-8 bytes; no byte of a longer code point is white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least ``n`` places."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length() if n > 1 else 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))))
                      for b in (_BASE, _BACK)]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """Whole texts of one block: ``data`` holds their bytes, text i is ``data[offsets[i]:offsets[i + 1]]``;
    ``rows`` are their places in the batch."""

    data: np.ndarray
    offsets: np.ndarray
    rows: slice

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array) -> Iterator[Block]:
    """Cut a column into blocks of whole texts."""
    data, offsets = text_bytes(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1)
        last = min(last, n)
        yield Block(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], slice(first, last))
        first = last


@dataclass
class Spans:
    """Pieces of the texts of a block: ``starts``/``ends`` in bytes; text i has pieces ``of[i]`` to ``of[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def words(block: Block) -> Spans:
    """Words of all texts of a block."""
    inside = IS_WORD[block.data]
    if not len(inside):
        return Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(block) + 1, np.int64))
    cut = block.offsets[:-1][np.diff(block.offsets) > 0]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last[:-1] &= ~inside[1:]
    stop = block.offsets[1:][np.diff(block.offsets) > 0] - 1
    last[stop] = inside[stop]
    starts = np.flatnonzero(first)
    return Spans(starts, np.flatnonzero(last) + 1, np.searchsorted(starts, block.offsets))


def lines(block: Block) -> Spans:
    """Lines of all texts, split at line feeds; a text of no bytes is one empty line."""
    feeds = np.flatnonzero(block.data == 10)
    doc = np.searchsorted(block.offsets, feeds, side="right") - 1
    starts = np.concatenate((block.offsets[:-1], feeds + 1))
    ends = np.concatenate((block.offsets[1:], feeds))
    of_doc = np.concatenate((np.arange(len(block)), doc))
    order = np.lexsort((starts, of_doc))
    of = np.concatenate(([0], np.cumsum(np.bincount(of_doc, minlength=len(block)))))
    starts = starts[order]
    ends = np.append(starts[1:] - 1, 0)
    ends[of[1:] - 1] = block.offsets[1:]
    return Spans(starts, ends, of)


def span_hashes(data: np.ndarray, spans: Spans) -> np.ndarray:
    """A 64-bit hash of the bytes of every span."""
    power, back = _power_tables(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[:len(data)])))
    raw = (total[spans.ends] - total[spans.starts]) * back[spans.starts]
    return mix(raw + (spans.ends - spans.starts).astype(np.uint64))


def windows(hashes: np.ndarray, of: np.ndarray, width: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` consecutive words that lie in one text, and their first words' places."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, by = mix(hashes + np.uint64(seed)), np.uint64((0xD6E8FEB86659FD93 * (2 * seed + 1) | 1) & (2**64 - 1))
    acc = h[:n].copy()
    for j in range(1, width):
        acc *= by
        acc += h[j:j + n]
    left = np.repeat(of[1:], np.diff(of))[:n] - np.arange(n)  # words from here to the end of the text
    places = np.flatnonzero(left >= width)
    return mix(acc[places]), places


def covered(places: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``width`` words that starts at one of ``places``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, places, 1)
    np.subtract.at(steps, np.minimum(places + width, n), 1)
    return np.cumsum(steps[:n]) > 0


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
