"""Substring dedup: words that repeat a passage of an earlier document are found through difference-cover anchors.

A passage of ``WINDOW`` = 13 words is repeated when the same word sequence starts in a document of smaller id. Hashing all
windows of all documents would shuffle a row per word. With the difference cover {0, 1, 3} modulo 7, any two places i, j
have a shift d < 7 with (i + d) mod 7 and (j + d) mod 7 both in the cover, so two equal windows of 13 words always hold
equal *anchors*: windows of 7 words that start, at the same shift, at a cover place of both documents. Only anchors
(3 of 7 places) are hashed and shuffled first; only windows around an anchor that a second document has are then
compared in full, by 128-bit hashes.

Hot passages. An anchor hash that several documents of one task share is settled inside that task and passed on with two of
them (two, as a row of another task may repeat the id of one). A hash that one document holds alone is passed on with all
its places, since each of them is marked if another task has the hash. So what meets for one hash is bounded by the number
of tasks times the places in the rows of one id, not by the number of documents. Hashes travel packed, by ranges of their
value; the number of ranges follows the counted words, so a range has about ``RANGE_ENTRIES`` entries at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flickpulse.llm import batches as B
from flickpulse.llm.frames import extended, map_batches, own, without
from flickpulse.operators.scale import stage

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
RANGE_ENTRIES = 500_000
FLUSH_ENTRIES = 1_000_000

_FOUND = "range_ int, group_ int, hashes binary, tails binary, docs binary, prints binary, places binary"
_HITS = "group_ int, docs binary, prints binary, places binary"


def _cut(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every number in ``part`` with the places that have it."""
    order = np.argsort(part, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)]))
    for s, e in zip(cuts[:-1], cuts[1:]):
        if s < e:
            yield int(part[order[s]]), order[s:e]


def _share(h: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges a hash lies in."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _pack(ranges: int, h: np.ndarray, tail: np.ndarray | None, doc: np.ndarray, fp: np.ndarray,
          place: np.ndarray) -> pa.RecordBatch:
    """Entries as one row per range of hash values; ``tail`` are the further hash bits of windows."""
    rows = [(part, None, h[at].tobytes(), b"" if tail is None else tail[at].tobytes(), doc[at].tobytes(),
             fp[at].tobytes(), place[at].astype(np.int32).tobytes()) for part, at in _cut(_share(h, ranges))]
    return _batch(rows)


def _hits(ranges: int, doc: np.ndarray, fp: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Places that were hit, as one row per group of documents."""
    groups = _share(B.mix(doc.astype(np.uint64)), ranges)
    return _batch([(group, group, None, None, doc[at].tobytes(), fp[at].tobytes(), place[at].astype(np.int32).tobytes())
                   for group, at in _cut(groups)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _settle(h: np.ndarray, tail: np.ndarray | None, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have a hash that another document has too, and which are of the smallest document of their hash."""
    keys = (h,) if tail is None else (h, tail)
    order = np.lexsort((doc, *keys[::-1]))
    new = np.zeros(len(h), bool)
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    group, sorted_doc = np.cumsum(new), doc[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), new[1:])))
    last = np.append(first[1:], len(h)) - 1
    shared, least = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h):
        shared[order] = (sorted_doc[first] != sorted_doc[last])[group]
        least[order] = sorted_doc == sorted_doc[first][group]
    return shared, least


class _Collector:
    """Gathers hashed places of a task; settles and packs them whenever ``FLUSH_ENTRIES`` have come together."""

    def __init__(self, ranges: int, pick_least: bool):
        self.ranges, self.pick_least, self.parts, self.n = ranges, pick_least, [], 0

    def add(self, *arrays: np.ndarray | None) -> bool:
        self.parts.append(arrays)
        self.n += len(arrays[0])
        return self.n >= FLUSH_ENTRIES

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h, tail, doc, fp, place = (None if x[0] is None else np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.n = [], 0
        shared, least = _settle(h, tail, doc)
        # settled here: every document of a shared hash (anchors), or all but the smallest one (windows)
        known = shared & ~least if self.pick_least else shared
        if known.any():
            yield _hits(self.ranges, doc[known], fp[known], place[known])
        go = least
        if not self.pick_least:  # all places of a lone document, as none is marked yet; else two documents stand for the hash
            go = ~shared
            for side in (np.flatnonzero(shared & least), np.flatnonzero(shared & ~least)):
                go[side[np.unique(h[side], return_index=True)[1]]] = True
        yield _pack(self.ranges, h[go], None if tail is None else tail[go], doc[go], fp[go], place[go])


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _anchors(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Collector(ranges, False)
        for batch in batches:
            ids, fps = _numbers(batch, "doc_"), _numbers(batch, "print_")
            for block in B.blocks(batch.column("text_")):
                w = B.words(block)
                h, at = B.windows(B.span_hashes(block.data, w), w.of, ANCHOR, seed=3)
                doc = w.doc()[at]
                place = at - w.of[doc]
                is_cover = np.isin(place % PERIOD, COVER)
                doc, place = doc[is_cover] + block.rows.start, place[is_cover]
                if kept.add(h[is_cover], None, ids[doc], fps[doc], place):
                    yield from kept.flush()
        yield from kept.flush()
    return run


def _windows(ranges: int):
    """Windows of 13 words around the given anchors, as 128-bit hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Collector(ranges, True)
        for batch in batches:
            ids, fps, near = _numbers(batch, "doc_"), _numbers(batch, "print_"), batch.column("near")
            for block in B.blocks(batch.column("text_")):
                w = B.words(block)
                hashes = B.span_hashes(block.data, w)
                h, at = B.windows(hashes, w.of, WINDOW, seed=5)
                tail, _ = B.windows(hashes, w.of, WINDOW, seed=6)
                marked = np.zeros(len(hashes) + 1, np.int64)
                for i in range(len(block)):
                    a = _places(near[block.rows.start + i]) + w.of[i]
                    np.add.at(marked, np.maximum(a - (PERIOD - 1), w.of[i]), 1)
                    np.subtract.at(marked, a + 1, 1)
                wanted = (np.cumsum(marked) > 0)[at]
                h, tail, at = h[wanted], tail[wanted], at[wanted]
                doc = w.doc()[at]
                place, doc = at - w.of[doc], doc + block.rows.start
                if kept.add(h, tail, ids[doc], fps[doc], place):
                    yield from kept.flush()
        yield from kept.flush()
    return run


def _places(value) -> np.ndarray:
    """Packed word places."""
    return np.frombuffer(value.as_py() or b"", np.int32).astype(np.int64)


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)


def _meet(ranges: int, pick_least: bool):
    """Entries of one range of hashes that another document has as well, or has with a smaller id; hits pass through."""
    def run(table: pa.Table) -> pa.Table:
        is_hit = pc.is_valid(table.column("group_"))
        entries, names = table.filter(pc.invert(is_hit)), ["group_", "docs", "prints", "places"]
        h, doc, fp, place = (_column(entries, n, t) for n, t in (("hashes", np.uint64), ("docs", np.int64),
                                                                 ("prints", np.int64), ("places", np.int32)))
        shared, least = _settle(h, _column(entries, "tails", np.uint64) if pick_least else None, doc)
        known = shared & ~least if pick_least else shared
        met = _hits(ranges, doc[known], fp[known], place[known])
        return pa.concat_tables([pa.Table.from_batches([met]).select(names), table.filter(is_hit).select(names)])
    return run


def _gather(table: pa.Table) -> pa.Table:
    """All hits of a group of documents, one row per document."""
    doc, fp, place = (_column(table, n, t) for n, t in (("docs", np.int64), ("prints", np.int64), ("places", np.int32)))
    order = np.lexsort((place, fp, doc))
    doc, fp, place = doc[order], fp[order], place[order]
    new = (np.diff(doc) != 0) | (np.diff(fp) != 0)
    cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [len(doc)]))
    return pa.table({"doc_": pa.array(doc[cuts[:-1]]), "print_": pa.array(fp[cuts[:-1]]),
                     "near": B.binary([np.unique(place[s:e]).tobytes() for s, e in zip(cuts[:-1], cuts[1:])])})


def _matched(found: DataFrame, ranges: int, pick_least: bool) -> DataFrame:
    """Per document, the packed places of its hits, settled inside tasks or across them."""
    return (found.groupBy("range_").applyInArrow(_meet(ranges, pick_least), _HITS)
            .groupBy("group_").applyInArrow(_gather, "doc_ long, print_ long, near binary"))


def _ranges(entries: float) -> int:
    return max(1, int(entries // RANGE_ENTRIES) + 1)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of every text, and its words without those in repeated windows."""
    for batch in batches:
        near = batch.column("near")
        kept_text, n_words, n_removed = [], [], []
        for block in B.blocks(batch.column("text_")):
            w = B.words(block)
            for i in range(len(block)):
                s, e = w.starts[w.of[i]:w.of[i + 1]], w.ends[w.of[i]:w.of[i + 1]]
                hit = near[block.rows.start + i]
                gone = B.covered(_places(hit), WINDOW, len(s)) if hit.is_valid else np.zeros(len(s), bool)
                kept_text.append(_joined(block.data, s, e, gone))
                n_words.append(len(s))
                n_removed.append(int(gone.sum()))
        drop = [batch.schema.get_field_index(n) for n in ("doc_", "print_", "text_", "near")]
        own = [i for i in range(batch.num_columns) if i not in drop]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in own] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept_text, pa.string())],
            names=[batch.schema.names[i] for i in own] + ["n_words_", "n_removed_", "kept_text_"])


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> str:
    """Kept words with one space between them."""
    keep = np.flatnonzero(~gone)
    if not len(keep):
        return ""
    s, e = starts[keep], ends[keep]
    size = e - s + 1
    total = int(size.sum())
    begin = np.cumsum(size) - size
    source = np.arange(total) - np.repeat(begin - s, size)
    out = data[np.minimum(source, len(data) - 1)]
    out[begin + size - 1] = 0x20
    return out[:-1].tobytes().decode("utf-8", "replace")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with ``n_words_``, ``n_removed_`` and ``kept_text_``.

    A word goes if a window of 13 words that covers it also starts in a document with a smaller id, judged on the input;
    the other words are joined by one space. Defined cases: null text counts as empty (0 words, empty kept text). A row
    with null id is left whole and takes nothing from others. Rows that repeat an id take nothing from each other.
    Further columns are kept, but replaced where they have the name of a result or are named ``doc_ print_ text_ near``. An
    empty table gives an empty result.
    """
    docs = without(docs, "n_words_ n_removed_ kept_text_ doc_ print_ text_ near")
    keyed = docs.withColumns({"doc_": F.col(id_col).cast("long"), "print_": F.xxhash64(text_col),
                              "text_": F.coalesce(F.col(text_col), F.lit(""))})
    slim = keyed.select("doc_", "print_", "text_").filter("doc_ is not null")
    chars = slim.agg(F.sum(F.octet_length("text_"))).first()[0] or 0
    ranges = _ranges(chars / 6 * len(COVER) / PERIOD)
    anchors = stage(_matched(slim.mapInArrow(_anchors(ranges), _FOUND), ranges, False))
    near = slim.join(anchors, ["doc_", "print_"])
    hits = stage(_matched(near.mapInArrow(_windows(ranges), _FOUND), ranges, True))
    schema = extended(docs, "n_words_ long, n_removed_ long, kept_text_ string")
    marked = keyed.join(hits, ["doc_", "print_"], "left").select(*own(docs), "doc_", "print_", "text_", "near")
    return map_batches(marked, _spans, schema)
