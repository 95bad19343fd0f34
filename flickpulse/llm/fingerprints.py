"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs, the pieces between line feeds (empty ones count). Every paragraph is hashed to a wide
vector, and a text's fingerprint is the sum of its paragraphs' vectors:

* ``EQUAL`` lanes modulo 2**64 are the paragraph's SHAKE-128 output. Two texts have equal sums exactly when they hold the same
  paragraphs equally often, in whatever order (but for a collision of 2,048 bits).
* ``LIKE`` lanes modulo 2**32 are a count sketch of what the paragraph holds: each of its windows of ``WIDTH`` bytes, and of
  ``SHORT`` bytes in a paragraph of less than ``4 * WIDTH``, adds +1 or -1 to one lane. The cosine of two sums, their largest lanes cut, estimates how much of
  the texts is common, within about ``LIKE ** -0.5``, for texts of any length.

Sums need no order and can be undone, so paragraphs are inserted and deleted without the rest of the text (``updated`` for one
fingerprint, ``apply_edits`` for a table of them).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256, shake_128

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from flickpulse.llm import batches as B
from flickpulse.llm.frames import extended, map_batches, without

EQUAL, LIKE, WIDTH, SHORT = 32, 256, 8, 3
SIZE = EQUAL * 8 + LIKE * 4
SLICE = 1 << 20

_BYTE = B.mix(np.arange(1, 257, dtype=np.uint64))
_BY = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4)]


class Sums:
    """Vectors of some texts, one per row; they add and subtract modulo the powers of two."""

    def __init__(self, equal: np.ndarray, like: np.ndarray):
        self.equal, self.like = equal, like

    def __len__(self) -> int:
        return len(self.equal)

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.equal + other.equal, self.like + other.like)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.equal - other.equal, self.like - other.like)

    def __getitem__(self, rows) -> Sums:
        return Sums(self.equal[rows], self.like[rows])

    def packed(self) -> list[bytes]:
        both = np.concatenate((self.equal.view(np.uint8).reshape(len(self), -1), self.like.view(np.uint8).reshape(len(self), -1)), axis=1)
        return [row.tobytes() for row in both]


def unpacked(values: list[bytes]) -> Sums:
    raw = np.frombuffer(b"".join(values), np.uint8).reshape(-1, SIZE)
    return Sums(raw[:, :EQUAL * 8].copy().view(np.uint64), raw[:, EQUAL * 8:].copy().view(np.uint32))


def zeros(n: int) -> Sums:
    """The vectors of texts without any paragraph."""
    return Sums(np.zeros((n, EQUAL), np.uint64), np.zeros((n, LIKE), np.uint32))


def sums(texts: list[bytes | None]) -> Sums:
    """The vector of every text; None is a text without paragraphs, which is less than one empty paragraph."""
    out, rows = zeros(len(texts)), [i for i, t in enumerate(texts) if t is not None]
    if not rows:
        return out
    whole = B.Block(np.frombuffer(b"".join(texts[i] for i in rows), np.uint8),
                    np.concatenate(([0], np.cumsum([len(texts[i]) for i in rows]))), slice(0, len(rows)))
    pieces = B.lines(whole)
    data, view = whole.data, memoryview(whole.data)
    digests = [shake_128(view[s:e]).digest(EQUAL * 8) for s, e in zip(pieces.starts.tolist(), pieces.ends.tolist())]
    lanes = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, EQUAL)
    out.equal[rows] = np.add.reduceat(lanes, pieces.of[:-1], axis=0)

    length, doc = pieces.ends - pieces.starts, pieces.doc()
    counts = np.zeros(len(rows) * LIKE)

    def add(of: np.ndarray, h: np.ndarray) -> None:
        lane = of * LIKE + (h & np.uint64(LIKE - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64)
        counts[:] += np.bincount(lane, weights=sign, minlength=len(counts))

    tiny = (length > 0) & (length < SHORT)
    add(doc[tiny], B.mix(lanes[tiny, 0]))

    def begins(of: np.ndarray, width: int) -> np.ndarray:
        """Where windows of these paragraphs begin: +1 at the first one, -1 behind the last one, and the running sum."""
        of = of & (length >= width)
        steps = np.zeros(len(data) + 1, np.int8)
        steps[pieces.starts[of]] = 1
        steps[pieces.ends[of] - width + 1] -= 1
        return np.cumsum(steps[:-1], dtype=np.int8).view(bool)

    wide, narrow = begins(length >= WIDTH, WIDTH), begins(length < 4 * WIDTH, SHORT)
    for low in range(0, len(data), SLICE):
        h1 = _BYTE[data[low:low + SLICE + WIDTH - 1]]
        h2 = h1[:-1] * _BY[0] + h1[1:]
        h4 = h2[:-2] * _BY[1] + h2[2:]
        for begin, h in ((wide, h4[:-4] * _BY[2] + h4[4:]), (narrow, h2[:-1] * _BY[0] + h1[2:])):
            places = np.flatnonzero(begin[low:low + SLICE])
            add(np.searchsorted(whole.offsets, places + low, side="right") - 1, B.mix(h[places]))
    out.like[rows] = counts.astype(np.int64).astype(np.uint32).reshape(-1, LIKE)
    return out


def _even(of: Sums) -> np.ndarray:
    """Lanes as signed numbers, cut at twice the median size of those that are not 0: a line that a text repeats many times
    lies in a few large lanes and would outweigh all the rest."""
    x = of.like.view(np.int32).astype(np.float64)
    used = np.sort(np.where(x == 0, np.inf, np.abs(x)), axis=1)
    middle = np.maximum((x != 0).sum(1) - 1, 0) // 2
    top = 2 * used[np.arange(len(x)), middle]
    return np.clip(x, -top[:, None], top[:, None])


def likeness(a: Sums, b: Sums) -> np.ndarray:
    """0 to 1 for every pair of rows, and 1 for equal fingerprints only."""
    x, y = _even(a), _even(b)
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), size, out=np.zeros(len(x)), where=size > 0)
    same = (a.equal == b.equal).all(1) & (a.like == b.like).all(1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1 - 2.0 ** -20))


def updated(fingerprint: bytes, inserted: list[str] = (), deleted: list[str] = ()) -> bytes:
    """The fingerprint of a text after paragraphs came and went; the text itself is not needed."""
    now = unpacked([fingerprint])
    for paragraphs, new in ((inserted, True), (deleted, False)):
        if paragraphs:
            change = sums(["\n".join(paragraphs).encode()])
            now = now + change if new else now - change
    return now.packed()[0]


@F.pandas_udf(DoubleType())
def likeness_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two fingerprint columns; null where one is null."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if known.any():
        out[known] = likeness(unpacked(a[known].tolist()), unpacked(b[known].tolist()))
    return pd.Series(out).astype(object).where(known, None)


def _chunks(sizes: list[int]) -> Iterator[slice]:
    """Runs of rows of about a block's bytes together."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > B.BLOCK_BYTES:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint_`` (binary): the sum of the text's paragraph vectors.

    Defined cases: a null text counts as empty, and an empty text is one empty paragraph. Rows may repeat ids or have null ones;
    ids are not read. Columns of any name are handed on, but for one called ``fingerprint_``, which is replaced.
    """
    docs = without(docs, "fingerprint_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column(at)):
                part = batch.slice(block.rows.start, block.rows.stop - block.rows.start)
                values = B.binary(sums([block.text(i) for i in range(len(block))]).packed())
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, "fingerprint_"])

    at = docs.columns.index(text_col)
    return map_batches(docs, run, extended(docs, "fingerprint_ binary"))


def apply_edits(prints: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``prints`` (an id, ``fingerprint_``) after ``edits`` (the id, ``paragraph``, ``times``: how often it comes in, or
    goes out if negative), without any text.

    Edits are summed inside every batch first and only one vector per id and batch travels, so an id with most of the edits is
    no large group. Defined cases: edits of unknown or null ids and with null ``paragraph`` or ``times`` change nothing; rows
    that repeat an id all change alike; without edits the table stays as it is.
    """
    def deltas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            parts = []
            for cut in _chunks(frame.paragraph.str.len().tolist()):
                part = frame.iloc[cut]
                change, times = sums([p.encode() for p in part.paragraph]), part.times.to_numpy(np.int64)
                groups, of = np.unique(part.id_.to_numpy(), return_inverse=True)
                total = zeros(len(groups))
                np.add.at(total.equal, of, change.equal * times.astype(np.uint64)[:, None])
                np.add.at(total.like, of, change.like * times.astype(np.uint32)[:, None])
                parts.append(pd.DataFrame({"id_": groups, "delta_": total.packed()}))
            if parts:
                yield _summed(pd.concat(parts))

    by_id = edits.select(F.col(id_col).cast("long").alias("id_"), "paragraph", F.col("times").cast("long")).dropna()
    change = (by_id.mapInPandas(deltas, "id_ long, delta_ binary").groupBy("id_")
              .applyInPandas(_summed, "id_ long, delta_ binary"))

    @F.pandas_udf(BinaryType())
    def plus(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((unpacked(a.tolist()) + unpacked(b.tolist())).packed()) if len(a) else pd.Series([], dtype=object)

    joined = prints.join(change, F.col(id_col).cast("long") == F.col("id_"), "left")
    none = F.lit(bytes(SIZE))
    return joined.withColumn("fingerprint_", plus("fingerprint_", F.coalesce("delta_", none))).select(*prints.columns)


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per id, the sum of its vectors."""
    groups, of = np.unique(frame.id_.to_numpy(), return_inverse=True)
    each, total = unpacked(frame.delta_.tolist()), zeros(len(groups))
    np.add.at(total.equal, of, each.equal)
    np.add.at(total.like, of, each.like)
    return pd.DataFrame({"id_": groups, "delta_": total.packed()})


def _in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out by ranges of (``down_``, ``tie_``) and sorted, as ``range_, follower_, ...``.

    The first row of every range is in the range before it as well, as its follower; the last range is followed by the first
    one. Only one key per range travels to the driver, and each text is shuffled once.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = (rows.select("down_", "tie_").repartitionByRange(n, "down_", "tie_").groupBy(F.spark_partition_id())
              .agg(F.min(F.struct("down_", "tie_")).alias("k")).select("k.*").collect())
    starts = sorted((r.down_, r.tie_) for r in firsts) or [(0, 0)]
    down, tie = (np.array(x, np.int64) for x in zip(*starts))

    @F.pandas_udf("array<struct<range_: int, follower_: boolean>>")
    def places(d: pd.Series, t: pd.Series) -> pd.Series:
        d, t = d.to_numpy(np.int64), t.to_numpy(np.int64)
        at = np.searchsorted(down, d, side="right") - 1
        while (late := (at > 0) & (down[at] == d) & (tie[at] > t)).any():
            at[late] -= 1
        at = np.maximum(at, 0)
        first = (down[at] == d) & (tie[at] == t)
        own = [[{"range_": r, "follower_": False}] for r in at.tolist()]
        for i in np.flatnonzero(first).tolist():
            own[i].append({"range_": (int(at[i]) - 1) % len(down), "follower_": True})
        return pd.Series(own, dtype=object)

    placed = rows.withColumn("p_", F.explode(places("down_", "tie_"))).select("p_.*", *rows.columns)
    return (placed.repartitionById(len(starts), F.col("range_"))
            .sortWithinPartitions("range_", "follower_", "down_", "tie_"))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with its edited text's vectors; a row waits for the one after it, which may come with the next batch."""
    held = None  # (range, follower, id, text), its kept paragraphs' vector, its vector
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("range_", "follower_", "doc_", "text_"))))
        for cut in _chunks([len(r[3]) for r in rows]):
            part = rows[cut]
            kept, tails, begins = [], [], []
            for *_, text in part:
                middle = len(text) - len(text) // 2
                begin = text.rfind("\n", 0, middle) + 1
                kept.append(text[:begin - 1].encode() if begin else None)
                tails.append(text[begin:].encode())
                begins.append((begin, middle))
            kept = sums(kept)
            own = kept + sums(tails)
            if held is not None:
                part, begins = [held[0], *part], [held[1], *begins]
                kept, own = (Sums(np.concatenate((a.equal, b.equal)), np.concatenate((a.like, b.like)))
                             for a, b in ((held[2], kept), (held[3], own)))
            ready = [i for i in range(len(part) - 1) if not part[i][1] and part[i][0] == part[i + 1][0]]
            ends = []
            for i in ready:
                text, (begin, middle) = part[i][3], begins[i]
                ends.append(text[begin:middle] + part[i + 1][3][:len(text) - middle])
            edited = kept[ready] + sums([e.encode() for e in ends])
            yield pa.RecordBatch.from_arrays([
                pa.array([part[i][2] for i in ready], pa.int64()),
                pa.array([len(part[i][3]) for i in ready], pa.int64()),
                pa.array([sha256((part[i][3][:begins[i][0]] + e).encode()).hexdigest() for i, e in zip(ready, ends)], pa.string()),
                B.binary(own[ready].packed()), B.binary(edited.packed()),
                pa.array(likeness(own[ready], edited)), pa.array(likeness(own[ready], own[[i + 1 for i in ready]]))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint_", "edited_fingerprint_", "near_edited", "near_next"])
            held = part[-1], begins[-1], kept[-1:], own[-1:]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint_, edited_fingerprint_, near_edited, near_next`` of every row.

    The edited text ends with the beginning of the next row's text, in descending order of ids; see ``edited_sha256`` in
    ``catalog``. Its fingerprint comes from the row's own by deletion of the paragraphs behind the cut and insertion of the new.

    Defined cases: a null text counts as empty; the next row of the last is the first, so a single row is its own next. Rows
    that repeat an id follow each other in the order of a hash of their texts, those with null ids come last. Other columns are
    not read. Rows equal in id and text are one range of their own task at most, which holds two texts at a time.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    down = F.coalesce(F.bitwise_not("doc_"), F.lit(2**63 - 1))
    rows = rows.select("doc_", "text_", down.alias("down_"), F.xxhash64("text_").alias("tie_"))
    return _in_ranges(rows).select("range_", "follower_", "doc_", "text_").mapInArrow(
        _edits, "doc_id long, n_chars long, edited_sha256 string, fingerprint_ binary, edited_fingerprint_ binary, "
                "near_edited double, near_next double")
