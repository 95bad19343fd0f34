"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Texts become token ids; only a document longer than a sequence is cut. Full pieces are sequences of their own. The others
are dealt at random into problems of about ``PROBLEM`` pieces. A problem has ``ISLANDS`` populations of packings. In each
epoch an island breeds: a child takes whole well-filled bins of one parent, the other parent's bins that hold any of the
same pieces are dissolved, and the displaced pieces are placed best-fit, largest first. After an epoch each island's best
packing migrates to the next island, as rows through a join. A problem is done when it reaches the bound of total length
over sequence length. What the problems' worst bins hold is then packed once more together, in problems of the same size.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flickpulse.llm import batches as B
from flickpulse.operators.scale import stage

LENGTH = 4096
END = 1
PROBLEM, ISLANDS, EPOCHS, CHILDREN, POPULATION = 8192, 2, 2, 4, 4
WELL_FILLED, LOOSE = 0.995, 0.98
WORDS_KEPT = 300_000


class WordTokens:
    """Token ids of whole texts, for a tokenizers file that drops white space and lower-cases.

    Such a tokenizer encodes the words of a text apart, whatever their case, and a full stop or comma after an ASCII letter
    or digit apart from its word. So each distinct word is encoded once, many in one call with a special token between
    them, and remembered (``WORDS_KEPT`` words at most). Texts that hold the start of a special token are encoded whole.
    """

    def __init__(self, path: str, between: str = "<|startoftext|>"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between, self.between_id = between.encode(), self.tokenizer.token_to_id(between)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of words; their ids are ids[at:at + size]
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        texts, mark = [], np.frombuffer(self.between, np.uint8)
        for s in range(0, len(h), 256):
            size = (ends - starts)[s:s + 256] + len(mark)
            stop = np.cumsum(size)
            joined = np.empty(int(stop[-1]), np.uint8)
            inside = np.arange(len(joined)) < np.repeat(stop - len(mark), size)
            joined[inside] = data[(np.repeat(starts[s:s + 256] - (stop - size), size) + np.arange(len(joined)))[inside]]
            joined[~inside] = np.tile(mark, len(size))
            texts.append(joined.tobytes().decode("utf-8", "replace"))
        ids = np.concatenate([np.array(e.ids, np.int32) for e in
                              self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        stops = np.flatnonzero(ids == self.between_id)  # one after each word
        first = np.concatenate(([0], stops[:-1] + 1))
        known = np.concatenate((self.known, h))
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at = np.concatenate((self.at, first + len(self.ids)))[order]
        self.size = np.concatenate((self.size, stops - first))[order]
        self.ids = np.concatenate((self.ids, ids))

    def encode(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and where each text's ids start and end."""
        low = B.LOWER[block.data]
        w = _parts(low, B.words(block))
        h = B.span_hashes(low, w)
        unique, first, of = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > WORDS_KEPT:
            self._forget()
        new = ~np.isin(unique, self.known, assume_unique=True)
        if new.any():
            self._learn(low, w.starts[first[new]], w.ends[first[new]], unique[new])
        place = np.searchsorted(self.known, unique)[of] if len(h) else np.zeros(0, np.int64)
        size = self.size[place] if len(h) else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.at[place] - (ends - size), size) + np.arange(int(size.sum()))] if len(h) else self.ids[:0]
        bounds = np.concatenate(([0], ends))[w.of]
        special = np.flatnonzero((block.data[:-1] == 0x3C) & (block.data[1:] == 0x7C))
        if len(special):
            return self._whole(block, flat, bounds, np.unique(np.searchsorted(block.offsets, special, side="right") - 1))
        return flat, bounds

    def _whole(self, block: B.Block, flat: np.ndarray, bounds: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put in the ids of the given texts, encoded whole."""
        parts = [flat[s:e] for s, e in zip(bounds[:-1], bounds[1:])]
        for i in texts:
            parts[i] = np.array(self.tokenizer.encode(block.text(i).decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


def _parts(low: np.ndarray, w: B.Spans) -> B.Spans:
    """Words, with a last full stop or comma after an ASCII letter or digit as a word of its own."""
    if not len(w.starts):
        return w
    last, before = low[w.ends - 1], low[np.maximum(w.ends - 2, 0)]
    cut = (w.ends - w.starts > 1) & ((last == 0x2E) | (last == 0x2C)) & (
        ((before >= 97) & (before <= 122)) | ((before >= 48) & (before <= 57)))
    place = np.arange(len(cut)) + np.cumsum(cut) - cut  # of each word's first part
    starts, ends = np.empty(len(cut) + int(cut.sum()), np.int64), np.empty(len(cut) + int(cut.sum()), np.int64)
    starts[place], ends[place] = w.starts, w.ends - cut
    starts[place[cut] + 1], ends[place[cut] + 1] = w.ends[cut] - 1, w.ends[cut]
    return B.Spans(starts, ends, np.append(place, len(starts))[w.of])


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
           end_id: int = END, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, key`` (with ``with_ids`` also ``ids``, little-endian 32-bit numbers).

    ``key`` is a number of the row that is unique once the result is staged. Null text is empty: one piece, of ``end_id``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        words, count, base = WordTokens(tokenizer_path), 0, TaskContext.get().partitionId() << 36
        for batch in batches:
            ids_of = batch.column("doc_")
            for block in B.blocks(batch.column("text_")):
                flat, bounds = words.encode(block)
                rows = []
                for i in range(len(block)):
                    ids = np.append(flat[bounds[i]:bounds[i + 1]], end_id).astype("<u4")
                    for piece, s in enumerate(range(0, len(ids), length)):
                        part = ids[s:s + length].tobytes()
                        rows.append((block.rows.start + i, piece, s, len(part) // 4, zlib.crc32(part), part))
                own = [ids_of.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32())]
                own += [pa.array([r[j] for r in rows], pa.int64()) for j in (2, 3, 4)]
                own += [pa.array(np.arange(count, count + len(rows)) + base)]
                count += len(rows)
                own += [B.binary([r[5] for r in rows])] if with_ids else []
                yield pa.RecordBatch.from_arrays(own, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "key"] + ["ids"] * with_ids
    kinds = ["long", "int", "long", "long", "long", "long", "binary"]
    slim = docs.select(F.col(id_col).cast("long").alias("doc_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    return slim.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def best_fit(sizes: np.ndarray, order: np.ndarray, bin_of: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Place the pieces in ``order`` each into the fullest bin that takes it, else into a new one; returns all bins' room."""
    free = sorted((int(r), b) for b, r in enumerate(room))
    room = list(room)
    for i in order:
        size = int(sizes[i])
        at = bisect_left(free, (size, -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b = length, len(room)
            room.append(length)
        bin_of[i], room[b] = b, r - size
        if r > size:
            insort(free, (r - size, b))
    return np.asarray(room)


def _decreasing(sizes: np.ndarray, noise: np.ndarray, length: int) -> np.ndarray:
    bin_of = np.full(len(sizes), -1, np.int32)
    best_fit(sizes, np.argsort(-(sizes * noise), kind="stable"), bin_of, np.zeros(0, np.int64), length)
    return bin_of


def _worth(bin_of: np.ndarray, sizes: np.ndarray, length: int) -> tuple[float, float]:
    """Fewer bins are better; among as many, unevenly filled ones are."""
    fill = np.bincount(bin_of, sizes) / length
    return -float(len(fill)), float((fill ** 2).sum())


def _child(mother: np.ndarray, father: np.ndarray, sizes: np.ndarray, length: int, rng) -> np.ndarray:
    """Whole well-filled bins of ``father`` go into ``mother``; the pieces displaced there are placed best-fit."""
    fill = np.bincount(father, sizes)
    good = np.flatnonzero((fill >= WELL_FILLED * length) & (rng.random(len(fill)) < rng.uniform(0.2, 0.8)))
    injected = np.isin(father, good)
    dissolved = np.unique(mother[injected])
    loose = np.bincount(mother, sizes)  # bins that aren't well filled are dissolved as well, to be filled anew
    dissolved = np.union1d(dissolved, np.flatnonzero(loose < LOOSE * length))
    displaced = np.flatnonzero(np.isin(mother, dissolved) & ~injected)
    child = np.full(len(sizes), -1, np.int32)
    kept = np.flatnonzero(~np.isin(mother, dissolved))
    labels, child[kept] = np.unique(mother[kept], return_inverse=True)
    more, at = np.unique(father[injected], return_inverse=True)
    child[injected] = at + len(labels)
    n = len(labels) + len(more)
    room = length - np.bincount(child[child >= 0], sizes[child >= 0], n).astype(np.int64) if n else np.zeros(0, np.int64)
    noise = rng.uniform(0.9, 1.0, len(displaced))
    best_fit(sizes, displaced[np.argsort(-(sizes[displaced] * noise), kind="stable")], child, room, length)
    return child


def evolve(sizes: np.ndarray, population: list[np.ndarray], seed: int, length: int) -> list[np.ndarray]:
    """One epoch of one island; the best packing comes first. It ends early at the lower bound."""
    rng = np.random.default_rng(seed)
    bound = -(-int(sizes.sum()) // length)
    if not population:
        population = [_decreasing(sizes, np.ones(len(sizes)), length)]
    rank = lambda x: _worth(x, sizes, length)
    while len(population) < POPULATION and -rank(population[0])[0] > bound:
        population.append(_decreasing(sizes, rng.uniform(0.85, 1.0, len(sizes)), length))
    population.sort(key=rank, reverse=True)
    for _ in range(CHILDREN * POPULATION):
        if -rank(population[0])[0] <= bound:
            break
        a, b = rng.choice(len(population), 2, replace=False)
        population.append(_child(population[a], population[b], sizes, length, rng))
        population.sort(key=rank, reverse=True)
        del population[POPULATION:]
    return population


def _solve(items: DataFrame, length: int) -> DataFrame:
    """``key, sequence (problem << 32 | bin), offset, fill`` of ``items`` (key, length)."""
    items = stage(items)
    problems = -(-max(1, items.count()) // PROBLEM)
    dealt = items.withColumn("problem", F.pmod(F.xxhash64("key", F.lit(10)), F.lit(problems)))

    def gather(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "key"], ascending=[False, True])
        return pd.DataFrame({"problem": [key[0]], "keys": [frame.key.to_numpy(np.int64).tobytes()],
                             "sizes": [frame.length.to_numpy(np.int64).tobytes()]})

    def epoch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                sizes = np.frombuffer(r.sizes, np.int64)
                had = [np.frombuffer(x, np.int32).copy() for x in r.population]
                got = evolve(sizes, had, int(r.problem) * 1000 + r.island * 10 + r.epoch, length)
                out.append((r.problem, r.keys, r.sizes, r.island, r.epoch + 1, [x.tobytes() for x in got],
                            *_worth(got[0], sizes, length)))
            yield pd.DataFrame(out, columns=["problem", "keys", "sizes", "island", "epoch", "population", "bins", "even"])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                sizes, keys = np.frombuffer(r.sizes, np.int64), np.frombuffer(r.keys, np.int64)
                bin_of = np.frombuffer(r.best, np.int32)
                order = np.argsort(bin_of, kind="stable")
                fill = np.bincount(bin_of, sizes).astype(np.int64)
                ends = np.cumsum(sizes[order])
                first = np.concatenate(([0], np.cumsum(fill)[:-1]))
                b = bin_of[order].astype(np.int64)
                yield pd.DataFrame({"key": keys[order], "sequence": (int(r.problem) << 32) + b,
                                    "offset": ends - sizes[order] - first[b], "fill": fill[b]})

    state = "problem long, keys binary, sizes binary, island int, epoch int, population array<binary>, bins double, even double"
    now = (dealt.groupBy("problem").applyInPandas(gather, "problem long, keys binary, sizes binary")
           .withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
           .withColumns({"epoch": F.lit(0), "population": F.array().cast("array<binary>")}))
    for e in range(EPOCHS):
        now = stage(now.repartition("problem", "island").mapInPandas(epoch, state))
        if e < EPOCHS - 1:
            guests = now.select("problem", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
                                F.slice("population", 1, 1).alias("guests"))
            now = (now.join(guests, ["problem", "island"]).withColumn("population", F.concat("population", "guests"))
                   .drop("guests", "bins", "even"))
    best = now.groupBy("problem").agg(F.max_by(F.struct("keys", "sizes", F.col("population")[0].alias("best")),
                                               F.struct("bins", "even", -F.col("island"))).alias("b")).select("problem", "b.*")
    return best.mapInPandas(place, "key long, sequence long, offset long, fill long")


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """Staged pieces with ``sequence_id`` and ``offset``; each sequence is gapless from 0 and at most ``length`` long.

    Defined cases: full pieces stand alone; repeated rows are pieces of their own; a null id is carried along; an empty
    table gives an empty result. No row is left out.
    """
    alone = cut.filter(F.col("length") >= length).select(
        "key", (F.col("key") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = stage(_solve(cut.filter(F.col("length") < length).select("key", "length"), length))
    loose = F.col("fill") < LOOSE * length
    again = _solve(first.filter(loose).join(cut, "key").select("key", "length"), length)
    firm = first.filter(~loose).select("key", (F.col("sequence") * 4).alias("sequence_id"), "offset")
    placed = alone.unionByName(firm).unionByName(again.select("key", (F.col("sequence") * 4 + 2).alias("sequence_id"), "offset"))
    return cut.join(placed, "key")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """All pieces of all documents with their places in sequences: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` (and ``ids``). See :func:`pieces` and :func:`pack` for what the defined cases give."""
    cut = stage(pieces(docs, tokenizer_path, id_col, text_col, length, end_id, with_ids))
    return pack(cut, length).drop("key")
