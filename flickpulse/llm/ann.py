"""Approximate nearest neighbours by inner product: multiprobe hashing with p-stable (Gaussian) projections.

Vectors are cut into bands of norms, ``BANDS`` per doubling, scaled by the largest norm of the band and given one more
component that makes all norms 1, and queries are scaled to norm 1; in each band the nearest by distance then are those
of largest inner product, and a few long vectors don't push the others together. A table hashes a vector to
``PROJECTIONS`` numbers floor((a.x + b) / WIDTH). A query visits, in each of ``TABLES`` tables, its own bucket and
perturbed ones (a number one lower or higher) in the order of estimated success, the sum of squared distances to the
crossed borders; ``PROBES`` buckets per table and band. Queries that found fewer than ``k`` so go on in that order
through the buckets that the first table has, any number of borders away, until they have ``k`` or all vectors were
visited. Candidates of all tables are reranked by the exact inner product of the original vectors in double precision.

Every row is indexed. Buckets are cut into blocks of about ``BLOCK`` vectors by their counted size, so a hot bucket or
thousands of equal vectors are many small blocks. Queries travel in blocks per bucket too; a block of queries meets each
block of vectors as one matrix product, and only the best ``k`` per query leave it. On the generated vectors (nearly
random directions, the hard case) the parameters give a recall of 0.96 and more against brute force.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flickpulse.operators.scale import stage

PROJECTIONS, WIDTH, TABLES, PROBES, BLOCK = 4, 2.0, 4, 12, 4096
BANDS = 2  # per doubling of the norm
BAND_SALT = 0x2545F4914F6CDD1D
NEAR_TIE = 1e-9


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v, norm`` of the rows that take part: an id, and a vector of finite numbers that aren't all 0."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("norm", norm).filter("norm > 0 and norm < double('infinity')")


class Hashing:
    """The tables' projections for vectors of ``dims`` components (and the added one)."""

    def __init__(self, dims: int, projections: int = PROJECTIONS, width: float = WIDTH, tables: int = TABLES, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dims + 1, projections))
        self.b = rng.uniform(0, width, (tables, 1, projections))
        self.width, self.moves = width, _moves(projections)
        self.salt = rng.integers(1, 1 << 62, projections, dtype=np.int64) | 1

    def places(self, x: np.ndarray) -> np.ndarray:
        """(table, vector, projection): where vectors lie, in bucket widths."""
        return (x @ self.a + self.b) / self.width

    def key(self, numbers: np.ndarray) -> np.ndarray:
        """One number for the bucket with the given hash values."""
        with np.errstate(over="ignore"):
            return (numbers.astype(np.int64) * self.salt).sum(-1)

    def onward(self, x: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """(query, bucket): cost of any buckets of the first table, given as their hash values."""
        at = self.places(x)[0][:, None, :]
        return (np.maximum(0, np.maximum(buckets - at, at - buckets - 1)) ** 2).sum(-1)

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """(table, query, probe): buckets to visit, likeliest first."""
        at = self.places(x)
        base = np.floor(at)
        inside = at - base
        cost = np.stack((inside ** 2, np.zeros_like(inside), (1 - inside) ** 2), -1)  # one lower, same, one higher
        total = sum(cost[..., j, :][..., self.moves[:, j] + 1] for j in range(self.moves.shape[1]))
        best = np.argsort(total, -1, kind="stable")[..., :count]
        return self.key(base[:, :, None, :] + self.moves[best])


def _moves(projections: int) -> np.ndarray:
    """All ways to leave each number, lower it or raise it."""
    return np.stack(np.meshgrid(*[[-1, 0, 1]] * projections, indexing="ij"), -1).reshape(-1, projections)


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["v"].to_numpy()).astype(np.float64)


def _unit(x: np.ndarray, norm: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """Vectors scaled by the largest norm of their band, with the component that makes their norm 1."""
    return np.column_stack((x / largest[:, None], np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2))))


def _banded(keys: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Buckets of a band, apart from those of other bands."""
    with np.errstate(over="ignore"):
        return keys + band.astype(np.int64) * BAND_SALT


def _hashed(hashing: Hashing, bands: dict[int, float], query_probes: int | None):
    """``vec_id, v, table, bucket`` rows of vectors, or of queries for every bucket that they visit in every band."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s in range(0, len(frame), 1024):
                part = frame.iloc[s:s + 1024]
                x = _matrix(part)
                norm = part["norm"].to_numpy()
                if query_probes is None:
                    band = part["band"].to_numpy()
                    x = _unit(x, norm, np.array([bands[b] for b in band]))
                    keys = _banded(hashing.key(np.floor(hashing.places(x))), band)[..., None]
                else:
                    keys = hashing.probes(np.column_stack((x / norm[:, None], np.zeros(len(x)))), query_probes)
                    keys = np.concatenate([_banded(keys, np.array(b)) for b in bands], -1)
                tables, n, probes = keys.shape
                row = np.tile(np.repeat(np.arange(n), probes), tables)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy()[row], "v": part["v"].to_numpy()[row],
                                    "table": np.repeat(np.arange(tables), n * probes), "bucket": keys.reshape(-1)})
    return run


def _filled(hashing: Hashing, bands: dict[int, float], rows: DataFrame) -> pd.DataFrame:
    """``band, numbers, n``: the buckets of the first table and their vectors. All places are of vectors of norm 1, so there
    are some hundred buckets per band at any number of vectors."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                band = frame["band"].to_numpy()
                x = _unit(_matrix(frame), frame["norm"].to_numpy(), np.array([bands[b] for b in band]))
                numbers = np.column_stack((band, np.floor(hashing.places(x)[0]).astype(np.int64)))
                kinds, n = np.unique(numbers, axis=0, return_counts=True)
                yield pd.DataFrame({"band": kinds[:, 0], "numbers": list(kinds[:, 1:]), "n": n})
    found = rows.mapInPandas(run, "band long, numbers array<long>, n long")
    return found.groupBy("band", "numbers").agg(F.sum("n").alias("n")).toPandas()


def _onward(hashing: Hashing, filled: pd.DataFrame, least: int):
    """``vec_id, v, table, bucket`` rows of queries for the first buckets of each band that hold ``least`` vectors or all."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s in range(0, len(frame), 64):
                part = frame.iloc[s:s + 64]
                x = np.column_stack((_matrix(part) / part["norm"].to_numpy()[:, None], np.zeros(len(part))))
                for band, of in filled.groupby("band"):
                    numbers, n = np.stack(of["numbers"].to_numpy()), of["n"].to_numpy()
                    order = np.argsort(hashing.onward(x, numbers), -1, kind="stable")
                    row, at = np.nonzero(np.cumsum(n[order], -1) - n[order] < least)
                    keys = _banded(hashing.key(numbers), np.array(band))[order[row, at]]
                    yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy()[row], "v": part["v"].to_numpy()[row],
                                        "table": np.zeros(len(row), np.int32), "bucket": keys})
    return run


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """``table, bucket, ids, vs``: buckets packed into blocks of about ``block`` vectors."""
    sizes = rows.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = rows.join(sizes, ["table", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))

    def gather(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"table": [key[0]], "bucket": [key[1]], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
                             "vs": [_matrix(frame).tobytes()]})

    return dealt.groupBy("table", "bucket", "block").applyInPandas(gather, "table int, bucket long, ids binary, vs binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, nearest first, ties to the smaller id.

    Defined cases: rows without id, and vectors that are null, zero, or hold null or non-finite components, take no part;
    nor do vectors of another length than the commonest (the larger of two as common). A query is not its own neighbour; a
    row that repeats an id counts once, with its larger score. Queries with fewer candidates get all of them; equal vectors
    tie. Other columns are not read. No usable vector, or no query, gives an empty result.
    """
    rows, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    shape = (rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("largest"))
             .orderBy(F.desc("n"), F.desc("dims")).limit(1).first())
    out = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return vectors.sparkSession.createDataFrame([], out)
    hashing = Hashing(shape.dims)
    of_shape = F.size("v") == shape.dims
    form, packed = "vec_id long, v array<double>, table int, bucket long", "query_id long, ids binary, scores binary"
    rows = rows.filter(of_shape).withColumn("band", F.floor(BANDS * (F.lit(float(np.log2(shape.largest))) - F.log2("norm"))))
    asked = asked.filter(of_shape)
    bands = {r.band: r.largest for r in rows.groupBy("band").agg(F.max("norm").alias("largest")).collect()}
    index = stage(_blocks(rows.mapInPandas(_hashed(hashing, bands, None), form), block))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                q_ids, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q, x = (np.frombuffer(b).reshape(-1, shape.dims) for b in (r.q_vs, r.vs))
                got = [_best(i, v, ids, x, row, k) for i, v, row in zip(q_ids, q, q @ x.T)]
                yield pd.DataFrame({"query_id": q_ids, "ids": [g[0].tobytes() for g in got], "scores": [g[1].tobytes() for g in got]})

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, float] = {}
        for a, b in zip(frame["ids"], frame["scores"]):
            for i, s in zip(np.frombuffer(a, np.int64).tolist(), np.frombuffer(b).tolist()):
                best[i] = max(s, best.get(i, -np.inf))
        top = heapq.nsmallest(k, ((-s, i) for i, s in best.items()))
        return pd.DataFrame({"query_id": [key[0]], "ids": [np.array([i for _, i in top], np.int64).tobytes()],
                             "scores": [np.array([-s + 0.0 for s, _ in top]).tobytes()]})

    def ranked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                yield pd.DataFrame({"query_id": np.full(len(ids), r.query_id), "rank": np.arange(1, len(ids) + 1, dtype=np.int32),
                                    "vec_id": ids, "score": np.frombuffer(r.scores)})

    def compared(visits: DataFrame) -> DataFrame:
        dealt = _blocks(visits, 256).select("table", "bucket", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
        return dealt.join(index, ["table", "bucket"]).mapInPandas(meet, packed)

    def best_of(found: DataFrame) -> DataFrame:
        return stage(found.groupBy("query_id").applyInPandas(merge, packed))

    best = best_of(compared(asked.mapInPandas(_hashed(hashing, bands, probes), form)))
    few = [r.vec_id for r in rows.select("vec_id").distinct().limit(k + 1).collect()]
    due = F.lit(k) if len(few) > k else F.lit(len(few)) - F.col("vec_id").isin(few).cast("int")
    filled, least = None, k + 1
    while True:  # further buckets for queries that lack neighbours
        got = best.select(F.col("query_id").alias("vec_id"), (F.octet_length("ids") / 8).alias("got"))
        short = asked.join(got, "vec_id", "left").filter(F.coalesce("got", F.lit(0)) < due).drop("got")
        if short.isEmpty():
            break
        filled = _filled(hashing, bands, rows) if filled is None else filled
        best = best_of(best.unionByName(compared(short.mapInPandas(_onward(hashing, filled, least), form))))
        if least >= filled["n"].sum():
            break
        least *= 4
    return best.mapInPandas(ranked, out)


def _best(query_id: int, v: np.ndarray, ids: np.ndarray, x: np.ndarray, products: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of a block: found by matrix product, scored again one by one so that equal vectors tie exactly."""
    other = np.flatnonzero(ids != query_id)
    if len(other) > k:
        least = np.partition(products[other], len(other) - k)[len(other) - k]
        other = other[products[other] >= least - NEAR_TIE * max(1.0, abs(least))]
    scores = (x[other] * v).sum(1)
    order = np.lexsort((ids[other], -scores))[:k]
    return ids[other][order], scores[order]
