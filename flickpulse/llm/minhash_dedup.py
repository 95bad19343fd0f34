"""MinHash near-dedup with sequential Bayesian verification.

Documents are sets of distinct 4-word shingles (A-Z lower-cased); two are linked at a Jaccard similarity of 0.8 or more,
and a group is a connected component of links.

1. One pass over the texts gives every document a 128-bit hash of its set, 128 minhash values and 32 band keys of 4 values
   each; two sets at 0.8 share no band with probability (1 - 0.8**4)**32 = 5e-8. Documents of equal sets are one class; only
   its smallest document goes on.
2. Members of a band bucket are candidates. Their signatures are compared 32 values at a time; after each batch a pair is
   dropped if the posterior probability (uniform prior) that its similarity reaches 0.8 is below ``MISS``. What survives is
   verified exactly on the full sets.
3. No bucket is expanded into pairs. Each member is first compared with its bucket's leader only, and members that this
   joins need no further comparison. For buckets that still hold several components, the shingles that other open
   documents have as well are counted by ``BLOCKS`` ranges of their hash. The sum of the smaller counts bounds what two sets
   can have in common: members that can reach 0.8 with nothing in their bucket leave it, the rest meets leaders with few
   shingles of their own, and only pairs that the bound leaves are then compared across components. No link between
   different texts is lost, and members of a bucket's largest component are never paired with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flickpulse.llm import batches as B
from flickpulse.llm.components import components
from flickpulse.operators.scale import stage

SHINGLE = 4
PERCENT = 80
VALUES, BANDS, BATCH = 128, 32, 32
MISS = 1e-7
CENTRAL_ROUNDS = 1
BLOCKS = 64

_rng = np.random.default_rng(4)
_TIMES = (_rng.integers(0, 1 << 32, VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_PLUS = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(block: B.Block, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of shingle hashes of every text of a block."""
    low = B.Block(B.LOWER[block.data], block.offsets, block.rows)
    w = B.words(low)
    hashes = B.span_hashes(low.data, w)
    h, at = B.windows(hashes, w.of, width, seed=7)
    cut = np.searchsorted(at, w.of)
    out = []
    for i in range(len(block)):
        n = w.of[i + 1] - w.of[i]
        if 0 < n < width:
            own = hashes[w.of[i]:w.of[i + 1]]
            out.append(B.windows(own, np.array([0, n]), int(n), seed=7)[0] + np.uint64(n))
        else:
            out.append(np.unique(h[cut[i]:cut[i + 1]]))
    return out


def _sketches(batches: Iterator[pa.RecordBatch], width: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """``doc_, n_shingles, set_a, set_b, bands, values``; an empty set has no bands."""
    for batch in batches:
        ids = batch.column("doc_")
        for block in B.blocks(batch.column("text_")):
            sets = shingle_sets(block, width)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            starts = np.cumsum(sizes[full]) - sizes[full]
            flat = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, np.uint64)
            small = (flat >> np.uint64(32)).astype(np.uint32)
            sig = np.zeros((len(full), VALUES), np.uint32)
            if len(full):
                for k in range(VALUES):
                    sig[:, k] = np.minimum.reduceat(small * _TIMES[k] + _PLUS[k], starts)
            ab = [np.zeros(len(block), np.uint64) for _ in range(2)]
            for j, x in enumerate(ab):
                if len(full):
                    x[full] = np.add.reduceat(B.mix(flat ^ np.uint64(0xA0761D6478BD642F >> j)), starts)
            per = VALUES // BANDS
            key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(full), 1))
            for r in range(per):
                key = B.mix(key * np.uint64(31) + sig[:, r::per].astype(np.uint64))
            bands = np.zeros(len(block) + 1, np.int32)
            bands[1:] = np.cumsum((sizes > 0) * BANDS)
            values = [b""] * len(block)
            for row, i in enumerate(full):
                values[i] = sig[row].astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids[block.rows.start:block.rows.stop], pa.array(sizes), *(pa.array(x.view(np.int64)) for x in ab),
                 pa.ListArray.from_arrays(pa.array(bands), pa.array(key.reshape(-1).view(np.int64))), B.binary(values)],
                names=["doc_", "n_shingles", "set_a", "set_b", "bands", "values"])


def least_matches(miss: float = MISS, at: float = PERCENT / 100) -> list[int]:
    """For 32, 64, ... compared values, the fewest equal ones at which the posterior of a similarity of ``at`` or more is
    ``miss`` at least; with a uniform prior it is Beta(m + 1, n - m + 1)."""
    out = []
    for n in range(BATCH, VALUES + 1, BATCH):
        # the tail of Beta(m + 1, n - m + 1) above ``at`` is the chance of at most m successes in n + 1 trials
        chance = [math.comb(n + 1, k) * at ** k * (1 - at) ** (n + 1 - k) for k in range(n + 2)]
        total = np.cumsum(chance)
        out.append(int(np.argmax(total >= miss)))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs that no batch of values rules out, with their number of equal values."""
    least = least_matches()
    for batch in batches:
        if not len(batch):
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, VALUES) for c in ("u", "v"))
        alive, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
        for j, need in enumerate(least):
            part = slice(j * BATCH, (j + 1) * BATCH)
            equal[alive] += (x[alive, part] == y[alive, part]).sum(1)
            alive = alive[equal[alive] >= need]
        keep = pa.array(alive)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep),
                                          pa.array(equal[alive])], names=["a", "b", "equal"])


def _exact(batches: Iterator[pa.RecordBatch], width: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """Pairs with texts ``u`` and ``v`` whose full sets reach the similarity."""
    for batch in batches:
        first = [s for block in B.blocks(batch.column("u")) for s in shingle_sets(block, width)]
        second = [s for block in B.blocks(batch.column("v")) for s in shingle_sets(block, width)]
        keep = []
        for i, (s, t) in enumerate(zip(first, second)):
            both = len(np.intersect1d(s, t, assume_unique=True))
            if both and 100 * both >= PERCENT * (len(s) + len(t) - both):
                keep.append(i)
        keep = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])


class _Verifier:
    """Compares candidate pairs (a, b): signatures first, then full sets."""

    def __init__(self, texts: DataFrame, sketches: DataFrame, width: int):
        self.texts, self.sketches, self.width = texts, sketches, width

    def _with(self, pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
        return (pairs.join(of.select(F.col("doc_").alias("a"), F.col(value).alias("u")), "a")
                .join(of.select(F.col("doc_").alias("b"), F.col(value).alias("v")), "b").select("a", "b", "u", "v"))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """``(a, b, equal)`` of the pairs that the signatures leave."""
        return self._with(pairs, self.sketches, "values").mapInArrow(_compare, "a long, b long, equal long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        exact = partial(_exact, width=self.width)  # of the pairs alone: this object stays on the driver
        return self._with(pairs, self.texts, "text_").mapInArrow(lambda batches: exact(batches), "a long, b long")


def _can_reach(n_x: Column, n_y: Column, at_most: Column) -> Column:
    """Whether sets of these sizes, with ``at_most`` common members, can have the similarity."""
    common = F.least(n_x, n_y, at_most)
    return 100 * common >= PERCENT * (n_x + n_y - common)


def _shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``doc_, s, counts``: the shingles of every text, and how many lie in each of ``BLOCKS`` ranges."""
    for batch in batches:
        for block in B.blocks(batch.column("text_")):
            sets = shingle_sets(block, width)
            cuts = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets)
            key = np.repeat(np.arange(len(sets)), np.diff(cuts)) * BLOCKS + (flat >> np.uint64(40)).astype(np.int64) % BLOCKS
            counts = np.bincount(key, minlength=len(sets) * BLOCKS).astype(np.int32)
            each = np.arange(0, len(counts) + 1, BLOCKS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_")[block.rows.start:block.rows.stop],
                 pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(each), pa.array(counts))], names=["doc_", "s", "counts"])


def _shared_counts(texts: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``doc_, shared, counts``: how many of its shingles another of ``members`` has, in all and by range."""
    sets = stage(texts.join(members.select("doc_").distinct(), "doc_", "left_semi").mapInArrow(
        lambda batches: _shingles(batches, width), "doc_ long, s array<long>, counts array<int>"))
    once = (sets.select("doc_", F.explode("s").alias("s")).groupBy("s")
            .agg(F.min("doc_").alias("doc_"), F.max("doc_").alias("last")).filter("doc_ = last"))
    block = F.pmod(F.shiftrightunsigned("s", 40), F.lit(BLOCKS))
    own = once.groupBy("doc_").agg(F.array(*[F.count_if(block == i).cast("int") for i in range(BLOCKS)]).alias("own"))
    left = F.zip_with("counts", F.coalesce("own", F.array_repeat(F.lit(0), BLOCKS)), lambda c, o: c - o)
    # rows that repeat an id are one document: the larger counts keep the bound safe
    counts = sets.select("doc_", "counts").join(own, "doc_", "left").groupBy("doc_").agg(
        F.max(F.struct(F.aggregate(left, F.lit(0), lambda x, y: x + y).cast("long").alias("shared"), left.alias("counts"))).alias("m"),
        F.count(F.lit(1)).alias("rows"))
    return counts.select("doc_", "m.shared", "m.counts", "rows")


def _common(x: str, y: str) -> Column:
    """At most so many shingles are common to two sets with these counts."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b).cast("long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``; ``component_id`` is the smallest id of its group.

    Defined cases: null and empty texts and texts without words have no shingles and are linked with nothing; a text of
    fewer than ``shingle`` words has its whole word sequence as its only shingle. Rows that repeat an id are one document: links
    of any of their texts count for it. A row with null id is linked with nothing, its component is null and it is kept.
    Other columns are not read. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    sketches = stage(texts.mapInArrow(
        lambda batches: _sketches(batches, shingle), "doc_ long, n_shingles long, set_a long, set_b long, bands array<long>, values binary"))
    sets = ["n_shingles", "set_a", "set_b"]
    usable = sketches.filter("doc_ is not null and n_shingles > 0")
    classes = usable.groupBy(*sets).agg(F.min("doc_").alias("first_doc"))
    copies = stage(usable.select("doc_", *sets).join(classes, sets).filter("doc_ <> first_doc")
                   .select(F.col("doc_").alias("a"), F.col("first_doc").alias("b")).distinct())
    heads = usable.join(classes.withColumnRenamed("first_doc", "doc_"), ["doc_", *sets], "left_semi")
    banded = heads.select("doc_", "n_shingles", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("doc_").alias("lo"), F.max("doc_").alias("hi")).filter("lo <> hi")
    banded = stage(banded.join(shared.select("band"), "band").distinct())
    check = _Verifier(texts, heads, shingle)

    found, decided = copies.limit(0), copies.limit(0)
    members = banded.withColumns({"comp": F.col("doc_"), "shared": F.col("n_shingles"), "counts": F.lit(None).cast("array<int>")})
    for round_ in range(1 + CENTRAL_ROUNDS):
        own = F.floor((F.col("n_shingles") - F.col("shared")) * 20 / F.col("n_shingles"))
        order = F.struct(own, F.xxhash64("doc_", F.lit(round_)))
        leader = members.groupBy("band").agg(F.min(F.struct(order.alias("o"), "doc_", "n_shingles", "comp", "counts")).alias("l"))
        star = (members.join(leader, "band").filter(F.col("comp") != F.col("l.comp"))
                .filter(_can_reach(F.col("n_shingles"), F.col("l.n_shingles"),
                                   F.coalesce(_common("counts", "l.counts"), F.col("n_shingles"))))
                .select(F.greatest("doc_", "l.doc_").alias("a"), F.least("doc_", "l.doc_").alias("b"),
                        F.col("doc_").alias("member")).distinct().join(decided, ["a", "b"], "left_anti"))
        star = stage(star)
        pairs = star.select("a", "b").distinct()
        likely = stage(check.likely(pairs))
        # each member's likeliest leader only; what that leaves apart is compared in a later round
        best = stage(star.join(likely, ["a", "b"]).groupBy("member")
                     .agg(F.max_by(F.struct("a", "b"), F.struct("equal", -F.col("a"), -F.col("b"))).alias("p"))
                     .select("p.a", "p.b").distinct())
        found = stage(found.unionByName(check.links(best)))
        decided = stage(decided.unionByName(pairs.join(likely, ["a", "b"], "left_anti")).unionByName(best))
        placed = _placed(banded, components(found, "a", "b"))
        if round_ == 0:
            members = stage(_several(placed))
            counts = stage(_shared_counts(texts, members, shingle))
            placed = members  # what is in one component stays so
        members = stage(_several(_alive(placed, counts)))
        if members.isEmpty():
            break
    last = check.links(check.likely(_across(members).join(decided, ["a", "b"], "left_anti")).select("a", "b"))
    groups = components(copies.unionByName(found).unionByName(last), "a", "b")
    out = sketches.select("doc_", "n_shingles").join(groups.withColumnRenamed("node", "doc_"), "doc_", "left")
    component = F.coalesce("component", "doc_")
    return out.select(F.col("doc_").alias("doc_id"), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_") == component, F.lit(True)).alias("kept"))


def _placed(banded: DataFrame, comps: DataFrame) -> DataFrame:
    """Members with their components."""
    return (banded.join(comps.toDF("doc_", "c"), "doc_", "left")
            .select("band", "doc_", "n_shingles", F.coalesce("c", "doc_").alias("comp")))


def _several(placed: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    several = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return placed.join(several.select("band"), "band")


def _alive(placed: DataFrame, counts: DataFrame) -> DataFrame:
    """Members that may reach the similarity with some member of their bucket, by sizes and shared shingles."""
    least = placed.groupBy("band").agg(F.min("n_shingles").alias("least_n"))
    return (placed.select("band", "doc_", "n_shingles", "comp").join(counts, "doc_").join(least, "band")
            .withColumn("shared", F.when(F.col("rows") > 1, F.col("n_shingles")).otherwise(F.col("shared")))
            .withColumn("counts", F.when(F.col("rows") == 1, F.col("counts")))
            .filter(_can_reach(F.col("n_shingles"), F.greatest("least_n", "shared"), F.col("shared"))).drop("least_n", "rows"))


def _across(members: DataFrame) -> DataFrame:
    """Pairs across the components of a bucket that the counts leave possible. One side is outside the bucket's largest
    component, so that component's members are not paired among themselves."""
    largest = (members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("band")
               .agg(F.max_by("comp", F.struct("n", "comp")).alias("largest")))
    of = members.join(largest, "band")
    x, y = (of.select("band", "largest", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_", "n_shingles", "counts", "comp")]) for s in "xy")
    fits = _can_reach(F.col("n_shingles_x"), F.col("n_shingles_y"), F.coalesce(_common("counts_x", "counts_y"), F.col("n_shingles_x")))
    return (x.filter("comp_x <> largest").drop("largest").join(y, "band")
            .filter("comp_x <> comp_y and (comp_y = largest or doc__x > doc__y)").filter(fits)
            .select(F.greatest("doc__x", "doc__y").alias("a"), F.least("doc__x", "doc__y").alias("b")).distinct())
