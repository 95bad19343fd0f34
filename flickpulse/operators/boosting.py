"""Boosted regression trees, all folds or resamples of a model fitted together.

``pyspark.ml`` fits one boosted model as some thousand short jobs in a row, and again for each fold and resample. Here one
job adds up the histograms of all models for a level of their trees: the rows stay in cached blocks of bin codes on the
executors, only histograms, whose size does not depend on the rows, reach the driver. Trees, bins and losses are those of
GBTRegressor and GBTClassifier.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from flickpulse.operators import scale

SAMPLE = 20_000  # rows, about, from which the limits of the bins are taken; all rows if there are fewer
ROWS_A_TASK = 10_000
ROWS_A_BLOCK = 50_000
CHECKPOINT = 50  # rounds


def bin_limits(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Limits of at most ``bins`` bins of about equal weight, each halfway between neighbouring values."""
    v, at = np.unique(values[weights > 0], return_inverse=True)
    middle = (v[:-1] + v[1:]) / 2
    if len(middle) < bins:
        return middle
    counts = np.bincount(at, weights[weights > 0])
    stride = counts.sum() / bins
    ends, out, target = np.cumsum(counts).tolist(), [], stride
    for i, (before, after) in enumerate(zip(ends, ends[1:])):
        if abs(before - target) < abs(after - target):
            out.append(middle[i])
            target += stride
    return np.array(out)


def best_splits(hist: np.ndarray, starts: list[int], named: list[bool]):
    """Feature, bin and both sides' means of the best split of each node; without a gain the bin is beyond all codes.

    hist: (model, weight or weighted target, node, cell), the cells of a feature from its entry of ``starts`` on. Bins up to
    the chosen one go left; of names, all but the chosen one do.
    """
    left, feature, code = [], [], []
    for f, (a, b) in enumerate(zip(starts, starts[1:])):
        h = hist[..., a:b]
        left.append(h.sum(-1, keepdims=True) - h[..., :-1] if named[f] else np.cumsum(h, -1)[..., :-1])
        feature += [f] * (b - a - 1)
        code += range(b - a - 1)
    lw, ls = np.moveaxis(np.concatenate(left, -1), 1, 0)
    w, s = np.moveaxis(hist[..., :starts[1]].sum(-1, keepdims=True), 1, 0)
    rw, rs = w - lw, s - ls
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((lw > 0) & (rw > 0), ls * ls / lw + rs * rs / rw - s * s / w, -np.inf)
        best = gain.argmax(-1)[..., None]
        at = lambda x: np.take_along_axis(x, best, -1)[..., 0]
        split = at(gain) > 0
        means = np.stack([np.where(split, at(ls / lw), (s / w)[..., 0]), at(rs / rw)], -1)
    return np.array(feature)[best[..., 0]], np.where(split, np.array(code)[best[..., 0]], 1 << 16), means


def node_of(codes: np.ndarray, splits: list, m: int, is_name: np.ndarray) -> np.ndarray:
    """The node of each row below the levels ``splits`` of model ``m``'s tree."""
    rows = np.arange(codes.shape[1])
    node = np.zeros(len(rows), np.intp)
    for feature, code in splits:
        f = feature[m][node]
        c, own = codes[f, rows], code[m][node]
        node = 2 * node + np.where(is_name[f], c == own, c > own)
    return node


def add_tree(block, tree, step: float, is_name: np.ndarray):
    """The block with a further tree of each model in what the models say of its rows."""
    codes, w, y, said = block
    splits, leaves = tree
    return codes, w, y, np.stack([s + step * leaves[m][node_of(codes[m], splits, m, is_name)] for m, s in enumerate(said)])


def histogram(block, splits: list, starts: list[int], is_name: np.ndarray, first: bool, classes: bool) -> np.ndarray:
    """Weights and weighted targets by model, node below ``splits`` and cell (bin of a feature)."""
    codes, w, y, said = block
    nodes = 1 << len(splits)
    hist = np.zeros((len(said), 2, nodes, starts[-1]))
    for m, s in enumerate(said):
        rest = y if first else 4 * y / (1 + np.exp(2 * y * s)) if classes else 2 * (y - s)
        wm = w[m].astype(float)
        node, sums = node_of(codes[m], splits, m, is_name), (wm, wm * rest)
        for f, (a, b) in enumerate(zip(starts, starts[1:])):
            cell = node * (b - a) + codes[m][f]
            for i, x in enumerate(sums):
                hist[m, i, :, a:b] = np.bincount(cell, x, (b - a) * nodes).reshape(nodes, b - a)
    return hist


def fit_trees(blocks, starts: list[int], named: list[bool], rounds: int, step: float, depth: int, classes: bool) -> list:
    """The trees of each round for all models: splits by level, and leaves. blocks: an RDD of (codes, w, y, said)."""
    is_name, trees = np.array(named), []
    state = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    for turn in range(rounds):
        before = None
        if trees:
            before, tree, share = state, trees[-1], step if turn > 1 else 1.0
            state = before.map(lambda b, tree=tree, share=share: add_tree(b, tree, share, is_name)).persist(
                StorageLevel.MEMORY_AND_DISK)
            if turn % CHECKPOINT == 0:
                state.checkpoint()
        splits = []
        for _ in range(depth):
            parts = state.mapPartitions(lambda bs, splits=tuple(splits), first=turn == 0: _added(
                histogram(b, splits, starts, is_name, first, classes) for b in bs)).collect()  # one histogram a task
            feature, code, means = best_splits(sum(parts), starts, named)
            if np.isnan(means[..., 0]).all(-1).any():
                raise ValueError("no rows to fit")
            splits.append((feature, code))
        trees.append((splits, np.nan_to_num(means).reshape(len(means), -1)))
        if before is not None:
            before.unpersist()
    state.unpersist()
    return trees


def _added(parts):
    total = None
    for p in parts:
        total = p if total is None else total + p
    return [] if total is None else [total]


def boosted(frame: DataFrame, numbers: list[str], label: str, weights: list[Column], stage, classes: bool = False,
            names: dict[str, list[str]] | None = None, standard: list[tuple] | None = None) -> DataFrame:
    """``frame`` with columns ``p0``, ``p1``, ...: for each row what the model of each weight says of it.

    A row of weight 0 takes no part in that model's fit. ``stage`` is the GBTRegressor or GBTClassifier whose rounds, step,
    depth and bins are taken; for ``classes`` the label is 0 or 1 and the columns are margins. ``names`` lists the values of
    text features, each of which can be split off. ``standard`` has means and deviations of ``numbers`` for each model, which
    then sees them standardised.
    """
    names = names or {}
    rounds, step, depth, bins = stage.getMaxIter(), stage.getStepSize(), stage.getMaxDepth(), stage.getMaxBins()
    ws = [f"w{i}_" for i in range(len(weights))]
    ready = frame.select("*", *[w.alias(n) for w, n in zip(weights, ws)])
    rows = frame.count()
    if rows == 0:
        raise ValueError("no rows to fit")
    held = ready
    if rows > SAMPLE:  # by the rows' values, so that their places do not matter
        held = ready.filter(F.pmod(F.xxhash64(*frame.columns), F.lit(rows)) < SAMPLE)
    held = held.select(*numbers, *ws).toPandas()  # SAMPLE rows, about
    shifts = [list(zip(mean, [1 / d if d else 0.0 for d in dev])) for mean, dev in standard or [
        (np.zeros(len(numbers)), np.ones(len(numbers)))] * len(ws)]
    limits = [[bin_limits((held[c].to_numpy(float) - mean) * by, held[w].to_numpy(float), bins)
               for c, (mean, by) in zip(numbers, shift)] for w, shift in zip(ws, shifts)]
    sizes = [bins] * len(numbers) + [len(v) + 1 for v in names.values()]
    named = [False] * len(numbers) + [True] * len(names)
    starts = [0, *np.cumsum(sizes).tolist()]
    tasks = max(1, min(frame.sparkSession.sparkContext.defaultParallelism, rows // ROWS_A_TASK))
    if max(sizes) > 256:
        raise ValueError("a code is one byte: at most 256 bins or names")

    def codes_of(batch):
        x = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in numbers]
        if any(np.isnan(v).any() for v in x):
            raise ValueError("a feature is null or not a number")
        texts = [np.array([place.get(v, len(place)) for v in batch.column(c).to_pylist()], np.uint8)
                 for c, place in ((c, {v: i for i, v in enumerate(values)}) for c, values in names.items())]
        return [np.stack([np.searchsorted(t, (v - mean) * by).astype(np.uint8) for t, v, (mean, by) in zip(lim, x, shift)]
                         + texts) for lim, shift in zip(limits, shifts)]

    def pack(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS_A_BLOCK:
                yield block(pa.Table.from_batches(held))
                held = []
        if held:
            yield block(pa.Table.from_batches(held))

    def block(rows):
        y = rows.column(label).to_numpy().astype(float)
        if np.isnan(y).any():
            raise ValueError("a label is null or not a number")
        w = np.stack([rows.column(c).to_numpy() for c in ws])
        b = codes_of(rows.combine_chunks()), w, 2 * y - 1 if classes else y, np.zeros((len(ws), len(y)))
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(b)], pa.binary())], names=["block"])

    scale.shared_root(frame.sparkSession)  # for the checkpoints
    packed = ready.select(*numbers, *names, label, *ws).repartition(tasks).mapInArrow(pack, "block binary")
    trees = fit_trees(packed.rdd.map(lambda r: pickle.loads(r[0])), starts, named, rounds, step, depth, classes)
    is_name = np.array(named)

    def say(batches):
        for batch in batches:
            b = codes_of(batch), None, None, np.zeros((len(ws), batch.num_rows))
            for i, tree in enumerate(trees):
                b = add_tree(b, tree, step if i else 1.0, is_name)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p) for p in b[-1]]], names=schema.names)

    schema = Y.StructType([*frame.schema.fields, *[Y.StructField(f"p{i}", Y.DoubleType()) for i in range(len(ws))]])
    return frame.mapInArrow(say, schema)


def of_fold(models: int) -> Column:
    """What the model of the row's own fold says, of the columns of ``boosted``."""
    return F.element_at(F.array(*[F.col(f"p{k}") for k in range(models)]), F.col("fold") + 1)
