"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of 1,024 bytes that cover all of it. Bytes get learned vectors of 8 numbers and one
fixed channel that says whether the byte's word repeats the word before it. 32 learned filters of 12 bytes slide over every
chunk in steps of 4; each is max- and mean-pooled over the chunk, the chunks' values are max-pooled over the text, and a
linear layer combines them into one probability. Embeddings, filters and the last layer are trained together by
back-propagation (Adam), in one task, on at most ``SAMPLE`` labelled rows outside the held-out fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flickpulse.llm import batches as B
from flickpulse.llm.frames import extended, map_batches, without
from flickpulse.llm.quality_rules import in_one_task, training_rows

SAMPLE = 1500
CHUNK, STEP = 1024, 896
DIMS, STRIDE, TAPS, FILTERS = 8, 4, 3, 32
CHANNELS = DIMS + 1
SPOTS = CHUNK // STRIDE - TAPS + 1
EPOCHS, BATCH_TEXTS, RATE = 8, 32, 4e-3
GROUP = 128
THRESHOLD = 0.3

_CLASSES = [range(97, 123), range(65, 91), range(48, 58), [32, 9], [10, 13], b".,;:!?'\"-", b"#*$%&|<>()[]{}=+/\\@_~^", range(128, 256)]
Params = dict[str, np.ndarray]


def _start() -> Params:
    rng = np.random.default_rng(3)
    embed = rng.normal(0, 0.05, (256, DIMS))
    for d, members in enumerate(_CLASSES):  # kinds of characters are where learning starts from
        embed[list(members), d] += 1
    return {"embed": embed.astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
            "filters": rng.normal(0, 0.15, (TAPS, STRIDE * CHANNELS, FILTERS)).astype(np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "offset": np.zeros(1, np.float32)}


def chunks(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, repeat flags and lengths of all chunks of a block, and the text of each; an empty text has one empty chunk."""
    w = B.words(block)
    h = B.span_hashes(block.data, w)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (np.diff(w.doc()) == 0)
    flags = np.zeros(len(block.data) + 1, np.int8)
    np.add.at(flags, w.starts[again], 1)
    np.subtract.at(flags, w.ends[again], 1)
    flags = np.cumsum(flags[:-1], dtype=np.int8)
    sizes = np.diff(block.offsets)
    count = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
    doc = np.repeat(np.arange(len(block)), count)
    start = block.offsets[:-1][doc] + (np.arange(len(doc)) - (np.cumsum(count) - count)[doc]) * STEP
    size = np.clip(block.offsets[1:][doc] - start, 0, CHUNK)
    at = start[:, None] + np.arange(CHUNK)
    inside = np.arange(CHUNK) < size[:, None]
    at = np.where(inside, at, 0)
    if not len(block.data):
        return np.zeros(at.shape, np.uint8), np.zeros(at.shape, np.int8), size, doc
    return np.where(inside, block.data[at], 0), np.where(inside, flags[at], 0), size, doc


def _forward(p: Params, x: np.ndarray, flag: np.ndarray, size: np.ndarray):
    """Pooled filter values of chunks, with what back-propagation needs."""
    inside = (np.arange(CHUNK) < size[:, None]).astype(np.float32)
    a = np.empty((len(x), CHUNK, CHANNELS), np.float32)
    a[:, :, :DIMS] = p["embed"][x]
    a[:, :, DIMS] = flag
    a *= inside[:, :, None]
    a = a.reshape(len(x), CHUNK // STRIDE, STRIDE * CHANNELS)
    z = a[:, :SPOTS] @ p["filters"][0] + p["bias"]
    for t in range(1, TAPS):
        z += a[:, t:t + SPOTS] @ p["filters"][t]
    valid = np.arange(SPOTS) * STRIDE < size[:, None]
    np.maximum(z, 0, out=z)
    z *= valid[:, :, None]
    spots = np.maximum(valid.sum(1), 1).astype(np.float32)
    return a, z, spots, np.concatenate((z.max(1), z.sum(1) / spots[:, None]), 1)


def _backward(p: Params, x, flag, size, doc, n, y, weight) -> tuple[float, Params]:
    a, z, spots, pooled = _forward(p, x, flag, size)
    starts = np.searchsorted(doc, np.arange(n))
    best = np.maximum.reduceat(pooled, starts)
    logit = best @ p["out"] + p["offset"]
    prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    error = ((prob - y) * weight / n).astype(np.float32)
    g = {"out": best.T @ error, "offset": error.sum(keepdims=True)}
    holds = (pooled == best[doc]).astype(np.float32)  # chunks that share a largest value share its gradient
    down = (error[:, None] * p["out"])[doc] * holds / np.add.reduceat(holds, starts)[doc]
    gz = np.broadcast_to((down[:, FILTERS:] / spots[:, None])[:, None], z.shape).copy()
    top = z.argmax(1)
    gz[np.arange(len(z))[:, None], top, np.arange(FILTERS)] += down[:, :FILTERS]
    gz *= z > 0
    flat = gz.reshape(-1, FILTERS)
    g["bias"] = flat.sum(0)
    ga = np.zeros_like(a)
    g["filters"] = np.empty_like(p["filters"])
    for t in range(TAPS):
        g["filters"][t] = a[:, t:t + SPOTS].reshape(-1, a.shape[2]).T @ flat
        ga[:, t:t + SPOTS] += gz @ p["filters"][t].T
    ga = ga.reshape(-1, CHANNELS)
    own = (np.arange(CHUNK) < size[:, None]).reshape(-1)
    g["embed"] = np.stack([np.bincount(x.reshape(-1)[own], ga[own, d], 256) for d in range(DIMS)], 1).astype(np.float32)
    loss = -(weight * np.log(np.where(y > 0.5, prob, 1 - prob) + 1e-9)).mean()
    return float(loss), g


def fit(frame: pd.DataFrame) -> Params:
    """Train on the texts and labels of a bounded frame. The order of its rows does not matter."""
    frame = frame.sort_values(["doc_id", "text", "label"], na_position="first").reset_index(drop=True)
    y = frame.label.to_numpy(np.float32)
    texts = pa.array(frame.text, pa.string())
    good = float(y.mean()) if len(y) else 1.0
    weight = np.where(y > 0.5, 0.5 / max(good, 1e-3), 0.5 / max(1 - good, 1e-3)).astype(np.float32)
    weight = np.sqrt(np.clip(weight, 0.05, 20))
    p, rng, step = _start(), np.random.default_rng(5), 0
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / EPOCHS)
        for s in range(0, len(order), BATCH_TEXTS):
            pick = order[s:s + BATCH_TEXTS]
            data, offsets = B.text_bytes(texts.take(pa.array(pick)))
            x, flag, size, doc = chunks(B.Block(data, offsets, slice(0, len(pick))))
            _, g = _backward(p, x, flag, size, doc, len(pick), y[pick], weight[pick])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return p


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Params:
    """The network's numbers; without labelled rows, a network that scores every text 1."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{k: x.tobytes() for k, x in fit(frame).items()}])

    start = _start()
    rows = training_rows(docs, labels, label, sample)
    row = in_one_task(rows, run, ", ".join(f"{k} binary" for k in start)).first()
    if row is None:
        return start | {"out": np.zeros(2 * FILTERS, np.float32), "offset": np.full(1, 30, np.float32)}
    return {k: np.frombuffer(row[k], np.float32).reshape(x.shape) for k, x in start.items()}


def scores(p: Params, block: B.Block) -> np.ndarray:
    """Probability of good quality of every whole text of a block."""
    x, flag, size, doc = chunks(block)
    pooled = np.concatenate([_forward(p, x[s:s + GROUP], flag[s:s + GROUP], size[s:s + GROUP])[3]
                             for s in range(0, len(x), GROUP)])
    best = np.maximum.reduceat(pooled, np.searchsorted(doc, np.arange(len(block))))
    return 1 / (1 + np.exp(-np.clip((best @ p["out"] + p["offset"]).astype(np.float64), -30, 30)))


def classify(docs: DataFrame, model: Params, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score``: the probability that the text is of good quality.

    Defined cases: null text counts as empty; an empty text has one chunk without bytes and gets the network's score of
    that; repeated rows score alike; ids are not read, so null ids are no case of their own. Further columns are kept,
    but replaced where they are named ``score`` or ``text_``. An empty table gives an empty result; without any labelled row
    every score is 1 (nearly).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scores(model, block) for block in B.blocks(batch.column("text_"))]
            own = [i for i, n in enumerate(batch.schema.names) if n != "text_"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in own] + [pa.array(np.concatenate(got or [np.zeros(0)]))],
                                             names=[batch.schema.names[i] for i in own] + ["score"])

    docs = without(docs, "score text_")
    return map_batches(docs.withColumn("text_", F.coalesce(F.col(text_col), F.lit(""))), run, extended(docs, "score double"))
