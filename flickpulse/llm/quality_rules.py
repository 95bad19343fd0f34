"""Quality rules: fixed base rules, then a calibrated logistic regression on hashed word and character n-grams.

Features of a text are the shares of its hashed words, word pairs and byte 3- and 5-grams, each family in its own range
of ``BUCKETS`` weights, over the whole text; a score is the sum over families of the mean weight, so a text of any length
is scored in one pass. The model is trained in one task on a bounded sample of at most ``SAMPLE`` labelled rows (those of
smallest hash of their id; rows whose crc32 of the id is divisible by 5 are held out). A quarter of the sample is kept
from the weights to calibrate the probability (Platt scaling). All other rows are scored in Arrow batches against the
fixed ``THRESHOLD``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flickpulse.llm import batches as B
from flickpulse.llm.frames import extended, map_batches, without

SAMPLE = 2000
THRESHOLD = 0.3
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
FAMILIES = 4
SHARE_SCALE, STEPS, MOMENTUM, DECAY, LEAST_TEXTS = 10.0, 80, 0.9, 1e-5, 5
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def held_out(id_col: str) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``text, label`` of at most ``sample`` labelled rows outside the held-out fold, chosen by the hash of their id.

    Where documents repeat a labelled id, the one of smallest text hash stands for it, so there are never more rows."""
    chosen = (labels.select(F.col(id_col), F.col(label).cast("double").alias("label"))
              .filter(~held_out(id_col) & F.col("label").isin(0.0, 1.0))
              .orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), id_col, "label").limit(sample))
    return (docs.filter(~held_out(id_col)).select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .join(chosen, id_col).groupBy(id_col, "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
            .select(id_col, "text", "label"))


def _bucket(h: np.ndarray, family: int) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + family * BUCKETS


def _grams(block: B.Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of byte n-grams (A-Z kept apart from a-z: shouting is a sign), and the text of each."""
    n = len(block.data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for j in range(width):
        value = (value << np.uint64(8)) | block.data[j:j + n].astype(np.uint64)
    doc = np.repeat(np.arange(len(block)), np.diff(block.offsets))
    inside = doc[:n] == doc[width - 1:]
    return value[inside] * np.uint64(0x9E3779B97F4A7C15), doc[:n][inside]


def features(block: B.Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family, the buckets of all its n-grams and the text of each."""
    w = B.words(block)
    doc = w.doc()
    h = B.span_hashes(block.data, w)
    yield _bucket(h, 0), doc
    pairs, at = B.windows(h, w.of, 2, seed=9)
    yield _bucket(pairs, 1), doc[at]
    for family, width in ((2, 3), (3, 5)):
        grams, of = _grams(block, width)
        yield _bucket(grams, family), of


def _matrix(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse shares: (row, bucket, value) of all texts."""
    rows, cols, values = [], [], []
    for block in B.blocks(pa.array(texts, pa.string())):
        for bucket, doc in features(block):
            total = np.bincount(doc, minlength=len(block))
            key, count = np.unique(doc * (FAMILIES * BUCKETS) + bucket, return_counts=True)
            r = key // (FAMILIES * BUCKETS)
            rows.append(r + block.rows.start)
            cols.append(key % (FAMILIES * BUCKETS))
            values.append(count / total[r])
    return tuple(np.concatenate(x) for x in (rows, cols, values))


def _train(frame: pd.DataFrame) -> pd.DataFrame:
    """Weights, offset and calibration from a bounded sample; one row."""
    frame = frame.sort_values(["doc_id", "text", "label"], na_position="first").reset_index(drop=True)
    passed = [~base_failed(base_counts(block)) for block in B.blocks(pa.array(frame.text, pa.string()))]
    frame = frame[np.concatenate(passed)].reset_index(drop=True)  # the model judges only what passes the base rules
    if not len(frame):
        return pd.DataFrame({"weights": [np.zeros(FAMILIES * BUCKETS, np.float32).tobytes()], "offset": [30.0]})
    y = frame.label.to_numpy()
    row, col, value = _matrix(frame.text)
    often = np.bincount(col, minlength=FAMILIES * BUCKETS)[col] >= LEAST_TEXTS  # the rest can't be learned from
    order = np.argsort(row[often], kind="stable")
    row, col, value = (x[often][order] for x in (row, col, value))
    used, at = np.unique(col, return_inverse=True)
    n, x = len(y), (value * SHARE_SCALE).astype(np.float32)
    fit = np.arange(n) % 4 != 3
    w, speed, b, b_speed = np.zeros(len(used), np.float32), np.zeros(len(used)), 0.0, 0.0
    rate = 30 * 4 / max(1e-9, np.bincount(row, x ** 2, n).max(initial=0.0))
    for _ in range(STEPS):
        z = np.bincount(row, x * w[at], n) + b
        error = np.where(fit, 1 / (1 + np.exp(-z)) - y, 0) / max(1, fit.sum())
        speed = MOMENTUM * speed - rate * (np.bincount(at, x * error[row], len(used)) + DECAY * w)
        b_speed = MOMENTUM * b_speed - 0.3 * error.sum()
        w, b = (w + speed).astype(np.float32), b + b_speed
    z = np.bincount(row, x * w[at], n) + b
    a, c = _platt(z[~fit], y[~fit]) if (~fit).any() else (1.0, 0.0)
    weights = np.zeros(FAMILIES * BUCKETS, np.float32)
    weights[used] = w * SHARE_SCALE * a
    return pd.DataFrame({"weights": [weights.tobytes()], "offset": [float(b * a + c)]})


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logit that make the held-back part's probabilities fit (smoothed targets, Newton steps)."""
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x = np.stack((z, np.ones(len(z))), 1)
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, x.T @ (p - target)), -2, 2)
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def in_one_task(rows: DataFrame, fit, schema: str) -> DataFrame:
    """``fit`` of all rows of a bounded sample as one frame; no row gives no row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in frames if len(f)]
        if frames:
            yield fit(pd.concat(frames, ignore_index=True))
    return rows.repartition(1).mapInPandas(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Calibrated weights and offset; without labelled rows, a model that scores every text 1."""
    rows = training_rows(docs, labels, label, sample)
    model = in_one_task(rows, _train, "weights binary, offset double").first()
    if model is None:
        return np.zeros(FAMILIES * BUCKETS, np.float32), 30.0
    return np.frombuffer(model.weights, np.float32), model.offset


def scores(block: B.Block, weights: np.ndarray, offset: float) -> np.ndarray:
    """Probability of good quality of every text of a block."""
    z = np.full(len(block), offset)
    for bucket, doc in features(block):
        n = np.bincount(doc, minlength=len(block))
        z += np.bincount(doc, weights[bucket], len(block)) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def base_counts(block: B.Block) -> dict[str, np.ndarray]:
    """The five base counts of every text of a block."""
    w, n = B.words(block), len(block)
    doc = np.repeat(np.arange(n), np.diff(block.offsets))
    per_doc = lambda mask: np.bincount(doc[mask], minlength=n)
    points = (block.data & 0xC0) != 0x80
    h = B.span_hashes(block.data, w)
    wins, at = B.windows(h, w.of, WINDOW, seed=13)
    of_word = w.doc()
    repeats = B.covered(at[_again(wins, of_word[at], False)], WINDOW, len(h))
    rows = B.lines(block)
    has_word = np.searchsorted(w.starts, rows.ends) > np.searchsorted(w.starts, rows.starts)
    keep = np.flatnonzero(has_word)
    line_doc = rows.doc()[keep]
    line_hash = B.span_hashes(block.data, B.Spans(rows.starts[keep], rows.ends[keep], rows.of))
    dup = _again(line_hash, line_doc, True)
    return {"n_words": np.diff(w.of), "word_chars": per_doc(points & B.IS_WORD[block.data]),
            "n_symbols": per_doc(SYMBOL[block.data]), "n_dup_lines": np.bincount(line_doc[dup], minlength=n),
            "n_repeat_words": np.bincount(of_word[repeats], minlength=n)}


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def _again(h: np.ndarray, doc: np.ndarray, later_only: bool) -> np.ndarray:
    """Entries whose hash occurs again in the same text: all of them, or all but the first."""
    order = np.lexsort((h, doc))
    same = (np.diff(h[order]) == 0) & (np.diff(doc[order]) == 0)
    out = np.zeros(len(h), bool)
    out[order[1:]] = same
    if not later_only:
        out[order[:-1]] |= same
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with the five counts, ``base_failed``, ``score`` and ``keep_``.

    ``keep_`` is false if the base rules fail (fewer than 20 words, or over 30 % of the words in repeated windows), else
    whether the calibrated score reaches ``THRESHOLD``. Defined cases: null text counts as empty and fails; a row with null
    id is judged like any other, and repeated rows alike; further columns are kept, but replaced where they have the name
    of a result or ``text_``. An empty table gives an empty result; without any labelled row every score is 1.
    """
    weights, offset = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, score = {c: [] for c in COUNTS}, []
            for block in B.blocks(batch.column("text_")):
                for c, v in base_counts(block).items():
                    counts[c].append(v)
                score.append(scores(block, weights, offset))
            got = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in counts.items()}
            score = np.concatenate(score) if score else np.zeros(0)
            failed = base_failed(got)
            own = [i for i, n in enumerate(batch.schema.names) if n != "text_"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in own] + [pa.array(got[c].astype(np.int64)) for c in COUNTS]
                + [pa.array(failed), pa.array(score), pa.array(~failed & (score >= THRESHOLD))],
                names=[batch.schema.names[i] for i in own] + COUNTS + ["base_failed", "score", "keep_"])

    docs = without(docs, " ".join(COUNTS) + " base_failed score keep_ text_")
    schema = extended(docs, ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, keep_ boolean")
    return map_batches(docs.withColumn("text_", F.coalesce(F.col(text_col), F.lit(""))), run, schema)
