"""Operator 3: quality classifier by naive Bayes support vectors.

Features are indicators of word 1- and 2-grams and byte 4-grams, hashed to 2**BITS.  Each is scaled by the log-ratio of its smoothed
shares in the two classes; on the scaled, length-normalised rows a linear hinge-loss model is fitted by dual coordinate descent.
A sigmoid fitted on rows that the descent did not see turns margins into probabilities.

The model is fitted on at most TRAIN_ROWS labelled rows (those with the least hash of doc_id); every text is scored whole.

Defined results: null or empty texts get the score of a text without features; labels that are null, or name no document, teach
nothing; repeated labels or documents count as often as they occur; with labels of fewer than two classes every score is the share
of label 1 (0.5 without labels); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import common as C

BITS = 18
TRAIN_ROWS = 12_000
FOLDS = 5
EPOCHS = 12
COST = 1.0


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text, and their offsets."""
    data, at = C.text_bytes(column)
    starts, ends, words_at = C.word_spans(data, at)
    h = C.word_hashes(data, starts, ends)
    two, two_at = C.windows_of(words_at, 2)
    pair = C.rolling(h, 2)[two] if len(two) else np.zeros(0, np.uint64)
    four, four_at = C.windows_of(at, 4)
    grams = np.ndarray((max(len(data) - 3, 0),), "<u4", data.tobytes() + b"\0" * 4, strides=(1,))[four].astype(np.uint64) if len(four) else np.zeros(0, np.uint64)
    shift = np.uint64(64 - BITS)
    parts = [(C.mix(h + np.uint64(1)) >> shift, words_at), (C.mix(pair + np.uint64(2)) >> shift, two_at), (C.mix(C.mix(grams) + np.uint64(3)) >> shift, four_at)]
    parts = [(v.astype(np.int32), a.tolist()) for v, a in parts]
    rows = []
    for i in range(len(at) - 1):
        x = np.concatenate([v[a[i] : a[i + 1]] for v, a in parts])
        x.sort()
        rows.append(x[np.flatnonzero(np.diff(x, prepend=-1))])
    return (np.concatenate(rows) if rows else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)])


def log_ratios(flat: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    of = np.repeat(y, np.diff(at))
    p = 1.0 + np.bincount(flat[of > 0], minlength=1 << BITS)
    q = 1.0 + np.bincount(flat[of <= 0], minlength=1 << BITS)
    return np.log((p / p.sum()) / (q / q.sum()))


def descend(flat: np.ndarray, at: np.ndarray, y: np.ndarray, r: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) of the hinge-loss model, by dual coordinate descent; classes weigh alike."""
    w, alpha = np.zeros((1 << BITS) + 1), np.zeros(len(y))
    x = [r[flat[a:z]] for a, z in zip(at[:-1], at[1:])]
    x = [v / max(np.sqrt(v @ v), 1e-9) for v in x]
    q = np.array([v @ v for v in x]) + 1.0
    top = np.where(y > 0, cost * len(y) / (2 * max((y > 0).sum(), 1)), cost * len(y) / (2 * max((y <= 0).sum(), 1)))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f = flat[at[i] : at[i + 1]]
            g = y[i] * (w[f] @ x[i] + w[-1]) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * x[i]
                w[-1] += step
                alpha[i] = new
    return w


def margins(flat: np.ndarray, at: np.ndarray, w: np.ndarray, r: np.ndarray) -> np.ndarray:
    scale, weighted = r[flat], w[flat]
    total = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[at])
    return total(scale * weighted) / np.maximum(np.sqrt(np.maximum(total(scale * scale), 0)), 1e-9) + w[-1]


def sigmoid_fit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make 1/(1+exp(-(a*m+b))) the share of label 1, by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p)
        hess = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(flat: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """y: +1 or -1.  The model as arrays."""
    if len(y) < 10 or abs(y.sum()) == len(y):
        p = np.clip((y > 0).mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return {"w": np.zeros((1 << BITS) + 1, np.float32), "r": np.zeros(1 << BITS, np.float32), "ab": np.array([1.0, np.log(p / (1 - p))])}
    fold = np.random.default_rng(3).integers(0, FOLDS, len(y)) == 0
    pick = lambda on: (np.concatenate([flat[at[i] : at[i + 1]] for i in np.flatnonzero(on)]), np.concatenate([[0], np.cumsum(np.diff(at)[on])]), y[on])
    f, a, own = pick(~fold)
    r = log_ratios(f, a, own)
    w = descend(f, a, own, r)
    f, a, own = pick(fold)
    return {"w": w.astype(np.float32), "r": r.astype(np.float32), "ab": np.array(sigmoid_fit(margins(f, a, w, r), own))}


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """docs (doc_id, text), labels (doc_id, <column>): the rows to learn from."""
    picked = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y")  # `rows` rows of two numbers

    def prepared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat, at = features(b.column("text"))
                yield pa.RecordBatch.from_pydict({"data": pa.array([C.pack_arrays(flat, at, b.column("y").to_numpy().astype(np.int64))], pa.binary())})

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for b in batches for x in C.blobs(b.column("data"))]
        flat = np.concatenate([x[0] for x in got]) if got else np.zeros(0, np.int32)
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[1]) for x in got]))]) if got else np.zeros(1, np.int64)
        y = np.where(np.concatenate([x[2] for x in got]) > 0, 1.0, -1.0) if got else np.zeros(0)
        m = fit(flat, at, y)
        yield pa.RecordBatch.from_pydict({"data": pa.array([C.pack_arrays(m["w"], m["r"], m["ab"])], pa.binary())})

    out = sample.mapInArrow(prepared, "data binary").repartition(1).mapInArrow(fitted, "data binary").first()
    if out is None:
        return fit(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0))
    return dict(zip(("w", "r", "ab"), C.unpack_arrays(bytes(out.data))))


def score(docs: DataFrame, model: dict[str, np.ndarray], *keep: str) -> DataFrame:
    """docs (doc_id, text, and columns to keep): doc_id, those, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the input
    kept = docs.select("doc_id", *keep, "text")

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        a, b = m["ab"]
        for t in batches:
            if t.num_rows:
                flat, at = features(t.column("text"))
                z = np.clip(a * margins(flat, at, m["w"].astype(float), m["r"].astype(float)) + b, -40, 40)
                yield pa.RecordBatch.from_arrays([*t.columns[:-1], pa.array(1 / (1 + np.exp(-z)))], [*t.schema.names[:-1], "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    return kept.mapInArrow(scored, f"{kinds}, score double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    C.small_batches(spark)
    docs = C.documents(spark, sf_dir)
    held = C.crc_mod(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), train(docs, labels.where(~held)), "held_out")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
