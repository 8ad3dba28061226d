"""Operator 7: language ID by a bidirectional gated recurrent network over bytes, trained here in numpy.

The network reads a text's bytes (ASCII lower-cased, white space as a space, a space before and after) in both directions and gives
every position probabilities of the languages; a document's probabilities are the mean over all its positions.  States run through
the text, across words.  A text is read in blocks of CORE positions side by side, each with CONTEXT positions more on both sides
that are read but not counted, so every counted position has read at least CONTEXT bytes, or all there are, on either side.

Trained by backpropagation through time (Adam) on at most TRAIN_PIECES pieces of PIECE bytes of at most TRAIN_DOCS documents, spread
over the languages; a document gives up to DOC_PIECES pieces, evenly spaced from its beginning to its end.

Defined results: null text or text without a letter is `und` with score 0; null lang teaches nothing; without any language to learn
from all is `und`; repeated rows are labelled row by row; an empty table gives no rows; other columns pass through `identify`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quadrille.llm import common as C

HIDDEN = 12
CORE = 448
CONTEXT = 32
ROWS = 512  # blocks that are read side by side
TRAIN_DOCS = 2_400
DOC_PIECES = 10
TRAIN_PIECES = 24_000
PIECE = 64
LENGTHS = (16, 32, 64)  # of the sequences of a training step
STEPS = 600
POSITIONS = 8192  # of a training step

_READ = C.lower_ascii(np.arange(256, dtype=np.uint8))
_READ[list(C.SPACES)] = 32


def new_network(langs: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"x{d}"] = (0.3 * rng.standard_normal((256, 3 * HIDDEN))).astype(np.float32)  # byte embedding and input weights in one
        p[f"u{d}"] = (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        p[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
    p["o"] = (rng.standard_normal((2 * HIDDEN, langs)) / np.sqrt(HIDDEN)).astype(np.float32)
    p["ob"] = np.zeros(langs, np.float32)
    return p


def _direction(p: dict, d: str, x: np.ndarray, out: np.ndarray, keep: list | None = None, live: np.ndarray | None = None) -> None:
    """States of one direction over x (time, row), into out (time, hidden, row); gates: update, reset, candidate.  Where live is false
    (after a row's end) the state stays zero.  Rows lie last, so each step works on long contiguous runs."""
    n, rows = HIDDEN, x.shape[1]
    kind = p["o"].dtype
    half = np.repeat(np.array([0.5, 1], kind), [2 * n, n])  # sigmoid(v) = (tanh(v / 2) + 1) / 2
    table, u = ((p[f"x{d}"] + p[f"c{d}"]) * half).T.copy(), (p[f"u{d}"] * half).T.copy()
    h, a = np.zeros((n, rows), kind), np.empty((3 * n, rows), kind)
    for t in range(len(x)) if d == "f" else reversed(range(len(x))):
        np.take(table, x[t], axis=1, out=a, mode="clip")
        b = u @ h
        z = a[: 2 * n] + b[: 2 * n]
        np.tanh(z, out=z)
        z += 1
        z *= 0.5
        c = z[n:] * b[2 * n :]
        c += a[2 * n :]
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((t, h, z, c, b[2 * n :]))
        new = c - h
        new *= z[:n]
        new += h
        if live is not None:
            new *= live[t]
        h = out[t] = new


def forward(p: dict, x: np.ndarray, keep: tuple[list, list] | None = None, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (time, language, row) of every position, and the joined states."""
    both = np.empty((len(x), 2 * HIDDEN, x.shape[1]), p["o"].dtype)
    _direction(p, "f", x, both[:, :HIDDEN], keep and keep[0], live)
    _direction(p, "b", x, both[:, HIDDEN:], keep and keep[1], live)
    e = p["o"].T @ both + p["ob"][:, None]
    e -= e.max(1, keepdims=True)
    np.exp(e, out=e)
    e /= e.sum(1, keepdims=True)
    return e, both


def gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of all positions of x (time, row) with languages y (row), and its gradients."""
    keep: tuple[list, list] = ([], [])
    prob, both = forward(p, x, keep)
    t_all, rows = x.shape
    own = np.arange(rows)
    loss = -np.log(np.maximum(prob[:, y, own], 1e-9)).mean()
    dl = prob.copy()
    dl[:, y, own] -= 1
    dl /= t_all * rows
    g = {"o": np.tensordot(both, dl, ((0, 2), (0, 2))), "ob": dl.sum((0, 2))}
    back = p["o"] @ dl
    n = HIDDEN
    by = np.argsort(x, axis=None, kind="stable")
    first, _ = C.runs_of(x.ravel()[by])
    for i, d in enumerate("fb"):
        u = p[f"u{d}"]
        gx, gu = np.zeros((256, 3 * n), u.dtype), np.zeros_like(u)
        into = np.empty((t_all, rows, 3 * n), u.dtype)
        dh = np.zeros((n, rows), u.dtype)
        for t, h, z, c, b in reversed(keep[i]):
            dh = dh + back[t, i * n : (i + 1) * n]
            zu, zr = z[:n], z[n:]
            dc = dh * zu * (1 - c * c)
            da = np.concatenate([dh * (c - h) * zu * (1 - zu), dc * b * zr * (1 - zr), dc])
            into[t] = da.T
            da[2 * n :] *= zr
            gu += h @ da.T
            dh = dh * (1 - zu) + u @ da
        gx[x.ravel()[by[first]]] = np.add.reduceat(into.reshape(-1, 3 * n)[by], first, axis=0)
        g[f"x{d}"], g[f"u{d}"], g[f"c{d}"] = gx, gu, gx.sum(0)
    return float(loss), g


def fit(pieces: np.ndarray, y: np.ndarray, langs: int, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Adam on cuts of one length from pieces (piece, byte)."""
    rng = np.random.default_rng(11)
    p = new_network(langs, rng)
    if not len(pieces) or langs < 2:
        return p
    pieces = np.ascontiguousarray(pieces.T)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for s in range(1, steps + 1):
        size = int(rng.choice(LENGTHS))
        at = int(rng.integers(0, PIECE - size + 1))
        pick = rng.integers(0, len(y), POSITIONS // size)
        _, g = gradients(p, pieces[at : at + size, pick], y[pick])
        rate = 0.02 * min(1.0, 2.0 * (1 - s / (steps + 1)))
        for name, d in g.items():
            m[name] = 0.9 * m[name] + 0.1 * d
            v[name] = 0.99 * v[name] + 0.01 * d * d
            p[name] = (p[name] - rate * (m[name] / (1 - 0.9**s)) / (np.sqrt(v[name] / (1 - 0.99**s)) + 1e-7)).astype(np.float32)
    return p


def label_texts(p: dict, column) -> np.ndarray:
    """Mean probabilities of all positions of each text; zeros for an empty one."""
    data, at = C.text_bytes(column)
    data = _READ[data]
    length = np.diff(at)
    size = np.where(length > 0, length + 2, 0)
    blocks = -(-size // CORE)
    of = np.repeat(np.arange(len(size)), blocks)
    first = np.cumsum(blocks) - blocks
    begin = (np.arange(len(of)) - first[of]) * CORE
    end = np.minimum(begin + CORE, size[of])
    low, high = np.maximum(begin - CONTEXT, 0), np.minimum(end + CONTEXT, size[of])
    sums = np.zeros((len(of), p["o"].shape[1]))
    order = np.argsort(high - low, kind="stable")
    for i in range(0, len(order), ROWS):
        b = order[i : i + ROWS]
        step = np.arange(int((high[b] - low[b]).max()))[:, None]
        pos = low[b] + step  # in the text with its two spaces
        within = (pos > 0) & (pos <= length[of[b]])
        x = np.where(within, data[np.where(within, at[of[b]] + pos - 1, 0)], np.uint8(32))
        live = pos < high[b]
        prob, _ = forward(p, x, live=None if live.all() else live)
        prob *= ((pos >= begin[b]) & (pos < end[b]))[:, None]
        sums[b] = prob.sum(0).T
    out = np.zeros((len(size), sums.shape[1]))
    full = np.flatnonzero(blocks)
    if len(full):
        out[full] = np.add.reduceat(sums, first[full], axis=0) / size[full, None]
    return out


def doc_pieces(text: str) -> list[bytes]:
    """Up to DOC_PIECES pieces of PIECE bytes, evenly spaced from a text's beginning to its end; a shorter text is repeated to that length."""
    own = b" " + text.encode().translate(_READ.tobytes()) + b" "
    spare = len(own) - PIECE
    if spare <= 0:
        return [(own * PIECE)[:PIECE]]
    k = min(DOC_PIECES, 2 + spare // PIECE)
    return [own[x : x + PIECE] for x in (i * spare // (k - 1) for i in range(k))]


def train(docs: DataFrame) -> tuple[list[str], dict[str, np.ndarray]]:
    """docs (doc_id, text, lang): rows to learn from.  The languages, sorted, and the network."""
    taught = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = sorted(counts)
    if not langs:
        return [], new_network(1, np.random.default_rng(11))
    each = max(1, TRAIN_DOCS // len(langs))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, each / n))) for k, n in counts.items()])
    sample = taught.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * float(1 << 20))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, of = [], []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                own = doc_pieces(text)
                got += own
                of += [lang] * len(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(of, pa.string()), "piece": pa.array(got, pa.binary())})

    rows = sample.mapInArrow(cut, "lang string, piece binary").limit(2 * TRAIN_PIECES).toPandas()  # twice what is expected at most
    rows = rows.sort_values(["lang", "piece"], kind="stable").sample(n=min(len(rows), TRAIN_PIECES), random_state=5)
    where = {k: i for i, k in enumerate(langs)}
    pieces = np.frombuffer(b"".join(map(bytes, rows["piece"])), np.uint8).reshape(-1, PIECE)
    return langs, fit(pieces, rows["lang"].map(where).to_numpy().astype(np.int64), len(langs))


def identify(docs: DataFrame, langs: list[str], network: dict[str, np.ndarray], into: str = "langid") -> DataFrame:
    """docs (text and any other columns) with a struct column `into`: lang_pred, score.  It replaces an input column of that name."""
    held = docs.sparkSession.sparkContext.broadcast((langs, network))  # 60 KB
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    rest = F.struct(*C.own(docs, (into.lower(),))).alias("row")
    packed = docs.select(F.col("text"), rest)

    def labelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = held.value
        for t in C.chunks(batches, C.CHUNK_BYTES // 4):  # some thousand blocks are enough to fill ROWS
            texts = t["text"].to_pylist()
            letters = np.array([bool(x) and next((True for c in x if c.isalpha()), False) for x in texts])
            prob = label_texts(p, t["text"])
            best = prob.argmax(1)
            known = letters & bool(names)
            lang = [names[i] if k else "und" for i, k in zip(best, known)]
            score = np.where(known, np.clip(prob[np.arange(len(best)), best], 0, 1), 0.0)
            out = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score.astype(float))], ["lang_pred", "score"])
            whole = pa.RecordBatch.from_arrays([t["row"].combine_chunks(), out], ["row", "langid"])
            for i in range(0, whole.num_rows, 1024):
                yield whole.slice(i, 1024)

    schema = StructType([packed.schema["row"], StructField("langid", StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))])
    out = packed.mapInArrow(labelled, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("langid").alias(into))


def op7_langid(spark, sf_dir: str) -> DataFrame:
    C.small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(C.crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    out = identify(docs.select("doc_id", "text"), *train(docs.where(~held & F.col("doc_id").isNotNull())))
    return out.select("doc_id", held.alias("held_out"), F.col("langid.lang_pred").alias("lang_pred"), F.col("langid.score").alias("score"))
