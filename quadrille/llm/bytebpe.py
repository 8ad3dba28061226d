"""Operator 4: byte-level BPE by overlapping chunks.

Texts of more than CHUNK characters are cut into chunks that overlap by OVERLAP.  Chunks are rows of their own, so tasks
pre-tokenise the parts of one text in parallel.  The pre-tokenizer keeps no state: from a boundary on, its matches depend on what
follows alone.  So if a chunk's scan has a boundary where the true scan has one, it is true from there on.  Stitching walks the
chunks of a text and passes from one to the next at the first boundary that both share; where no shared boundary lies in the
overlap (one very long match, say), the scan goes on from the last true boundary until it meets one.  The pieces between the
boundaries are then encoded, each distinct piece once.  Decoding concatenates the raw bytes of the ids.

Defined results: null or empty text gives no ids and the digests of nothing; null or repeated doc_ids are kept row by row; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import common as C

CHUNK = 32_768
OVERLAP = 1_024
#: Characters behind a match that may still change it (contractions look two ahead, white space one).
MARGIN = 4


class ByteBPE:
    """Ids of pre-tokens by a rank file, through the tiktoken library; known pre-tokens are remembered up to a fixed number."""

    def __init__(self, path: str, pattern: str, known: int = 1_500_000):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(pattern).findall
        self.scan = regex.compile(pattern).finditer
        size = max(ranks.values()) + 1
        raw = [b""] * size
        for k, v in ranks.items():
            raw[v] = k
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.ranks, self.known = ranks, known
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self, pieces: list[str]) -> None:
        one = self.core._encode_single_piece
        got = [one(p.encode()) for p in pieces]
        n = np.array([len(x) for x in got], np.int64)
        k, total = len(self.index), int(n.sum())
        while k + len(pieces) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + total] = np.fromiter((y for x in got for y in x), np.uint32, total)
        self.first[k : k + len(n)] = self.used + np.cumsum(n) - n
        self.count[k : k + len(n)] = n
        self.used += total
        self.index.update(zip(pieces, range(k, k + len(pieces))))

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are given as pre-tokens, one after the other, and the n+1 offsets."""
        pieces: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            pieces += t
            ends[i + 1] = len(pieces)
        new = list(set(pieces).difference(self.index))
        if len(self.index) + len(new) > self.known:
            self.reset()
            new = list(set(pieces))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        n = self.count[at].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.arange(total[-1]) + np.repeat(self.first[at] - total[:-1], n)], total[ends]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw bytes of ids, one after the other, and where those of each text begin (n+1)."""
        n = self.raw_at[ids + 1] - self.raw_at[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.raw[np.arange(total[-1]) + np.repeat(self.raw_at[ids] - total[:-1], n)], total[at]


_CODERS: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBPE(path, pattern)
    return _CODERS[path, pattern]


def boundaries(bpe: ByteBPE, text: str, last: bool) -> np.ndarray:
    """Ends of the matches in a chunk; of a chunk with text behind it only those that this text can't change."""
    ends = np.array([m.end() for m in bpe.scan(text)], np.int64)
    return ends if last else ends[ends <= len(text) - MARGIN]


def stitch(bpe: ByteBPE, text: str, chunks: list[tuple[int, np.ndarray]]) -> list[str]:
    """Pre-tokens of a text from its chunks' boundaries [(start of the chunk, boundaries in the text)], in order."""
    cuts: list[np.ndarray] = []
    true_to = 0  # up to here the boundaries are known
    for k, (start, ends) in enumerate(chunks):
        stop = chunks[k + 1][0] if k + 1 < len(chunks) else len(text) + 1
        if k and true_to < len(text):
            near = ends[ends >= true_to]
            own = set(near.tolist())
            if true_to not in own and start != true_to:  # not in step yet: go on from the last true boundary
                step = []
                for m in bpe.scan(text, true_to):
                    true_to = m.end()
                    step.append(true_to)
                    if true_to in own:
                        break
                cuts.append(np.array(step, np.int64))
        mine = ends[ends > true_to]
        if k + 1 < len(chunks):  # leave the overlap, but for its first boundary, to the next
            over = np.searchsorted(mine, stop)
            nxt = chunks[k + 1][1]
            shared = mine[over:][np.isin(mine[over:], nxt)]
            mine = mine[: np.searchsorted(mine, shared[0], "right")] if len(shared) else mine
        if len(mine):
            cuts.append(mine)
            true_to = int(mine[-1])
    at = np.concatenate(cuts).tolist() if cuts else []
    return [text[a:z] for a, z in zip([0, *at[:-1]], at)]


def encode(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode (doc_id, text): counts and digests of the ids and of the decoded bytes; with_ids adds the ids."""
    C.small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema, kinds = pa.schema(fields), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def result(bpe: ByteBPE, names: list, texts: list[list[str]]) -> pa.RecordBatch:
        ids, at = bpe.encode(texts)
        raw, raw_at = bpe.decode(ids, at)
        le = ids.astype("<u4", copy=False)
        cols = [names, np.diff(at), [hashlib.sha256(le[a:z]).hexdigest() for a, z in zip(at[:-1], at[1:])], [hashlib.sha256(raw[a:z]).hexdigest() for a, z in zip(raw_at[:-1], raw_at[1:])]]
        if with_ids:
            cols.append([ids[a:z].astype(np.int32) for a, z in zip(at[:-1], at[1:])])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], schema=schema)

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for b in batches:
            if b.num_rows:
                yield result(bpe, b.column("doc_id").to_pylist(), [bpe.find(t) if t else [] for t in b.column("text").to_pylist()])

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for b in batches:
            ends = [boundaries(bpe, t, last).astype(np.int32) for t, last in zip(b.column("part").to_pylist(), b.column("is_last").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.list_(pa.int32()))], names=[*b.schema.names, "ends"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for _, held in C.by_key(batches, "row"):
            t = pa.Table.from_batches(held)
            order = np.argsort(t["k"].to_numpy(), kind="stable").tolist()
            parts, ends = t["part"].to_pylist(), t["ends"].to_pylist()
            text = "".join(parts[i] if j == len(order) - 1 else parts[i][:CHUNK] for j, i in enumerate(order))
            chunks = [(j * CHUNK, j * CHUNK + np.array(ends[i], np.int64)) for j, i in enumerate(order)]
            yield result(bpe, [t["doc_id"][0].as_py()], [stitch(bpe, text, chunks)])

    docs = docs.select("doc_id", "text")
    size = F.length("text")
    usual = docs.where(F.coalesce(size, F.lit(0)) <= CHUNK).mapInArrow(short, kinds)
    long = docs.where(size > CHUNK).withColumn("row", F.monotonically_increasing_id()).withColumn("size", size)
    # A last chunk that lay within the overlap of the one before it would add nothing.
    cut = long.withColumn("k", F.explode(F.sequence(F.lit(0), ((F.col("size") - OVERLAP - 1) / CHUNK).cast("int"))))
    cut = cut.select("row", "doc_id", "k", F.col("text").substr(F.col("k") * CHUNK + 1, F.lit(CHUNK + OVERLAP)).alias("part"), ((F.col("k") + 1) * CHUNK + OVERLAP >= F.col("size")).alias("is_last"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = cut.repartition(n, "row", "k").mapInArrow(scanned, "row long, doc_id long, k int, part string, is_last boolean, ends array<int>")
    return usual.unionAll(C.exchange(ends, n, "row", "k").mapInArrow(joined, kinds))


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(C.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
