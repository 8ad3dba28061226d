"""Operator 1: token ids of documents as wavelet matrices, one compressed file per shard of ascending doc_id.

A wavelet matrix holds a sequence of numbers as bit planes, most significant first; each plane reorders what it saw, zeros before
ones, for the next.  With ranks over the planes, ``access``, ``rank`` (counting) and ``select`` (occurrence lookup) take one step
for each plane, whatever the length.  A file is one binary value (``MAGIC`` format below): executors may share nothing but what
Spark's own writers reach, so files are stored through Spark, a row each, uncompressed by Parquet since planes are compressed here.

Defined results: null text is an empty text and holds the end id alone; null doc_id sorts first; repeated doc_ids keep one entry
for each row, in order of a hash of their texts; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm import common as C
from quadrille.llm.wordbpe import encoder

MAGIC = b"QWM1"
BLOCK_BITS = 1 << 19  # bits of a plane that are compressed together
RANK_BITS = 1 << 12  # bits between rank samples
SHARD_IDS = 6_000_000  # ids of a file, but for a longer single document
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def build(ids: np.ndarray, levels: int, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of one shard: header, document directory, then for each plane its zeros, rank samples and compressed blocks."""
    pack = zstandard.ZstdCompressor(level=1).compress
    n, seq = len(ids), ids
    null = np.array([d is None for d in doc_ids], np.uint8)
    directory = pack(null.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.astype("<i8").tobytes())
    parts = [MAGIC, struct.pack("<QBQQ", n, levels, len(doc_ids), len(directory)), directory]
    for level in range(levels):
        bit = (seq & seq.dtype.type(1 << (levels - 1 - level))) != 0
        packed = np.packbits(bit, bitorder="little")
        ones = np.add.reduceat(_ONES[packed], np.arange(0, len(packed), RANK_BITS // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
        samples = pack((np.cumsum(ones) - ones).astype("<u8").tobytes())
        blocks = [pack(packed[i : i + BLOCK_BITS // 8].tobytes()) for i in range(0, len(packed), BLOCK_BITS // 8)]
        parts.append(struct.pack("<QQQ", n - int(ones.sum()), len(samples), len(blocks)))
        parts.append(np.array([len(b) for b in blocks], "<u8").tobytes())
        parts += [samples, *blocks]
        seq = np.concatenate([seq[~bit], seq[bit]])
    return b"".join(parts)


class Wavelet:
    """Reader of one file; blocks are decompressed when first touched."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        unpack = zstandard.ZstdDecompressor().decompress
        self._unpack = unpack
        self.n, self.levels, docs, size = struct.unpack_from("<QBQQ", data, 4)
        at = 4 + struct.calcsize("<QBQQ")
        directory = unpack(data[at : at + size]) if docs else b""
        at += size
        null = np.frombuffer(directory[:docs], np.uint8)
        ids = np.frombuffer(directory[docs : 9 * docs], "<i8")
        self.doc_ids = [None if x else int(d) for x, d in zip(null, ids)]
        self.lengths = np.frombuffer(directory[9 * docs :], "<i8")
        self.zeros, self._samples, self._blocks = [], [], []
        for _ in range(self.levels):
            zeros, samples, blocks = struct.unpack_from("<QQQ", data, at)
            at += 24
            sizes = np.frombuffer(data, "<u8", blocks, at).astype(int)
            at += 8 * blocks
            self.zeros.append(zeros)
            self._samples.append(np.frombuffer(unpack(data[at : at + samples]), "<u8").astype(np.int64) if self.n else np.zeros(0, np.int64))
            at += samples
            here = []
            for s in sizes:
                here.append(data[at : at + s])
                at += s
            self._blocks.append(here)
        self._open: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, b: int) -> np.ndarray:
        if (level, b) not in self._open:
            self._open[level, b] = np.frombuffer(self._unpack(self._blocks[level][b]), np.uint8)
        return self._open[level, b]

    def _bit(self, level: int, i: int) -> int:
        return self._block(level, i // BLOCK_BITS)[i % BLOCK_BITS // 8] >> (i % 8) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        if i == 0:
            return 0
        if i >= self.n:
            return self.n - self.zeros[level]
        s = i // RANK_BITS
        out, b, start = int(self._samples[level][s]), i // BLOCK_BITS, s * RANK_BITS % BLOCK_BITS // 8
        stop = i % BLOCK_BITS // 8
        raw = self._block(level, b)
        out += int(_ONES[raw[start:stop]].sum())
        return out + (bin(raw[stop] & ((1 << (i % 8)) - 1)).count("1") if i % 8 else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = int(self._bit(level, i))
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, z = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + z) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - z)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token at positions lo <= i < hi."""
        if token >> self.levels:
            return 0
        a, z = self._range(token, lo, self.n if hi is None else min(hi, self.n))
        return max(0, z - a)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0); -1 if there are not so many."""
        if token >> self.levels:
            return -1
        a, z = self._range(token, 0, self.n)
        if not 0 <= k < z - a:
            return -1
        i = a + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th bit of that value in a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            raw = np.concatenate([self._block(level, b) for b in range(len(self._blocks[level]))]) if self.n else np.zeros(0, np.uint8)
            bit = np.unpackbits(raw, count=self.n, bitorder="little").astype(bool)
            out = np.empty(self.n, kind)
            out[~bit] = seq[: self.zeros[level]]
            out[bit] = seq[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            seq = out
            self._open = {k: v for k, v in self._open.items() if k[0] != level}
        return seq


def write_shards(docs: DataFrame, tokenizer: str, end: int, name: str = "wavelet", most: int = SHARD_IDS) -> DataFrame:
    """Encode documents (doc_id, text) and store them as files: one row (shard, part, n_ids, file) each, read back from storage.
    A file is closed by the document that brings it to `most` ids."""
    C.small_batches(docs.sparkSession)
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("n_ids", pa.int64()), ("file", pa.binary())])

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, part = encoder(tokenizer), TaskContext.get().partitionId(), 0
        levels = max(1, (max(enc.tok.get_vocab_size() - 1, end)).bit_length())
        held: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal part, held, names, sizes
            ids = np.concatenate(held)
            data = build(ids, levels, names, np.concatenate(sizes))
            held, names, sizes, part = [], [], [], part + 1
            return pa.RecordBatch.from_pydict({"shard": [shard], "part": [part - 1], "n_ids": [len(ids)], "file": [data]}, schema)

        for b in batches:
            ids, at = enc.encode(b.column("text"), end)
            docs, first = b.column("doc_id").to_pylist(), 0
            have = sum(map(len, held))
            while first < len(docs):
                last = min(len(docs), int(np.searchsorted(at, at[first] + most - have)))  # up to the document that fills the file
                held.append(ids[at[first] : at[last]])
                names += docs[first:last]
                sizes.append(np.diff(at[first : last + 1]))
                have += int(at[last] - at[first])
                first = last
                if have >= most:
                    yield flush()
                    have = 0
        if names:
            yield flush()

    n = C.buckets_for(docs, 12 << 20)
    # A doc_id that many rows share, null too, spans shards: ranges also follow a hash of the text, and equal rows their numbers.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    ordered = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return C.materialise(ordered.mapInArrow(shards, "shard int, part int, n_ids long, file binary"), name, "uncompressed")


def starts_of(files: DataFrame, block: int = 1024) -> DataFrame:
    """(shard, part, before): ids of all files before each.  Prefix sums within blocks of `block` shards, then over the blocks: of
    at most 2**20 shards there are at most 1024 blocks, so no task or driver sees a row for each file."""
    own = files.select("shard", "part", "n_ids", F.expr(f"shard div {block}").alias("block"))
    within = F.sum("n_ids").over(Window.partitionBy("block").orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))
    total = own.groupBy("block").agg(F.sum("n_ids").alias("n"))
    before = total.select("block", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("first"))  # a row for each block
    return own.withColumn("here", within).join(before, "block").select("shard", "part", (F.coalesce("here", F.lit(0)) + F.coalesce("first", F.lit(0))).alias("before"))


def read_documents(files: DataFrame) -> DataFrame:
    """From the files: each document with the number of ids before it, its length and the checksum of its ids."""
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, part, data in zip(b.column("shard").to_pylist(), b.column("part").to_pylist(), b.column("file")):
                w = Wavelet(data.as_py())
                ids = w.decode().astype("<u4")
                at = np.concatenate([[0], np.cumsum(w.lengths)])
                crcs = [C.crc(ids[a:z]) for a, z in zip(at[:-1], at[1:])]
                same = lambda x: np.full(len(crcs), x, np.int32)
                yield pa.RecordBatch.from_pydict({"shard": same(shard), "part": same(part), "doc_id": w.doc_ids, "at": at[:-1], "n_tokens": w.lengths, "ids_crc32": crcs}, schema)

    found = files.select("shard", "part", "file").mapInArrow(read, "shard int, part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts_of(files), ["shard", "part"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op1_wavelet(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_documents(write_shards(C.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=1))
