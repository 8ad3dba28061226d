"""What the training-data operators share: shared storage, byte-level word vectors, and packed exchanges.

The operators move millions of small hashes between tasks.  Rows of one hash each would cost far more in the JVM than the
eight bytes are worth, so a task packs what it has for one bucket into one binary value and sends that ("packed exchange").
Every bucket count follows the input's size, so a bucket stays small whatever the input.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts have it: [\x20\x09-\x0D]; bytes.split() splits on exactly these.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
CHUNK_BYTES = 16 << 20
U64 = np.uint64


# ---------------------------------------------------------------- storage and sizes


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; where that is unset, below a folder of this process if all tasks run in it, as in tests.
    On a cluster an unset folder is an error: executors do not see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{_own_folder()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@functools.cache
def _own_folder() -> str:
    """A temporary folder of this process, deleted at its end."""
    path = tempfile.mkdtemp(prefix="quadrille-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


WRITTEN: list[str] = []  # what materialise has written


def release(docs: DataFrame, paths: list[str]) -> None:
    """Delete these paths and take them off the list, but for what docs reads."""
    used = docs.inputFiles() if paths else []
    for path in list(paths):
        if not any(f"/{path.rpartition('/')[2]}/" in f for f in used):
            at = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            paths.remove(path)


def sweep(spark: SparkSession) -> None:
    """Delete all that materialise has written in this process: for callers that have taken or stored their results."""
    for path in WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    WRITTEN.clear()


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1024, size: int = 8 << 20) -> None:
    """Arrow batches of few rows and bytes: a batch of long texts or packed values must fit beside its neighbours in an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


UNKNOWN = 1 << 62  # the optimizer's estimate of what it knows nothing about is 2**63 - 1, before it scales it by columns


def size_of(df: DataFrame) -> int:
    """Bytes of df: the optimizer's estimate, at most that of its leaves (joins multiply); measured where a leaf has none."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if all(x < UNKNOWN for x in sizes):
        return min(int(str(plan.stats().sizeInBytes())), sum(sizes))
    flat, total = df.toDF(*[f"c{i}" for i in range(len(df.columns))]), F.lit(16 * len(df.columns))
    for f in flat.schema:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            total += F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind.startswith("array"):
            total += F.greatest(F.size(f.name), F.lit(0)) * 8
    return flat.agg(F.sum(total.cast("long"))).first()[0] or 0


def buckets_for(df: DataFrame, bytes_each: int = 8 << 20, size: int | None = None) -> int:
    """How many buckets an exchange of data in proportion to df gets; size: its bytes, where they are known already."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min((size_of(df) if size is None else size) // bytes_each + 1, 1 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def own(docs: DataFrame, but: tuple[str, ...] = ()) -> list:
    """The columns of docs by their exact names, whatever characters these hold, without some (in any case of letters)."""
    return [F.col(f"`{c.replace('`', '``')}`").alias(c) for c in docs.columns if c.lower() not in but]


def free_name(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(doc_id, m: int):
    """crc32 of the id as text, modulo m, as a column; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


# ---------------------------------------------------------------- texts as bytes


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the n+1 offsets; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], U64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts, and for each text where its words begin (n+1)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~_IS_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes, eight bytes a step; another seed gives an independent hash."""
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    lengths = ends - starts
    h = mix(lengths.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    live, k = None, 0
    while True:
        if k == 0:
            h = mix((h ^ (eight[starts] & _KEEP[np.minimum(lengths, 8)])) * U64(0xD6E8FEB86659FD93))
        else:
            h[live] = mix((h[live] ^ (eight[starts[live] + k] & _KEEP[np.minimum(lengths[live] - k, 8)])) * U64(0xD6E8FEB86659FD93))
        k += 8
        live = np.flatnonzero(lengths > k) if live is None else live[lengths[live] > k]
        if not len(live):
            return h


_BASE = 0x9FB21C651E98DF25


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of every n consecutive entries: doubling, so about 2*log2(n) passes."""
    if len(words) < n:
        return np.zeros(0, U64)
    done, have, power, out = words, 1, _BASE, None
    bits, used = n, 0
    acc: np.ndarray | None = None
    while bits:
        if bits & 1:
            if acc is None:
                acc = done
            else:  # acc covers `used` words, done the next `have`
                m = min(len(acc), len(done) - used)
                acc = acc[:m] * U64(power) + done[used : used + m]
            used += have
        bits >>= 1
        if bits:
            m = len(done) - have
            done = done[:m] * U64(power) + done[have : have + m]
            have *= 2
            power = power * power % (1 << 64)
    out = acc
    return mix(out[: len(words) - n + 1])


def windows_of(word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows of n words that lie within one text, and for each text where its windows begin (n+1)."""
    per = np.maximum(np.diff(word_offsets) - n + 1, 0)
    at = np.concatenate([[0], np.cumsum(per)])
    pos = np.arange(at[-1]) + np.repeat(word_offsets[:-1] - at[:-1], per)
    return pos, at


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's n-word shingles (fewer words: the whole sequence as one), with repeats, and their offsets."""
    starts, ends, words_at = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    pos, at = windows_of(words_at, n)
    all_windows = rolling(h, n)
    values = all_windows[pos] if len(pos) else np.zeros(0, U64)
    counts = np.diff(words_at)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), U64)
        left = words_at[short].copy()
        for k in range(n - 1):
            on = counts[short] > k
            extra[on] = extra[on] * U64(_BASE) + h[left[on] + k] + U64(1)
        extra = mix(extra + counts[short].astype(U64))
        per = np.diff(at)
        per[short] = 1
        new_at = np.concatenate([[0], np.cumsum(per)])
        out = np.empty(new_at[-1], U64)
        is_short = np.zeros(len(out), bool)
        is_short[new_at[short]] = True
        out[is_short] = extra
        out[~is_short] = values
        return out, new_at
    return values, at


def distinct_per_text(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text."""
    v = values.copy()
    for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
        v[a:z].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    keep[at[:-1][at[:-1] < len(v)]] = True
    return v[keep], np.concatenate([[0], np.cumsum(keep)])[at]


# ---------------------------------------------------------------- chunks and packed exchanges


def chunks(batches: Iterable[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Arrow batches joined until they hold about `size` bytes: what one step of a task works on."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_key(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Runs of rows with one key, of batches that are sorted by it: all rows of a key are held at once, so keys are buckets whose number
    follows the input, and what is sent to one bucket is summed before."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, z in zip(cuts[:-1], cuts[1:]):
            if held and now != k[a]:
                yield now, held
                held = []
            now = k[a]
            held.append(b.slice(a, z - a))
    if held:
        yield now, held


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that puts entries of a bucket together, and the n+1 offsets of the buckets."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))])


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high 32 bits."""
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def exchange(df: DataFrame, n: int, key: str, *then: str) -> DataFrame:
    """Rows of a key together, and sorted by it (and by `then`).  A whole number, such as a bucket's, is dealt by its rest modulo n: n
    buckets fill n partitions, where their hashes would leave a third of these empty and put several buckets in others."""
    if df.schema[key].dataType.typeName() in ("integer", "long"):
        return df.repartitionById(n, F.pmod(F.col(key).cast("long"), F.lit(n).cast("long")).cast("int")).sortWithinPartitions(key, *then)
    return df.repartition(n, key).sortWithinPartitions(key, *then)


@functools.cache
def _trim():
    """glibc's malloc_trim; where there is none, nothing."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system: the allocators of Python and Arrow keep it, and workers live through many tasks."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def crc(values: np.ndarray) -> int:
    return zlib.crc32(values.astype("<u4", copy=False).tobytes()) & 0xFFFFFFFF


def whole_keys(batches: Iterable[pa.RecordBatch], key: str, size: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Batches sorted by a key, joined to tables of about `size` bytes that never part the rows of one key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        if n >= size:
            i = b.schema.get_field_index(key)
            last, keys = held[-1].column(i)[-1], b.column(i)
            same = 0
            while same < b.num_rows and keys[same] == last:
                same += 1
            if same:
                held.append(b.slice(0, same))
            if same < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                b = b.slice(same)
                held, n = [], 0
            else:
                continue
        held.append(b)
        n += b.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one value: their kinds and lengths, then their bytes."""
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), len(a))]], "<i8")
    return b"".join([head.tobytes(), *[a.tobytes() for a in arrays]])


def unpack_arrays(data: pa.Buffer | bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 2 * k, 8).tolist()
    at, out = 8 + 16 * k, []
    for char, n in zip(head[::2], head[1::2]):
        out.append(np.frombuffer(data, np.dtype(chr(char)), n, at))
        at += n * out[-1].itemsize
    return out


def blobs(column: pa.Array) -> Iterator[list[np.ndarray]]:
    for x in column:
        yield unpack_arrays(x.as_buffer())


def runs_of(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions of the runs of equal neighbours, and the runs' lengths."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    return first, np.diff(np.concatenate([first, [len(owner)]]))
