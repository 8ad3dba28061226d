"""Operator 2: exact dedup by distributed most-significant-digit radix partitioning; equality needs no digest.

Digits are runs of bytes of the normalised text, the first DIGIT long and each next one wider.
1. Every task partitions the texts it reads, digit by digit, until a group is a singleton or its texts have ended.  A group of
   equal texts leaves one representative, so a text with copies in a third of all rows leaves one for each task's chunk.
2. Representatives are dealt by their first digit.  Digits that gather more than HEAVY bytes (a header that many texts share) are
   dealt anew by a wider prefix, until none is heavy; heavy groups whose texts have ended are equal and are merged by aggregation.
3. Each task finishes its groups with the same recursion.  Members are joined back by representative.

Defined results: null text is an empty text; a null doc_id counts as larger than any other; of repeated rows (same doc_id and text)
one is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import common as C

DIGIT = 48
HEAVY = 1 << 20  # bytes of several representatives that one digit may bring to one task


def radix_groups(texts: list[bytes], digit: int = DIGIT) -> list[list[int]]:
    """Indices of equal texts: split by successive digits until a group is a singleton or has ended."""
    done, todo = [], [(range(len(texts)), 0, digit)]
    while todo:
        group, at, width = todo.pop()
        parts: dict[bytes, list[int]] = {}
        for i in group:
            parts.setdefault(texts[i][at : at + width], []).append(i)
        for d, members in parts.items():
            if len(members) == 1 or len(d) < width:
                done.append(members)
            else:
                todo.append((members, at + width, 2 * width))
    return done


_REP = "rep long, norm binary, n long, best_len long, best_id long, best_pos int, best_h long, best_g int, members array<long>, sha string"
_REPS = pa.schema([("rep", pa.int64()), ("norm", pa.binary()), ("n", pa.int64()), ("best_len", pa.int64()), ("best_id", pa.int64()), ("best_pos", pa.int32()), ("best_h", pa.int64()), ("best_g", pa.int32()), ("members", pa.list_(pa.int64())), ("sha", pa.string())])
_LAST = (1 << 63) - 1


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    rep = TaskContext.get().partitionId() << 36
    for t in C.chunks(batches):
        ids, h, g_ = (t[c].to_pylist() for c in ("doc_id", "_h", "_g"))
        original = [x or "" for x in t["text"].to_pylist()]
        norm = [x.encode().translate(None, C.SPACES) for x in original]
        rows = []
        for g in radix_groups(norm):
            best = min(range(len(g)), key=lambda j: (-len(original[g[j]]), _LAST if ids[g[j]] is None else ids[g[j]]))
            first = g[best]
            rows.append((rep, norm[first], len(g), len(original[first]), ids[first], best, h[first], g_[first], [ids[i] for i in g], hashlib.sha256(norm[first]).hexdigest()))
            rep += 1
        for i in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 1024]), _REPS)], schema=_REPS)


_CLASSES = pa.schema([("rep", pa.int64()), ("keep_rep", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in C.whole_keys(batches, "digit"):
        reps, n, best_len, best_id = (t[c].to_pylist() for c in ("rep", "n", "best_len", "best_id"))
        rows = []
        for g in radix_groups(t["norm"].to_pylist()):
            best = min(g, key=lambda i: (-best_len[i], _LAST if best_id[i] is None else best_id[i], reps[i]))
            size = sum(n[i] for i in g)
            rows += [(reps[i], reps[best], best_id[best], size) for i in g]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CLASSES)], schema=_CLASSES)


def text_key() -> list:
    """Two hashes of the original text: with the doc_id, they name a row among its equals."""
    return [F.xxhash64("text").alias("_h"), F.hash("text").alias("_g")]


def groups(docs: DataFrame, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """Representatives of the texts of (doc_id, text), and for each the one of its group that stays: (rep, keep_rep, keep_id, group_size)."""
    C.small_batches(docs.sparkSession)
    n = C.buckets_for(docs)
    reps = C.materialise(docs.select("doc_id", "text", *text_key()).mapInArrow(_local, _REP), "radix")
    cols = ["rep", "norm", "n", "best_len", "best_id"]
    active, width, out = reps.select(*cols), DIGIT, []
    while True:
        active = active.withColumn("digit", F.substring("norm", 1, width))
        size = active.groupBy("digit").agg(F.sum(F.length("norm") + 64).alias("bytes"), F.count("*").alias("many"))
        big = C.materialise(size.where((F.col("bytes") > heavy) & (F.col("many") > 1)).select("digit"), "radix-heavy")
        if big.isEmpty():
            out.append(active)
            break
        out.append(active.join(big, "digit", "left_anti").select(*cols, "digit"))
        marked = C.materialise(active.join(big, "digit", "left_semi"), "radix-round")  # heavy rows alone
        ended = marked.where(F.length("norm") < width)
        order = F.struct((-F.col("best_len")).alias("a"), F.coalesce("best_id", F.lit(_LAST)).alias("b"), F.col("rep").alias("keep_rep"), F.col("best_id").alias("keep_id"))
        merged = ended.groupBy("digit").agg(F.min(order).alias("m"), F.sum("n").alias("group_size"))
        equal = ended.join(merged, "digit").select("rep", "m.keep_rep", "m.keep_id", "group_size")
        out.append(equal)
        active, width = marked.where(F.length("norm") >= width).select(*cols), width * 4
    parts = [x if "digit" not in x.columns else C.exchange(x, n, "digit").mapInArrow(_finish, "rep long, keep_rep long, keep_id long, group_size long") for x in out]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return reps, found


def classes(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Every row of (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    reps, found = groups(docs, heavy)
    each = reps.select("rep", "best_pos", "sha", F.posexplode("members").alias("pos", "doc_id"))
    kept = (F.col("rep") == F.col("keep_rep")) & (F.col("pos") == F.col("best_pos"))
    return each.join(found, "rep").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def survivors(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The row of each group that stays, by its doc_id and the hashes of its text: doc_id, _h, _g."""
    reps, found = groups(docs, heavy)
    stay = found.where("rep = keep_rep").select("rep")
    return reps.join(stay, "rep", "left_semi").select(F.col("best_id").alias("doc_id"), F.col("best_h").alias("_h"), F.col("best_g").alias("_g"))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(C.documents(spark, sf_dir))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
