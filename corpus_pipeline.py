"""The corpus pipeline: language ID, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), where docs has been written and reread, so it first deletes what earlier stages left in the
shared folder; it works on all rows that its predecessor kept; all but the last return the columns of
documents.  ``run`` writes each stage's rows in the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import common, exact_dedup, langid, ngram_join, packing, substring_dedup

#: Texts are rejected that have no letter, or whose language is less sure than this.
LEAST_SCORE = 0.3
_LEFT: list[str] = []  # intermediate results of stages whose rows are not yet known to be stored


def _stage(f):
    """Before a stage runs, its predecessors' rows are stored: what they left in the shared folder goes."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(docs, _LEFT)
        before = len(common.WRITTEN)
        out = f(spark, docs, sf_dir)
        _LEFT.extend(common.WRITTEN[before:])
        return out

    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that read as one of the languages of `lang`, as learned from all of docs.  Null texts, empty ones and those without a
    letter go, and all go where there is no language to learn; repeated rows are read each."""
    common.small_batches(spark)
    found = common.free_name(docs, "langid")
    out = langid.identify(docs, *langid.train(docs.select("doc_id", "text", "lang")), into=found)
    return out.where((F.col(f"{found}.lang_pred") != "und") & (F.col(f"{found}.score") >= LEAST_SCORE)).select(*common.own(docs))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts: the longest original, then the smallest doc_id; of several rows of that doc_id and text one.  A null
    text is empty, a null doc_id larger than all others; an empty table stays empty."""
    keep = exact_dedup.survivors(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_null"), "_h", "_g")
    key = ["_id", "_null", "_h", "_g"]
    rows = docs.select(F.struct(*common.own(docs)).alias("row"), F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_null"), *exact_dedup.text_key())
    stay = rows.join(keep, key, "left_semi")
    # Rows of one doc_id and equal text are alike to here; the semi-join has dealt them by the same key.
    return stay.groupBy(*key).agg(F.first("row").alias("row")).select("row.*")


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of texts whose 5-word shingles are at least 80 % alike.  Rows without doc_id or without a
    word stay, as do all rows of a doc_id that stays; an empty table stays empty."""
    found = ngram_join.near_duplicates(docs, shingle=5, percent=80)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*common.own(docs))


@_stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words in 20-word windows that occurred earlier; n_chars follows the text.  Null texts stay null; rows of one doc_id and text
    are one document; a null doc_id comes last; an empty table stays empty."""
    found = common.free_name(docs, "dedup")
    out = substring_dedup.remove_repeats(docs, into=found)
    changed, kept = F.col(f"{found}.n_removed") > 0, F.col(f"{found}.kept")
    new = {"text": F.when(changed, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*common.own(docs))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 4096 ids: null text is the end id alone, null doc_ids stay null, repeated rows are packed each, an empty table
    gives no rows."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings), ("packing", pack)]

#: The stages hold a trained network, graph components and a tokenizer; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[str] = []
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        stored, last = last, common.WRITTEN[-1:]
        common.release(docs, stored)
    return STAGES[-1][1](spark, docs, sf_dir)
