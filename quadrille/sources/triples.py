"""Triples: reading, writing, deriving them from relational tables, dictionary encoding."""

from __future__ import annotations

import atexit
import functools
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.hashing import jump_hash
from quadrille.plans.model import Const, Pattern

TYPE = "rdf:type"
TYPE_ID = 1  # reserved; 0 stands for unknown

#: table, subject prefix and key, then (predicate, prefix of the object or None, column or constant).  Fixed values of the view.
VIEW = [
    ("region", "region/", "r_regionkey", [(TYPE, None, "'Region'"), ("label", None, "r_name")]),
    ("nation", "nation/", "n_nationkey", [(TYPE, None, "'Nation'"), ("inRegion", "region/", "n_regionkey"), ("label", None, "n_name")]),
    ("customer", "customer/", "c_custkey", [(TYPE, None, "'Customer'"), ("inNation", "nation/", "c_nationkey"), ("segment", None, "c_mktsegment")]),
    ("supplier", "supplier/", "s_suppkey", [(TYPE, None, "'Supplier'"), ("inNation", "nation/", "s_nationkey")]),
    ("part", "part/", "p_partkey", [(TYPE, None, "'Part'"), ("brand", None, "p_brand"), ("ptype", None, "p_type")]),
    ("orders", "order/", "o_orderkey", [(TYPE, None, "'Order'"), ("placedBy", "customer/", "o_custkey"), ("priority", None, "o_orderpriority"), ("status", None, "o_orderstatus")]),
    ("lineitem", "order/", "l_orderkey", [("containsPart", "part/", "l_partkey"), ("suppliedBy", "supplier/", "l_suppkey")]),
    ("events", "customer/", "user_id", [("did", None, "event_type")]),
]
#: Predicates whose rows may repeat in their table; the others are unique by the table's key.
REPEATED = {"containsPart", "suppliedBy", "did"}


def _keys(terms, prefix: str) -> list[int]:
    """Numbers of the terms that are this prefix and a number."""
    rest = [t[len(prefix) :] for t in terms if t.startswith(prefix)]
    return [int(x) for x in rest if x.isdigit() and str(int(x)) == x]


def rdfize(spark: SparkSession, sf_dir: str, predicates: set[str] | None = None, subjects: Iterable[str] | None = None, objects: Iterable[str] | None = None) -> DataFrame:
    """triples(s, p, o) of the relational tables, as a set.  Each predicate is its own branch with a constant p, so a query on one
    predicate reads one table and two columns; only branches whose rows repeat are made distinct.  With predicates, subjects or objects
    given, other triples are left out: branches that hold none are not planned, tables without a branch are not opened, and the
    rest become filters on key columns, which reach the Parquet scan."""
    parts = []
    for table, prefix, key, facts in VIEW:
        facts = [x for x in facts if predicates is None or x[0] in predicates]
        own = None if subjects is None else _keys(subjects, prefix)
        if not facts or own == []:
            continue
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        rows = rows if own is None else rows.where(F.col(key).isin(*own))
        subject = F.concat(F.lit(prefix), F.col(key).cast("string")).alias("s")
        for p, to, column in facts:
            constant = column.startswith("'")
            o = F.lit(column[1:-1]) if constant else F.concat(F.lit(to), F.col(column).cast("string")) if to else F.col(column)
            known = F.col(key).isNotNull() if constant else F.col(key).isNotNull() & F.col(column).isNotNull()
            if objects is not None:
                wanted = [x for x in objects if x == column[1:-1]] if constant else _keys(objects, to) if to else list(objects)
                if not wanted:
                    continue
                known = known if constant else known & F.col(column).isin(*wanted)
            pairs = rows.where(known).select(key, column).distinct() if p in REPEATED else rows.where(known)
            parts.append(pairs.select(subject, F.lit(p).alias("p"), o.alias("o")))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], "s string, p string, o string")


def scans(spark: SparkSession, sf_dir: str) -> Callable[[Pattern], DataFrame]:
    """For the planner: the triples of the tables that one pattern can match."""
    terms = lambda x: x.terms if isinstance(x, Const) else None
    return lambda p: rdfize(spark, sf_dir, set(p.p.terms) if isinstance(p.p, Const) else None, terms(p.s), terms(p.o))


def rdfize_sql(predicates: Iterable[str] | None = None) -> str:
    """The same view in SQL, for a WITH clause or a FROM clause; with predicates given, these alone."""
    rows = []
    for table, prefix, key, facts in VIEW:
        for p, to, column in facts:
            if predicates is None or p in predicates:
                o = f"'{to}' || {column}" if to else column
                rows.append(f"SELECT '{prefix}' || {key} AS s, '{p}' AS p, {o} AS o FROM {table} WHERE {key} IS NOT NULL" + ("" if column.startswith("'") else f" AND {column} IS NOT NULL"))
    return f"SELECT DISTINCT s, p, o FROM ({' UNION ALL '.join(rows)})" if rows else "SELECT '' AS s, '' AS p, '' AS o WHERE false"


# ---------------------------------------------------------------- other views: rules in the SQL that Spark and DuckDB share


Rules = list[tuple[str, str, list[tuple[str, str]]]]


def derive(spark: SparkSession, sf_dir: str, rules: Rules, predicates: set[str] | None = None, distinct: bool = True) -> DataFrame:
    """triples(s, p, o) by rules (table, subject, [(predicate, object)]), subjects and objects being SQL expressions; null ones give none.
    Not distinct: triples may repeat, for callers that make them a set later."""
    parts = []
    for table, subject, facts in rules:
        own = [x for x in facts if predicates is None or x[0] in predicates]
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet") if own else None
        parts += [rows.select(F.expr(subject).alias("s"), F.lit(p).alias("p"), F.expr(o).cast("string").alias("o")) for p, o in own]
    out = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], "s string, p string, o string")
    out = out.where("s is not null and o is not null")
    return out.distinct() if distinct else out


def derive_sql(rules: Rules, predicates: set[str] | None = None) -> str:
    rows = [f"SELECT {s} AS s, '{p}' AS p, ({o})::VARCHAR AS o FROM {table}" for table, s, facts in rules for p, o in facts if predicates is None or p in predicates]
    return f"SELECT DISTINCT s, p, o FROM ({' UNION ALL '.join(rows)}) WHERE s IS NOT NULL AND o IS NOT NULL"


# ---------------------------------------------------------------- files


def read_text(spark: SparkSession, *paths: str, ids: bool = False) -> DataFrame:
    """N-Triples-like lines `s p o [.]`; ids: the terms are integers.  Blank lines, comments and short lines are skipped."""
    raw = spark.read.text(list(paths)).where(~F.col("value").rlike(r"^\s*(#|$)"))
    cut = raw.select(*[F.regexp_extract("value", r"^\s*(\S+)\s+(\S+)\s+(.*?\S)\s*\.?\s*$", i).alias(c) for i, c in enumerate("spo", 1)])
    out = cut.where("s <> ''").dropDuplicates()
    return out.select(*[F.col(c).cast("long").alias(c) for c in "spo"]) if ids else out


def read_dictionary(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines `<term> <white space> <id>`: dict(term, id)."""
    raw = spark.read.text(list(paths))
    return raw.select(F.regexp_extract("value", r"^(.*\S)\s+(\d+)\s*$", 1).alias("term"), F.expr("try_cast(regexp_extract(value, '(\\\\d+)\\\\s*$', 1) as bigint)").alias("id")).where("term <> '' and id is not null").dropDuplicates()


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """An initial placement, lines `<vertex> <part>`: vloc(v, server)."""
    two = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(two[0].cast("long").alias("v"), two[1].cast("int").alias("server")).where("v is not null")


def dictionary_path(folder: str, stem: str = "str_normal") -> str:
    """The dictionary file of a folder: the first by name that holds the stem."""
    found = sorted(str(p) for p in Path(folder).iterdir() if stem in p.name)
    if not found:
        raise FileNotFoundError(f"no file named like {stem!r} in {folder}")
    return found[0]


def load(spark: SparkSession, *paths: str, ids: bool = False, into: str | None = None) -> DataFrame:
    """Bulk load of many text files as one set of triples; into: written there by predicate and read from there."""
    rows = read_text(spark, *paths, ids=ids)
    if into is None:
        return rows
    write(rows, into)
    return read(spark, into) if not ids else spark.read.parquet(into).select("s", F.col("p").cast("long").alias("p"), "o")


def write(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, one folder for each predicate (vertical partitioning), clustered by subject within files.  Few predicates hold most
    triples, so rows are dealt by (p, s), not by p alone."""
    triples.repartition("p", "s").sortWithinPartitions("p", "s").write.mode(mode).partitionBy("p").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("s", F.col("p").cast("string").alias("p"), "o")


def insert(triples: DataFrame, more: DataFrame) -> DataFrame:
    """Set union."""
    return triples.unionByName(more).dropDuplicates(["s", "p", "o"])


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a folder of this process if all tasks run in it, as in tests."""
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


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession, *paths: str) -> None:
    """Delete these paths and the shuffle files of frames that nothing refers to; Spark keeps these until the driver collects its garbage."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()


def build_dictionary(triples: DataFrame, path: str | None = None) -> DataFrame:
    """dict(term, id) of all terms, stored (at path, if given): each use of it must see the same ids, which a range partitioning made anew would not
    promise.  rdf:type is 1; the rest get ids in ranges: unique, never 0 or 1, and made without one global sort in one task."""
    terms = triples.select(F.explode(F.array("s", "p", "o")).alias("term")).distinct()
    path = path or fresh_path(triples.sparkSession, "dictionary")
    ids = terms.where(F.col("term") != TYPE).repartitionByRange("term").sortWithinPartitions("term").select("term", (F.monotonically_increasing_id() + 2).alias("id"))
    known = ids.unionAll(terms.where(F.col("term") == TYPE).select("term", F.lit(TYPE_ID).cast("long").alias("id")))
    known.write.parquet(path)
    return triples.sparkSession.read.schema(known.schema).parquet(path)


def encode(triples: DataFrame, dictionary: DataFrame, columns: str = "pso") -> DataFrame:
    """Terms to ids in some columns; a triple with an unknown term is dropped, as an unknown term matches nothing.  Predicates are few
    and most triples have one of very few, so their part of the dictionary goes to the triples."""
    out = triples
    for c in columns:
        known = dictionary.select(F.col("term").alias(c), F.col("id").alias(f"{c}_id"))
        if c == "p":
            known = F.broadcast(known.join(F.broadcast(triples.select("p").distinct()), "p", "left_semi"))
        out = out.join(known, c).drop(c).withColumnRenamed(f"{c}_id", c)
    return out.select("s", "p", "o")


def decode(rows: DataFrame, dictionary: DataFrame, *columns: str) -> DataFrame:
    """Ids to terms in the named columns (all if none is named)."""
    out, order = rows, rows.columns
    for c in columns or order:
        out = out.join(dictionary.select(F.col("id").alias(c), F.col("term").alias("_term")), c).drop(c).withColumnRenamed("_term", c)
    return out.select(*order)


def lookup(dictionary: DataFrame, *terms: str) -> dict[str, int]:
    """Ids of a query's constants; an unknown term has id 0."""
    found = {r.term: r.id for r in dictionary.where(F.col("term").isin(*terms)).collect()}  # as many rows as constants
    return {t: found.get(t, 0) for t in terms}


def extend_dictionary(dictionary: DataFrame, terms: DataFrame) -> DataFrame:
    """The dictionary with terms(term) added: known terms keep their ids, new ones get ids above all of these."""
    new = terms.select("term").where("term is not null").distinct().join(dictionary, "term", "left_anti")
    top = dictionary.agg(F.coalesce(F.max("id"), F.lit(TYPE_ID))).first()[0]
    return stored(dictionary.select("term", "id").unionAll(new.repartitionByRange("term").select("term", (F.monotonically_increasing_id() + top + 1).alias("id"))), "dictionary")


def hosts_of_terms(dictionary: DataFrame, terms: DataFrame, servers: int) -> DataFrame:
    """(term, id, server): the home of each of terms(term); an unknown term has id 0 and no server."""
    known = terms.select("term").distinct().join(dictionary, "term", "left")
    return known.select("term", F.coalesce("id", F.lit(0)).alias("id"), jump_hash("id", servers).alias("server"))
