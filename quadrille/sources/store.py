"""Triples over ids, stored for queries: a dictionary, the triples by predicate in two orders, and statistics of the predicates.

A query's constants are looked up once, it is planned by the stored statistics and solved on whole numbers, and the terms of its head
are put in last.  Each pattern scans the folders of its predicates alone, in the copy that is sorted by what it has constant, so
Parquet skips row groups."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans import planner
from quadrille.plans.model import Const, Pattern, Query
from quadrille.sources import triples as source

_SCHEMA = "s long, o long, p long"


@dataclass
class Store:
    spark: SparkSession
    path: str
    _known: dict[str, int] = field(default_factory=dict)

    @classmethod
    def build(cls, triples: DataFrame, path: str) -> Store:
        """Store triples(s, p, o) of terms; repeated ones count once.  Each step writes what the next one reads and then lets go of its
        shuffle files, so the disk holds one step's at a time."""
        spark = triples.sparkSession
        source.build_dictionary(triples, f"{path}/dictionary")
        source.let_go(spark)
        known = spark.read.schema("term string, id long").parquet(f"{path}/dictionary")
        ids, steps = triples, []
        for columns in ("ps", "o"):
            steps.append(source.fresh_path(spark, "encoded"))
            source.encode(ids, known, columns).write.parquet(steps[-1])
            source.let_go(spark, *steps[:-1])
            ids = spark.read.parquet(steps[-1])
        cls._write(ids, path)
        source.let_go(spark, steps[-1])
        return cls(spark, path)

    @staticmethod
    def _write(ids: DataFrame, path: str) -> None:
        for name, first in (("by_subject", "s"), ("by_object", "o")):
            then = "o" if first == "s" else "s"
            one = ids.repartitionByRange("p", first, then).dropDuplicates(["p", first, then])  # equal rows are in one range
            one.sortWithinPartitions("p", first, then).write.partitionBy("p").parquet(f"{path}/{name}")
            source.let_go(ids.sparkSession)
        # each copy is sorted by what is counted in it, so tasks hand on few rows
        read = lambda name: ids.sparkSession.read.schema(_SCHEMA).parquet(f"{path}/{name}")
        subjects = read("by_subject").groupBy("p").agg(F.count("*").alias("n_triples"), F.countDistinct("s").alias("n_subjects"))
        objects = read("by_object").groupBy("p").agg(F.countDistinct("o").alias("n_objects"))
        subjects.join(objects, "p").coalesce(1).write.parquet(f"{path}/predicates")  # a row for each predicate
        source.let_go(ids.sparkSession)

    def insert(self, triples: DataFrame, path: str) -> Store:
        """A new store with these triples added: known terms keep their ids."""
        terms = triples.select(F.explode(F.array("s", "p", "o")).alias("term"))
        source.extend_dictionary(self.dictionary, terms).write.parquet(f"{path}/dictionary")
        new = source.encode(triples, self.spark.read.parquet(f"{path}/dictionary"))
        self._write(source.stored(source.insert(self.triples, new), "encoded"), path)
        return Store(self.spark, path)

    @functools.cached_property
    def dictionary(self) -> DataFrame:
        return self.spark.read.schema("term string, id long").parquet(f"{self.path}/dictionary")

    @functools.cached_property
    def triples(self) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/by_subject").select("s", "p", "o")

    @functools.cached_property
    def by_object(self) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/by_object").select("s", "p", "o")

    @functools.cached_property
    def stats(self) -> dict[int, tuple[int, int, int]]:
        """Of each predicate its triples, subjects and objects; read once."""
        return {r.p: (r.n_triples, r.n_subjects, r.n_objects) for r in self.spark.read.parquet(f"{self.path}/predicates").collect()}

    def ids(self, *terms: str) -> dict[str, int]:
        """Ids of terms, asked once each; 0 for unknown ones."""
        new = [t for t in dict.fromkeys(terms) if t not in self._known]
        if new:
            self._known |= source.lookup(self.dictionary, *new)
        return {t: self._known[t] for t in terms}

    def encode(self, query: Query) -> Query | None:
        """The query over ids; None if a position knows none of its terms, so that nothing can match."""
        known = self.ids(*[t for p in query.body for _, x in p.positions if isinstance(x, Const) for t in x.terms])
        body = []
        for p in query.body:
            new = [Const(tuple(known[t] for t in x.terms if known[t]) or (0,)) if isinstance(x, Const) else x for _, x in p.positions]
            if any(isinstance(x, Const) and x.terms == (0,) for x in new):
                return None
            body.append(Pattern(*new))
        return Query(list(query.head), body)

    def scan(self, pattern: Pattern) -> DataFrame:
        """The copy to scan for a pattern over ids."""
        return self.by_object if isinstance(pattern.o, Const) and not isinstance(pattern.s, Const) else self.triples

    def solve(self, query: Query, distinct: bool = False, decoded: bool = True) -> DataFrame:
        query.check()
        coded = self.encode(query)
        if coded is None:
            return self.spark.createDataFrame([], ", ".join(f"`{v}` {'string' if decoded else 'long'}" for v in query.head))
        out = planner.solve(self.scan, coded, self.stats, distinct)
        return source.decode(out, self.dictionary, *query.head) if decoded and query.head else out
