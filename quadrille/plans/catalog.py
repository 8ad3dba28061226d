"""The built-in query banks, and workloads made from them."""

from __future__ import annotations

import random
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.plans.model import Const, Pattern, Query, parse_queries, q

# The banks' queries in their registered order (heads and bodies).
LUBM = [
    ("?X", "?X rdf:type ub:GraduateStudent . ?X ub:takesCourse <http://www.Department0.University0.edu/GraduateCourse0>"),
    ("?X ?Y ?Z", "?X rdf:type ub:GraduateStudent . ?Y rdf:type ub:University . ?Z rdf:type ub:Department . ?X ub:memberOf ?Z . ?Z ub:subOrganizationOf ?Y . ?X ub:undergraduateDegreeFrom ?Y"),
    ("?X", "?X rdf:type ub:Publication . ?X ub:publicationAuthor <http://www.Department0.University0.edu/AssistantProfessor0>"),
    ("?X ?Y1 ?Y2 ?Y3", "?X rdf:type {ub:FullProfessor, ub:AssociateProfessor, ub:AssistantProfessor} . ?X ub:worksFor <http://www.Department0.University0.edu> . ?X ub:name ?Y1 . ?X ub:emailAddress ?Y2 . ?X ub:telephone ?Y3"),
    ("?X", "?X rdf:type {ub:FullProfessor, ub:AssociateProfessor, ub:AssistantProfessor, ub:GraduateStudent, ub:UndergraduateStudent} . ?X ub:memberOf <http://www.Department0.University0.edu>"),
    ("?X", "?X rdf:type {ub:GraduateStudent, ub:UndergraduateStudent}"),
    ("?X ?Y", "?X rdf:type {ub:GraduateStudent, ub:UndergraduateStudent} . ?Y rdf:type ub:Course . ?X ub:takesCourse ?Y . <http://www.Department0.University0.edu/AssociateProfessor0> ub:teacherOf ?Y"),
    ("?X ?Y ?Z", "?X rdf:type {ub:GraduateStudent, ub:UndergraduateStudent} . ?Y rdf:type ub:Department . ?X ub:memberOf ?Y . ?Y ub:subOrganizationOf <http://www.University0.edu> . ?X ub:emailAddress ?Z"),
    ("?X ?Y ?Z", "?X rdf:type {ub:GraduateStudent, ub:UndergraduateStudent} . ?Y rdf:type {ub:Lecturer, ub:FullProfessor, ub:AssociateProfessor, ub:AssistantProfessor} . ?Z rdf:type ub:Course . ?X ub:advisor ?Y . ?Y ub:teacherOf ?Z . ?X ub:takesCourse ?Z"),
    ("?X", "?X rdf:type {ub:GraduateStudent, ub:UndergraduateStudent} . ?X ub:takesCourse <http://www.Department0.University0.edu/GraduateCourse0>"),
    ("?X", "?X rdf:type ub:ResearchGroup . ?X ub:subOrganizationOf <http://www.University0.edu>"),
    ("?X ?Y", "?X ub:headOf ?Z . ?Y rdf:type ub:Department . ?Y ub:subOrganizationOf <http://www.University0.edu> . ?Z rdf:type ub:Department . ?X ub:worksFor ?Y"),
    ("?X", "?X rdf:type {ub:FullProfessor, ub:AssociateProfessor, ub:AssistantProfessor, ub:GraduateStudent, ub:UndergraduateStudent} . ?X {ub:undergraduateDegreeFrom, ub:mastersDegreeFrom, ub:doctoralDegreeFrom} <http://www.Department0.University0.edu>"),
    ("?X", "?X rdf:type ub:UndergraduateStudent"),
]
WATDIV = [
    ("?v0 ?v2 ?v3", "?v0 wsdbm:subscribes wsdbm:Website6244 . ?v2 sorg:caption ?v3 . ?v0 wsdbm:likes ?v2"),
    ("?v1 ?v2", "wsdbm:City142 gn:parentCountry ?v1 . ?v2 wsdbm:likes wsdbm:Product0 . ?v2 sorg:nationality ?v1"),
    ("?v0 ?v1", "?v0 wsdbm:likes ?v1 . ?v0 wsdbm:subscribes wsdbm:Website31204"),
    ("?v0 ?v2", "?v0 og:tag wsdbm:Topic124 . ?v0 sorg:caption ?v2"),
    ("?v0 ?v1 ?v3", "?v0 sorg:jobTitle ?v1 . wsdbm:City21 gn:parentCountry ?v3 . ?v0 sorg:nationality ?v3"),
    ("?v0 ?v1 ?v3 ?v4 ?v5 ?v6 ?v7 ?v8 ?v9", "?v0 gr:includes ?v1 . wsdbm:Retailer346 gr:offers ?v0 . ?v0 gr:price ?v3 . ?v0 gr:serialNumber ?v4 . ?v0 gr:validFrom ?v5 . ?v0 gr:validThrough ?v6 . ?v0 sorg:eligibleQuantity ?v7 . ?v0 sorg:eligibleRegion ?v8 . ?v0 sorg:priceValidUntil ?v9"),
    ("?v0 ?v1 ?v3", "?v0 dc:Location ?v1 . ?v0 sorg:nationality wsdbm:Country21 . ?v0 wsdbm:gender ?v3 . ?v0 rdf:type wsdbm:Role2"),
    ("?v0 ?v2 ?v3 ?v4", "?v0 rdf:type wsdbm:ProductCategory1 . ?v0 sorg:caption ?v2 . ?v0 wsdbm:hasGenre ?v3 . ?v0 sorg:publisher ?v4"),
    ("?v0 ?v2 ?v3", "?v0 foaf:age wsdbm:AgeGroup2 . ?v0 foaf:familyName ?v2 . ?v3 mo:artist ?v0 . ?v0 sorg:nationality wsdbm:Country1"),
    ("?v0 ?v2 ?v3", "?v0 rdf:type wsdbm:ProductCategory14 . ?v0 sorg:description ?v2 . ?v0 sorg:keywords ?v3 . ?v0 sorg:language wsdbm:Language0"),
    ("?v0 ?v1 ?v2", "?v0 mo:conductor ?v1 . ?v0 rdf:type ?v2 . ?v0 wsdbm:hasGenre wsdbm:SubGenre44"),
    ("?v0 ?v1 ?v2", "?v0 rdf:type ?v1 . ?v0 sorg:text ?v2 . wsdbm:User534664 wsdbm:likes ?v0"),
    ("?v0 ?v2 ?v3 ?v4 ?v5", "?v0 og:tag wsdbm:Topic245 . ?v0 rdf:type ?v2 . ?v3 sorg:trailer ?v4 . ?v3 sorg:keywords ?v5 . ?v3 wsdbm:hasGenre ?v0 . ?v3 rdf:type wsdbm:ProductCategory2"),
    ("?v0 ?v1 ?v2 ?v4 ?v5 ?v6 ?v7", "?v0 foaf:homepage ?v1 . ?v0 og:title ?v2 . ?v0 rdf:type ?v3 . ?v0 sorg:caption ?v4 . ?v0 sorg:description ?v5 . ?v1 sorg:url ?v6 . ?v1 wsdbm:hits ?v7 . ?v0 wsdbm:hasGenre wsdbm:SubGenre91"),
    ("?v0 ?v1 ?v2 ?v4 ?v5 ?v6", "?v0 sorg:contentRating ?v1 . ?v0 sorg:contentSize ?v2 . ?v0 wsdbm:hasGenre wsdbm:SubGenre42 . ?v4 wsdbm:makesPurchase ?v5 . ?v5 wsdbm:purchaseDate ?v6 . ?v5 wsdbm:purchaseFor ?v0"),
    ("?v0 ?v1 ?v2 ?v4 ?v5 ?v6 ?v7 ?v8", "?v0 foaf:homepage ?v1 . ?v2 gr:includes ?v0 . ?v0 og:tag wsdbm:Topic245 . ?v0 sorg:description ?v4 . ?v0 sorg:contentSize ?v8 . ?v1 sorg:url ?v5 . ?v1 wsdbm:hits ?v6 . ?v1 sorg:language wsdbm:Language0 . ?v7 wsdbm:likes ?v0"),
    ("?v0 ?v1 ?v3 ?v4 ?v5 ?v6", "?v0 gr:includes ?v1 . wsdbm:Retailer10487 gr:offers ?v0 . ?v0 gr:price ?v3 . ?v0 gr:validThrough ?v4 . ?v1 og:title ?v5 . ?v1 rdf:type ?v6"),
    ("?v0 ?v4 ?v6 ?v7", "?v0 sorg:caption ?v1 . ?v0 sorg:text ?v2 . ?v0 sorg:contentRating ?v3 . ?v0 rev:hasReview ?v4 . ?v4 rev:title ?v5 . ?v4 rev:reviewer ?v6 . ?v7 sorg:actor ?v6 . ?v7 sorg:language ?v8"),
    ("?v0 ?v3 ?v4 ?v8", "?v0 sorg:legalName ?v1 . ?v0 gr:offers ?v2 . ?v2 sorg:eligibleRegion wsdbm:Country5 . ?v2 gr:includes ?v3 . ?v4 sorg:jobTitle ?v5 . ?v4 foaf:homepage ?v6 . ?v4 wsdbm:makesPurchase ?v7 . ?v7 wsdbm:purchaseFor ?v3 . ?v3 rev:hasReview ?v8 . ?v8 rev:totalVotes ?v9"),
    ("?v0", "?v0 wsdbm:likes ?v1 . ?v0 wsdbm:friendOf ?v2 . ?v0 dc:Location ?v3 . ?v0 foaf:age ?v4 . ?v0 wsdbm:gender ?v5 . ?v0 foaf:givenName ?v6"),
]
YAGO2 = [
    ("?x", "?x <livesIn> <Athens>"),
    ("?y ?u", '?y <graduatedFrom> ?u . "Albert Einstein" <graduatedFrom> ?u'),
    ("?p ?p1 ?p2 ?p3", "?p <hasInternalWikipediaLinkTo> ?p1 . ?p1 <hasInternalWikipediaLinkTo> ?p2 . ?p2 <hasInternalWikipediaLinkTo> ?p3"),
    ("?p ?p1 ?e1 ?e", "?p <hasInternalWikipediaLinkTo> ?p1 . ?p1 <hasExternalWikipediaLinkTo> ?e1 . ?p <hasExternalWikipediaLinkTo> ?e"),
]
PREFIXES = {
    "ub": "http://www.lehigh.edu/~zhp2/2004/0401/univ-bench.owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "wsdbm": "http://db.uwaterloo.ca/~galuc/wsdbm/",
    "sorg": "http://schema.org/",
    "gr": "http://purl.org/goodrelations/",
    "foaf": "http://xmlns.com/foaf/",
    "og": "http://ogp.me/ns#",
    "rev": "http://purl.org/stuff/rev#",
    "dc": "http://purl.org/dc/terms/",
    "mo": "http://purl.org/ontology/mo/",
    "gn": "http://www.geonames.org/ontology#",
}
SLOTS = {"lubm": 14, "watdiv": 20, "yago2": 14}


def bank(kind: str, full_names: bool = False) -> list[Query]:
    """The queries of a bank; full_names writes prefixed terms as <address>.  YAGO2 has 14 slots, of which 4 are filled."""
    rows = {"lubm": LUBM, "watdiv": WATDIV, "yago2": YAGO2}.get(kind)
    if rows is None:
        raise ValueError(f"no query bank {kind!r}; there are {sorted(SLOTS)}")
    long = lambda t: re.sub(r"(?<![\w<:/])(" + "|".join(PREFIXES) + r"):([\w]+)", lambda m: f"<{PREFIXES[m[1]]}{m[2]}>", t)
    out = [q(h, long(b) if full_names else b) for h, b in rows]
    return out + [Query() for _ in range(SLOTS[kind] - len(out))]


def _rows() -> list[tuple]:
    return [(k, i, " ".join(f"?{v}" for v in x.head), len(x.body)) for k in SLOTS for i, x in enumerate(bank(k)) if x.body]


def as_rows(spark) -> DataFrame:
    """(bank, number, head, patterns): the filled slots of all banks."""
    return spark.createDataFrame(_rows(), "bank string, number int, head string, patterns int")


def rows_sql() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i}::INTEGER, '{h}', {n}::INTEGER)" for k, i, h, n in _rows()) + ") t(bank, number, head, patterns)"


class Bank:
    """A bank whose queries can be changed."""

    def __init__(self, kind: str, full_names: bool = False):
        self.queries = bank(kind, full_names)

    def __len__(self) -> int:
        return len(self.queries)

    def get(self, i: int) -> Query:
        if not 0 <= i < len(self.queries):
            raise IndexError(f"no query {i} in a bank of {len(self.queries)}")
        return self.queries[i]

    def add(self, query: Query) -> int:
        query.check()
        self.queries.append(query)
        return len(self.queries) - 1

    def update(self, i: int, query: Query) -> None:
        self.get(i)
        query.check()
        self.queries[i] = query

    def set_body(self, i: int, body: list[Pattern]) -> None:
        self.update(i, Query(list(self.get(i).head), list(body)))

    def add_heads(self, i: int, *variables: str) -> None:
        new = self.get(i).copy()
        for v in variables:
            new.add_to_head(v)
        self.update(i, new)

    def delete(self, i: int) -> Query:
        self.get(i)
        return self.queries.pop(i)

    def clear(self) -> None:
        self.queries.clear()


# ---------------------------------------------------------------- workloads


def instances(dictionary: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Terms prefix + digits (or nothing) + suffix of dict(term, id)."""
    return dictionary.where(F.col("term").rlike("^" + re.escape(prefix).replace("/", "/") + r"\d*" + re.escape(suffix) + "$")).select("term")


def instantiate(template: Query, pattern: int, side: str, term: str) -> Query:
    """The template with the subject ('s') or object ('o') of one pattern replaced by a term."""
    if side not in ("s", "o"):
        raise ValueError("the side is s or o")
    out, old = template.copy(), template.pattern(pattern)
    new = Const((term,))
    out.body[pattern] = Pattern(new, old.p, old.o) if side == "s" else Pattern(old.s, old.p, new)
    return out


def workload(templates: list[tuple[Query, int, str, list[str]]], percent: list[int], n: int, seed: int = 0) -> list[Query]:
    """n queries: the i-th comes from the first template whose cumulative percentage reaches i * 100 / n, so the first gets one
    more; its term is drawn by the seed; then all are shuffled by it.  A template without terms is used as it is."""
    if len(templates) != len(percent):
        raise ValueError("one percentage for each template")
    rng, out = random.Random(seed), []
    bounds = [sum(percent[: i + 1]) for i in range(len(percent))]
    for i in range(n):
        k = next((j for j, b in enumerate(bounds) if b >= i * 100 / n and percent[j]), None)
        if k is not None:
            query, pattern, side, terms = templates[k]
            out.append(instantiate(query, pattern, side, rng.choice(terms)) if terms else query.copy())
    rng.shuffle(out)
    return out


def read_query_files(folder: str, stem: str = "query_workload_Q") -> dict[int, list[Query]]:
    """Queries of files <stem><number>, by number."""
    found = {int(m[1]): p for p in Path(folder).iterdir() if (m := re.fullmatch(re.escape(stem) + r"(\d+)", p.name))}
    return {k: parse_queries(found[k].read_text()) for k in sorted(found)}
