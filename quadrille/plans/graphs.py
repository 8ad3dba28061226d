"""Graphs in the vocabularies of the query banks, derived from the relational tables, so that every bank query has data to run on.

Rules are (table, subject, [(predicate, object)]); subjects and objects are expressions that Spark and DuckDB read alike."""

from __future__ import annotations


def _university(x: str) -> str:
    return f"'<http://www.University' || {x} || '.edu>'"


def _department(x: str) -> str:
    return f"'<http://www.Department' || {x} || '.University0.edu>'"


def _professor(x: str) -> str:
    return f"CASE {x} WHEN 0 THEN '<http://www.Department0.University0.edu/AssociateProfessor0>' WHEN 1 THEN '<http://www.Department0.University0.edu/AssistantProfessor0>' ELSE '<professor' || {x} || '>' END"


def _course(x: str) -> str:
    return f"'<course' || {x} || '>'"


_STUDENT = "'<student' || c_custkey || '>'"
_PUPIL = "c_custkey % 3 = 0"
LUBM = [
    ("region", _university("r_regionkey"), [("rdf:type", "'ub:University'")]),
    ("nation", _department("n_nationkey"), [("rdf:type", "'ub:Department'"), ("ub:subOrganizationOf", _university("n_regionkey"))]),
    ("nation", "'<group' || n_nationkey || '>'", [("rdf:type", "'ub:ResearchGroup'"), ("ub:subOrganizationOf", _university("n_regionkey"))]),
    ("part", f"CASE WHEN p_partkey < 20 THEN {_course('p_partkey')} END", [("rdf:type", "'ub:Course'")]),
    ("customer", _STUDENT, [("rdf:type", f"CASE WHEN {_PUPIL} THEN 'ub:GraduateStudent' ELSE 'ub:UndergraduateStudent' END"), ("ub:memberOf", _department("c_nationkey")), ("ub:emailAddress", "c_name || '@u'")]),
    ("customer", _STUDENT, [("ub:undergraduateDegreeFrom", f"CASE WHEN {_PUPIL} THEN {_university('c_custkey % 5')} END"), ("ub:mastersDegreeFrom", f"CASE WHEN c_custkey % 40 = 1 THEN {_department('0')} END")]),
    ("customer", _STUDENT, [("ub:advisor", _professor("c_custkey % 10")), ("ub:takesCourse", _course("c_custkey % 20"))]),
    ("customer", _STUDENT, [("ub:takesCourse", "CASE WHEN c_custkey % 50 = 0 THEN '<http://www.Department0.University0.edu/GraduateCourse0>' END")]),
    ("supplier", _professor("s_suppkey"), [("rdf:type", "CASE s_suppkey % 4 WHEN 0 THEN 'ub:FullProfessor' WHEN 1 THEN 'ub:AssociateProfessor' WHEN 2 THEN 'ub:AssistantProfessor' ELSE 'ub:Lecturer' END"), ("ub:worksFor", _department("s_nationkey"))]),
    ("supplier", _professor("s_suppkey"), [("ub:worksFor", f"CASE WHEN s_suppkey < 9 THEN {_department('0')} END"), ("ub:name", "s_name"), ("ub:emailAddress", "s_name || '@u'"), ("ub:telephone", "'+' || s_suppkey")]),
    ("supplier", _professor("s_suppkey"), [("ub:headOf", f"CASE WHEN s_suppkey % 5 = 0 THEN {_department('s_nationkey')} END"), ("ub:teacherOf", _course("s_suppkey % 20"))]),
    ("orders", "'<publication' || o_orderkey || '>'", [("rdf:type", "'ub:Publication'"), ("ub:publicationAuthor", _professor("o_custkey % 10"))]),
]

_USER = "'wsdbm:User' || CASE c_custkey WHEN 5 THEN 534664 ELSE c_custkey END"
_PRODUCT = "'wsdbm:Product' || p_partkey"
_OFFER = "'wsdbm:Offer' || o_orderkey"
_SELLER = "'wsdbm:Retailer' || CASE s_suppkey WHEN 1 THEN 346 WHEN 2 THEN 10487 ELSE 100000 + s_suppkey END"
_SITE = "'wsdbm:Website' || CASE {0} WHEN 0 THEN 6244 WHEN 1 THEN 31204 ELSE {0} END"
_GENRE = "'wsdbm:SubGenre' || CASE {0} WHEN 0 THEN 44 WHEN 1 THEN 91 WHEN 2 THEN 42 ELSE {0} END"
WATDIV = [
    ("nation", _SITE.format("n_nationkey"), [("sorg:url", "n_name || '.org'"), ("wsdbm:hits", "100 + n_nationkey"), ("sorg:language", "'wsdbm:Language' || n_nationkey % 2")]),
    ("nation", "'wsdbm:City' || CASE n_nationkey WHEN 2 THEN 142 WHEN 3 THEN 21 ELSE 1000 + n_nationkey END", [("gn:parentCountry", "'wsdbm:Country' || n_nationkey")]),
    ("nation", _GENRE.format("n_nationkey"), [("rdf:type", "'wsdbm:Genre' || n_regionkey"), ("og:tag", "CASE WHEN n_nationkey % 2 = 0 THEN 'wsdbm:Topic245' END")]),
    ("customer", _USER, [("wsdbm:subscribes", _SITE.format("c_custkey % 25")), ("wsdbm:likes", "'wsdbm:Product' || c_custkey % 200"), ("sorg:nationality", "'wsdbm:Country' || c_nationkey"), ("sorg:jobTitle", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END")]),
    ("customer", _USER, [("wsdbm:likes", "CASE WHEN c_custkey % 7 = 0 THEN 'wsdbm:Product0' END"), ("dc:Location", "'wsdbm:City' || c_custkey % 40"), ("wsdbm:gender", "'wsdbm:Gender' || c_custkey % 2"), ("rdf:type", "'wsdbm:Role' || c_custkey % 3")]),
    ("customer", _USER, [("foaf:age", "'wsdbm:AgeGroup' || c_custkey % 9"), ("foaf:familyName", "c_name"), ("foaf:givenName", "'n' || c_custkey % 99"), ("wsdbm:friendOf", "'wsdbm:User' || (c_custkey + 1) % 150"), ("foaf:homepage", "CASE WHEN c_custkey % 3 = 0 THEN " + _SITE.format("c_custkey % 25") + " END")]),
    ("part", _PRODUCT, [("sorg:caption", "p_name"), ("og:tag", "CASE p_partkey % 5 WHEN 0 THEN 'wsdbm:Topic124' WHEN 1 THEN 'wsdbm:Topic245' END"), ("rdf:type", "'wsdbm:ProductCategory' || p_partkey % 15"), ("wsdbm:hasGenre", _GENRE.format("p_partkey % 25"))]),
    ("part", _PRODUCT, [("sorg:publisher", "p_brand"), ("sorg:description", "p_type"), ("sorg:keywords", "CASE WHEN p_partkey % 2 = 0 THEN p_brand END"), ("sorg:language", "'wsdbm:Language' || p_partkey % 3"), ("sorg:text", "CASE WHEN p_partkey % 3 = 0 THEN p_name END")]),
    ("part", _PRODUCT, [("mo:artist", "'wsdbm:User' || p_partkey % 150"), ("mo:conductor", "'wsdbm:User' || (p_partkey + 7) % 150"), ("sorg:actor", "CASE WHEN p_partkey % 4 = 0 THEN 'wsdbm:User' || p_partkey % 150 END"), ("sorg:trailer", "CASE WHEN p_partkey % 2 = 0 THEN 'trailer' || p_partkey END")]),
    ("part", _PRODUCT, [("foaf:homepage", _SITE.format("p_partkey % 25")), ("og:title", "p_name"), ("sorg:contentRating", "p_size"), ("sorg:contentSize", "CASE WHEN p_partkey % 2 = 1 THEN p_size END")]),
    ("orders", _OFFER, [("gr:includes", "'wsdbm:Product' || o_orderkey % 200"), ("gr:price", "o_orderkey % 977"), ("gr:serialNumber", "o_orderkey"), ("gr:validFrom", "o_orderpriority"), ("gr:validThrough", "o_orderstatus")]),
    ("orders", _OFFER, [("sorg:eligibleQuantity", "o_orderkey % 9"), ("sorg:eligibleRegion", "'wsdbm:Country' || o_custkey % 25"), ("sorg:priceValidUntil", "o_orderkey % 12")]),
    ("lineitem", _SELLER.replace("s_suppkey", "l_suppkey"), [("gr:offers", "'wsdbm:Offer' || l_orderkey")]),
    ("supplier", _SELLER, [("sorg:legalName", "CASE WHEN s_suppkey % 5 = 0 THEN s_name END")]),
    ("orders", "CASE WHEN o_orderkey % 4 = 0 THEN 'wsdbm:Purchase' || o_orderkey END", [("wsdbm:purchaseFor", "'wsdbm:Product' || o_orderkey % 200"), ("wsdbm:purchaseDate", "o_orderkey % 365")]),
    ("orders", "'wsdbm:User' || o_custkey", [("wsdbm:makesPurchase", "CASE WHEN o_orderkey % 4 = 0 THEN 'wsdbm:Purchase' || o_orderkey END")]),
    ("events", "'wsdbm:Product' || event_id % 200", [("rev:hasReview", "CASE WHEN event_id % 9 = 0 THEN 'wsdbm:Review' || event_id END")]),
    ("events", "CASE WHEN event_id % 9 = 0 THEN 'wsdbm:Review' || event_id END", [("rev:title", "event_type"), ("rev:reviewer", "'wsdbm:User' || user_id"), ("rev:totalVotes", "CASE WHEN event_id % 2 = 0 THEN event_id % 50 END")]),
]

_PAGE = "'<page' || {0} || '>'"
_PERSON = "CASE c_custkey WHEN 0 THEN '\"Albert Einstein\"' ELSE '<person' || c_custkey || '>' END"
_LINK, _OUTSIDE = "<hasInternalWikipediaLinkTo>", "<hasExternalWikipediaLinkTo>"
YAGO2 = [
    ("customer", _PERSON, [("<livesIn>", "CASE c_nationkey WHEN 3 THEN '<Athens>' ELSE '<city' || c_nationkey || '>' END"), ("<graduatedFrom>", "'<school' || c_custkey % 30 || '>'")]),
    ("customer", _PAGE.format("c_custkey"), [(_LINK, _PAGE.format("(c_custkey * 7 + 1) % 150")), (_OUTSIDE, "'<site' || c_custkey % 60 || '>'")]),
    ("customer", _PAGE.format("c_custkey"), [(_LINK, _PAGE.format("(c_custkey * 3 + 2) % 150")), (_OUTSIDE, "CASE WHEN c_custkey % 2 = 0 THEN '<other' || c_custkey % 40 || '>' END")]),
]
GRAPHS = {"lubm": LUBM, "watdiv": WATDIV, "yago2": YAGO2}
