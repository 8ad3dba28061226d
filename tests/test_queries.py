"""Every registered query of the graph engine against its SQL in DuckDB, and the fixed counts of the fixtures."""

import duckdb
import pytest

from quadrille import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
COUNTS = {"bgp_point": 6, "bgp_type_scan": 10, "bgp_star": 2, "bgp_star_expand": 493, "bgp_chain": 277, "bgp_tree": 9, "bgp_object_disjunction": 34, "bgp_predicate_disjunction": 3520, "bgp_subject_const": 37, "bgp_predicate_var": 9, "bgp_cyclic": 194, "bgp_unbound_hop": 30, "bgp_empty": 0, "bgp_unbound_hop_distinct": 6, "triples_view": 18123, "dictionary_roundtrip": 18123, "bgp_reduced": 9, "stored_tree": 9}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, "" if x is None else x) for x in r])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = ordered(tuple(r[c] for c in cols) for r in df.collect())
    if name in COUNTS:
        assert len(got) == COUNTS[name]
    if name in registry.SQL:
        rel = duck.execute(registry.SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        assert got == ordered(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())
    else:
        raise AssertionError(f"{name} has no SQL")
