"""Queries of the graph engine over the driver's tables, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.hashing import MULTIPLIER, jump_hash
from quadrille.operators import access, placement, queue, setops, stats
from quadrille.plans import catalog, graphs, planner
from quadrille.plans.model import parse, q
from quadrille.sources import triples as source
from quadrille.plans.model import Const, Pattern, Query
from quadrille.sources.store import Store
from quadrille.sources.triples import rdfize, rdfize_sql, scans
from quadrille.streaming import weights

BGP = {
    "bgp_point": q("?x", "?x inNation nation/3"),
    "bgp_type_scan": q("?x", "?x rdf:type Supplier"),
    "bgp_star": q("?x", "?x rdf:type Customer . ?x inNation {nation/3, nation/7} . ?x segment BUILDING"),
    "bgp_star_expand": q("?x ?y1 ?y2", "?x rdf:type Order . ?x status P . ?x priority ?y1 . ?x placedBy ?y2"),
    "bgp_chain": q("?o ?c ?n", "?o placedBy ?c . ?c inNation ?n . ?n inRegion region/2"),
    "bgp_tree": q("?o ?c ?p", "?o priority 1-URGENT . ?o placedBy ?c . ?c segment BUILDING . ?o containsPart ?p . ?p brand Brand#12"),
    "bgp_object_disjunction": q("?x ?n", "?x rdf:type {Customer, Supplier} . ?x inNation ?n . ?n inRegion region/1"),
    "bgp_predicate_disjunction": q("?o ?y", "?o status P . ?o {containsPart, suppliedBy} ?y"),
    "bgp_subject_const": q("?o ?p", "order/7 placedBy ?c . ?o placedBy ?c . ?o containsPart ?p"),
    "bgp_predicate_var": q("?p ?y", "order/7 ?p ?y"),
    "bgp_cyclic": q("?o ?c ?s ?n", "?o placedBy ?c . ?o suppliedBy ?s . ?c inNation ?n . ?s inNation ?n"),
    "bgp_unbound_hop": q("?a ?b", "?a did ?e . ?a inNation ?n . ?b inNation ?n . ?b rdf:type Supplier"),
    "bgp_empty": q("?x", "?x inNation nation/999"),
}
QUERIES, SQL = {}, {}
_VIEW = f"WITH RECURSIVE triples AS ({rdfize_sql()})"


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = f"{_VIEW} {sql}" if re.search(r"FROM triples\b", sql) else sql


def _sql(query: Query) -> str:
    """Explicit joins in the planned order over the triples that each pattern can match."""
    return planner.to_sql(query, lambda p: rdfize_sql(p.p.terms if isinstance(p.p, Const) else None))


for _name, _query in BGP.items():
    _add(_name, lambda spark, d, x=_query: planner.solve(scans(spark, d), x), _sql(_query))
_add("bgp_unbound_hop_distinct", lambda s, d: planner.solve(scans(s, d), BGP["bgp_unbound_hop"], distinct=True), "SELECT DISTINCT * FROM (" + _sql(BGP["bgp_unbound_hop"]) + ")")
_add("bgp_bindings", lambda s, d: planner.bindings(scans(s, d), BGP["bgp_tree"])["c"], "SELECT DISTINCT c FROM (" + _sql(BGP["bgp_tree"]) + ")")
_add("bgp_edges", lambda s, d: planner.edges(scans(s, d), BGP["bgp_tree"])[3], "SELECT DISTINCT o AS s, 'containsPart' AS p, p AS o FROM (" + _sql(BGP["bgp_tree"]) + ")")
_add("triples_view", rdfize, "SELECT s, p, o FROM triples")
_add("entities_out", lambda s, d: access.entities(rdfize(s, d, {"placedBy"}), "placedBy"), "SELECT DISTINCT s AS v FROM triples WHERE p = 'placedBy'")
_add("entities_in", lambda s, d: access.entities(rdfize(s, d, {"placedBy"}), "placedBy", "IN"), "SELECT DISTINCT o AS v FROM triples WHERE p = 'placedBy'")
_add("entities_set", lambda s, d: access.entities(rdfize(s, d, {"brand", "segment"}), ["brand", "segment"]), "SELECT DISTINCT s AS v FROM triples WHERE p IN ('brand', 'segment')")
_add("class_index", lambda s, d: access.class_members(rdfize(s, d, {"rdf:type"}, objects=["Part"]), "Part"), "SELECT s AS v FROM triples WHERE p = 'rdf:type' AND o = 'Part'")
_add("predicates_of", lambda s, d: access.predicates(rdfize(s, d, subjects=["order/7"]), "order/7"), "SELECT DISTINCT p FROM triples WHERE s = 'order/7'")
_add("predicates_in", lambda s, d: access.predicates(rdfize(s, d, objects=["customer/7"]), "customer/7", "IN"), "SELECT DISTINCT p FROM triples WHERE o = 'customer/7'")
_add("neighbours_out", lambda s, d: access.neighbours(rdfize(s, d, {"containsPart"}, ["order/7"]), "order/7", "containsPart"), "SELECT o AS v FROM triples WHERE s = 'order/7' AND p = 'containsPart'")
_add("neighbours_in", lambda s, d: access.neighbours(rdfize(s, d, {"inNation"}, objects=["nation/3"]), "nation/3", "inNation", "IN"), "SELECT s AS v FROM triples WHERE o = 'nation/3' AND p = 'inNation'")
_add("neighbourhood", lambda s, d: access.neighbours(rdfize(s, d, subjects=["nation/3"]), "nation/3").unionAll(access.neighbours(rdfize(s, d, objects=["nation/3"]), "nation/3", direction="IN")).distinct(), "SELECT o AS v FROM triples WHERE s = 'nation/3' UNION SELECT s FROM triples WHERE o = 'nation/3'")
_add("exists", lambda s, d: access.exists(rdfize(s, d), s.range(0, 40).select(F.concat(F.lit("nation/"), "id").alias("v"))), "SELECT 'nation/' || i AS v FROM range(40) t(i) WHERE 'nation/' || i IN (SELECT s FROM triples UNION SELECT o FROM triples)")
_add("adjacency_sizes", lambda s, d: access.adjacency(rdfize(s, d)).groupBy("v", "p").agg(F.sum(F.size("o_vals")).alias("n")), "SELECT s AS v, p, count(*) AS n FROM triples GROUP BY 1, 2")
_add("predicate_stats", lambda s, d: stats.predicate_stats(rdfize(s, d)), "SELECT p, count(*) AS n_triples, count(DISTINCT s) AS n_subjects, count(DISTINCT o) AS n_objects FROM triples GROUP BY p")
_add("vertex_stats", lambda s, d: stats.vertex_stats(rdfize(s, d)), "SELECT v, count(*) AS n_edges, count(DISTINCT o) AS n_objects FROM (SELECT s AS v, o FROM triples UNION ALL SELECT o, NULL FROM triples) GROUP BY v")
_add("set_intersect", lambda s, d: setops.intersect(access.entities(rdfize(s, d, {"did"}), "did"), access.entities(rdfize(s, d, {"placedBy"}), "placedBy", "IN")), "SELECT DISTINCT s AS v FROM triples WHERE p = 'did' AND s IN (SELECT o FROM triples WHERE p = 'placedBy')")
_add("set_difference", lambda s, d: setops.difference(access.entities(rdfize(s, d, {"segment"}), "segment"), access.entities(rdfize(s, d, {"did"}), "did")), "SELECT s AS v FROM triples WHERE p = 'segment' AND s NOT IN (SELECT s FROM triples WHERE p = 'did')")
_add("set_union", lambda s, d: setops.union(access.entities(rdfize(s, d, {"brand"}), "brand"), access.entities(rdfize(s, d, {"segment"}), "segment")), "SELECT s AS v FROM triples WHERE p = 'brand' UNION SELECT s FROM triples WHERE p = 'segment'")
_add("star_candidates", lambda s, d: planner.star(scans(s, d), BGP["bgp_star"].body, "x"), _sql(BGP["bgp_star"]))
_add("order_batch", lambda s, d: setops.batch(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("seq"), "o_custkey")), "SELECT o_orderkey AS seq, o_custkey FROM orders ORDER BY 1 LIMIT 1000")
_add("query_catalog", lambda s, d: catalog.as_rows(s), catalog.rows_sql())


def _edges(s, d):
    """Result edges of customers and their orders over one id space: customers even, orders odd."""
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select((2 * F.col("o_orderkey") + 1).alias("s"), F.lit(9).alias("p"), F.lit("OUT").alias("d"), (2 * F.col("o_custkey")).alias("o")).distinct()


def _located(s, d, n=3):
    e = _edges(s, d)
    return access.locate(e.select(F.explode(F.array("s", "o")).alias("v")), F.pmod(F.col("v"), F.lit(n)))


_E = "e AS (SELECT DISTINCT 2 * o_orderkey + 1 AS s, 2 * o_custkey AS o FROM orders), doi AS (SELECT v, k AS server, count(*) AS cnt FROM (SELECT s AS v, s % 3 AS k FROM e UNION ALL SELECT o, s % 3 FROM e) GROUP BY 1, 2)"
_add("doi_counters", lambda s, d: stats.doi(_edges(s, d), _located(s, d)), f"WITH {_E} SELECT v, server, cnt FROM doi")
_add("doi_target", lambda s, d: placement.doi_target(stats.doi(_edges(s, d), _located(s, d)), _located(s, d)), f"WITH {_E} SELECT v, v % 3 AS current, arg_min(server, cnt * -1000 + CASE WHEN server = v % 3 THEN 0 ELSE 100 END + server) AS target FROM doi GROUP BY v")
_add("edge_cut", lambda s, d: stats.edge_cut(_edges(s, d), _located(s, d)), f"WITH {_E} SELECT s % 3 AS server, count(DISTINCT o) AS cut FROM e WHERE s % 3 <> o % 3 GROUP BY 1")
_add("server_stats", lambda s, d: stats.server_stats(stats.vertex_stats(_edges(s, d)), _located(s, d)), f"WITH {_E}, w AS (SELECT v, count(*) AS n, count(DISTINCT o) AS m FROM (SELECT s AS v, o FROM e UNION ALL SELECT o, NULL FROM e) GROUP BY v) SELECT v % 3 AS server, count(*) AS n_vertices, sum(n)::BIGINT AS n_edges, sum(m)::BIGINT AS n_objects FROM w GROUP BY 1")
_add("predicate_servers", lambda s, d: stats.predicate_servers(_edges(s, d), _located(s, d)), f"WITH {_E} SELECT 9 AS p, s % 3 AS server, count(DISTINCT s) AS n FROM e GROUP BY 2")
_add("moved", lambda s, d: placement.plan_round(_edges(s, d), s.createDataFrame([], "v long, server long"), _located(s, d), F.pmod(F.col("v"), F.lit(3))), f"WITH {_E} SELECT v, t AS server FROM (SELECT v, arg_min(server, cnt * -1000 + CASE WHEN server = v % 3 THEN 0 ELSE 100 END + server) AS t FROM doi GROUP BY v) WHERE t <> v % 3")
_add("vertex_weights", lambda s, d: stats.add_weights(_edges(s, d).select(F.col("o").alias("v"), F.lit(1).cast("long").alias("weight")), _edges(s, d).select(F.col("s").alias("v"), F.lit(2).cast("long").alias("weight"))), f"WITH {_E} SELECT v, sum(w)::BIGINT AS weight FROM (SELECT o AS v, 1 AS w FROM e UNION ALL SELECT s, 2 FROM e) GROUP BY v")
_add(
    "jump_home",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("v"), jump_hash("c_custkey", 10).alias("server")),
    f"""WITH RECURSIVE j AS (SELECT c_custkey AS v, c_custkey::HUGEINT AS key, 0::BIGINT AS b, 0::BIGINT AS nxt, 0 AS step FROM customer
UNION ALL SELECT v, k, nxt, floor((nxt + 1) * (2147483648.0::DOUBLE / ((k // 8589934592)::DOUBLE + 1.0)))::BIGINT, step + 1
FROM (SELECT *, (key * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k FROM j WHERE nxt < 10))
SELECT v, arg_max(b, step)::INTEGER AS server FROM j GROUP BY v""",
)


# ---------------------------------------------------------------- dictionary, storage, text queries, workloads


def _roundtrip(s, d):
    t = rdfize(s, d)
    known = source.build_dictionary(t)
    return source.decode(source.encode(t, known), known)


def _stored_tree(s, d):
    """The tree query over triples written and read with a folder for each predicate, planned by their statistics."""
    t = rdfize(s, d, BGP["bgp_tree"].predicates)
    path = source.fresh_path(s, "triples")
    source.write(t, path)
    held = source.read(s, path)
    return planner.solve(held, BGP["bgp_tree"], stats.planner_stats(held))


def _store(s, d, rules, queries):
    """A store of the triples that these queries can match."""
    needed = {p for x in queries for p in x.predicates}
    return Store.build(rdfize(s, d, needed) if rules is None else source.derive(s, d, rules, needed, distinct=False), source.fresh_path(s, "store"))


def _answers(store, numbered):
    """(number, solution): the solutions of all queries, each as one text."""
    parts = [store.solve(x).select(F.lit(i).alias("number"), F.concat_ws("|", *x.head).alias("solution")) for i, x in numbered]
    return setops.union_all(*parts)


def _answers_sql(numbered, of):
    one = lambda i, x: f"SELECT {i} AS number, " + " || '|' || ".join(f'"{v}"' for v in x.head) + f" AS solution FROM ({planner.to_sql(x, of)})"
    return " UNION ALL ".join(one(i, x) for i, x in numbered)


def _bank(kind):
    queries = [(i, x) for i, x in enumerate(catalog.bank(kind)) if x.body]
    run = lambda s, d: _answers(_store(s, d, graphs.GRAPHS[kind], [x for _, x in queries]), queries)
    return run, _answers_sql(queries, lambda p: source.derive_sql(graphs.GRAPHS[kind], set(p.p.terms)))


TEXT = "SELECT ?v0 ?v1 WHERE {\n\t?v0 inNation ?v1 .\n\t?v0 segment MACHINERY .\n\t?v1 inRegion region/0 .\n}\n"
REGIONS = [f"region/{i}" for i in range(5)]
WORKLOAD = catalog.workload([(BGP["bgp_chain"], 2, "o", REGIONS), (BGP["bgp_object_disjunction"], 2, "o", REGIONS), (BGP["bgp_point"], 0, "o", [f"nation/{i}" for i in range(25)])], [40, 30, 30], 10, seed=7)


def _workload_counts(s, d):
    """Solutions of each query of a seeded workload."""
    parts = [planner.solve(scans(s, d), x).agg(F.count("*").alias("n")).select(F.lit(i).alias("number"), "n") for i, x in enumerate(WORKLOAD)]
    return setops.union_all(*parts)


for _kind in graphs.GRAPHS:
    _add(f"bank_{_kind}", *_bank(_kind))
_CODED = [(i, BGP[k]) for i, k in enumerate(["bgp_star", "bgp_tree", "bgp_cyclic", "bgp_object_disjunction"])]
_add("store_bgp", lambda s, d: _answers(_store(s, d, None, [x for _, x in _CODED]), _CODED), _answers_sql(_CODED, lambda p: rdfize_sql(p.p.terms)))


def _grown(s, d):
    """The tree query over a store to which half of its triples came later."""
    t = rdfize(s, d, BGP["bgp_tree"].predicates)
    late = {"brand", "segment"}
    first = Store.build(t.where(~F.col("p").isin(*late)), source.fresh_path(s, "store"))
    return first.insert(t.where(F.col("p").isin(*late)), source.fresh_path(s, "store")).solve(BGP["bgp_tree"])


_add("store_insert", _grown, _sql(BGP["bgp_tree"]))
_add("dictionary_extended", lambda s, d: _extended(s, d), "SELECT count(*) AS terms, count(*) AS ids, count(*) FILTER (WHERE old) AS kept FROM (SELECT t, bool_or(old) AS old FROM (SELECT DISTINCT unnest([s, p, o]) AS t, true AS old FROM triples WHERE p = 'segment' UNION ALL SELECT DISTINCT unnest([s, p, o]), false FROM triples WHERE p = 'brand') GROUP BY t)")


def _extended(s, d):
    """Terms and ids of a dictionary that was extended, and how many of its first entries it keeps."""
    first = source.build_dictionary(rdfize(s, d, {"segment"}))
    more = source.extend_dictionary(first, rdfize(s, d, {"brand"}).select(F.explode(F.array("s", "p", "o")).alias("term")))
    same = first.join(more, ["term", "id"], "left_semi").agg(F.count("*").alias("kept"))
    return more.agg(F.countDistinct("term").alias("terms"), F.countDistinct("id").alias("ids")).crossJoin(same)  # a row with a row


_add("dictionary_roundtrip", _roundtrip, "SELECT s, p, o FROM triples")
_add("stored_tree", _stored_tree, _sql(BGP["bgp_tree"]))
_add("bgp_text", lambda s, d: planner.solve(scans(s, d), parse(TEXT)), _sql(parse(TEXT)))
_add("bgp_given", lambda s, d: planner.solve(rdfize(s, d, {"inNation"}), q("?x ?n", "?x inNation ?n"), given=s.read.parquet(f"{d}/nation.parquet").where("n_regionkey = 2").select(F.concat(F.lit("nation/"), "n_nationkey").alias("n"))), "SELECT s AS x, o AS n FROM triples WHERE p = 'inNation' AND o IN (SELECT 'nation/' || n_nationkey FROM nation WHERE n_regionkey = 2)")
_add("bgp_reduced", lambda s, d: planner.reduce_semi(scans(s, d), BGP["bgp_tree"])[3], "SELECT DISTINCT o, p FROM (" + _sql(BGP["bgp_tree"]) + ")")
_add("workload_counts", _workload_counts, " UNION ALL ".join(f"SELECT {i} AS number, count(*) AS n FROM ({_sql(x)})" for i, x in enumerate(WORKLOAD)))
_add("term_instances", lambda s, d: catalog.instances(access.entities(rdfize(s, d, {"placedBy"}), "placedBy").select(F.col("v").alias("term")), "order/1", "7"), "SELECT DISTINCT s AS term FROM triples WHERE p = 'placedBy' AND regexp_full_match(s, 'order/1[0-9]*7')")


# ---------------------------------------------------------------- multisets


def _placed(s, d, status):
    return s.read.parquet(f"{d}/orders.parquet").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("v"))


def _users(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("v"))


_P, _O = ("SELECT o_custkey AS v FROM orders WHERE o_orderstatus = '%s'" % x for x in "PO")
_add("multiset_intersect", lambda s, d: setops.intersect(_placed(s, d, "P"), _placed(s, d, "O")), f"{_P} INTERSECT ALL {_O}")
_add("difference_keeps_repeats", lambda s, d: setops.difference(_placed(s, d, "P"), _users(s, d)), f"{_P} AND o_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
_add("union_append", lambda s, d: setops.union_all(_placed(s, d, "P"), _users(s, d)), f"{_P} UNION ALL SELECT user_id FROM events")
_add("sorted_distinct", lambda s, d: setops.sorted_distinct(_placed(s, d, "P")), f"SELECT DISTINCT v FROM ({_P}) ORDER BY v")
_add(
    "adjacency_merged",
    lambda s, d: setops.dedup_adjacency(setops.union_all(*[access.adjacency(rdfize(s, d, p)) for p in ({"did", "segment"}, {"did", "inNation"})])).select("v", "p", F.explode("o_vals").alias("o")),
    "SELECT s AS v, p, o FROM triples WHERE p IN ('did', 'segment', 'inNation')",
)


# ---------------------------------------------------------------- statistics and placement


def _candidates(s, d, n=3):
    """A row for each vertex and server with what the balance score asks for."""
    at = _located(s, d, n)
    wide = stats.doi_wide(stats.doi(_edges(s, d), at), n)
    long = wide.select("v", F.expr("stack(3, 0, s0, 1, s1, 2, s2) AS (server, locality)")).join(at.withColumnRenamed("server", "current"), "v")
    per = long.groupBy("server").agg(F.sum("locality").alias("server_weight"), F.sum((F.col("locality") > 0).cast("long")).alias("active"))
    total = long.groupBy("v").agg(F.sum("locality").alias("own"))
    out = long.join(total, "v").join(per, "server").join(per.select(F.col("server").alias("current"), F.col("server_weight").alias("source_weight")), "current")
    mean = per.agg((F.sum("server_weight") / n).alias("average"))  # one row
    return out.crossJoin(F.broadcast(mean)).withColumns({"edges": F.col("own"), "weight": F.col("own"), "previous": F.lit(0)})


_WIDE = "SELECT v, sum(CASE WHEN server = 0 THEN cnt ELSE 0 END)::BIGINT AS s0, sum(CASE WHEN server = 1 THEN cnt ELSE 0 END)::BIGINT AS s1, sum(CASE WHEN server = 2 THEN cnt ELSE 0 END)::BIGINT AS s2 FROM doi GROUP BY v"
_SCORES = f"""{_E}, wide AS ({_WIDE}), long AS (SELECT v, v % 3 AS cur, s0 + s1 + s2 AS own, k AS server, CASE k WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS locality FROM wide, range(3) r(k)),
per AS (SELECT server, sum(locality) AS weight, sum((locality > 0)::INT) AS active FROM long GROUP BY server), mean AS (SELECT sum(weight) / 3 AS average FROM per),
scored AS (SELECT l.*, CASE WHEN src.weight - own < average * (2 - 1.1::DOUBLE) OR dst.weight + own > average * 1.1::DOUBLE THEN '-inf'::DOUBLE WHEN dst.active = 0 THEN locality ELSE locality - floor(dst.weight / (3 * dst.active)) END AS score
FROM long l JOIN per dst ON dst.server = l.server JOIN per src ON src.server = cur, mean)
SELECT v, CASE WHEN own >= 2 AND score > '-inf'::DOUBLE THEN server END AS target FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY score DESC, server <> cur, server) AS n FROM scored) WHERE n = 1"""
_add("doi_wide", lambda s, d: stats.doi_wide(stats.doi(_edges(s, d), _located(s, d)), 3), f"WITH {_E} {_WIDE}")
_add("balance_target", lambda s, d: placement.balance_target(_candidates(s, d)), f"WITH {_SCORES}")
_add("predicate_hosts", lambda s, d: access.servers_of_predicate(_edges(s, d), 9, F.pmod(F.col("v"), F.lit(3))), f"WITH {_E} SELECT DISTINCT s % 3 AS server FROM e")


def _weighed(s, d):
    """Candidates as the operators give them: weights of vertices, of which some were moved before and some live elsewhere."""
    e, at = _edges(s, d), _located(s, d)
    counts = stats.doi(e, at)
    own = counts.groupBy("v").agg(F.sum("cnt").alias("weight"))
    weights_ = own.select("v", "weight", F.expr("CASE WHEN v % 5 = 0 THEN weight div 2 ELSE 0 END").alias("previous"))
    return placement.reassign_info(stats.vertex_stats(e), counts, at, weights_).withColumn("elsewhere", F.expr("v % 11 = 0"))


_add("reassign_info", lambda s, d: _weighed(s, d).select("v", "server", "current", "edges", "locality", "own", "previous", "active", "server_weight", "source_weight"), f"""WITH {_E}, wide AS ({_WIDE}), long AS (SELECT v, v % 3 AS cur, s0 + s1 + s2 AS own, k AS server, CASE k WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS locality FROM wide, range(3) r(k)),
per AS (SELECT server, sum(locality)::BIGINT AS weight, sum((locality > 0)::INT)::BIGINT AS active FROM long GROUP BY server)
SELECT v, l.server, cur AS current, own AS edges, locality, own, CASE WHEN v % 5 = 0 THEN own // 2 ELSE 0 END AS previous, dst.active, dst.weight AS server_weight, src.weight AS source_weight FROM long l JOIN per dst ON dst.server = l.server JOIN per src ON src.server = cur""")
_add("balance_trigger", lambda s, d: placement.balance_target(_weighed(s, d)), f"WITH {_SCORES}".replace("own >= 2 AND score", "v % 11 <> 0 AND CASE WHEN v % 5 <> 0 OR own // 2 = 0 THEN own >= 2 ELSE own - own // 2 >= 2 END AND score"))


def _moves(s, d):
    """Moves of every fifth vertex to the next server."""
    return _located(s, d).where("v % 5 = 0").select("v", F.col("server").alias("source"), F.expr("(server + 1) % 3").alias("target"))


_add("doi_follows_moves", lambda s, d: placement.follow_moves(stats.doi(_edges(s, d), _located(s, d)), _edges(s, d), _moves(s, d)), f"WITH {_E.split(', doi AS')[0]}, moved AS (SELECT s, o, CASE WHEN s % 5 = 0 THEN (s % 3 + 1) % 3 ELSE s % 3 END AS k FROM e) SELECT v, k AS server, count(*) AS cnt FROM (SELECT s AS v, k FROM moved UNION ALL SELECT o, k FROM moved) GROUP BY 1, 2")
_add("doi_dropped", lambda s, d: placement.drop_counts(stats.doi(_edges(s, d), _located(s, d)), _moves(s, d)), f"WITH {_E} SELECT v, server, cnt FROM doi WHERE v % 5 <> 0")


def _queued(s, d):
    """A queue after two pushes, the second of which repeats some of the first, and what a pop takes and leaves."""
    c = s.read.parquet(f"{d}/customer.parquet").select(F.expr("c_custkey % 3").alias("server"), F.col("c_custkey").alias("v"))
    q0 = queue.push(s.createDataFrame([], queue.QUEUE), c.where("v % 2 = 0"), 1)
    taken, rest = queue.pop(queue.push(q0, c.where("v % 4 < 2"), 2), 20)
    return taken.withColumn("taken", F.lit(True)).unionAll(rest.withColumn("taken", F.lit(False)))


_add("reassign_queue", _queued, "SELECT round, server, v, row_number() OVER (PARTITION BY server ORDER BY round, v) <= 20 AS taken FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS round, c_custkey % 3 AS server, c_custkey AS v FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 4 < 2)")


def _tasks(s, d):
    """Counters and weights after a batch of put-off tasks of all kinds: (kind, a, b, n)."""
    e = _edges(s, d).select(F.col("s").alias("a"), F.col("o").alias("b"), F.expr("s % 3").alias("server"), F.lit(1).alias("amount"))
    todo = setops.union_all(*[queue.tasks(k, e) for k in (queue.EDGE_WEIGHT, queue.VERTEX_WEIGHT, queue.DOI)])
    none = lambda cols: s.createDataFrame([], cols)
    w, v, c = queue.apply_tasks(todo, none("v1 long, v2 long, weight long"), none("v long, weight long"), none("v long, server long, cnt long"))
    return w.select(F.lit(0).alias("kind"), F.col("v1").alias("a"), F.col("v2").alias("b"), F.col("weight").alias("n")).unionAll(v.select(F.lit(1), "v", F.lit(-1).cast("long"), "weight")).unionAll(c.select(F.lit(2), "v", "server", "cnt"))


_add("deferred_tasks", _tasks, f"WITH {_E} SELECT 0 AS kind, s AS a, o AS b, 1::BIGINT AS n FROM e UNION ALL SELECT 1, s, -1, count(*) FROM e GROUP BY s UNION ALL SELECT 2, s, s % 3, count(*) FROM e GROUP BY s")


def _rounds(s, d):
    """Where vertices live after up to three rounds of 40 moves a server."""
    vertices = _located(s, d).select("v")
    out, _ = placement.rounds(_edges(s, d), vertices, s.createDataFrame([], "v long, server long"), F.pmod(F.col("v"), F.lit(3)), 1, 40)
    return out


_add("reassign_round", _rounds, f"WITH {_E}, t AS (SELECT v, arg_min(server, cnt * -1000 + CASE WHEN server = v % 3 THEN 0 ELSE 100 END + server) AS target FROM doi GROUP BY v) SELECT v, target AS server FROM (SELECT v, target, row_number() OVER (PARTITION BY v % 3 ORDER BY v) AS n FROM t WHERE target <> v % 3) WHERE n <= 40")
_add("star_reply", lambda s, d: access.star_reply(rdfize(s, d, {"brand", "ptype"}), rdfize(s, d, {"brand"}, objects=["Brand#12"]).select(F.col("s").alias("v")), ["brand", "ptype"]).select("s", F.explode("edges").alias("e")).groupBy("s").agg(F.count("*").cast("long").alias("n"), F.min("e.p").alias("first"), F.max(F.element_at("e.o_vals", 1)).alias("last")), "SELECT s, 2::BIGINT AS n, 'brand' AS first, greatest(max(o), 'Brand#12') AS last FROM triples WHERE p IN ('brand', 'ptype') AND s IN (SELECT s FROM triples WHERE p = 'brand' AND o = 'Brand#12') GROUP BY s")
_add("edge_candidates", lambda s, d: planner.candidates(scans(s, d), Pattern.of("?x", ["containsPart", "suppliedBy"], ["part/1", "part/2", "supplier/3"]), "x"), "SELECT DISTINCT s AS x FROM triples WHERE p IN ('containsPart', 'suppliedBy') AND o IN ('part/1', 'part/2', 'supplier/3')")
_add("upserted", lambda s, d: setops.upsert(_customers(s, d).select("v", F.col("c_nationkey").cast("long").alias("n")), _customers(s, d).where("c_nationkey = 3").select("v", F.lit(-1).cast("long").alias("n")), "v"), "SELECT c_custkey AS v, CASE c_nationkey WHEN 3 THEN -1 ELSE c_nationkey END::BIGINT AS n FROM customer")
_add("scored_members", lambda s, d: setops.add_scored(_customers(s, d).select("v", F.col("c_nationkey").alias("score")), _users(s, d).select("v", F.lit(7).alias("score"))), "SELECT v, max(x)::INTEGER AS score FROM (SELECT c_custkey AS v, c_nationkey AS x FROM customer UNION ALL SELECT user_id, 7 FROM events) GROUP BY v")
_add("ordered_triples", lambda s, d: setops.spo(rdfize(s, d, {"brand"})).limit(50), "SELECT s, p, o FROM triples WHERE p = 'brand' ORDER BY s, p, o LIMIT 50")
_add("ordered_by_object", lambda s, d: setops.ops(rdfize(s, d, {"brand"})).limit(50), "SELECT s, p, o FROM triples WHERE p = 'brand' ORDER BY o, p, s LIMIT 50")
_add("edge_log", lambda s, d: weights.edge_weights(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.expr("o_custkey % 50").alias("s"), F.expr("o_custkey % 7").alias("o")), 500), "SELECT o_custkey % 50 AS v1, o_custkey % 7 AS v2, count(*) AS weight FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 500) GROUP BY 1, 2")


def _partition(s, d):
    return _customers(s, d).where("c_mktsegment = 'BUILDING'").select("v", F.lit(4).alias("server"))


def _customers(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("v"), "c_nationkey", "c_mktsegment")


def _overrides(s, d):
    return _customers(s, d).where("c_nationkey = 3").select("v", F.lit(7).cast("long").alias("server"))


_HOME = "pmod(v, 3L)"
_add("located", lambda s, d: access.locate(_customers(s, d), F.expr(_HOME), _overrides(s, d)), "SELECT c_custkey AS v, CASE WHEN c_nationkey = 3 THEN 7 ELSE c_custkey % 3 END AS server FROM customer")
_add("placed_by_file", lambda s, d: placement.placed_by(_customers(s, d), _partition(s, d), F.expr(_HOME))[0], "SELECT c_custkey AS v, CASE WHEN c_mktsegment = 'BUILDING' THEN 4 ELSE c_custkey % 3 END AS server FROM customer")
_add("partition_members", lambda s, d: placement.members(_customers(s, d).select("v"), _partition(s, d), 4), "SELECT c_custkey AS v FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("place_all", lambda s, d: placement.place_all(_overrides(s, d), _customers(s, d).where("c_mktsegment = 'BUILDING'"), 2, F.expr(_HOME)), "SELECT v, server FROM (SELECT c_custkey AS v, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 WHEN c_nationkey = 3 THEN 7 ELSE c_custkey % 3 END::BIGINT AS server FROM customer) WHERE server <> v % 3")
_add("vertices_by_server", lambda s, d: access.by_server(access.locate(_customers(s, d), F.expr(_HOME))).groupBy("server").agg(F.sum(F.size("vs")).alias("n"), F.min(F.element_at("vs", 1)).alias("first")), "SELECT c_custkey % 3 AS server, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1")
_add("moved_places", lambda s, d: placement.move(_overrides(s, d), _customers(s, d).where("c_mktsegment = 'BUILDING'").select("v", F.expr("pmod(v, 2L)").alias("target")), F.expr(_HOME)), "SELECT v, server FROM (SELECT c_custkey AS v, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey % 2 WHEN c_nationkey = 3 THEN 7 ELSE c_custkey % 3 END AS server FROM customer) WHERE server <> v % 3")
_add("edge_weights", lambda s, d: weights.edge_weights(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("s"), F.col("l_suppkey").alias("o"))), "SELECT l_partkey AS v1, l_suppkey AS v2, count(*) AS weight FROM lineitem GROUP BY 1, 2")
_add("windowed_weights", lambda s, d: weights.windowed_weights(s.read.parquet(f"{d}/events.parquet").select("ts", F.col("user_id").alias("s"))).withColumn("start", F.unix_timestamp("start")), "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, user_id AS v, count(*) AS weight FROM events GROUP BY 1, 2")
_add(
    "run_summary",
    lambda s, d: stats.run_summary(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("query"), F.col("l_quantity").alias("elapsed"), F.col("l_discount").alias("eval_time"), F.col("l_linenumber").cast("long").alias("edge_cut"))),
    "SELECT l_orderkey AS query, max(l_quantity) AS elapsed, max(l_discount) AS eval_time, sum(l_linenumber)::BIGINT AS edge_cut FROM lineitem GROUP BY 1",
)
