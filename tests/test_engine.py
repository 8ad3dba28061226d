"""Unit vectors of FIXTURES.md and the behaviour of parsing, encoding, placement and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions.hashing import jump, jump_hash
from quadrille.operators import access, placement, queue, setops, stats
from quadrille.plans import catalog, planner, settings
from quadrille.plans.model import Pattern, Query, Request, parse, parse_queries, q
from quadrille.sources import triples as T
from quadrille.sources.store import Store
from quadrille.streaming import weights

TINY = [("a", "type", "T1"), ("a", "type", "T2"), ("b", "type", "T1"), ("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("c", "p", "c"), ("a", "q", "c"), ("a", "p", "b")]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(TINY, "s string, p string, o string").dropDuplicates()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_jump_vectors():
    keys = np.array([0, 1, 2, 3, 7, 10, 42, 131072, 1048576, 1099511627775])
    assert jump(keys, 3).tolist() == [0, 0, 0, 2, 0, 2, 2, 2, 1, 1]
    assert jump(keys[:8], 10).tolist() == [0, 6, 6, 8, 0, 7, 2, 9]
    assert np.bincount(jump(np.arange(30000), 3)).tolist() == [9999, 10000, 10001]


def test_jump_column_keeps_null(spark):
    df = spark.createDataFrame([(42,), (None,)], "v long")
    assert sorted((r[0] is None, r[1]) for r in df.select("v", jump_hash("v", 3)).collect()) == [(False, 2), (True, None)]
    with pytest.raises(ValueError):
        jump_hash("v", 0)


def test_patterns(tiny):
    assert rows(planner.solve(tiny, q("?x", "?x type {T1, T2}"))) == [("a",), ("b",)]
    assert rows(planner.solve(tiny, q("?x", "?x p ?x"))) == [("c",)]
    assert rows(planner.solve(tiny, q("?x ?y ?z", "?x p ?y . ?y p ?z . ?z p ?x"))) == [("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"), ("c", "c", "c")]
    assert rows(planner.solve(tiny, q("?x ?y", "?x {p, q} ?y"))) == [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "c")]
    assert rows(access.neighbourhood(tiny, "a")) == [("T1",), ("T2",), ("b",), ("c",)]
    assert rows(stats.predicate_stats(tiny)) == [("p", 4, 3, 3), ("q", 1, 1, 1), ("type", 3, 2, 2)]
    assert planner.solve(tiny, Query()).count() == 1
    assert planner.solve(tiny, q("?x", "?x p ?y . a p zzz")).count() == 0
    assert planner.solve(tiny, q("?x", "?x type T1 . a p b")).count() == 2


def test_factorised(tiny):
    query = q("?x ?y", "?x type T1 . ?x {p, q} ?y")
    b = planner.bindings(tiny, query)
    assert rows(b["x"]) == [("a",), ("b",)] and rows(b["y"]) == [("b",), ("c",)]
    e = planner.edges(tiny, query)
    assert rows(e[0]) == [("a", "type", "T1"), ("b", "type", "T1")] and rows(e[1]) == [("a", "p", "b"), ("a", "q", "c"), ("b", "p", "c")]
    assert [rows(x) for x in planner.reduce_semi(tiny, q("?x ?y", "?x type T2 . ?x p ?y"))] == [[("a",)], [("a", "b")]]


def test_order_never_crosses_connected_bodies():
    for kind in catalog.SLOTS:
        for query in catalog.bank(kind):
            bound: set = set()
            for i, p in enumerate(planner.order(query.body)):
                assert not i or bound & set(p.variables)
                bound |= set(p.variables)


def test_text_round_trip():
    for kind in catalog.SLOTS:
        for query in catalog.bank(kind):
            if query.body:
                assert parse(str(query)) == query and Query.from_dict(query.to_dict()) == query
    assert len(parse_queries("SELECT ?a WHERE {\n\ta p ?a .\n}\n\nselect ?b where { ?b q {x, y} . }")) == 2
    assert str(catalog.bank("lubm", full_names=True)[5].body[0].p).startswith("<http://www.w3.org")
    with pytest.raises(ValueError):
        parse("SELECT ?z WHERE { a p ?x . }")
    with pytest.raises(ValueError):
        Query().add_to_head("a")
    with pytest.raises(ValueError):
        Pattern.of(["?x", "a"], "p", "o")


def test_query_edits():
    query = q("?x", "?x p a . ?x p a . ?x q b")
    assert query.replace(Pattern.of("?x", "p", "a"), Pattern.of("?x", "p", "c")) == 2 and query.replace(Pattern.of("no", "no", "no"), query.body[0]) == -1
    with pytest.raises(IndexError):
        query.pattern(3)


def test_catalog_runs_on_a_graph(spark):
    ub = [("s1", "rdf:type", "ub:GraduateStudent"), ("u", "rdf:type", "ub:University"), ("d", "rdf:type", "ub:Department"), ("s1", "ub:memberOf", "d"), ("d", "ub:subOrganizationOf", "u"), ("s1", "ub:undergraduateDegreeFrom", "u"), ("s2", "rdf:type", "ub:UndergraduateStudent")]
    t = spark.createDataFrame(ub, "s string, p string, o string")
    bank = catalog.bank("lubm")
    assert rows(planner.solve(t, bank[1])) == [("s1", "u", "d")]
    assert rows(planner.solve(t, bank[5])) == [("s1",), ("s2",)] and rows(planner.solve(t, bank[13])) == [("s2",)]


def test_workload():
    a, b = q("?x", "?x p ?y"), q("?x", "?x r ?y")
    got = catalog.workload([(a, 0, "o", ["t1", "t2"]), (b, 0, "s", [])], [50, 50], 10, seed=4)
    assert len(got) == 10 and sum("r" in str(x.body[0].p) for x in got) == 4
    assert got == catalog.workload([(a, 0, "o", ["t1", "t2"]), (b, 0, "s", [])], [50, 50], 10, seed=4)


def test_instances(spark):
    d = spark.createDataFrame([("<Uni12.edu>", 1), ("<Uni.edu>", 2), ("<Unix.edu>", 3)], "term string, id long")
    assert rows(catalog.instances(d, "<Uni", ".edu>")) == [("<Uni.edu>",), ("<Uni12.edu>",)]


def test_sources(spark, tmp_path, tiny):
    (tmp_path / "t.nt").write_text("a p b .\n\n# note\na p b .\nb q c\n")
    (tmp_path / "ids.nt").write_text("1 2 3\n")
    (tmp_path / "d.txt").write_text("<x y> 7\nz\t8\nbad\n")
    (tmp_path / "part").write_text("1 0\n2 2\n")
    assert rows(T.read_text(spark, str(tmp_path / "t.nt"))) == [("a", "p", "b"), ("b", "q", "c")]
    assert rows(T.read_text(spark, str(tmp_path / "ids.nt"), ids=True)) == [(1, 2, 3)]
    assert rows(T.read_dictionary(spark, str(tmp_path / "d.txt"))) == [("<x y>", 7), ("z", 8)]
    assert rows(T.read_partition(spark, str(tmp_path / "part"))) == [(1, 0), (2, 2)]
    T.write(tiny, str(tmp_path / "out"))
    assert rows(T.read(spark, str(tmp_path / "out"))) == rows(tiny)
    assert T.insert(tiny, tiny).count() == tiny.count()


def test_dictionary_round_trip(spark):
    t = spark.createDataFrame([("a", "rdf:type", "T"), ("a", "p", "b")], "s string, p string, o string")
    d = T.build_dictionary(t)
    assert d.count() == d.select("id").distinct().count() == 5 and T.lookup(d, "rdf:type", "nope") == {"rdf:type": 1, "nope": 0}
    e = T.encode(t, d)
    assert rows(T.decode(e, d)) == rows(t)


def test_sets(spark):
    f = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    assert rows(setops.intersect(f(1, 2, 2, 3), f(2, 2, 4))) == [(2,), (2,)]
    assert rows(setops.difference(f(3, 1, 1, 2), f(2))) == [(1,), (1,), (3,)]
    assert [r.v for r in setops.sorted_distinct(f(3, 1, 3, 2)).collect()] == [1, 2, 3]
    assert rows(setops.intersect_many(f(1, 2), f(2, 3), f(2, 2))) == [(2,)]
    a = spark.createDataFrame([(1, 2, "OUT", [3, 4]), (1, 2, "OUT", [4, 5])], "v int, p int, d string, o_vals array<int>")
    assert setops.dedup_adjacency(a).first().o_vals == [3, 4, 5]
    many = spark.createDataFrame([("h", "p", f"{i:02}") for i in range(9)] * 2 + [("i", "p", "x")], "s string, p string, o string")
    parts = access.adjacency(many, block=2).orderBy("v", "block").collect()
    assert max(len(r.o_vals) for r in parts) <= 2 and [x for r in parts for x in r.o_vals] == [f"{i:02}" for i in range(9)] + ["x"]
    held = access.by_server(many.select(F.col("o").alias("v"), F.lit(1).alias("server")), 4).orderBy("block").collect()
    assert max(len(r.vs) for r in held) <= 4 and [x for r in held for x in r.vs] == [f"{i:02}" for i in range(9)] + ["x"]


def test_doi_and_targets(spark):
    e = spark.createDataFrame([(1, 9, "OUT", 2), (1, 9, "OUT", 3), (4, 9, "OUT", 2)], "s long, p long, d string, o long")
    loc = access.locate(spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "v long"), F.pmod(F.col("v"), F.lit(3)))
    assert rows(stats.doi(e, loc)) == [(1, 1, 2), (2, 1, 2), (3, 1, 1), (4, 1, 1)]
    assert [r[2] for r in rows(placement.doi_target(stats.doi(e, loc), loc))] == [1, 1, 1, 1]
    assert rows(stats.edge_cut(e, loc)) == [(1, 2)]
    home = F.pmod(F.col("v"), F.lit(3))
    assert rows(placement.plan_round(e, spark.createDataFrame([], "v long, server long"), loc, home)) == [(2, 1), (3, 1)]
    assert rows(placement.move(spark.createDataFrame([(2, 1)], "v long, server long"), spark.createDataFrame([(2, 2)], "v long, target long"), home)) == []
    assert stats.doi_wide(stats.doi(e, loc), 3).where("v = 1").first()[1:] == (0, 2, 0)


def test_balance(spark):
    one = lambda *x: spark.range(1).select(placement.balance_score(*[F.lit(v) for v in x])).first()[0]
    assert one(120, 80, 4, 100, 5, 10) == 4 and one(120, 120, 4, 100, 5, 10) == float("-inf")
    assert one(120, 80, 0, 100, 5, 10) == 10 and one(90, 80, 4, 100, 5, 10) == float("-inf")
    hit = lambda p, w, **k: spark.range(1).select(placement.triggered(F.lit(p), F.lit(w), placement.Config(**k))).first()[0]
    assert [hit(0, 1), hit(0, 2), hit(4, 5), hit(4, 6)] == [False, True, False, True]
    assert [hit(4, 7, trigger_double=True), hit(4, 8, trigger_double=True)] == [False, True]
    c = spark.createDataFrame([(1, k, 0, 3, 0, 9, 120, 80, 4, 100, 5, 10 + k) for k in range(3)] + [(2, 0, 0, 0, 0, 9, 120, 80, 4, 100, 5, 1)], "v long, server int, current int, edges int, previous int, weight int, source_weight int, server_weight int, active int, average int, own int, locality int")
    assert rows(placement.balance_target(c)) == [(1, 2), (2, None)]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 2), (1, 3)], "s long, o long").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("s long, o long").parquet(str(tmp_path / "in"))
    run = weights.vertex_weights(src).writeStream.outputMode("complete").format("memory").queryName("w").start()
    run.processAllAvailable()
    run.stop()
    assert rows(spark.table("w")) == [(1, 2)]


# ---------------------------------------------------------------- store, banks, settings


def test_scans_reach_parquet(spark):
    sf = "/root/testdata/sf0.001"
    plan = planner.solve(T.scans(spark, sf), q("?o", "order/7 placedBy ?c . ?o placedBy ?c"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan and "nation.parquet" not in plan
    point = planner.solve(T.scans(spark, sf), q("?x", "?x inNation nation/3"))
    assert point._jdf.queryExecution().executedPlan().toString().count("EqualTo(") >= 2 and point.count() == 6
    assert T.rdfize(spark, sf, {"inNation"}, objects=["nation/03", "nation/x", "region/1"]).count() == 0


def test_order_by_statistics_joins_no_large_groups():
    body = q("?o ?c ?s ?n", "?o placedBy ?c . ?o suppliedBy ?s . ?c inNation ?n . ?s inNation ?n").body
    stats = {"placedBy": (150_000, 150_000, 10_000), "suppliedBy": (600_000, 150_000, 1_000), "inNation": (16_000, 16_000, 25)}
    assert [body.index(p) for p in planner.order(body, stats)] == [2, 0, 1, 3]  # not both inNation first: 10 million pairs


def test_store(spark, tmp_path):
    t = spark.createDataFrame([("a", "rdf:type", "T"), ("a", "p", "b"), ("b", "p", "c"), ("c", "q", "a")], "s string, p string, o string")
    store = Store.build(t, f"file://{tmp_path}/one")
    assert rows(store.solve(q("?x ?y", "?x p ?y . ?x rdf:type T"))) == [("a", "b")]
    assert rows(store.solve(q("?x", "?x p {b, nowhere}"))) == [("a",)] and store.solve(q("?x", "?x nowhere ?y")).columns == ["x"]
    assert store.solve(q("?x", "nobody p ?x")).count() == 0 and rows(store.solve(q("?y ?p", "c ?p ?y"))) == [("a", "q")]
    assert store.stats[store.ids("p")["p"]] == (2, 2, 2) and store.ids("rdf:type", "zzz") == {"rdf:type": 1, "zzz": 0}
    more = store.insert(spark.createDataFrame([("b", "p", "c"), ("d", "p", "a")], "s string, p string, o string"), f"file://{tmp_path}/two")
    assert rows(more.solve(q("?x ?y", "?x p ?y"))) == [("a", "b"), ("b", "c"), ("d", "a")]
    assert more.ids("a", "b", "c", "p") == store.ids("a", "b", "c", "p")
    plan = store.solve(q("?x", "?x p b"), decoded=False)._jdf.queryExecution().executedPlan().toString()
    assert "by_object" in plan and "PartitionFilters: [isnotnull(p" in plan and "EqualTo(o," in plan


def test_hosts_and_dictionary(spark):
    d = T.build_dictionary(spark.createDataFrame([("a", "rdf:type", "T")], "s string, p string, o string"))
    more = T.extend_dictionary(d, spark.createDataFrame([("a",), ("new",), ("new",), (None,)], "term string"))
    known = {r.term: r.id for r in d.collect()}
    now = {r.term: r.id for r in more.collect()}
    assert known.items() <= now.items() and set(now) == {*known, "new"} and now["new"] > max(known.values())
    got = {r.term: (r.id, r.server) for r in T.hosts_of_terms(d, spark.createDataFrame([("a",), ("zz",)], "term string"), 3).collect()}
    assert got["a"] == (known["a"], int(jump(np.array([known["a"]]), 3)[0])) and got["zz"][0] == 0


def test_bank_edits():
    bank = catalog.Bank("yago2")
    n = len(bank)
    assert n == 14 and bank.add(q("?x", "?x p ?y")) == n and len(bank) == n + 1
    bank.add_heads(n, "?y")
    bank.set_body(n, q("?x ?y", "?x q ?y").body)
    assert str(bank.get(n).body[0].p) == "q" and bank.get(n).head == ["x", "y"] and bank.delete(n).head == ["x", "y"]
    with pytest.raises(ValueError):
        bank.update(0, Query(["z"], []))
    with pytest.raises(IndexError):
        bank.get(n)
    bank.clear()
    assert not len(bank)


def test_query_files_and_requests(tmp_path):
    for n in (10, 2):
        (tmp_path / f"query_workload_Q{n}").write_text(f"SELECT ?v0 WHERE {{\n\t?v0 p{n} a .\n}}\n\nSELECT ?v0 WHERE {{\n?v0 p{n} b .\n}}\n\n")
    (tmp_path / "other").write_text("no query")
    got = catalog.read_query_files(tmp_path)
    assert list(got) == [2, 10] and [str(x.body[0]) for x in got[10]] == ["?v0 p10 a", "?v0 p10 b"]
    r = Request(got[2][0], 3, "node1", 1.5)
    assert Request.from_json(r.to_json()) == r


def test_settings(tmp_path):
    text = 'A = "x;y" // note\nTRIGGER_K = 3;\n# note\nGAMA = 1.5\nENABLE_REASSIGN = false\nnum_workloads = 2; data_set_type = "lubm";\nworkload_setting = {\n pattern = (1,6); pattern_frequency = ((100,0),(0,100)); num_query_per_workload = [10, 5];\n};'
    got = settings.parse_settings(text)
    assert got["A"] == "x;y" and settings.config(got, 4) == placement.Config(4, False, 3, False, 1.5)
    assert settings.workloads(got) == {"bank": "lubm", "pattern": [1, 6], "frequency": [[100, 0], [0, 100]], "queries": [10, 5]}
    with pytest.raises(ValueError):
        settings.parse_settings("a = (1, 2")
    (tmp_path / "hosts").write_text("node2 7471 /tmp/a.sock \n\nnode4 7471 /tmp/b.sock\n")
    assert [h.address for h in settings.read_hosts(tmp_path / "hosts")] == ["node2", "node4"]
    (tmp_path / "list").write_text("a.nt\nb.nt\n")
    assert settings.read_list(tmp_path / "list") == ["a.nt", "b.nt"]
    (tmp_path / "xstr_normal1").write_text("")
    assert T.dictionary_path(str(tmp_path)).endswith("xstr_normal1")
    own, n = settings.WORKLOAD, len(settings.WORKLOAD["queries"])
    made = catalog.workload([(catalog.bank(own["bank"])[i], 0, "o", []) for i in own["pattern"]], own["frequency"][1], own["queries"][1])
    assert n == 5 and len(made) == 10 and all(x == catalog.bank("lubm")[6] for x in made)


def test_load_many_files(spark, tmp_path):
    (tmp_path / "a.nt").write_text("1 2 3\n1 2 4\n")
    (tmp_path / "b.nt").write_text("1 2 3\n5 6 7\n")
    got = T.load(spark, str(tmp_path / "a.nt"), str(tmp_path / "b.nt"), ids=True, into=f"file://{tmp_path}/out")
    assert rows(got) == [(1, 2, 3), (1, 2, 4), (5, 6, 7)]


def test_rounds_settle(spark):
    e = spark.createDataFrame([(s, 9, "OUT", o) for s, o in ((1, 2), (1, 3), (4, 2), (4, 6), (7, 6), (7, 9))], "s long, p long, d string, o long")
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6, 7, 9)], "v long")
    home = F.pmod(F.col("v"), F.lit(3))
    none = spark.createDataFrame([], "v long, server long")
    out, moves = placement.rounds(e, v, none, home, 5, 1)  # a server takes one vertex a round
    assert moves == [2, 1, 1, 0] and rows(out) == [(2, 1), (3, 1), (6, 1), (9, 1)]
    at = access.locate(v, home, out)
    assert stats.edge_cut(e, at).count() == 0
    first, _ = placement.rounds(e, v, none, home, 1, 1)
    moved = access.locate(v, home, first).join(access.locate(v, home).withColumnRenamed("server", "source"), "v").where("server <> source").withColumnRenamed("server", "target")
    assert rows(placement.follow_moves(stats.doi(e, access.locate(v, home)), e, moved)) == rows(stats.doi(e, access.locate(v, home, first)))
    assert placement.rounds(e, v, none, home, c=placement.Config(enable_reassign=False))[1] == []


def test_queue_keeps_repeats_unless_told(spark):
    new = spark.createDataFrame([(0, 5), (0, 5), (1, 6)], "server long, v long")
    empty = spark.createDataFrame([], queue.QUEUE)
    assert rows(queue.push(empty, new, 1)) == [(1, 0, 5), (1, 1, 6)]
    twice = queue.push(empty, new, 1, False)
    taken, rest = queue.pop(twice, 1)
    assert rows(taken) == [(1, 0, 5), (1, 1, 6)] and rows(rest) == [(1, 0, 5)] and rows(queue.waiting(rest)) == [(0, 1)]
    assert rows(queue.push(rest, new, 2)) == [(1, 0, 5), (2, 1, 6)]
    with pytest.raises(ValueError):
        queue.tasks(9, new)


def test_orders_and_stars(spark, tiny):
    assert [tuple(r) for r in setops.spo(tiny).collect()] == sorted(set(TINY)) and [tuple(r) for r in setops.ops(tiny).collect()] == sorted(set(TINY), key=lambda t: t[::-1])
    d = tiny.select("s", "p", F.lit("OUT").alias("d"))
    assert [tuple(r) for r in setops.spd(d).collect()] == sorted((s, p, "OUT") for s, p, _ in set(TINY))
    got = access.star_reply(tiny, spark.createDataFrame([("a",), ("c",)], "v string"), ["p", "q"]).collect()
    assert sorted((r.s, [(x.p, x.o_vals) for x in r.edges]) for r in got) == [("a", [("p", ["b"]), ("q", ["c"])]), ("c", [("p", ["a", "c"])])]
    assert rows(planner.star(tiny, q("?x", "?x type T1 . ?x q ?y").body, "x")) == [("a",)]
    kept = setops.add_scored(spark.createDataFrame([(1, 5)], "v int, score int"), spark.createDataFrame([(1, 9), (2, 1)], "v int, score int"), keep=True)
    assert rows(kept) == [(1, 5), (2, 1)]
