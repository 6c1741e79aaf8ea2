"""Values taken by hand: search, routes, resolution, conditions, dispatch, ranking, text."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import paths, text
from loomgraph.operators import aggregates, conditions, dispatch, links, ranking, resolution, search, sets, traces, traversal, workspace

NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, docstring string, signature string, parent_id string, module_id string, seq bigint"


def nodes(spark, *rows):
    base = {"kind": "class", "qualified_name": None, "file_path": "src/a.java", "language": "java", "start_line": 1, "end_line": 2, "docstring": "", "signature": "", "parent_id": None, "module_id": "m"}
    out = []
    for i, row in enumerate(rows):
        full = base | {"name": row["id"], "seq": i} | row
        full["qualified_name"] = full["qualified_name"] or full["name"]
        out.append(tuple(full[c.split()[0]] for c in NODE.split(", ")))
    return spark.createDataFrame(out, NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(s, t, k, m, 1, 1, i) for i, (s, t, k, m) in enumerate(rows)], "source string, target string, kind string, metadata string, line int, col int, seq bigint")


@pytest.mark.parametrize("a,b,d", [("hello", "hello", 0), ("", "hel", 3), ("ab", "ba", 1), ("cat", "car", 1), ("cat", "cats", 1), ("Hello", "hello", 1), ("ca", "abc", 3), ("abcdef", "zzzzzz", 4)])
def test_osa(a, b, d):
    assert search.osa(a, b) == d


def test_osa_never_exceeds_levenshtein():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=200, deadline=None)
    @given(st.text("ab", max_size=7), st.text("ab", max_size=7))
    def check(a, b):
        assert search.osa(a, b) == search.osa(b, a)
        assert (search.osa(a, b) == 0) == (a == b)

    check()


def test_query_fields():
    q = search.parse_query('find kind:class lang:java "x" UserService path:*.ts foo:bar')
    assert (q.kind, q.language, q.path, q.text) == ("class", "java", "*.ts", 'find "x" UserService foo:bar')
    assert search.parse_query('kind:"my class" A').kind == "my class"


def test_search(spark):
    n = nodes(spark, {"id": "1", "name": "UserService", "docstring": "loads the user"}, {"id": "2", "name": "UserController"}, {"id": "3", "name": "AuthService", "file_path": "src/test/AuthTest.java", "docstring": "user user"}, {"id": "4", "name": None, "docstring": None, "signature": None})
    assert {r.id for r in search.search(n, "user").collect()} == {"1", "3"}
    assert search.search(n, "user").first().id == "1"
    assert {r.id for r in search.search(n, "UserServic").collect()} >= {"1"}
    assert search.search(n, "zzzzzzzzzz").count() == 0
    assert {r.id for r in search.search(n, "kind:class name:controller").collect()} == {"2"}
    near = search.fuzzy(n, ["UserServcie"]).collect()
    assert near[0].node_id == "1" and near[0].distance == 1


def test_text(spark):
    row = spark.createDataFrame([("HTTPServerName", 'value = "a,b", key = {x, y}, fn(1,2)', "lb://user-service/x", "${k}")], "n string, a string, u string, v string")
    got = row.select(text.split_camel("n").alias("w"), text.split_arguments("a").alias("s"), text.argument("a", "key").alias("k"), text.service_of_uri("u").alias("h")).first()
    assert got.w == ["http", "server", "name"] and got.s == ['value = "a,b"', "key = {x, y}", "fn(1,2)"] and got.k == "{x, y}" and got.h == "user-service"
    tx = spark.createDataFrame([("propagation = Propagation.REQUIRES_NEW, timeout = 5, rollbackFor = {A.class, B.class}",), ("",)], "a string").select(text.transaction_settings("a").alias("t")).collect()
    assert tx[0].t.propagation == "REQUIRES_NEW" and tx[0].t.timeout == 5 and tx[0].t.rollback_for == ["A", "B"] and tx[1].t.propagation == "REQUIRED"


def test_paths(spark):
    rows = spark.createDataFrame([("src/main/A.java",), ("src/test/ATest.java",), ("target/generated-sources/A.java",), ("project/node_modules/x.js",), ("foo.bar",)], "p string")
    assert [r[0] for r in rows.select(paths.path_relevance("p")).collect()] == [1, -1, -2, -2, 0]


def test_routes_match(spark):
    calls = spark.createDataFrame([(1, "GET", "/api/orders/123?x=1"), (2, "GET", "/other"), (3, "POST", "http://h/api/Orders/new/")], "call_id int, method string, url string")
    routes = spark.createDataFrame([(1, "GET", "/api/orders/{id}"), (2, "ANY", "/api/orders/new"), (3, "GET", "/api/users/{id}")], "route_id int, verb string, path string")
    got = {r.call_id: (r.route_id, r.score) for r in links.match_routes(calls, routes).collect()}
    assert got[1] == (1, 95) and got[3][0] == 2 and 2 not in got
    inside = links.contained_routes(routes.select("path"), spark.createDataFrame([("orders/new",), ("/api",)], "path string")).collect()
    assert {(r.path, r.other_path) for r in inside} == {("/api/orders/new", "orders/new"), ("/api/orders/{id}", "/api"), ("/api/orders/new", "/api"), ("/api/users/{id}", "/api")}


def test_match_confidence(spark):
    n = nodes(spark, {"id": "1", "name": "UserService", "qualified_name": "com.app.UserService"}, {"id": "2", "name": "Other", "qualified_name": "x.UserService"})
    got = {r.id: (r.confidence, r.strategy) for r in resolution.match_references(spark.createDataFrame([("UserService",)], "ref string"), n).collect()}
    assert got["1"] == (0.7, "qualified_name_contains") and got["2"][0] == 0.6


def test_conditions(spark):
    uses = spark.createDataFrame([("a", "ConditionalOnProperty", 'name = "x.on", havingValue = "yes"'), ("b", "ConditionalOnProperty", 'prefix = "x", name = "off", matchIfMissing = true'), ("c", "Profile", '"prod"'), ("d", "ConditionalOnExpression", "\"#{'${x.on}' == 'yes'}\""), ("e", "ConditionalOnProperty", '"gone"'), ("a", "ConditionalOnClass", "Foo.class"), ("z", "Other", "")], "id string, annotation string, args string")
    config = spark.createDataFrame([("x.on", "yes")], "key string, value string")
    got = {(r.id, r.type): (r.matched, r.confidence) for r in conditions.evaluate(conditions.parse_conditions(uses), config, ["dev"]).collect()}
    assert got == {("a", "property"): (True, 0.9), ("b", "property"): (True, 0.7), ("c", "profile"): (False, 0.9), ("d", "expression"): (True, 0.6), ("e", "property"): (False, 0.8), ("a", "class"): (True, 0.5)}
    active = {r.id: (r.active, r.confidence) for r in conditions.active_symbols(conditions.evaluate(conditions.parse_conditions(uses), config, [])).collect()}
    assert active["a"] == (True, 0.7) and active["e"] == (False, 0.24)


def test_dispatch(spark):
    n = nodes(spark, {"id": "P", "kind": "interface", "name": "PaymentStrategy"}, {"id": "A"}, {"id": "B"}, {"id": "C"}, {"id": "U", "kind": "interface", "name": "IUsers"}, {"id": "UI", "name": "UsersImpl"}, {"id": "T", "name": "Tx"}, {"id": "T.m", "kind": "METHOD", "name": "m", "parent_id": "T"}, {"id": "f", "kind": "function", "name": "createA"})
    e = edges(spark, ("A", "P", "implements", "{}"), ("B", "P", "implements", "{}"), ("C", "P", "implements", "{}"), ("C", "P", "implements", "{}"), ("T", "ext://x/Transactional", "decorates", None), ("f", "A", "instantiates", None))
    got = {(r.source, r.target, r.kind): (r.confidence, r.provenance) for r in dispatch.infer(n, e).collect()}
    assert {t for s, t, k in got if s == "P" and k == "dispatch_registration"} == {"A", "B", "C"}
    assert got["U", "UI", "conditional_impl"] == (0.9, "conditional_bean") and got["T", "T.m", "aop_advises"] == (0.7, "aop_proxy") and got["f", "A", "dispatch_registration"][0] == pytest.approx(0.4)
    assert links.dead_code(e, n).count() >= 1 and {r.implementation_id for r in links.implementations(e, n).where("interface_id = 'P'").collect()} == {"A", "B", "C"}


def test_paths_and_cycles(spark):
    steps = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)] + [("n2", "n0"), ("n1", "n0"), (None, "n1"), ("n0", "n0")], "source string, target string")
    start, end = spark.createDataFrame([("n0",)], "id string"), spark.createDataFrame([("n5",)], "id string")
    assert [r.length for r in traversal.simple_paths(steps, start, end, 6).collect()] == [5]
    assert traversal.simple_paths(steps, start, end, 3).count() == 0
    assert {tuple(r.path) for r in traversal.cycles(steps, 4).collect()} == {("n0", "n1"), ("n0", "n1", "n2")}
    assert {r.id: r.depth for r in traversal.reach(steps, start, 2).collect()} == {"n0": 0, "n1": 1, "n2": 2}


def test_transitive_callers(spark):
    n = nodes(spark, *[{"id": f"f{i}", "kind": "function"} for i in range(6)])
    e = edges(spark, *[(f"f{i}", f"f{i + 1}", "calls", None) for i in range(5)])
    assert {r.symbol: r.n_callers for r in traversal.transitive_callers(e, n, 3).collect()} == {"f1": 1, "f2": 2, "f3": 3, "f4": 3, "f5": 3}


def test_transitive_callers_of_any_depth(spark):
    # A chain of twelve calls with a ring of three behind it.
    calls = [(f"f{i}", f"f{i + 1}") for i in range(12)] + [("f12", "r0"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0")]
    n = nodes(spark, *[{"id": i, "kind": "function"} for i in [f"f{i}" for i in range(13)] + ["r0", "r1", "r2"]])
    got = {r.symbol: r.n_callers for r in traversal.transitive_callers(edges(spark, *[(a, b, "calls", None) for a, b in calls]), n).collect()}
    assert got == {f"f{i}": i for i in range(1, 13)} | {"r0": 16, "r1": 16, "r2": 16}


def test_sketches_with_many_callers_settle(spark):
    # More callers than a sketch lists one by one; the ring ends only if equal registers are seen as equal.
    calls = [(f"c{i}", f"r{i % 3}") for i in range(3000)] + [("r0", "r1"), ("r1", "r2"), ("r2", "r0")]
    n = nodes(spark, *[{"id": i, "kind": "function"} for i in [f"c{i}" for i in range(3000)] + ["r0", "r1", "r2"]])
    got = {r.symbol: r.n_callers for r in traversal.transitive_callers(edges(spark, *[(a, b, "calls", None) for a, b in calls]), n).collect()}
    assert len(set(got.values())) == 1 and abs(got["r0"] - 3003) < 150


def test_distance_from_entry_of_any_depth(spark):
    # A chain of twenty calls that returns to its middle, and a symbol that no entry reaches.
    n = nodes(spark, {"id": "f0", "kind": "entry_point"}, *[{"id": f"f{i}", "kind": "function"} for i in range(1, 21)], {"id": "alone", "kind": "function"})
    e = edges(spark, *[(f"f{i}", f"f{i + 1}", "calls", None) for i in range(20)], ("f20", "f9", "calls", None), ("alone", "f20", "calls", None))
    assert {r.id: r.depth for r in traversal.distance_from_entry(e, n).collect()} == {f"f{i}": i for i in range(21)}


def test_references_contained_anywhere(spark):
    texts = ["ActivePremiumStore", "PremiumStore", "Prem", "eP", "x", "countManualRefund", "Store.count", "a.b", "absent", ""]
    names = [("ActivePremiumStore", "ActivePremiumStore"), ("countManualRefund", "ActivePremiumStore.countManualRefund"), ("run", "a.b.ActivePremiumStore.run"), (None, "a.b.eP"), ("x", "other"), ("x", None), ("", "q.")] + [("run", f"z{i % 3}.ActivePremiumStore.run") for i in range(40)]
    n = nodes(spark, *[{"id": f"n{i:02}", "name": a} for i, (a, _) in enumerate(names)]).drop("qualified_name")
    n = n.join(spark.createDataFrame([(f"n{i:02}", q) for i, (_, q) in enumerate(names)], "id string, qualified_name string"), "id")
    got = {}
    for r in resolution.match_references(spark.createDataFrame([(t,) for t in texts], "ref string"), n).collect():
        got.setdefault(r.ref, set()).add((r.id, r.confidence))

    def best(ref):
        out = []
        for i, (name, q) in enumerate(names):
            q = name if q is None else q
            base = 0.9 if name == ref == q else 0.7 if name == ref else 0.6 if q.endswith("." + ref) else 0.3
            score = max(base, 0.5) if ref in q else base
            if score >= 0.5 and (ref or name == ""):
                out.append((-score, f"n{i:02}"))
        return {(i, -s) for s, i in sorted(out)[:10]}

    assert got == {t: best(t) for t in texts if best(t)} and len(got["PremiumStore"]) == 10


def test_consumers_by_common_words(spark):
    # All words are shared by more than a hundred provided names; the last provider is the consumer itself.
    provided = [("provides", f"svc/p{i:03}", "http_endpoint", f"/orders/q{i:03}", "p") for i in range(150)] + [("provides", f"svc/{p}", "http_endpoint", "/orders", "p") for p in ("x", "y", "z")]
    rows = spark.createDataFrame([*provided, ("consumes", "svc/z", "http_request", "http://h/orders/1", "p")], "side string, project string, kind string, name string, path string")
    got = workspace.match_consumers(rows).collect()
    assert [(r.consumer, r.provider, r.provided, r.score) for r in got] == [("svc/z", "svc/y", "/orders", 15)]


def test_workspace_reads_poms(spark):
    pom = "<project><groupId>g</groupId><artifactId>shop</artifactId><version>1</version><dependencies><dependency><groupId>o</groupId><artifactId>json</artifactId><version>2</version></dependency></dependencies></project>"
    same = pom.replace("json", "xml")
    files = spark.createDataFrame([("svc/a/pom.xml", "xml", pom, 1, "h"), ("svc/b/pom.xml", "xml", same, 1, "i")], "path string, language string, content string, indexed_at bigint, content_hash string")
    got = {(r.side, r.project, r.kind, r.name) for r in workspace._dependencies(files).collect()}
    assert got == {("consumes", "svc/a", "dependency", "o:json:2"), ("consumes", "svc/b", "dependency", "o:xml:2")}


def test_components_of_any_size(spark):
    # A ring of five, a way from it to a ring of two, and a tail.
    ring = [(f"a{i}", f"a{(i + 1) % 5}") for i in range(5)]
    steps = spark.createDataFrame([*ring, ("a2", "z1"), ("z1", "z2"), ("z2", "z1"), ("z2", "t"), ("s", "a0"), ("t", "t")], "source string, target string")
    got = {(r.component, r.id, r.size) for r in traversal.components(steps).collect()}
    assert got == {("a4", f"a{i}", 5) for i in range(5)} | {("z2", "z1", 2), ("z2", "z2", 2)}


def test_traces_keep_all_that_is_touched_outside(spark):
    n = nodes(spark, {"id": "E", "kind": "entry_point"}, {"id": "E.m", "kind": "method", "parent_id": "E"}, {"id": "s", "kind": "method"}, {"id": "q", "kind": "method"})
    e = edges(spark, ("E.m", "s", "calls", None), ("E.m", "q", "calls", None), ("s", "topic:b", "dispatch_call", None), ("s", "cache:a", "references", None), ("s", "ext://x/Y", "calls", None), ("s", "topic:b", "references", None))
    rows = traces.full_traces(e, n)
    got = {}
    for r in rows.orderBy("trace_id", "hop").collect():
        got.setdefault(r.trace_id, []).append((r.hop, r.node_id, r.role))
    start = [(0, "E", "entry_point"), (1, "E.m", "method")]
    assert sorted(got.values()) == [[*start, (2, "q", "callee")], [*start, (2, "s", "callee"), (3, "cache:a", "outside"), (4, "ext://x/Y", "outside"), (5, "topic:b", "outside")]]
    assert {r.target for r in traces.trace_steps(rows).collect()} == {"E.m", "q", "s", "cache:a", "ext://x/Y", "topic:b"}


def test_variables(spark):
    rows = spark.createDataFrame([("m", "a", "b"), ("m", "b", "c"), ("m", "c", '"alipay"'), ("m", "d", "d2")], "method string, variable string, value string")
    got = {r.variable: (r.origin, r.hops) for r in traversal.trace_variables(rows).collect()}
    assert got["a"] == ('"alipay"', 2) and got["d"] == ("d2", 0)


def test_pages_and_budget(spark):
    rows = ranking.page(spark.range(7), ["id"], 3, 5).collect()
    assert [r.id for r in rows] == [5, 6] and rows[0].total == 7 and rows[0].truncated is False
    assert ranking.budget(100)["total"] == 30 and ranking.budget(20_000)["collapse"]
    cut = spark.createDataFrame([("ab\ncdefgh",), ("short",)], "t string").select(ranking.shortened("t", 8)).collect()
    assert [r[0] for r in cut] == ["ab\ncdefg", "short"]


def test_sets(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, seq int, v string")
    assert {r.k: r.v for r in sets.first_wins(rows, ["k"]).collect()} == {"a": "y", "b": None}
    assert {r.k: r.v for r in sets.last_wins(rows, ["k"]).collect()} == {"a": "x", "b": None}
    other = spark.createDataFrame([("a", 2, "z"), ("c", 1, "n")], "k string, seq int, v string")
    assert {r.k: r.change for r in sets.changes(sets.last_wins(rows, ["k"]), other, ["k"], ["v"]).collect()} == {"a": "modified", "b": "removed", "c": "added"}


def test_consumers(spark):
    rows = spark.createDataFrame([("provides", "svc/user", "http_endpoint", "GET /api/users/profile", "p"), ("provides", "svc/user", "mq_queue", "users profile", "p"), ("consumes", "svc/web", "http_request", "http://x/users/profile", "p"), ("consumes", "svc/web", "http_request", "zzz", "p")], "side string, project string, kind string, name string, path string")
    got = workspace.match_consumers(rows).collect()
    assert len(got) == 1 and got[0].provider == "svc/user" and got[0].provided.startswith("GET") and got[0].score == 20


def test_pointcuts():
    assert links.pointcut_pattern("execution(* com.app..*Service.*(..))")[1] == "^[^.]*$"
    import re

    owner, _ = links.pointcut_pattern("execution(* com.app..*Service.*(..))")
    assert re.match(owner, "com.app.order.OrderService") and not re.match(owner, "com.app.Config")
    inside, _ = links.pointcut_pattern("within(com.app.controller..*)")
    assert re.match(inside, "com.app.controller.A") and not re.match(inside, "com.other.A")


def test_session_windows(spark, tmp_path):
    from loomgraph.streaming import sync

    rows = spark.sql("select * from values (1, 'a', 'added', timestamp_ntz'2025-01-01 00:00:00'), (2, 'a', 'modified', timestamp_ntz'2025-01-01 00:00:01'), (3, 'a', 'deleted', timestamp_ntz'2025-01-01 00:00:09'), (4, 'b', 'added', timestamp_ntz'2025-01-01 00:00:00'), (5, null, 'added', null) as t(change_id, path, op, changed_at)").withColumn("change_id", F.col("change_id").cast("bigint"))
    got = sorted((r.path, r.n_reports, r.last_op) for r in sync.change_sessions(rows).collect())
    assert got == [("a", 1, "deleted"), ("a", 2, "modified"), ("b", 1, "added")]
    source = str(tmp_path / "in")
    rows.where("change_id <= 2").write.parquet(source)
    stream = lambda: sync.read_stream(spark, source, "change_id bigint, path string, op string, changed_at timestamp_ntz")
    sync.sync_to(stream(), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    rows.where("change_id > 2").write.mode("append").parquet(source)
    rows.where("change_id = 1").write.mode("append").parquet(source)  # a report that comes again, late
    sync.sync_to(stream(), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    assert {r.path: r.op for r in sync.read_synced(spark, str(tmp_path / "table")).collect()} == {"a": "deleted", "b": "added"}


def test_index_of_a_tree(spark, tmp_path):
    from loomgraph import api, cli

    tree = tmp_path / "tree" / "svc" / "app"
    tree.mkdir(parents=True)
    (tree / "Shop.java").write_text("/** Sells things. */\npublic class Shop {\n    public void sell(int n) {\n        pack(n);\n    }\n    void pack(int n) {\n    }\n}\n")
    (tree / ".git").mkdir()
    (tree / ".git" / "x.java").write_text("class Hidden {}")
    api.build_index(spark, str(tmp_path / "tree"), str(tmp_path / "out"))
    index = spark.read.parquet(str(tmp_path / "out" / "nodes.parquet"))
    assert {r.name for r in index.collect()} == {"Shop", "sell", "pack"}
    assert index.where("name = 'Shop'").first().docstring == "Sells things."
    assert len(api.TOOLS) == 35 and len(cli.commands()) >= 62


def shuffled_rows(spark):
    gateway = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_references_move_only_sought_pieces(spark):
    # Every name holds "id" and has some eighty pieces; only those that a reference seeks are moved, and of a short text ten for each task.
    n = spark.range(3000).selectExpr("concat('n', id) as id", "concat('run', id) as name", "'method' as kind", "concat('pkg.module.ValidateThing', id, '.computeAllOfTheOthers', id) as qualified_name", "id as seq")
    before, bound = shuffled_rows(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = {}
    for r in resolution.match_references(spark.createDataFrame([("id",), ("Thing2999.computeAll",), ("run7",), ("ValidateThing12.compute",)], "ref string"), n).collect():
        got.setdefault(r.ref, []).append((r.id, r.confidence))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    ids = sorted(f"n{i}" for i in range(3000))
    assert {k: sorted(v) for k, v in got.items()} == {"id": [(i, 0.5) for i in ids[:10]], "Thing2999.computeAll": [("n2999", 0.5)], "run7": [("n7", 0.7)], "ValidateThing12.compute": [("n12", 0.5)]}
    assert shuffled_rows(spark) - before < 60_000


def test_similar_code_moves_no_pair_beyond_the_best(spark):
    # Every two of 1,500 symbols are alike: 300 queries have 450,000 pairs, of which ten each for a task are moved.
    base = " ".join(f"w{k}" for k in range(8))
    n = nodes(spark, *[{"id": f"s{i:04}", "name": f"s{i:04}", "kind": "method", "docstring": base} for i in range(1500)])
    ask = n.where("id < 's0300'").select("id")
    before, bound = shuffled_rows(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = {}
    for r in aggregates.similar_code(n, ask).collect():
        got.setdefault(r.id, set()).add((r.other_id, r.similarity))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert got == {f"s{q:04}": {(f"s{i:04}", 0.8) for i in range(11) if i != q and (q < 10 or i < 10)} for q in range(300)}
    assert shuffled_rows(spark) - before < 200_000


def test_similar_code_equals_brute_force(spark):
    rnd = random.Random(7)
    texts = [" ".join(rnd.sample([f"w{k}" for k in range(14)], rnd.randrange(0, 12))) for _ in range(150)]
    n = nodes(spark, *[{"id": f"s{i:03}", "name": "f", "kind": rnd.choice(["method", "Function"]), "docstring": t} for i, t in enumerate(texts)])
    kinds = {r.id: r.kind.lower() for r in n.select("id", "kind").collect()}
    classes = {}
    for i, t in enumerate(texts):
        if t:
            classes.setdefault((kinds[f"s{i:03}"], frozenset(t.split())), []).append(f"s{i:03}")
    for least in (0.3, 0.5, 0.7):
        want = set()
        for (kind, t), ids in classes.items():
            scored = sorted((-len(t & u) / len(t | u), min(other), len(other)) for (k, u), other in classes.items() if k == kind and u != t)
            want |= {(i, o, c, int(-s * 100 + 0.5 + 1e-9) / 100) for i in ids for s, o, c in [x for x in scored if -x[0] >= least][:10]}
        assert {tuple(r) for r in aggregates.similar_code(n, n.select("id"), least).collect()} == want
