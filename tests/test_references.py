"""Broken references against brute force, with nulls, repeats and ties in time."""

import datetime as dt
import random

from loomgraph.operators import references

T0 = dt.datetime(2025, 1, 1)


def at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


def tables(spark, edges, nodes, external, changes):
    return (
        spark.createDataFrame([(s, t, c, q, "k", 1) for s, t, c, q in edges], "source string, target string, created_at timestamp_ntz, seq bigint, kind string, until int"),
        spark.createDataFrame([(i, p, f, c, q, "x") for i, p, f, c, q in nodes], "id string, parent_id string, file_path string, created_at timestamp_ntz, seq bigint, ref string"),
        spark.createDataFrame(external, "id string, created_at timestamp_ntz"),
        spark.createDataFrame(changes, "path string, op string, changed_at timestamp_ntz"),
    )


def brute(edges, nodes, external, changes):
    out = []
    refs = [("edges", f, r, q, c) for s, t, c, q in edges for f, r in (("source", s), ("target", t)) if r and not r.startswith(("tx:", "cache:", "config:", "topic:"))]
    refs += [("nodes", "parent_id", p, q, c) for _, p, _, c, q in nodes if p]
    early = dt.datetime(1, 1, 1)
    for table, field, ref, seq, t in refs:
        mine = [(c, f) for i, _, f, c, _ in nodes if i == ref]
        times = [c or early for c, _ in mine] + ([c or early for i, c in external if i == ref] if table == "edges" else [])
        status = None
        if not times:
            status = "missing"
        elif t is not None and all(c > t for c in times):
            status = "late"
        elif t is not None:
            known = [(c, f) for c, f in mine if c is not None and c <= t]
            if known:
                c = max(c for c, _ in known)
                files = {f for k, f in known if k == c}
                if any(op == "deleted" and p is not None and p in files and d is not None and c < d <= t for p, op, d in changes):
                    status = "deleted"
        if status:
            out.append((table, field, seq, status, None if t is None else t.strftime("%Y-%m")))
    return sorted(out, key=str)


def test_random(spark):
    rnd = random.Random(5)
    ids = [f"f{i % 7}:s{i}" for i in range(30)]
    hours = lambda: rnd.choice([None, *range(0, 4000, 97)])
    nodes = [(rnd.choice([*ids, None]), rnd.choice([*ids, "", None, "lost"]), rnd.choice([f"f{rnd.randrange(7)}", None]), at(hours()), i) for i in range(150)]
    external = [(f"ext://{i}", at(hours())) for i in range(5)]
    names = [*ids, "lost", "ext://1", "ext://9", "tx:a", "config:b", "", None]
    edges = [(rnd.choice(names), rnd.choice(names), at(hours()), i) for i in range(300)]
    edges += [(ids[0], "ext://1", at(i), 1000 + i) for i in range(400)]
    changes = [(rnd.choice([f"f{rnd.randrange(7)}", None]), rnd.choice(["deleted", "added", "modified"]), at(hours())) for _ in range(80)]
    changes += [changes[0], ("f1", "deleted", at(97)), ("f1", "deleted", at(97))]
    found = references.broken_references(*tables(spark, edges, nodes, external, changes))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(edges, nodes, external, changes)


def test_empty_tables(spark):
    assert references.broken_references(*tables(spark, [], [], [], [])).count() == 0
    only = references.broken_references(*tables(spark, [("a", "b", at(1), 1)], [], [], []))
    assert {r.status for r in only.collect()} == {"missing"} and only.count() == 2


def test_filter_has_no_false_negative(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as id")
    words = references.filter_words(5000)
    rows = references.bloom_filter(keys, "id", words)
    probed = references.probe(keys.union(spark.range(5000).selectExpr("concat('other', id) as id")), "id", rows, words, "hit")
    assert probed.where("id like 'k%' and not hit").count() == 0
    assert probed.where("id like 'other%' and hit").count() < 1000


def test_without_a_filter_all_is_verified(spark, monkeypatch):
    assert references.filter_words(10**12) is None
    monkeypatch.setattr(references, "MAX_FILTER_WORDS", 1)
    nodes = [("a", None, "f", at(0), 1), ("b", "lost", "f", at(0), 2)]
    edges = [("a", "b", at(1), 1), ("gone", "b", at(1), 2)]
    found = references.broken_references(*tables(spark, edges, nodes, [], []))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(edges, nodes, [], [])
