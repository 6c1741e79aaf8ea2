"""Hierarchies against brute force on random forests with rings."""

import random

import pytest

from loomgraph.operators import hierarchy

SCHEMA = "id string, parent_id string, seq bigint, steps int, _n string"


def brute(rows):
    current = {}
    for id_, parent, seq in sorted(rows, key=lambda r: r[2]):
        if id_ is not None:
            current[id_] = parent or None
    rings, paths = {}, {}
    for id_ in current:
        chain, at = [id_], current[id_]
        while at in current and at not in chain:
            chain.append(at)
            at = current[at]
        if at in chain:
            ring = chain[chain.index(at):]
            rings[id_] = (min(ring), chain.index(at))
        else:
            paths[id_] = list(reversed(chain))
    return rings, paths


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, 7, "x") for a, b, c in rows], SCHEMA)


def random_rows(seed, n=120):
    rnd = random.Random(seed)
    ids = [f"n{i}" for i in range(n)]
    rows = []
    for at, id_ in enumerate(ids):
        kind = rnd.random()
        parent = None if kind < 0.1 else "" if kind < 0.15 else "lost" if kind < 0.2 else rnd.choice(ids) if kind < 0.35 else ids[rnd.randrange(at)] if at else None
        rows.append((id_, parent, at))
    chain = [f"c{i}" for i in range(40)]
    rows += [(c, chain[i + 1] if i + 1 < len(chain) else "n0", n + i) for i, c in enumerate(chain)]
    rows += [("self", "self", 900), (None, "n1", 901), ("n3", None, -5), ("n4", "n4", -4)]
    hub = [(f"leaf{i}", "n2", 1000 + i) for i in range(60)]
    return rows + hub + [rows[0], rows[5]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rings_and_paths(spark, seed):
    rows = random_rows(seed)
    rings, paths = brute(rows)
    found = {r.id: (r.cycle_id, r.steps) for r in hierarchy.cyclic(frame(spark, rows)).collect()}
    assert found == rings
    tree = hierarchy.hierarchy(frame(spark, rows)).collect()
    assert {r.id: list(r.path) for r in tree if r.path} == paths
    assert {r.id: r.cycle_id for r in tree if not r.path} == {k: v[0] for k, v in rings.items()}
    below = {k: sum(k in p[:-1] for p in paths.values()) for k in paths}
    placed = [r for r in tree if r.path]
    assert {r.id: r.n_below for r in placed} == below
    assert all(r.depth == len(r.path) - 1 and r.root_id == r.path[0] for r in placed)
    for a in placed[:40]:
        inside = {b.id for b in placed if b.root_id == a.root_id and a.entry < b.entry <= a.exit}
        assert inside == {k for k, p in paths.items() if a.id in p[:-1]}


def test_descendants(spark):
    tree = hierarchy.hierarchy(frame(spark, random_rows(4)))
    pairs = {(r.ancestor_id, r.id) for r in hierarchy.ancestors(tree).collect()}
    one = hierarchy.below(tree, spark.createDataFrame([("n2",), ("n0",)], "id string"))
    assert {tuple(r) for r in one.collect()} == {p for p in pairs if p[0] in ("n0", "n2")}


def test_many_siblings_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "SIBLINGS_A_BUCKET", 3)
    rows = [("root", None, 0)] + [(f"k{i}", "root", i + 1) for i in range(20)] + [(f"g{i}", f"k{i}", 100 + i) for i in range(10)]
    _, paths = brute(rows)
    tree = hierarchy.hierarchy(frame(spark, rows)).collect()
    for a in tree:
        assert {b.id for b in tree if a.entry < b.entry <= a.exit} == {k for k, p in paths.items() if a.id in p[:-1]}


def test_empty_table(spark):
    assert hierarchy.cyclic(frame(spark, [])).count() == 0
    assert hierarchy.hierarchy(frame(spark, [])).count() == 0


def test_many_short_rings_and_one_long_chain(spark):
    rows = [(f"r{i}.{k}", f"r{i}.{(k + 1) % 3}", i * 3 + k) for i in range(30) for k in range(3)]
    rows += [(f"t{i}", f"t{i + 1}" if i < 69 else "r7.1", 1000 + i) for i in range(70)]
    rings, _ = brute(rows)
    assert {r.id: (r.cycle_id, r.steps) for r in hierarchy.cyclic(frame(spark, rows)).collect()} == rings
