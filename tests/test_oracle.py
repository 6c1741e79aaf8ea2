"""Every query of the core against its SQL on the smallest tables."""

import pytest
from compare import compare, duck

from loomgraph.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(tiny):
    return duck(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, tiny, name):
    good, text = compare(spark, con, tiny, name, QUERIES[name], SQL[name])
    assert good, text


# What the smallest tables hold nothing of; these operators have tests on rows of their own.
NONE_THERE = {"framework_relations", "infrastructure_relations", "inventory_counts", "resolved_import_paths", "routes", "source_annotations", "source_extends", "text_relations", "workspace_found", "workspace_matches"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    assert len(set(df.columns)) == len(df.columns)
    assert (df.count() == 0) == (name in NONE_THERE)


def test_nodes_and_edges_of_sources_belong_together(spark, tiny):
    nodes = {r.id: r for r in QUERIES["source_nodes"](spark, tiny).collect()}
    edges = QUERIES["source_edges"](spark, tiny).collect()
    assert all(r.start_line <= r.end_line and r.signature and (r.parent_id is None or r.parent_id in nodes) for r in nodes.values())
    assert {(e.source, e.target) for e in edges if e.kind == "contains"} == {(r.parent_id, r.id) for r in nodes.values() if r.parent_id}
    calls = [e for e in edges if e.kind == "calls"]
    assert calls and all(nodes[e.source].kind in ("method", "function", "constructor") and nodes[e.source].start_line < e.line <= nodes[e.source].end_line for e in calls)
    files = {(r.path, line): text for r in spark.read.parquet(f"{tiny}/files.parquet").select("path", "content", "indexed_at", "content_hash").orderBy("indexed_at", "content_hash").collect() if r.content for line, text in enumerate(r.content.replace("\r\n", "\n").split("\n"), 1)}
    assert all(n.name in files[n.file_path, n.start_line] for n in nodes.values())


def test_the_rest_needs_no_optional_part():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
