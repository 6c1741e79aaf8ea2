import pytest

from loomgraph.llm import queries

FOUND = {"p1_found": ["id"], "p4_found": ["path"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    assert df.columns == FOUND.get(name, df.columns)
    rows = df.collect()
    assert rows
    if name in FOUND:
        assert len({tuple(r) for r in rows}) == len(rows)
