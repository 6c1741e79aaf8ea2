"""Grouping by load, against plain grouping, with one key holding most rows."""

from collections import defaultdict

from loomgraph.operators import skew


def edges(spark, hot=3000):
    rows = [(f"s{i % 900}", "hot", "calls", None) for i in range(hot)] + [(f"s{i % 11}", f"t{i % 50}", ["calls", "uses", None][i % 3], None) for i in range(700)]
    rows += [(None, "hot", "calls", None), (None, None, None, None), ("s1", None, "calls", None)]
    return spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "source string, target string, kind string, created_at timestamp_ntz, seq bigint, n string"), rows


def test_profile(spark):
    df, rows = edges(spark)
    sources = defaultdict(set)
    for s, t, k, _ in rows:
        sources[t, k].add(s)
    found = {(r.target, r.kind): (r.n_edges, r.n_sources) for r in skew.edge_profile(df, tasks=6).collect()}
    assert found == {k: (len(v), len(v - {None})) for k, v in sources.items()}
    total = sum(map(len, sources.values()))
    top = {(r.target, r.kind) for r in skew.dominant_keys(skew.edge_profile(df, tasks=6), 0.01).collect()}
    assert top == {k for k, v in sources.items() if len(v) >= 0.01 * total and None not in k} | {k for k in top if None in k and len(sources[k]) >= 0.01 * total}


def test_large_key_is_split_and_load_is_even(spark):
    df, _ = edges(spark, hot=6000)
    plan = skew.LoadPlan(df.select("source", "target"), ["target"], 6)
    hot = spark.createDataFrame([("hot",)], "target string").select(skew.key_hash(["target"])).first()[0]
    assert len([p for p in plan.plan if p[0] == (hot,)]) > 3
    placed = plan.fragment(df.select("source", "target"), ["source"])
    from pyspark.sql import functions as F

    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 2.2 * sum(sizes) / 6


def test_matching_side_goes_only_where_needed(spark):
    df, _ = edges(spark)
    plan = skew.LoadPlan(df.select("source", "target"), ["target"], 6)
    copies = plan.replicate(spark.createDataFrame([("hot", "H"), ("t1", "T")], "target string, target_name string"))
    counts = {r.target: r["count"] for r in copies.groupBy("target").count().collect()}
    assert counts["t1"] == 1 and 1 < counts["hot"] <= 6


def test_packing_loads():
    plan = skew.pack_loads([(("a",), 100), (("b",), 10), (("c",), 10)], 130, 4)
    assert len({task for key, _, task in plan if key == ("a",)}) == 4


def test_empty(spark):
    df, _ = edges(spark)
    assert skew.edge_profile(df.where("false"), tasks=4).count() == 0
    assert skew.dominant_keys(skew.edge_profile(df.where("false"), tasks=4)).count() == 0


def test_one_edge_repeated_is_combined_before_it_moves(spark):
    rows = [("s", "hot", "calls", None, i, "x") for i in range(4000)] + [(f"s{i}", "t", "calls", None, i, "x") for i in range(50)]
    df = spark.createDataFrame(rows, "source string, target string, kind string, created_at timestamp_ntz, seq bigint, n string")
    assert {(r.target, r.n_edges) for r in skew.edge_profile(df, tasks=6).collect()} == {("hot", 1), ("t", 50)}
