"""The surroundings of a task: symbols found by its words, what is near them, and their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.paths import path_class, path_relevance
from loomgraph.functions.text import STOP_WORDS
from loomgraph.operators import ranking, search, traversal
from loomgraph.operators.graph import annotations, current_nodes
from loomgraph.operators.links import callees, callers, implementations

NEAR_SCORE = 0.3


def task_words(task: str) -> tuple[list[str], list[str]]:
    """(words, names in Pascal case) of a task description."""
    import re

    words = [w for w in re.findall(r"[a-z0-9]+", task.lower()) if len(w) > 2 and w not in STOP_WORDS]
    return list(dict.fromkeys(words)), list(dict.fromkeys(re.findall(r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b", task)))


def build_context(nodes: DataFrame, edges: DataFrame, files: DataFrame, task: str) -> DataFrame:
    """(id, name, kind, file_path, score, origin): the symbols that matter for a task, within the budget of the tree.

    Steps: full text over each word; names in Pascal case and definitions;
    greatest score per symbol; callers and callees; type neighbours; at most so
    many per file and so many outside production; siblings of one interface
    collapsed to one. The limits are the feature: an answer has a budget.
    """
    spark: SparkSession = nodes.sparkSession
    words, names = task_words(task)
    plan = ranking.budget(files.select("path").distinct().count())
    current = current_nodes(nodes, "name", "kind", "file_path", "parent_id")
    asked = spark.createDataFrame([(i, [w]) for i, w in enumerate(words)], "query_id int, words array<string>")
    by_word = search.match_all(nodes, asked, top=plan["total"]).select(F.col("node_id").alias("id"), "score", F.lit("text").alias("origin"))
    exact = current.where(F.col("name").isin(*names) if names else F.lit(False)).select("id", F.lit(100.0).alias("score"), F.lit("name").alias("origin"))
    seeds = sets_union(by_word, exact)
    top = seeds.orderBy(F.desc("score"), "id").limit(plan["total"])
    near = traversal.expand(edges, nodes, top, plan["per_file"]).select("id", F.lit(NEAR_SCORE).alias("score"), F.lit("near").alias("origin"))
    types = traversal.type_expansion(edges, nodes).join(top.select(F.col("id").alias("symbol")), "symbol", "left_semi").select(F.col("type_id").alias("id"), F.lit(NEAR_SCORE / 2).alias("score"), F.lit("type").alias("origin"))
    rows = sets_union(top, near, types).join(current, "id").withColumn("relevance", path_relevance("file_path"))
    order = [F.desc("score"), F.desc("relevance"), F.col("id")]
    rows = ranking.top_per_group(rows, ["file_path"], order, plan["per_file"])
    rows = rows.withColumn("production", path_class("file_path") == "production")
    rows = ranking.top_per_group(rows.where("production"), ["production"], order, plan["total"]).unionByName(ranking.top_per_group(rows.where("not production"), ["production"], order, plan["non_production"]))
    if plan["collapse"]:
        rows = collapse_siblings(rows, edges, nodes)
    return rows.select("id", "name", "kind", "file_path", "score", "origin").orderBy(*order[:1], "id").limit(plan["total"])


def sets_union(*parts: DataFrame) -> DataFrame:
    from loomgraph.operators.sets import union_best

    return union_best(list(parts), ["id"], "score")


def collapse_siblings(rows: DataFrame, edges: DataFrame, nodes: DataFrame, groups: int = 3) -> DataFrame:
    """Of the implementations of one interface, when two or more are there, only the best stays; at most three groups."""
    impl = implementations(edges, nodes).groupBy(F.col("implementation_id").alias("id")).agg(F.min("interface_id").alias("interface_id"))
    tagged = rows.join(impl, "id", "left")
    sizes = tagged.where("interface_id is not null").groupBy("interface_id").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "interface_id").limit(groups)
    joined = tagged.join(sizes.select("interface_id", "n"), "interface_id", "left")
    first = ranking.top_per_group(joined.where("n is not null"), ["interface_id"], [F.desc("score"), F.col("id")], 1)
    return joined.where("n is null").unionByName(first).select(*rows.columns)


def code_blocks(selected: DataFrame, nodes: DataFrame, files: DataFrame, edges: DataFrame, near: int = 5) -> DataFrame:
    """(id, file_path, code, callers, callees): the lines of each selected symbol with up to five names around it."""
    content = files.where("content is not null").groupBy("path").agg(F.max(F.struct("indexed_at", "content_hash", "content")).alias("f")).select(F.col("path").alias("file_path"), F.split(F.col("f.content"), "\n").alias("lines"))
    rows = current_nodes(nodes, "file_path", "start_line", "end_line").join(selected.select("id").distinct(), "id", "left_semi").join(content, "file_path", "left")
    code = F.array_join(F.slice("lines", F.greatest("start_line", F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))), "\n")
    def first(df: DataFrame, key: str) -> DataFrame:
        # The names are made distinct and ranked before they are collected, so that a hot symbol collects ``near`` of them.
        unique = df.select(key, "name").where("name is not null").distinct()
        return ranking.top_per_group(unique, [key], ["name"], near).groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))

    ids = selected.select(F.col("id").alias("symbol")).distinct()
    into = first(callers(edges, nodes).join(ids, "symbol", "left_semi"), "symbol").select(F.col("symbol").alias("id"), F.col("names").alias("callers"))
    out = first(callees(edges, nodes).join(ids, "symbol", "left_semi"), "symbol").select(F.col("symbol").alias("id"), F.col("names").alias("callees"))
    return rows.select("id", "file_path", code.alias("code")).join(into, "id", "left").join(out, "id", "left")


def node_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent_name, n_children, n_callers, n_callees, n_implementations, annotations) of every symbol."""
    current = current_nodes(nodes, "name", "parent_id")
    count = lambda df, key, name: df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    parents = current.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    marks = annotations(edges).groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("annotation_name")), ",").alias("annotations"))
    rows = current.join(parents, "parent_id", "left").select("id", "parent_name")
    for part in (
        count(current.where("parent_id is not null"), "parent_id", "n_children"),
        count(callers(edges, nodes), "symbol", "n_callers"),
        count(callees(edges, nodes), "symbol", "n_callees"),
        count(implementations(edges, nodes), "interface_id", "n_implementations"),
        marks,
    ):
        rows = rows.join(part, "id", "left")
    return rows.select("id", "parent_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_children", "n_callers", "n_callees", "n_implementations")], F.coalesce("annotations", F.lit("")).alias("annotations"))


def as_markdown(blocks: DataFrame) -> DataFrame:
    """One row of Markdown per file, its symbols in order."""
    item = F.concat(F.lit("### "), "id", F.lit("\n```\n"), F.coalesce("code", F.lit("")), F.lit("\n```\n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("t")))), lambda x: x["t"]), "\n")
    return blocks.groupBy("file_path").agg(F.concat(F.lit("## "), F.first("file_path"), F.lit("\n"), listed).alias("markdown"))
