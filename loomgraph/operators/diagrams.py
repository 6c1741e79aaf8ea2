"""Mermaid text from relations: each diagram is one ordered aggregate of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import diagram_id

MAX_LINES = 2_000  # a diagram with more is not readable; the cut is part of the tool and is said in the text


def diagram(lines: DataFrame, head: str = "graph LR") -> DataFrame:
    """One row (diagram) from (line), sorted, without repeats; beyond MAX_LINES a comment gives the number left out."""
    unique = lines.select("line").distinct()
    total = unique.count()
    kept = unique.orderBy("line").limit(MAX_LINES)
    body = F.array_join(F.sort_array(F.collect_list("line")), "\n")
    rest = f"\n  %% {total - MAX_LINES} more" if total > MAX_LINES else ""
    return kept.agg(F.concat(F.lit(head + "\n"), body, F.lit(rest)).alias("diagram"))


def _arrow(source: str, target: str, label: str | None = None):
    middle = F.concat(F.lit(" -->|"), F.col(label).cast("string"), F.lit("| ")) if label else F.lit(" --> ")
    return F.concat(F.lit("  "), diagram_id(source), middle, diagram_id(target)).alias("line")


def service_diagram(service_graph: DataFrame) -> DataFrame:
    return diagram(service_graph.select(_arrow("from_module", "to_module", "n_relations")))


def architecture_diagram(modules: DataFrame, service_graph: DataFrame) -> DataFrame:
    boxes = modules.select(F.concat(F.lit("  "), diagram_id("id"), F.lit('["'), F.coalesce("name", "id"), F.lit('"]')).alias("line"))
    return diagram(boxes.unionByName(service_graph.select(_arrow("from_module", "to_module"))), "graph TB")


def key_diagram(edges: DataFrame, nodes: DataFrame, prefix: str) -> DataFrame:
    """Modules and the caches, topics, settings or transactions that their symbols use."""
    from loomgraph.operators.graph import current_nodes

    uses = edges.where(F.col("target").startswith(prefix)).select("source", "target").distinct()
    where = current_nodes(nodes, "module_id").where("module_id is not null and module_id != ''").select(F.col("id").alias("source"), "module_id")
    return diagram(uses.join(where, "source").groupBy("module_id", "target").agg(F.count("*").alias("n")).select(_arrow("module_id", "target", "n")))


def trace_diagram(steps: DataFrame) -> DataFrame:
    return diagram(steps.select(_arrow("source", "target")))


def sequence_diagram(service_graph: DataFrame) -> DataFrame:
    lines = service_graph.select(F.concat(F.lit("  "), diagram_id("from_module"), F.lit("->>"), diagram_id("to_module"), F.lit(": "), "kinds").alias("line"))
    return diagram(lines, "sequenceDiagram")


def gateway_diagram(routes: DataFrame) -> DataFrame:
    return diagram(routes.select(F.concat(F.lit("  gateway -->|"), F.array_join("predicates", " "), F.lit("| "), diagram_id("service")).alias("line")))


def fanout_diagram(fanout: DataFrame) -> DataFrame:
    return diagram(fanout.where("depth > 0").select(_arrow("seed", "id", "depth")))
