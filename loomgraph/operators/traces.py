"""Requests followed from the page to the database, and the view of one service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import current_nodes, external_references, relations
from loomgraph.operators.links import callees
from loomgraph.operators.traversal import entry_points


def full_traces(edges: DataFrame, nodes: DataFrame, outside: tuple[str, ...] = ("topic:", "cache:", "config:", "tx:")) -> DataFrame:
    """(trace_id, hop, node_id, role): entry point, what it calls, what that calls and all it touches outside.

    A trace belongs to one entry and one symbol it calls; hops are kept in
    order and traces of one hop are dropped. Everything that the called symbol
    touches outside is a hop of its own behind it, numbered by its id.
    """
    entries = entry_points(edges, nodes).select(F.col("id").alias("entry_id"), F.col("entry").alias("role"))
    members = current_nodes(nodes, "parent_id", "kind").where("parent_id is not null and kind in ('method', 'function', 'constructor')").select(F.col("parent_id").alias("entry_id"), F.col("id").alias("method_id"))
    begun = entries.join(members, "entry_id", "left").select("entry_id", "role", F.coalesce("method_id", "entry_id").alias("first_id"))
    calls = callees(edges, nodes).select("symbol", "callee_id")
    second = begun.join(calls.select(F.col("symbol").alias("first_id"), F.col("callee_id").alias("second_id")), "first_id")
    third = relations(edges, "calls", "references", "dispatch_call").where(F.col("target").rlike("^(" + "|".join(p.rstrip(":") for p in outside) + "|ext):")).select(F.col("source").alias("second_id"), F.col("target").alias("third_id")).distinct()
    touched = third.withColumn("_r", F.row_number().over(Window.partitionBy("second_id").orderBy("third_id")))
    rows = second.withColumn("trace_id", F.md5(F.concat_ws("\x1f", "entry_id", "first_id", "second_id"))).dropDuplicates(["trace_id"])
    hops = F.array_compact(
        F.array(
            F.struct(F.col("entry_id").alias("node_id"), F.col("role").alias("role")),
            F.when(F.col("first_id") != F.col("entry_id"), F.struct(F.col("first_id").alias("node_id"), F.lit("method").alias("role"))),
            F.struct(F.col("second_id").alias("node_id"), F.lit("callee").alias("role")),
        )
    )
    inside = rows.select("trace_id", F.posexplode(hops).alias("hop", "h")).select("trace_id", "hop", "h.node_id", "h.role")
    # The first hop outside has the number of the hops inside: two, or three with a method.
    after = F.when(F.col("first_id") != F.col("entry_id"), 3).otherwise(2)
    return inside.unionByName(rows.join(touched, "second_id").select("trace_id", (after + F.col("_r") - 1).cast("int").alias("hop"), F.col("third_id").alias("node_id"), F.lit("outside").alias("role")))


def trace_steps(traces: DataFrame) -> DataFrame:
    """(trace_id, hop, source, target): consecutive hops of each trace."""
    order = Window.partitionBy("trace_id").orderBy("hop")
    return traces.withColumn("target", F.lead("node_id").over(order)).where("target is not null").select("trace_id", "hop", F.col("node_id").alias("source"), "target")


def traces_through(traces: DataFrame, nodes: DataFrame, module: str) -> DataFrame:
    """(trace_id) of traces with a hop in a module whose id contains the text."""
    where = current_nodes(nodes, "module_id").where(F.contains("module_id", F.lit(module))).select(F.col("id").alias("node_id"))
    return traces.join(where, "node_id", "left_semi").select("trace_id").distinct()


def service_traces(edges: DataFrame, nodes: DataFrame, external_symbols: DataFrame) -> DataFrame:
    """Per module: entry points, internal calls, calls out and in, and external references."""
    where = current_nodes(nodes, "module_id").where("module_id is not null and module_id != ''")
    a = where.select(F.col("id").alias("source"), F.col("module_id").alias("a"))
    b = where.select(F.col("id").alias("target"), F.col("module_id").alias("b"))
    calls = relations(edges, "calls").join(b, "target").join(a, "source")
    inside = calls.where("a = b").groupBy(F.col("a").alias("module_id")).agg(F.count("*").alias("n_internal"))
    out = calls.where("a != b").groupBy(F.col("a").alias("module_id")).agg(F.count("*").alias("n_out"))
    into = calls.where("a != b").groupBy(F.col("b").alias("module_id")).agg(F.count("*").alias("n_in"))
    entries = entry_points(edges, nodes).join(where, "id").groupBy("module_id").agg(F.count("*").alias("n_entries"))
    ext = external_references(edges, external_symbols).join(where.select(F.col("id").alias("source_location"), "module_id"), "source_location").groupBy("module_id").agg(F.count("*").alias("n_external"))
    rows = where.select("module_id").distinct()
    for part in (entries, inside, out, into, ext):
        rows = rows.join(part, "module_id", "left")
    return rows.select("module_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_entries", "n_internal", "n_out", "n_in", "n_external")])
