"""The current property graph: one row per symbol and one per relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of relations that stand for dynamic dispatch.
DISPATCH_KINDS = ("dispatch_call", "dispatch_registration", "proxy_wraps", "aop_advises", "conditional_impl")
CALLABLE_KINDS = ("function", "method", "constructor")
TYPE_KINDS = ("class", "interface", "enum")


def current_nodes(nodes: DataFrame, *columns: str) -> DataFrame:
    """The last written row of each id, kinds in lower case, '' for no parent as null."""
    columns = columns or tuple(c for c in nodes.columns if c not in ("id", "seq"))
    packed = F.max(F.struct(F.col("seq"), *[F.col(c) for c in columns])).alias("_n")
    rows = nodes.where("id is not null").groupBy("id").agg(packed).select("id", *[F.col("_n")[c].alias(c) for c in columns])
    if "kind" in columns:
        rows = rows.withColumn("kind", F.lower("kind"))
    if "parent_id" in columns:
        rows = rows.withColumn("parent_id", F.when(F.col("parent_id") != "", F.col("parent_id")))
    return rows


def unique_edges(edges: DataFrame, *columns: str) -> DataFrame:
    """The first written row of each (source, target, kind): later ones are ignored."""
    columns = columns or ("metadata", "line", "col")
    packed = F.min(F.struct(F.col("seq"), *[F.col(c) for c in columns])).alias("_e")
    return edges.groupBy("source", "target", "kind").agg(packed).select("source", "target", "kind", *[F.col("_e")[c].alias(c) for c in columns])


def relations(edges: DataFrame, *kinds: str) -> DataFrame:
    """Different (source, target) of the given kinds."""
    return edges.where(F.col("kind").isin(*kinds)).select("source", "target").distinct()


def annotations(edges: DataFrame) -> DataFrame:
    """(node_id, annotation_name, value): the first use of a name on a symbol counts."""
    name = F.element_at(F.split("target", "[/:]"), -1)
    rows = edges.where("kind = 'decorates' and source is not null").select(F.col("source").alias("node_id"), name.alias("annotation_name"), F.col("metadata").alias("value"), "seq")
    packed = F.min(F.struct("seq", "value")).alias("_a")
    return rows.groupBy("node_id", "annotation_name").agg(packed).select("node_id", "annotation_name", F.col("_a.value").alias("value"))


def external_references(edges: DataFrame, external_symbols: DataFrame) -> DataFrame:
    """(source_location, external_symbol_id, reference_type, target_service) of every relation that leaves the graph."""
    refs = edges.where(F.col("target").startswith("ext://")).select(F.col("source").alias("source_location"), F.col("target").alias("external_symbol_id"), F.col("kind").alias("reference_type")).distinct()
    known = external_symbols.select(F.col("id").alias("external_symbol_id"), F.col("providing_service").alias("target_service"))
    return refs.join(known, "external_symbol_id", "left").select("source_location", "external_symbol_id", "reference_type", "target_service")


def confidence(metadata: str = "metadata", default: float = 1.0) -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.confidence").cast("double"), F.lit(default))
