"""Inferred targets of dynamic dispatch.

A detector takes the tables and gives patterns (source_id, target_id,
provenance, confidence, interface_id). Detectors are DataFrame functions; the
engine unions them, drops what is too uncertain, and keeps the best of each
relation. None of them pairs all classes with all calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import CALLABLE_KINDS, annotations, current_nodes, relations
from loomgraph.operators.links import implementations

# Certainty by kind of evidence.
CONFIDENCE = {
    "static": 1.0, "autowired_unique": 0.9, "conditional": 0.8, "aop": 0.7, "strategy": 0.6, "factory": 0.5,
    "autowired_many": 0.3, "proxy": 0.3, "data_driven": 0.15, "reflective": 0.1, "unknown": 0.0,
}
# Kinds of relations by provenance; others register a dispatch.
EDGE_KINDS = {"proxy_handler": "proxy_wraps", "aop_proxy": "aop_advises", "conditional_bean": "conditional_impl"}
PROXY_ANNOTATIONS = ("Transactional", "Cacheable", "CacheEvict", "CachePut", "Async", "Retryable", "Component")
LEAST = 0.3


def _pattern(df: DataFrame, source: str, target: str, provenance: str, confidence, interface: str | None = None) -> DataFrame:
    value = confidence if not isinstance(confidence, float) else F.lit(confidence)
    return df.select(F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(provenance).alias("provenance"), value.cast("double").alias("confidence"), (F.col(interface) if interface else F.lit(None).cast("string")).alias("interface_id"))


def aop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Methods of classes that a proxy stands before."""
    marked = annotations(edges).where(F.col("annotation_name").isin(*PROXY_ANNOTATIONS)).select(F.col("node_id").alias("parent_id")).distinct()
    methods = current_nodes(nodes, "kind", "parent_id").where(F.col("kind").isin(*CALLABLE_KINDS)).join(marked, "parent_id", "left_semi")
    return _pattern(methods, "parent_id", "id", "aop_proxy", CONFIDENCE["aop"])


def strategy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Interfaces with two implementations or more."""
    impls = implementations(edges, nodes)
    many = impls.groupBy("interface_id").agg(F.count("*").alias("n")).where("n >= 2").select("interface_id")
    return _pattern(impls.join(many, "interface_id", "left_semi"), "interface_id", "implementation_id", "strategy_registered", CONFIDENCE["strategy"], "interface_id")


def factory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes that creating functions instantiate, and classes that their signature returns."""
    current = current_nodes(nodes, "kind", "name", "signature")
    makers = current.where(F.col("kind").isin(*CALLABLE_KINDS) & F.col("name").rlike("^(create|build|make|new|get|open|load)[A-Z_]"))
    types = current.where("kind in ('class', 'enum')").select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    made = relations(edges, "instantiates").join(makers.select(F.col("id").alias("source")), "source").join(types.select(F.col("class_id").alias("target")), "target", "left_semi")
    returned = makers.withColumn("class_name", F.regexp_extract("signature", r":\s*(\w+)\s*$", 1)).where("class_name != ''")
    best = types.groupBy("class_name").agg(F.min("class_id").alias("class_id"))
    return _pattern(made, "source", "target", "factory_product", CONFIDENCE["factory"] * 0.8).unionByName(_pattern(returned.join(best, "class_name"), "id", "class_id", "factory_product", CONFIDENCE["factory"] * 0.7))


def proxy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols that call a proxy factory, with what they instantiate."""
    callers = edges.where("kind = 'calls' and target rlike '(newProxyInstance|Enhancer[.:]create|createProxy)'").select("source").distinct()
    return _pattern(relations(edges, "instantiates").join(callers, "source", "left_semi"), "source", "target", "proxy_handler", CONFIDENCE["proxy"])


def reflection(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes that a reflective call names in its metadata."""
    calls = edges.where("kind = 'calls' and target rlike '(forName|loadClass|newInstance|invoke)'").select("source", F.get_json_object("metadata", "$.argument").alias("qualified_name")).where("qualified_name is not null").distinct()
    types = current_nodes(nodes, "kind", "qualified_name").where("kind in ('class', 'enum')")
    return _pattern(calls.join(types, "qualified_name"), "source", "id", "reflective_match", CONFIDENCE["reflective"] * 3)


def spi(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Implementations of interfaces that a service loader is asked for."""
    callers = edges.where("kind = 'calls' and target rlike 'ServiceLoader'").select("source").distinct()
    asked = relations(edges, "references", "type_of").join(callers, "source", "left_semi").select("source", F.col("target").alias("interface_id"))
    return _pattern(asked.join(implementations(edges, nodes), "interface_id"), "source", "implementation_id", "spi_loaded", CONFIDENCE["factory"], "interface_id")


def conditional_beans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Implementations of an interface: certain if there is one, else likelier with a condition of their own."""
    impls = implementations(edges, nodes)
    counted = impls.groupBy("interface_id").agg(F.count("*").alias("n"))
    conditional = annotations(edges).where("annotation_name rlike '^(Conditional|Profile)'").select(F.col("node_id").alias("implementation_id")).distinct().withColumn("c", F.lit(True))
    rows = impls.join(counted, "interface_id").join(conditional, "implementation_id", "left")
    value = F.when(F.col("n") == 1, CONFIDENCE["autowired_unique"]).when(F.col("c"), CONFIDENCE["conditional"]).otherwise(CONFIDENCE["strategy"])
    return _pattern(rows, "interface_id", "implementation_id", "conditional_bean", value, "interface_id")


Detector = Callable[[DataFrame, DataFrame], DataFrame]
DETECTORS: dict[str, Detector] = {"aop": aop, "strategy": strategy, "factory": factory, "proxy": proxy, "reflection": reflection, "spi": spi, "conditional": conditional_beans}


def register(name: str, detector: Detector) -> None:
    """Adds a detector of one's own."""
    DETECTORS[name] = detector


def detect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = None
    for detector in DETECTORS.values():
        part = detector(nodes, edges)
        rows = part if rows is None else rows.unionByName(part)
    return rows


def merge(patterns: DataFrame, least: float = LEAST) -> DataFrame:
    """(source, target, kind, confidence, provenance): relations of the patterns that are certain enough, the best of each."""
    kinds = F.create_map(*[F.lit(x) for pair in EDGE_KINDS.items() for x in pair])
    kept = patterns.where((F.col("confidence") >= least) & F.col("target_id").isNotNull())
    kind = F.coalesce(kinds[F.col("provenance")], F.lit("dispatch_registration"))
    main = kept.where("source_id is not null and source_id != ''").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), kind.alias("kind"), "confidence", "provenance")
    extra = kept.where("interface_id is not null and interface_id != coalesce(source_id, '')").select(F.col("interface_id").alias("source"), F.col("target_id").alias("target"), F.lit("conditional_impl").alias("kind"), "confidence", "provenance")
    best = F.max(F.struct("confidence", "provenance")).alias("b")
    return main.unionByName(extra).groupBy("source", "target", "kind").agg(best).select("source", "target", "kind", F.col("b.confidence").alias("confidence"), F.col("b.provenance").alias("provenance"))


def infer(nodes: DataFrame, edges: DataFrame, least: float = LEAST) -> DataFrame:
    return merge(detect(nodes, edges), least)
