"""Inventories: one row per finding of a kind, with the fields its metadata holds.

Each of the inventories is an entry of a table: which relations it reads, and
which fields of their metadata it shows. They are run by the same few lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Inventory:
    name: str
    kinds: tuple[str, ...] = ()
    prefix: str = ""  # of kinds, where their number is open
    fields: tuple[str, ...] = ()
    group: str = ""  # column to group by


# The inventories, with the kinds and fields of the relations they show.
INVENTORIES = {
    i.name: i
    for i in (
        Inventory("feign_clients", ("feign_client",), fields=("value", "name", "url", "path")),
        Inventory("mybatis_mappings", ("mybatis_mapping",), fields=("namespace", "verb", "sql")),
        Inventory("gateway_routes", ("routes_to",), fields=("uri", "predicates", "filters")),
        Inventory("queue_bindings", ("subscribes_to", "publishes_to"), fields=("topics", "queues", "groupId")),
        Inventory("api_mappings", ("api_mapping", "api_call"), fields=("method", "url", "route")),
        Inventory("security_annotations", ("secured_by",), fields=("value",)),
        Inventory("jpa_entities", ("jpa_entity",), fields=("name",)),
        Inventory("react_components", ("react_component",)),
        Inventory("react_stores", ("react_store",)),
        Inventory("react_queries", ("react_query",)),
        Inventory("mongo_entities", ("mongo_entity",), fields=("collection", "value")),
        Inventory("redis_hashes", ("redis_hash",), fields=("value", "timeToLive")),
        Inventory("redis_templates", ("redis_operation",)),
        Inventory("sql_tables", ("sql_table", "maps_to"), fields=("column", "type")),
        Inventory("sql_statements", ("sql_statement", "jpa_query"), fields=("value", "nativeQuery")),
        Inventory("batch_jobs", ("batch_job",)),
        Inventory("resilience_policies", ("resilience_policy",), fields=("name", "fallbackMethod")),
        Inventory("pinia_stores", ("pinia_store",)),
        Inventory("i18n_messages", ("i18n_usage",), group="target"),
        Inventory("deploy_containers", ("deploy_mapping", "depends_on"), fields=("image", "ports")),
        Inventory("k8s_resources", ("k8s_deployment", "k8s_service", "ingress_route"), fields=("namespace", "image")),
        Inventory("openapi_endpoints", ("api_contract",), fields=("method", "operation_id")),
        Inventory("config_bindings", ("config_binding", "value_inject"), fields=("prefix", "value")),
        Inventory("transactions", ("transactional",), fields=("propagation", "isolation", "timeout", "readOnly")),
        Inventory("transaction_conflicts", ("tx_propagate",), fields=("outerPropagation", "innerPropagation")),
        Inventory("cache_topologies", ("cache_annotation",), group="target"),
        Inventory("routing_manifest", ("route",), fields=("value", "path", "method")),
        Inventory("lombok_members", ("lombok_synthetic",), fields=("value",)),
        Inventory("grpc_services", ("grpc_stub", "grpc_implements", "grpc_call", "grpc_message"), fields=("value",)),
        Inventory("mapstruct_mappers", ("mapstruct_mapper", "mapstruct_mapping"), fields=("source", "target", "componentModel")),
        Inventory("auto_configurations", ("auto_configure_after", "auto_configure_before", "conditional_config"), fields=("name", "havingValue", "matchIfMissing")),
        Inventory("maven_modules", ("maven_depends_on", "maven_submodule"), fields=("version", "scope")),
        Inventory("maven_scopes", ("maven_depends_on",), group="target"),
        Inventory("gradle_modules", ("gradle_depends_on", "gradle_includes"), fields=("configuration",)),
        Inventory("cloud_configs", ("cloud_config_ref",)),
        Inventory("load_balancer_clients", ("load_balanced",)),
        Inventory("load_balancer_uris", ("load_balanced_uri",), group="target"),
        Inventory("graphql_endpoints", ("graphql_handler",), fields=("value", "typeName", "field")),
        Inventory("websocket_endpoints", ("websocket_handler",), fields=("value",)),
        Inventory("test_annotations", ("test_class", "mock_replaces"), fields=("classes", "value")),
        Inventory("async_methods", ("async_method", "scheduled_method", "jobrunr_job"), fields=("cron", "fixedRate", "fixedDelay", "value")),
        Inventory("aspect_advices", prefix="aspect_", fields=("value", "pointcut")),
        Inventory("security_filter_rules", prefix="security_filter_", fields=("value",)),
        Inventory("k8s_services", ("k8s_service_binding",), fields=("port", "selector")),
        Inventory("k8s_ingresses", ("ingress_rule",), fields=("host", "route", "port")),
        Inventory("k8s_network_policies", ("network_policy_allow",), fields=("from",)),
        Inventory("controller_advices", ("controller_advice", "exception_handler"), fields=("value", "basePackages")),
        Inventory("interceptors", ("interceptor",)),
        Inventory("stream_functions", ("stream_function",), fields=("value",)),
        Inventory("jpa_custom_queries", ("jpa_query", "jpa_modifying"), fields=("value", "nativeQuery")),
        Inventory("jpa_procedures", ("jpa_procedure",), fields=("value", "procedureName")),
        Inventory("profiles", ("profile_activated",), fields=("value",)),
    )
}


def inventory(relations: DataFrame, name: str) -> DataFrame:
    """One inventory over (source, target, kind, metadata): by relation with its fields, or by group and user."""
    what = INVENTORIES[name]
    test = F.col("kind").startswith(what.prefix) if what.prefix else F.col("kind").isin(*what.kinds)
    rows = relations.where(test)
    if what.group:
        # One row for each use, with the number of uses of its group: a list of all users could grow without bound.
        uses = rows.select(what.group, F.col("source").alias("used_by")).distinct()
        return uses.join(uses.groupBy(what.group).agg(F.count("*").alias("n_uses")), what.group)
    return rows.select("source", "target", "kind", *[F.get_json_object("metadata", f"$.{f}").alias(f"f_{f}") for f in what.fields]).distinct()


def inventory_counts(relations: DataFrame) -> DataFrame:
    """(name, n_relations) of all inventories in one pass."""
    pairs = []
    for what in INVENTORIES.values():
        test = F.col("kind").startswith(what.prefix) if what.prefix else F.col("kind").isin(*what.kinds)
        pairs.append(F.when(test, F.lit(what.name)))
    rows = relations.select(F.explode(F.array_compact(F.array(*pairs))).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("n_relations"))
