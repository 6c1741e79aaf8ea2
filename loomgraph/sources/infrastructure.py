"""Relations that deployment, build and description files declare.

Each function takes current contents (path, language, content) and gives
(extractor, source, target, kind, metadata), like the rules for frameworks do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources import formats, frameworks
from loomgraph.sources.lines import current_contents


def _relation(df: DataFrame, extractor: str, source: Column, target: Column, kind: str | Column, **fields: str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    metadata = F.to_json(F.struct(*[F.col(column).cast("string").alias(name) for name, column in fields.items()])) if fields else F.lit("{}")
    return df.select(F.lit(extractor).alias("extractor"), source.alias("source"), target.alias("target"), kind.alias("kind"), metadata.alias("metadata")).where("source is not null and target is not null")


def _id(prefix: str, *columns: str) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws(":", *[F.col(c) for c in columns]))


def deployment(contents: DataFrame) -> DataFrame:
    """Compose services: what they depend on and which image they run."""
    services = formats.compose_services(contents)
    needs = _relation(services.withColumn("need", F.explode("depends_on")), "docker", _id("docker:", "name"), _id("docker:", "need"), "depends_on")
    runs = _relation(services.where("image is not null"), "docker", _id("docker:", "name"), _id("image:", "image"), "deploy_mapping", image="image", ports="ports")
    bases = _relation(formats.dockerfile(contents).withColumn("base", F.explode("bases")), "docker", F.col("path"), _id("image:", "base"), "deploy_mapping", ports="ports")
    return needs.unionByName(runs).unionByName(bases)


def kubernetes(contents: DataFrame) -> DataFrame:
    """Deployments, services and the deployments their selectors match, ingress rules and network policies."""
    rows = formats.kubernetes_resources(contents)
    deployments = rows.where("kind in ('Deployment', 'StatefulSet', 'DaemonSet', 'Job', 'CronJob')")
    services = rows.where("kind = 'Service'")
    images = _relation(deployments, "k8s", _id("k8s:Deployment:", "namespace", "name"), _id("image:", "image"), "k8s_deployment", namespace="namespace", image="image", replicas="replicas")
    exposed = _relation(services, "k8s", _id("k8s:Service:", "namespace", "name"), F.concat(F.lit("port:"), F.array_join("ports", ",")), "k8s_service", namespace="namespace")
    # A selector matches where all its labels are there: joined on one label, the others are compared.
    asked = services.select("namespace", F.col("name").alias("service"), "selector", "ports", F.get(F.map_entries("selector"), 0).alias("one")).where("one is not null")
    labelled = deployments.select("namespace", F.col("name").alias("deployment"), "labels", F.explode(F.map_entries("labels")).alias("one"))
    bound = asked.join(labelled, ["namespace", "one"]).where(F.size(F.array_except(F.map_entries("selector"), F.map_entries("labels"))) == 0).withColumn("selected", F.to_json("selector")).withColumn("port", F.array_join("ports", ","))
    bindings = _relation(bound, "k8s", _id("k8s:Service:", "namespace", "service"), _id("k8s:Deployment:", "namespace", "deployment"), "k8s_service_binding", selector="selected", port="port")
    rules = formats.ingress_rules(contents)
    ingress = _relation(rules, "k8s", _id("k8s:Ingress:", "name"), _id("k8s:Service:default:", "service"), "ingress_rule", host="host", route="route", port="port")
    policies = formats.network_policies(contents).withColumn("allowed", F.explode("allows"))
    allow = _relation(policies, "k8s", _id("app:", "allowed"), _id("app:", "applies_to"), "network_policy_allow", **{"from": "allowed"})
    return images.unionByName(exposed).unionByName(bindings).unionByName(ingress).unionByName(allow)


def builds(contents: DataFrame) -> DataFrame:
    """Dependencies and modules of Maven and Gradle builds."""
    modules = formats.maven_modules(contents)
    maven = _relation(formats.maven_dependencies(contents).where("not managed"), "maven", _id("pom:", "module"), _id("pom:", "artifact_id"), "maven_depends_on", version="version", scope="scope", group="group_id")
    parts = _relation(modules.withColumn("part", F.explode("submodules")), "maven", _id("pom:", "artifact_id"), _id("pom:", "part"), "maven_submodule")
    gradle = _relation(formats.gradle_dependencies(contents), "gradle", _id("gradle:", "path"), F.concat(F.when(F.col("is_project"), F.lit("gradle:project")).otherwise(F.lit("pom:")), "notation"), "gradle_depends_on", configuration="configuration")
    included = _relation(formats.gradle_includes(contents), "gradle", _id("gradle:", "path"), _id("gradle:project:", "module"), "gradle_includes")
    return maven.unionByName(parts).unionByName(gradle).unionByName(included)


def contracts(contents: DataFrame) -> DataFrame:
    """Endpoints of OpenAPI documents, calls and messages of gRPC services, operations of GraphQL schemas."""
    api = _relation(formats.openapi_endpoints(contents), "openapi", F.col("path"), _id("openapi:", "method", "route"), "api_contract", method="method", operation_id="operation_id")
    rpcs = formats.proto_services(contents)
    calls = _relation(rpcs, "grpc", _id("grpc:", "package", "service"), _id("grpc:", "package", "service", "rpc"), "grpc_call", request="request", response="response")
    used = rpcs.select("package", "service", "rpc", F.explode(F.array("request", "response")).alias("message"))
    messages = _relation(used, "grpc", _id("grpc:", "package", "service", "rpc"), _id("grpc:message:", "message"), "grpc_message")
    graphql = _relation(formats.graphql_operations(contents), "graphql", _id("graphql:", "type"), _id("graphql:", "type", "field"), "graphql_field", returns="returns")
    return api.unionByName(calls).unionByName(messages).unionByName(graphql)


def gateways(contents: DataFrame) -> DataFrame:
    rows = formats.gateway_routes(contents).withColumn("p", F.array_join("predicates", " ")).withColumn("f", F.array_join("filters", " "))
    return _relation(rows, "gateway", _id("gateway:", "id"), _id("service:", "service"), "routes_to", uri="uri", predicates="p", filters="f")


def statements(contents: DataFrame) -> DataFrame:
    """Mapper statements with the method they belong to, the tables they name, tables and columns of DDL, change logs."""
    rows = formats.mapper_statements(contents)
    mapped = _relation(rows, "mybatis", F.concat_ws(".", "namespace", "id"), _id("mybatis:", "namespace", "id"), "mybatis_mapping", namespace="namespace", verb="verb", sql="sql")
    tables = rows.select("namespace", "id", F.explode(F.array_distinct(F.regexp_extract_all("sql", F.lit(r"(?i)\b(?:from|join|into|update)\s+([\w.]+)"), F.lit(1)))).alias("table"))
    touched = _relation(tables, "sql", _id("mybatis:", "namespace", "id"), _id("mysql:table:", "table"), "maps_to")
    columns = _relation(formats.sql_tables(contents), "sql", _id("mysql:table:", "table"), _id("mysql:column:", "table", "column"), "sql_table", column="column", type="type")
    changes = _relation(formats.liquibase_changes(contents), "liquibase", F.col("path"), _id("liquibase:", "author", "id"), "liquibase_change", change="change", context="context")
    return mapped.unionByName(touched).unionByName(columns).unionByName(changes)


def processes(contents: DataFrame) -> DataFrame:
    """Flows between the elements of BPMN processes, and rules of rule files."""
    rows = formats.bpmn_elements(contents)
    flows = _relation(rows.where("tag = 'sequenceFlow'"), "flowable", _id("bpmn:", "process", "source_ref"), _id("bpmn:", "process", "target_ref"), "bpmn_flow", name="name")
    tasks = _relation(rows.where("tag != 'sequenceFlow'"), "flowable", _id("bpmn:", "process"), _id("bpmn:", "process", "id"), "bpmn_element", tag="tag", name="name")
    rules = _relation(formats.drools_rules(contents), "drools", _id("drools:", "package"), _id("drools:", "package", "rule"), "drools_rule", salience="salience", condition="condition")
    return flows.unionByName(tasks).unionByName(rules)


def messages(contents: DataFrame) -> DataFrame:
    """Uses of message keys joined with the locales that have them; a key without a locale has the target ``i18n:?:key``."""
    used = frameworks.text_relations(contents).where("kind = 'i18n_usage'").select(F.col("source").alias("path"), F.expr("substr(target, 6)").alias("key"))
    known = formats.locale_messages(contents).select("locale", "key").distinct()
    return _relation(used.join(known, "key", "left").withColumn("locale", F.coalesce("locale", F.lit("?"))), "i18n", F.col("path"), _id("i18n:", "locale", "key"), "i18n_usage")


def assets(contents: DataFrame) -> DataFrame:
    """Selectors of style sheets and the ids of elements."""
    css = _relation(formats.css_selectors(contents), "css", F.col("path"), _id("css:", "selector"), "css_selector")
    return css.unionByName(_relation(formats.html_elements(contents), "html", F.col("path"), _id("html:#", "id"), "html_element", tag="tag"))


def pages(contents: DataFrame) -> DataFrame:
    """Calls of pages matched with the route declarations of controllers, the best route of each."""
    from loomgraph.operators.links import match_routes

    calls = frameworks.text_relations(contents).where("kind = 'api_call'").select(F.concat_ws("\x1f", "source", "target").alias("call_id"), F.lit("ANY").alias("method"), F.expr("substr(target, 5)").alias("url")).distinct()
    routes = frameworks.routes(contents).where("framework in ('spring', 'webflux', 'nest', 'express')").select(F.concat_ws("\x1f", "path", "method", "route").alias("route_id"), F.col("method").alias("verb"), F.col("route").alias("path")).distinct()
    best = match_routes(calls, routes).withColumn("c", F.split("call_id", "\x1f")).withColumn("r", F.split("route_id", "\x1f"))
    rows = best.select(F.col("c")[0].alias("page"), F.expr("substr(c[1], 5)").alias("url"), F.col("r")[0].alias("handler"), F.col("r")[1].alias("method"), F.col("r")[2].alias("route"))
    return _relation(rows, "vue_api", F.col("page"), F.col("handler"), "api_mapping", url="url", method="method", route="route")


PARTS = (deployment, kubernetes, builds, contracts, gateways, statements, processes, messages, assets, pages)


def infrastructure_relations(files: DataFrame) -> DataFrame:
    """(extractor, source, target, kind, metadata) of all parts."""
    contents = current_contents(files)
    rows = None
    for part in PARTS:
        found = part(contents)
        rows = found if rows is None else rows.unionByName(found)
    return rows.distinct()
