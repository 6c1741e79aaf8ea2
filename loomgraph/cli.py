"""Command line: one command for each tool and inventory, answers as JSON lines.

    python -m loomgraph.cli index SOURCE_TREE FOLDER
    python -m loomgraph.cli callers FOLDER --symbol NAME
    python -m loomgraph.cli jpa FOLDER
"""

from __future__ import annotations

import argparse
import json
import sys

from loomgraph import api
from loomgraph.operators.summaries import INVENTORIES

# Commands that show an inventory, and commands named otherwise than their tool.
INVENTORY_COMMANDS = {
    "gateway": "gateway_routes", "mq": "queue_bindings", "api-map": "api_mappings", "security": "security_annotations", "jpa": "jpa_entities", "batch": "batch_jobs", "resilience": "resilience_policies",
    "pinia": "pinia_stores", "i18n": "i18n_messages", "docker": "deploy_containers", "k8s": "k8s_resources", "openapi": "openapi_endpoints", "config": "config_bindings", "tx": "transactions",
    "tx-conflicts": "transaction_conflicts", "cache": "cache_topologies", "lombok": "lombok_members", "grpc": "grpc_services", "mapstruct": "mapstruct_mappers", "autoconfig": "auto_configurations",
    "maven": "maven_modules", "gradle": "gradle_modules", "cloud-config": "cloud_configs", "loadbalancer": "load_balancer_clients", "graphql": "graphql_endpoints", "websocket": "websocket_endpoints",
    "test": "test_annotations", "async": "async_methods", "aop": "aspect_advices", "security-filter": "security_filter_rules", "k8s-net": "k8s_network_policies", "advice": "controller_advices",
    "interceptor": "interceptors", "stream-func": "stream_functions", "jpa-query": "jpa_custom_queries", "profile": "profiles", "react": "react_components", "mongo": "mongo_entities", "redis": "redis_hashes",
    "sql": "sql_tables", "routes-manifest": "routing_manifest",
}
TOOL_COMMANDS = {"modules": "module", "affected": "affected_tests", "diagram": "mermaid", "dead-imports": "metrics"}


def commands() -> list[str]:
    return sorted({"index", "init", "sync", "routes", "dead-code", *INVENTORY_COMMANDS, *TOOL_COMMANDS, *(t.replace("_", "-") for t in api.TOOLS), *INVENTORIES})


def answer(index: api.Index, command: str, arguments: dict):
    """The DataFrame that a command asks for."""
    from loomgraph.operators import links
    from loomgraph.sources import frameworks

    name = command.replace("-", "_")
    if command == "dead-code":
        return links.dead_code(index.tables.edges, index.tables.nodes)
    if command == "routes":
        return frameworks.routes(index.tables.files)
    if command in INVENTORY_COMMANDS:
        return api.inventory_of(index, INVENTORY_COMMANDS[command])
    if command in TOOL_COMMANDS:
        return index.run(TOOL_COMMANDS[command], **(arguments | ({"type": "dead-imports"} if command == "dead-imports" else {})))
    if name in api.TOOLS:
        return index.run(name, **arguments)
    if name in INVENTORIES:
        return api.inventory_of(index, name)
    raise SystemExit(f"no command {command}; there are: {', '.join(commands())}")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    parser.add_argument("command")
    parser.add_argument("folder")
    parser.add_argument("target", nargs="?")
    parser.add_argument("--pretty", action="store_true")
    known, rest = parser.parse_known_args(args)
    given = {}
    for key, value in zip(rest[::2], rest[1::2]):
        given[key.lstrip("-").replace("-", "_")] = int(value) if value.lstrip("-").isdigit() else value
    if isinstance(given.get("paths"), str):
        given["paths"] = given["paths"].split(",")
    from loomgraph.session import build_session

    spark = build_session()
    if known.command in ("index", "init", "sync"):
        api.build_index(spark, known.folder, known.target or f"{known.folder}/.loomgraph")
        return 0
    for row in answer(api.Index(spark, known.folder), known.command, given).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False, indent=2 if known.pretty else None))
    return 0


if __name__ == "__main__":
    sys.exit(main())
