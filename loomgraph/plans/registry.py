"""All queries of the core and their SQL."""

from __future__ import annotations

from loomgraph.plans import graph, problems, sources

MODULES = (problems, graph, sources)


def queries():
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql():
    return {name: text for module in MODULES for name, text in module.SQL.items()}


def flagship(spark, folder):
    return graph.QUERIES["impact"](spark, folder)
