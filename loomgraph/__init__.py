"""Spark-native analytics over a code knowledge graph.

Everything is ``DataFrame -> DataFrame``. Nothing in this package imports
the optional subpackage ``loomgraph.llm``.
"""

__version__ = "0.1.0"
