"""Named tools over a folder of tables: a name, arguments, and a DataFrame as answer.

Symbols are given by id, or by text that is searched for first. Limits are kept
within their bounds; pages say how many rows there are.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.paths import glob_regex, language_of
from loomgraph.operators import aggregates, context, diagrams, dispatch, graph, links, ranking, resolution, search, sets, summaries, traces, traversal
from loomgraph.plans.base import Folder
from loomgraph.sources import formats, frameworks, infrastructure, lines


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    run: Callable[..., DataFrame]
    arguments: dict[str, str] = field(default_factory=dict)


TOOLS: dict[str, Tool] = {}


def tool(name: str, about: str, **arguments: str):
    def keep(run):
        TOOLS[name] = Tool(name, about, run, arguments)
        return run

    return keep


class Unsupported(NotImplementedError):
    """A tool that is listed but has no implementation to match."""


class Index:
    """A folder of tables with all tools as methods: ``Index(spark, folder).run("callers", symbol=...)``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.tables = spark, folder, Folder(spark, folder)

    def run(self, name: str, **arguments) -> DataFrame:
        known = TOOLS[name]
        unknown = set(arguments) - set(known.arguments)
        if unknown:
            raise TypeError(f"{name} has no argument {', '.join(sorted(unknown))}")
        return known.run(self, **arguments)

    def symbols(self, symbol: str, most: int = 5) -> DataFrame:
        """(id): the symbol of that id, or the best matches of a search."""
        rows = graph.current_nodes(self.tables.nodes, "name").where(F.col("id") == symbol).select("id")
        return rows if not rows.isEmpty() else search.search(self.tables.nodes, symbol, most).select("id")

    def relations(self) -> DataFrame:
        """All relations: those of the edge table and those that frameworks leave in sources."""
        t = self.tables
        found = frameworks.annotation_relations(t.files).select("source", "target", "kind", "metadata")
        texts = frameworks.text_relations(t.files).select("source", "target", "kind", F.lit(None).cast("string").alias("metadata"))
        declared = infrastructure.infrastructure_relations(t.files).select("source", "target", "kind", "metadata")
        return t.edges.select("source", "target", "kind", "metadata").unionByName(found).unionByName(texts).unionByName(declared)


def _page(df: DataFrame, order: list, limit=None, offset=0) -> DataFrame:
    return ranking.page(df, order, limit, offset)


@tool("search", "Search symbols by name, text and fields", query="str", kind="str", limit="int", offset="int")
def _search(ix: Index, query: str, kind: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = search.search(ix.tables.nodes, f"kind:{kind} {query}" if kind else query, 1000)
    return _page(rows, [F.desc("score"), "id"], limit, offset)


@tool("context", "Symbols, neighbours and code for a task", task="str", max_nodes="int")
def _context(ix: Index, task: str, max_nodes: int = 20) -> DataFrame:
    t = ix.tables
    rows = context.build_context(t.nodes, t.edges, t.files, task).limit(max_nodes)
    return context.code_blocks(rows, t.nodes, t.files, t.edges)


@tool("explore", "Symbols by file, for a text or for all", query="str")
def _explore(ix: Index, query: str | None = None) -> DataFrame:
    if not query:
        return aggregates.module_stats(ix.tables.modules, ix.tables.files, ix.tables.nodes)
    rows = search.search(ix.tables.nodes, query, 200)
    return rows.groupBy("file_path").agg(F.count("*").alias("n_symbols"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


@tool("semantic_search", "Search by meaning (listed only)", query="str")
def _semantic(ix: Index, query: str) -> DataFrame:
    raise Unsupported("semantic_search")


@tool("trace", "Call paths between two symbols", start="str", end="str", max_depth="int", max_paths="int")
def _trace(ix: Index, start: str, end: str, max_depth: int = 6, max_paths: int = 20) -> DataFrame:
    steps = graph.relations(ix.tables.edges, "calls", "implements", "overrides", "dispatch_call", "instantiates")
    paths = traversal.simple_paths(steps, ix.symbols(start, 1), ix.symbols(end, 1), min(max_depth, 12))
    return paths.orderBy("length", F.array_join("path", ">")).limit(max_paths)


@tool("callers", "Who calls a symbol, other services too", symbol="str", limit="int", offset="int")
def _callers(ix: Index, symbol: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    t = ix.tables
    rows = links.callers_with_external(t.edges, t.nodes, t.external_symbols).join(ix.symbols(symbol, 1).withColumnRenamed("id", "symbol"), "symbol", "left_semi")
    return _page(rows, ["caller_id", "provenance"], limit, offset)


@tool("callees", "What a symbol calls, other services too", symbol="str", limit="int", offset="int")
def _callees(ix: Index, symbol: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    t = ix.tables
    rows = links.callees_with_external(t.edges, t.nodes, t.external_symbols).join(ix.symbols(symbol, 1).withColumnRenamed("id", "symbol"), "symbol", "left_semi")
    return _page(rows, ["callee_id", "provenance"], limit, offset)


@tool("node", "A symbol with its source", symbol="str")
def _node(ix: Index, symbol: str) -> DataFrame:
    t = ix.tables
    rows = ix.symbols(symbol, 1)
    details = graph.current_nodes(t.nodes, "kind", "name", "qualified_name", "signature", "docstring", "visibility", "start_line", "end_line")
    return details.join(rows, "id", "left_semi").join(context.code_blocks(rows, t.nodes, t.files, t.edges), "id", "left")


@tool("impact", "What a change of a symbol may break", symbol="str", depth="int", limit="int")
def _impact(ix: Index, symbol: str, depth: int = 3, limit: int | None = None) -> DataFrame:
    t = ix.tables
    rows = traversal.impact(t.edges, t.nodes, ix.symbols(symbol, 1), max(1, min(depth, 5)))
    return _page(rows, ["depth", "id"], limit)


@tool("backtrace", "The way from entry points to a symbol", symbol="str", depth="int", max_paths="int")
def _backtrace(ix: Index, symbol: str, depth: int = 6, max_paths: int = 10) -> DataFrame:
    t = ix.tables
    upwards = graph.relations(t.edges, "calls", "contains", "implements", "overrides").select(F.col("target").alias("source"), F.col("source").alias("target"))
    entries = traversal.entry_points(t.edges, t.nodes).select("id")
    return traversal.simple_paths(upwards, ix.symbols(symbol, 1), entries, min(depth, 15)).orderBy("length", F.array_join("path", ">")).limit(max_paths)


@tool("files", "Indexed files, by pattern", pattern="str", limit="int")
def _files(ix: Index, pattern: str = "*", limit: int | None = None) -> DataFrame:
    rows = sets.upsert_files(ix.tables.files).where(F.col("path").rlike(glob_regex(pattern)))
    return _page(rows.select("path", "language", "size", "node_count"), ["path"], limit)


@tool("file_content", "The stored content of a file", path="str", max_lines="int")
def _file_content(ix: Index, path: str, max_lines: int = 500) -> DataFrame:
    rows = lines.source_lines(lines.current_contents(ix.tables.files.where(F.col("path") == path)))
    return rows.where(F.col("line") <= max_lines).select("line", "text").orderBy("line")


@tool("status", "Counts of all tables and kinds")
def _status(ix: Index) -> DataFrame:
    t = ix.tables
    counts = aggregates.table_counts(files=t.files, nodes=t.nodes, edges=t.edges, modules=t.modules)
    return counts.unionByName(aggregates.kind_breakdown(t.nodes).select(F.concat(F.lit("kind:"), "kind").alias("name"), F.col("n_nodes").alias("n_rows")))


@tool("module", "Modules with their files and symbols")
def _module(ix: Index) -> DataFrame:
    return aggregates.module_stats(ix.tables.modules, ix.tables.files, ix.tables.nodes)


@tool("processes", "BPMN processes with their elements", limit="int")
def _processes(ix: Index, limit: int | None = None) -> DataFrame:
    return _page(formats.bpmn_elements(lines.current_contents(ix.tables.files)), ["path", "process", "id"], limit)


@tool("rules", "Rules with conditions and actions", query="str", limit="int")
def _rules(ix: Index, query: str = "", limit: int | None = None) -> DataFrame:
    return _page(formats.drools_search(formats.drools_rules(lines.current_contents(ix.tables.files)), query), ["path", "rule"], limit)


def git_log(spark: SparkSession, root: str, *arguments: str) -> DataFrame:
    """(commit, author, at, subject, path) of a repository, read by the driver."""
    text = subprocess.run(["git", "-C", root, "log", "--format=\x1e%H\x1f%an\x1f%aI\x1f%s", "--name-only", *arguments], capture_output=True, text=True, check=True).stdout
    rows = []
    for entry in text.split("\x1e")[1:]:
        head, *names = entry.strip("\n").split("\n")
        commit = head.split("\x1f")
        rows += [(*commit, name) for name in names if name]
    return spark.createDataFrame(rows, "commit string, author string, at string, subject string, path string")


def git_changes(spark: SparkSession, root: str) -> DataFrame:
    """(path, op) of a working tree: added, modified or deleted."""
    text = subprocess.run(["git", "-C", root, "status", "--porcelain", "--no-renames"], capture_output=True, text=True, check=True).stdout
    rows = [(line[3:].strip('"'), "added" if line[:2] == "??" else "deleted" if "D" in line[:2] else "modified") for line in text.splitlines()]
    return spark.createDataFrame(rows, "path string, op string")


@tool("history", "Commits that touched a file", root="str", path="str", max_commits="int")
def _history(ix: Index, root: str, path: str, max_commits: int = 20) -> DataFrame:
    return git_log(ix.spark, root, f"-{int(max_commits)}", "--follow", "--", path)


@tool("affected_tests", "Tests that changed files may break", paths="list", min_confidence="float", limit="int")
def _affected(ix: Index, paths: list[str], min_confidence: float = 0.0, limit: int | None = None) -> DataFrame:
    changed = ix.spark.createDataFrame([(p,) for p in paths], "path string")
    rows = links.affected_tests(ix.tables.edges, ix.tables.nodes, changed).where(F.col("confidence") >= min_confidence)
    return _page(rows, [F.desc("confidence"), "test_file"], limit)


@tool("lint", "Rules of architecture (listed only)")
def _lint(ix: Index) -> DataFrame:
    raise Unsupported("lint")


@tool("summary", "Modules, entry points, frameworks")
def _summary(ix: Index) -> DataFrame:
    t = ix.tables
    parts = aggregates.architecture(t.modules, t.nodes, t.edges).select(F.col("module_id").alias("name"), F.col("n_entry_points").alias("n"), F.lit("module").alias("what"))
    found = frameworks.detected_frameworks(t.files).groupBy(F.col("framework").alias("name")).agg(F.sum("n_files").alias("n")).withColumn("what", F.lit("framework"))
    return parts.unionByName(found)


@tool("metrics", "Complexity, hot paths, cycles or dead imports", type="str", limit="int")
def _metrics(ix: Index, type: str = "complexity", limit: int = 20) -> DataFrame:
    t = ix.tables
    if type == "complexity":
        return aggregates.complexity(t.nodes, t.files).orderBy(F.desc("complexity"), "id").limit(limit)
    if type == "hot-paths":
        return aggregates.hot_spots(t.edges, limit)
    if type == "circular":
        steps = links.file_dependencies(t.edges, t.nodes).select(F.col("file_path").alias("source"), F.col("depends_on").alias("target"))
        return traversal.cycles(steps, 5).orderBy("length", F.array_join("path", ">")).limit(limit)
    if type == "dead-imports":
        return links.dead_imports(t.edges, t.nodes).orderBy("file_path", "imported_id").limit(limit)
    raise ValueError(type)


@tool("search_files", "Files by pattern, content and language", pattern="str", language="str", keyword="str", limit="int")
def _search_files(ix: Index, pattern: str = "*", language: str | None = None, keyword: str | None = None, limit: int | None = None) -> DataFrame:
    rows = lines.current_contents(ix.tables.files).where(F.col("path").rlike(glob_regex(pattern)))
    if language:
        rows = rows.where((F.lower("language") == language.lower()) | (language_of("path") == language.lower()))
    if keyword:
        rows = rows.where(F.contains(F.lower("content"), F.lit(keyword.lower())))
    return _page(rows.select("path", "language"), ["path"], limit)


@tool("related_tests", "Tests related to a file or symbol", symbol="str", path="str", limit="int")
def _related(ix: Index, symbol: str | None = None, path: str | None = None, limit: int | None = None) -> DataFrame:
    t = ix.tables
    changed = ix.spark.createDataFrame([(path,)], "path string") if path else graph.current_nodes(t.nodes, "file_path").join(ix.symbols(symbol), "id", "left_semi").select(F.col("file_path").alias("path"))
    return _page(links.affected_tests(t.edges, t.nodes, changed), [F.desc("confidence"), "test_file"], limit)


@tool("recent_changes", "Recently changed files", root="str", max_commits="int", since="str")
def _recent(ix: Index, root: str, max_commits: int = 20, since: str | None = None) -> DataFrame:
    return git_log(ix.spark, root, f"-{int(max_commits)}", *([f"--since={since}"] if since else []))


@tool("unresolved_refs", "References to symbols that aren't indexed", kind="str", limit="int")
def _unresolved(ix: Index, kind: str | None = None, limit: int | None = None) -> DataFrame:
    t = ix.tables
    rows = resolution.unresolved(t.edges, t.nodes, t.external_symbols)
    return _page(rows.where(F.col("kind") == kind) if kind else rows, ["source", "target", "kind"], limit)


@tool("export", "Nodes, edges or files as rows, or edges as DOT", scope="str", format="str", module="str", limit="int")
def _export(ix: Index, scope: str = "nodes", format: str = "json", module: str | None = None, limit: int = 1000) -> DataFrame:
    t, limit = ix.tables, max(1, min(int(limit), 10_000))
    if format == "dot":
        return sets.export_dot(t.edges, limit)
    rows = {"nodes": lambda: graph.current_nodes(t.nodes), "edges": lambda: graph.unique_edges(t.edges), "files": lambda: sets.upsert_files(t.files)}[scope]()
    if module and "module_id" in rows.columns:
        rows = rows.where(F.col("module_id") == module)
    return rows.orderBy(*[c for c in ("id", "path", "source", "target", "kind") if c in rows.columns]).limit(limit)


@tool("available_tools", "All tools with their arguments", filter="str")
def _tools(ix: Index, filter: str = "") -> DataFrame:
    rows = [(x.name, x.about, ", ".join(f"{k}: {v}" for k, v in x.arguments.items())) for x in TOOLS.values() if filter.lower() in x.name]
    return ix.spark.createDataFrame(rows, "name string, about string, arguments string")


@tool("architecture", "Modules, entry points and dependencies")
def _architecture(ix: Index) -> DataFrame:
    return aggregates.architecture(ix.tables.modules, ix.tables.nodes, ix.tables.edges)


@tool("feign", "Declared clients with their methods")
def _feign(ix: Index) -> DataFrame:
    return frameworks.feign_references(ix.tables.files)


@tool("mybatis", "Mapper statements")
def _mybatis(ix: Index) -> DataFrame:
    return formats.mapper_statements(lines.current_contents(ix.tables.files))


@tool("page_trace", "Files behind a page, and the requests in them", page="str", max_depth="int")
def _page_trace(ix: Index, page: str, max_depth: int = 4) -> DataFrame:
    t = ix.tables
    pages = ix.spark.createDataFrame([(page,)], "path string")
    reached = traversal.page_fanout(t.edges, t.nodes, pages, max_depth)
    calls = frameworks.http_references(t.files).select(F.col("source").alias("id"), "url")
    return reached.join(calls, "id", "left")


@tool("service_trace", "Entry points and calls of services", service="str")
def _service_trace(ix: Index, service: str | None = None) -> DataFrame:
    rows = traces.service_traces(ix.tables.edges, ix.tables.nodes, ix.tables.external_symbols)
    return rows.where(F.col("module_id") == service) if service else rows


@tool("dispatch", "Inferred targets of a symbol", symbol="str")
def _dispatch(ix: Index, symbol: str) -> DataFrame:
    t = ix.tables
    known = links.dispatch_targets(t.edges).select("symbol", "other_id", "kind", "confidence")
    inferred = dispatch.infer(t.nodes, t.edges).select(F.col("source").alias("symbol"), F.col("target").alias("other_id"), "kind", "confidence")
    return known.unionByName(inferred).join(ix.symbols(symbol, 1).withColumnRenamed("id", "symbol"), "symbol", "left_semi").distinct()


@tool("mermaid", "Diagrams as Mermaid text", diagram="str")
def _mermaid(ix: Index, diagram: str = "architecture") -> DataFrame:
    t = ix.tables
    services = lambda: aggregates.service_graph(t.edges, t.nodes)
    return {
        "architecture": lambda: diagrams.architecture_diagram(t.modules, services()),
        "service-dependency": lambda: diagrams.service_diagram(services()),
        "sequence": lambda: diagrams.sequence_diagram(services()),
        "trace": lambda: diagrams.trace_diagram(traces.trace_steps(traces.full_traces(t.edges, t.nodes))),
        "cache": lambda: diagrams.key_diagram(t.edges, t.nodes, "cache:"),
        "transaction": lambda: diagrams.key_diagram(t.edges, t.nodes, "tx:"),
        "gateway": lambda: diagrams.gateway_diagram(formats.gateway_routes(lines.current_contents(t.files))),
    }[diagram]()


@tool("workspace_status", "Services with what they provide and use")
def _workspace_status(ix: Index) -> DataFrame:
    return aggregates.service_counts(ix.tables.edges, ix.tables.external_symbols)


def inventory_of(ix: Index, name: str) -> DataFrame:
    return summaries.inventory(ix.relations(), name)


def read_tree(spark: SparkSession, root: str, most_bytes: int = 10_000_000) -> DataFrame:
    """(path, content_hash, language, size, modified_at, indexed_at, content) of a source tree, paths relative to it.

    Folders of tools and version control are left out, and so are files that
    are larger than ``most_bytes``, which parsers don't take.
    """
    base = Path(root).resolve().as_posix()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file:{base}")
    relative = F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit(base + "/"), F.lit(""))
    rows = files.where(F.col("length") <= most_bytes).select(relative.alias("path"), F.md5("content").alias("content_hash"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"), F.decode("content", "UTF-8").alias("content"))
    rows = rows.where(~F.col("path").rlike(r"(^|/)(\.git|\.svn|\.hg|\.idea|\.vscode|node_modules|__pycache__)(/|$)"))
    rows = rows.withColumn("language", language_of("path")).where("language != 'unknown'")
    return rows.select("path", "content_hash", "language", "size", "modified_at", F.unix_millis(F.current_timestamp()).alias("indexed_at"), "content")


def build_index(spark: SparkSession, root: str, folder: str) -> None:
    """Reads a source tree and writes the tables files, nodes and edges to a folder."""
    files = read_tree(spark, root)
    sets.write_table(files.withColumn("module_id", F.lit("default")).withColumn("node_count", F.lit(0)), f"{folder}/files.parquet")
    files = spark.read.parquet(f"{folder}/files.parquet")
    contents = lines.current_contents(files)
    docs = lines.doc_comments(contents).select(F.col("path").alias("file_path"), F.col("line").alias("start_line"), "docstring")
    nodes = lines.parsed_nodes(contents).join(docs, ["file_path", "start_line"], "left")
    now = F.current_timestamp().alias("created_at")
    sets.write_table(nodes.select("*", F.lit("default").alias("module_id"), F.lit("{}").alias("metadata"), F.lit(0).alias("start_column"), F.lit(0).alias("end_column"), (F.col("visibility") == "public").alias("is_exported"), now, F.monotonically_increasing_id().alias("seq")), f"{folder}/nodes.parquet")
    found = frameworks.annotation_relations(contents).select("source", "target", "kind", F.col("line").cast("int").alias("line"), "metadata")
    edges = lines.parsed_edges(contents).withColumn("metadata", F.lit("{}")).select("source", "target", "kind", F.col("line").cast("int").alias("line"), "metadata").unionByName(found)
    sets.write_table(edges.select("*", F.lit(0).alias("col"), now, F.monotonically_increasing_id().alias("seq")), f"{folder}/edges.parquet")
