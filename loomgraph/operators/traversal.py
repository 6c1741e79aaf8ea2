"""Walks over the graph, breadth first, one join per round.

Every round is written to the shared folder, so the lineage stays short and a
lost executor repeats one round only. A round joins the new frontier, not all
that was seen, and rows that were seen before are removed by an anti join.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import DISPATCH_KINDS, annotations, current_nodes, relations
from loomgraph.session import Scratch


def reach(steps: DataFrame, seeds: DataFrame, depth: int | None, per_seed: bool = False) -> DataFrame:
    """(id, depth) with the least depth of all ids reached from the seeds (id); with ``per_seed`` (seed, id, depth).

    ``steps`` is (source, target). Seeds have depth 0. Null ids are no seeds.
    Without a depth the walk ends when it meets nothing new.
    """
    scratch = Scratch(steps.sparkSession)
    steps = scratch.write(steps.select("source", "target").where("source is not null and target is not null").distinct())
    keys = ["seed", "id"] if per_seed else ["id"]
    start = seeds.select("id").where("id is not null").distinct()
    frontier = scratch.write((start.select(F.col("id").alias("seed"), "id") if per_seed else start).withColumn("depth", F.lit(0)))
    seen = [frontier]
    for level in count(1) if depth is None else range(1, depth + 1):
        following = frontier.select(*keys).withColumnRenamed("id", "source").join(steps, "source").select(*[k for k in keys if k != "id"], F.col("target").alias("id")).distinct()
        following = following.join(scratch.together(seen).select(*keys), keys, "left_anti")
        frontier, found = scratch.counted(following.withColumn("depth", F.lit(level)))
        if not found["rows"]:
            break
        seen.append(frontier)
    return scratch.together(seen)


def impact_steps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target): from a symbol to what a change of it may break: callers, children, implementations."""
    called = relations(edges, "calls", "references", "instantiates").select(F.col("target").alias("source"), F.col("source").alias("target"))
    children = current_nodes(nodes, "parent_id").where("parent_id is not null").select(F.col("parent_id").alias("source"), F.col("id").alias("target"))
    implementing = relations(edges, "implements", "overrides", "extends").select(F.col("target").alias("source"), F.col("source").alias("target"))
    stored = current_nodes(nodes, "kind").select("id")
    steps = called.union(children).union(implementing).distinct()
    return steps.join(stored.withColumnRenamed("id", "source"), "source", "left_semi").join(stored.withColumnRenamed("id", "target"), "target", "left_semi")


def impact(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(id, depth): the blast radius of the seeds, without them."""
    return reach(impact_steps(edges, nodes), seeds, depth).where("depth > 0")


def simple_paths(steps: DataFrame, starts: DataFrame, ends: DataFrame | None, depth: int) -> DataFrame:
    """(path, length): all paths without a repeated id, of at most ``depth`` steps, from starts (id) to ends (id)."""
    scratch = Scratch(steps.sparkSession)
    steps = scratch.write(steps.select("source", "target").where("source is not null and target is not null").distinct())
    frontier = scratch.write(starts.select(F.col("id").alias("at"), F.array("id").alias("path")).where("at is not null").distinct())
    found = []
    for _ in range(depth):
        grown = frontier.join(steps.withColumnRenamed("source", "at"), "at").where(~F.array_contains("path", F.col("target")))
        frontier = scratch.write(grown.select(F.col("target").alias("at"), F.array_append("path", F.col("target")).alias("path")))
        if frontier.isEmpty():
            break
        found.append(frontier)
    out = frontier.where("false")
    for part in found:
        out = out.unionByName(part)
    if ends is not None:
        out = out.join(ends.select(F.col("id").alias("at")).distinct(), "at", "left_semi")
    return out.select("path", (F.size("path") - 1).alias("length"))


def cycles(steps: DataFrame, length: int) -> DataFrame:
    """(path, length): cycles of 2 to ``length`` ids, each once, beginning with its smallest id.

    Ids without a way in or out can't be on a cycle and are peeled off first.
    """
    scratch = Scratch(steps.sparkSession)
    core = scratch.write(steps.select("source", "target").where("source is not null and target is not null and source != target").distinct())
    left = core.count()
    while left:
        smaller = core.join(core.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(core.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        smaller, found = scratch.counted(smaller.select("source", "target"))
        scratch.drop(core)
        core, before, left = smaller, left, found["rows"]
        if left == before:
            break
    frontier = core.where("source < target").select(F.col("source").alias("start"), F.col("target").alias("at"), F.array("source", "target").alias("path"))
    found = None
    for size in range(2, length + 1):
        frontier = scratch.write(frontier)
        closed = frontier.join(core.select(F.col("source").alias("at"), F.col("target").alias("start")), ["at", "start"], "left_semi").select("path", F.lit(size).alias("length"))
        found = closed if found is None else found.unionByName(closed)
        if size < length:
            grown = frontier.join(core.withColumnRenamed("source", "at"), "at").where((F.col("target") > F.col("start")) & ~F.array_contains("path", F.col("target")))
            frontier = grown.select("start", F.col("target").alias("at"), F.array_append("path", F.col("target")).alias("path"))
    return found


def components(steps: DataFrame) -> DataFrame:
    """(component, id, size): the strongly connected components of two and more ids, named by their largest id.

    Every id takes the largest id that reaches it; those from which that one is
    reached again within its label are its component. The rest goes on with
    the steps inside one label until none is left, so cycles of any length count.
    """
    scratch = Scratch(steps.sparkSession)
    core = scratch.write(steps.select("source", "target").where("source is not null and target is not null and source != target").distinct())
    found = core.select(F.col("source").alias("component"), F.col("source").alias("id")).where("false")
    while not core.isEmpty():
        # Only ids with a way in and a way out can be on a cycle.
        before, left = -1, core.count()
        while left != before:
            core, n = scratch.counted(core.join(core.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(core.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
            before, left = left, n["rows"]
        if not left:
            break
        label = scratch.write(core.select(F.col("source").alias("id")).distinct().withColumn("label", F.col("id")).withColumn("changed", F.lit(True)))
        moved = True
        while moved:
            passed = core.join(label.where("changed").select(F.col("id").alias("source"), "label"), "source").select(F.col("target").alias("id"), "label", F.lit(None).cast("string").alias("own"))
            joined = label.select("id", "label", F.col("label").alias("own")).unionByName(passed).groupBy("id").agg(F.max("label").alias("label"), F.max("own").alias("own"))
            label, n = scratch.counted(joined.select("id", "label", (F.col("label") != F.col("own")).alias("changed")), changed=F.count_if("changed"))
            moved = n["changed"] > 0
        a = label.select(F.col("id").alias("source"), F.col("label").alias("a"))
        b = label.select(F.col("id").alias("target"), F.col("label").alias("b"))
        inside = scratch.write(core.join(a, "source").join(b, "target").where("a = b").select("source", "target"))
        back = reach(inside.select(F.col("target").alias("source"), F.col("source").alias("target")), label.where("id = label").select("id"), None)
        done = scratch.write(back.select("id").join(label, "id").select(F.col("label").alias("component"), "id"))
        found = found.unionByName(done)
        core = scratch.write(inside.join(done.select(F.col("id").alias("source")), "source", "left_anti").join(done.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target"))
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return found.join(sizes, "component").select("component", "id", "size")


# Annotations that make a symbol an entry point, by kind of entry.
ENTRY_ANNOTATIONS = {
    "GetMapping": "rest_endpoint", "PostMapping": "rest_endpoint", "PutMapping": "rest_endpoint", "DeleteMapping": "rest_endpoint", "PatchMapping": "rest_endpoint",
    "RequestMapping": "rest_endpoint", "RabbitListener": "mq_listener", "KafkaListener": "mq_listener", "JmsListener": "mq_listener", "Scheduled": "scheduled_task",
    "SchedulingConfigurer": "scheduled_task", "VueRoute": "page_entry", "Route": "page_entry", "Component": "component",
}


def entry_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, entry): by kind, by the first telling annotation, or a main function of a JVM language."""
    pairs = F.create_map(*[F.lit(x) for pair in ENTRY_ANNOTATIONS.items() for x in pair])
    marked = annotations(edges).select(F.col("node_id").alias("id"), pairs[F.col("annotation_name")].alias("marked")).where("marked is not null").groupBy("id").agg(F.min("marked").alias("marked"))
    rows = current_nodes(nodes, "kind", "name", "file_path").join(marked, "id", "left")
    main = (F.col("name") == "main") & F.col("file_path").rlike("[.](java|kt)$")
    entry = F.when(F.col("kind") == "entry_point", "entry_point").when(F.col("marked").isNotNull(), F.col("marked")).when(main, "main_method")
    return rows.select("id", entry.alias("entry")).where("entry is not null")


def distance_from_entry(edges: DataFrame, nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth): least number of calls or memberships from an entry point to each symbol that one reaches.

    Asking every symbol for the way back to an entry is one walk from all
    entries forwards.
    """
    stored = current_nodes(nodes, "kind").select("id")
    calls = relations(edges, "calls", "contains").join(stored.withColumnRenamed("id", "target"), "target", "left_semi")
    return reach(calls, entry_points(edges, nodes), depth)


def _sketch_mark(sketch: str) -> Column:
    """Text that differs if what is in the sketch differs: the registers of a full one, else the number of values."""
    return F.when(F.length(sketch) > 4096, F.md5(F.expr(f"substring({sketch}, 41)"))).otherwise(F.hll_sketch_estimate(sketch).cast("string"))


def transitive_callers(edges: DataFrame, nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(symbol, n_callers): different symbols that call it directly or through others, up to ``depth`` calls or all.

    A HyperLogLog sketch per symbol is joined along the calls (one shuffle of
    sketches per round), so no pair of symbols is ever listed. Sketches only
    grow, so the rounds end when none changes, also where calls form cycles;
    only those that changed in the last round are passed on.
    """
    scratch = Scratch(edges.sparkSession)
    stored = current_nodes(nodes, "kind").select("id")
    calls = scratch.write(relations(edges, "calls").join(stored.withColumnRenamed("id", "source"), "source", "left_semi").join(stored.withColumnRenamed("id", "target"), "target", "left_semi"))
    first = calls.groupBy(F.col("target").alias("id")).agg(F.hll_sketch_agg("source", F.lit(12)).alias("sketch"))
    state = scratch.write(first.withColumn("mark", F.lit(None).cast("string")).withColumn("changed", F.lit(True)))
    done = 1
    changed = True
    while (depth is None or done < depth) and changed:
        passed = state.where("changed").select(F.col("id").alias("source"), "sketch")
        inherited = calls.join(passed, "source").select(F.col("target").alias("id"), "sketch", F.lit(None).cast("string").alias("mark"))
        joined = state.select("id", "sketch", "mark").unionByName(inherited).groupBy("id").agg(F.hll_union_agg("sketch").alias("sketch"), F.max("mark").alias("before"))
        marked = joined.withColumn("mark", _sketch_mark("sketch"))
        following, n = scratch.counted(marked.select("id", "sketch", "mark", (~F.col("mark").eqNullSafe(F.col("before"))).alias("changed")), changed=F.count_if("changed"))
        changed = n["changed"] > 0
        scratch.drop(state)
        state = following
        done += 1
    return state.select(F.col("id").alias("symbol"), F.hll_sketch_estimate("sketch").alias("n_callers"))


def related_symbols(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, relation, other_id): callers, callees, children, parents and implementations."""
    stored = current_nodes(nodes, "parent_id").select("id", "parent_id")
    ids = stored.select("id")
    calls = relations(edges, "calls")
    out = calls.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("symbol"), F.lit("callee").alias("relation"), F.col("target").alias("other_id"))
    into = calls.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("symbol"), F.lit("caller").alias("relation"), F.col("source").alias("other_id"))
    nested = stored.where("parent_id is not null")
    child = nested.select(F.col("parent_id").alias("symbol"), F.lit("child").alias("relation"), F.col("id").alias("other_id"))
    parent = nested.join(ids.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select(F.col("id").alias("symbol"), F.lit("parent").alias("relation"), F.col("parent_id").alias("other_id"))
    impl = relations(edges, "implements").select(F.col("target").alias("symbol"), F.lit("implementation").alias("relation"), F.col("source").alias("other_id"))
    return out.unionByName(into).unionByName(child).unionByName(parent).unionByName(impl)


def dispatch_chain(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(id, depth) reached from the seeds through inferred relations in either direction."""
    inferred = edges.where(F.col("kind").isin(*DISPATCH_KINDS)).select("source", "target").distinct()
    both = inferred.union(inferred.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    return reach(both, seeds, depth)


def page_fanout(edges: DataFrame, nodes: DataFrame, pages: DataFrame, depth: int = 4) -> DataFrame:
    """(seed, id, depth): files that a page file imports, directly or through others."""
    from loomgraph.operators.links import file_dependencies

    steps = file_dependencies(edges, nodes).select(F.col("file_path").alias("source"), F.col("depends_on").alias("target"))
    return reach(steps, pages.select(F.col("path").alias("id")), depth, per_seed=True)


def expand(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, per_seed: int = 10) -> DataFrame:
    """(seed, id): callers and callees of each seed, the first by id."""
    from loomgraph.operators.ranking import top_per_group

    near = related_symbols(edges, nodes).where("relation in ('caller', 'callee')").select(F.col("symbol").alias("seed"), F.col("other_id").alias("id")).distinct()
    return top_per_group(near.join(seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi"), ["seed"], ["id"], per_seed)


def type_expansion(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, type_id): types that a type is tied to by inheritance or calls."""
    types = current_nodes(nodes, "kind").where("kind in ('class', 'interface')").select("id")
    rows = relations(edges, "extends", "implements", "calls", "instantiates")
    return rows.join(types.withColumnRenamed("id", "target"), "target", "left_semi").join(types.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("source").alias("symbol"), F.col("target").alias("type_id"))


def recover_edges(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """(id, n_edges): symbols outside the selection at the other end of edges that cross its border."""
    inside = selected.select("id").distinct()
    pairs = edges.select("source", "target").distinct()
    a = pairs.join(inside.withColumnRenamed("id", "source"), "source", "left_semi").join(inside.withColumnRenamed("id", "target"), "target", "left_anti").select(F.col("target").alias("id"))
    b = pairs.join(inside.withColumnRenamed("id", "target"), "target", "left_semi").join(inside.withColumnRenamed("id", "source"), "source", "left_anti").select(F.col("source").alias("id"))
    return a.union(b).groupBy("id").agg(F.count("*").alias("n_edges"))


def module_steps(edges: DataFrame, nodes: DataFrame, *kinds: str) -> DataFrame:
    where = current_nodes(nodes, "module_id").where("module_id is not null and module_id != ''")
    a = where.select(F.col("id").alias("source"), F.col("module_id").alias("a"))
    b = where.select(F.col("id").alias("target"), F.col("module_id").alias("b"))
    return relations(edges, *kinds).join(b, "target").join(a, "source").where("a != b").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()


# Names of calls whose result comes from a request, the system or a database.
REQUEST_CALLS = "getParameter|getHeader|getAttribute|getCookies|getQueryString|getInputStream|getReader|getBody"
SYSTEM_CALLS = "getProperty|getenv|getEnv"
DB_PREFIX, DB_PART = "^(find|get|query|search|fetch|load|read|select)", "(ById|ByKey|ByName|ByCode|ByType|All|One|List)"


def data_source(call: str):
    """Where a called method takes its value from: http_request, system_property, db_query, field_access or method_call."""
    name = F.col(call)
    return (
        F.when(name.rlike(f"^({REQUEST_CALLS})$"), "http_request")
        .when(name.rlike(f"^({SYSTEM_CALLS})$"), "system_property")
        .when(name.rlike(DB_PREFIX) & name.rlike(DB_PART), "db_query")
        .when(name.rlike("^(get|is)[A-Z]"), "field_access")
        .otherwise("method_call")
    )


def trace_variables(assignments: DataFrame, depth: int = 3) -> DataFrame:
    """(method, variable, origin, hops): assignments (method, variable, value) followed to a literal, a call or the end.

    A value is a literal (quoted or a number), a call ``name(...)``, or another variable of the method.
    """
    scratch = Scratch(assignments.sparkSession)
    rows = scratch.write(assignments.select("method", "variable", F.col("value").alias("origin")).distinct())
    state = rows.withColumn("hops", F.lit(0))
    link = rows.select("method", F.col("variable").alias("origin"), F.col("origin").alias("_next"))
    for _ in range(depth):
        state = scratch.write(state.join(link, ["method", "origin"], "left").select("method", "variable", F.coalesce("_next", "origin").alias("origin"), (F.col("hops") + F.col("_next").isNotNull().cast("int")).alias("hops")))
    return state.distinct()


def entry_kinds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return entry_points(edges, nodes).groupBy("entry").agg(F.count("*").alias("n_symbols"))


