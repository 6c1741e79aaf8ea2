"""Joins between symbols: callers, callees, implementations, dead code, affected tests.

Each operator works on all symbols at once and names its key ``symbol``, so a
question about one symbol is a filter that Catalyst pushes below the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.paths import is_test_path
from loomgraph.operators.graph import CALLABLE_KINDS, DISPATCH_KINDS, annotations, confidence, current_nodes, external_references, relations, unique_edges


def callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, caller_id, name, kind, file_path) of the stored symbols that call it."""
    who = current_nodes(nodes, "name", "kind", "file_path").withColumnRenamed("id", "source")
    return relations(edges, "calls").join(who, "source").select(F.col("target").alias("symbol"), F.col("source").alias("caller_id"), "name", "kind", "file_path")


def callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, callee_id, name, kind, file_path) of the stored symbols that it calls."""
    who = current_nodes(nodes, "name", "kind", "file_path").withColumnRenamed("id", "target")
    return relations(edges, "calls").join(who, "target").select(F.col("source").alias("symbol"), F.col("target").alias("callee_id"), "name", "kind", "file_path")


def imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    who = current_nodes(nodes, "name", "kind").withColumnRenamed("id", "target")
    return relations(edges, "imports").join(who, "target").select(F.col("source").alias("symbol"), F.col("target").alias("imported_id"), "name", "kind")


def file_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, depends_on): files whose symbols are imported by symbols of the file."""
    where = current_nodes(nodes, "file_path")
    hops = relations(edges, "imports").join(where.select(F.col("id").alias("source"), "file_path"), "source")
    ends = where.select(F.col("id").alias("target"), F.col("file_path").alias("depends_on"))
    return hops.join(ends, "target").where("file_path != depends_on").select("file_path", "depends_on").distinct()


def nodes_by_annotation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    who = current_nodes(nodes, "name", "kind").withColumnRenamed("id", "node_id")
    return annotations(edges).join(who, "node_id").select("annotation_name", "node_id", "name", "kind")


def annotations_by_node(edges: DataFrame) -> DataFrame:
    return annotations(edges).groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_set("annotation_name")), ",").alias("names"), F.count("*").alias("n_annotations"))


def external_references_by_symbol(edges: DataFrame, external_symbols: DataFrame) -> DataFrame:
    """(symbol_name, source_location, reference_type, target_service): references found by the symbol's name."""
    names = external_symbols.select(F.col("id").alias("external_symbol_id"), F.col("name").alias("symbol_name"))
    return external_references(edges, external_symbols).join(names, "external_symbol_id").select("symbol_name", "source_location", "reference_type", "target_service")


def external_references_by_location(edges: DataFrame, external_symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_refs): references whose location contains the term. Terms are settings; their number is checked."""
    if terms.limit(1001).count() > 1000:
        raise ValueError("more than 1000 terms; join on exploded path segments instead")
    refs = external_references(edges, external_symbols)
    return refs.join(F.broadcast(terms.select("term").distinct()), F.contains("source_location", "term")).groupBy("term").agg(F.count("*").alias("n_refs"))


def callers_with_external(edges: DataFrame, nodes: DataFrame, external_symbols: DataFrame) -> DataFrame:
    """(symbol, caller_id, provenance): callers of stored symbols and of external ones."""
    internal = callers(edges, nodes).select("symbol", "caller_id").where(~F.col("symbol").startswith("ext://")).withColumn("provenance", F.lit("internal"))
    refs = external_references(edges, external_symbols).where("target_service is not null and source_location is not null")
    outside = refs.select(F.col("external_symbol_id").alias("symbol"), F.col("source_location").alias("caller_id")).distinct().withColumn("provenance", F.lit("external"))
    return internal.unionByName(outside)


def callees_with_external(edges: DataFrame, nodes: DataFrame, external_symbols: DataFrame) -> DataFrame:
    internal = callees(edges, nodes).select("symbol", "callee_id").withColumn("provenance", F.lit("internal"))
    refs = external_references(edges, external_symbols).where("target_service is not null and source_location is not null")
    outside = refs.select(F.col("source_location").alias("symbol"), F.col("external_symbol_id").alias("callee_id")).distinct().withColumn("provenance", F.lit("external"))
    return internal.unionByName(outside)


def dispatch_targets(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """(symbol, other_id, kind, confidence, direction) of inferred relations that touch a symbol."""
    inferred = unique_edges(edges.where(F.col("kind").isin(*DISPATCH_KINDS)), "metadata").select("source", "target", "kind", confidence().alias("confidence")).where(F.col("confidence") >= least)
    out = inferred.select(F.col("source").alias("symbol"), F.col("target").alias("other_id"), "kind", "confidence", F.lit("out").alias("direction"))
    into = inferred.select(F.col("target").alias("symbol"), F.col("source").alias("other_id"), "kind", "confidence", F.lit("in").alias("direction"))
    return out.unionByName(into)


def callers_with_dispatch(edges: DataFrame, nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """(symbol, caller_id, provenance, confidence): static callers, and callers of what the symbol dispatches to."""
    static = callers(edges, nodes).select("symbol", "caller_id", F.lit("static").alias("provenance"), F.lit(1.0).alias("confidence"))
    targets = dispatch_targets(edges, least).where("direction = 'out'").select("symbol", "other_id", "kind", "confidence")
    through = static.select(F.col("symbol").alias("other_id"), "caller_id").join(targets, "other_id")
    dynamic = through.groupBy("symbol", "caller_id", F.col("kind").alias("provenance")).agg(F.max("confidence").alias("confidence"))
    return static.unionByName(dynamic)


def parent_names(nodes: DataFrame) -> DataFrame:
    current = current_nodes(nodes, "name", "parent_id")
    parents = current.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return current.join(parents, "parent_id", "left").select("id", "name", "parent_id", "parent_name")


def _name_keys():
    """Names that an implementation of the interface ``name`` may have."""
    plain = F.col("name")
    stripped = F.expr("substr(name, 2)")
    prefixed = plain.rlike("^I[A-Z]")
    return F.array_distinct(F.array_compact(F.array(plain, F.concat(plain, F.lit("Impl")), F.when(prefixed, stripped), F.when(prefixed, F.concat(stripped, F.lit("Impl"))))))


def implementations_by_name(nodes: DataFrame) -> DataFrame:
    """(interface_id, implementation_id): classes named by convention after an interface.

    The alternatives of the convention are exploded to keys, which makes the
    theta join an equi-join on the last part of the qualified name.
    """
    current = current_nodes(nodes, "name", "kind", "qualified_name")
    wanted = current.where("kind = 'interface'").select(F.col("id").alias("interface_id"), F.explode(_name_keys()).alias("key"))
    last = F.element_at(F.split(F.coalesce("qualified_name", "name"), "\\."), -1)
    classes = current.where("kind in ('class', 'enum')").select(F.col("id").alias("implementation_id"), F.explode(F.array_distinct(F.array("name", last))).alias("key"))
    return wanted.join(classes, "key").select("interface_id", "implementation_id").distinct()


def implementations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Declared implementations together with those found by name."""
    declared = edges.where("kind in ('implements', 'conditional_impl')").select(F.col("target").alias("interface_id"), F.col("source").alias("implementation_id"))
    known = current_nodes(nodes, "kind").select(F.col("id").alias("implementation_id"))
    return declared.join(known, "implementation_id", "left_semi").select("interface_id", "implementation_id").union(implementations_by_name(nodes)).distinct()


def concrete_classes(nodes: DataFrame) -> DataFrame:
    """(interface_id, class_id): classes of the same module named by convention after an interface."""
    modules = current_nodes(nodes, "module_id").where("module_id != ''").select("id", "module_id")
    pairs = implementations_by_name(nodes).withColumnRenamed("implementation_id", "class_id")
    a = modules.select(F.col("id").alias("interface_id"), F.col("module_id").alias("m"))
    b = modules.select(F.col("id").alias("class_id"), F.col("module_id").alias("m"))
    return pairs.join(a, "interface_id").join(b, ["class_id", "m"]).select("interface_id", "class_id")


def override_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(method_id, overrides_id): methods of an implementation paired with the first method of that name above it."""
    above = relations(edges, "implements", "extends")
    members = current_nodes(nodes, "name", "kind", "parent_id").where(F.col("kind").isin(*CALLABLE_KINDS) & F.col("parent_id").isNotNull())
    mine = members.select(F.col("id").alias("method_id"), "name", F.col("parent_id").alias("source"))
    theirs = members.select(F.col("id").alias("overrides_id"), "name", F.col("parent_id").alias("target"))
    pairs = mine.join(above, "source").join(theirs, ["target", "name"])
    return pairs.groupBy("method_id").agg(F.min("overrides_id").alias("overrides_id"))


def interface_callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(method_id, caller_id): callers that reach a method through the method it overrides."""
    pairs = relations(edges, "overrides").select(F.col("source").alias("method_id"), F.col("target").alias("overrides_id"))
    return pairs.union(override_pairs(edges, nodes)).distinct().join(callers(edges, nodes).select(F.col("symbol").alias("overrides_id"), "caller_id"), "overrides_id").select("method_id", "caller_id").distinct()


# Calls after which a function that was passed in is called, and verbs of HTTP clients.
CHAIN_NAMES = ("then", "catch", "finally", "subscribe", "map", "forEach", "filter", "reduce")
REST_VERBS = ("getForObject", "postForObject", "exchange", "get", "post", "put", "delete", "patch")


def callback_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, target_id): variables and parameters that callees of the symbol call, and calls of promise chains."""
    calls = relations(edges, "calls")
    who = current_nodes(nodes, "name", "kind").select(F.col("id").alias("target"), "name", "kind")
    two = calls.select(F.col("source").alias("symbol"), F.col("target").alias("source")).join(calls, "source").join(who, "target").where("kind in ('variable', 'parameter')")
    chained = calls.join(who, "target").where(F.col("name").isin(*CHAIN_NAMES)).withColumnRenamed("source", "symbol")
    return two.select("symbol", F.col("target").alias("target_id")).union(chained.select("symbol", "target")).distinct()


def cross_service_callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, target_module, n_calls): calls that end in a symbol of another module."""
    where = current_nodes(nodes, "module_id").where("module_id is not null and module_id != ''")
    a = where.select(F.col("id").alias("source"), F.col("module_id").alias("from_module"))
    b = where.select(F.col("id").alias("target"), F.col("module_id").alias("target_module"))
    return relations(edges, "calls").join(b, "target").join(a, "source").where("from_module != target_module").groupBy(F.col("source").alias("symbol"), "target_module").agg(F.count("*").alias("n_calls"))


def cross_module_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, other_id, relation): callers and callees in other modules, and types of the same name there."""
    where = current_nodes(nodes, "module_id", "name", "kind").where("module_id is not null and module_id != ''")
    a = where.select(F.col("id").alias("source"), F.col("module_id").alias("ma"))
    b = where.select(F.col("id").alias("target"), F.col("module_id").alias("mb"))
    calls = relations(edges, "calls").join(b, "target").join(a, "source").where("ma != mb")
    types = where.where("kind in ('class', 'interface')")
    twins = types.select(F.col("id").alias("symbol"), "name", F.col("module_id").alias("ma")).join(types.select(F.col("id").alias("other_id"), "name", F.col("module_id").alias("mb")), "name").where("ma != mb")
    return (
        calls.select(F.col("source").alias("symbol"), F.col("target").alias("other_id"), F.lit("callee").alias("relation"))
        .unionByName(calls.select(F.col("target").alias("symbol"), F.col("source").alias("other_id"), F.lit("caller").alias("relation")))
        .unionByName(twins.select("symbol", "other_id", F.lit("same_name").alias("relation")))
    )


def dead_code(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Symbols that are no types and that nothing calls."""
    called = edges.where("kind = 'calls'").select(F.col("target").alias("id"))
    rows = current_nodes(nodes, "kind", "name", "file_path").where("kind not in ('class', 'interface', 'enum')")
    return rows.join(called, "id", "left_anti").select("id", "kind", "name", "file_path")


def dead_imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, imported_id, name): imports of symbols that nothing else in the file refers to."""
    where = current_nodes(nodes, "file_path", "name")
    a = where.select(F.col("id").alias("source"), "file_path")
    b = where.select(F.col("id").alias("target"), "name")
    brought = relations(edges, "imports").join(a, "source").join(b, "target").select("file_path", F.col("target").alias("imported_id"), "name").distinct()
    used = edges.where("kind in ('calls', 'references', 'instantiates', 'extends', 'implements', 'type_of', 'returns')").select("source", "target").distinct()
    used_names = used.join(a, "source").join(b, "target").select("file_path", "name").distinct()
    return brought.join(used_names, ["file_path", "name"], "left_anti")


def affected_tests(edges: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(test_file, n_matched, confidence) for changed files (path): matched names over names in the changed files."""
    current = current_nodes(nodes, "name", "file_path", "kind").where("name is not null and name != ''")
    paths = changed.select(F.col("path").alias("file_path")).distinct()
    names = current.where("kind != 'file'").join(paths, "file_path", "left_semi").where(~is_test_path("file_path")).select("name").distinct()
    total = names.count()
    tests = current.where(is_test_path("file_path"))
    own = tests.where("kind != 'file'").select("file_path", "name")
    called = relations(edges, "calls").join(tests.select(F.col("id").alias("source"), "file_path"), "source").join(current.select(F.col("id").alias("target"), "name"), "target").select("file_path", "name")
    matched = own.union(called).distinct().join(names, "name", "left_semi").groupBy(F.col("file_path").alias("test_file")).agg(F.count("*").alias("n_matched"))
    return matched.select("test_file", "n_matched", F.round(F.least(F.col("n_matched") / F.greatest(F.lit(total), F.lit(1)), F.lit(1.0)), 6).alias("confidence"))


def bean_injections(edges: DataFrame, nodes: DataFrame, per_field: int = 5) -> DataFrame:
    """(member_id, bean_id): classes that a member marked for injection may get, five at most, by id."""
    marked = annotations(edges).where("annotation_name in ('Autowired', 'Inject', 'Resource')").select(F.col("node_id").alias("member_id"))
    current = current_nodes(nodes, "name", "kind", "file_path")
    members = current.withColumnRenamed("id", "member_id").join(marked, "member_id", "left_semi").select("member_id", "name")
    capital = F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substr(name, 2)"))
    keys = members.select("member_id", F.explode(F.array_distinct(F.array(capital, F.concat(capital, F.lit("Impl"))))).alias("name"))
    pairs = keys.join(current.where("kind = 'class'").select(F.col("id").alias("bean_id"), "name"), "name").select("member_id", "bean_id").distinct()
    rank = F.row_number().over(Window.partitionBy("member_id").orderBy("bean_id"))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= per_field).select("member_id", "bean_id")


def shared_config(edges: DataFrame) -> DataFrame:
    """(key, n_users, users_in_common): keys of configuration, caches, transactions and topics by their users."""
    rows = edges.where(F.col("target").rlike("^(config|cache|tx|topic):")).select("source", "target").distinct()
    return rows.groupBy(F.col("target").alias("key")).agg(F.count("*").alias("n_users"))


def config_by_prefix(edges: DataFrame) -> DataFrame:
    """(prefix, key, n_users): the prefix join of bindings, as an equi-join on every leading part of the key."""
    keys = edges.where(F.col("target").startswith("config:")).select("source", F.expr("substr(target, 8)").alias("key")).distinct()
    grown = keys.select("key", "source", F.explode(F.expr("transform(sequence(1, size(split(key, '[.]'))), i -> array_join(slice(split(key, '[.]'), 1, i), '.'))")).alias("prefix"))
    return grown.groupBy("prefix", "key").agg(F.count("*").alias("n_users"))


def services_by_location(locations: DataFrame, modules: DataFrame) -> DataFrame:
    """(location, service): the module whose root the location lies under, else one named in its path."""
    roots = modules.select(F.col("id").alias("service"), "root_path").where("root_path is not null")
    prefix = F.expr("array_join(slice(split(replace(location, '\\\\', '/'), '/'), 1, 2), '/')")
    rows = locations.select("location").distinct().withColumn("root_path", prefix)
    by_root = rows.join(roots, "root_path", "left").groupBy("location").agg(F.min("service").alias("by_root"))
    named = rows.select("location", F.posexplode(F.split(F.replace("location", F.lit("\\"), F.lit("/")), "[/:]")).alias("at", "segment")).join(modules.select(F.col("id").alias("segment")), "segment", "left_semi")
    by_name = named.groupBy("location").agg(F.min_by("segment", "at").alias("by_name"))
    return by_root.join(by_name, "location", "left").select("location", F.coalesce("by_root", "by_name").alias("service"))


def provider_matches(edges: DataFrame, external_symbols: DataFrame) -> DataFrame:
    """(consumer_ref, provider_id, how): references matched to providers, exactly or by the best scored name.

    A reference without a provider of that id is matched within the service it
    names: five points for each word of the provider's name in the reference,
    three for each part of its id; fifteen are needed.
    """
    wanted = edges.where(F.col("target").startswith("ext://")).select(F.col("target").alias("consumer_ref")).distinct()
    provided = external_symbols.select(F.col("id").alias("provider_id"), "name", "providing_service").where("id is not null")
    exact = wanted.join(provided.select(F.col("provider_id").alias("consumer_ref")), "consumer_ref", "left_semi").select("consumer_ref", F.col("consumer_ref").alias("provider_id"), F.lit("exact").alias("how"))
    rest = wanted.join(provided.select(F.col("provider_id").alias("consumer_ref")), "consumer_ref", "left_anti").withColumn("providing_service", F.regexp_extract("consumer_ref", "^ext://([^/]+)/", 1))
    words = F.filter(F.split(F.lower(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    parts = F.filter(F.split(F.lower("provider_id"), "[-._/:]+"), lambda w: F.length(w) >= 3)
    low = F.lower("consumer_ref")
    score = F.size(F.filter(words, lambda w: F.contains(low, w))) * 5 + F.size(F.filter(parts, lambda w: F.contains(low, w))) * 3
    scored = rest.join(provided, "providing_service").withColumn("score", score).where("score >= 15")
    best = scored.groupBy("consumer_ref").agg(F.max(F.struct("score", F.expr("struct(-ascii(provider_id), provider_id)").alias("tie"))).alias("b"))
    return exact.unionByName(best.select("consumer_ref", F.col("b.tie.provider_id").alias("provider_id"), F.lit("scored").alias("how")))


def dependency_projects(dependencies: DataFrame, projects: DataFrame) -> DataFrame:
    """(group_id, artifact_id, project): dependencies whose artifact, or last part of the group, names a project."""
    named = projects.select(F.lower("name").alias("key"), F.col("name").alias("project"))
    by_artifact = named.select(F.col("key").alias("ka"), F.col("project").alias("pa"))
    by_group = named.select(F.col("key").alias("kg"), F.col("project").alias("pg"))
    rows = dependencies.withColumn("ka", F.lower("artifact_id")).withColumn("kg", F.lower(F.element_at(F.split("group_id", "\\."), -1)))
    return rows.join(by_artifact, "ka", "left").join(by_group, "kg", "left").select("group_id", "artifact_id", F.coalesce("pa", "pg").alias("project")).where("project is not null")


def transaction_propagation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(caller_id, callee_id, key): calls from a symbol in one transaction to a symbol in another."""
    boundaries = edges.where(F.col("target").startswith("tx:")).select(F.col("source").alias("id"), F.col("target").alias("key")).distinct()
    calls = relations(edges, "calls").join(boundaries.select(F.col("id").alias("target"), F.col("key").alias("inner_key")), "target")
    return calls.join(boundaries.select(F.col("id").alias("source"), F.col("key").alias("outer_key")), "source").where("inner_key != outer_key").select(F.col("source").alias("caller_id"), F.col("target").alias("callee_id"), "outer_key", "inner_key").distinct()


def cache_related(edges: DataFrame) -> DataFrame:
    """(cache, n_nodes, n_pairs): symbols that share a cache; pairs are counted, not listed."""
    users = edges.where(F.col("target").startswith("cache:")).select(F.col("target").alias("cache"), "source").distinct()
    return users.groupBy("cache").agg(F.count("*").alias("n_nodes"), F.expr("count(*) * (count(*) - 1) div 2").alias("n_pairs"))


def match_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Best route of each call: calls (call_id, method, url), routes (route_id, verb, path).

    Paths must have as many segments, and each segment must fit; 60 points, and for each segment 10 if
    equal, 5 if a variable or equal but for case; the same path has 100; 10
    more for the verb. The first best route wins.
    """
    def cleaned(column: str):
        bare = F.regexp_replace(F.regexp_replace(F.col(column), "^[a-z]+://[^/]+", ""), "\\?.*$", "")
        return F.regexp_replace(F.regexp_replace(bare, "/+$", ""), "^/*", "/")

    a = calls.withColumn("_u", cleaned("url")).withColumn("_us", F.split("_u", "/")).withColumn("_n", F.size("_us"))
    b = routes.withColumn("_p", cleaned("path")).withColumn("_ps", F.split("_p", "/")).withColumn("_n", F.size("_ps"))
    # A route is known by its shape: its length, and its segments in lower case with '*' for variables. A call asks
    # for every such shape that occurs with its length and fits its segments, so routes that can't match never meet it.
    variable = "^(\\{.*\\}|:.+)$"
    b = b.withColumn("_shape", F.transform("_ps", lambda p: F.when(p.rlike(variable), "*").otherwise(F.lower(p))))
    masks = b.select("_n", F.transform("_shape", lambda p: p == "*").alias("_mask")).distinct()
    asked = a.join(masks, "_n").withColumn("_shape", F.zip_with("_us", "_mask", lambda u, m: F.when(m, "*").otherwise(F.lower(u))))
    pairs = asked.drop("_n", "_mask").join(b.drop("_n"), "_shape").drop("_shape")
    points = F.zip_with("_us", "_ps", lambda u, p: F.when(u == p, 10).when(p.rlike("^(\\{.*\\}|:.+)$"), 5).when(F.lower(u) == F.lower(p), 5).otherwise(-1000))
    score = F.when(F.col("_u") == F.col("_p"), 100).otherwise(F.lit(60) + F.aggregate(points, F.lit(0), lambda s, x: s + x) - 10)
    verb = F.when((F.upper("verb") == "ANY") | (F.upper("verb") == F.upper("method")), 10).otherwise(0)
    scored = pairs.withColumn("score", score + verb).where(F.col("score") >= 60)
    first = F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("score"), "route_id"))
    return scored.withColumn("_r", first).where("_r = 1").select("call_id", "route_id", "score")


def contained_routes(routes: DataFrame, others: DataFrame) -> DataFrame:
    """(path, other_path) where one contains the other, by their segments instead of a nested loop.

    Containment of whole segments: every run of segments of the longer path is a
    key, so the substring test becomes an equi-join.
    """
    runs = "flatten(transform(sequence(1, size(s)), i -> transform(sequence(i, size(s)), j -> array_join(slice(s, i, j - i + 1), '/'))))"
    def keyed(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        parts = df.select(F.col("path").alias(name)).distinct().withColumn("s", F.filter(F.split(name, "/"), lambda x: x != "")).where("size(s) > 0")
        return parts.select(name, F.array_join("s", "/").alias("key")), parts.select(name, F.explode(F.array_distinct(F.expr(runs))).alias("key"))

    whole_a, runs_a = keyed(routes, "path")
    whole_b, runs_b = keyed(others, "other_path")
    return whole_a.join(runs_b, "key").select("path", "other_path").union(runs_a.join(whole_b, "key").select("path", "other_path")).distinct()


def named_by(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, node_id): symbols whose name contains a container, service or topic name, matched by words."""
    word = F.explode(F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: w != "")))
    symbols = current_nodes(nodes, "name").select(F.col("id").alias("node_id"), word.alias("word"))
    wanted = names.select(F.col("name").alias("wanted")).distinct().select("wanted", F.split(F.lower("wanted"), "[^a-z0-9]+").alias("ws")).withColumn("need", F.size("ws")).select("wanted", "need", F.explode("ws").alias("word"))
    hits = symbols.join(wanted, "word").groupBy("wanted", "node_id", "need").agg(F.countDistinct("word").alias("n"))
    return hits.where("n = need").select(F.col("wanted").alias("name"), "node_id")


def pointcut_pattern(expression: str) -> tuple[str, str]:
    """(class regex, method regex) of an execution or within pointcut.

    '..' stands for any packages, '*' for one name part, '?' for one character.
    """
    import re

    def regex(pattern: str) -> str:
        out = ""
        i = 0
        while i < len(pattern):
            if pattern.startswith("..", i):
                out, i = out + r"(?:\.[^.]+)*\.?", i + 2
            else:
                c = pattern[i]
                out, i = out + {"*": "[^.]*", ".": r"\.", "?": "."}.get(c, re.escape(c)), i + 1
        return "^" + out + "$"

    found = re.search(r"execution\(([^()]*)\(", expression)
    if found:
        target = found.group(1).split()[-1]
        owner, _, method = target.rpartition(".")
        if owner.endswith("."):
            owner += "."
        return regex(owner) if owner else ".*", regex(method or "*")
    found = re.search(r"within\(([^)]*)\)", expression)
    return (regex(found.group(1).strip()), ".*") if found else ("(?!)", "(?!)")


def pointcut_matches(nodes: DataFrame, pointcuts: list[str]) -> DataFrame:
    """(pointcut, method_id): methods that aspects with these expressions advise."""
    methods = current_nodes(nodes, "name", "kind", "qualified_name").where(F.col("kind").isin(*CALLABLE_KINDS))
    owner = F.regexp_replace(F.regexp_replace("qualified_name", "\\(.*$", ""), "\\.[^.]*$", "")
    rows = None
    for expression in pointcuts:
        class_rx, method_rx = pointcut_pattern(expression)
        part = methods.where(owner.rlike(class_rx) & F.col("name").rlike(method_rx)).select(F.lit(expression).alias("pointcut"), F.col("id").alias("method_id"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def service_locations(edges: DataFrame, modules: DataFrame) -> DataFrame:
    return services_by_location(edges.select(F.col("source").alias("location")).where("source is not null"), modules)


