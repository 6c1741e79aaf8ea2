"""Counts and groupings over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import CALLABLE_KINDS, annotations, current_nodes, external_references, relations
from loomgraph.session import Scratch


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, n_rows) of each table."""
    rows = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def kind_breakdown(nodes: DataFrame) -> DataFrame:
    return current_nodes(nodes, "kind", "language").groupBy("kind").agg(F.count("*").alias("n_nodes"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))


def module_stats(modules: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(module_id, n_files, n_nodes); modules without either count zero."""
    n_files = files.groupBy("module_id").agg(F.countDistinct("path").alias("n_files"))
    n_nodes = current_nodes(nodes, "module_id").groupBy("module_id").agg(F.count("*").alias("n_nodes"))
    rows = modules.select(F.col("id").alias("module_id"))
    joined = rows.join(n_files, "module_id", "left").join(n_nodes, "module_id", "left")
    return joined.select("module_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


def service_counts(edges: DataFrame, external_symbols: DataFrame) -> DataFrame:
    """(service, n_provided, n_referenced), services of either side."""
    provided = external_symbols.groupBy(F.col("providing_service").alias("service")).agg(F.count("*").alias("n_provided"))
    used = external_references(edges, external_symbols).groupBy(F.col("target_service").alias("service")).agg(F.count("*").alias("n_referenced"))
    both = provided.join(used.where("service is not null"), "service", "full")
    return both.select("service", F.coalesce("n_provided", F.lit(0)).alias("n_provided"), F.coalesce("n_referenced", F.lit(0)).alias("n_referenced"))


def hot_spots(edges: DataFrame, limit: int = 20) -> DataFrame:
    """The most called targets: different callers, ties by id."""
    counted = relations(edges, "calls").groupBy(F.col("target").alias("symbol")).agg(F.count("*").alias("n_callers"))
    return counted.orderBy(F.desc("n_callers"), "symbol").limit(limit)


def topic_usage(edges: DataFrame, nodes: DataFrame, prefix: str) -> DataFrame:
    """(key, n_uses, modules) of things outside the graph with this prefix: caches, messages, transactions."""
    uses = edges.where(F.col("target").startswith(prefix)).select("source", "target").distinct()
    where = current_nodes(nodes, "module_id").withColumnRenamed("id", "source")
    return uses.join(where, "source", "left").groupBy(F.expr(f"substr(target, {len(prefix) + 1})").alias("key")).agg(F.count("*").alias("n_uses"), F.array_join(F.sort_array(F.collect_set("module_id")), ",").alias("modules"))


def service_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_module, to_module, n_calls, kinds) of relations between modules."""
    where = current_nodes(nodes, "module_id").where("module_id is not null and module_id != ''")
    a = where.select(F.col("id").alias("source"), F.col("module_id").alias("from_module"))
    b = where.select(F.col("id").alias("target"), F.col("module_id").alias("to_module"))
    rows = edges.where("kind in ('calls', 'imports', 'references', 'instantiates')").select("source", "target", "kind").distinct()
    joined = rows.join(b, "target").join(a, "source").where("from_module != to_module")
    return joined.groupBy("from_module", "to_module").agg(F.count("*").alias("n_relations"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def provider_graph(edges: DataFrame, nodes: DataFrame, external_symbols: DataFrame) -> DataFrame:
    """(consumer, provider, n_refs, types): modules and the services whose symbols they use."""
    where = current_nodes(nodes, "module_id").where("module_id != ''").select(F.col("id").alias("source_location"), F.col("module_id").alias("consumer"))
    refs = external_references(edges, external_symbols).where("target_service is not null")
    return refs.join(where, "source_location").groupBy("consumer", F.col("target_service").alias("provider")).agg(F.count("*").alias("n_refs"), F.array_join(F.sort_array(F.collect_set("reference_type")), ",").alias("types"))


def architecture(modules: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module_id, n_entry_points, depends_on): modules with their entry points and what they depend on."""
    points = annotations(edges).where("annotation_name = 'Component'").select(F.col("node_id").alias("id")).distinct()
    entries = current_nodes(nodes, "module_id").join(points, "id", "left_semi").groupBy("module_id").agg(F.count("*").alias("n_entry_points"))
    depends = service_graph(edges, nodes).groupBy(F.col("from_module").alias("module_id")).agg(F.array_join(F.sort_array(F.collect_set("to_module")), ",").alias("depends_on"))
    rows = modules.select(F.col("id").alias("module_id")).join(entries, "module_id", "left").join(depends, "module_id", "left")
    return rows.select("module_id", F.coalesce("n_entry_points", F.lit(0)).alias("n_entry_points"), F.coalesce("depends_on", F.lit("")).alias("depends_on"))


def symbols_by_file(nodes: DataFrame) -> DataFrame:
    rows = current_nodes(nodes, "file_path", "name", "kind")
    return rows.groupBy("file_path").agg(F.count("*").alias("n_symbols"), F.count_if(F.col("kind").isin(*CALLABLE_KINDS)).alias("n_callables"), F.min("name").alias("first_name"))


def dominant_file(nodes: DataFrame) -> DataFrame:
    """(module_id, file_path, n_symbols): the file with most symbols of each module, ties by path."""
    counted = current_nodes(nodes, "file_path", "module_id").where("file_path is not null").groupBy("module_id", "file_path").agg(F.count("*").alias("n_symbols"))
    best = F.min(F.struct((-F.col("n_symbols")).alias("n"), F.col("file_path").alias("f"))).alias("b")
    return counted.groupBy("module_id").agg(best).select("module_id", F.col("b.f").alias("file_path"), (-F.col("b.n")).alias("n_symbols"))


def conflicting_names(nodes: DataFrame) -> DataFrame:
    """(qualified_name, n_kinds, kinds): names that stand for more than one kind (a HAVING over distinct values)."""
    rows = current_nodes(nodes, "qualified_name", "kind").groupBy("qualified_name").agg(F.collect_set("kind").alias("k"))
    return rows.where(F.size("k") > 1).select("qualified_name", F.size("k").alias("n_kinds"), F.array_join(F.sort_array("k"), ",").alias("kinds"))


def scope_conflicts(dependencies: DataFrame) -> DataFrame:
    """(group_id, artifact_id, scopes, modules): dependencies that modules declare with different scopes."""
    rows = dependencies.groupBy("group_id", "artifact_id").agg(F.collect_set("scope").alias("s"), F.collect_set("module").alias("m"))
    return rows.where(F.size("s") > 1).select("group_id", "artifact_id", F.array_join(F.sort_array("s"), ",").alias("scopes"), F.array_join(F.sort_array("m"), ",").alias("modules"))


def first_binding(edges: DataFrame) -> DataFrame:
    """(source, target): the first configuration key of each symbol, by seq."""
    rows = edges.where(F.col("target").startswith("config:") & F.col("source").isNotNull())
    return rows.groupBy("source").agg(F.min_by("target", "seq").alias("target"))


def average_confidence(edges: DataFrame) -> DataFrame:
    """(kind, n_edges, avg_confidence): relations without a confidence count as certain."""
    value = F.coalesce(F.get_json_object("metadata", "$.confidence").cast("double"), F.lit(1.0))
    return edges.groupBy("kind").agg(F.count("*").alias("n_edges"), F.round(F.avg(value), 6).alias("avg_confidence"))


# Decision points that are counted, one pattern each.
BRANCHES = (r"\bif\s*\(", r"\belse\s+if\b", r"\bcase\s+", r"\b(?:for|while)\s*\(", r"\bcatch\s*\(", r"\?\s+", r"\b&&\b|\b\|\|\b", r"\bdefault\s*:")


def complexity(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, complexity): 1 + decision points in the symbol's lines of the current content of its file."""
    content = files.where("content is not null").groupBy("path").agg(F.max(F.struct("indexed_at", "content_hash", "content")).alias("f")).select(F.col("path").alias("file_path"), F.split(F.col("f.content"), "\n").alias("lines"))
    rows = current_nodes(nodes, "name", "kind", "file_path", "start_line", "end_line").where(F.col("kind").isin(*CALLABLE_KINDS) & (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")))
    body = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    joined = rows.join(content, "file_path").where(F.size("lines") >= F.col("start_line")).select("id", "name", body.alias("body"))
    total = F.lit(1)
    for pattern in BRANCHES:
        total = total + F.regexp_count("body", F.lit(pattern))
    return joined.select("id", "name", total.cast("int").alias("complexity"))


def similar_code(nodes: DataFrame, queries: DataFrame, least: float = 0.5, top: int = 10) -> DataFrame:
    """(id, other_id, n_equal, similarity): for each query symbol (id) the ten classes of symbols most like it.

    Similarity is the Jaccard index of the tokens of name, signature and
    docstring, between symbols of one kind. Symbols with equal tokens form a
    class, named by its smallest id; a query's own class is not listed. Exact:
    tokens are ordered from rare to common, and two sets this similar have their
    first common token so early in both that enough others may follow (prefix and
    position filter by both sizes), so hot tokens are no join keys. Pairs whose
    bitmaps differ in too many places are dropped before sets are compared, and
    a pair counts at its first common token only.
    """
    from pyspark.sql import Window

    scratch = Scratch(nodes.sparkSession)
    text = F.lower(F.concat_ws(" ", "name", "signature", "docstring"))
    split = F.array_distinct(F.filter(F.split(text, r"[\s,();{}\[\]<>]+"), lambda w: F.length(w) > 1))
    wanted = queries.select("id").distinct().withColumn("asked", F.lit(True))
    rows = current_nodes(nodes, "kind", "name", "signature", "docstring").where(F.col("kind").isin(*CALLABLE_KINDS)).join(wanted, "id", "left")
    rows = scratch.write(rows.select("id", "kind", F.sort_array(split).alias("tokens"), F.coalesce("asked", F.lit(False)).alias("asked")).where("size(tokens) > 0"))
    # Numbers of classes are in the order of their ids, so they decide ties as those do.
    classes = scratch.write(rows.groupBy("kind", "tokens").agg(F.min("id").alias("rep"), F.count("*").alias("n_equal"), F.max("asked").alias("asked")).orderBy("rep").withColumn("c", F.monotonically_increasing_id()))
    exploded = classes.select("c", "kind", "asked", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    # A token of one class only is common to no pair. It ranks before all others and only counts in the size.
    frequency = scratch.write(exploded.groupBy("kind", "token").agg(F.count("*").alias("df")).where("df > 1").withColumn("t", F.monotonically_increasing_id()))
    ranked = exploded.join(frequency, ["kind", "token"]).groupBy("c", "n", "asked").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("a")).select("c", "n", "asked", F.col("a.t").alias("set"))
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))
    ranked = scratch.write(ranked.select("*", F.aggregate("set", F.lit(0).cast("long"), lambda s, t: s.bitwiseOR(bit(t))).alias("bits")))
    scratch.drop(frequency)
    asked = scratch.write(rows.where("asked").select("id", "kind", "tokens").join(classes.where("asked").select("kind", "tokens", "c"), ["kind", "tokens"]).select("id", "c"))
    scratch.drop(rows)
    # Rounding may only add pairs: the similarity itself is tested last.
    slack = 1e-9
    begins = ranked.select("*", F.posexplode("set").alias("i", "t")).withColumn("left", F.size("set") - F.col("i"))
    keys = begins.where(F.col("left") >= least * F.col("n") - slack).drop("i")
    mine = keys.where("asked").select("t", *[F.col(x).alias("_" + x) for x in ("c", "n", "set", "bits", "left")])
    sizes = F.sequence(F.ceil(least * F.col("_n") - slack).cast("int"), F.floor((1 + least) / least * F.col("_left") - F.col("_n") + slack).cast("int"))
    mine = mine.where(F.col("_left") * (1 + least) >= least * (F.col("_n") + F.ceil(least * F.col("_n") - slack)) - slack).select("*", F.explode(sizes).alias("n")).where(F.col("n") * least <= F.col("_n") + slack)
    both = F.col("n") + F.col("_n")
    apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("_bits"))) + both - F.size("set") - F.size("_set")
    near = (F.col("c") != F.col("_c")) & ((1 + least) * F.col("left") >= least * both - slack) & ((1 + least) * apart <= (1 - least) * both + slack)
    common = F.array_intersect("_set", "set")
    shared = F.size(common)
    similarity = shared / (both - shared)
    pairs = mine.join(keys.drop("asked"), ["t", "n"]).where(near).where((similarity >= least) & (F.element_at(common, 1) == F.col("t"))).select("_c", "c", similarity.alias("_s"))
    best = F.row_number().over(Window.partitionBy("_c").orderBy(F.desc("_s"), "c"))
    kept = pairs.withColumn("_r", best).where(F.col("_r") <= top).select("_c", "c", F.round("_s", 2).alias("similarity"))
    named = kept.join(classes.select("c", F.col("rep").alias("other_id"), "n_equal"), "c").select("_c", "other_id", "n_equal", "similarity")
    return asked.withColumnRenamed("c", "_c").join(named, "_c").select("id", "other_id", "n_equal", "similarity")


def condition_activity(edges: DataFrame) -> DataFrame:
    """(source, n_conditions, all_met): a symbol is active if every configuration key it needs is one that others set."""
    needed = edges.where(F.col("target").startswith("config:")).select("source", "target", "kind").distinct()
    met = needed.where("kind = 'overrides'").select(F.col("target")).distinct().withColumn("met", F.lit(True))
    joined = needed.where("kind = 'references'").join(met, "target", "left")
    return joined.groupBy("source").agg(F.count("*").alias("n_conditions"), F.coalesce(F.bool_and(F.coalesce("met", F.lit(False))), F.lit(True)).alias("all_met"))


def provenance_histogram(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """(kind, n_edges, n_filtered): inferred relations by kind, and how many are less certain than asked for."""
    value = F.coalesce(F.get_json_object("metadata", "$.confidence").cast("double"), F.lit(1.0))
    rows = edges.where("kind in ('dispatch_call', 'proxy_wraps', 'aop_advises')").groupBy("source", "target", "kind").agg(F.min_by("metadata", "seq").alias("metadata"))
    return rows.groupBy("kind").agg(F.count("*").alias("n_edges"), F.count_if(value < least).alias("n_filtered"))
