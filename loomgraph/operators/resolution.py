"""Names in relations resolved to symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import CALLABLE_KINDS, annotations, current_nodes
from loomgraph.operators.references import CHUNK_WORDS, MAX_FILTER_WORDS, bloom_filter, probe
from loomgraph.session import Scratch

ACCEPTED = 0.5
# Bits a key in the filter of pieces: names have some hundred pieces that no reference seeks, so false hits must be few.
BITS_PER_PIECE = 24
# Endings that are tried for an import path, in order.
IMPORT_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".vue", ".java", ".kt", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.vue", "/__init__.py")


def unresolved(edges: DataFrame, nodes: DataFrame, external_symbols: DataFrame) -> DataFrame:
    """(source, target, kind): relations whose target is no stored symbol, neither here nor outside."""
    known = nodes.select("id").where("id is not null").distinct().union(external_symbols.select("id")).withColumnRenamed("id", "target")
    rows = edges.select("source", "target", "kind").where("target is not null and not target rlike '^(tx|cache|config|topic):'").distinct()
    return rows.join(known, "target", "left_anti").select("source", "target", "kind")


def _called_name(target: str) -> Column:
    """The name in a reference: the last part but a line number."""
    return F.regexp_extract(target, r"([^:./]+)(?::\d+)?$", 1)


def resolve_by_name(edges: DataFrame, nodes: DataFrame, external_symbols: DataFrame) -> DataFrame:
    """(source, target, resolved_id, how): unresolved calls, resolved by name.

    Preferred is a symbol of the file that the reference names, then one of the
    caller's file, then of the caller's module, then the smallest id.
    """
    open_calls = unresolved(edges, nodes, external_symbols).where("kind = 'calls'").withColumn("name", _called_name("target")).withColumn("file", F.nullif(F.regexp_extract("target", r"^(.+?):[^:]+(?::\d+)?$", 1), F.lit("")))
    current = current_nodes(nodes, "name", "kind", "file_path", "module_id")
    from_where = current.select(F.col("id").alias("source"), F.col("file_path").alias("from_file"), F.col("module_id").alias("from_module"))
    candidates = current.where(F.col("kind").isin(*CALLABLE_KINDS)).select(F.col("id").alias("resolved_id"), "name", "file_path", "module_id")
    # One candidate per name and file, module or all is enough: a hot name isn't paired with all its symbols.
    per_file = candidates.groupBy("name", F.col("file_path").alias("f")).agg(F.min("resolved_id").alias("r"))
    per_module = candidates.groupBy("name", F.col("module_id").alias("m")).agg(F.min("resolved_id").alias("r"))
    anywhere = candidates.groupBy("name").agg(F.min("resolved_id").alias("r_any"))
    rows = open_calls.join(from_where, "source", "left")
    rows = rows.join(per_file.select("name", F.col("f").alias("file"), F.col("r").alias("r_file")), ["name", "file"], "left")
    rows = rows.join(per_file.select("name", F.col("f").alias("from_file"), F.col("r").alias("r_own")), ["name", "from_file"], "left")
    rows = rows.join(per_module.select("name", F.col("m").alias("from_module"), F.col("r").alias("r_module")), ["name", "from_module"], "left")
    rows = rows.join(anywhere, "name", "left")
    how = F.when(F.col("r_file").isNotNull(), "named_file").when(F.col("r_own").isNotNull(), "same_file").when(F.col("r_module").isNotNull(), "same_module").when(F.col("r_any").isNotNull(), "name")
    return rows.select("source", "target", F.coalesce("r_file", "r_own", "r_module", "r_any").alias("resolved_id"), how.alias("how")).where("how is not null")


def promoted_kind(kind: str, target_kind: str) -> Column:
    """calls of a type instantiate it, instantiation of a function calls it, and an interface is implemented."""
    k, t = F.col(kind), F.col(target_kind)
    return (
        F.when((k == "calls") & t.isin("class", "enum", "component"), "instantiates")
        .when((k == "instantiates") & t.isin(*CALLABLE_KINDS), "calls")
        .when((k == "extends") & (t == "interface"), "implements")
        .otherwise(k)
    )


def promoted_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, promoted, n_edges): how kinds change when the kind of the target is known."""
    rows = edges.select("source", "target", "kind").distinct()
    kinds = current_nodes(nodes, "kind").select(F.col("id").alias("target"), F.col("kind").alias("target_kind"))
    return rows.join(kinds, "target").select("kind", promoted_kind("kind", "target_kind").alias("promoted")).groupBy("kind", "promoted").agg(F.count("*").alias("n_edges"))


def match_confidence(ref: str, name: str, qualified: str) -> Column:
    """How well a symbol answers a reference: 0.9 both names, 0.7 the name, 0.6 the end of the qualified name, at least 0.5 if contained, else 0.3."""
    r, n, q = F.col(ref), F.col(name), F.col(qualified)
    base = F.when((n == r) & (q == r), 0.9).when(n == r, 0.7).when(q.endswith(F.concat(F.lit("."), r)), 0.6).otherwise(0.3)
    return F.when(q.contains(r), F.greatest(base, F.lit(0.5))).otherwise(base)


def match_strategy(ref: str, name: str, qualified: str) -> Column:
    r, n, q = F.col(ref), F.col(name), F.col(qualified)
    return F.when(q.contains(r), "qualified_name_contains").when(n == r, "exact_name").when(q.endswith(F.concat(F.lit("."), r)), "qualified_suffix").otherwise("weak")


def _gram_size(text: str) -> Column:
    """How many letters the piece has by which a reference is looked up: the most of 8, 4, 2, 1 that it has."""
    n = F.length(text)
    return F.when(n >= 8, 8).when(n >= 4, 4).when(n >= 2, 2).otherwise(1)


def _parts(text: str, size: str) -> str:
    """SQL of the pieces of ``size`` letters, one for each place."""
    return f"transform(sequence(1, greatest(length({text}) - {size} + 1, 1)), i -> substring({text}, i, {size}))"


def _grams(text: str, size: str) -> Column:
    """Hashes of the different pieces of ``size`` letters. Equal hashes of different pieces only add a candidate, which is then tested."""
    return F.expr(f"array_distinct(transform(sequence(1, greatest(length({text}) - {size} + 1, 1)), i -> xxhash64(substring({text}, i, {size}))))")


def _sought(pieces: DataFrame, key: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """The pieces whose key is wanted, and few others: all that is not is dropped before anything moves."""
    words = min(MAX_FILTER_WORDS, max(CHUNK_WORDS, -(-n_keys * BITS_PER_PIECE // 64)))
    return probe(pieces, key, bloom_filter(keys, key, words), words, "maybe").where("maybe").drop("maybe")


def _of_sizes(symbols: DataFrame, asked: DataFrame) -> DataFrame:
    """Symbols once for each size of piece that the references have, where a name is long enough."""
    used = sorted(r["size"] for r in asked.select("size").distinct().collect())
    return symbols.withColumn("size", F.explode(F.array(*[F.lit(n) for n in used or [1]]))).where("length(qualified_name) >= size")


def _first_of(rows: DataFrame, ref: str, top: int) -> DataFrame:
    """Of the symbols whose qualified name contains a text the first ``top``: those that end in it as a part, then by id."""
    ends = F.col("qualified_name").endswith(F.concat(F.lit("."), F.col(ref)))
    rank = F.row_number().over(Window.partitionBy(ref).orderBy(F.desc("_ends"), "id"))
    return rows.withColumn("_ends", ends).withColumn("_r", rank).where(F.col("_r") <= top).select(ref, "id", "name", "qualified_name")


def match_references(references: DataFrame, nodes: DataFrame, top: int = 10) -> DataFrame:
    """(ref, id, confidence, strategy): symbols for each reference text (ref), the best ten at 0.5 or more.

    A symbol answers if its name is the text or its qualified name contains it
    anywhere. Containment is an equi-join on pieces of the text: each reference
    meets the names that have its rarest piece, and those are tested. References
    that are a piece themselves need no test and, as they may be in most names,
    meet only the ten that rank first. A Bloom filter keeps pieces that nothing
    seeks from being moved. Symbols of the same names answer alike, so of those
    only the first ten take part. An empty text is contained in nothing and only
    matches an empty name.
    """
    scratch = Scratch(nodes.sparkSession)
    current = current_nodes(nodes, "name", "qualified_name").select("id", "name", F.coalesce("qualified_name", "name").alias("qualified_name")).where("qualified_name is not null")
    first = F.row_number().over(Window.partitionBy("name", "qualified_name").orderBy("id"))
    symbols = scratch.write(current.withColumn("_r", first).where(F.col("_r") <= top).drop("_r"))
    asked = scratch.write(references.select("ref").where("ref is not null").distinct().withColumn("size", _gram_size("ref")))

    whole, n_whole = scratch.counted(asked.where("length(ref) = size"))
    parts = _of_sizes(symbols, whole).withColumn("ref", F.explode(F.expr(f"array_distinct({_parts('qualified_name', 'size')})"))).drop("size")
    contained = _first_of(_sought(parts, "ref", whole.select("ref"), n_whole["rows"]), "ref", top).join(whole.select("ref"), "ref", "left_semi")

    longer = asked.where("length(ref) > size")
    pieces = _of_sizes(symbols, longer).withColumn("gram", F.explode(_grams("qualified_name", "size"))).drop("size")
    # A piece that no name has leaves its reference without an answer, which the left join counts as the rarest.
    rare = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    counted = longer.select("ref", F.explode(_grams("ref", "size")).alias("gram")).join(rare, "gram", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")
    keys, n_keys = scratch.counted(counted.groupBy("ref").agg(rarest).where("g.n > 0").select("ref", F.col("g.gram").alias("gram")))
    tested = keys.join(_sought(pieces, "gram", keys, n_keys["rows"]), "gram").where(F.col("qualified_name").contains(F.col("ref")))

    # Symbols that bear the text as their name rank before all others and are found by it.
    contained = contained.unionByName(_first_of(tested, "ref", top)).where(~F.col("name").eqNullSafe(F.col("ref")))
    rows = contained.unionByName(asked.join(symbols, F.col("ref") == F.col("name")).drop("size"))
    rows = rows.withColumn("confidence", match_confidence("ref", "name", "qualified_name")).where(F.col("confidence") >= ACCEPTED)
    rows = rows.select("ref", "id", "confidence", match_strategy("ref", "name", "qualified_name").alias("strategy"))
    rank = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("confidence"), "id"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def names_in_other_modules(nodes: DataFrame) -> DataFrame:
    """(name, n_modules, n_symbols): types whose name several modules use."""
    rows = current_nodes(nodes, "name", "kind", "module_id").where("kind in ('class', 'interface') and module_id != ''")
    return rows.groupBy("name").agg(F.countDistinct("module_id").alias("n_modules"), F.count("*").alias("n_symbols")).where("n_modules > 1")


def imports_in(files: DataFrame) -> DataFrame:
    """(path, imported): import statements of Java, Kotlin, TypeScript and Python sources."""
    content = files.where("content is not null and path is not null").groupBy("path").agg(F.max(F.struct("indexed_at", "content_hash", "content")).alias("f")).select("path", F.regexp_replace(F.col("f.content"), "\r", "").alias("content"))
    # Patterns keep to what both regular-expression engines share.
    jvm = F.regexp_extract_all("content", F.lit(r"(?m)^import (?:static )?([\w.]+);?$"), F.lit(1))
    script = F.regexp_extract_all("content", F.lit(r"(?m)^import [^'\"\n]* from ['\"]([^'\"\n]+)['\"]"), F.lit(1))
    python = F.regexp_extract_all("content", F.lit(r"(?m)^from ([\w.]+) import \w+"), F.lit(1))
    return content.select("path", F.explode(F.concat(jvm, script, python)).alias("imported")).distinct()


def resolve_import_paths(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, imported, file): relative and aliased imports resolved against the stored paths, the first ending wins."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    root = F.regexp_extract("path", r"^([^/]+/[^/]+)/", 1)
    base = (
        F.when(F.col("imported").startswith("./"), F.concat(folder, F.expr("substr(imported, 2)")))
        .when(F.col("imported").startswith("../"), F.concat(F.regexp_replace(folder, "/[^/]*$", ""), F.expr("substr(imported, 3)")))
        .when(F.col("imported").rlike("^[@~]/"), F.concat(root, F.lit("/src"), F.expr("substr(imported, 2)")))
    )
    endings = F.posexplode(F.array(*[F.lit(e) for e in IMPORT_ENDINGS]))
    tries = imports.withColumn("base", base).where("base is not null").select("path", "imported", "base", endings.alias("at", "ending")).withColumn("file", F.concat("base", "ending"))
    stored = files.select(F.col("path").alias("file")).distinct()
    return tries.join(stored, "file", "left_semi").groupBy("path", "imported").agg(F.min_by("file", "at").alias("file"))


def event_pairs(edges: DataFrame) -> DataFrame:
    """(topic, n_publishers, n_subscribers): both ends of topics, joined on the topic and not within one file."""
    rows = edges.where(F.col("target").startswith("topic:")).select(F.expr("substr(target, 7)").alias("topic"), "source", "kind").distinct()
    return rows.groupBy("topic").agg(F.count_if(F.col("kind") == "dispatch_call").alias("n_publishers"), F.count_if(F.col("kind") != "dispatch_call").alias("n_subscribers"))


def injected(edges: DataFrame) -> DataFrame:
    return annotations(edges).where("annotation_name in ('Autowired', 'Inject', 'Resource')").select("node_id", "annotation_name")
