"""Source text by lines: declarations, scopes, annotations, docstrings, calls.

All of it is column expressions and windows over the lines of one file; no
Python sees the text. A window never holds more than one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import Scratch

LOOK_AHEAD = 5

# Declarations by language, as (kind, pattern with the name as group 1).
DECLARATIONS: dict[str, tuple[tuple[str, str], ...]] = {
    "java": (
        ("interface", r"^\s*(?:(?:public|protected|private|abstract|static|sealed|non-sealed)\s+)*@?interface\s+(\w+)"),
        ("enum", r"^\s*(?:(?:public|protected|private|static)\s+)*enum\s+(\w+)"),
        ("class", r"^\s*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*(?:class|record)\s+(\w+)"),
        ("method", r"^\s+(?:(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]+>\s+)?(?!return\b|new\b|else\b|throw\b)\w[\w.<>\[\],? ]*?\s+(?!if\b|for\b|while\b|switch\b|catch\b)(\w+)\s*\([^;]*\)?\s*(?:throws [\w., ]+)?[{;]?\s*$"),
        ("constructor", r"^\s+(?:public|protected|private)\s+([A-Z]\w*)\s*\("),
        ("field", r"^\s+(?:(?:public|protected|private|static|final|volatile|transient)\s+)+[\w.<>\[\],? ]+\s+(\w+)\s*(?:=.*)?;\s*$"),
    ),
    "kotlin": (
        ("interface", r"^\s*(?:\w+\s+)*interface\s+(\w+)"),
        ("object", r"^\s*(?:(?:private|internal|companion|data)\s+)*object\s+(\w+)"),
        ("class", r"^\s*(?:(?:public|private|internal|open|abstract|sealed|data|inner|enum|annotation)\s+)*class\s+(\w+)"),
        ("function", r"^\s*(?:(?:public|private|protected|internal|override|suspend|open|inline|operator|abstract)\s+)*fun\s+(?:<[^>]+>\s+)?(?:\w+\.)?(\w+)\s*\("),
        ("property", r"^\s+(?:(?:public|private|protected|internal|override|lateinit|const)\s+)*va[lr]\s+(\w+)\s*[:=]"),
    ),
    "typescript": (
        ("interface", r"^\s*(?:export\s+)?(?:default\s+)?interface\s+(\w+)"),
        ("type_alias", r"^\s*(?:export\s+)?type\s+(\w+)\s*(?:<[^>]*>)?\s*="),
        ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"),
        ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)\s*[(<]"),
        ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
        ("method", r"^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b|await\b)(\w+)\s*\([^)]*\)\s*(?::\s*[\w<>\[\]|., ]+)?\s*\{\s*$"),
    ),
    "python": (
        ("class", r"^\s*class\s+(\w+)\s*[(:]"),
        ("function", r"^(?:async\s+)?def\s+(\w+)\s*\("),
        ("method", r"^\s+(?:async\s+)?def\s+(\w+)\s*\("),
    ),
}
DECLARATIONS["javascript"] = DECLARATIONS["vue"] = DECLARATIONS["typescript"]
TYPE_KINDS = ("class", "interface", "enum", "object")


def current_contents(files: DataFrame) -> DataFrame:
    """(path, language, content): the latest content of each path, with '\\n' as line end."""
    if files.columns == ["path", "language", "content"]:
        return files  # taken before
    packed = F.max(F.struct("indexed_at", "content_hash", "language", "content")).alias("f")
    rows = files.where("path is not null and content is not null").groupBy("path").agg(packed)
    return rows.select("path", F.col("f.language").alias("language"), F.regexp_replace("f.content", "\r\n?", "\n").alias("content"))


def source_lines(contents: DataFrame) -> DataFrame:
    """(path, language, line, text), lines from 1."""
    return contents.select("path", "language", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("path", "language", (F.col("at") + 1).alias("line"), "text")


def _declared(language: str) -> Column:
    """kind:name of the first pattern that matches, else null."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(DECLARATIONS[language]):
        name = F.regexp_extract("text", pattern, 1)
        out = F.when(name != "", F.concat(F.lit(f"{kind}:"), name)).otherwise(out)
    return out


def declarations(lines: DataFrame) -> DataFrame:
    """Adds kind and name where a line declares something."""
    declared = F.lit(None).cast("string")
    for language in DECLARATIONS:
        declared = F.when(F.col("language") == language, _declared(language)).otherwise(declared)
    rows = lines.withColumn("_d", declared)
    return rows.select("*", F.split("_d", ":")[0].alias("kind"), F.split("_d", ":")[1].alias("name")).drop("_d")


def braces(text: str = "text") -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.col(text), r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", ""), r"//.*$", "")
    return F.regexp_count(plain, F.lit(r"\{")) - F.regexp_count(plain, F.lit(r"\}"))


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of points (path, line, ...) once for each span (path, from, to, level, ...) with from < line <= to; adds ``span``.

    Spans of one level don't overlap, so on each level the last one that began
    is the only candidate: one running window per file and level, no join of
    points with spans.
    """
    inner = F.struct(*[c for c in spans.columns if c != "path"]).alias("span")
    levels = spans.groupBy("path").agg(F.explode(F.collect_set("level")).alias("_level"))
    asked = points.join(levels, "path").withColumn("_began", F.lit(False)).withColumn("span", F.lit(None).cast(spans.select(inner).schema["span"].dataType))
    begun = spans.select("path", F.col("from").alias("line"), F.col("level").alias("_level"), F.lit(True).alias("_began"), inner)
    both = asked.unionByName(begun, allowMissingColumns=True)
    before = Window.partitionBy("path", "_level").orderBy("line", "_began").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("span", F.coalesce("span", F.last("span", ignorenulls=True).over(before))).where("not _began and span is not null")
    return found.where(F.col("line") <= F.col("span.to")).drop("_level", "_began")


def scoped(lines: DataFrame) -> DataFrame:
    """Declarations with their enclosing type and last line.

    The depth before a line is the running sum of braces; a declaration ends at
    the first line that brings the depth back to where it began. Languages
    without braces end at the line before the next one that is indented no more.
    Lines that lower the depth are events of each level they close, so the end
    of a declaration is the next event of its level.
    """
    order = Window.partitionBy("path").orderBy("line")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = declarations(lines).withColumn("_delta", braces()).withColumn("_after", F.sum("_delta").over(up_to)).withColumn("_depth", F.col("_after") - F.col("_delta"))
    python = F.col("language") == "python"
    indent = F.when(python & (F.trim("text") != ""), F.length(F.regexp_extract("text", r"^\s*", 0)))
    rows = rows.withColumn("_indent", indent).withColumn("_before", F.last("_indent", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    following = order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_next", F.first("_indent", ignorenulls=True).over(following)).withColumn("_next_line", F.first(F.when(F.col("_indent").isNotNull(), F.col("line")), ignorenulls=True).over(following))
    rows = rows.withColumn("level", F.when(python, F.col("_indent")).otherwise(F.col("_depth")).cast("long"))
    declared = F.col("name").isNotNull()
    levels = rows.where(declared).groupBy("path").agg(F.collect_set("level").alias("_levels"), F.count(F.lit(1)).alias("_n"))
    last = rows.groupBy("path").agg(F.max("line").alias("_last"))
    rows = rows.join(levels, "path").join(last, "path")
    low, high = F.when(python, F.col("_indent")).otherwise(F.col("_after")), F.when(python, F.col("_before")).otherwise(F.col("_depth"))
    closes = rows.where(low < high).select("path", "line", F.explode(F.filter("_levels", lambda x: (x >= low) & (x < high))).alias("level"), F.lit(True).alias("_event"))
    heads = rows.where(declared).select("path", "language", "line", "kind", "name", "level", "text", "_after", "_next", "_next_line", "_last", F.lit(False).alias("_event"))
    ahead = Window.partitionBy("path", "level").orderBy("line", F.desc("_event")).rowsBetween(1, Window.unboundedFollowing)
    found = heads.unionByName(closes, allowMissingColumns=True).withColumn("_close", F.min(F.when(F.col("_event"), F.col("line"))).over(ahead)).where("not _event")
    # A declaration that opens nothing ends where it stands.
    brace_end = F.when(F.col("_after") <= F.col("level"), F.col("line")).otherwise(F.col("_close"))
    python_end = F.when(F.col("_next") <= F.col("level"), F.col("_next_line")).otherwise(F.col("_close")) - 1
    out = found.withColumn("end_line", F.coalesce(F.when(python, python_end).otherwise(brace_end), "_last"))
    out = out.select("path", "language", "line", "kind", "name", "level", "text", "end_line")
    # A header whose brace opens on a later line closes at once by depth; it ends with the type around it then.
    types = out.where(F.col("kind").isin(*TYPE_KINDS)).select("path", F.col("line").alias("from"), F.col("end_line").alias("to"), "level", F.col("name").alias("owner"))
    inside = enclosing(out.select("path", "line", "kind", "name", "end_line"), types).where(F.col("span.to") >= F.col("end_line"))
    owner = inside.groupBy("path", "line", "kind", "name").agg(F.max(F.struct("span.from", "span.owner")).alias("_o"))
    named = out.join(owner, ["path", "line", "kind", "name"], "left")
    return named.select("path", "language", "kind", "name", F.col("line").alias("start_line"), "end_line", F.col("_o.owner").alias("owner"), F.col("_o.from").alias("owner_line"), F.trim("text").alias("text"), "level")


def symbol_id(path: str = "path", name: str = "name", line: str = "start_line") -> Column:
    return F.concat_ws(":", F.col(path), F.col(name), F.col(line).cast("string"))


def parsed_nodes(files: DataFrame) -> DataFrame:
    """Nodes of all supported sources: id, kind, name, qualified_name, file_path, language, lines, signature, visibility, parent_id."""
    rows = scoped(source_lines(current_contents(files)))
    visibility = F.coalesce(F.nullif(F.regexp_extract("text", r"\b(public|protected|private|internal)\b", 1), F.lit("")), F.lit("public"))
    return rows.select(
        symbol_id().alias("id"), "kind", "name", F.concat_ws(".", "owner", "name").alias("qualified_name"), F.col("path").alias("file_path"), "language", "start_line", "end_line",
        F.regexp_replace("text", r"\s*[{:]?\s*$", "").alias("signature"), visibility.alias("visibility"),
        F.when(F.col("owner").isNotNull(), F.concat_ws(":", "path", "owner", F.col("owner_line").cast("string"))).alias("parent_id"),
    )


# Words before a bracket that are no calls.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "return", "new", "super", "this", "function", "def", "fun", "class", "constructor", "when", "try", "else", "throw", "await", "typeof")


def parsed_edges(files: DataFrame) -> DataFrame:
    """Edges of all supported sources: contains, calls (target ``path:name``), imports, extends, implements."""
    contents = current_contents(files)
    lines = source_lines(contents)
    rows = Scratch(files.sparkSession).write(scoped(lines))
    contains = rows.where("owner is not null").select(F.concat_ws(":", "path", "owner", F.col("owner_line").cast("string")).alias("source"), symbol_id().alias("target"), F.lit("contains").alias("kind"), F.col("start_line").alias("line"))
    callers = rows.where("kind in ('method', 'function', 'constructor')").select("path", F.col("start_line").alias("from"), F.col("end_line").alias("to"), "level", symbol_id().alias("source"))
    called = lines.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)\s*\("), F.lit(1)))).alias("callee")).where(~F.col("callee").isin(*NOT_CALLS))
    inside = enclosing(called, callers).select("path", "line", "callee", "span.source")
    calls = inside.groupBy("source", F.concat_ws(":", "path", "callee").alias("target")).agg(F.min("line").alias("line")).select("source", "target", F.lit("calls").alias("kind"), "line")
    imported = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in (r"^import (?:static )?([\w.]+)", r"^import .* from ['\"]([^'\"]+)['\"]", r"^from ([\w.]+) import ")])
    imports = lines.where("text rlike '^(import|from) '").select(F.concat_ws(":", "path", F.lit("module")).alias("source"), imported.alias("target"), F.lit("imports").alias("kind"), "line").where("target is not null")
    heads = rows.where(F.col("kind").isin(*TYPE_KINDS))
    bases = heads.select(symbol_id().alias("source"), F.lit("extends").alias("kind"), "start_line", F.explode(F.split(F.regexp_extract("text", r"\bextends\s+([\w.<>, ]+?)(?:\s+implements\b|\s*\{|$)", 1), r"\s*,\s*")).alias("t"))
    roles = heads.select(symbol_id().alias("source"), F.lit("implements").alias("kind"), "start_line", F.explode(F.split(F.regexp_extract("text", r"\bimplements\s+([\w.<>, ]+?)\s*(?:\{|$)", 1), r"\s*,\s*")).alias("t"))
    above = bases.unionByName(roles).select("source", F.trim(F.regexp_replace("t", "<.*$", "")).alias("target"), "kind", F.col("start_line").alias("line")).where("target != ''")
    return contains.unionByName(calls).unionByName(imports).unionByName(above)


def annotation_uses(files: DataFrame) -> DataFrame:
    """(path, line, annotation, args, kind, name, owner, symbol_line): annotations and the next declaration within five lines."""
    lines = source_lines(current_contents(files).where("language in ('java', 'kotlin')"))
    rows = declarations(lines)
    ahead = Window.partitionBy("path").orderBy("line").rowsBetween(0, LOOK_AHEAD)
    behind = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    target = F.when(F.col("name").isNotNull(), F.struct("line", "kind", "name"))
    owner = F.when(F.col("kind").isin(*TYPE_KINDS), F.col("name"))
    rows = rows.withColumn("_next", F.first(target, ignorenulls=True).over(ahead)).withColumn("owner", F.last(owner, ignorenulls=True).over(behind))
    found = F.regexp_extract_all("text", F.lit(r"@(\w+(?:\.\w+)*(?:\((?:[^()\"]|\"[^\"]*\"|\([^()]*\))*\))?)"), F.lit(1))
    rows = rows.where("text rlike '^\\\\s*@\\\\w' and not text rlike '@interface'").select("path", "line", "owner", "_next", F.explode(found).alias("use"))
    args = F.regexp_extract("use", r"(?s)\((.*)\)$", 1)
    return rows.select("path", "line", F.element_at(F.split(F.regexp_extract("use", r"^([\w.]+)", 1), "\\."), -1).alias("annotation"), args.alias("args"), "_next.kind", "_next.name", "owner", F.col("_next.line").alias("symbol_line"))


def doc_comments(files: DataFrame) -> DataFrame:
    """(path, line, name, docstring): the comment block that ends right above a declaration."""
    rows = declarations(source_lines(current_contents(files)))
    order = Window.partitionBy("path").orderBy("line")
    text = F.trim("text")
    opens, closes = text.startswith("/**"), text.endswith("*/")
    rows = rows.withColumn("_open", F.last(F.when(opens, F.col("line")), ignorenulls=True).over(order)).withColumn("_close", F.last(F.when(closes, F.col("line")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # Annotations may stand between the comment and the declaration.
    other = F.when(~(text.startswith("@")) & (text != ""), F.col("line"))
    rows = rows.withColumn("_other", F.last(other, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    heads = rows.where("name is not null and _close = _other and _open <= _close").select("path", F.col("line").alias("head"), "name", F.col("_open").alias("a"), F.col("_close").alias("b"))
    # A line belongs to the comment that was opened last.
    body = rows.where("_open is not null").select("path", F.col("_open").alias("a"), F.col("line").alias("l"), F.trim(F.regexp_replace("text", r"^\s*/?\*+/?|\*/\s*$", "")).alias("t"))
    joined = heads.join(body, ["path", "a"]).where("l <= b and t != ''")
    ordered = F.array_sort(F.collect_list(F.struct("l", "t")))
    return joined.groupBy("path", F.col("head").alias("line"), "name").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("docstring"))
