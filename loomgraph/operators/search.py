"""Full-text and fuzzy search over symbols."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.paths import path_relevance
from loomgraph.operators.graph import current_nodes

FIELDS = ("name", "qualified_name", "docstring", "signature")
K1, B = 1.2, 0.75
MAX_DISTANCE = 3


def sanitised(text: str) -> str:
    """Word characters, blanks and hyphens only."""
    import re

    return re.sub(r"[^\w\s-]", "", text)


def tokens_of(column: str) -> Column:
    """Runs of letters and digits in lower case; '.', '_' and ':' divide words, capitals don't."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(nodes: DataFrame) -> DataFrame:
    """The inverted index: (token, node_id, field, tf)."""
    current = current_nodes(nodes, *FIELDS)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens_of(f).alias("tokens")) for f in FIELDS])).alias("f")
    rows = current.select(F.col("id").alias("node_id"), each).select("node_id", "f.field", F.explode("f.tokens").alias("token"))
    return rows.groupBy("token", "node_id", "field").agg(F.count("*").alias("tf"))


def document_tokens(nodes: DataFrame) -> DataFrame:
    """(node_id, tokens): all tokens of the four fields."""
    return current_nodes(nodes, *FIELDS).select(F.col("id").alias("node_id"), F.concat(*[tokens_of(f) for f in FIELDS]).alias("tokens"))


def match_all(nodes: DataFrame, queries: DataFrame, top: int | None = 10) -> DataFrame:
    """(query_id, node_id, score): symbols that hold all words of a query, best BM25 first, ``top`` per query or all.

    ``queries`` is (query_id, words). Only the rarest word of a query is a join
    key; the other words are looked up in the matched symbol's own tokens. Equal
    queries are answered once. Words of the corpus are counted over all symbols.
    """
    docs = document_tokens(nodes)
    statistics = docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("l")).first()
    n, length = statistics["n"], statistics["l"] or 1.0
    counted = docs.select("node_id", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    asked = queries.select("query_id", F.array_sort(F.array_distinct("words")).alias("words")).where("size(words) > 0")
    unique = asked.select("words").distinct()
    weighed = unique.select("words", F.explode("words").alias("token")).join(counted, "token", "left").groupBy("words").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("w")
    )
    weighed = weighed.where(F.col("w")[0]["df"] > 0).select("words", "w", F.col("w")[0]["token"].alias("token"))
    holders = docs.select("node_id", "tokens", F.explode(F.array_distinct("tokens")).alias("token")).join(weighed.select("token").distinct(), "token", "left_semi")
    pairs = weighed.join(holders, "token").where(F.forall("words", lambda w: F.array_contains("tokens", w)))
    size = F.size("tokens")

    def part(w: Column) -> Column:
        tf = F.size(F.filter("tokens", lambda t: t == w["token"]))
        idf = F.greatest(F.log((F.lit(float(n)) - w["df"] + 0.5) / (w["df"] + 0.5)), F.lit(1e-6))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(float(length))))

    scored = pairs.select("words", "node_id", F.round(F.aggregate("w", F.lit(0.0), lambda s, w: s + part(w)), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("words").orderBy(F.desc("score"), "node_id"))
    best = scored.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r") if top else scored
    return asked.join(best, "words").select("query_id", "node_id", "score")


def like_all(nodes: DataFrame, words: list[str]) -> DataFrame:
    """(node_id): every word somewhere in name, qualified name or path; the answer when the index has none."""
    test = F.lit(True)
    for word in words:
        w = word.lower()
        test = test & (F.lower("name").contains(w) | F.lower("qualified_name").contains(w) | F.lower("file_path").contains(w))
    return current_nodes(nodes, "name", "qualified_name", "file_path").where(test).select(F.col("id").alias("node_id"))


@dataclass
class ParsedQuery:
    text: str
    kind: str | None = None
    language: str | None = None
    path: str | None = None
    name: str | None = None


def parse_query(text: str) -> ParsedQuery:
    """``kind: lang: language: path: name:`` with optional quotes; all other text is kept, unknown fields too."""
    import re

    found: dict[str, str] = {}
    fields = {"kind": "kind", "lang": "language", "language": "language", "path": "path", "file": "path", "name": "name"}

    def take(match):
        field = fields.get(match.group(1).lower())
        if not field:
            return match.group(0)
        found[field] = match.group(2) if match.group(2) is not None else match.group(3)
        return " "

    rest = re.sub(r'(\w+):(?:"([^"]*)"|(\S+))', take, text)
    return ParsedQuery(" ".join(rest.split()), **found)


def fts_expression(text: str) -> str:
    return " AND ".join(f'"{word}"' for word in sanitised(text).split())


def search(nodes: DataFrame, text: str, limit: int = 50, module: str | None = None) -> DataFrame:
    """(id, name, kind, file_path, score): fields are filters and apply before the limit; then text, then fuzzy.

    Best paths come first (own sources before tests before generated files),
    then the best score; higher is better.
    """
    from loomgraph.functions.paths import glob_regex

    query = parse_query(text)
    rows = nodes
    current = current_nodes(nodes, *FIELDS, "kind", "language", "file_path", "module_id")
    test = F.lit(True)
    if query.kind:
        test = test & (F.col("kind") == query.kind.lower())
    if query.language:
        test = test & (F.lower("language") == query.language.lower())
    if query.path:
        test = test & F.col("file_path").rlike(glob_regex(query.path))
    if query.name:
        test = test & F.lower("name").contains(query.name.lower())
    if module:
        test = test & (F.col("module_id") == module)
    kept = current.where(test)
    words = [w for w in __import__("re").split(r"[^\w]+|_", sanitised(query.text).lower()) if w]
    if words:
        spark = nodes.sparkSession
        asked = spark.createDataFrame([(0, words)], "query_id int, words array<string>")
        hits = match_all(rows, asked, top=None).select(F.col("node_id").alias("id"), "score")
        found = kept.join(hits, "id")
        if found.isEmpty():
            plain = like_all(rows, words).select(F.col("node_id").alias("id"), F.lit(0.5).alias("score"))
            found = kept.join(plain, "id")
        if found.isEmpty():
            near = fuzzy(rows, [query.text], None).select(F.col("node_id").alias("id"), (1 / (1 + F.col("distance"))).alias("score"))
            found = kept.join(near, "id")
    else:
        found = kept.withColumn("score", F.lit(0.0))
    return found.select("id", "name", "kind", "file_path", "score").orderBy(F.desc(path_relevance("file_path")), F.desc("score"), "id").limit(limit)


def osa(a: str, b: str, most: int = MAX_DISTANCE) -> int:
    """Optimal string alignment distance; ``most`` + 1 when it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most and min(last) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


@F.pandas_udf(T.IntegerType())
def _osa_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y) for x, y in zip(a, b)], dtype="int32")


def fuzzy(nodes: DataFrame, terms: list[str], top: int | None = 20) -> DataFrame:
    """(term, node_id, distance): symbols whose name or qualified name is at most three edits from a term.

    The terms are a short list given by the caller, held against all different
    names in one pass; Levenshtein in the JVM removes what can't be near (three
    alignments are at most six edits) before Python sees it.
    """
    current = current_nodes(nodes, "name", "qualified_name")
    named = current.select("id", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("name"), F.lower("qualified_name"))))).alias("n"))
    wanted = F.explode(F.array(*[F.lit(t.lower()) for t in dict.fromkeys(terms)]))
    pairs = named.select("n").distinct().select("n", wanted.alias("term")).where((F.abs(F.length("n") - F.length("term")) <= MAX_DISTANCE) & (F.levenshtein("n", "term", 2 * MAX_DISTANCE) >= 0))
    near = pairs.withColumn("distance", _osa_column("n", "term")).where(F.col("distance") <= MAX_DISTANCE)
    hits = named.join(near, "n").groupBy("term", F.col("id").alias("node_id")).agg(F.min("distance").alias("distance"))
    if not top:
        return hits
    rank = F.row_number().over(Window.partitionBy("term").orderBy("distance", "node_id"))
    return hits.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def camel_match(nodes: DataFrame, words: list[str]) -> DataFrame:
    """(id, name): symbols whose name holds all the words as parts of its camel case."""
    from loomgraph.functions.text import split_camel

    rows = current_nodes(nodes, "name").withColumn("parts", split_camel("name"))
    return rows.where(F.size(F.array_except(F.array(*[F.lit(w.lower()) for w in words]), "parts")) == 0).select("id", "name")


def idf(n: int, df: int) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
