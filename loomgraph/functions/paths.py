"""Predicates and scores of file paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of paths by which files are classified.
TEST_PATH = r"(?i)(test|spec|__tests__|__test__)"
GENERATED_PATH = r"(?i)(/|^)(target|build|dist|out|generated|generated-sources|node_modules|\.gradle|\.next|\.nuxt|vendor|third_party)(/|$)|\.(min|bundle|chunk)\.|_pb2|\.pb\.|(^|/)Q[A-Z][A-Za-z]*\.java$"
# Languages by extension.
LANGUAGES = {
    "java": "java", "kt": "kotlin", "kts": "kotlin", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "py": "python", "vue": "vue", "xml": "xml", "yml": "yaml", "yaml": "yaml", "sql": "sql", "css": "css", "scss": "css", "html": "html", "properties": "properties",
    "json": "json", "gradle": "gradle", "proto": "protobuf", "graphql": "graphql", "drl": "drools",
}


def normal_path(column: str | Column) -> Column:
    """With forward slashes."""
    return F.translate(column, "\\", "/")


def extension(column: str) -> Column:
    return F.lower(F.regexp_extract(F.col(column), r"\.([A-Za-z0-9]+)$", 1))


def language_of(column: str) -> Column:
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(column)), F.lit("unknown"))


def is_test_path(column: str) -> Column:
    return F.coalesce(F.col(column).rlike(TEST_PATH), F.lit(False))


def is_generated_path(column: str) -> Column:
    return F.coalesce(normal_path(column).rlike(GENERATED_PATH), F.lit(False))


def path_relevance(column: str) -> Column:
    """-2 generated, -1 test, 1 under src/, app/ or components/, else 0."""
    path = normal_path(column)
    return (
        F.when(is_generated_path(column), -2)
        .when(is_test_path(column), -1)
        .when(path.contains("src/") | path.contains("app/") | path.contains("components/"), 1)
        .otherwise(0)
    )


def path_class(column: str) -> Column:
    """test, sample, generated or production."""
    low = F.lower(F.col(column))
    return (
        F.when(low.rlike("test|spec|__test__"), "test")
        .when(low.rlike("sample|example|demo"), "sample")
        .when(low.rlike("generated|\\.pb\\.|mock"), "generated")
        .otherwise("production")
    )


def glob_regex(pattern: str, anchored: bool = False) -> str:
    """'*' for any characters, '?' for one; case doesn't matter; unanchored unless asked for."""
    import re

    body = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)
    return f"(?i)^{body}$" if anchored else f"(?i){body}"


def matches_glob(column: str, pattern: str) -> Column:
    return F.col(column).rlike(glob_regex(pattern))


def matches_name_patterns(column: str, patterns: list[str]) -> Column:
    """Exact names, ``p*`` prefixes and ``*s`` suffixes."""
    test = F.lit(False)
    for pattern in patterns:
        if pattern.endswith("*"):
            test = test | F.col(column).startswith(pattern[:-1])
        elif pattern.startswith("*"):
            test = test | F.col(column).endswith(pattern[1:])
        else:
            test = test | (F.col(column) == pattern)
    return test
