"""Scalar functions on text, names, JSON and hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of keys whose values are secrets.
SENSITIVE = r"(?i)(password|passwd|secret|token|api[-_.]?key|access[-_.]?key|private[-_.]?key|credential)"


def split_camel(column: str | Column) -> Column:
    """Words of a name in lower case; runs of capitals are one word."""
    spaced = F.regexp_replace(F.regexp_replace(column, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda w: w != "")


def pascal_names(column: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+)\b"), F.lit(1)))


def content_hash(column: str) -> Column:
    return F.md5(F.col(column))


def safe_json(column: str) -> Column:
    """The text if it is JSON, else null."""
    return F.when(F.try_parse_json(F.col(column)).isNotNull(), F.col(column))


def json_field(column: str, field: str, default: str, blank_too: bool = False) -> Column:
    """A field of a JSON text; the default for null, and with ``blank_too`` for '' as well."""
    value = F.get_json_object(column, f"$.{field}")
    return F.coalesce(F.nullif(value, F.lit("")) if blank_too else value, F.lit(default))


def masked(key: str, value: str) -> Column:
    return F.when(F.col(key).rlike(SENSITIVE), F.lit("***")).otherwise(F.col(value))


def implementation_name(column: str) -> Column:
    """The usual name of the implementation of an interface."""
    name = F.col(column)
    return F.when(name.rlike("^I[A-Z]"), F.expr(f"substr({column}, 2)")).otherwise(F.concat(name, F.lit("Impl")))


def is_service_interface(name: str, kind: str) -> Column:
    return (F.col(kind) == "interface") & F.col(name).rlike("(Service|Repository|Client|Gateway|Manager|Mapper|Dao)$")


def getter_name(field: str, kind: str | None = None) -> Column:
    start = F.when(F.lower(kind).isin("boolean"), F.lit("is")).otherwise(F.lit("get")) if kind else F.lit("get")
    return F.concat(start, F.upper(F.substring(field, 1, 1)), F.expr(f"substr({field}, 2)"))


def setter_name(field: str) -> Column:
    return F.concat(F.lit("set"), F.upper(F.substring(field, 1, 1)), F.expr(f"substr({field}, 2)"))


def service_of_uri(column: str) -> Column:
    """The host of ``lb://name`` or ``http(s)://name``."""
    return F.nullif(F.regexp_extract(column, r"^(?:lb|https?)://([^/:]+)", 1), F.lit(""))


def diagram_id(column: str) -> Column:
    """Letters, digits and '_' only; a leading digit gets a prefix."""
    plain = F.regexp_replace(column, "[^A-Za-z0-9]", "_")
    return F.regexp_replace(plain, "^([0-9])", "n_$1")


def split_arguments(column: str) -> Column:
    """Top-level commas of annotation arguments: commas inside brackets or quotes don't split."""
    pieces = F.regexp_extract_all(F.col(column), F.lit(r"((?:[^,(\[{\"]|\"[^\"]*\"|\([^()]*(?:\([^()]*\)[^()]*)*\)|\{[^{}]*\}|\[[^\[\]]*\])+)"), F.lit(1))
    return F.transform(pieces, lambda x: F.trim(x))


def argument(column: str, name: str) -> Column:
    """The value of ``name = value`` in annotation arguments, without quotes; null where absent."""
    value = F.regexp_extract(column, rf"(?:^|[,(\s]){name}\s*=\s*(\{{[^}}]*\}}|\"[^\"]*\"|[^,)]+)", 1)
    return F.nullif(F.trim(F.regexp_replace(value, '^"|"$', "")), F.lit(""))


def transaction_settings(column: str) -> Column:
    """Settings of a transaction annotation, with their defaults."""
    return F.struct(
        F.coalesce(F.get(F.regexp_extract_all(F.col(column), F.lit(r"Propagation\.(\w+)"), F.lit(1)), 0), F.lit("REQUIRED")).alias("propagation"),
        F.coalesce(F.get(F.regexp_extract_all(F.col(column), F.lit(r"Isolation\.(\w+)"), F.lit(1)), 0), F.lit("DEFAULT")).alias("isolation"),
        F.coalesce(argument(column, "timeout").try_cast("int"), F.lit(-1)).alias("timeout"),
        F.coalesce(argument(column, "readOnly") == "true", F.lit(False)).alias("read_only"),
        F.regexp_extract_all(F.coalesce(argument(column, "rollbackFor"), F.lit("")), F.lit(r"(\w+)\.class"), F.lit(1)).alias("rollback_for"),
        F.regexp_extract_all(F.coalesce(argument(column, "noRollbackFor"), F.lit("")), F.lit(r"(\w+)\.class"), F.lit(1)).alias("no_rollback_for"),
    )


def cache_settings(column: str) -> Column:
    names = F.coalesce(argument(column, "cacheNames"), argument(column, "value"), F.regexp_extract(column, r"^\s*(\{[^}]*\}|\"[^\"]*\")", 1))
    return F.struct(
        F.regexp_extract_all(F.regexp_replace(F.concat(F.lit('"'), names, F.lit('"')), '""', '"'), F.lit(r"\"([^\"{},]+)\""), F.lit(1)).alias("cache_names"),
        *[argument(column, name).alias(alias) for name, alias in (("key", "key"), ("condition", "condition"), ("unless", "unless"), ("keyGenerator", "key_generator"), ("cacheManager", "cache_manager"))],
    )


def entity_of_method(column: str) -> Column:
    """The entity in the name of a repository method: findOrderById -> Order."""
    return F.nullif(F.regexp_extract(column, r"^(?:find|get|query|search|fetch|load|read|select)([A-Z]\w*?)(?:By[A-Z]\w*|All|One|List)?$", 1), F.lit(""))


def field_of_getter(column: str) -> Column:
    part = F.regexp_extract(column, r"^(?:get|is)([A-Z]\w*)$", 1)
    return F.nullif(F.concat(F.lower(F.substring(part, 1, 1)), F.substr(part, F.lit(2))), F.lit(""))


# Words that a task description doesn't need.
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "into", "how", "what", "where", "when", "why", "does", "are", "was")


def search_terms(column: str, least: int = 2, stop: tuple[str, ...] = ()) -> Column:
    words = F.filter(F.split(F.lower(column), r"[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop)) if stop else words)
