"""Conditions on beans, evaluated against configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import argument

# What each outcome of a condition is worth.
MISSING_BUT_MATCHES, MISSING, VALUE, PRESENT, PROFILE, CLASS, BEAN = 0.7, 0.8, 0.9, 0.9, 0.9, 0.5, 0.4
SPEL_LITERAL, SPEL_EQUAL, SPEL_UNKNOWN = 0.35, 0.6, 0.2


def parse_conditions(uses: DataFrame) -> DataFrame:
    """(id, type, name, having, match_if_missing, expression) from (id, annotation, args)."""
    first = F.regexp_extract("args", r"\"([^\"]*)\"", 1)
    prefix = argument("args", "prefix")
    plain = F.coalesce(argument("args", "name"), argument("args", "value"), first)
    name = F.when(prefix.isNotNull(), F.concat_ws(".", F.regexp_replace(prefix, r"\.$", ""), plain)).otherwise(plain)
    kind = (
        F.when(F.col("annotation") == "ConditionalOnProperty", "property")
        .when(F.col("annotation") == "ConditionalOnClass", "class")
        .when(F.col("annotation") == "ConditionalOnMissingBean", "missing_bean")
        .when(F.col("annotation") == "ConditionalOnBean", "bean")
        .when(F.col("annotation") == "ConditionalOnExpression", "expression")
        .when(F.col("annotation") == "Profile", "profile")
    )
    return uses.select("id", kind.alias("type"), name.alias("name"), argument("args", "havingValue").alias("having"), (argument("args", "matchIfMissing") == "true").alias("match_if_missing"), first.alias("expression"), "args").where("type is not null")


def evaluate(conditions: DataFrame, config: DataFrame, profiles: list[str]) -> DataFrame:
    """Adds matched and confidence; ``config`` is (key, value).

    Properties are looked up by an equi-join; an expression's placeholder is
    looked up the same way.
    """
    placeholder = F.regexp_extract("expression", r"\$\{([^:}]+)", 1)
    rows = conditions.withColumn("_key", F.when(F.col("type") == "expression", placeholder).otherwise(F.col("name")))
    rows = rows.join(config.select(F.col("key").alias("_key"), F.col("value").alias("_value")), "_key", "left")
    wanted = F.regexp_extract_all("args", F.lit(r"\"([^\"]+)\""), F.lit(1))
    active = F.array(*[F.lit(p) for p in profiles]).cast("array<string>")
    missing_ok = F.coalesce("match_if_missing", F.lit(False))
    default = F.nullif(F.regexp_extract("expression", r"\$\{[^:}]+:([^}]*)\}", 1), F.lit(""))
    filled = F.regexp_replace("expression", r"\$\{[^}]*\}", F.coalesce(F.col("_value"), default, F.lit("?")))
    bare = F.trim(F.regexp_replace(filled, r"#\{|\}", ""))
    left, right = F.trim(F.regexp_extract(bare, r"^(.*?)={2,3}", 1)), F.trim(F.regexp_extract(bare, r"={2,3}(.*)$", 1))
    unquoted = lambda c: F.regexp_replace(c, "^'|'$", "")
    equal = unquoted(left) == unquoted(right)
    outcome: list[tuple[Column, Column, float]] = [
        ((F.col("type") == "property") & F.col("_value").isNull() & missing_ok, F.lit(True), MISSING_BUT_MATCHES),
        ((F.col("type") == "property") & F.col("_value").isNull(), F.lit(False), MISSING),
        ((F.col("type") == "property") & F.col("having").isNotNull(), F.col("_value") == F.col("having"), VALUE),
        (F.col("type") == "property", F.lower("_value") != "false", PRESENT),
        (F.col("type") == "profile", F.arrays_overlap(wanted, active) if profiles else F.lit(False), PROFILE),
        (F.col("type") == "class", F.lit(True), CLASS),
        (F.col("type").isin("missing_bean", "bean"), F.lit(True), BEAN),
        ((F.col("type") == "expression") & F.lower(bare).isin("true", "false"), F.lower(bare) == "true", SPEL_LITERAL),
        ((F.col("type") == "expression") & (left != ""), equal, SPEL_EQUAL),
    ]
    matched, confidence = F.lit(True), F.lit(SPEL_UNKNOWN)
    for test, result, worth in reversed(outcome):
        matched, confidence = F.when(test, result).otherwise(matched), F.when(test, F.lit(worth)).otherwise(confidence)
    return rows.select("id", "type", "name", matched.alias("matched"), confidence.alias("confidence"))


def active_symbols(evaluated: DataFrame) -> DataFrame:
    """(id, active, confidence): all conditions met; the mean confidence, times 0.3 where not."""
    grouped = evaluated.groupBy("id").agg(F.bool_and("matched").alias("active"), F.avg("confidence").alias("c"))
    return grouped.select("id", "active", F.round(F.when(F.col("active"), F.col("c")).otherwise(F.col("c") * 0.3), 6).alias("confidence"))


def active_implementations(implementations: DataFrame, evaluated: DataFrame) -> DataFrame:
    """(interface_id, implementation_id, active, confidence); 0.8 where there are no conditions."""
    state = active_symbols(evaluated).withColumnRenamed("id", "implementation_id")
    return implementations.join(state, "implementation_id", "left").select("interface_id", "implementation_id", F.coalesce("active", F.lit(True)).alias("active"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"))
