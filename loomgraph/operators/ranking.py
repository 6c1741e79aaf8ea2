"""Sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.paths import path_class, path_relevance

PAGE_LIMIT, PAGE_MAX = 50, 500
OUTPUT_CHARS = 15_000
# Budgets by number of files.
BUDGET_TIERS = ((150, 30), (500, 40), (5000, 50), (15000, 60))
BUDGET_MOST = 70


def page(df: DataFrame, order: list[Column | str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page, with the total and whether more follows: the limit is kept within 1 and 500."""
    limit = PAGE_LIMIT if limit is None else max(1, min(PAGE_MAX, int(limit)))
    offset = max(0, int(offset))
    total = df.count()
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumn("total", F.lit(total).cast("bigint")).withColumn("truncated", F.lit(offset + limit < total))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def by_relevance(df: DataFrame, path: str = "file_path") -> DataFrame:
    return df.withColumn("relevance", path_relevance(path))


def non_production_cap(df: DataFrame, keys: list[str], path: str, order: list[Column | str], cap: int) -> DataFrame:
    """All production rows, and of each group at most ``cap`` others in the given order."""
    other = (path_class(path) != "production").cast("int")
    running = F.sum(other).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_other", other).withColumn("_n", running).where((F.col("_other") == 0) | (F.col("_n") <= cap)).drop("_other", "_n")


def budget(n_files: int) -> dict[str, int | bool]:
    """What an answer about a tree of so many files may hold."""
    total = next((t for limit, t in BUDGET_TIERS if n_files < limit), BUDGET_MOST)
    groups = max(1, -(-n_files // 10))
    return {
        "total": total,
        "per_file": max(3, total // groups),
        "non_production": max(2, int(0.15 * total)),
        "max_files": min(50, max(5, -(-n_files // 10))),
        "routes_inline": total <= 40,
        "collapse": total >= 50,
    }


def budget_column(n_files: str) -> Column:
    column = F.lit(BUDGET_MOST)
    for limit, total in reversed(BUDGET_TIERS):
        column = F.when(F.col(n_files) < limit, total).otherwise(column)
    return column


def shortened(text: str, limit: int = OUTPUT_CHARS) -> Column:
    """At most ``limit`` characters, cut at the last line end if that keeps four fifths."""
    head = F.substring(text, 1, limit)
    back = F.instr(F.reverse(head), "\n")
    kept = limit - back
    cut = F.when((back > 0) & (kept > 0.8 * limit), F.substr(head, F.lit(1), kept)).otherwise(head)
    return F.when(F.length(text) <= limit, F.col(text)).otherwise(cut)
