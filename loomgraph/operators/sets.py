"""Set operations and writes with defined winners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """INSERT OR IGNORE: the first row of each key."""
    return _winner(df, keys, order, F.min)


def last_wins(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """INSERT OR REPLACE: the last row of each key."""
    return _winner(df, keys, order, F.max)


def _winner(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c != order]
    packed = pick(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_w")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*[F.col(c) if c in keys else F.col("_w")[c].alias(c) for c in df.columns])


def upsert_files(files: DataFrame) -> DataFrame:
    """Files by path: the last row's sizes and times, but language and module of the first row."""
    facts = ("content_hash", "size", "modified_at", "indexed_at", "node_count")
    last = F.max(F.struct("indexed_at", *[c for c in facts if c != "indexed_at"])).alias("l")
    first = F.min(F.struct("indexed_at", "content_hash", "language", "module_id")).alias("f")
    out = files.where("path is not null").groupBy("path").agg(last, first)
    return out.select("path", *[F.col("l")[c].alias(c) for c in facts], F.col("f.language").alias("language"), F.col("f.module_id").alias("module_id"))


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the given paths, and edges at either end of them, removed."""
    gone = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id").distinct()
    kept_nodes = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")
    kept_edges = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return kept_nodes.select(*nodes.columns), kept_edges.select(*edges.columns)


def changes(old: DataFrame, new: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """(keys, change): 'added', 'removed' or 'modified', by one full outer join."""
    a = old.select(*keys, F.struct(*compare).alias("_a"))
    b = new.select(*keys, F.struct(*compare).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).where("change is not null")


def unchanged_files(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """Scanned files that are new or differ in size or whole milliseconds of time."""
    stamp = F.floor("modified_at").alias("modified_at")
    return scanned.join(known.select("path", "size", stamp), ["path", "size", "modified_at"], "left_anti")


def union_best(parts: list[DataFrame], keys: list[str], rank: str) -> DataFrame:
    """All parts together; of equal keys the row with the greatest rank."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rest = [c for c in rows.columns if c not in keys]
    packed = F.max(F.struct(F.col(rank), *[F.col(c) for c in rest if c != rank])).alias("_b")
    return rows.groupBy(*keys).agg(packed).select(*keys, *[F.col("_b")[c].alias(c) for c in rest])


def jaccard(a: str, b: str):
    shared, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(both > 0, shared / both).otherwise(F.lit(0.0))


def export_dot(edges: DataFrame, limit: int = 10_000) -> DataFrame:
    """One row with the edges as DOT text, in the order of source, target and kind; the limit is part of the tool."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c), '"', "'"), F.lit('"'))
    rows = edges.select("source", "target", "kind").distinct().orderBy("source", "target", "kind").limit(limit)
    line = F.concat(F.lit("  "), q("source"), F.lit(" -> "), q("target"), F.lit(" [label="), q("kind"), F.lit("];"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "target", "kind", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.agg(F.concat(F.lit("digraph G {\n"), body, F.lit("\n}")).alias("dot"))


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """A table as Parquet, JSON lines or CSV; Spark's commit protocol makes the write whole or absent."""
    writer = df.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
