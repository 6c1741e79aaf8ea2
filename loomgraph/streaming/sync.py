"""Reports of changed files as a stream: sessions of changes, and an index kept up to date.

A watcher that waits until a path has been quiet for some seconds is a session
window with that gap over the reports of the path. Late reports are never
dropped by the sync itself: every batch is merged by key and order, so applying
a report twice, or late, gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.sets import last_wins

QUIET = "2 seconds"
LATE = "10 minutes"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1_000) -> DataFrame:
    """A folder of Parquet files as a stream; back-pressure is the number of files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def change_sessions(reports: DataFrame, at: str = "changed_at", gap: str = QUIET, late: str | None = LATE) -> DataFrame:
    """(path, first_seen, last_seen, n_reports, last_op): reports of a path with less than ``gap`` between them.

    Works on a table and on a stream; on a stream the watermark ``late`` says
    how long a session waits for late reports.
    """
    rows = reports.where(F.col("path").isNotNull() & F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("timestamp"))
    if late and reports.isStreaming:
        rows = rows.withWatermark("_at", late)
    grouped = rows.groupBy(F.session_window("_at", gap), "path")
    out = grouped.agg(F.min("_at").alias("first_seen"), F.max("_at").alias("last_seen"), F.count("*").alias("n_reports"), F.max(F.struct("_at", "op")).alias("_l"))
    return out.select("path", "first_seen", "last_seen", "n_reports", F.col("_l.op").alias("last_op"))


def latest_operations(reports: DataFrame) -> DataFrame:
    """(path, op, changed_at): the last report of each path, repeated reports once."""
    rows = reports.where("path is not null and changed_at is not null").groupBy("path").agg(F.max(F.struct("changed_at", "change_id", "op")).alias("r"))
    return rows.select("path", "r.op", "r.changed_at")


def apply_changes(known: DataFrame, batch: DataFrame) -> DataFrame:
    """The table of known files (path, op, changed_at) after a batch of reports; idempotent, and blind to their order."""
    both = known.select("path", "op", "changed_at", F.lit(None).cast("bigint").alias("change_id")).unionByName(batch.select("path", "op", "changed_at", "change_id"))
    return latest_operations(both)


def sync_to(reports: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of the last operation of each path up to date with a stream of reports."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pointer = f"{table_path}/_versions"
        versions = _versions(spark, pointer)
        fresh = latest_operations(batch)
        # A batch that is repeated after a failure starts from the version before its own and writes its own again.
        before = [v for v in versions if v < batch_id]
        if before:
            fresh = apply_changes(spark.read.parquet(f"{table_path}/v{before[-1]}"), batch)
        fresh.write.mode("overwrite").parquet(f"{table_path}/v{batch_id}")
        spark.range(1).select(F.lit(batch_id).cast("int").alias("v")).write.mode("append").parquet(pointer)
        # The version before stays for readers that began with it; older ones go.
        for old in before[:-1]:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/v{old}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return reports.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, pointer: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(pointer)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return []  # the first batch
    return [r["v"] for r in spark.read.schema("v int").parquet(pointer).distinct().orderBy("v").collect()]


def read_synced(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.parquet(f"{table_path}/v{_versions(spark, f'{table_path}/_versions')[-1]}")


def plan_sync(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, change): files to add, to index again (size or time, then hash, differ), or to remove."""
    a = last_wins(indexed.select("path", "content_hash", "size", F.floor("modified_at").alias("modified_at"), "indexed_at"), ["path"], "indexed_at").withColumn("_known", F.lit(True))
    b = scanned.select("path", F.col("content_hash").alias("h"), F.col("size").alias("s"), F.floor("modified_at").alias("m")).withColumn("_there", F.lit(True))
    same_stamp = (F.col("size") == F.col("s")) & (F.col("modified_at") == F.col("m"))
    change = (
        F.when(F.col("_known").isNull(), "added")
        .when(F.col("_there").isNull(), "removed")
        .when(~F.coalesce(same_stamp, F.lit(False)) & ~F.col("content_hash").eqNullSafe(F.col("h")), "modified")
    )
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def stale_paths(files: DataFrame, reports: DataFrame) -> DataFrame:
    """(path, changed_at): files whose last report is later than their index entry: answers about them may be stale."""
    indexed = files.where("path is not null").groupBy("path").agg(F.max("indexed_at").alias("indexed_at"))
    last = latest_operations(reports).where("op != 'deleted'")
    return last.join(indexed, "path").where(F.unix_millis(F.col("changed_at").cast("timestamp")) > F.col("indexed_at")).select("path", "changed_at")
