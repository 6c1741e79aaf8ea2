"""Per-key results where a few keys hold most rows: fragment and replicate by load.

1. Loads: an estimate of the rows of the heaviest keys, from a sketch that every
   task fills while it reads; no key is shuffled for it.
2. Plan: keys above a task's fair share are split into shards in proportion;
   shards and the remaining large keys are packed onto tasks, largest first;
   the tail, whose keys are all small, is spread by hash.
3. Every row gets the slot of its shard (chosen by a hash of ``within``, so
   that equal rows meet), one shuffle by slot, and all grouping happens there.
   A matching side is replicated only to the slots of the keys it matches.
   Rows that repeat are combined before, so no single row value is hot either.
4. Shards are merged: one row per key and shard, whatever the key's size.

Only keys above 1 / (tasks * FINE) of all rows are planned, so the plan has at
most tasks * FINE rows and may be collected and broadcast.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINE = 16


SKETCH_ROOM = 4  # entries of the sketch for each key that may be planned
MOST_ENTRIES = 1_000_000  # of a sketch


def key_hash(keys: list[str]):
    """One number per key. Two keys of the same number share their slots, which changes the load but no result."""
    return F.xxhash64(*keys)


def heavy_loads(df: DataFrame, keys: list[str], planned: int) -> tuple[list[tuple[int, int]], int]:
    """((key hash, estimated rows) of at most ``planned`` heaviest keys, number of all rows)."""
    entries = min(MOST_ENTRIES, max(1_024, SKETCH_ROOM * planned))
    top = F.expr(f"approx_top_k(_k, {min(planned, entries)}, {entries})")
    row = df.where(_all_set(keys)).select(key_hash(keys).alias("_k")).agg(top.alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [(item["item"], item["count"]) for item in row["top"] or []], row["n"]


def pack_loads(loads: list[tuple[tuple, int]], total: int, tasks: int) -> list[tuple[tuple, int, int]]:
    """(key, shard, task) of each planned key; the largest shards are placed first.

    The tail that isn't planned is spread evenly, so every task starts with an
    equal part of it.
    """
    share = max(1, total / tasks)
    shards = []
    for key, load in loads:
        parts = max(1, math.ceil(load / share))
        shards += [(load / parts, key, part) for part in range(parts)]
    heap = [(0.0, task) for task in range(tasks)]
    plan = []
    for load, key, part in sorted(shards, key=lambda x: (-x[0], x[1:])):
        filled, task = heapq.heappop(heap)
        plan.append((key, part, task))
        heapq.heappush(heap, (filled + load, task))
    return plan


def _slot_values(spark: SparkSession, tasks: int) -> list[int]:
    """For each task an integer that Spark's hash partitioning sends to it."""
    rows = spark.range(tasks * 64).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("task"))
    found = {r["task"]: r["slot"] for r in rows.groupBy("task").agg(F.min("id").cast("int").alias("slot")).collect()}
    return [found.get(task, task) for task in range(tasks)]


class LoadPlan:
    """Which slot each key, or each shard of a large key, belongs to."""

    def __init__(self, df: DataFrame, keys: list[str], tasks: int):
        self.keys, self.tasks = keys, tasks
        spark = df.sparkSession
        loads, total = heavy_loads(df, keys, tasks * FINE)
        least = max(1, total // (tasks * FINE))
        self.plan = pack_loads([((key,), load) for key, load in loads if load > least], total, tasks)
        self.slots = _slot_values(spark, tasks)
        shards: dict[int, list[int]] = {}
        for (key,), _, task in self.plan:
            shards.setdefault(key, []).append(self.slots[task])
        self.table = spark.createDataFrame(list(shards.items()), "_key bigint, _slots array<int>")

    def _tail_slot(self):
        ids = F.array(*[F.lit(s) for s in self.slots])
        return ids[F.pmod(F.xxhash64(*self.keys), F.lit(self.tasks)).cast("int")]

    def fragment(self, df: DataFrame, within: list[str]) -> DataFrame:
        """Adds _slot, and _split for keys in several slots, and moves each row to its task; rows equal in ``within`` stay together."""
        part = F.pmod(F.xxhash64(*within), F.size("_slots")).cast("int")
        slotted = self._with_slots(df).withColumn(
            "_slot", F.when(F.col("_slots").isNotNull(), F.col("_slots")[part]).otherwise(self._tail_slot())
        )
        slotted = slotted.withColumn("_split", F.coalesce(F.size("_slots") > 1, F.lit(False)))
        return slotted.drop("_slots", "_key").repartition(self.tasks, "_slot")

    def _with_slots(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_key", F.when(_all_set(self.keys), key_hash(self.keys))).join(F.broadcast(self.table), "_key", "left")

    def replicate(self, side: DataFrame) -> DataFrame:
        """The matching side, once for each slot that holds its key."""
        slotted = self._with_slots(side)
        spread = F.when(F.col("_slots").isNotNull(), F.array_distinct("_slots")).otherwise(F.array(self._tail_slot()))
        return slotted.withColumn("_slot", F.explode(spread)).drop("_slots", "_key").repartition(self.tasks, "_slot")


def _all_set(keys: list[str]):
    test = F.lit(True)
    for key in keys:
        test = test & F.col(key).isNotNull()
    return test


def task_count(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def edge_profile(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(target, kind, n_edges, n_sources, first_at, last_at) of every target and kind.

    n_edges counts different (source, target, kind), n_sources different
    sources. Null targets, kinds and sources are values of their own; a null
    source counts as an edge but not as a source. An empty table gives no rows.
    """
    edges = edges.select("source", "target", "kind", "created_at")
    plan = LoadPlan(edges, ["target", "kind"], tasks or task_count(edges.sparkSession))
    # Repeated edges are combined before they move; every one is a group of its own, so no group is hot.
    unique = edges.groupBy("target", "kind", "source").agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    shards = plan.fragment(unique, ["source"]).groupBy("_slot", "target", "kind").agg(
        F.count("*").alias("n_edges"), F.count("source").alias("n_sources"), F.min("a").alias("first_at"), F.max("b").alias("last_at"), F.max("_split").alias("_split")
    )
    return merged(shards, ["target", "kind"], n_edges=F.sum, n_sources=F.sum, first_at=F.min, last_at=F.max)


def merged(shards: DataFrame, keys: list[str], **combine) -> DataFrame:
    """The rows of the keys: keys in one slot are whole already, only the shards of split keys are combined.

    ``_split`` must be an aggregate of the shards, so that both branches read one shuffle.
    """
    whole = shards.where("not _split").select(*keys, *combine)
    parts = shards.where("_split").groupBy(*keys).agg(*[f(name).alias(name) for name, f in combine.items()])
    return whole.unionByName(parts)


def dominant_keys(profile: DataFrame, share: float = 0.01) -> DataFrame:
    """(target, kind) with at least ``share`` of all different edges; at most 1 / share rows."""
    total = profile.agg(F.sum("n_edges").alias("_total"))
    return profile.join(F.broadcast(total), F.col("n_edges") >= F.lit(share) * F.col("_total")).select("target", "kind")


def edge_profile_named(edges: DataFrame, names: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows per target, kind and target name, the matching side replicated to the shards.

    ``names`` is (target, target_name) with one row per target.
    """
    edges = edges.select("source", "target", "kind")
    plan = LoadPlan(edges, ["target"], tasks or task_count(edges.sparkSession))
    placed = plan.fragment(edges, ["source"])
    matched = placed.join(plan.replicate(names.select("target", "target_name")).hint("shuffle_hash"), ["_slot", "target"], "left")
    shards = matched.groupBy("_slot", "target", "target_name", "kind").agg(F.count("*").alias("n_rows"), F.max("_split").alias("_split"))
    return merged(shards, ["target", "target_name", "kind"], n_rows=F.sum)
