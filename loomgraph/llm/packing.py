"""Documents into containers of fixed capacity, every window with the same mixture of sources.

Deficit round-robin over one queue per source: each window gives a source its
quantum, the window's tokens times the source's share, and what a document
takes beyond it is owed to the windows after it. Written down over all rounds,
the window of an item is its position in its queue divided by the quantum; the
position carries every deficit across windows and partitions, and is found by
prefix sums over buckets, in parallel. Within a window, whose size is bounded,
items are packed by best fit, largest first.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.queues import bucket_count, queue_positions
from loomgraph.llm.tokens import TOKENIZER, token_counts
from loomgraph.session import Scratch

CONTAINERS_A_WINDOW = 128


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item: largest items first, each where least room is left after it."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    room: list[tuple[int, int]] = []  # (room left, container), ascending
    where = [0] * len(sizes)
    opened = 0
    for i in order:
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, container = room.pop(at)
        else:
            left, container = capacity, opened
            opened += 1
        where[i] = container
        bisect.insort(room, (left - sizes[i], container))
    return where


def _pack_window(window: pd.DataFrame) -> pd.DataFrame:
    window = window.sort_values(["doc_id", "piece"], kind="stable")
    places = best_fit(window["tokens"].tolist(), int(window["capacity_tokens"].iloc[0]))
    prefix = f"{window['profile'].iloc[0]}-{window['window'].iloc[0]}-"
    return window.assign(container_id=[f"{prefix}{p}" for p in places])[["profile", "doc_id", "source", "piece", "n_pieces", "token_from", "tokens", "container_id"]]


_DDL = "profile string, doc_id bigint, source string, piece int, n_pieces int, token_from bigint, tokens bigint, container_id string"


def pack(counts: DataFrame, capacities: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """(profile, doc_id, source, piece, n_pieces, token_from, tokens, container_id) for every document and profile.

    ``counts`` is (doc_id, source, tokens); ``shares`` (source, share) are the
    target proportions of every window, by default those of all tokens, so that
    all queues end together. Sources that ``shares`` doesn't name keep their
    natural share, and the named ones divide the rest; a queue that ends early
    leaves its room in later windows to the others. A document larger than a container is cut into
    full containers and a rest, which is packed like a document; no other is
    split. Documents without tokens (null or '') get a null container; a
    capacity that is null or below 1 gives its documents null containers too.
    Repeated doc_ids are packed row by row. Null sources form a queue.
    """
    scratch = Scratch(counts.sparkSession)
    counts = counts.select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), F.col("tokens").cast("bigint"))
    buckets = bucket_count(counts.count())
    everything = float(counts.agg(F.sum("tokens")).first()[0] or 1)
    natural = counts.groupBy("source").agg((F.sum("tokens") / everything).alias("share"))
    if shares is None:
        shares = natural
    else:
        named = shares.select(F.lower(F.trim("source")).alias("source"), "share").where("share > 0").groupBy("source").agg(F.sum("share").alias("share")).join(natural.select("source"), "source", "left_semi")
        others = natural.join(named, "source", "left_anti")
        weights = float(named.agg(F.sum("share")).first()[0] or 1)
        room = 1 - float(others.agg(F.sum("share")).first()[0] or 0)
        shares = named.withColumn("share", F.col("share") / weights * room).unionByName(others)
    settings = profile_settings(capacities)
    usable, unusable = [s for s in settings if (s[1] or 0) >= 1], [s for s in settings if (s[1] or 0) < 1]
    sized = for_each_profile(counts.where("tokens > 0"), usable).withColumn("n_pieces", F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("int"))
    items = sized.select("*", F.explode(F.expr("sequence(0, n_pieces - 1)")).alias("piece")).withColumn("token_from", F.col("piece") * F.col("capacity_tokens"))
    items = items.withColumn("tokens", F.least(F.col("tokens") - F.col("token_from"), F.col("capacity_tokens"))).withColumn(
        "queue", F.concat_ws("\x1f", "profile", "source")
    )
    placed = queue_positions(items, "queue", "tokens", ["doc_id", "token_from"], buckets).join(shares, "source")
    quantum = F.col("share") * F.col("capacity_tokens") * CONTAINERS_A_WINDOW
    phase = F.pmod(F.xxhash64("queue"), F.lit(1 << 20)) / float(1 << 20)
    windows = placed.withColumn("window", F.floor(F.col("before") / quantum + phase).cast("bigint")).drop("queue", "before", "share")
    packed = scratch.write(windows.groupBy("profile", "window").applyInPandas(_pack_window, _DDL))
    empty = for_each_profile(counts.where("tokens is null or tokens = 0"), settings)
    bad = for_each_profile(counts.where("tokens > 0"), unusable)
    nowhere = empty.unionByName(bad).select(
        "profile", "doc_id", "source", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).cast("bigint").alias("token_from"),
        F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("container_id"),
    )
    return packed.unionByName(nowhere)


MAX_PROFILES = 1_000


def profile_settings(capacities: DataFrame) -> list[tuple[str, int | None]]:
    """The profiles: a table of settings that every document meets, so their number is checked."""
    rows = capacities.where("profile is not null").groupBy("profile").agg(F.max("capacity_tokens").alias("c")).orderBy("profile").limit(MAX_PROFILES + 1).collect()
    if len(rows) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    return [(r["profile"], r["c"]) for r in rows]


def for_each_profile(df: DataFrame, settings: list[tuple[str, int | None]]) -> DataFrame:
    """Every row once for each profile, with its capacity."""
    if not settings:
        return df.select("*", F.lit("").alias("profile"), F.lit(0).cast("bigint").alias("capacity_tokens")).where("false")
    each = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).cast("bigint").alias("capacity_tokens")) for p, c in settings])
    return df.select("*", F.explode(each).alias("_p")).select("*", "_p.profile", "_p.capacity_tokens").drop("_p")


def pack_documents(documents: DataFrame, capacities: DataFrame, shares: DataFrame | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    counts = Scratch(documents.sparkSession).write(token_counts(documents, tokenizer))
    return pack(counts, capacities, shares)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per profile: containers, tokens, the share of room that is used, and split documents."""
    used = packed.where("container_id is not null").groupBy("profile").agg(
        F.countDistinct("container_id").alias("n_containers"),
        F.sum("tokens").alias("n_tokens"),
        F.sum(((F.col("n_pieces") > 1) & (F.col("piece") == 0)).cast("long")).alias("n_split"),
    )
    return used.join(capacities, "profile").select(
        "profile", "n_containers", "n_tokens", "n_split", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill")
    )


def mixture_report(packed: DataFrame) -> DataFrame:
    """Per profile and source: the share of all packed tokens and how far windows are from it on average."""
    rows = packed.where("container_id is not null").withColumn("window", F.expr("element_at(split(container_id, '-'), -2)"))
    cells = rows.groupBy("profile", "window", "source").agg(F.sum("tokens").alias("t"))
    per_window = cells.groupBy("profile", "window").agg(F.sum("t").alias("w"))
    per_source = cells.groupBy("profile", "source").agg(F.sum("t").alias("s"))
    per_profile = per_source.groupBy("profile").agg(F.sum("s").alias("p"))
    joined = cells.join(per_window, ["profile", "window"]).join(per_source, ["profile", "source"]).join(F.broadcast(per_profile), "profile")
    share = F.col("s") / F.col("p")
    return joined.groupBy("profile", "source").agg(
        F.round(F.first(share), 6).alias("share"), F.round(F.sum(F.abs(F.col("t") / F.col("w") - share) * F.col("w")) / F.sum("w"), 6).alias("mean_deviation"), F.count("*").alias("n_windows")
    )


def target_report(packed: DataFrame) -> DataFrame:
    """(profile, source, share, mean_deviation, max_deviation, n_windows) while no queue of the profile has ended.

    ``share`` is the source's share of the tokens of these windows, the
    deviations are those of single windows from it. The first window of a
    profile is left out, since its queues begin at different places in it; a
    profile without a whole window has n_windows 0 and nulls.
    """
    rows = packed.where("container_id is not null").withColumn("window", F.expr("cast(element_at(split(container_id, '-'), -2) as bigint)"))
    cells = rows.groupBy("profile", "window", "source").agg(F.sum("tokens").alias("t"))
    ends = cells.groupBy("profile", "source").agg(F.max("window").alias("w")).groupBy("profile").agg(F.min("w").alias("end"))
    cells = cells.join(F.broadcast(ends), "profile").where("window > 0 and window < end")
    per_window = cells.groupBy("profile", "window").agg(F.sum("t").alias("w"))
    total = cells.groupBy("profile").agg(F.sum("t").alias("p"))
    whole = cells.groupBy("profile", "source").agg(F.sum("t").alias("s")).join(F.broadcast(total), "profile").select("profile", "source", (F.col("s") / F.col("p")).alias("share"))
    off = F.abs(F.col("t") / F.col("w") - F.col("share"))
    joined = cells.join(per_window, ["profile", "window"]).join(whole, ["profile", "source"])
    found = joined.groupBy("profile", "source").agg(F.round(F.first("share"), 6).alias("share"), F.round(F.avg(off), 6).alias("mean_deviation"), F.round(F.max(off), 6).alias("max_deviation"), F.count("*").alias("n_windows"))
    sources = rows.select("profile", "source").distinct()
    return sources.join(found, ["profile", "source"], "left").withColumn("n_windows", F.coalesce("n_windows", F.lit(0)))
