"""Parent-child links to full hierarchies, and the links that never end.

Only inner symbols (those that have children) take part in the rounds: the
leaves, most of all rows, are peeled first and are answered by one join with
their parent at the end. What is left is peeled a few more times; long chains
would need one round per level, so the rest is ranked by pointer doubling,
whose rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.session import Scratch
from loomgraph.tables import blank_to_null, current_rows

PEEL_ROUNDS = 4
SIBLINGS_A_BUCKET = 20_000


def parent_links(nodes: DataFrame) -> DataFrame:
    """(id, parent) of each current symbol; parent is null where '' or null."""
    return current_rows(nodes, "id", "seq", "parent_id").select("id", blank_to_null("parent_id").alias("parent"))


def inner_links(links: DataFrame) -> DataFrame:
    """The rows of those ids that are somebody's parent."""
    parents = links.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    return links.join(parents, "id", "left_semi")


def _peel(scratch: Scratch, inner: DataFrame, rounds: int) -> tuple[list[DataFrame], int]:
    """Removes leaves, at most ``rounds`` times: the table before each round and after the last."""
    layers, left = [inner], inner.count()
    for _ in range(rounds):
        smaller, found = scratch.counted(inner_links(layers[-1]))
        before, left = left, found["rows"]
        layers.append(smaller)
        if left == before or not left:
            break
    return layers, left


def _descend(links: DataFrame, endless: DataFrame) -> DataFrame:
    """``endless`` and the rows of ``links`` right below it; on a ring the distance 0 wins."""
    above = endless.select(F.col("id").alias("parent"), "cycle_id", (F.col("steps") + 1).alias("steps"))
    return (
        links.join(above, "parent")
        .select("id", "cycle_id", "steps")
        .unionByName(endless)
        .groupBy("id")
        .agg(F.min("cycle_id").alias("cycle_id"), F.min("steps").cast("int").alias("steps"))
    )


def never_ending(scratch: Scratch, inner: DataFrame) -> DataFrame:
    """(id, cycle_id, steps) of the inner symbols whose parents never end.

    ``inner`` is a written table of inner_links. Peeling leaves removes whole
    branches; doubling then drops every row whose chain has ended. The rest is
    closed under "parent of" exactly when no chain in it ends. From then on the
    smallest ids seen only change while a ring isn't gone round once, and the
    ids that are still hopped to get fewer while some of them lie before a
    ring. When neither happens any more all hops are on rings, so the rounds
    are the logarithm of the longest chain or ring, however many ids there are.
    """
    layers, left = _peel(scratch, inner, PEEL_ROUNDS)
    core, spark = layers[-1], scratch.spark
    empty = spark.createDataFrame([], "id string, cycle_id string, steps int")
    if not left:
        return empty
    # hop = id after 2^k steps; low = smallest id among the 2^k ids from here on
    jumps = core.select("id", "parent", F.col("parent").alias("hop"), F.col("id").alias("low"), F.lit(True).alias("lower"))
    known_closed, hops, before = False, None, None
    while True:
        other = jumps.select(F.col("id").alias("hop"), F.col("hop").alias("_hop"), F.col("low").alias("_low"))
        least = F.least("low", "_low")
        joined = jumps.join(other, "hop").select("id", "parent", F.col("_hop").alias("hop"), least.alias("low"), (least < F.col("low")).alias("lower"))
        following, found = scratch.counted(joined, lower=F.count_if("lower"))
        scratch.drop(jumps)
        jumps = following
        if not found["rows"]:
            return empty
        if not known_closed:
            known_closed = jumps.join(jumps.select(F.col("id").alias("parent")), "parent", "left_anti").isEmpty()
        if known_closed and not found["lower"]:
            hops, before = scratch.counted(jumps.select(F.col("hop").alias("id")).distinct()), hops
            if before and before[1]["rows"] == hops[1]["rows"]:
                break
    rings = scratch.write(
        hops[0].join(jumps.select("id", F.col("low").alias("cycle_id")), "id")
    )
    # Each ring is cut: its ids are ends with distance 0, all others are ranked against them.
    tails = (
        jumps.join(rings.select("id", "cycle_id"), "id", "left")
        .select(
            "id",
            F.when(F.col("cycle_id").isNull(), F.col("parent")).alias("hop"),
            F.when(F.col("cycle_id").isNull(), 1).otherwise(0).alias("steps"),
            F.coalesce("cycle_id", F.lit(None).cast("string")).alias("cycle_id"),
        )
    )
    ranked, found = scratch.counted(tails, open=F.count("hop"))
    while found["open"]:
        other = ranked.select(
            F.col("id").alias("hop"), F.col("hop").alias("_hop"), F.col("steps").alias("_steps"), F.col("cycle_id").alias("_cycle")
        )
        following, found = scratch.counted(
            ranked.join(other, "hop", "left").select(
                "id",
                F.col("_hop").alias("hop"),
                (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
                F.coalesce("cycle_id", "_cycle").alias("cycle_id"),
            ),
            open=F.count("hop"),
        )
        scratch.drop(ranked)
        ranked = following
    endless = ranked.select("id", "cycle_id", "steps")
    for layer in reversed(layers[:-1]):
        endless = scratch.write(_descend(layer, endless))
    return endless


def cyclic(nodes: DataFrame) -> DataFrame:
    """(id, cycle_id, steps) of every current symbol whose chain of parents never ends.

    null and '' are no parent; a parent that is not stored ends the chain;
    repeated rows count once by the highest seq; rows without id are left out;
    an empty table gives no rows.
    """
    scratch = Scratch(nodes.sparkSession)
    links = scratch.write(parent_links(nodes))
    inner = scratch.write(inner_links(links))
    return _descend(links, never_ending(scratch, inner))


def _double(scratch: Scratch, ranked: DataFrame) -> DataFrame:
    """Pointer doubling to the root: (id, hop, path) until no pointer is left."""
    open_ones = True
    while open_ones:
        other = ranked.select(F.col("id").alias("hop"), F.col("hop").alias("_hop"), F.col("path").alias("_path"))
        following, found = scratch.counted(
            ranked.join(other, "hop", "left").select(
                "id",
                F.col("_hop").alias("hop"),
                F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"),
            ),
            open=F.count("hop"),
        )
        scratch.drop(ranked)
        ranked, open_ones = following, found["open"]
    return ranked


def _tour(inner: DataFrame, leaves: DataFrame) -> DataFrame:
    """Elements of the Euler tours of the inner symbols: (el, next, weight, mark).

    An entry weighs one plus its leaves, an exit one; mark counts entries.

    Siblings are linked in the order of their ids within buckets of bounded
    size, and the buckets with each other, so that a parent with very many
    children is never sorted by one task.
    """
    sizes = inner.where("parent is not null").groupBy("parent").agg(F.ceil(F.count("*") / SIBLINGS_A_BUCKET).alias("buckets"))
    kids = (
        inner.where("parent is not null")
        .join(sizes, "parent")
        .select("parent", "id", F.expr("pmod(xxhash64(id), buckets)").alias("bucket"))
    )
    in_bucket = Window.partitionBy("parent", "bucket").orderBy("id")
    linked = kids.select("parent", "id", "bucket", F.lead("id").over(in_bucket).alias("next"))
    firsts = kids.groupBy("parent", "bucket").agg(F.min("id").alias("first"))
    chain = firsts.select(
        "parent", "bucket", "first", F.lead("first").over(Window.partitionBy("parent").orderBy("bucket")).alias("after")
    )
    heads = chain.groupBy("parent").agg(F.min_by("first", "bucket").alias("first"))
    exits = linked.join(chain.select("parent", "bucket", "after"), ["parent", "bucket"]).select(
        F.concat(F.lit(")"), "id").alias("el"),
        F.coalesce(F.concat(F.lit("("), F.coalesce("next", "after")), F.concat(F.lit(")"), "parent")).alias("next"),
        F.lit(1).cast("long").alias("weight"),
        F.lit(0).cast("long").alias("mark"),
    )
    roots = inner.where("parent is null").select(
        F.concat(F.lit(")"), "id").alias("el"),
        F.lit(None).cast("string").alias("next"),
        F.lit(1).cast("long").alias("weight"),
        F.lit(0).cast("long").alias("mark"),
    )
    counts = leaves.groupBy("parent").agg(F.count("*").alias("leaves"))
    enters = (
        inner.select("id")
        .join(heads.withColumnRenamed("parent", "id"), "id", "left")
        .join(counts.withColumnRenamed("parent", "id"), "id", "left")
        .select(
            F.concat(F.lit("("), "id").alias("el"),
            F.coalesce(F.concat(F.lit("("), "first"), F.concat(F.lit(")"), "id")).alias("next"),
            (1 + F.coalesce("leaves", F.lit(0))).cast("long").alias("weight"),
            F.lit(1).cast("long").alias("mark"),
        )
    )
    return enters.unionByName(exits).unionByName(roots)


def _list_rank(scratch: Scratch, tour: DataFrame) -> DataFrame:
    """(el, rank, marks): weights and marks from each element to the end of its list."""
    ranked, found = scratch.counted(tour.select("el", "next", F.col("weight").alias("rank"), F.col("mark").alias("marks")), open=F.count("next"))
    while found["open"]:
        other = ranked.select(F.col("el").alias("next"), F.col("next").alias("_next"), F.col("rank").alias("_rank"), F.col("marks").alias("_marks"))
        following, found = scratch.counted(
            ranked.join(other, "next", "left").select(
                "el",
                F.col("_next").alias("next"),
                (F.col("rank") + F.coalesce("_rank", F.lit(0))).alias("rank"),
                (F.col("marks") + F.coalesce("_marks", F.lit(0))).alias("marks"),
            ),
            open=F.count("next"),
        )
        scratch.drop(ranked)
        ranked = following
    return ranked.select("el", "rank", "marks")


def hierarchy(nodes: DataFrame) -> DataFrame:
    """Every current symbol with root, depth, path, interval and number of symbols below.

    Columns: id, root_id, depth, path (array from the root to the symbol),
    entry, exit, n_below, cycle_id. The symbols below x are those of the same
    root with ``x.entry < entry <= x.exit``; intervals come from ranking Euler
    tours. For symbols whose parents never end, only id and cycle_id are set.
    """
    scratch = Scratch(nodes.sparkSession)
    links = scratch.write(parent_links(nodes))
    inner_all = scratch.write(inner_links(links))
    endless = never_ending(scratch, inner_all)
    inner = inner_all.join(endless.select("id"), "id", "left_anti")
    # A parent that isn't stored ends the chain: its children are roots.
    stored = inner.select(F.col("id").alias("parent"), F.lit(True).alias("stored"))
    inner = scratch.write(
        inner.join(stored, "parent", "left").select("id", F.when(F.col("stored"), F.col("parent")).alias("parent"))
    )
    paths = _double(scratch, scratch.write(inner.select("id", F.col("parent").alias("hop"), F.array("id").alias("path"))))
    leaves = links.join(inner_all.select("id"), "id", "left_anti")
    known = leaves.join(inner.select(F.col("id").alias("parent")), "parent", "left_semi")
    ranks = _list_rank(scratch, _tour(inner, known))
    enters = ranks.where("el like '(%'").select(F.expr("substr(el, 2)").alias("id"), F.col("rank").alias("r_in"), F.col("marks").alias("m_in"))
    exits = ranks.where("el like ')%'").select(F.expr("substr(el, 2)").alias("id"), F.col("rank").alias("r_out"), F.col("marks").alias("m_out"))
    placed = paths.select("id", "path", F.col("path")[0].alias("root_id")).join(enters, "id").join(exits, "id")
    totals = placed.where("id = root_id").select("root_id", F.col("r_in").alias("total"))
    placed = scratch.write(
        placed.join(totals, "root_id").select(
            "id",
            "root_id",
            "path",
            (F.col("total") - F.col("r_in")).alias("entry"),
            (F.col("total") - F.col("r_out")).alias("close"),
            (F.col("m_in") - F.col("m_out") - 1).alias("inner_below"),
        )
    )
    # A subtree holds two elements per inner symbol and one per leaf.
    inner_rows = placed.select(
        "id",
        "root_id",
        (F.size("path") - 1).alias("depth"),
        "path",
        "entry",
        F.col("close").alias("exit"),
        (F.col("close") - F.col("entry") - 1 - F.col("inner_below")).alias("n_below"),
        F.lit(None).cast("string").alias("cycle_id"),
    )
    per_bucket = Window.partitionBy("parent", "bucket").orderBy("id")
    bucketed = _with_buckets(known)
    offsets = bucketed.groupBy("parent", "bucket").agg(F.count("*").alias("n"))
    offsets = offsets.select(
        "parent",
        "bucket",
        F.coalesce(
            F.sum("n").over(Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("offset"),
    )
    leaf_rows = (
        bucketed.withColumn("nth", F.row_number().over(per_bucket))
        .join(offsets, ["parent", "bucket"])
        .join(
            placed.select(
                F.col("id").alias("parent"), "root_id", F.col("path").alias("above"), F.col("entry").alias("start")
            ),
            "parent",
        )
        .select(
            "id",
            "root_id",
            F.size("above").alias("depth"),
            F.concat("above", F.array("id")).alias("path"),
            (F.col("start") + F.col("offset") + F.col("nth")).alias("entry"),
            (F.col("start") + F.col("offset") + F.col("nth")).alias("exit"),
            F.lit(0).cast("long").alias("n_below"),
            F.lit(None).cast("string").alias("cycle_id"),
        )
    )
    lone = leaves.join(inner_all.select(F.col("id").alias("parent")), "parent", "left_anti").select(
        "id",
        F.col("id").alias("root_id"),
        F.lit(0).alias("depth"),
        F.array("id").alias("path"),
        F.lit(0).cast("long").alias("entry"),
        F.lit(0).cast("long").alias("exit"),
        F.lit(0).cast("long").alias("n_below"),
        F.lit(None).cast("string").alias("cycle_id"),
    )
    looped = endless.select("id", "cycle_id").unionByName(
        leaves.join(endless.select(F.col("id").alias("parent"), "cycle_id"), "parent").select("id", "cycle_id")
    )
    looped = looped.select(
        "id",
        *[F.lit(None).cast(kind).alias(name) for name, kind in (("root_id", "string"), ("depth", "int"), ("path", "array<string>"), ("entry", "long"), ("exit", "long"), ("n_below", "long"))],
        "cycle_id",
    )
    return inner_rows.unionByName(leaf_rows).unionByName(lone).unionByName(looped)


def _with_buckets(kids: DataFrame) -> DataFrame:
    sizes = kids.groupBy("parent").agg(F.ceil(F.count("*") / SIBLINGS_A_BUCKET).alias("buckets"))
    return kids.join(sizes, "parent").select("parent", "id", F.expr("pmod(xxhash64(id), buckets)").alias("bucket"))


def ancestors(tree: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance) for every symbol and every symbol above it, from hierarchy()."""
    steps = tree.where("path is not null").select("id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return steps.where("at < depth").select("ancestor_id", "id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def below(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """(ancestor_id, id) of the symbols below the given ids, by their intervals.

    An interval is laid out in blocks whose length is a power of two, at most
    two of each length; a symbol lies in one block of each length. So the
    interval join is an equi-join on root, length and block, and a large root
    isn't paired with all its symbols.
    """
    tops = tree.join(ids.select("id").distinct(), "id", "left_semi").where("entry < exit").select(F.col("id").alias("ancestor_id"), "root_id", (F.col("entry") + 1).alias("a"), (F.col("exit") + 1).alias("b"))
    longest = tops.agg(F.max(F.expr("b - a"))).first()[0]
    if not longest:
        return tops.select("ancestor_id", F.col("ancestor_id").alias("id")).where("false")
    levels = F.explode(F.sequence(F.lit(0), F.lit(int(longest).bit_length()))).alias("k")
    # [a, b): on level k the block at either end is taken if it doesn't fill a block of level k + 1 inside the interval.
    size = F.expr("shiftleft(1L, k)")
    left, right = F.ceil(F.col("a") / size).cast("long"), F.floor(F.col("b") / size).cast("long")
    cover = tops.select("ancestor_id", "root_id", "a", "b", levels).withColumn("l", left).withColumn("r", right).where("l < r")
    ends = F.array_compact(F.array_distinct(F.array(F.when(F.expr("l % 2 = 1"), F.col("l")), F.when(F.expr("r % 2 = 1"), F.col("r") - 1))))
    cover = cover.select("ancestor_id", "root_id", "k", F.explode(ends).alias("block"))
    placed = tree.where("entry is not null").select("id", "root_id", "entry", levels).select("id", "root_id", "k", F.floor(F.col("entry") / size).cast("long").alias("block"))
    return placed.join(cover, ["root_id", "k", "block"]).select("ancestor_id", "id")
