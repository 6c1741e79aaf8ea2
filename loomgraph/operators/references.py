"""References to records that do not exist, are deleted, or arrive later.

A Bloom filter of the stored ids, whose size has a fixed bound, is broadcast:
what it doesn't hold is certainly not stored and needs no join. Only the rest
is joined exactly. Of those, only references to ids that were ever deleted need
the order of events: they are held against the times in which an id was gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.session import Scratch

# Words of 64 bits in the broadcast filter: at most 2^22, or 32 MB. A false hit
# only means one exact lookup more, so few bits a key are enough.
MAX_FILTER_WORDS = 1 << 22
CHUNK_WORDS = 1 << 10
BITS_PER_KEY = 6
PROBES = 3
# Rows up to which a side table is broadcast after its size was checked.
SMALL_TABLE_ROWS = 10_000
# Ends with these prefixes name things kept outside the tables.
OUTSIDE = ("tx:", "cache:", "config:", "topic:")


def micros(column: str):
    """Microseconds of a timestamp column, with or without a zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def _word_and_mask(key: str, words: int):
    hashed = F.xxhash64(F.col(key))
    word = F.pmod(hashed, F.lit(words))
    other = F.xxhash64(F.col(key), F.lit(1))
    mask = None
    for probe in range(PROBES):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", other, F.lit(6 * probe)).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return word, mask


def filter_words(keys: int) -> int | None:
    """Words of a filter for so many keys; None where it would grow beyond the bound of a broadcast."""
    words = max(CHUNK_WORDS, -(-keys * BITS_PER_KEY // 64))
    return words if words <= MAX_FILTER_WORDS else None


def bloom_filter(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(chunk, words): a blocked Bloom filter, CHUNK_WORDS words of 64 bits a row. A key sets a few bits of one word."""
    word, mask = _word_and_mask(key, words)
    rows = keys.where(F.col(key).isNotNull()).select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    place = F.struct((F.col("_word") % CHUNK_WORDS).cast("int").alias("k"), F.col("_bits").alias("v"))
    chunks = rows.groupBy((F.col("_word") / CHUNK_WORDS).cast("int").alias("_chunk")).agg(F.map_from_entries(F.collect_list(place)).alias("_m"))
    return chunks.select("_chunk", F.expr(f"transform(sequence(0, {CHUNK_WORDS - 1}), i -> coalesce(element_at(_m, i), 0L))").alias("_words"))


def probe(df: DataFrame, key: str, rows: DataFrame | None, words: int | None, flag: str) -> DataFrame:
    """Adds ``flag``: false where the key is certainly not in the filter; true for all without one."""
    if words is None:
        return df.withColumn(flag, F.lit(True))
    word, mask = _word_and_mask(key, words)
    placed = df.select("*", word.alias("_word"), mask.alias("_mask")).withColumn("_chunk", (F.col("_word") / CHUNK_WORDS).cast("int"))
    probed = placed.join(F.broadcast(rows), "_chunk", "left")
    bits = F.col("_words")[(F.col("_word") % CHUNK_WORDS).cast("int")]
    hit = F.coalesce(bits.bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return probed.withColumn(flag, hit).drop("_chunk", "_word", "_mask", "_words")


# Where a reference stands, by the number that is carried through the joins.
PLACES = (("edges", "source"), ("edges", "target"), ("nodes", "parent_id"))


def all_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(place, ref, seq, t): every reference of every row, repeated and outdated ones too; place counts in PLACES."""
    pair = F.explode(F.array(*[F.struct(F.lit(at).cast("byte").alias("place"), F.col(name).alias("ref")) for at, name in enumerate(("source", "target"))]))
    ends = edges.select("seq", F.col("created_at").alias("t"), pair.alias("end")).select("end.place", "end.ref", "seq", "t")
    for prefix in OUTSIDE:
        ends = ends.where(~F.col("ref").startswith(prefix))
    parents = nodes.select(F.lit(2).cast("byte").alias("place"), F.col("parent_id").alias("ref"), "seq", F.col("created_at").alias("t"))
    return ends.unionByName(parents).where("ref is not null and ref != ''")


def next_event(left: DataFrame, right: DataFrame, keys: list[str], at: str, when: str, out: str) -> DataFrame:
    """As-of join forwards: the first ``right.when`` of the same keys that is later than ``left.at``.

    Windows hold one key and one day; days are carried over by an aggregate of
    one row per key and day.
    """
    day = lambda c: F.to_date(F.timestamp_micros(F.col(c))).alias("_day")
    marks = right.select(*keys, F.col(when).alias("_when"), day(when)).distinct()
    per_day = left.select(*keys, day(at)).distinct().withColumn("_first", F.lit(None).cast("long")).unionByName(
        marks.select(*keys, "_day", F.col("_when").alias("_first"))
    ).groupBy(*keys, "_day").agg(F.min("_first").alias("_first"))
    ahead = Window.partitionBy(*keys).orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    carried = per_day.select(*keys, "_day", F.min("_first").over(ahead).alias("_carried"))
    both = left.withColumn("_day", day(at)).withColumn("_at", F.col(at)).withColumn("_when", F.lit(None).cast("long")).unionByName(
        marks.withColumn("_at", F.col("_when")), allowMissingColumns=True
    ).withColumn("_left", F.col("_when").isNull())
    within = Window.partitionBy(*keys, "_day").orderBy("_at").rangeBetween(1, Window.unboundedFollowing)
    found = both.withColumn("_same", F.min("_when").over(within)).where("_left")
    joined = found.join(carried, [*keys, "_day"], "left").withColumn(out, F.coalesce("_same", "_carried"))
    return joined.drop("_day", "_at", "_when", "_left", "_same", "_carried")


def broken_references(edges: DataFrame, nodes: DataFrame, external_symbols: DataFrame, file_changes: DataFrame) -> DataFrame:
    """(ref_table, ref_field, seq, status, period): one row per reference that is missing, late or deleted.

    Nulls: a null or '' reference is none; a referring row without created_at
    can only be ``missing`` and has a null period; a stored row without
    created_at counts as stored from the start; reports without path or time
    are left out. Empty tables give no rows, or ``missing`` for everything
    that refers to them.
    """
    scratch = Scratch(edges.sparkSession)
    stored = nodes.where("id is not null and id != ''").select("id", micros("created_at").alias("c"), "file_path")
    early = F.lit(-(1 << 62)).cast("long")
    external = external_symbols.where("id is not null").groupBy("id").agg(F.min(F.coalesce(micros("created_at"), early)).alias("x_first"))
    small = external.limit(SMALL_TABLE_ROWS + 1).count() <= SMALL_TABLE_ROWS
    side = (F.broadcast(external) if small else external).withColumnRenamed("id", "ref")

    gone = absences(stored, file_changes)
    gone = scratch.write(gone)
    mortal = gone.select("id").distinct().withColumn("mortal", F.lit(True))
    summary = stored.groupBy("id").agg(F.min(F.coalesce("c", early)).alias("n_first")).join(mortal, "id", "left").withColumnRenamed("id", "ref")
    summary, found = scratch.counted(summary)
    words = filter_words(found["rows"])
    rows = bloom_filter(summary, "ref", words) if words else None
    probed = probe(all_references(edges, nodes), "ref", rows, words, "maybe")

    def judged(df: DataFrame) -> DataFrame:
        first = F.when(F.col("place") < 2, F.least("n_first", "x_first")).otherwise(F.col("n_first"))
        return df.withColumn("status", F.when(first.isNull(), "missing").when(first > micros("t"), "late"))

    kept = ["place", "ref", "seq", "t", "status"]
    absent = judged(probed.where("not maybe").join(side, "ref", "left").withColumn("n_first", F.lit(None).cast("long"))).where("status is not null").select(*kept)
    present = judged(probed.where("maybe").drop("maybe").join(summary, "ref", "left").join(side, "ref", "left"))
    # Only what is broken, or may be deleted, goes on; both come out of one pass.
    open_ones = scratch.write(present.where("status is not null or (mortal and t is not null)").select(*kept).unionByName(absent))
    pending = open_ones.where("status is null").withColumn("u", micros("t")).withColumn("month", F.date_trunc("month", F.timestamp_micros("u")))
    last = gone.where("until is null").groupBy("id").agg(F.min("since").alias("since")).select(F.col("id").alias("ref"), F.col("since").alias("for_good"))
    between = gone.where("until is not null").select(F.col("id").alias("ref"), "since", "until", F.explode(F.expr("sequence(date_trunc('month', timestamp_micros(since)), date_trunc('month', timestamp_micros(until)), interval 1 month)")).alias("month"))
    again = pending.join(between, ["ref", "month"]).where("u >= since and u < until").select(*kept)
    ended = pending.join(last, "ref").where("u >= for_good").select(*kept)
    deleted = again.unionByName(ended).withColumn("status", F.lit("deleted"))
    names = [F.element_at(F.array(*[F.lit(p[k]) for p in PLACES]), F.col("place").cast("int") + 1) for k in (0, 1)]
    return open_ones.where("status is not null").unionByName(deleted).select(
        names[0].alias("ref_table"), names[1].alias("ref_field"), "seq", "status", F.date_format("t", "yyyy-MM").alias("period")
    )


def absences(stored: DataFrame, file_changes: DataFrame) -> DataFrame:
    """(id, since, until): when an id was gone: from the first deletion of its file after it was stored until it is stored again.

    ``until`` is null where it never is. The times of one id don't overlap.
    """
    gone = file_changes.where("op = 'deleted' and path is not null and changed_at is not null").select(
        F.col("path").alias("file_path"), micros("changed_at").alias("d")
    ).distinct()
    versions = stored.where("c is not null and file_path is not null").join(gone.select("file_path").distinct(), "file_path", "left_semi").distinct()
    ends = next_event(versions, gone, ["file_path"], "c", "d", "since").groupBy("id", "c").agg(F.min("since").alias("since")).where("since is not null")
    times = stored.where("c is not null").join(ends.select("id").distinct(), "id", "left_semi").select("id", F.col("c").alias("_c")).distinct()
    return next_event(ends, times, ["id"], "c", "_c", "until").where("until is null or since < until").select("id", "since", "until")


def broken_reference_report(broken: DataFrame) -> DataFrame:
    """Count of broken references per table, field, month and state."""
    return broken.groupBy("ref_table", "ref_field", "period", "status").agg(F.count("*").alias("n_refs"))
