"""Documents drawn so that every source makes up its target share of all tokens.

1. Membership: a document with a source belongs to it; one without gets the
   posterior of a classifier that was fitted on labelled rows (naive Bayes over
   hashed tokens). Labels without a target are a class of their own, so a
   document that resembles no target is drawn for none.
2. Rates: nonnegative rates of use, at most max_repeats, whose expected tokens
   per source match the targets, by projected gradient steps on least squares.
   Documents with equal membership share a rate, so a step is one aggregate
   over groups; the steps so far are all that is handed from step to step.
3. Draw: the whole part of a rate is used for all, the rest for documents in a
   random order until the source's tokens are reached; what then still lacks is
   filled with ever smaller documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.queues import bucket_count, queue_positions
from loomgraph.llm.tokens import TOKENIZER, encode
from loomgraph.session import Scratch

FEATURES = 4096
EVIDENCE_TOKENS = 60  # long texts count as this many independent tokens
GRID = 20  # posteriors are rounded to 1 / GRID, so that equal ones share a rate
STEPS = 60
TOLERANCE = 1e-7
GROUPS_AT_ONCE = 50_000  # groups of equal membership that are solved in the driver; more are solved where they are
FIT_ROWS = 20_000  # labelled rows, about, that the classifier is fitted on
HIDDEN = 5  # one of so many labels, by a hash of the document, is hidden when the classifier is measured
FILL_ROUNDS = 3
MAX_SOURCES = 1_000


def target_settings(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, weight, max_repeats) of the targets, a table of settings whose size is checked."""
    cleaned = targets.select(F.lower(F.trim("source")).alias("source"), "weight", "max_repeats").where("source is not null and weight > 0")
    rows = cleaned.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have targets")
    return [(r["source"], float(r["weight"]), max(0, int(r["max_repeats"] if r["max_repeats"] is not None else 1))) for r in rows]


def _histogram(ids: list[int]) -> np.ndarray:
    return np.bincount(np.asarray(ids, dtype=np.int64) % FEATURES, minlength=FEATURES)


def _class_counts(labels: list[str], path: str):
    """Per partition one row for each label: its documents and its token histogram, the label '' for all others."""
    schema = pa.schema([("label", pa.string()), ("docs", pa.int64()), ("counts", pa.list_(pa.int64()))])
    places = {label: i for i, label in enumerate([*labels, ""])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros((len(places), FEATURES), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        for batch in batches:
            for source, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist()):
                at = places.get(source, len(labels))
                docs[at] += 1
                counts[at] += _histogram(encode(text, path))
        yield pa.RecordBatch.from_pydict({"label": list(places), "docs": docs.tolist(), "counts": counts.tolist()}, schema=schema)

    return run


class SourceClassifier:
    """Naive Bayes over hashed tokens; its size is labels x FEATURES, whatever the corpus."""

    def __init__(self, labels: list[str], docs: np.ndarray, counts: np.ndarray):
        self.labels = labels
        self.prior = np.log((docs + 1) / (docs.sum() + len(docs)))
        self.word = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * FEATURES))

    @classmethod
    def fit(cls, documents: DataFrame, labels: list[str], tokenizer: str = TOKENIZER) -> SourceClassifier:
        """From (doc_id, source, text): about FIT_ROWS labelled rows, chosen by a hash; labels without a target form one class, ''."""
        known = documents.where("source is not null and source != '' and text is not null and text != ''")
        every = max(1, -(-known.count() // FIT_ROWS))
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(every)) == 0).select("source", "text")
        parts = known.mapInArrow(_class_counts(labels, tokenizer), "label string, docs bigint, counts array<bigint>")
        cells = parts.select("label", "docs", F.posexplode("counts").alias("at", "n")).groupBy("label", "at").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        # One row for each label, with one number for each feature.
        rows = cells.groupBy("label").agg(F.max("docs").alias("docs"), F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda c: c["n"]).alias("counts")).toArrow().to_pylist()
        places = {label: i for i, label in enumerate([*labels, ""])}
        docs, counts = np.zeros(len(places)), np.zeros((len(places), FEATURES))
        for row in rows:
            docs[places[row["label"]]], counts[places[row["label"]]] = row["docs"], row["counts"]
        return cls([*labels, ""], docs, counts)

    def posterior(self, ids: list[int]) -> np.ndarray:
        counts = _histogram(ids)
        weight = min(1.0, EVIDENCE_TOKENS / max(1, counts.sum()))
        score = self.prior + weight * (self.word @ counts)
        p = np.exp(score - score.max())
        return p / p.sum()

    def member(self, ids: list[int]) -> list[float]:
        """The posterior on a grid, so that equal ones share a rate, still with the sum 1 over all classes."""
        p = np.round(self.posterior(ids) * GRID)
        return (p / p.sum()).tolist() if p.sum() else self.posterior(ids).tolist()


_MEMBERS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64()), ("member", pa.list_(pa.float64()))])


def _memberships(labels: list[str], model: SourceClassifier | None, path: str):
    places = {label: i for i, label in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            sizes, members = [], []
            for source, text in zip(rows["source"], rows["text"]):
                ids = encode(text, path) if text else []
                member = [0.0] * (len(labels))
                if source in places:
                    member[places[source]] = 1.0
                elif not source and ids and model is not None:
                    member = model.member(ids)[: len(labels)]
                sizes.append(len(ids))
                members.append(member)
            yield pa.RecordBatch.from_pydict({"doc_id": rows["doc_id"], "source": rows["source"], "tokens": sizes, "member": members}, schema=_MEMBERS)

    return run


def memberships(documents: DataFrame, labels: list[str], model: SourceClassifier | None, tokenizer: str = TOKENIZER) -> DataFrame:
    return documents.select("doc_id", "source", "text").mapInArrow(_memberships(labels, model, tokenizer), "doc_id bigint, source string, tokens bigint, member array<double>")


def rates_after(member: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rate of each row of ``member`` after the given gradient steps, each projected onto [0, cap]."""
    rate = np.zeros(len(member))
    for step in steps:
        rate = np.clip(rate - member @ step, 0.0, caps)
    return rate


def _expected(caps: list[int], steps: list[np.ndarray]):
    schema = pa.schema([("at", pa.int32()), ("tokens", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(caps))
        for batch in batches:
            if batch.num_rows:
                member = np.array(batch.column("member").to_pylist())
                tokens = np.array(batch.column("tokens").to_pylist(), dtype=float)
                rate = rates_after(member, member @ np.array(caps, dtype=float) / np.maximum(member.sum(axis=1), 1e-9), steps)
                total += (rate * tokens) @ member
        yield pa.RecordBatch.from_pydict({"at": list(range(len(caps))), "tokens": total.tolist()}, schema=schema)

    return run


def fit_rates(groups: DataFrame, weights: np.ndarray, caps: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """(gradient steps, target tokens per source).

    The total is the largest one at which every source that has tokens can
    reach its share within its repeats; a source without tokens is left out and
    its weight goes to the others in proportion.
    """
    stock_rows = groups.select(F.posexplode("member").alias("at", "m"), "tokens").groupBy("at").agg(F.sum(F.col("m") * F.col("tokens")).alias("t")).collect()
    stock = np.zeros(len(caps))
    for row in stock_rows:
        stock[row["at"]] = row["t"]
    able = (stock > 0) & (np.array(caps) > 0)
    share = np.where(able, weights, 0.0)
    if not able.any() or share.sum() == 0:
        return [], np.zeros(len(caps))
    share = share / share.sum()
    total = min(caps[i] * stock[i] / share[i] for i in range(len(caps)) if able[i] and share[i] > 0)
    target = share * total
    steps: list[np.ndarray] = []
    reached = np.zeros(len(caps))
    local = None
    if groups.count() <= GROUPS_AT_ONCE:
        rows = groups.select("member", "tokens").toArrow()
        member = np.array(rows.column("member").to_pylist(), dtype=float).reshape(-1, len(caps))
        limit = member @ np.array(caps, dtype=float) / np.maximum(member.sum(axis=1), 1e-9)
        local = (member, limit, np.array(rows.column("tokens").to_pylist(), dtype=float), np.zeros(len(member)))
    for _ in range(STEPS):
        residual = np.where(able, reached - target, 0.0)
        if np.abs(residual).sum() <= TOLERANCE * max(1.0, total):
            break
        # Scaled by each source's tokens, so that a full step solves the case of documents with one source.
        steps.append(np.where(able, residual / np.maximum(stock, 1.0), 0.0))
        if local:
            member, limit, tokens, rate = local
            rate[:] = np.clip(rate - member @ steps[-1], 0.0, limit)
            reached = (rate * tokens) @ member
            continue
        rows = groups.mapInArrow(_expected(caps, steps), "at int, tokens double").groupBy("at").agg(F.sum("tokens").alias("t")).collect()
        for row in rows:
            reached[row["at"]] = row["t"]
    return steps, target


_RATED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64()), ("queue", pa.string()), ("rate", pa.float64()), ("cap", pa.int32())])


def _rated(labels: list[str], caps: list[int], steps: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            if not rows["doc_id"]:
                continue
            member = np.array(rows["member"], dtype=float).reshape(len(rows["doc_id"]), len(labels))
            cap = member @ np.array(caps, dtype=float) / np.maximum(member.sum(axis=1), 1e-9)
            rate = rates_after(member, cap, steps)
            strongest = member.argmax(axis=1) if labels else np.zeros(len(member), dtype=int)
            has = member.sum(axis=1) > 0
            queue = [labels[k] if h else None for k, h in zip(strongest, has)]
            out = {"doc_id": rows["doc_id"], "source": rows["source"], "tokens": rows["tokens"], "queue": queue, "rate": np.where(has, rate, 0.0).tolist()}
            out["cap"] = [caps[k] if h else 0 for k, h in zip(strongest.tolist(), has)]
            yield pa.RecordBatch.from_pydict(out, schema=_RATED)

    return run


def draw(rated: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``uses``: whole numbers whose tokens per queue come as close to the rates as single documents allow."""
    buckets = bucket_count(rated.count())
    base = rated.withColumn("uses", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("part", F.greatest(F.col("rate") - F.col("uses"), F.lit(0.0)))
    drawn = scratch.write(base)
    goals = scratch.write(
        drawn.where("queue is not null").groupBy("queue").agg(F.round(F.sum(F.col("part") * F.col("tokens"))).cast("bigint").alias("goal"))
    )
    lacking = goals
    for _ in range(1 + FILL_ROUNDS):
        open_ones = drawn.where("queue is not null and tokens > 0 and uses < cap and part > 1e-9").join(lacking.where("goal > 0"), "queue").where("tokens <= goal")
        chosen = queue_positions(open_ones, "queue", "tokens", ["doc_id"], buckets).where("before + tokens <= goal").select("doc_id", F.lit(1).alias("more"))
        following = scratch.write(
            drawn.join(chosen.groupBy("doc_id").agg(F.max("more").alias("more")), "doc_id", "left")
            .withColumn("uses", F.col("uses") + F.coalesce("more", F.lit(0)))
            .withColumn("part", F.when(F.col("more").isNotNull(), 0.0).otherwise(F.col("part")))
            .drop("more")
        )
        scratch.drop(drawn)
        drawn = following
        taken = drawn.where("queue is not null").groupBy("queue").agg(F.sum(F.col("tokens") * (F.col("uses") - F.floor(F.col("rate") + 1e-9))).cast("bigint").alias("taken"))
        lacking = goals.join(taken, "queue").select("queue", (F.col("goal") - F.col("taken")).alias("goal"))
    return drawn


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, domain, tokens, rate, uses) of every document; uses is 0 where it isn't drawn.

    ``domain`` is the target source that the document counts for: its own one,
    or for a document without a source its likeliest one; it is null for one
    that resembles none. Sources are compared in lower case without blanks
    around; null and '' mean no source; documents of a source without a target,
    and null or '' texts, are not drawn, since they would make up a share that
    no target gives them; a null doc_id is left out. A target without documents
    is reported with share 0.
    """
    scratch = Scratch(documents.sparkSession)
    settings = target_settings(targets)
    labels, weights, caps = [s for s, _, _ in settings], np.array([w for _, w, _ in settings]), [c for _, _, c in settings]
    docs = documents.where("doc_id is not null").select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    unlabelled = not docs.where("(source is null or source = '') and text is not null and text != ''").isEmpty()
    model = SourceClassifier.fit(docs, labels, tokenizer) if labels and unlabelled else None
    members = scratch.write(memberships(docs, labels, model, tokenizer))
    groups = scratch.write(members.groupBy("member").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    steps, _ = fit_rates(groups, weights, caps) if labels else ([], None)
    rated = members.mapInArrow(_rated(labels, caps, steps), "doc_id bigint, source string, tokens bigint, queue string, rate double, cap int")
    return draw(scratch.write(rated), scratch).select("doc_id", "source", F.col("queue").alias("domain"), "tokens", F.round("rate", 9).alias("rate"), "uses")


_HELD = pa.schema([("source", pa.string()), ("tokens", pa.int64()), ("right", pa.int32()), ("own", pa.float64()), ("member", pa.list_(pa.float64()))])


def _measured(labels: list[str], model: SourceClassifier, path: str):
    places = {label: i for i, label in enumerate([*labels, ""])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in _HELD.names}
            for source, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text, path)
                p, true = model.posterior(ids), places.get(source, len(labels))
                for name, value in zip(_HELD.names, (source if source in places else "", len(ids), int(p.argmax() == true), float(p[true]), model.member(ids))):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_HELD)

    return run


def membership_report(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, n_hidden, accuracy, mean_posterior, true_share, soft_share): how well soft memberships stand for labels.

    The labels of one document in HIDDEN are hidden, the classifier is fitted on
    the others and judges them. ``soft_share`` is the share of tokens that the
    memberships give to the source. Labels without a target are the source ''.
    """
    labels = [s for s, _, _ in target_settings(targets)]
    docs = documents.where("doc_id is not null and text is not null and text != ''").select("doc_id", F.lower(F.trim("source")).alias("source"), "text").where("source is not null and source != ''")
    hidden = F.pmod(F.xxhash64("doc_id", F.lit("hidden")), F.lit(HIDDEN)) == 0
    model = SourceClassifier.fit(docs.where(~hidden), labels, tokenizer)
    judged = Scratch(documents.sparkSession).write(docs.where(hidden).select("source", "text").mapInArrow(_measured(labels, model, tokenizer), "source string, tokens bigint, right int, own double, member array<double>"))
    classes = F.array(*[F.lit(label) for label in (*labels, "")])
    soft = judged.select("tokens", F.posexplode("member").alias("at", "m")).groupBy(F.element_at(classes, F.col("at") + 1).alias("source")).agg(F.sum(F.col("m") * F.col("tokens")).alias("soft"))
    per = judged.groupBy("source").agg(F.count("*").alias("n_hidden"), F.avg("right").alias("accuracy"), F.avg("own").alias("posterior"), F.sum("tokens").alias("tokens"))
    total = float(judged.agg(F.sum("tokens")).first()[0] or 1)
    return soft.join(per, "source", "left").select(
        "source", F.coalesce("n_hidden", F.lit(0)).alias("n_hidden"), F.round("accuracy", 6).alias("accuracy"), F.round("posterior", 6).alias("mean_posterior"),
        F.round(F.coalesce("tokens", F.lit(0)) / total, 6).alias("true_share"), F.round(F.col("soft") / total, 6).alias("soft_share"),
    )


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: weight, actual share of the drawn tokens, documents, uses and the highest number of uses."""
    per = mixed.where("domain is not null").groupBy("domain").agg(
        F.sum(F.col("tokens") * F.col("uses")).alias("n_tokens"), F.sum((F.col("uses") > 0).cast("long")).alias("n_docs"), F.sum("uses").cast("long").alias("n_uses"), F.max("uses").alias("max_uses")
    )
    total = float(per.agg(F.sum("n_tokens")).first()[0] or 1)
    wanted = targets.select(F.lower(F.trim("source")).alias("source"), "weight", "max_repeats").where("source is not null")
    return wanted.join(per.withColumnRenamed("domain", "source"), "source", "left").select(
        "source", "weight", F.round(F.coalesce(F.col("n_tokens") / total, F.lit(0.0)), 6).alias("actual_share"), "max_repeats",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_docs", "n_uses", "max_uses")],
    )
