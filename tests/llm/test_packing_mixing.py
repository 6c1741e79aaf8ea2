import os
import random
from collections import Counter, defaultdict

import pytest

from loomgraph.llm import mixing, packing, tokens

needs_files = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer files")


def counts(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, tokens bigint, piece int")


def capacities(spark, *rows):
    return spark.createDataFrame(rows, "profile string, capacity_tokens bigint")


def test_best_fit_never_overflows():
    rnd = random.Random(1)
    sizes = [rnd.randrange(1, 100) for _ in range(400)]
    room = Counter()
    for size, place in zip(sizes, packing.best_fit(sizes, 100)):
        room[place] += size
    assert max(room.values()) <= 100 and len(room) <= sum(sizes) / 100 * 1.05 + 1


def test_packing(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "A ", "b", None]), rnd.choice([3, 10, 40, 64, 250])) for i in range(1500)] + [(9000, "b", 0), (9001, "b", None), (1, "a", 10)]
    rows += [(10_000 + i, "hot", 20) for i in range(1500)]
    found = packing.pack(counts(spark, rows), capacities(spark, ("s", 64), ("l", 500), ("none", None), (None, 5))).collect()
    for profile, cap in (("s", 64), ("l", 500)):
        mine = [r for r in found if r.profile == profile]
        total = Counter()
        for r in mine:
            total[r.container_id] += r.tokens
        del total[None]
        assert max(total.values()) <= cap and sum(total.values()) == sum(t or 0 for _, _, t in rows)
        assert sum(total.values()) / (len(total) * cap) > 0.9
        parts = defaultdict(list)
        for r in mine:
            parts[r.doc_id].append(r)
        assert all(p.n_pieces == 1 or p.n_pieces > 1 and sum(x.tokens for x in ps) > cap for ps in parts.values() for p in ps)
        assert {r.doc_id for r in mine if r.container_id is None} == {9000, 9001}
    assert all(r.container_id is None for r in found if r.profile == "none")
    report = {r.profile: r for r in packing.fill_report(packing.pack(counts(spark, rows), capacities(spark, ("s", 64))), capacities(spark, ("s", 64))).collect()}
    assert report["s"].fill > 0.9


def test_windows_keep_the_mixture(spark):
    rows = [(i, "big" if i % 3 else "small", 10) for i in range(6000)]
    packed = packing.pack(counts(spark, rows), capacities(spark, ("p", 50)))
    report = {r.source: r for r in packing.mixture_report(packed).collect()}
    assert report["big"].share == pytest.approx(2 / 3, abs=1e-3) and report["small"].mean_deviation < 0.02


def test_no_rows(spark):
    assert packing.pack(counts(spark, []), capacities(spark, ("p", 5))).count() == 0
    assert packing.pack(counts(spark, [(1, "a", 3)]), capacities(spark)).count() == 0


@needs_files
def test_long_texts_count_as_a_whole():
    rnd = random.Random(4)
    text = "".join(rnd.choice(["word", "  ", "\n\n", " a1", "中文", "é ", "   x", "!? ", "\t"]) for _ in range(30_000))
    assert tokens.encode(text) == tokens.encoding().encode_ordinary(text)
    assert len(tokens.encode("a" * 200_000)) > 0 and len(tokens.encode(" " * 200_000)) > 0


def documents(spark, rows):
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, source string, text string, rate double")


TARGETS = "source string, weight double, max_repeats int"


@needs_files
def test_mixing(spark):
    rnd = random.Random(3)
    words = {"code": ["def", "return", "self", "import"], "talk": ["hello", "thanks", "please", "agree"], "log": ["error", "trace", "warn", "at"]}
    rows = []
    for i in range(900):
        source = rnd.choice(["code", "code", "code", "talk", "log"])
        rows.append((i, rnd.choice([source, source.upper() + " "]), " ".join(rnd.choice(words[source]) for _ in range(rnd.randrange(5, 60)))))
    rows += [(1000, None, " ".join(words["talk"] * 10)), (1001, "other", "x y z"), (1002, "code", None), (1003, "code", ""), (None, "code", "a b")]
    targets = spark.createDataFrame([("code", 0.3, 1), ("talk", 0.4, 3), ("log", 0.2, 2), ("absent", 0.1, 4)], TARGETS)
    mixed = mixing.mix(documents(spark, rows), targets)
    got = mixed.collect()
    assert len(got) == len(rows) - 1
    caps = {"code": 1, "talk": 3, "log": 2}
    assert all(0 <= r.uses <= caps.get(r.domain, 0) for r in got)
    assert {r.doc_id: r.uses for r in got}[1001] == 0 and next(r for r in got if r.doc_id == 1000).domain == "talk"
    shares = {r.source: r for r in mixing.share_report(mixed, targets).collect()}
    for source, weight in (("code", 0.3), ("talk", 0.4), ("log", 0.2)):
        assert shares[source].actual_share == pytest.approx(weight / 0.9, abs=0.01)
    assert shares["absent"].actual_share == 0


@needs_files
def test_classifier_on_held_out_rows(spark):
    rnd = random.Random(5)
    words = {"code": ["def", "return", "self", "import", "class"], "talk": ["hello", "thanks", "please", "agree", "maybe"]}
    make = lambda s: " ".join(rnd.choice(words[s] + ["the", "a"]) for _ in range(12))
    train = [(i, s, make(s)) for i in range(200) for s in ("code", "talk")]
    model = mixing.SourceClassifier.fit(documents(spark, train), ["code", "talk"])
    right = sum(model.labels[int(model.posterior(tokens.encode(make(s))).argmax())] == s for s in ("code", "talk") for _ in range(100))
    assert right >= 195


@needs_files
def test_mixing_without_rows(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.mix(documents(spark, []), targets).count() == 0
    only = mixing.mix(documents(spark, [(1, "b", "text")]), targets.where("false")).collect()
    assert [r.uses for r in only] == [0]


def test_memberships_keep_their_sum():
    import numpy as np

    model = mixing.SourceClassifier([f"s{i}" for i in range(60)] + [""], np.ones(61), np.ones((61, mixing.FEATURES)))
    assert abs(sum(model.member([1, 2, 3])) - 1) < 1e-9 and abs(sum(mixing.SourceClassifier(["a", ""], np.array([5.0, 1.0]), np.ones((2, mixing.FEATURES))).member([7])) - 1) < 1e-9


def test_memberships_on_hidden_labels(spark):
    rows = [(i, "a", "alpha beta gamma " * 20) for i in range(60)] + [(100 + i, "b", "delta epsilon zeta " * 20) for i in range(60)]
    rows += [(200 + i, "c", "eta theta iota kappa " * 20) for i in range(40)] + [(302, "c", None), (303, None, "")]
    documents = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], TARGETS)
    report = {r.source: r for r in mixing.membership_report(documents, targets).collect()}
    assert report["a"].accuracy == 1.0 and report[""].n_hidden > 0 and abs(report["b"].soft_share - report["b"].true_share) < 0.01
    assert mixing.membership_report(documents.where("false"), targets).where("n_hidden > 0").count() == 0


def test_windows_keep_target_shares(spark):
    counts = spark.createDataFrame([(i, "ab"[i % 2], 5 + i % 7) for i in range(6000)], "doc_id bigint, source string, tokens bigint")
    capacities = spark.createDataFrame([("p", 32)], "profile string, capacity_tokens bigint")
    shares = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("none", 4.0)], "source string, share double")
    packed = packing.pack(counts, capacities, shares)
    assert packed.count() == 6000
    report = {r.source: r for r in packing.target_report(packed).collect()}
    assert abs(report["a"].share - 0.75) < 0.01 and report["a"].max_deviation < 0.02 and report["a"].n_windows > 3
