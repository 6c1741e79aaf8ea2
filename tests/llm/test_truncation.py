import random

import pytest

from loomgraph.llm import truncation


@pytest.mark.parametrize(
    "text,state",
    [
        (None, "empty"), ("", "empty"), (" \n", "empty"), ("A whole sentence.", "whole"), ("Cut here (message clipped)", "cut"), ("Cut [truncated]", "cut"), ("Cut <snip>", "cut"), ("Cut [...]", "cut"), ("Done.…", "cut"),
        ('{"a": [1, 2', "cut"), ('{"a": [1, 2]}', "whole"), ("package a;\nclass A {\n void f() {", "cut"), ("class A:\n    def f(self):", "cut"), ("text\n```\ncode", "cut"), ("text\n```\ncode\n```", "whole"), ("use `Foo", "cut"),
        ("No full stop", "open"), ("I will look again tomorrow...", "open"), ("a.b.c=1\nd.e.", "open"), ("[" * 100_000, "cut"),
    ],
)
def test_first_look(text, state):
    assert truncation.first_look(text)[0] == state


def corpus():
    rnd = random.Random(1)
    nouns = ["ledger", "invoice", "parcel", "voucher", "tenant", "basket"]
    sentences = ["Only used by the nightly repair of the {n}; everything else goes elsewhere.", "Falls back to the old {n} when no other {n} covers the requested day.", "Amounts are rounded half up before the {n} is written."]
    full = []
    for _ in range(400):
        text = " ".join(rnd.choice(sentences).format(n=rnd.choice(nouns)) for _ in range(rnd.randrange(1, 4)))
        full.append(text if rnd.random() < 0.8 else text + " See you tomorrow" if rnd.random() < 0.5 else f"Drop the {rnd.choice(nouns)}")
    return full


def test_cut_texts_are_found(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["Issue", "issue ", None]), t, 1) for i, t in enumerate(corpus())]
    cut = {5000: "Falls back to the old vouch", 5001: "Amounts are rounded half up before th", 5002: "Falls back to the old ledger when no other", 5003: "Amounts are rounded half up before the inv", 5004: "Amounts are rounded half up before the inv"}
    rows += [(k, "issue", v, 1) for k, v in cut.items()] + [(6000, "issue", None, 1), (6001, "issue", "", 1), (None, "issue", "x", 1), (6002, "issue", "word " * 60_000 + "end.", 1)]
    judged = truncation.truncated(spark.createDataFrame(rows, "doc_id bigint, source string, text string, last int"))
    got = {r.doc_id: r.state for r in judged.collect()}
    assert {k for k, v in got.items() if v == "cut"} == set(cut)
    assert 6000 not in got and got[6002] == "whole"
    rates = {r.source: r for r in truncation.truncation_rates(judged).collect()}
    assert rates["issue"].n_cut == 5 and None in rates


def test_limits(spark):
    rows = [(i, "a", 200 if i < 40 else 50 + i, "open") for i in range(200)]
    found = truncation.length_limits(spark.createDataFrame(rows, "doc_id bigint, source string, chars int, state string")).collect()
    assert [(r.source, r.chars) for r in found] == [("a", 200)]


def test_empty(spark):
    assert truncation.truncated(spark.createDataFrame([], "doc_id bigint, source string, text string")).count() == 0


def test_last_words_of_any_length_are_whole():
    word = "a" * 2500
    assert truncation.first_look("see " + word)[1][-1] == word
    assert truncation.first_look("一" * 3000)[1][-4:] == ["一"] * 4
    text = "Amounts are rounded half up\n   \n before " + "x " * 300 + "the end-of line"
    assert truncation.last_tokens(text)[-6:] == truncation.tokens(text)[-6:]


@pytest.mark.parametrize("text", ["One two-three 4a b_c \n  \n d.", "x;\ny = f(1)\x1c\x1f_ end", "a-1 b--c 12ab"])
def test_shorter_classes_give_the_same_tokens(text):
    assert truncation._ASCII_TOKEN.findall(text) == truncation._TOKEN.findall(text)


def test_a_long_word_cut_within_is_unfinished(spark):
    long = "Amortisationstabellenberechnungsdienst" * 60
    rows = [(i, "a", f"The {long} is called before number {i}.") for i in range(30)] + [(99, "a", "The " + long[:2000])]
    got = {r.doc_id: r.state for r in truncation.truncated(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    assert [k for k, v in got.items() if v == "cut"] == [99]
