import random
import re
from collections import Counter

import pytest

from loomgraph.llm import provenance
from loomgraph.llm.repair import explained, grammar_size, re_pair, shared_phrases

CODE = "package a;\n\npublic class B {\n    public void run(int n) {\n        var x = store.load(n);\n        x.save();\n    }\n}\n"


def expand(symbol, rules):
    if isinstance(symbol, tuple) and symbol[0] == "rule":
        return [t for part in rules[symbol[1]] for t in expand(part, rules)]
    return [symbol]


@pytest.mark.parametrize("seed", range(8))
def test_re_pair_is_a_round_trip(seed):
    rnd = random.Random(seed)
    sequence = [rnd.choice("abcd") for _ in range(rnd.choice([0, 1, 3, 50, 5000]))]
    start, rules = re_pair(sequence)
    assert [t for s in start for t in expand(s, rules)] == sequence
    if len(sequence) > 100:
        assert grammar_size(start, rules) < len(sequence)


@pytest.mark.parametrize("seed", range(4))
def test_explained_tokens_are_those_of_the_expanded_rules(seed):
    rnd = random.Random(seed)
    sequence = [rnd.choice("abcdefgh") for _ in range(rnd.choice([0, 3, 40, 3000]))]
    start, rules = re_pair(sequence)
    assert explained(start, rules) == Counter(t for s in start if isinstance(s, tuple) for t in expand(s, rules))


def test_random_literals_do_not_compress():
    rnd = random.Random(1)
    start, rules = re_pair([rnd.randrange(10**9) for _ in range(500)])
    assert grammar_size(start, rules) == 500


@pytest.mark.parametrize(
    "path,verdict",
    [
        ("services/a/node_modules/x/index.js", "copied"), ("services/a/third_party/x-1.2.3/core.py", "copied"), ("services/a/vendor/x/main.ts", "copied"), ("services/a/src/vendor/x/main.ts", ""),
        ("services/a\\target\\generated-sources\\A.java", "generated"), ("services/a/src/main/java/com/h/target/A.java", ""), ("services/a/dist/x.js", "generated"), ("services/a/jobs/dist/x.py", ""),
        ("services/a/web/static/x.MIN.JS", "minified"), ("services/a/src/minimal-x.ts", ""), ("services/a/src/x_pb2_grpc.py", "generated"), ("services/a/src/x-generated-report.ts", ""), ("services/a/src/x.generated.ts", "generated"),
        ("services/a/src/GeneratedThing.java", ""), ("services/a/src/MockThing.java", ""), ("services/a/src/AutoValue_Thing.java", "generated"), ("services/a/db/dump/x_rows.py", "data"), ("services/a/src/thing_data.py", ""),
    ],
)
def test_places(path, verdict):
    assert provenance.place(path) == verdict


@pytest.mark.parametrize(
    "head,verdict",
    [
        ("// Code generated by x 1.2. DO NOT EDIT.\n", "generated"), ("# <auto-generated>\n", "generated"), ("// Automatisch erzeugt mit x, bitte nicht von Hand bearbeiten.\n", "generated"), ("// Fichier créé par x. Ne pas modifier.\n", "generated"),
        ("// 本文件由 x 自动生成，请勿修改\n", "generated"), ("/*!\n * lib v1.2.3\n * (c) lib contributors, MIT licensed\n */\n", "copied"), ("# Vendored from lib 1.2.3 (BSD-3-Clause).\n", "copied"), ("# lib 1.2.3\r\n# x\r\n", "copied"),
        ("// Rejects sources that carry a do-not-edit banner.\n", ""), ("// Lists every generated invoice of the run.\n", ""), ("// Copyright Own Works. All rights reserved.\n", ""), ("// Replaces the vendored date parser we dropped.\n", ""), ("", ""),
    ],
)
def test_banners(head, verdict):
    assert provenance.judge("services/a/src/B.java", head + CODE)[0] == verdict


def test_contents():
    rnd = random.Random(3)
    blob = "ROWS = [\n" + "".join(f"  [{rnd.random():.5f}, {rnd.randrange(10**6)}],\n" for _ in range(40)) + "]\n"
    dense = "".join(f"function {rnd.choice('abc')}{i}(a,b){{return a&&b?a.x{rnd.randrange(9)}(b):null}}" for i in range(30))
    assert provenance.judge("services/a/src/x.py", blob)[0] == "data" and provenance.judge("services/a/src/x.ts", dense)[0] == "minified"
    assert provenance.judge("services/a/x.yaml", "a:\n  b: 12345\n" * 40)[0] == "" and provenance.judge("services/a/src/B.java", CODE)[0] == ""


def test_table(spark):
    files = spark.createDataFrame(
        [("s/a/src/A.java", 1, "h", "// Code generated by x. DO NOT EDIT.\n", 0), ("s/a/src/A.java", 2, "h", CODE, 0), ("s/a/dist/x.js", 1, "h", None, 0), ("s/a/src/B.java", 1, "h", "@Generated(\"x\")\n" + CODE, 0), ("s/a/src/C.java", 1, "h", "", 0), (None, 1, "h", CODE, 0), ("s/a/src/L.java", 1, "h", CODE * 3000, 0)],
        "path string, indexed_at bigint, content_hash string, content string, verdict int",
    )
    nodes = spark.createDataFrame([("s/a/node_modules/y.js", 1), ("s/a/src/A.java", 1), (None, 1), ("", 1)], "file_path string, path int")
    found = {r.path: r.verdict for r in provenance.provenance(files, nodes).collect()}
    assert found == {"s/a/src/A.java": "hand-written", "s/a/dist/x.js": "generated", "s/a/src/B.java": "generated", "s/a/src/C.java": "hand-written", "s/a/node_modules/y.js": "copied", "s/a/src/L.java": "hand-written"}
    assert provenance.provenance(files.where("false"), nodes.where("false")).count() == 0


def test_rules_shared_across_repositories(spark):
    body = "".join(f"if (alpha{i % 2} > 0) {{ beta.gamma(delta, epsilon, {i}); zeta = eta + theta; }}\n" for i in range(12))
    rows = [(f"s/r{i}/src/x.ts", 1, "h", body) for i in range(3)] + [("s/r0/src/own.ts", 1, "h", CODE)]
    files = spark.createDataFrame(rows, "path string, indexed_at bigint, content_hash string, content string")
    found = {r.path: (r.verdict, r.evidence) for r in provenance.provenance(files, spark.createDataFrame([], "file_path string")).collect()}
    assert found["s/r0/src/x.ts"] == ("copied", "shared rules") and found["s/r0/src/own.ts"][0] == "hand-written"


def test_a_common_piece_gives_common_rules_wherever_it_stands():
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(400)}" for _ in range(2000)]
    piece, other = words[:300], words[300:]
    a, b = set(shared_phrases(other[:170] + piece + other[200:260], 12)), set(shared_phrases(other[700:741] + piece + other[900:1300], 12))
    alone = set(shared_phrases(piece, 12))
    assert len(a & b) >= 6 and len(a & b & alone) >= 5
    assert not set(shared_phrases(other[:600], 12)) & set(shared_phrases(other[700:1300], 12))
    assert shared_phrases([], 12) == [] and shared_phrases(["x"] * 500, 12) == shared_phrases(["x"] * 500, 12)


def test_copies_under_a_neutral_path_without_a_banner(spark):
    rnd = random.Random(5)
    body = lambda seed: "".join(f"export function f{random.Random(seed * 1000 + i).randrange(10**6)}(a, b) {{ return a.{random.Random(seed * 7 + i).choice('pqrstuv')}{i * seed}(b, {i}) }}\n" for i in range(25))
    rows = [(f"services/r{i}/src/util/helper.ts", 1, "h", body(1)) for i in range(4)] + [(f"services/r{i}/src/own{i}.ts", 1, "h", body(10 + i)) for i in range(4)]
    # A house idiom: many files of each repository hold it.
    rows += [(f"services/r{i}/src/idiom{k}.ts", 1, "h", body(3) + body(30 + i * 10 + k)) for i in range(4) for k in range(4)]
    rnd.shuffle(rows)
    files = spark.createDataFrame(rows, "path string, indexed_at bigint, content_hash string, content string")
    modules = spark.createDataFrame([(f"services/r{i}",) for i in range(4)], "root_path string")
    found = {r.path: r.verdict for r in provenance.provenance(files, spark.createDataFrame([], "file_path string"), modules).collect()}
    assert {p for p, v in found.items() if v == "copied"} == {f"services/r{i}/src/util/helper.ts" for i in range(4)}


def test_a_banner_behind_a_long_licence():
    licence = "/*\n" + "".join(f"   licence text number {i} of our own works\n" for i in range(40)) + "*/\n\n"
    assert provenance.judge("services/a/src/B.java", licence + CODE)[0] == ""
    assert provenance.judge("services/a/src/B.java", licence + "// Code generated by x 1.2. DO NOT EDIT.\n" + CODE)[0] == "generated"
    assert provenance.judge("services/a/src/B.java", licence + CODE + "// Code generated by x 1.2. DO NOT EDIT.\n")[0] == ""


def test_roots():
    roots = frozenset(["services/a", "services/a/web"])
    assert provenance.repository("services/a/web\\src\\x.ts", roots) == "services/a/web"
    assert provenance.repository("services/a/src/x.ts", roots) == "services/a" and provenance.repository("x/y/z.ts", roots) == "x/y"
    assert provenance.judge("services/a/web/dist/x.js", None, 3)[0] == "generated" and provenance.judge("services/a/web/dist/x.js", None, 2)[0] == ""


def minified(seed, n):
    rnd = random.Random(seed)
    name = lambda: "".join(rnd.choices("abcdefghijk", k=rnd.randrange(1, 3)))
    forms = ("function {0}({1},{2}){{{3}}}", "var {0}=function({1}){{for(var {2}=0;{2}<{1}.length;{2}++){1}[{2}].{3}()}};", "{0}.{1}=!1,{2}.{3}=16,", "!({0}=>{{{1}({0},767);{2}={0}.{3}()}})({1}),")
    return "".join(rnd.choice(forms).format(name(), name(), name(), name()) for _ in range(n))


@pytest.mark.parametrize("width", [80, 120, 500, 10**6])
def test_minified_code_is_known_by_its_rules_however_it_is_wrapped(width):
    code, lines = minified(width, 60), [""]
    for token in re.findall(r"\w+ \w+|\w+|\W", code):
        if len(lines[-1]) + len(token) > width:
            lines.append("")
        lines[-1] += token
    assert max(map(len, lines)) <= width and "".join(lines) == code
    assert provenance.judge("services/a/src/x.js", "\n".join(lines))[:2] == ("minified", "token grammar")


@pytest.mark.parametrize(
    "path,content",
    [
        ("ci.yml", "".join(f"job{i}:\n  needs: build\n  run: make all\n" for i in range(8)) + "secure: " + "k3" * 700 + "\n"),
        ("src/routes.js", "".join(f"app.use(api.route{i}(path.get(key{i}),b));\n" for i in range(60))),
        ("x.properties", "".join(f"com.own.works.part{i}.group.of.settings.with.name{i}={i}\n" for i in range(60))), ("x.csv", "".join(",".join(str(i * k) for k in range(20)) + "\n" for i in range(40))),
        ("src/B.java", CODE * 20), ("src/x.py", "total = 0\n" * 100),
    ],
)
def test_rules_of_lines_and_blanks_are_hand_written(path, content):
    assert provenance.judge("services/a/" + path, content)[0] == ""
