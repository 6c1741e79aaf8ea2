"""Source files that nobody wrote by hand: generated, minified, copied, or data saved as code.

Every content is tokenised and compressed with Re-Pair. Read off the grammars
are how much of a file its rules explain and whether they are rules of bare code,
without the blanks and line ends that people write between tokens (minified), how
little the grammar of its literals explains while they make up most of the file
(blobs), and long rules that files of several repositories share once each
(copies). The layout of the text, banners at the head of a file and the place
where it lies are then judged exactly. Paths without content are judged by the
place alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.repair import explained, grammar_size, re_pair, shared_phrases
from loomgraph.session import Scratch

RULE_TOKENS = 12  # a rule this long is a fingerprint
SHARED_BY = 3  # repositories that have the rule
SPREAD = 1.5  # files per repository that have it, at most: house idioms are in more
SHARED_RULES = 3  # such rules in one file
SHARED_TOKENS = 0.5  # and the share of its rules that they are at least
MAX_ROOTS = 100_000  # module roots, a table of settings that every task reads
LITERAL_SHARE = 0.6
LITERAL_CHARS = 150
LITERAL_REUSE = 0.6  # a grammar that explains more than this of the literals means text, not a blob
DENSE_LINE = 250
DENSE_SPACE = 0.08
BARE_TOKENS = 60  # fewer have hardly any rules
BARE_SHARE = 0.5  # of a minified file that its rules explain, at least
BARE_GAPS = 0.1  # blanks and line ends per token in what they explain, at most
BARE_BREAKS = 0.05  # line ends alone: minified code may be wrapped, but anywhere
BARE_BREAKS_CONFIG = 0.01  # rows of settings and tables have no blanks by nature

_TOKEN = re.compile(
    r"""(?P<s>"(?:[^"\\\n]|\\.)*(?:"|$)|'(?:[^'\\\n]|\\.)*(?:'|$)|`[^`]*(?:`|$))|(?P<n>0x[0-9a-fA-F]+|\d[\w.]*)|(?P<w>[^\W\d]\w*)|(?P<p>[^\w\s])"""
)
_BREAK = re.compile(r"[\n\r]")
_PIECE = re.compile(r"[A-Za-z]+|\d+|[^\w\s]|_")

# Wording of banners that tools put at the head of their output, by language.
GENERATED_BANNER = re.compile(
    r"(?i)@generated\b|<auto-?generated|\b(?:generated|produced|emitted|compiled) (?:automatically )?(?:by|from|with|using)\b|\bauto(?:matically)?[- ]generated\b"
    r"|\bdo not (?:edit|modify)\b|(?:changes|edits)[\w ,]* will be (?:lost|overwritten)|\bregenerate (?:with|by|using)\b|^\W*\w+ v?\d+(?:\.\d+)+ output\b"
    r"|\b(?:erzeugt|generiert|erstellt) (?:mit|von|durch|aus)\b|nicht von hand|bitte nicht (?:bearbeiten|ändern)"
    r"|\b(?:créé|généré|produit) (?:par|avec|automatiquement|à partir)\b|ne pas (?:modifier|éditer)"
    r"|\b(?:generado|creado|producido) (?:automáticamente|por|con|a partir)\b|no (?:editar|modificar)\b"
    r"|自动生成|请勿(?:手动)?(?:修改|编辑)|不要(?:手动)?(?:修改|编辑)"
)
COPIED_BANNER = re.compile(
    r"(?i)@license\b|\b(?:bundled|vendored|imported|verbatim|unmodified) (?:copy|version|from)\b|\bvendored from\b|\bupstream (?:archive|release|version|project|source)\b|\bcopied (?:without changes|verbatim|from)\b"
    r"|\(c\)[^\n]{0,60}\b(?:contributors|authors|maintainers)\b|copyright[^\n]{0,80}\b(?:contributors|authors|maintainers)\b|__author__ *= *[\"'][^\"'\n]*(?:maintainers|contributors|authors)"
    r"|\b(?:mit|bsd|apache|isc|mpl|lgpl|gpl)\b[^\n]{0,20}\blicen[sc]ed?\b|permission is hereby granted|redistribution and use in source|^\W*[\w.-]+[ @]v?\d+\.\d+\.\d+\s*$"
)
GENERATED_MARK = re.compile(r"(?m)^[ \t]*@(?:[\w.]+\.)?Generated\b")
_COMMENT_LINE = re.compile(r"^\s*(?://|#|/\*|\*|<!--|--|\"\"\"|'''|;|%|__\w+__\s*=)")
# Places that tools and package managers own, and names they give.
OWNED_PLACE = re.compile(
    r"(?i)(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|\.venv|venv|\.tox|\.nuxt|\.next|\.svelte-kit|\.gradle|\.m2|\.cargo|\.yarn|__generated__|generated-(?:test-)?sources|proto-gen|third_party|third-party|thirdparty|pods|carthage|deriveddata)/"
    r"|(?:^|/)(?:target/(?:classes|test-classes|generated[\w-]*)|build/(?:generated|classes|intermediates|libs|tmp)|db/dumps?|js/libs?|dist/(?:assets|static|js))/"
)
OWNED_AT_ROOT = frozenset(["dist", "vendor", "vendored", "build", "target", "out", "generated", "gen", "bin", "obj", "coverage", "extern", "external", "deps"])
OWNED_NAME = re.compile(
    r"(?i)[._-]min\.(?:js|mjs|cjs|css)$|\.(?:bundle|chunk|packed)\.(?:js|mjs|css)$|-[0-9a-f]{8,}\.(?:js|mjs|css)$|\.[0-9a-f]{8,}\.(?:chunk\.)?(?:js|mjs|css)$"
    r"|_pb2(?:_grpc)?\.pyi?$|\.pb\.(?:ts|js|go|cc|h|rs|dart)$|_pb\.(?:js|ts|d\.ts)$|_grpc_pb\.(?:js|ts)$|\.(?:generated|gen|g|designer)\.\w+$|\.(?:base64|sprite-data|wasm)\.\w+$|[._-](?:base64|bytes|blob)\.\w+$"
    r"|-lock\.(?:json|yaml)$|\.map$|-\d+\.\d+\.\d+\.(?:js|mjs|css)$"
)
OWNED_NAME_CASED = re.compile(r"^AutoValue_\w+\.java$|^\w+Grpc\.(?:java|kt)$|^Dagger[A-Z]\w+\.java$|\$\$\w+\.java$|(?:Font|Sprite|Glyph|Blob)Data\.\w+$|^R\.java$")


def place(path: str, root_depth: int = 2) -> str:
    """'' or the kind of place: 'copied', 'generated', 'minified' or 'data'.

    A telling directory counts when a tool is known to own it, or when it lies
    right below the module's root; the same word as a package of the sources
    proves nothing.
    """
    path = path.replace("\\", "/")
    parts = path.split("/")
    name = parts[-1]
    if re.search(r"(?i)[._-](?:base64|bytes|blob|sprite-data)\.\w+$|(?:^|/)db/dumps?/", path) or re.search(r"(?:Font|Sprite|Glyph|Blob)Data\.\w+$", name):
        return "data"
    if re.search(r"(?i)[._-]min\.(?:js|mjs|cjs|css)$|\.(?:bundle|chunk|packed)\.(?:js|mjs|css)$", name):
        return "minified"
    if OWNED_PLACE.search(path) or len(parts) > root_depth + 1 and parts[root_depth].lower() in OWNED_AT_ROOT:
        return "copied" if re.search(r"(?i)modules|packages|components|third|vendor|extern|pods|venv|/js/lib|deps", path) else "generated"
    if OWNED_NAME.search(name) or OWNED_NAME_CASED.search(name):
        return "copied" if re.search(r"-\d+\.\d+\.\d+\.", name) else "generated"
    return ""


_OPENERS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))


def leading_comment(content: str) -> list[str]:
    """The lines of the comments that a file begins with, however many, blank lines between them left out."""
    head, closing = [], None
    at = 0
    while at <= len(content):
        end = content.find("\n", at)
        line = content[at : end if end >= 0 else len(content)]
        at = end + 1 if end >= 0 else len(content) + 1
        text = line.strip()
        if closing:
            closing = None if closing in text else closing
        elif not text:
            continue
        elif not _COMMENT_LINE.match(line):
            break
        else:
            for opener, closer in _OPENERS:
                if text.startswith(opener) and closer not in text[len(opener) :]:
                    closing = closer
        head.append(line)
    return head


def banner(content: str) -> str:
    """'' or what the leading comment says of the file: 'generated' or 'copied'."""
    head = leading_comment(content.replace("\r\n", "\n").replace("\r", "\n"))
    text = "\n".join(head)
    if GENERATED_BANNER.search(text) or GENERATED_MARK.search(content):
        return "generated"
    return "copied" if any(COPIED_BANNER.search(line) for line in (*head, text)) else ""


def grammar_features(content: str) -> dict:
    """Measures of one content, from Re-Pair grammars of its tokens and of its literals.

    The grammar of the tokens has one symbol for all words, so that renaming
    changes nothing, and symbols for the gaps between tokens.
    """
    texts, shapes, literals, literal_chars, solid, end = [], [], [], 0, 0, 0
    for match in _TOKEN.finditer(content):
        value, kind = match.group(), match.lastgroup
        if texts and match.start() > end:
            shapes.append("\n" if _BREAK.search(content, end, match.start()) else " ")
        end = match.end()
        solid += len(value)
        texts.append(value)
        shapes.append(value if kind == "p" else kind)
        if kind in "sn":
            literal_chars += len(value)
            literals += _PIECE.findall(value) if kind == "s" else [value]
    start, rules = re_pair(shapes)
    features = {"tokens": len(texts), "rule_reuse": 0.0, "rule_share": 0.0, "rule_gaps": 0.0, "rule_breaks": 0.0, "literal_share": 0.0, "literal_reuse": 0.0, "fingerprints": []}
    if texts:
        features["rule_reuse"] = 1 - grammar_size(start, rules) / len(shapes)
        found = explained(start, rules)
        features["rule_share"] = found.total() / len(shapes)
        breaks, blanks = found.pop("\n", 0), found.pop(" ", 0)
        features["rule_gaps"] = (breaks + blanks) / max(1, found.total())
        features["rule_breaks"] = breaks / max(1, found.total())
        features["fingerprints"] = shared_phrases(texts, RULE_TOKENS)
    if solid:
        numbers = sum(len(v) for v in literals) if literals else 0
        features["literal_share"] = literal_chars / solid
        features["literal_chars"] = numbers
        if literal_chars / solid >= LITERAL_SHARE / 2 and literals:
            sparse = [v for v in literals if len(v) > 1] or literals
            s, r = re_pair(sparse)
            features["literal_reuse"] = 1 - grammar_size(s, r) / len(sparse)
    lines = content.split("\n")
    features["longest_line"] = max(map(len, lines))
    features["space"] = sum(map(content.count, (" ", "\n", "\t"))) / max(1, len(content))
    return features


def is_bare(f: dict, config: bool) -> bool:
    """Whether rules explain the content and stand for code without gaps, as minifiers write it."""
    breaks = BARE_BREAKS_CONFIG if config else BARE_BREAKS
    return f["tokens"] >= BARE_TOKENS and f["rule_share"] >= BARE_SHARE and f["rule_gaps"] <= BARE_GAPS and f["rule_breaks"] <= breaks


def is_dense(f: dict, config: bool) -> bool:
    """Whether long lines without blanks tell what the rules leave open: mark-up around texts, code around very long literals.

    Settings whose rules are made of lines have such literals by nature.
    """
    return f["tokens"] >= BARE_TOKENS and f["longest_line"] >= DENSE_LINE and f["space"] <= DENSE_SPACE and (not config or f["rule_breaks"] <= BARE_BREAKS)


def judge(path: str, content: str | None, root_depth: int = 2) -> tuple[str, str, dict]:
    """(verdict, evidence, features); the verdict is '' for a hand-written file."""
    where = place(path, root_depth)
    if not content:
        return where, "place" if where else "", {}
    f = grammar_features(content)
    numeric = f["literal_share"] >= LITERAL_SHARE and f.get("literal_chars", 0) >= LITERAL_CHARS and f["literal_reuse"] <= LITERAL_REUSE
    if numeric and not is_config(path):
        return "data", "literal grammar", f
    if is_bare(f, is_config(path)):
        return "minified", "token grammar", f
    if is_dense(f, is_config(path)):
        return "minified", "layout", f
    said = banner(content)
    if said:
        return said, "banner", f
    return where, "place" if where else "", f


def is_config(path: str) -> bool:
    """Settings and mark-up hold literals by nature."""
    return bool(re.search(r"(?i)\.(?:ya?ml|xml|json|toml|ini|properties|html?|css|md|sql|csv|txt)$", path))


_OUT = pa.schema(
    [
        ("path", pa.string()), ("repository", pa.string()), ("verdict", pa.string()), ("evidence", pa.string()), ("tokens", pa.int32()),
        ("rule_reuse", pa.float64()), ("literal_share", pa.float64()), ("literal_reuse", pa.float64()), ("fingerprints", pa.list_(pa.int64())),
    ]
)


def repository(path: str, roots: frozenset[str]) -> str:
    """The longest root that the path lies under; without one, its first two folders."""
    parts = path.replace("\\", "/").split("/")
    for n in range(len(parts) - 1, 0, -1):
        if "/".join(parts[:n]) in roots:
            return "/".join(parts[:n])
    return "/".join(parts[:2])


def module_roots(modules: DataFrame | None) -> frozenset[str]:
    if modules is None:
        return frozenset()
    rows = modules.select(F.rtrim(F.lit("/"), F.replace("root_path", F.lit("\\"), F.lit("/"))).alias("r")).where("r != ''").distinct().limit(MAX_ROOTS + 1).collect()
    if len(rows) > MAX_ROOTS:
        raise ValueError(f"more than {MAX_ROOTS} module roots")
    return frozenset(r["r"] for r in rows)


def _judge_batches(roots: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            out: dict[str, list] = {name: [] for name in _OUT.names}
            for path, content in zip(rows["path"], rows["content"]):
                root = repository(path, roots)
                verdict, evidence, f = judge(path, content, root.count("/") + 1)
                out["path"].append(path)
                out["repository"].append(root)
                out["verdict"].append(verdict)
                out["evidence"].append(evidence)
                out["tokens"].append(f.get("tokens"))
                for name in ("rule_reuse", "literal_share", "literal_reuse"):
                    out[name].append(f.get(name))
                out["fingerprints"].append(f.get("fingerprints", []))
            yield pa.RecordBatch.from_pydict(out, schema=_OUT)

    return run


def path_contents(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, content): every path that files or nodes name, with its latest content that isn't null."""
    nothing = F.lit(None)
    stored = files.select("path", F.when(F.col("content").isNotNull(), F.struct("indexed_at", "content_hash", "content")).alias("f"))
    named = nodes.select(F.col("file_path").alias("path")).distinct().select("path", nothing.cast(stored.schema["f"].dataType).alias("f"))
    both = stored.unionByName(named).where("path is not null and path != ''")
    return both.groupBy("path").agg(F.max("f").alias("f")).select("path", F.col("f.content").alias("content"))


def provenance(files: DataFrame, nodes: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(path, verdict, evidence, tokens, rule_reuse, literal_share, literal_reuse, shared_rules) of every path.

    verdict: 'generated', 'minified', 'copied', 'data' or 'hand-written'.
    evidence: 'literal grammar', 'token grammar', 'layout', 'banner', 'place' or 'shared rules'.
    A repository is the longest root_path of ``modules`` that a path lies under.
    Null and '' paths are left out; null or '' content is judged by the path; of
    several rows of a path the one indexed last counts; contents are read whole.
    """
    scratch = Scratch(files.sparkSession)
    judged = scratch.write(
        path_contents(files, nodes).mapInArrow(
            _judge_batches(module_roots(modules)),
            "path string, repository string, verdict string, evidence string, tokens int, rule_reuse double, literal_share double, literal_reuse double, fingerprints array<bigint>",
        )
    )
    prints = judged.select("path", "repository", F.explode("fingerprints").alias("print"))
    per_repository = prints.groupBy("print", "repository").agg(F.count("*").alias("n"))
    shared = (
        per_repository.groupBy("print")
        .agg(F.count("*").alias("repositories"), F.sum("n").alias("files"))
        .where((F.col("repositories") >= SHARED_BY) & (F.col("files") <= SPREAD * F.col("repositories")))
        .select("print")
    )
    counted = prints.join(shared, "print").groupBy("path").agg(F.count("*").alias("shared_rules"))
    rules = F.coalesce("shared_rules", F.lit(0))
    copied = (rules >= SHARED_RULES) & (rules >= SHARED_TOKENS * F.size("fingerprints"))
    return judged.join(counted, "path", "left").select(
        "path",
        F.when(F.col("verdict") != "", F.col("verdict")).when(copied, "copied").otherwise("hand-written").alias("verdict"),
        F.when(F.col("verdict") != "", F.col("evidence")).when(copied, "shared rules").otherwise("").alias("evidence"),
        "tokens",
        "rule_reuse",
        "literal_share",
        "literal_reuse",
        rules.alias("shared_rules"),
    )
