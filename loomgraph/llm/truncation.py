"""Texts that were cut off by a field or a transfer.

First the text alone is looked at: marks of a cut at its end, brackets, quotes
and fences that stay open. A text that ends in none of these ways and not with
the end of a sentence is open, and the corpus decides. Its last word is held
against the trie of the corpus vocabulary: an unknown word that begins known
words was cut. The last words together are held against all places where the
corpus has them: if the text goes on there nearly always, it was cut here too.
A length at which many texts of the source pile up lowers the bar.

The corpus is tokenised once for all counts. The open texts leave a few keys
each, 64-bit hashes of words; they fill a Bloom filter whose size follows their
number, and the pass over the corpus counts only places whose key is in it, so
that what is shuffled follows the open texts, not all n-grams. What depends on
a word alone is worked out once per word and task; places are numpy arrays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import Scratch

FILTER_BITS = 16  # a key, in the filter of keys
MAX_FILTER_WORDS = 1 << 22  # of 64 bits: 32 MB; with more keys more places pass, and the join drops them
SUPPORT = 20  # places that a context needs in the corpus
GOES_ON = 0.01  # share of places with an end, up to which a text was cut
GOES_ON_AT_LIMIT = 0.08  # the same for texts whose length is a limit of their source
KNOWN_END = 3  # places where the same two or three words end a text or line
KNOWN_END_RATE = 0.8  # and their share, from which they are an end here too
LONGER_SHARE = 0.05  # texts that end with a word after its neighbour, against places with a longer word there: more is a habit
MARK_CHARS = 120  # no mark is longer
LAST_TOKENS = 8  # more than the contexts of an end take
NEAR = 12  # lengths on either side that a length is compared with
FLUSH = 200_000  # words or keys that a task keeps

# Marks that systems put where they cut a text.
CUT_MARK = re.compile(
    r"(?i)\s*(?:\(?\[?\(?\s*(?:message|text|content|output|body|comment|mail|log)?\s*(?:clipped|truncated|cut off|shortened|abgeschnitten|gekürzt|tronqué|truncado|recortado|已截断|截断)\s*\)?\]?|\[\s*(?:\.{2,}|…)\s*\]|<\s*(?:snip|truncated)\s*>|(?:read|show|view) more|\(continued\))\s*[.…]*$"
)
MARK_SIGN = re.compile(r"(?i)clipped|truncated|cut off|shortened|abgeschnitten|gekürzt|tronqué|truncado|recortado|截断|\[\s*(?:\.\.|…)|<\s*snip|more|continued")
ELLIPSIS = re.compile(r"\s*(?:…|\.\.\.)$")
ENDS = frozenset(".!?。！？")
CLOSERS = "\"'”’»)]*_"

_TOKEN = re.compile(r"\n\s*|[㐀-鿿]|[^\W\d_㐀-鿿][^\W㐀-鿿]*(?:-[^\W\d_㐀-鿿][^\W㐀-鿿]*)*|\d+|[^\w\s]|_")
_CAMEL = re.compile(r"^[a-z]+[A-Z]|^[A-Z][a-z]+[A-Z]")
_LAST_PIECE = re.compile(r"[A-Z][a-z0-9]*$")
_CODE_START = re.compile(r"\s*(?:package |import |from [\w.]+ import |export |public |class |function |def |#include|@\w+|/\*\*|\{|\[|<\?xml|<\w+[ >])")
_STRINGS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_COMMENTS = re.compile(r"/\*.*?\*/|//[^\n]*|(?m:^[ \t]*#[^\n]*)", re.S)


# The same tokens of a text in ASCII, with its shorter classes.
_ASCII_TOKEN = re.compile(r"\n[\s\x1c-\x1f]*|[A-Za-z]\w*(?:-[A-Za-z]\w*)*|\d+|[^\w\s\x1c-\x1f]|_", re.A)


def tokens(text: str) -> list[str]:
    return (_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text)


def last_tokens(text: str) -> list[str]:
    """At least the last LAST_TOKENS tokens of a text, each as tokens() finds it in the whole text."""
    size = 160
    while size < len(text):
        tail = text[-size:]
        blank = _BLANK.search(tail)
        if blank:
            found = tokens(tail[blank.end() :])
            # The first one may be what is left of a line end.
            if len(found) > LAST_TOKENS:
                return found
        size *= 4
    return tokens(text)


_BLANK = re.compile(r"\s")


def mask(token: str) -> str:
    """Numbers and names of code stand for their kind; other words for themselves."""
    first = token[0]
    if first == "\n":
        return "\n"
    if first.isdigit():
        return "#"
    if _CAMEL.match(token):
        return "Xx" if first.isupper() else "xX"
    return token


def piece(token: str) -> str:
    """The last part of a name in camel case, with the case of its first letter; else the word."""
    if _CAMEL.match(token):
        last = _LAST_PIECE.search(token)
        return ("^" if token[0].isupper() else "~") + (last.group() if last else token)
    return token


# -- keys: 64-bit hashes ------------------------------------------------------

START = "^"  # stands before the first word of a text
_ONE = np.uint64(1)
_ODD = [np.uint64(int(xxhash.xxh64_intdigest(f"factor {i}")) | 1) for i in range(12)]


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * _ODD[1] + b * _ODD[2])


def context_key(kind: int, pair: np.ndarray) -> np.ndarray:
    """Key of a pair of words as a context: kind 0 the last two, 1 with one word, 2 with two words between them and the end."""
    return _mixed(pair * _ODD[3 + kind])


def triple_key(a: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return _mixed(a * _ODD[6] + pair * _ODD[7])


def near_key(before: np.ndarray, beginning: np.ndarray) -> np.ndarray:
    return _mixed(before * _ODD[8] + beginning * _ODD[9])


def structure(text: str) -> str:
    """'cut', 'whole' or 'unknown', from brackets, quotes and fences alone."""
    head = text.lstrip()[:1]
    if head in ("{", "[") and re.match(r"\s*(?:\{\s*\"|\[\s*[\[{\"\d])", text):
        try:
            json.loads(text)
            return "whole"
        except RecursionError:
            return "cut" if _unclosed(text) else "unknown"
        except ValueError as error:
            return "cut" if _unclosed(text) or "Expecting" in str(error) and error.pos >= len(text.rstrip()) - 1 else "unknown"
    fences = len(re.findall(r"(?m)^```", text))
    if fences % 2:
        return "cut"
    if not fences and _CODE_START.match(text):
        if text.rfind("/*") > text.rfind("*/") or text.count('"""') % 2:
            return "cut"
        if _unclosed(text):
            return "cut"
        last = text.rstrip().split("\n")[-1].rstrip()
        if last.endswith((":", ",", "(", "=", "&&", "||", "+", ".")) and not last.lstrip().startswith(("#", "//", "*")):
            return "cut"
    elif text.split("\n")[-1].count("`") % 2 and not fences:
        return "cut"
    return "unknown"


def _unclosed(text: str) -> bool:
    plain = _COMMENTS.sub(" ", _STRINGS.sub('""', text))
    return any(plain.count(a) > plain.count(b) for a, b in ("{}", "()", "[]"))


def without_mark(text: str) -> str:
    """The text up to a mark of a cut, so that what stands before it counts as the end."""
    text = text.rstrip()
    tail = text[-MARK_CHARS:]
    kept = ELLIPSIS.sub("", CUT_MARK.sub("", tail) if MARK_SIGN.search(tail) else tail)
    return text[: len(text) - len(tail) + len(kept)].rstrip()


def first_look(text: str | None) -> tuple[str, list[str]]:
    """(state, last tokens): 'empty', 'cut', 'whole' or 'open'; tokens only of an open text."""
    stripped = (text or "").rstrip()
    if not stripped.strip():
        return "empty", []
    tail = stripped[-MARK_CHARS:]
    if MARK_SIGN.search(tail) and CUT_MARK.search(tail):
        return "cut", []
    shape = structure(stripped)
    if shape != "unknown":
        return shape, []
    plain = ELLIPSIS.sub("", stripped) if stripped[-1] in ".…" else stripped
    dots = plain != stripped
    if dots and plain[-1:] in ENDS and len(plain) > 1:
        return "cut", []  # a mark behind a finished sentence
    key_line = stripped[-1] == "." and not re.search(r"\s|[㐀-鿿]", stripped[stripped.rfind("\n") + 1 :])
    if not dots and not key_line and (stripped[-1] in ENDS or stripped[-1] in CLOSERS and stripped.rstrip(CLOSERS)[-1:] in ENDS):
        return "whole", []
    if stripped.endswith("```"):
        return "whole", []
    words = last_tokens(plain)
    return ("open", words) if words else ("whole", [])


# Keys of an open text: A to D its contexts, V its last piece as a word, T as a beginning, E its last word behind the one before.
# L, P and N only tell the pass over the corpus which ends, words before and beginnings are looked for.
KINDS = ("A", "B", "C", "D", "V", "T", "E", "L", "P", "N")
_FIRST = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("chars", pa.int32()), ("state", pa.string()), ("keys", pa.list_(pa.int64()))])
_FIRST_DDL = "doc_id bigint, source string, chars int, state string, keys array<bigint>"


def _kind_hash(kind: str, word: str) -> int:
    return xxhash.xxh64_intdigest(kind + "\x1f" + word)


def _end_keys(ends: list[list[str]]) -> list[list[int]]:
    """The keys of each text by its last tokens, in the order of KINDS; 0 where a kind doesn't apply."""
    place = np.array([[word_hash(mask(w)) for w in [START] * max(0, 4 - len(t)) + t[-4:]] for t in ends], dtype=np.uint64).reshape(len(ends), 4)
    a, b, c, d = place.T
    last = pair_hash(c, d)
    rows = np.zeros((len(ends), len(KINDS)), dtype=np.uint64)
    rows[:, 0], rows[:, 1] = context_key(0, last), triple_key(b, last)
    rows[:, 2], rows[:, 3] = context_key(1, pair_hash(b, c)), context_key(2, pair_hash(a, b))
    letters = np.array([t[-1][0].isalpha() for t in ends], dtype=bool)
    beginning = np.array([word_hash(t[-1]) for t in ends], dtype=np.uint64)
    rows[:, 6] = np.where(letters, near_key(c, beginning), 0)
    for row, words in zip(rows, ends):
        row[7] = _kind_hash("L", mask(words[-1]))
        if words[-1][0].isalpha():
            row[4], row[5] = _kind_hash("V", piece(words[-1])), _kind_hash("T", piece(words[-1]))
            row[8], row[9] = _kind_hash("P", mask(words[-2]) if len(words) > 1 else START), _kind_hash("N", words[-1])
    return rows.view(np.int64).tolist()


def _first_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        looks = [first_look(text) for text in rows["text"]]
        at = [i for i, look in enumerate(looks) if look[0] == "open"]
        keys: list[list[int]] = [[]] * len(looks)
        for i, row in zip(at, _end_keys([looks[i][1] for i in at]) if at else []):
            keys[i] = row
        out = {"doc_id": rows["doc_id"], "source": rows["source"], "chars": [len(t or "") for t in rows["text"]], "state": [s for s, _ in looks], "keys": keys}
        yield pa.RecordBatch.from_pydict(out, schema=_FIRST)


def _filter_places(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key and the two bits that it sets there."""
    word = (keys >> np.uint64(20)) % np.uint64(words)
    return word, _ONE << (keys & np.uint64(63)) | _ONE << ((keys >> np.uint64(6)) & np.uint64(63))


def _bit_rows(words: int):
    schema = pa.schema([("word", pa.int32()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bits = _filter_places(np.asarray(batch.column(0)).view(np.uint64), words)
            order = np.argsort(word, kind="stable")
            word, bits = word[order], bits[order]
            first = np.flatnonzero(np.diff(word, prepend=np.uint64(2**63)))
            merged = np.bitwise_or.reduceat(bits, first) if len(first) else bits
            yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int32)), pa.array(merged.view(np.int64))], schema=schema)

    return run


def key_filter(keys: DataFrame, n_keys: int) -> np.ndarray:
    """A Bloom filter of the keys (bigint), built by all tasks."""
    size = int(min(MAX_FILTER_WORDS, max(1_024, n_keys * FILTER_BITS // 64)))
    rows = keys.mapInArrow(_bit_rows(size), "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size, dtype=np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint64)


class _Known(dict):
    """Whether the filter holds the hash of a string, by string."""

    def __init__(self, kind: str, words: np.ndarray):
        self.prefix, self.words, self.size = kind + "\x1f", words, len(words)

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(self.prefix + word)
        bits = int(self.words[(h >> 20) % self.size])
        hit = self[word] = h if bits >> (h & 63) & 1 and bits >> (h >> 6 & 63) & 1 else 0
        return hit


_COUNTS = pa.schema([("key", pa.int64()), ("ends", pa.int64()), ("goes_on", pa.int64()), ("finals", pa.int64())])
FINAL, CLOSED, GOES = 0, 1, 2
_CAMEL_PIECE = re.compile(r"[A-Z][a-z0-9]*")


def known_entries(word: str) -> set[str]:
    """What a last piece may be unfinished against, when ``word`` stands in the corpus.

    These are the trie's inner nodes: every proper beginning of the word's last
    piece and of the parts of a name, for parts with and without the sign of
    camel case, since a name may be cut inside its first part. The last part of
    a name that is known only inside names is unfinished as well.
    """
    entries = [piece(word)]
    if _CAMEL.match(word):
        sign = "^" if word[0].isupper() else "~"
        entries += [sign + part for part in _CAMEL_PIECE.findall(word)[:-1]]
    out: set[str] = set()
    for entry in entries:
        out.update(entry[:k] for k in range(1, len(entry)))
        if entry[0] in "^~":
            out.add(entry)
            out.update(entry[1:k] for k in range(2, len(entry) + 1))
    return out


class _Words(dict):
    """Numbers of the words of a task, with what depends on the word alone."""

    def __init__(self, words: np.ndarray):
        self.filter = words
        self.ends, self.befores, self.vocabulary, self.begins, self.near = (_Known(k, words) for k in "LPVTN")
        self.words: list[str] = []
        self.hashes: list[int] = []
        self.flags: list[int] = []  # bits: 1 ends a context, 2 asked before a last word, 4 has a wanted beginning, 8 closes, 16 ';', 32 line end
        self[START_SIGN]  # noqa: B018 - number 0

    def __missing__(self, word: str) -> int:
        masked = START if word == START_SIGN else mask(word)
        number = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(word_hash(masked))
        flag = (1 if self.ends[masked] else 0) | (2 if self.befores[masked] else 0)
        if word[0].isalpha() and any(self.near[word[:k]] for k in range(1, len(word))):
            flag |= 4
        flag |= (8 if masked == "\n" or masked in ENDS else 0) | (16 if masked == ";" else 0) | (32 if masked == "\n" else 0)
        self.flags.append(flag)
        return number


START_SIGN = "\x00start"


def count_places(shared):
    """Counts, for keys that the filter holds, how often the corpus ends there and how often it goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = shared.value
        size = np.uint64(len(words_of))
        known = _Words(words_of)
        seen = np.zeros(0, dtype=np.int64)  # places of each word that aren't the end of a text
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (keys, what follows there)

        def held(keys: np.ndarray) -> np.ndarray:
            bits = words_of[(keys >> np.uint64(20)) % size]
            return ((bits >> (keys & np.uint64(63))) & (bits >> ((keys >> np.uint64(6)) & np.uint64(63))) & _ONE).astype(bool)

        def places(texts: list[str]) -> None:
            nonlocal seen
            ids: list[int] = []
            lasts: list[int] = []
            for text in texts:
                words = tokens(without_mark(text))
                if words:
                    ids += (0, 0, 0)
                    ids += [known[w] for w in words]
                    lasts.append(len(ids) - 1)
            if not lasts:
                return
            n = np.array(ids, dtype=np.int64)
            flags, hashes = np.array(known.flags, dtype=np.int8)[n], np.array(known.hashes, dtype=np.uint64)[n]
            last = np.zeros(len(n) + 2, dtype=bool)
            last[lasts] = True
            follow = np.append(flags, [0, 0])
            after = follow[1:-1]
            closes = (after & 8 > 0) | (after & 16 > 0) & (last[1:-1] | (follow[2:] & 32 > 0))
            last = last[:-2]
            kind = np.where(last, FINAL, np.where(closes, CLOSED, GOES)).astype(np.int8)
            real = np.flatnonzero(n)
            pair = pair_hash(np.roll(hashes, 1), hashes)
            ending = real[flags[real] & 1 > 0]
            for at, keys in (
                (ending, context_key(0, pair[ending])),
                (ending, triple_key(hashes[ending - 2], pair[ending])),
                (real, context_key(1, pair[real - 1])),
                (real, context_key(2, pair[real - 2])),
            ):
                hit = held(keys)
                found.append((keys[hit], kind[at[hit]]))
            inner = n[real[~last[real]]]
            counted = np.bincount(inner, minlength=len(known.words))
            counted[: len(seen)] += seen
            seen = counted
            begun = real[(flags[real] & 4 > 0) & (flags[real - 1] & 2 > 0)]
            codes, times = np.unique(n[begun - 1] * len(known.words) + n[begun], return_counts=True)
            longer, before, many = [], [], []
            for code, count in zip(codes.tolist(), times.tolist()):
                first, second = divmod(code, len(known.words))
                word = known.words[second]
                for k in range(1, len(word)):
                    if known.near[word[:k]]:
                        longer.append(word_hash(word[:k]))
                        before.append(known.hashes[first])
                        many.append(count)
            if longer:
                keys = near_key(np.array(before, dtype=np.uint64), np.array(longer, dtype=np.uint64))
                hit = held(keys)
                found.append((np.repeat(keys[hit], np.array(many)[hit]), np.full(int(np.array(many)[hit].sum()), GOES, dtype=np.int8)))

        def flush() -> pa.RecordBatch:
            nonlocal seen, known
            keys = np.concatenate([k for k, _ in found]) if found else np.zeros(0, dtype=np.uint64)
            kinds = np.concatenate([k for _, k in found]) if found else np.zeros(0, dtype=np.int8)
            unique, where = np.unique(keys, return_inverse=True)
            counts = [np.bincount(where, weights=kinds == what, minlength=len(unique)).astype(np.int64) for what in (CLOSED, GOES, FINAL)]
            extra: dict[int, int] = {}
            for number in np.flatnonzero(seen).tolist():
                word = known.words[number]
                if not word[0].isalpha():
                    continue
                key = known.vocabulary[piece(word)]
                if key:
                    extra[key] = extra.get(key, 0) + int(seen[number])
                for entry in known_entries(word):
                    key = known.begins[entry]
                    if key:
                        extra[key] = extra.get(key, 0) + 1
            more = np.array(list(extra), dtype=np.uint64)
            unique = np.concatenate([unique, more]).view(np.int64)
            none = np.zeros(len(more), dtype=np.int64)
            columns = [unique, np.concatenate([counts[0], none]), np.concatenate([counts[1], np.array(list(extra.values()), dtype=np.int64)]), np.concatenate([counts[2], none])]
            found.clear()
            seen = np.zeros(0, dtype=np.int64)
            if len(known.words) > FLUSH:
                known = _Words(words_of)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_COUNTS)

        for batch in batches:
            texts = batch.column(0).to_pylist()
            # Long texts are taken a few at a time, so that the arrays stay small.
            start, chars = 0, 0
            for at, text in enumerate(texts, 1):
                chars += len(text)
                if chars > 4_000_000 or at == len(texts):
                    places(texts[start:at])
                    start, chars = at, 0
            if len(known.words) > FLUSH or sum(len(k) for k, _ in found) > 4 * FLUSH:
                yield flush()
        yield flush()

    return run


def source_name(column: str = "source"):
    """Sources are written in different case and with blanks around."""
    return F.lower(F.trim(F.col(column)))


def length_limits(looked: DataFrame) -> DataFrame:
    """(source, chars) of lengths at which far more texts of a source lie than at the lengths around them."""
    per = looked.where("state != 'empty'").groupBy("source", "chars").agg(F.count("*").alias("n"))
    around = per.select("source", F.explode(F.sequence(F.col("chars") - NEAR, F.col("chars") + NEAR)).alias("chars"), "n").groupBy("source", "chars").agg(F.sum("n").alias("near"))
    same = [F.col("p.source").eqNullSafe(F.col("a.source")), F.col("p.chars") == F.col("a.chars")]
    usual = (F.col("near") - F.col("n")) / (2 * NEAR)
    near = per.alias("p").join(around.alias("a"), same).select("p.source", "p.chars", "n", usual.alias("usual"))
    return near.where("chars >= 40 and n >= 4 and n >= 6 * usual").select("source", "chars")


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, state, why): every document that isn't empty, state 'cut' or 'whole'.

    Null, '' and blank texts are left out, so are null doc_ids; repeated texts
    are judged alike, and counted once in the corpus; a null source is a source
    of its own; an empty table gives no rows. Every text is read whole for the
    counts; a mark of a cut is looked for where it ends.
    """
    scratch = Scratch(documents.sparkSession)
    docs = documents.where("doc_id is not null").select("doc_id", source_name().alias("source"), "text")
    looked, sizes = scratch.counted(docs.mapInArrow(_first_batches, _FIRST_DDL), open=F.count_if(F.col("state") == "open"))
    opened = looked.where("state = 'open'").select("doc_id", "keys")
    wanted = opened.select(F.explode(F.array_distinct("keys")).alias("key")).where("key != 0")
    shared = documents.sparkSession.sparkContext.broadcast(key_filter(wanted, sizes["open"] * len(KINDS)))
    texts = documents.where("text is not null and text != ''").select("text").distinct()
    counted = texts.mapInArrow(count_places(shared), "key bigint, ends bigint, goes_on bigint, finals bigint")
    counts = counted.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("ends", "goes_on", "finals")])
    judging = len(KINDS) - 3
    asked = opened.select("doc_id", F.posexplode(F.slice("keys", 1, judging)).alias("at", "key")).where("key != 0")

    kinds = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("at") + 1)
    evidence = asked.join(counts, "key", "left").select(
        "doc_id",
        kinds.alias("kind"),
        F.coalesce("ends", F.lit(0)).alias("ends"),
        F.coalesce("goes_on", F.lit(0)).alias("goes_on"),
        F.greatest(F.coalesce("finals", F.lit(0)) - 1, F.lit(0)).alias("finals"),
    )
    rate = (F.col("ends") + F.col("finals")) / (F.col("ends") + F.col("finals") + F.col("goes_on"))
    in_context = F.col("kind").isin("A", "B", "C", "D") & (F.col("ends") + F.col("finals") + F.col("goes_on") >= SUPPORT)
    summed = evidence.groupBy("doc_id").agg(
        F.sum(F.when(F.col("kind") == "V", F.col("goes_on"))).alias("word_seen"),
        F.max(F.when(F.col("kind") == "T", F.col("goes_on") > 0)).alias("unfinished"),
        F.sum(F.when(F.col("kind") == "A", F.col("ends") + F.col("goes_on"))).alias("pair_seen"),
        F.sum(F.when(F.col("kind") == "A", F.col("finals"))).alias("pair_finals"),
        F.sum(F.when(F.col("kind") == "E", F.col("goes_on"))).alias("longer_seen"),
        F.min(F.when(in_context, rate)).alias("end_rate"),
        F.max(F.when(F.col("kind").isin("A", "B", "C") & (F.col("ends") + F.col("finals") >= KNOWN_END), rate)).alias("known_end"),
    )
    limits = length_limits(looked).withColumn("at_limit", F.lit(True))
    # Null sources are compared as equal here.
    same = [F.col("l.source").eqNullSafe(F.col("o.source")), F.col("l.chars") == F.col("o.chars")]
    judged = (
        looked.where("state != 'empty'").alias("o")
        .join(limits.alias("l"), same, "left")
        .select("o.doc_id", "o.source", "o.chars", "o.state", F.coalesce("l.at_limit", F.lit(False)).alias("at_limit"))
        .join(summed, "doc_id", "left")
    )
    # Ends that are few against longer words at the same place are other cuts, no habit.
    few = F.coalesce("pair_finals", F.lit(0)) <= LONGER_SHARE * F.coalesce("longer_seen", F.lit(0))
    begun_longer = (F.coalesce("longer_seen", F.lit(0)) >= 3) & few
    bar = F.when(F.col("at_limit"), GOES_ON_AT_LIMIT).otherwise(GOES_ON)
    why = (
        F.when(F.col("state") == "cut", "mark or structure")
        .when(F.col("state") == "whole", None)
        .when(F.col("unfinished") & (F.coalesce("word_seen", F.lit(0)) == 0), "unfinished word")
        .when((F.col("pair_seen") == 0) & begun_longer, "unfinished word after its neighbour")
        .when((F.col("end_rate") <= bar) & ((F.coalesce("known_end", F.lit(0.0)) < KNOWN_END_RATE) | begun_longer), "goes on elsewhere")
    )
    return judged.select("doc_id", "source", "chars", "at_limit", why.alias("why")).withColumn(
        "state", F.when(F.col("why").isNotNull(), "cut").otherwise("whole")
    )


def truncation_rates(judged: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, their share, and how many were cut at a length limit."""
    cut = F.col("state") == "cut"
    return judged.groupBy("source").agg(
        F.count("*").alias("n_texts"),
        F.sum(cut.cast("long")).alias("n_cut"),
        F.round(F.avg(cut.cast("double")), 6).alias("share"),
        F.sum((cut & F.col("at_limit")).cast("long")).alias("n_cut_at_limit"),
    )
