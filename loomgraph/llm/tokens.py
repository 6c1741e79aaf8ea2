"""Token counts of texts, by a public tokenizer whose files lie outside the repository."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECE = 20_000
RUN = 4_000


def pieces(text: str) -> list[str]:
    """Texts of more than PIECE characters in parts that encode as the whole does.

    Tokens never reach across the start of white space, so a part may end
    there. A run without any such place is cut after RUN characters: there,
    and only there, the count can be a little higher than that of the whole.
    """
    out, at = [], 0
    while len(text) - at > PIECE:
        end = at + PIECE
        found = _BOUNDARY.search(text, at + PIECE // 2, end)
        cut = found.start() + 1 if found else at + RUN
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


_BOUNDARY = re.compile(r"\S(?=\s)")


def encode(text: str, path: str = TOKENIZER) -> list[int]:
    run = encoding(path).encode_ordinary
    if len(text) <= PIECE:
        return run(text)
    return [token for piece in pieces(text) for token in run(piece)]


def count_batches(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            counts = [len(encode(text, path)) if text else 0 for text in rows["text"]]
            yield pa.RecordBatch.from_pydict({"doc_id": rows["doc_id"], "source": rows["source"], "tokens": counts}, schema=schema)

    return run


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) from (doc_id, source, text); null and '' have no tokens."""
    return documents.select("doc_id", "source", "text").mapInArrow(count_batches(path), "doc_id bigint, source string, tokens bigint")
