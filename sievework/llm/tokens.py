"""p6: token ids of a whole corpus under a public byte-level tokenizer.

The rank file is read once by the driver and sent to the executors (it doesn't grow with the data).
Long texts are cut where a word character or punctuation is followed by white space: the tokenizer's
pattern never matches across such a place, and its one look-ahead only looks from white space on, so
the pieces' ids joined are the text's ids.  Decoding works on raw bytes, since a character's bytes
may lie in several tokens.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-splitting pattern that belongs to the rank file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of a text that go through the tokenizer at a time, at least.
PIECE = 16_384
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


def read_ranks(path: str = DEFAULT_RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def _ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


@functools.lru_cache(maxsize=2)
def encoding(content: bytes):
    import tiktoken

    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=_ranks(content), special_tokens={})


def pieces(text: str, size: int = PIECE):
    """The text cut at the first safe place behind every ``size`` characters."""
    a = 0
    while len(text) - a > size:
        m = _SAFE.search(text, a + size)
        if m is None:
            break
        yield text[a : m.start()]
        a = m.start()
    yield text[a:]


def encode(content: bytes, text: str | None) -> np.ndarray:
    """The text's ids; none for an empty or null text."""
    if not text:
        return np.zeros(0, np.int32)
    own = encoding(content)
    parts = [own.encode_ordinary(p) for p in pieces(text)]
    return np.array(parts[0] if len(parts) == 1 else [i for p in parts for i in p], np.int32)


def decode(content: bytes, ids) -> str:
    """The text of ids, by their bytes; bytes that aren't UTF-8 come out as U+FFFD."""
    return encoding(content).decode_bytes(list(ids)).decode("utf-8", "replace")


def _encoder(shared, lengths_only: bool):
    def run(batches):
        content = shared.value
        for batch in batches:
            ids = [encode(content, t) for t in batch.column(1).to_pylist()]
            size = np.zeros(len(ids) + 1, np.int64)
            np.cumsum([len(x) for x in ids], out=size[1:])
            if lengths_only:
                out = pa.array(np.diff(size), pa.int64())
            else:
                out = pa.ListArray.from_arrays(pa.array(size.astype(np.int32)), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", "n_tokens" if lengths_only else "ids"])

    return run


def _pair(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def token_ids(documents: DataFrame, ranks: str = DEFAULT_RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids: array<int>): one row for each row of the input, in whatever state its text is.

    Null, empty: an empty list.  Blank texts are encoded like others.  Strings that look like special
    tokens are ordinary text.  Null and repeated keys are kept.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    return _pair(documents, key, text).mapInArrow(_encoder(shared, False), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, ranks: str = DEFAULT_RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens): the lengths of ``token_ids``."""
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    return _pair(documents, key, text).mapInArrow(_encoder(shared, True), "doc_id bigint, n_tokens bigint")


def texts_of(encoded: DataFrame, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, text): ids decoded by raw bytes; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches):
        content = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else decode(content, x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
