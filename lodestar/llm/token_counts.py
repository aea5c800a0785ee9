"""Token counts: the tokenizers library encodes batches inside Arrow functions and only lengths come back.

Rows of a batch are dealt to calls by bytes, so that no call holds much more than ``call_bytes`` of text.  A text longer
than that is split at safe boundaries: a letter, digit or mark followed by one space and a letter, or a full-width mark
followed by a letter.  The pre-tokeniser ``\\p{L}+ | \\p{N}+ | other`` always ends there, since a single space belongs to the
word after it, so the parts' tokens are the text's tokens.  A cut is never made inside or next to an added special token's string.

Defined results: null counts as the empty text (0 tokens); a stretch without a safe boundary stays whole; equal rows
give equal results; other columns are ignored.  Special strings inside texts are taken as the library takes them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import arrow_limits, texts

CALL_BYTES = 1 << 18
LIMIT = 1024
#: A place before a single space between a letter, digit or mark and a letter, or after a full-width mark and before a letter;
#: no special string of the vocabularies holds one.
SAFE = re.compile(r"(?<=[^\W_]|[.,;:!?])(?= [^\W\d_])|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[^\W\d_])")


@cache
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the tasks
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def split_safely(text: str, size: int) -> list[str]:
    """Parts of about size characters, cut at safe boundaries only."""
    parts, begin = [], 0
    while len(text) - begin > size:
        m = SAFE.search(text, begin + size)
        if not m:
            break
        parts.append(text[begin : m.start()])
        begin = m.start()
    parts.append(text[begin:])
    return parts


def balanced(parts: list[str], limit: int) -> Iterator[list[str]]:
    """Calls of about limit bytes (of UTF-8): what is longest goes first, so that a call's texts are alike in length."""
    call, size = [], 0
    for p in parts:
        n = len(p.encode())
        if call and size + n > limit:
            yield call
            call, size = [], 0
        call.append(p)
        size += n
    if call:
        yield call


def token_counts(docs: DataFrame, path: str, call_bytes: int = CALL_BYTES, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document. path must be readable on every node."""
    arrow_limits(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            values = [x or "" for x in b.column(1).to_pylist()]
            owner, parts = [], []
            for k, x in enumerate(values):
                for p in split_safely(x, call_bytes) if len(x) > call_bytes else (x,):
                    owner.append(k)
                    parts.append(p)
            order = sorted(range(len(parts)), key=lambda j: -len(parts[j]))
            n = [0] * len(values)
            at = 0
            for call in balanced([parts[j] for j in order], call_bytes):
                for e in t.encode_batch_fast(call, add_special_tokens=False):
                    n[owner[order[at]]] += len(e)
                    at += 1
            size = [len(x.encode()) for x in values]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
