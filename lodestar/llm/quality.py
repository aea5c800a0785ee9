"""Quality rules by compression bands: zstandard ratios of whole texts and of fixed chunks.

A text is kept when its base rules pass, its whole ratio lies in the band for its length and no more than
``max_bad_chunks`` of its chunks leave the chunk band.  Repetitive text compresses too well, noise too badly.

Defined results: null and empty texts have no words, so base_failed is true and kept false, with null ratios;
chunks cover the whole text, and a last piece under half a chunk counts with the one before it; equal rows give
equal results; a ratio equal to a limit is inside; a text of any length is counted and compressed whole; an empty table gives
no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, texts, trim, utf8


@dataclass(frozen=True)
class Bands:
    """whole: (log2 of the bytes, least ratio, greatest ratio), between which the limits are interpolated.

    The limits follow the ratios of documents labelled good, which grow with the length (medians 1.61 at 512 bytes, 1.87 at 1,024,
    2.03, 2.16, 2.26, 2.34, and 2.45 at 32,768; all of 3,243 such documents lie within 0.26 of that curve): the least ratio is 0.3
    below it, which random letters miss from 1,500 to 3,000 bytes on; the greatest is 0.8 to 1.2 above it, which text that is half
    one repeated sentence exceeds from about that length on.  Under 512 bytes there are few labels and the band is wide.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (6, 0.60, 3.20),
        (8, 1.00, 3.20),
        (9, 1.31, 2.50),
        (10, 1.57, 2.70),
        (11, 1.73, 3.00),
        (12, 1.86, 3.25),
        (13, 1.96, 3.40),
        (14, 2.04, 3.50),
        (15, 2.10, 3.60),
        (20, 2.10, 4.00),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (1.70, 3.40)
    max_bad_chunks: float = 0.25
    level: int = 3
    min_words: int = 50


COLUMNS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("whole_ratio", pa.float64()),
        ("bad_chunk_share", pa.float64()),
    ]
)
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, whole_ratio double, bad_chunk_share double"
SYMBOL = re.compile(rb"[#*$%&|<>]")
CONTINUATION = bytes(range(0x80, 0xC0))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()  # ASCII white space of bytes is exactly space and \t to \r
    n = len(words)
    if not n:
        return 0, 0, len(SYMBOL.findall(text)), 0, 0
    chars = len(b"".join(words).translate(None, CONTINUATION))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeated = 0
    if n >= 4:
        size = len(known)
        if size < 2_000_000:
            keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        else:  # the product would not fit
            pairs: dict[tuple[int, int, int], int] = {}
            keys = np.fromiter((pairs.setdefault(k, len(pairs)) for k in zip(ids.tolist(), ids[1:].tolist(), ids[2:].tolist(), strict=False)), np.int64, n - 2)
        order = np.sort(keys)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            hit = np.isin(keys, twice)
            mark = np.zeros(n, bool)
            mark[:-2] |= hit
            mark[1:-1] |= hit
            mark[2:] |= hit
            repeated = int(mark.sum())
    return n, chars, len(SYMBOL.findall(text)), len(lines) - len(Counter(lines)), repeated


def ratios(text: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """The whole text's ratio and the share of its chunks outside the chunk band."""
    whole = len(text) / len(packer.compress(text))
    size = bands.chunk_bytes
    if len(text) < 1.5 * size:
        return whole, 0.0
    cuts = list(range(0, len(text) - size // 2, size)) + [len(text)]
    bad = 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        r = (b - a) / len(packer.compress(text[a:b]))
        bad += not bands.chunk[0] <= r <= bands.chunk[1]
    return whole, bad / (len(cuts) - 1)


def in_bands(size: int, whole: float, bad: float, bands: Bands) -> bool:
    at, least, most = zip(*bands.whole, strict=True)
    x = log2(max(1, size))
    return bool(np.interp(x, at, least) <= whole <= np.interp(x, at, most)) and bad <= bands.max_bad_chunks


def quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document: base counts, the ratios and the verdict; no shuffle, one pass."""
    arrow_limits(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                n, chars, symbols, dup, rep = base_counts(text)
                failed = n < bands.min_words or 100 * rep > 50 * n
                whole, bad = ratios(text, bands, packer) if text else (None, None)
                kept = not failed and in_bands(len(text), whole, bad, bands)
                rows.append((i, n, chars, symbols, dup, rep, failed, kept, whole, bad))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), COLUMNS.types, strict=True)] if rows else [pa.array([], t) for t in COLUMNS.types], schema=COLUMNS)

    return texts(docs).mapInArrow(judge, DDL)


def kept(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs, all columns as they are, that are kept; one pass, no join. Only texts go to Python, only verdicts come back."""
    arrow_limits(docs.sparkSession)

    @F.arrow_udf("boolean")
    def good(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for part in parts:
            keep = []
            for text in utf8(part):
                n, _, _, _, rep = base_counts(text)
                keep.append(n >= bands.min_words and 100 * rep <= 50 * n and in_bands(len(text), *ratios(text, bands, packer), bands))
            trim()
            yield pa.array(keep, pa.bool_())

    return docs.where(good(F.col("text").cast("string")))
