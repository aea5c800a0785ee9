"""Blocked exchange: tasks pack what belongs to a block into one binary message, and a block's messages meet in one place.

A block is a range of hash values; there are as many as the text needs, so a block stays small however much there is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import trim

MESSAGE = "block int, payload binary"
_SCHEMA = pa.schema([("block", pa.int32()), ("payload", pa.binary())])


def pack(*columns: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed string."""
    raw = []
    for c in columns:
        data = c if isinstance(c, bytes) else np.ascontiguousarray(c)
        kind = b"" if isinstance(data, bytes) else data.dtype.str.encode()
        body = data if isinstance(data, bytes) else data.tobytes()
        raw += [len(kind).to_bytes(1, "little"), kind, len(body).to_bytes(8, "little"), body]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpack(payload: bytes) -> list:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    out, at = [], 0
    while at < len(raw):
        k = raw[at]
        kind = raw[at + 1 : at + 1 + k].decode()
        at += 1 + k
        n = int.from_bytes(raw[at : at + 8], "little")
        body = raw[at + 8 : at + 8 + n]
        out.append(np.frombuffer(body, kind) if kind else body)
        at += 8 + n
    return out


def messages(pairs: Iterator[tuple[int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """(block, payload) as record batches of bounded size."""
    blocks, payloads, size = [], [], 0
    for b, p in pairs:
        blocks.append(b)
        payloads.append(p)
        size += len(p)
        if size >= most or len(blocks) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(payloads, pa.binary())], schema=_SCHEMA)
            blocks, payloads, size = [], [], 0
            trim()
    if blocks:
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(payloads, pa.binary())], schema=_SCHEMA)


def by_block(df: DataFrame, work: Callable[[list[bytes]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """work on the payloads of each block, one block at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block != now and held:
                    yield from work(held)
                    held = []
                    trim()
                now = block
                held.append(payload)
        if held:
            yield from work(held)
        trim()

    return df.repartition("block").sortWithinPartitions("block").mapInArrow(run, ddl)


def split_by(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by block, the blocks that occur, and where each begins (one more at the end)."""
    order = np.argsort(block, kind="stable")
    found, first = np.unique(block[order], return_index=True)
    return order, found, np.append(first, len(block))


def pieces(sizes: np.ndarray, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Stretches [a, b) of items whose sizes add up to about step."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, "right")))
        yield a, b
        a = b


def gather(buf: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of buf at begin, one after the other; index arrays stay small."""
    out, at = np.empty(int(sizes.sum()), buf.dtype), 0
    for a, b in pieces(sizes):
        n = sizes[a:b]
        own = np.repeat(begin[a:b] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        own += np.arange(len(own))
        out[at : at + len(own)] = buf[own]
        at += len(own)
    return out
