"""Exact removal of passages that repeat across documents, by a logarithmic family of suffix arrays per block.

A byte goes if a ``length``-byte string over it also starts in a document with a smaller id.  Every window of that many
bytes has a minimiser, the least hash of its ``gram``-byte grams; equal windows have equal minimisers, so the block of
the minimiser is where they meet.  First only the minimisers' hashes are exchanged, and those of one document alone
drop out.  For the rest, each run of windows with one minimiser travels with its bytes, which are the suffixes it
starts.  Inside a block the documents come in batches in order of their ids: a batch gets its suffix array (sorted by
the first ``length`` bytes), which is merge-scanned against the arrays of the levels before it for long matches and
then becomes a level; levels of equal size merge, so a suffix is merged a logarithmic number of times.  A run whose
bytes came before as a whole is matched as one, and one whose minimiser no other bytes share needs no sorting.

Defined results: null and empty texts have 0 bytes and the hash of the empty string; texts under ``length`` bytes keep
all; documents with the same id don't remove from each other, and each row is judged by its own text; a null id counts as
greater than all others, as the same id as the greatest long; ties can't change a result, since every window is judged by
ids alone; a text of any length is judged whole, by overlapping slices; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MESSAGE, by_block, gather, messages, pack, pieces, split_by, unpack
from .common import BYTE_VALUES, arrow_limits, block_count, cut, mix, release, trim, utf8

LENGTH, GRAM = 50, 16
#: Bytes hashed at once; longer texts are taken in overlapping slices, each window in exactly one.
SLICE = 1 << 19
#: Text after which a task sends its messages.
FLUSH = 24 << 20
#: Bytes of runs after which it does.
FLUSH_RUNS = 8 << 20
LAST = 2**63 - 1


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every gram-byte string of a buffer."""
    n = len(buf) - gram + 1
    if gram == 16 and n > 0:
        words = np.ndarray((len(buf) - 7,), "<u8", buf.tobytes(), strides=(1,))
        h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
        h += words[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h
    h = np.zeros(max(0, n), np.uint64)
    for k in range(gram):
        h = h * np.uint64(0x100000001B3) + BYTE_VALUES[buf[k : k + n]]
    return mix(h)


def runs(buf: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser, of the texts between bounds: text number, start in the buffer, windows, hash."""
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    if len(buf) < length:
        return none
    h = gram_hashes(buf, gram)
    n = len(buf) - length + 1
    width = length - gram + 1
    key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    low, span = key, 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    least = np.minimum(low[:n], low[width - span : width - span + n])
    new = np.ones(n, bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    # Windows stop length - 1 bytes before their text does; the first of each text starts a run.
    limits = bounds[1:] - length + 1
    new[bounds[:-1][bounds[:-1] < n]] = True
    for a, b in zip(np.maximum(limits, bounds[:-1]).tolist(), bounds[1:].tolist(), strict=True):
        new[a:b] = False
    start = np.flatnonzero(new)
    if not len(start):
        return none
    text = np.searchsorted(bounds, start, "right") - 1
    ends = limits[text]
    same = text[1:] == text[:-1]
    ends[:-1][same] = start[1:][same]
    return text, start, ends - start, h[(least[start] & np.uint64(0xFFFFFF)).astype(np.int64)]


def slices(values: list[bytes], length: int = LENGTH, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """Buffers of about size bytes: the bytes, the bounds of the parts, whose they are, and where they begin in their text."""
    parts, owner, offset, total = [], [], [], 0

    def out():
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))), owner, offset

    for k, v in enumerate(values):
        for a in range(0, max(1, len(v) - length + 1), size):
            p = v[a : a + size + length - 1]
            if len(p) < length:
                continue
            if parts and total + len(p) > size:
                yield out()
                parts, owner, offset, total = [], [], [], 0
            parts.append(p)
            owner.append(k)
            offset.append(a)
            total += len(p)
    if parts:
        yield out()


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("key"), F.xxhash64(text).alias("th"), text.alias("text"), F.col("doc_id").isNull().alias("nul"))


def _zipped(keyed: DataFrame) -> DataFrame:
    """key, th, whether the id is null, and the text packed for the exchange."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([packer.compress(t) for t in utf8(b.column(2))], pa.binary()), b.column(3)], names=["key", "th", "z", "nul"])

    return keyed.mapInArrow(run, "key long, th long, z binary, nul boolean")


def _anchors(keyed: DataFrame, blocks: int, length: int) -> DataFrame:
    """Messages: ids, how many hashes each has here, the hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, size = [], [], 0

        def flush():
            i, h = np.concatenate(ids), np.concatenate(hashes)
            order, found, first = split_by((h % np.uint64(blocks)).astype(np.int64))
            for b, x, y in zip(found.tolist(), first, first[1:], strict=False):
                own, mine = i[order[x:y]], h[order[x:y]]
                o = np.lexsort((mine, own))
                who, begin = np.unique(own[o], return_index=True)
                yield b, pack(who, np.diff(np.append(begin, len(own))).astype(np.uint32), mine[o])

        def pairs():
            nonlocal ids, hashes, size
            for b in batches:
                keys = np.array(b.column(0).to_pylist(), np.int64)
                for buf, bounds, owner, _ in slices(utf8(b.column(1)), length):
                    t, _, _, h = runs(buf, bounds, length)
                    if len(h):
                        ids.append(keys[np.array(owner)[t]])
                        hashes.append(h)
                    size += len(buf)
                    if size > FLUSH and ids:
                        yield from flush()
                        ids, hashes, size = [], [], 0
                        trim()
            if ids:
                yield from flush()

        yield from messages(pairs())

    return keyed.select("key", "text").mapInArrow(run, MESSAGE)


def _shared(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
    """(key, hashes) of the minimisers of a block that more than one document has."""
    parts = [unpack(p) for p in payloads]
    ids = np.concatenate([np.repeat(who, n) for who, n, _ in parts])
    h = np.concatenate([x[2] for x in parts])
    o = np.lexsort((ids, h))
    ids, h = ids[o], h[o]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h)) - 1
    many = np.repeat(ids[first] != ids[last], last - first + 1)
    ids, h = ids[many], h[many]
    if not len(ids):
        return
    o = np.lexsort((h, ids))
    ids, h = ids[o], h[o]
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])
    ids, h = ids[keep], h[keep]
    who, begin = np.unique(ids, return_index=True)
    ends = np.append(begin[1:], len(ids))
    for a in range(0, len(who), 4096):
        some = range(a, min(len(who), a + 4096))
        yield pa.RecordBatch.from_arrays([pa.array(who[a : a + 4096], pa.int64()), pa.array([h[begin[k] : ends[k]].tobytes() for k in some], pa.binary())], names=["key", "hashes"])


def _contexts(joined: DataFrame, blocks: int, length: int) -> DataFrame:
    """Messages: key, text hash, start, windows and minimiser of each shared run, and its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta, bodies, size = [], [], 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*meta, strict=True)]
            raw = np.concatenate(bodies)
            each = cols[3].astype(np.int64) + length - 1
            begin = np.concatenate(([0], np.cumsum(each)[:-1]))
            order, found, first = split_by((cols[4] % np.uint64(blocks)).astype(np.int64))
            for b, x, y in zip(found.tolist(), first, first[1:], strict=False):
                o = order[x:y]
                m = each[o]
                yield b, pack(*(c[o] for c in cols), gather(raw, begin[o], m).tobytes())

        def pairs():
            nonlocal meta, bodies, size
            opener = zstandard.ZstdDecompressor()
            for b in batches:
                keys, th = (np.array(b.column(c).to_pylist(), np.int64) for c in ("key", "th"))
                known = [np.frombuffer(b"".join(x), np.uint64) for x in b.column("hashes").to_pylist()]
                values = [opener.decompress(z) for z in b.column("z").to_pylist()]
                for buf, bounds, owner, offset in slices(values, length):
                    t, s, n, h = runs(buf, bounds, length)
                    own = np.array(owner)[t]
                    wanted = np.zeros(len(h), bool)
                    edges = np.searchsorted(own, np.arange(len(values) + 1))
                    for k in np.unique(own).tolist():
                        wanted[edges[k] : edges[k + 1]] = np.isin(h[edges[k] : edges[k + 1]], known[k])
                    t, s, n, h, own = t[wanted], s[wanted], n[wanted], h[wanted], own[wanted]
                    if not len(h):
                        continue
                    meta.append((keys[own], th[own], s - bounds[t] + np.array(offset)[t], n.astype(np.uint8), h))
                    each = n + length - 1
                    bodies.append(gather(buf, s, each))
                    size += len(bodies[-1])
                    if size > FLUSH_RUNS:
                        yield from flush()
                        meta, bodies, size = [], [], 0
                        trim()
            if meta:
                yield from flush()

        yield from messages(pairs())

    return joined.select("key", "th", "z", "hashes").mapInArrow(run, MESSAGE)


class Family:
    """Levels of suffix arrays over the first ``length`` bytes of the suffixes, each with the least id that has it."""

    def __init__(self, length: int) -> None:
        self.length, self.levels = length, []

    def scan(self, suffixes: np.ndarray) -> np.ndarray:
        """Which of the sorted suffixes stand in a level: one merge-scan a level."""
        hit = np.zeros(len(suffixes), bool)
        for level in self.levels:
            at = np.searchsorted(level, suffixes)
            at[at == len(level)] = 0
            hit |= level[at] == suffixes
        return hit

    def add(self, suffixes: np.ndarray) -> None:
        """Adds a batch's array as a level and merges levels while the last is no larger than twice the new one."""
        while self.levels and len(self.levels[-1]) <= 2 * len(suffixes):
            suffixes = np.unique(np.concatenate((self.levels.pop(), suffixes)))
        self.levels.append(suffixes)


def suffix_array(buf: np.ndarray, begin: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the runs at begin that start a window, sorted by their first length bytes: the bytes, run, place in it."""
    run = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(run)) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    rows = np.lib.stride_tricks.sliding_window_view(buf, length)[begin[run] + place]
    keys = np.ascontiguousarray(rows).view(f"S{length}").ravel()  # all of equal length, so padding can't make two equal
    order = np.argsort(keys, kind="stable")
    return keys[order], run[order], place[order]


def run_classes(buf: np.ndarray, sizes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each run the first that has the same bytes (itself, if none has before it)."""
    n = len(sizes)
    powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    digest = np.empty(n, np.uint64)
    for a, b in pieces(sizes):
        start = begin[a:b] - begin[a]
        place = np.arange(int(sizes[a:b].sum())) - np.repeat(start, sizes[a:b])
        digest[a:b] = mix(np.add.reduceat(BYTE_VALUES[buf[begin[a] : begin[a] + len(place)]] * powers[place], start))
    order = np.lexsort((np.arange(n), digest, sizes))
    new = np.ones(n, bool)
    new[1:] = (digest[order[1:]] != digest[order[:-1]]) | (sizes[order[1:]] != sizes[order[:-1]])
    first = np.empty(n, np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    # The bytes decide: what only shares a digest stands alone.
    later = np.flatnonzero(first != np.arange(n))
    if len(later):
        each = sizes[later]
        equal = gather(buf, begin[later], each) == gather(buf, begin[first[later]], each)
        wrong = ~np.logical_and.reduceat(equal, np.concatenate(([0], np.cumsum(each)[:-1])))
        first[later[wrong]] = later[wrong]
    return first


def matches(keys: np.ndarray, counts: np.ndarray, hashes: np.ndarray, buf: np.ndarray, length: int = LENGTH, batch: int = 4096) -> np.ndarray:
    """Of all windows of the runs (in order of id, their bytes one after the other in buf): whether it also starts in a document with a smaller id."""
    sizes = counts + length - 1
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    edge = np.concatenate(([0], np.cumsum(counts)))
    first = run_classes(buf, sizes, begin)
    # Of each class of equal runs the first goes into the index, if another class has its minimiser.
    alone = np.flatnonzero(first == np.arange(len(keys)))
    _, at, many = np.unique(hashes[alone], return_inverse=True, return_counts=True)
    contested = alone[many[at] > 1]
    flat = np.zeros(int(edge[-1]), bool)
    family, a = Family(length), 0
    while a < len(contested):
        b = min(len(contested), a + batch)
        while b < len(contested) and keys[contested[b]] == keys[contested[b - 1]]:
            b += 1  # a document's runs stay in one batch
        own = contested[a:b]
        suffixes, body, place = suffix_array(buf, begin[own], counts[own], length)
        older = family.scan(suffixes)
        new = np.ones(len(suffixes), bool)
        new[1:] = suffixes[1:] != suffixes[:-1]
        who = keys[own][body]
        least = np.minimum.reduceat(who, np.flatnonzero(new))[np.cumsum(new) - 1]
        flat[edge[own][body] + place] = older | (least < who)
        family.add(suffixes[new])
        a = b
    # The others: matched as a whole by an older equal run, or, of the same id, as the first of them.
    later = np.flatnonzero(first != np.arange(len(keys)))
    if not len(later):
        return flat
    each = counts[later]
    at = np.arange(int(each.sum())) - np.repeat(np.concatenate(([0], np.cumsum(each)[:-1])), each)
    flat[np.repeat(edge[later], each) + at] = flat[np.repeat(edge[first[later]], each) + at] | np.repeat(keys[first[later]] < keys[later], each)
    return flat


def _matched(length: int):
    def work(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(p) for p in payloads]
        keys, th, start, n = (np.concatenate([p[c] for p in parts]) for c in range(4))
        n = n.astype(np.int64)
        h = np.concatenate([p[4] for p in parts])
        raw = np.concatenate([np.frombuffer(p[5], np.uint8) for p in parts])
        order = np.lexsort((start, th, keys))
        sizes = (n + length - 1)[order]
        begin = np.concatenate(([0], np.cumsum(n + length - 1)[:-1]))[order]
        raw = gather(raw, begin, sizes)
        keys, th, start, n = keys[order], th[order], start[order], n[order]
        total = matches(keys, n, h[order], raw, length)
        text = np.repeat(np.arange(len(n)), n)
        at = start[text] + np.arange(len(total)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        text, at = text[total], at[total]
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (keys[text[1:]] != keys[text[:-1]]) | (th[text[1:]] != th[text[:-1]]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        k, t, s = keys[text[first]], th[text[first]], at[first]
        spans = np.stack((s, s + count + length - 1), 1).astype(np.int64)
        head = np.ones(len(first), bool)
        head[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
        edge = np.append(np.flatnonzero(head), len(first))
        for a in range(0, len(edge) - 1, 4096):
            some = range(a, min(len(edge) - 1, a + 4096))
            yield pa.RecordBatch.from_arrays([pa.array(k[edge[a : a + len(some)]], pa.int64()), pa.array(t[edge[a : a + len(some)]], pa.int64()), pa.array([spans[edge[j] : edge[j + 1]].tobytes() for j in some], pa.binary())], names=["key", "th", "spans"])

    return work


def spans_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the spans cover."""
    s = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
    s = s[np.argsort(s[:, 0], kind="stable")]
    top = np.maximum.accumulate(s[:, 1])
    new = np.ones(len(s), bool)
    new[1:] = s[1:, 0] > top[:-1]
    first = np.flatnonzero(new)
    return s[first, 0], top[np.append(first[1:], len(s)) - 1]


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, th, z (packed text), nul (no id), parts (array of packed spans, null if none): what removal and digests are made from."""
    spark = docs.sparkSession
    arrow_limits(spark)
    blocks = block_count(docs)
    keyed = _keyed(docs)
    shared = cut(by_block(_anchors(keyed, blocks, length), _shared, "key long, hashes binary"))
    release(spark)
    lists = shared.groupBy("key").agg(F.collect_list("hashes").alias("hashes"))
    zipped = _zipped(keyed)
    joined = zipped.join(lists, "key")
    marked = cut(by_block(_contexts(joined, blocks, length), _matched(length), "key long, th long, spans binary"))
    release(spark)
    return zipped.join(marked.groupBy("key", "th").agg(F.collect_list("spans").alias("parts")), ["key", "th"], "left")


def kept_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), starts, ends of the removed runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows(b, lambda kept, s, e: (kept, s.tolist(), e.tolist()), [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())], ["kept", "starts", "ends"])

    return repeated(docs, length).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<long>, ends array<long>")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows(b, lambda kept, s, e: (hashlib.sha256(kept).hexdigest(),), [pa.string()], ["kept_sha256"])

    return repeated(docs, length).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _rows(b: pa.RecordBatch, last, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    opener = zstandard.ZstdDecompressor()
    rows = []
    none = np.empty(0, np.int64)
    for key, nul, z, parts in zip(*(b.column(c).to_pylist() for c in ("key", "nul", "z", "parts")), strict=True):
        text = opener.decompress(z)
        s, e = spans_of(parts) if parts else (none, none)
        kept = b"".join([text[a:c] for a, c in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True)]) if len(s) else text
        rows.append((None if nul else key, len(text), len(text) - len(kept), len(s), *last(kept, s, e)))
    cols = zip(*rows, strict=True) if rows else [()] * (4 + len(types))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", *names])
