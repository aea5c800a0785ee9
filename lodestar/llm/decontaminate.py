"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are compared in lower case and with white space runs as one space.  An item of n bytes is found in every place where the
edit distance is at most ``tolerance * n``.  Such a place holds at least one of the item's k + 1 equal pieces unchanged (its
first ``least`` bytes, or all of a shorter piece, are the seed), so
only windows that begin with a piece are looked at, in the text and in the item, so that both are aligned.  Their size doesn't
follow the item's, so edits that crowd in one part of an item leave the windows of its other parts as they are.  The CGK
random walk turns windows into strings whose Hamming distance follows the edit distance: at every step the current byte is
copied and a random bit of (step, byte) says whether to move on.  Repeated bit-sampling of several walks gives the
hash tables that pair windows with items; pairs are then verified by the exact edit distance of the item to any part
of the surrounding text (bit-parallel).  The tests measure the recall at the full tolerance, with edits spread and crowded;
a window equal to its item's collides in every table.

Items are taken in blocks of at most ``item_bytes``, each with its pass over the documents; of more than one block each pass
is written before the next block is collected, so neither the driver nor an executor holds more than one.

Defined results: null or empty documents have no leak; items under ``least`` bytes or null match nothing; a null item id
is returned as null; equal rows of items count once, repeated documents are each judged; of equally good places the first
counts; a document of any length is searched whole, in one piece; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, cut, grouped, mix, texts, trim, utf8

#: Window sizes: from each piece on, an item is embedded over the largest that the rest of it holds, else over the seed.
CLASSES = (16, 32)
#: Bytes of text that are searched at once.
TOGETHER = 2 << 20


@dataclass(frozen=True)
class Settings:
    tolerance: float = 0.08
    exact_below: int = 50  # shorter items must match exactly
    least: int = 11
    walks: int = 8
    tables: int = 8  # of each walk
    bits: int = 6
    seed: int = 11
    item_bytes: int = 4 << 20


def normal(text: bytes) -> bytes:
    return " ".join(text.decode("utf-8", "replace").lower().split()).encode()


def allowed(n: int, s: Settings) -> int:
    return floor(s.tolerance * n) if n >= s.exact_below else 0


def edits(item: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of item to a part of text, and where such a part ends (bit-parallel, any length)."""
    n = len(item)
    masks: dict[int, int] = defaultdict(int)
    for k, c in enumerate(item):
        masks[c] |= 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best, end = n, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a part may start anywhere
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """Pieces and hash tables of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], s: Settings) -> None:
        self.s = s
        self.items = [(i, t) for i, t in ((i, normal(t or b"")) for i, t in items) if len(t) >= s.least]
        lengths = [len(t) for _, t in self.items]
        buf = np.frombuffer(b"\n".join(t for _, t in self.items), np.uint8)
        begin = np.concatenate(([0], np.cumsum([n + 1 for n in lengths]))).astype(np.int64)
        sizes = [n // (allowed(n, s) + 1) for n in lengths]
        at = [np.arange(0, size * (allowed(n, s) + 1), size) for n, size in zip(lengths, sizes, strict=True)]
        counts = [len(x) for x in at]
        item = np.repeat(np.arange(len(at), dtype=np.int32), counts)
        at = np.concatenate([np.empty(0, np.int64), *at])
        q = np.repeat(np.minimum(np.array(sizes, np.int64), s.least), counts)
        rest = np.repeat(np.array(lengths, np.int64), counts) - at
        m = q.copy()
        for c in CLASSES:
            m[rest >= c] = c
        rng = np.random.default_rng(s.seed)
        self.move = rng.integers(0, 2, (s.walks, 3 * CLASSES[-1], 256), dtype=np.uint8)
        self.samples = {int(c): np.sort(rng.integers(0, 2 * c, (s.walks, s.tables, s.bits)), axis=2) for c in np.unique(m)}
        self.factor = rng.integers(1, 1 << 63, s.bits, dtype=np.uint64) | np.uint64(1)
        self.seeds = {}  # of each seed length: hashes, filter, and which have windows of a size
        for size in np.unique(q).tolist():
            own = np.flatnonzero(q == size)
            hashes, place = np.unique(seed_hashes(buf, size)[begin[item[own]] + at[own]], return_inverse=True)
            known = np.zeros(1 << 22, bool)
            known[(hashes >> np.uint64(42)).astype(np.int64)] = True
            windows = {}
            for c in np.unique(m[own]).tolist():
                windows[c] = np.zeros(len(hashes), bool)
                windows[c][place[m[own] == c]] = True
            self.seeds[size] = hashes, known, windows
        self.tables, self.rows = {}, {}
        for c in self.samples:
            own = np.flatnonzero(m == c)
            self.rows[c] = item[own], at[own].astype(np.int32)
            starts = begin[item[own]] + at[own]
            self.tables[c] = []
            for x in self.signatures(buf, starts, starts + c, c):
                o = np.argsort(x, kind="stable").astype(np.int32)
                self.tables[c].append((x[o], o))

    def signatures(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, m: int) -> list[np.ndarray]:
        """Of the windows of m bytes at starts, cut off at ends, one array for each table of each walk."""
        padded = np.concatenate((buf, np.zeros(m + 1, np.uint8)))
        ends = np.minimum(starts + m, ends)
        out = []
        for w in range(self.s.walks):
            at = self.samples[m][w]
            wanted: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for t, places in enumerate(at.tolist()):
                for b, step in enumerate(places):
                    wanted[step].append((t, b))
            sums = np.zeros((self.s.tables, len(starts)), np.uint64)
            pos = starts.copy()
            for step in range(max(wanted) + 1):
                past = pos >= ends
                c = padded[np.minimum(pos, len(padded) - 1)]
                c[past] = 0
                for t, b in wanted.get(step, ()):
                    sums[t] += mix(c.astype(np.uint64) + np.uint64(b << 8)) * self.factor[b]
                pos += self.move[w, step][c]
            out.extend((mix(sums) >> np.uint64(32)).astype(np.uint32))
        return out

    def candidates(self, buf: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start), sorted and distinct, that collide in a table, of the windows that begin with a piece.

        A start before the text that holds the piece becomes that text's begin, so a start tells its text.
        """
        windows: dict[int, list[np.ndarray]] = defaultdict(list)
        for q, (seeds, known, sizes) in self.seeds.items():
            if len(buf) < q:
                continue
            h = seed_hashes(buf, q)
            at = np.flatnonzero(known[(h >> np.uint64(42)).astype(np.int64)])
            hit, place = among(h[at], seeds)
            for m, own in sizes.items():
                windows[m].append(at[hit][own[place[hit]]])
        found = [np.empty(0, np.int64)]
        for m, parts in windows.items():
            where = np.unique(np.concatenate(parts))
            held = np.searchsorted(begin, where, "right") - 1
            item, offset = self.rows[m]
            for sig, (keys, own) in zip(self.signatures(buf, where, begin[held + 1] - 1, m), self.tables[m], strict=True):
                lo = np.searchsorted(keys, sig, "left")
                n = np.searchsorted(keys, sig, "right") - lo
                x = np.flatnonzero(n)
                n, lo = n[x], lo[x]
                x, row = np.repeat(x, n), own[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                start = np.maximum(begin[held[x]], where[x] - offset[row])
                found.append(np.unique(item[row].astype(np.int64) * len(buf) + start))
        found = np.unique(np.concatenate(found))
        return found // max(1, len(buf)), found % max(1, len(buf))

    def likely(self, buf: np.ndarray, begin: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Around which starts there are enough of the item's 8-grams: an edit takes away eight at most."""
        keep = np.ones(len(item), bool)
        if not len(item):
            return keep
        first = begin[np.searchsorted(begin, start, "right") - 1]
        longest = max(len(self.items[j][1]) for j in set(item.tolist()))
        grams = gram_hashes(np.concatenate((buf, np.zeros(2 * longest + 8, np.uint8))))
        has = np.zeros(1 << 16, bool)
        for own in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
            text = self.items[int(item[own[0]])][1]
            most = allowed(len(text), self.s)
            if not most:
                continue
            of = gram_hashes(np.frombuffer(text, np.uint8))
            has[of] = True
            at = np.maximum(first[own], start[own] - 2 * most)
            width = len(text) + 4 * most
            step = max(1, (1 << 20) // width)
            for k in range(0, len(own), step):
                some = at[k : k + step]
                if len(some) * width > int(some[-1] - some[0]) + width:  # they overlap: count along the stretch
                    total = np.concatenate(([0], np.cumsum(has[grams[some[0] : some[-1] + width]], dtype=np.int32)))
                    there = total[some - some[0] + width] - total[some - some[0]]
                else:
                    there = np.count_nonzero(has[np.lib.stride_tricks.sliding_window_view(grams, width)[some]], axis=1)
                keep[own[k : k + step]] = there >= len(of) - 8 * most
            has[of] = False
        return keep

    def may_hold(self, item: int, part: bytes, most: int) -> bool:
        """Whether part has enough of the item's 4-grams: an edit takes away four at most."""
        text = self.items[item][1]
        if len(part) < 4:
            return len(text) - 3 <= 4 * most
        of, have = (np.ndarray((len(x) - 3,), "<u4", x, strides=(1,)) for x in (text, part))
        return int(np.isin(of, have).sum()) >= len(of) - 4 * most

    def leaks(self, values: list[bytes]) -> Iterator[tuple[int, int | None, int, int]]:
        """(number of the text, item id, edits, end in the normalised text): the best place of each item in each text, the first of equal ones."""
        plain = [normal(v) for v in values]
        begin = np.concatenate(([0], np.cumsum([len(p) + 1 for p in plain])))
        buf = np.frombuffer(b"\n".join(plain), np.uint8)
        items, starts = self.candidates(buf, begin)
        keep = self.likely(buf, begin, items, starts)
        held = np.searchsorted(begin, starts[keep], "right") - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for k, item, a, b in self.stretches(held, items[keep], starts[keep] - begin[held]):
            text = self.items[item][1]
            most = allowed(len(text), self.s)
            part = plain[k][a:b]
            at = part.find(text)
            if at >= 0:
                n, end = 0, at + len(text)
            elif most and self.may_hold(item, part, most):
                n, end = edits(text, part)
            else:
                continue
            if n <= most and ((k, item) not in best or n < best[k, item][0]):
                best[k, item] = (n, a + end)
        for (k, item), (n, end) in sorted(best.items()):
            yield k, self.items[item][0], n, end

    def stretches(self, held: np.ndarray, items: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, from, to): the surroundings of the starts of an item in a text, those that overlap as one."""
        now = None
        for k, item, start in zip(held.tolist(), items.tolist(), starts.tolist(), strict=True):
            n = len(self.items[item][1])
            most = allowed(n, self.s)
            a, b = max(0, start - 2 * most), start + n + 2 * most
            if now and now[:2] == (k, item) and a <= now[3]:
                now = (k, item, now[2], max(now[3], b))
                continue
            if now:
                yield now
            now = (k, item, a, b)
        if now:
            yield now


def seed_hashes(a: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q-byte string (q up to 16)."""
    n = len(a) - q + 1
    raw = a.tobytes() + b"\0" * 16
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    low = words[:n] if q >= 8 else words[:n] & np.uint64((1 << 8 * q) - 1)
    h = low * np.uint64(0x9E3779B97F4A7C15)
    if q > 8:
        h = h ^ ((words[8 : 8 + n] & np.uint64((1 << 8 * (q - 8)) - 1 if q < 16 else (1 << 64) - 1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return h * np.uint64(0x165667B19E3779F9)


def among(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted wanted ones, and where those stand there."""
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return (wanted[at] == values if len(wanted) else np.zeros(len(values), bool)), at


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """A 16-bit hash of every 8-byte string."""
    raw = a.tobytes()
    return ((np.ndarray((max(0, len(raw) - 7),), "<u8", raw, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def leaks(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, edits, ends (in the normalised text): a row for each document and item it holds."""
    arrow_limits(docs.sparkSession)

    def search(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, s)
            for held in _held(batches, 1):
                ids = [i for b, _ in held for i in b.column(0).to_pylist()]
                rows = []
                for own, values in grouped(ids, [v for _, values in held for v in values], TOGETHER):
                    rows += [(own[k], *rest) for k, *rest in index.leaks(values)]
                cols = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "edits", "ends"])

        return texts(docs).mapInArrow(run, "doc_id long, item_id long, edits long, ends long")

    return reduce(DataFrame.unionByName, (found for found in _by_items(docs, items, s, lambda _, shared: search(shared))))


def _by_items(docs: DataFrame, items: DataFrame, s: Settings, work: Callable[[DataFrame | None, Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """work(what it made of the block before, the block) of each block of items; of more than one, each is written before the next is sent."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-2 * size // s.item_bytes) if size > s.item_bytes else 1
    out = None
    for block in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"].encode()) for r in own.collect()])  # at most about item_bytes
        out = work(out, shared)
        if blocks > 1:
            out = cut(out)
            shared.destroy()
        yield out


def _held(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[list[tuple[pa.RecordBatch, list[bytes]]]]:
    """Batches with their texts, as many as have TOGETHER bytes: the walks' steps cost less over more windows."""
    held, size = [], 0
    for b in batches:
        values = utf8(b.column(place))
        held.append((b, values))
        size += sum(map(len, values))
        if size >= TOGETHER:
            yield held
            held, size = [], 0
            trim()
    if held:
        yield held


def clean(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no item; one pass for each block of items, no join."""
    arrow_limits(docs.sparkSession)
    place = docs.columns.index("text")

    def without(rows: DataFrame | None, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, s)
            for held in _held(batches, place):
                values = [v for _, own in held for v in own]
                keep = np.ones(len(values), bool)
                for rows, some in grouped(list(range(len(values))), values, TOGETHER):
                    for k, *_ in index.leaks(some):
                        keep[rows[k]] = False
                at = 0
                for b, own in held:
                    yield b.filter(pa.array(keep[at : at + len(own)], pa.bool_()))
                    at += len(own)

        return (docs if rows is None else rows).mapInArrow(run, docs.schema)

    return list(_by_items(docs, items, s, without))[-1]
