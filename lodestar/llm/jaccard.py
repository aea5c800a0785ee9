"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix with itself.

A document is its set of distinct word n-grams; equal sets are one node, named by a 64-bit digest of the set.  Of the matrix only each
node's prefix is multiplied: the rarest ``n - ceil(t n) + 1`` entries, of which two sets of Jaccard t share at least
one.  Rare means rare in all documents: heavy n-grams (a mergeable Misra-Gries summary of every document's n-grams,
at most ``heavy`` of them) come last, the others in order of their hash.  Columns are dealt to blocks; a block's lists of two nodes and more give
partial overlaps, which are summed over the blocks, and pairs whose sum cannot reach the bound that their sizes set
are dropped.  What is left is verified on the whole sets.

A large group is not multiplied out.  First each node is verified against a few partners: the one of its lists whose
n-grams are shared most widely (an original among its copies) and its neighbours in size; that finds most components.
The likely partners, linked or not, also make clusters.  Then nodes ask whole clusters: the product of a node's row with
the cluster's rows is taken block by block, exactly, for all nodes outside the largest component of their cluster, and
for each larger cluster with which a node shares enough lists; one link to each other component is kept.  So no link
between components is lost, and a group of thousands of near copies costs a few products for each copy.

Defined results: a document with fewer words than n has its whole sequence as its one n-gram; one without words, or
with null text, has none, is linked with nothing and is its own component; repeated rows of an id are one document's;
a null id is a row of its own set and never the least id, and if a component has no other its id is null; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MESSAGE, by_block, messages, pack, split_by, unpack
from .common import arrow_limits, block_count, cut, cut_by, doc_words, grouped, join_spread, mix, release, texts, trim, utf8
from .components import components

WORDS, SIMILARITY = 5, Fraction(3, 4)
HEAVY, HEAVY_DOCS = 1 << 16, 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(values: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    hashes, edge = doc_words(values)
    n = len(hashes) - words + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(words):
        if n > 0:
            grams = mix(grams * _STEP + hashes[k : k + n] + np.uint64(k + 1))
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(grams[a : b - words + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            one = np.zeros(1, np.uint64)
            for w in hashes[a:b]:
                one = mix(one * _STEP + w + np.uint64(b - a + 100))
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """A set's digest as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + _STEP * np.uint64(len(s))], np.uint64)).astype(np.int64)[0])


def prefix_size(n: int, t: Fraction = SIMILARITY) -> int:
    return n - ceil(t * n) + 1


def _sets(b: pa.RecordBatch, words: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for ids, values in grouped(b.column(0).to_pylist(), utf8(b.column(1))):
        yield from zip(ids, shingle_sets(values, words), strict=True)


def _hashed(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("th", F.xxhash64("text"))


def nodes(docs: DataFrame, words: int, heavy: int) -> DataFrame:
    """One pass: (doc_id, n, node, hash of the text) of every document, kind 0; and each task's heavy n-grams (n: count, node: hash), kind 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "node", "th"]
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def merge():
            nonlocal keys, counts
            k, c = np.unique(np.concatenate(held), return_counts=True)
            allk = np.concatenate((keys, k))
            keys, at = np.unique(allk, return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, c)), len(keys)).astype(np.int64)
            if len(keys) > heavy:
                counts = counts - np.partition(counts, len(counts) - heavy - 1)[len(counts) - heavy - 1]
                keys, counts = keys[counts > 0], counts[counts > 0]

        for b in batches:
            ids, ns, own = [], [], []
            th = b.column(2)
            for i, s in _sets(b, words):
                node = node_of(s) if len(s) else None
                ids.append(i)
                ns.append(len(s))
                own.append(node)
                if len(s) and node not in seen:
                    seen.add(node)
                    held.append(s[: max(1, (2 * len(s)) // 5)])  # the low hashes: only they can be in a prefix
                    size += len(held[-1])
                    if size > 1 << 19:
                        merge()
                        held, size = [], 0
                        seen.clear()
                        trim()
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(own, pa.int64()), th], names=names)
        if held:
            merge()
        keep = counts > 1
        if keep.any():
            k, c = keys[keep], counts[keep]
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(k), pa.int32()), pa.nulls(len(k), pa.int64()), pa.array(c, pa.int64()), pa.array(k.view(np.int64), pa.int64()), pa.nulls(len(k), pa.int64())], names=names)

    return _hashed(docs).mapInArrow(run, "kind int, doc_id long, n long, node long, th long")


def _postings(docs: DataFrame, words: int, t: Fraction, last: np.ndarray, blocks: int) -> DataFrame:
    """Messages: nodes, their sizes, how many n-grams each has here, the n-grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes, counts, grams, total = [], [], [], [], 0
        seen: set[int] = set()

        def flush():
            h = np.concatenate(grams)
            who = np.repeat(np.arange(len(own)), counts)
            order, found, first = split_by((h % np.uint64(blocks)).astype(np.int64))
            a, n = np.array(own, np.int64), np.array(sizes, np.uint32)
            for b, x, y in zip(found.tolist(), first, first[1:], strict=False):
                o = order[x:y]
                w, begin = np.unique(who[o], return_index=True)  # stable order: already grouped
                yield b, pack(a[w], n[w], np.diff(np.append(begin, len(o))).astype(np.uint32), h[o])

        def pairs():
            nonlocal own, sizes, counts, grams, total
            for b in batches:
                for _, s in _sets(b, words):
                    if not len(s):
                        continue
                    node = node_of(s)
                    if node in seen:
                        continue
                    seen.add(node)
                    p = prefix_size(len(s), t)
                    if len(last):
                        at = np.searchsorted(last, s)
                        at[at == len(last)] = 0
                        late = last[at] == s
                        s = np.concatenate((s[~late], s[late]))
                    own.append(node)
                    sizes.append(len(s))
                    counts.append(p)
                    grams.append(s[:p])
                    total += p
                    if total > 1 << 20:
                        yield from flush()
                        own, sizes, counts, grams, total = [], [], [], [], 0
                        seen.clear()
                        trim()
            if own:
                yield from flush()

        yield from messages(pairs())

    return texts(docs).mapInArrow(run, MESSAGE)


def _lists(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
    """(gram, node, n) of the n-grams of a block that two nodes or more have in their prefixes."""
    parts = [unpack(p) for p in payloads]
    node = np.concatenate([np.repeat(p[0], p[2]) for p in parts])
    n = np.concatenate([np.repeat(p[1], p[2]) for p in parts]).astype(np.int64)
    h = np.concatenate([p[3] for p in parts])
    o = np.lexsort((node, h))
    h, node, n = h[o], node[o], n[o]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])  # a node that more than one task sent
    h, node, n = h[keep], node[keep], n[keep]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    sizes = np.diff(np.append(np.flatnonzero(new), len(h)))
    many = np.repeat(sizes > 1, sizes)
    h, node, n = h[many], node[many], n[many]
    for a in range(0, len(h), 1 << 16):
        z = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(h[z].view(np.int64), pa.int64()), pa.array(node[z], pa.int64()), pa.array(n[z], pa.int64())], names=["gram", "node", "n"])


PAIRS = "x long, y long, nx long, ny long, c long"


def _pair_batches(x, y, nx, ny, c) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(x), 1 << 16):
        z = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(v[z], pa.int64()) for v in (x, y, nx, ny, c)], names=["x", "y", "nx", "ny", "c"])


def _summed(x, y, nx, ny) -> Iterator[pa.RecordBatch]:
    """Partial overlaps: each pair once, with how often it came."""
    o = np.lexsort((y, x))
    x, y, nx, ny = x[o], y[o], nx[o], ny[o]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    first = np.flatnonzero(new)
    yield from _pair_batches(x[first], y[first], nx[first], ny[first], np.diff(np.append(first, len(x))))


def _by_gram_block(lists: DataFrame, work, columns: list[str], ddl: str) -> DataFrame:
    """work(arrays of the columns, sorted by gram) on each block of n-grams, one at a time; blocks are runs of equal 'block'."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            block = b.column(0).to_numpy(zero_copy_only=False)
            cols = [b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(columns))]
            edge = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)])) if len(block) else [0]
            for a, z in zip(edge, edge[1:], strict=False):
                if held and block[a] != now:
                    yield from work([np.concatenate(c) for c in zip(*held, strict=True)])
                    held = []
                    trim()
                now = block[a]
                held.append([c[a:z] for c in cols])
        if held:
            yield from work([np.concatenate(c) for c in zip(*held, strict=True)])
        trim()

    return lists.repartition("block").sortWithinPartitions("block").select("block", *columns).mapInArrow(run, ddl)


def _neighbours(t: Fraction):
    """The likeliest partners in each list: the node whose n-grams are shared most widely (an original among its copies), and the next in size."""
    def work(cols) -> Iterator[pa.RecordBatch]:
        h, node, n, cover = cols
        o = np.lexsort((node, -cover, h))
        hub = np.flatnonzero(np.concatenate(([True], h[o][1:] != h[o][:-1])))
        sizes = np.diff(np.append(hub, len(h)))
        x, y = o[np.repeat(hub, sizes)], o
        o = np.lexsort((node, n, h))
        near = np.flatnonzero(h[o][1:] == h[o][:-1])
        x, y = np.concatenate((x, o[near])), np.concatenate((y, o[near + 1]))
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        fits = (x != y) & (small * t.denominator >= large * t.numerator)
        x, y = x[fits], y[fits]
        flip = node[x] > node[y]
        x, y = np.where(flip, y, x), np.where(flip, x, y)
        yield from _summed(node[x], node[y], n[x], n[y])

    return work


TOUCHES = "node long, label long, n long, low long, high long, c long"


def _touches(t: Fraction, most: int = 1 << 20):
    """(node, label, n, low, high, c): how many lists a node shares with each larger cluster (label), and the sizes it meets there.

    Of two clusters the smaller one's nodes ask (of equal ones those of the greater label), and sizes beyond t don't count.
    """
    def rows(parts) -> Iterator[pa.RecordBatch]:
        node, label, n, low, high = (np.concatenate(v) for v in zip(*parts, strict=True))
        o = np.lexsort((label, node))
        node, label, n, low, high = node[o], label[o], n[o], low[o], high[o]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (label[1:] != label[:-1])
        first = np.flatnonzero(new)
        out = (node[first], label[first], n[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.diff(np.append(first, len(node))))
        for a in range(0, len(first), 1 << 16):
            z = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(v[z], pa.int64()) for v in out], names=["node", "label", "n", "low", "high", "c"])

    p, q = t.numerator, t.denominator

    def least(n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """No size from low to high asks for less: up to n it grows with the size, beyond n it falls but for the ceiling."""
        return np.minimum((n + low) * p / (p + q) - -(-n * p // q), (n + high) * p / (p + q) - (high * p + q - 1) / q) + 1

    def work(cols) -> Iterator[pa.RecordBatch]:
        h, node, n, label, size, cover = cols
        o = np.lexsort((n, label, h))
        h, node, n, label, size, cover = h[o], node[o], n[o], label[o], size[o], cover[o]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        edge = np.append(np.flatnonzero(new), len(h))
        parts, held = [], 0
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if label[a] == label[b - 1]:
                continue
            # The components of the list, with the least and greatest size of their nodes in it.
            at = np.flatnonzero(np.concatenate(([True], label[a + 1 : b] != label[a : b - 1]))) + a
            low, high = n[at], n[np.append(at[1:], b) - 1]
            most_shared = np.maximum.reduceat(cover[a:b], at - a)
            for k in range(len(at)):
                mine = (size[a:b] < size[at[k]]) | (size[a:b] == size[at[k]]) & (label[a:b] > label[at[k]])
                mine &= (high[k] * q >= n[a:b] * p) & (low[k] * p <= n[a:b] * q)
                # Neither can share more of its prefix than it shares with anyone.
                few = least(n[a:b], np.maximum(low[k], -(-n[a:b] * p // q)), np.minimum(high[k], n[a:b] * q // p))
                mine &= np.minimum(cover[a:b], most_shared[k]) >= few
                who = np.flatnonzero(mine) + a
                if len(who):
                    parts.append((node[who], np.full(len(who), label[at[k]]), n[who], np.full(len(who), low[k]), np.full(len(who), high[k])))
                    held += len(who)
            if held > most:
                yield from rows(parts)
                parts, held = [], 0
        if parts:
            yield from rows(parts)

    return work


#: N-grams of a cluster's nodes that are looked at together: some 4 MB of arrays.
BUCKET = 1 << 18


def _meet(t: Fraction):
    """Block by block: sets of a cluster's nodes with about BUCKET n-grams (kind 0), then those that ask (kind 1): of each a link to every other component that it has one to.

    The block's n-grams stand sorted with the nodes that have them, so an asker's overlaps with all are counted at once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets, homes, grams, owners, sizes, size = None, [], [], [], None, None, None, 0
        for b in batches:
            x, y = [], []
            for cluster, bucket, kind, node, home, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(s, np.uint64)
                if (cluster, bucket) != now:
                    now, names, sets, homes, grams = (cluster, bucket), [], [], [], None
                    if size > 1 << 24:
                        size = 0
                        trim()
                size += s.nbytes
                if kind == 0:
                    names.append(node)
                    sets.append(s)
                    homes.append(home)
                    continue
                if not names:
                    continue
                if grams is None:
                    grams, sizes = np.concatenate(sets), np.array([len(v) for v in sets])
                    order = np.argsort(grams, kind="stable")
                    grams, owners = grams[order], np.repeat(np.arange(len(sets)), sizes)[order]
                lo, hi = np.searchsorted(grams, s, "left"), np.searchsorted(grams, s, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
                both = np.bincount(owners[at], minlength=len(names))
                hit = np.flatnonzero(both * t.denominator >= t.numerator * (sizes + len(s) - both))
                for other, k in {homes[k]: k for k in hit.tolist()}.items():
                    if other != home:
                        x.append(node)
                        y.append(names[k])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])
        trim()

    return run


def whole_sets(docs: DataFrame, base: DataFrame, wanted: DataFrame, words: int, parts: int) -> DataFrame:
    """(node, packed set) of the wanted nodes, each from one document that stands for it; a table in parts by node, so joins on node don't move the sets."""
    mine = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")
    one = base.join(wanted, "node").groupBy("node").agg(F.min(mine).alias("d")).select("node", F.col("d.doc_id").alias("i"), F.col("d.th").alias("h"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([packer.compress(v) for v in utf8(b.column(1))], pa.binary())], names=["doc_id", "th", "z"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for b in batches:
            node, s = [], []
            for own, values in grouped(b.column(0).to_pylist(), [opener.decompress(z) for z in b.column(1).to_pylist()]):
                node += own
                s += [x.tobytes() for x in shingle_sets(values, words)]
            trim()
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(s, pa.binary())], names=["node", "s"])

    packed = _hashed(docs).mapInArrow(shrink, "doc_id long, th long, z binary")
    found = packed.join(one, packed["doc_id"].eqNullSafe(one["i"]) & (packed["th"] == one["h"]))
    found = found.select("node", "z").repartition(parts, "node").dropDuplicates(["node"])
    return cut_by(found.mapInArrow(sets, "node long, s binary"), "node", parts)


def verified(pairs: DataFrame, whole: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (x, y) that link, by the overlap of the whole sets."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, ok = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both * t.denominator >= t.numerator * (len(p) + len(q) - both))
            trim()
            keep = [k for k, v in enumerate(ok) if v]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in keep], pa.int64()), pa.array([y[k] for k in keep], pa.int64())], names=["x", "y"])

    left = pairs.select("x", "y").join(whole.select(F.col("node").alias("x"), F.col("s").alias("sx")), "x")
    return left.join(whole.select(F.col("node").alias("y"), F.col("s").alias("sy")), "y").select("x", "y", "sx", "sy").mapInArrow(check, "x long, y long")


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()


def _shortfall(n: str, m: str, t: Fraction):
    """The least overlap of prefixes that sets of the sizes need: what the sizes ask for, less what can lie beyond a prefix."""
    suffix = lambda c: F.ceil(F.col(c) * t.numerator / F.lit(float(t.denominator))) - 1  # noqa: E731  n less its prefix
    return (F.col(n) + F.col(m)) * t.numerator / F.lit(float(t.numerator + t.denominator)) - F.greatest(suffix(n), suffix(m))


def _least_shortfall(n: str, low: str, high: str, t: Fraction):
    """At most the shortfall of n with any size from low to high (as in _touches)."""
    p, q = t.numerator, t.denominator
    share = lambda m: (F.col(n) + F.col(m)) * p / F.lit(float(p + q))
    return F.least(share(low) - F.ceil(F.col(n) * p / F.lit(float(q))), share(high) - (F.col(high) * p + q - 1) / F.lit(float(q))) + 1


def linked(docs: DataFrame, words: int = WORDS, t: Fraction = SIMILARITY, heavy: int = HEAVY, near: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of all documents, and the labels (node, label) of the components."""
    spark = docs.sparkSession
    arrow_limits(spark)
    blocks = block_count(docs)
    both = cut(nodes(docs, words, heavy), "kind")
    base = both.where("kind = 0").select("doc_id", "n", "node", "th")
    often = both.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_DOCS).orderBy(F.desc("n"), "node").limit(heavy)
    last = np.sort(np.array([r["node"] for r in often.collect()], np.int64).view(np.uint64))
    lists = by_block(_postings(docs, words, t, last, blocks), _lists, "gram long, node long, n long")
    lists = cut_by(lists.repartition(blocks, "node"), "node", blocks)
    release(spark)
    block = F.pmod("gram", F.lit(blocks)).alias("block")
    # First the likeliest partners: partial overlaps of a third of the bound, the best few of each node. A node stands in
    # no more lists than its prefix is long, so it has at most three times as many partners.
    cover = cut(lists.groupBy("node").agg(F.count(F.lit(1)).alias("cover"), F.max("n").alias("grams")))
    pairs = _by_gram_block(lists.join(cover, "node").select(block, "gram", "node", "n", "cover"), _neighbours(t), ["gram", "node", "n", "cover"], PAIRS)
    pairs = pairs.groupBy("x", "y", "nx", "ny").agg(F.sum("c").alias("c")).where(3 * F.col("c") >= _shortfall("nx", "ny", t))
    ends = pairs.select(F.explode(F.array("x", "y")).alias("node"), F.struct("c", "x", "y").alias("p"))
    best = ends.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("p"), asc=False), 1, near).alias("p"))
    first = cut(best.select(F.explode("p").alias("p")).select("p.x", "p.y").distinct())
    release(spark)
    whole = whole_sets(docs, base, _nodes_of(first), words, blocks)
    release(spark)
    links = cut(verified(first, whole, t))
    release(spark)
    labels, clusters = components(links), components(first)
    # Then what else may link. Clusters are joined by likely partners, linked or not; in each, all nodes outside its largest
    # component ask the whole cluster, and a node asks each larger cluster with which it shares enough of its prefix.
    info = cover.join(clusters.withColumnRenamed("label", "cluster"), "node", "left").join(labels, "node", "left").select("node", "cover", "grams", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("label", "node").alias("label"))
    info = cut(info)
    parts = info.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("cluster").agg(F.sum("k").alias("size"), F.min_by("label", F.struct(-F.col("k"), "label")).alias("main"))
    info = cut(info.join(main, "cluster"))
    inside = info.where((F.col("size") > 1) & (F.col("label") != F.col("main"))).select("node", "cluster")
    asked = cut(_asked(lists, info, t).unionByName(inside))
    release(spark)
    if not asked.limit(1).count():
        return base, labels
    rows = cut(_dealt(asked, info, t))
    more = whole_sets(docs, base, rows.select("node").distinct().join(whole.select("node"), "node", "left_anti"), words, blocks)
    release(spark)
    sets = rows.join(whole, "node").unionByName(rows.join(more, "node")).select("cluster", "bucket", "kind", "node", "label", "s")
    met = sets.repartition("cluster", "bucket").sortWithinPartitions("cluster", "bucket", "kind").mapInArrow(_meet(t), "x long, y long")
    links = cut(links.unionByName(cut(met)))
    release(spark)
    return base, components(links)


def _asked(lists: DataFrame, info: DataFrame, t: Fraction) -> DataFrame:
    """(node, cluster): nodes and larger clusters that may hold a link of theirs."""
    block = F.pmod("gram", F.lit(max(32, lists.count() >> 18))).alias("block")
    told = lists.join(info.select("node", F.col("cluster").alias("label"), "size", "cover"), "node").select(block, "gram", "node", "n", "label", "size", "cover")
    asked = _by_gram_block(told, _touches(t), ["gram", "node", "n", "label", "size", "cover"], TOUCHES)
    asked = asked.groupBy("node", "label", "n").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("c").alias("c"))
    # Of the sizes that may link at all, the one that asks for least.
    asked = asked.withColumn("low", F.greatest("low", F.ceil(F.col("n") * t.numerator / F.lit(float(t.denominator))))).withColumn("high", F.least("high", F.floor(F.col("n") * t.denominator / F.lit(float(t.numerator)))))
    return asked.where(F.col("c") >= _least_shortfall("n", "low", "high", t)).select("node", F.col("label").alias("cluster"))


def _dealt(asked: DataFrame, info: DataFrame, t: Fraction) -> DataFrame:
    """(cluster, bucket, kind, node, label): the clusters asked for, by classes of size and in buckets, and every asker in the buckets of its class and the two beside it."""
    # Sizes that may link differ by less than one class; the base is a little above 1 / t, so that rounding can't part them.
    # The classes of what fits in one bucket stand together, as class 0, since every copy of an asker moves its set.
    sized = info.withColumn("class", F.floor(F.log(F.col("grams").cast("double")) / F.lit(log(1.01 * t.denominator / t.numerator))) + 1)
    asked = asked.join(info.groupBy("cluster").agg((F.sum("grams") > BUCKET).alias("parted")), "cluster")
    both = asked.join(sized.select("node", "label", "class"), "node")
    askers = both.withColumn("class", F.explode(F.when(F.col("parted"), F.sequence(F.col("class") - 1, F.col("class") + 1)).otherwise(F.array(F.lit(0).cast("long")))))
    rows = sized.join(asked.select("cluster", "parted").distinct(), "cluster").withColumn("class", F.when(F.col("parted"), F.col("class")).otherwise(0))
    wanted = rows.groupBy("cluster", "class").agg(F.greatest(F.lit(1), F.ceil(F.sum("grams") / F.lit(float(BUCKET)))).cast("long").alias("buckets"))
    bucket = lambda k: (F.shiftleft(F.col("class").cast("long"), 32) + k).alias("bucket")
    members = wanted.join(rows, ["cluster", "class"]).select("cluster", bucket(F.pmod(F.xxhash64("node"), F.col("buckets"))), F.lit(0).alias("kind"), "node", "label")
    each = askers.join(wanted, ["cluster", "class"]).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))
    return members.unionByName(each.select("cluster", bucket(F.col("k")), F.lit(1).alias("kind"), "node", "label"))


def join(docs: DataFrame, words: int = WORDS, t: Fraction = SIMILARITY, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    base, labels = linked(docs, words, t, heavy)
    told = base.where("node IS NOT NULL")
    nodes = told.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    nodes = cut(nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least", "rows"))
    least = nodes.groupBy("label").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("k"))
    # Of a node with copies, or a component with nodes, by the million there are few: they go to the rows, not the rows to them.
    found = join_spread(nodes.select("node", "label", "rows"), least, "label", "k").select("node", "least", "rows")
    out = join_spread(told.select("doc_id", "n", "node"), found, "node", "rows")
    out = out.unionByName(base.where("node IS NULL").select("doc_id", "n", "node", F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("rows")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, t: Fraction = SIMILARITY) -> DataFrame:
    """The rows of docs whose id is the least of their component, of repeated rows of an id one; rows without id stay."""
    ids = join(docs, words, t).where("component_id = doc_id").select(F.col("doc_id").alias("_kept")).distinct()
    found = docs.join(ids, docs["doc_id"] == ids["_kept"], "left_semi").dropDuplicates(["doc_id"])
    return found.unionByName(docs.where(F.col("doc_id").isNull()))
