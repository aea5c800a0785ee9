"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

Every context word has a restaurant whose customers are the words after it; all share one parent, the restaurant of
single words, whose base spreads evenly over the known words and one unknown.  Seating is sampled by Gibbs sweeps:
the tables of every dish are drawn anew given the other tables of the restaurant and the parent's probability, and a
child's tables are the parent's customers.  Scores are the predictive probabilities averaged over sampled seatings.

Contexts are dealt to blocks by hash; contexts that hold a noticeable share of all tokens (a bounded list, found by a
mergeable summary of all words) are dealt by (context, word), and their totals are summed over the blocks.  Pairs that
hold such a share themselves are scored where their tokens lie, by a list of the same bound, from tables averaged over the
sampled seatings of the first pass.  One pass over the whole
corpus sends the counted pairs to the blocks, which seat them and tell the word blocks their tables; those seat the
parent and answer with its state for just the words asked about.  A second pass sends the tokens of all documents to
the blocks, which seat the restaurants again under the parent, and add up each document's log probabilities.

A binomial draw seats several customers of a dish at once when it has many, so a sweep takes logarithmic time in a
dish's count.  Words are 64-bit hashes; as dishes 48 bits of them.

Defined results: null and empty texts are the end token alone; a null id counts as a training row; repeated rows
count as often as they come when learning and are scored each; texts are told apart by their id and a 64-bit hash; without
training rows every word is unknown; a text of any length is taken whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MESSAGE, by_block, messages, pack, split_by, unpack
from .common import MAX_BLOCKS, MIN_BLOCKS, arrow_limits, cut, doc_hash, doc_words, grouped, mix, release, trim, utf8

BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x52DCE729DA3ED7AB)
LOW48 = np.uint64((1 << 48) - 1)
#: Text of a block, and of what a task holds before it sends.
BLOCK_TEXT, FLUSH_TEXT = 8 << 20, 12 << 20
#: Bound of the list of contexts that are dealt by (context, word).
HOT = 1 << 16
LAST = 2**63 - 1


@dataclass(frozen=True)
class Settings:
    strength: float = 1.0  # of a context's restaurant
    parent_strength: float = 10.0
    burn: int = 2
    samples: int = 3
    seed: int = 17
    training_residues: int = 7  # crc32(doc_id) modulo this, all but 2, teaches


def dishes48(h: np.ndarray) -> np.ndarray:
    return h & LOW48


def six(values: np.ndarray) -> bytes:
    """48-bit values as six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def pairs_of(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, text number) of every token of the texts; the end follows the last word."""
    h, edge = doc_words(values)
    n = np.diff(edge)
    total = len(h) + len(values)
    first = edge[:-1] + np.arange(len(values))
    last = first + n
    words, contexts = np.empty(total, np.uint64), np.empty(total, np.uint64)
    inner = np.ones(total, bool)
    inner[last] = False
    words[inner], words[last] = h, END
    contexts[1:] = words[:-1]
    contexts[first] = BEGIN
    return contexts, words, np.repeat(np.arange(len(values), dtype=np.int32), n + 1)


def block_of(u: np.ndarray, w: np.ndarray, blocks: int, hot: np.ndarray) -> np.ndarray:
    key = u.copy()
    if len(hot):
        at = np.searchsorted(hot, u)
        at[at == len(hot)] = 0
        spread = hot[at] == u
        key[spread] = mix(u[spread] + mix(w[spread]))
    return (mix(key) % np.uint64(blocks)).astype(np.int64)


def seat(count: np.ndarray, tables: np.ndarray, total: np.ndarray, p: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """New table numbers of dishes with count customers, each drawn given the other tables of its restaurant.

    tables: those of the dish now; total: those of its restaurant; p: the parent's probability of the dish.
    """
    t = np.minimum(count, 1).astype(np.float64)
    live = np.flatnonzero(count > 1)
    other = (total - tables)[live]
    k = np.ones(len(live))
    c, q = count[live].astype(np.float64), p[live]
    mine = np.ones(len(live))
    while len(live):
        m = np.minimum(np.maximum(1, k // 4), c - k)
        new = (theta + d * (other + mine)) * q
        mine = mine + rng.binomial(m.astype(np.int64), np.minimum(1.0, new / (new + np.maximum(k - d * mine, 1e-9))))
        k = k + m
        t[live] = mine
        go = k < c
        live, other, k, c, q, mine = live[go], other[go], k[go], c[go], q[go], mine[go]
    return t


def discount(n1: float, n2: float) -> float:
    """From how many dishes were had once and twice."""
    return float(min(0.95, max(0.1, n1 / (n1 + 2 * n2)))) if n1 + n2 else 0.5


def _rows(docs: DataFrame, s: Settings) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    held = F.coalesce(F.pmod(doc_hash(), F.lit(s.training_residues)) == 2, F.lit(False))
    return d.select(F.coalesce("doc_id", F.lit(LAST)).alias("key"), F.xxhash64("text").alias("th"), held.alias("held"), "text", F.col("doc_id").isNull().alias("nul"))


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Rows in stretches of about FLUSH_TEXT bytes: key, text hash, held, texts."""
    parts, size = [], 0

    def out():
        key, th, held = (np.concatenate([p[k] for p in parts]) for k in range(3))
        return key, th, held, [v for p in parts for v in p[3]]

    for b in batches:
        values = utf8(b.column(3))
        parts.append((np.array(b.column(0).to_pylist(), np.int64), np.array(b.column(1).to_pylist(), np.int64), np.array(b.column(2).to_pylist(), bool), values))
        size += sum(map(len, values))
        if size > FLUSH_TEXT:
            yield out()
            parts, size = [], 0
            trim()
    if parts:
        yield out()


def _tokens(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, dish, text number) of every token."""
    us, ws, ds, at = [], [], [], 0
    for _, group in grouped(values, values):
        u, w, d = pairs_of(group)
        us.append(u)
        ws.append(w)
        ds.append(d + at)
        at += len(group)
    return np.concatenate(us), dishes48(np.concatenate(ws)), np.concatenate(ds)


def hot_contexts(rows: DataFrame, blocks: int) -> tuple[np.ndarray, int]:
    """Contexts with more than an eighth of a block's share of all tokens (at most 8 * blocks, and at most HOT), and the number of tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for b in batches:
            for _, group in grouped(utf8(b.column(0)), utf8(b.column(0))):
                u, _, _ = pairs_of(group)
                total += len(u)
                k, c = np.unique(u, return_counts=True)
                both = np.concatenate((keys, k))
                keys, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, np.concatenate((counts, c)), len(keys)).astype(np.int64)
                if len(keys) > HOT:
                    counts = counts - np.partition(counts, len(counts) - HOT - 1)[len(counts) - HOT - 1]
                    keys, counts = keys[counts > 0], counts[counts > 0]
        much = counts * 16 * blocks > total  # what is over the share somewhere is over half of it in some task
        k, c = keys[much], counts[much]
        yield pa.RecordBatch.from_arrays([pa.array([0, *k.view(np.int64).tolist()], pa.int64()), pa.array([total, *c.tolist()], pa.int64()), pa.array([True] + [False] * len(k), pa.bool_())], names=["h", "n", "total"])

    sums = rows.select("text").mapInArrow(run, "h long, n long, total boolean").groupBy("h", "total").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("total"), F.desc("n"), "h").limit(HOT + 1).collect()
    total = sum(r["n"] for r in top if r["total"])
    return np.sort(np.array([r["h"] for r in top if not r["total"] and r["n"] * 8 * blocks > total], np.int64).view(np.uint64)), int(total)


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u ^ mix(w + np.uint64(1)))


def among(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted wanted ones, and where those stand there."""
    if not len(wanted):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return wanted[at] == values, at


def _counted(rows: DataFrame, blocks: int, hot: np.ndarray) -> DataFrame:
    """First pass: messages of (contexts, dishes of each, the dishes, their training counts); a count of 0 only asks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for _, _, held, values in _flushes(batches):
                u, w, d = _tokens(values)
                teach = ~held[d]
                order, found, first = split_by(block_of(u, w, blocks, hot))
                for b, x, y in zip(found.tolist(), first, first[1:], strict=False):
                    o = order[x:y]
                    yield b, _pack_types(u[o], dishes48(w[o]), teach[o].astype(np.int64))

        yield from messages(pairs())

    return rows.mapInArrow(run, MESSAGE)


def _pack_types(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    u, w, n = _types(u, w, n)
    who, begin = np.unique(u, return_index=True)
    return pack(who, np.diff(np.append(begin, len(u))).astype(np.uint32), six(w), n.astype(np.uint32))


def _types(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts summed by (context, dish), sorted."""
    o = np.lexsort((w, u))
    u, w, n = u[o], w[o], n[o]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    return u[first], w[first], np.add.reduceat(n, first) if len(n) else n


def _restaurants(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Restaurant number of each type (types sorted by context) and where each restaurant begins."""
    new = np.ones(len(u), bool)
    new[1:] = u[1:] != u[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _rng(s: Settings, u: np.ndarray, w: np.ndarray) -> np.random.Generator:
    """The same draws whenever a block is worked again."""
    return np.random.default_rng([s.seed, int((u[:1].sum() ^ w[-1:].sum()) & LOW48), len(u)])


def _first_seating(blocks: int, hot: np.ndarray, least: int, s: Settings):
    """Seats a block's counted pairs under the block's own word shares and tells the word blocks the tables.

    The parent gets the last seating; totals of hot contexts and frequent pairs go on as averages over the sampled ones. A
    probability is linear in its tables, so that of average tables is the average.
    """
    def work(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(p) for p in payloads]
        u = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        w = np.concatenate([unsix(p[2]) for p in parts])
        n = np.concatenate([p[3] for p in parts]).astype(np.int64)
        u, w, n = _types(u, w, n)
        mine = int(block_of(u[:1], w[:1], blocks, hot)[0])
        words, at = np.unique(w, return_inverse=True)
        share = np.bincount(at, n, len(words)) + 0.5
        p = (share / share.sum())[at]
        who, begin = _restaurants(u)
        d = discount(float((n == 1).sum()), float((n == 2).sum()))
        rng = _rng(s, u, w)
        t = (n > 0).astype(np.float64)
        mean = np.zeros(len(n))
        for sweep in range(s.burn + s.samples):
            t = seat(n, t, np.add.reduceat(t, begin)[who], p, d, s.strength, rng)
            if sweep >= s.burn:
                mean += t / s.samples
        tables = np.bincount(at, t, len(words)).astype(np.int64)
        taught = np.add.reduceat(n, begin)
        single = ~np.isin(u[begin], hot) if len(hot) else np.ones(len(begin), bool)
        real = single & (u[begin] != BEGIN) & (taught > 0)
        loose = ~single
        often = np.flatnonzero(n > least)  # pairs with a share of all tokens that no block should have to itself
        stats = pack(np.array([1], np.int64), np.array([n.sum(), real.sum(), (n == 1).sum(), (n == 2).sum()], np.int64), u[begin][loose], taught[loose].astype(np.int64), np.add.reduceat(mean, begin)[loose], u[often], w[often], n[often], mean[often])
        order, found, first = split_by((mix(words) % np.uint64(blocks)).astype(np.int64))

        def out():
            yield -1, stats
            for b, x, y in zip(found.tolist(), first, first[1:], strict=False):
                o = order[x:y]
                yield b, pack(np.array([0, mine], np.int64), six(words[o]), tables[o].astype(np.uint32))

        yield from messages(out())

    return work


def _parent(blocks: int, s: Settings):
    """Seats the parent's dishes of a word block and answers the blocks that asked: customers less discounted tables.

    The discount is of this block's dishes; statistics pass through, with the parent's sums.
    """
    def work(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(p) for p in payloads]
        if len(parts[0][0]) == 1:  # statistics only
            yield from messages((-1, p) for p in payloads)
            return
        w = np.concatenate([unsix(p[1]) for p in parts])
        n = np.concatenate([p[2] for p in parts]).astype(np.int64)
        words, at = np.unique(w, return_inverse=True)
        c = np.bincount(at, n, len(words)).astype(np.int64)
        d = discount(float((c == 1).sum()), float((c == 2).sum()))
        t = (c > 0).astype(np.float64)
        rng = _rng(s, words, words)
        known = max(1, int((c > 0).sum()))
        for _ in range(s.burn + 1):
            t = seat(c, t, np.full(len(c), t.sum()), np.full(len(c), 1 / known), d, s.parent_strength / blocks, rng)
        weight = (c - d * t).astype(np.float32)

        def out():
            yield -1, pack(np.array([2], np.int64), np.array([c.sum(), (d * t).sum()], np.float64))
            a = 0
            for p in parts:
                k = len(p[2])
                yield int(p[0][1]), pack(np.array([0], np.int64), p[1], weight[at[a : a + k]])
                a += k

        yield from messages(out())

    return work


def _token_messages(rows: DataFrame, blocks: int, state: State) -> DataFrame:
    """Second pass: messages of the tokens: contexts, tokens of each, their dishes and texts, and the texts' keys.

    Tokens of frequent pairs are scored where they lie, since their state is known; only sums of texts go on, by text.
    """
    hot = state.hot
    def sums(key, th, u, w, d, at):
        texts, to = np.unique(d, return_inverse=True)
        known = state.hot_customers[among(u, hot)[1]]
        k, is_word = len(texts), u != BEGIN
        cols = [np.bincount(to, state.pair_scores[at], k), np.bincount(to, np.where(is_word, np.log10(known + 1), 0), k), np.bincount(to, is_word & (known > 0), k), np.bincount(to, minlength=k), np.bincount(to, w == dishes48(np.array([END]))[0], k)]
        block = (mix(key[texts].view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        order, found, first = split_by(block)
        for b, x, y in zip(found.tolist(), first, first[1:], strict=False):
            o = order[x:y]
            yield b, pack(np.array([4], np.int64), key[texts[o]], th[texts[o]], *(c[o].astype(np.float64) for c in cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for key, th, held, values in _flushes(batches):
                u, w, d = _tokens(values)
                often, at = among(pair_key(u, w), state.pairs)
                if often.any():
                    yield from sums(key, th, u[often], w[often], d[often], at[often])
                    u, w, d = u[~often], w[~often], d[~often]
                order, found, first = split_by(block_of(u, w, blocks, hot))
                for b, x, y in zip(found.tolist(), first, first[1:], strict=False):
                    o = order[x:y]
                    o = o[np.argsort(u[o], kind="stable")]
                    who, begin = np.unique(u[o], return_index=True)
                    texts, place = np.unique(d[o], return_inverse=True)
                    yield b, pack(np.array([3], np.int64), who, np.diff(np.append(begin, len(o))).astype(np.uint32), six(w[o]), place.astype(np.uint16 if len(texts) < 65536 else np.uint32), key[texts], th[texts], held[texts].astype(np.uint8))

        yield from messages(pairs())

    return rows.mapInArrow(run, MESSAGE)


@dataclass(frozen=True)
class State:
    """What all blocks need of the whole: sizes, discounts, the parent's sums and the totals of hot contexts."""

    tokens: int
    known: int
    d: float
    parent_customers: float
    parent_free: float  # mass that the parent's discounts leave
    hot: np.ndarray
    hot_customers: np.ndarray
    hot_tables: np.ndarray
    pairs: np.ndarray  # keys of the frequent pairs, sorted
    pair_scores: np.ndarray  # their log10 probabilities


def _sum_batches(texts: np.ndarray, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for a in range(0, texts.shape[1], 1 << 15):
        z = slice(a, a + (1 << 15))
        yield pa.RecordBatch.from_arrays([pa.array(texts[0][z], pa.int64()), pa.array(texts[1][z], pa.int64()), *(pa.array(v[z].astype(ty.to_pandas_dtype()), ty) for v, ty in zip(cols, (pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=["key", "th", "score", "lb", "known", "tokens", "ends"])


def _scored(state: State, s: Settings):
    def work(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(p) for p in payloads]
        told = [p for p in parts if p[0][0] == 0]
        sent = [p for p in parts if p[0][0] == 3]
        for p in parts:
            if p[0][0] == 4:
                yield from _sum_batches(np.stack((p[1], p[2])), p[3:])
        if not sent:
            return
        u = np.concatenate([np.repeat(p[1], p[2]) for p in sent])
        w = np.concatenate([unsix(p[3]) for p in sent])
        base = np.concatenate(([0], np.cumsum([len(p[5]) for p in sent])))
        text = np.concatenate([p[4].astype(np.int32) + np.int32(base[k]) for k, p in enumerate(sent)])
        key, th = (np.concatenate([p[c] for p in sent]) for c in (5, 6))
        teach = np.concatenate([p[7] for p in sent])[text] == 0
        o = np.lexsort((w, u))
        u, w, text, teach = u[o], w[o], text[o], teach[o]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        kind = np.cumsum(new) - 1
        n = np.add.reduceat(teach.astype(np.int64), first)
        tu, tw = u[first], w[first]
        # The parent's probability of each dish.
        words = np.concatenate([unsix(p[1]) for p in told]) if told else np.empty(0, np.uint64)
        weight = np.concatenate([p[2] for p in told]) if told else np.empty(0, np.float32)
        by = np.argsort(words, kind="stable")
        words, weight = words[by], weight[by]
        num = np.zeros(len(tw))
        if len(words):
            at = np.searchsorted(words, tw)
            at[at == len(words)] = 0
            num = np.where(words[at] == tw, weight[at], 0.0)
        p = parent_probability(num, state, s)
        # The restaurants; hot ones have parts elsewhere.
        who, begin = _restaurants(tu)
        names = tu[begin]
        customers = np.add.reduceat(n, begin).astype(np.float64)
        known = customers.copy()
        beyond = np.zeros(len(names))
        if len(state.hot):
            at = np.searchsorted(state.hot, names)
            at[at == len(state.hot)] = 0
            is_hot = state.hot[at] == names
            known = np.where(is_hot, state.hot_customers[at], known)
            beyond = np.where(is_hot, state.hot_tables[at], -1.0)
        d, theta = state.d, s.strength
        rng = _rng(s, tu, tw)
        t = (n > 0).astype(np.float64)
        mean = np.zeros(len(n))
        for sweep in range(s.burn + s.samples):
            own = np.add.reduceat(t, begin)
            total = np.where(beyond >= 0, np.maximum(beyond, own), own) if len(state.hot) else own
            t = seat(n, t, total[who], p, d, theta, rng)
            if sweep >= s.burn:
                own = np.add.reduceat(t, begin)
                total = np.where(beyond >= 0, np.maximum(beyond, own), own) if len(state.hot) else own
                seated = (np.maximum(n - d * t, 0) + (theta + d * total[who]) * p) / (theta + known[who])
                mean += seated
        score = np.log10(mean / s.samples)
        # The base score counts a token as a context, where all of its occurrences meet; ends are counted apart.
        c = known[who]
        is_word = tu != BEGIN
        lb = np.where(is_word, np.log10(c + 1), 0.0)
        texts, to = np.unique(np.stack((key, th)), axis=1, return_inverse=True)
        to = to.ravel()[text]
        k = texts.shape[1]
        cols = [np.bincount(to, score[kind], k), np.bincount(to, lb[kind], k), np.bincount(to, (is_word & (c > 0))[kind], k).astype(np.int64), np.bincount(to, minlength=k), np.bincount(to, w == dishes48(np.array([END]))[0], k).astype(np.int64)]
        yield from _sum_batches(texts, cols)

    return work


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every document."""
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = _rows(docs, s)
    light = rows.select("key", "nul", "th", "held").groupBy("key", "nul", "th", "held").agg(F.count(F.lit(1)).alias("rows"))
    size, taught = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum((~F.col("held")).cast("long")), F.lit(0))).first()
    blocks = int(min(MAX_BLOCKS, max(MIN_BLOCKS, size // BLOCK_TEXT)))
    hot, total = hot_contexts(rows, blocks)
    least = max(total // (8 * blocks), total // HOT)
    release(spark)
    asked = by_block(_counted(rows, blocks, hot), _first_seating(blocks, hot, least, s), MESSAGE)
    told = cut(by_block(asked, _parent(blocks, s), MESSAGE))
    release(spark)
    state = _state(told, taught, hot, blocks, s)
    sums = by_block(_token_messages(rows, blocks, state).unionByName(told.where("block >= 0")), _scored(state, s), "key long, th long, score double, lb double, known long, tokens long, ends long")
    sums = sums.groupBy("key", "th").agg(*(F.sum(c).alias(c) for c in ("score", "lb", "known", "tokens", "ends")))
    # Each row has one end, so ends tell how often the row came.
    end_lb = float(np.log10(taught + 1))
    each = lambda c: F.col(c) / F.col("ends")
    n = (F.col("tokens") / F.col("ends")).cast("long")
    out = light.join(sums, ["key", "th"]).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select(
        F.when(~F.col("nul"), F.col("key")).alias("doc_id"),
        F.col("held").alias("held_out"),
        n.alias("n_tokens"),
        (each("known").cast("long") + F.lit(1 if taught else 0)).alias("n_known"),
        F.lit(state.tokens).cast("long").alias("train_tokens"),
        (each("lb") + F.lit(end_lb) - n * F.lit(float(np.log10(state.tokens + state.known + 1)))).alias("base_score"),
        each("score").alias("score"),
        F.pow(F.lit(10.0), -each("score") / n).alias("perplexity"),
    )


def _state(told: DataFrame, taught: int, hot: np.ndarray, blocks: int, s: Settings) -> State:
    """Adds up the blocks' statistics: a few numbers a block, the totals of hot contexts, and the frequent pairs."""
    tokens = known = n1 = n2 = 0
    customers, tables = np.zeros(len(hot)), np.zeros(len(hot))
    c1 = dt = 0.0
    often = [[np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0)], [np.empty(0)]]
    for r in told.where("block < 0").toLocalIterator():
        p = unpack(bytes(r["payload"]))
        if p[0][0] == 2:
            c1, dt = c1 + p[1][0], dt + p[1][1]
            continue
        a, b, c, d = p[1].tolist()
        tokens, known, n1, n2 = tokens + a, known + b, n1 + c, n2 + d
        if len(p[2]):
            at = np.searchsorted(hot, p[2])
            np.add.at(customers, at, p[3])
            np.add.at(tables, at, p[4])
        for x, y in zip(often, p[5:], strict=True):
            x.append(y)
    known += int(((customers > 0) & (hot != BEGIN)).sum()) + (1 if taught else 0)
    u, w, n, t = (np.concatenate(x) for x in often)
    is_hot, at = among(u, hot)  # a frequent pair's context is one; only then its totals are at hand
    u, w, n, t, at = u[is_hot], w[is_hot], n[is_hot], t[is_hot], at[is_hot]
    state = State(int(tokens), int(known), discount(n1, n2), c1, dt, hot, customers, tables, np.empty(0, np.uint64), np.empty(0))
    if not len(u):
        return state
    weights = _weights_of(told, np.unique(block_of(u, w, blocks, hot)), np.unique(w))
    p = parent_probability(np.array([weights.get(int(x), 0.0) for x in w]), state, s)
    seated = (np.maximum(n - state.d * t, 0) + (s.strength + state.d * tables[at]) * p) / (s.strength + customers[at])
    keys = pair_key(u, w)
    o = np.argsort(keys)
    return replace(state, pairs=keys[o], pair_scores=np.log10(seated)[o])


def parent_probability(weight: np.ndarray, state: State, s: Settings) -> np.ndarray:
    even = 1 / (state.known + 1)
    return (weight + (s.parent_strength + state.parent_free) * even) / (s.parent_strength + state.parent_customers)


def _weights_of(told: DataFrame, blocks: np.ndarray, words: np.ndarray) -> dict[int, float]:
    """The parent's weights of a few words, out of the answers to the blocks that asked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column(0).to_pylist():
                p = unpack(payload)
                w = unsix(p[1])
                mine = among(w, words)[0]
                yield pa.RecordBatch.from_arrays([pa.array(w[mine].astype(np.int64), pa.int64()), pa.array(p[2][mine].astype(np.float64), pa.float64())], names=["w", "weight"])

    rows = told.where(F.col("block").isin(blocks.tolist())).select("payload").mapInArrow(run, "w long, weight double").groupBy("w").agg(F.max("weight").alias("weight"))
    return {r["w"]: r["weight"] for r in rows.collect()}
