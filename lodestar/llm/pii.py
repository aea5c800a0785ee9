"""Personal data: base patterns, and spans that a character-level bidirectional LSTM with CRF transitions adds.

The network (numpy, trained here from labelled spans that a seeded rule makes) reads overlapping windows.  A region's
windows are reconciled globally: every character takes its scores from the window in which it stands most central,
and one Viterbi pass over the whole region then decides.  A span must hold a trigger (a digit, ``@`` or a spelt-out
at), so text without one near by has no added span by definition and isn't read by the network.  Regions over 65,536
characters are cut at the next line end or mark.  An added span must
also pass its kind's test (digits, Luhn, parts to 255, a name and a dotted host) and not touch a base span.

Defined results: null and empty texts have no spans; of equally good tag sequences the one with the lower tag numbers counts; an
empty table gives no rows; a text of any length is read as a whole, by regions; equal texts
get equal results; other columns are ignored (``masked`` keeps them).  Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pieces
from .common import arrow_limits, texts

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
WINDOW, STRIDE, MARGIN = 64, 32, 48

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Digits before a match can't start a better one, so each run of digits is tried once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping: the run of local characters before each @ and the dotted host after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL_SET:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = [(0, *x) for x in emails(text)]
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for kind, pattern, least, most in ((2, CARD, 13, 19), (3, PHONE, 9, 15)):
            for m in pattern.finditer(text):
                d = "".join(DIGIT.findall(m[0]))
                if least <= len(d) <= most and (kind == 3 or luhn(d)):
                    out.append((kind, *m.span()))
    return out


# ---------------------------------------------------------------- the network

_CLASS = np.zeros(128, np.int64)
_CLASS[48:58] = 1
for _k in range(26):
    _CLASS[65 + _k] = _CLASS[97 + _k] = 2 + _k
for _k, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[ord(_c)] = 28 + _k
_CLASS[[32, 9]], _CLASS[[10, 13]] = 60, 61
CLASSES = 64  # 0: other, 62: not ASCII, 63: beyond the text


def classes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, _CLASS[np.minimum(c, 127)], 62)


@dataclass
class Net:
    p: dict[str, np.ndarray]

    @staticmethod
    def new(hidden: int, rng: np.random.Generator) -> Net:
        p = {}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.3, (CLASSES, 4 * hidden))
            p["h" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            p["c" + d] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)))
        p["o"] = rng.normal(0, 0.3, (2 * hidden, TAGS))
        p["q"] = np.zeros(TAGS)
        p["t"] = np.zeros((TAGS, TAGS))
        return Net(p)

    def run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states [B, L, H] of one direction over class numbers [B, L], and what the gradient needs."""
        wx, wh, b = self.p["x" + d], self.p["h" + d], self.p["c" + d]
        n, length = x.shape
        size = wh.shape[0]
        h, c = np.zeros((n, size)), np.zeros((n, size))
        out, kept = np.zeros((n, length, size)), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = wx[x[:, t]] + h @ wh + b
            gates = 1 / (1 + np.exp(-z[:, : 3 * size]))
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            g = np.tanh(z[:, 3 * size :])
            new = f * c + i * g
            th = np.tanh(new)
            kept.append((t, h, c, i, f, o, g, th))
            h, c = o * th, new
            out[:, t] = h
        return out, kept

    def back(self, x: np.ndarray, d: str, kept: list, dout: np.ndarray, grad: dict) -> None:
        wh = self.p["h" + d]
        size = wh.shape[0]
        gx, gh, gc = np.zeros_like(self.p["x" + d]), np.zeros_like(wh), np.zeros(4 * size)
        dh, dc = np.zeros((len(x), size)), np.zeros((len(x), size))
        for t, h, c, i, f, o, g, th in reversed(kept):
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)), 1)
            np.add.at(gx, x[:, t], dz)
            gh += h.T @ dz
            gc += dz.sum(0)
            dh, dc = dz @ wh.T, dc * f
        grad["x" + d], grad["h" + d], grad["c" + d] = gx, gh, gc

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores [B, L, TAGS]."""
        return np.concatenate((self.run(x, "f")[0], self.run(x, "b")[0]), 2) @ self.p["o"] + self.p["q"]

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean CRF loss a character, and its gradient."""
        (hf, kf), (hb, kb) = self.run(x, "f"), self.run(x, "b")
        h = np.concatenate((hf, hb), 2)
        e, t = h @ self.p["o"] + self.p["q"], self.p["t"]
        n, length = x.shape
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for k in range(1, length):
            alpha[:, k] = e[:, k] + _lse(alpha[:, k - 1, :, None] + t, 1)
        for k in range(length - 2, -1, -1):
            beta[:, k] = _lse(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        gt, ge = np.zeros_like(t), np.exp(alpha + beta - z[:, None, None])
        rows = np.arange(n)
        gold = e[rows[:, None], np.arange(length), y].sum(1) + t[y[:, :-1], y[:, 1:]].sum(1)
        for k in range(1, length):
            gt += np.exp(alpha[:, k - 1, :, None] + t + (e[:, k] + beta[:, k])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(gt, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        ge[rows[:, None], np.arange(length), y] -= 1
        scale = 1 / (n * length)
        ge, gt = ge * scale, gt * scale
        grad = {"t": gt, "o": np.einsum("blh,blt->ht", h, ge), "q": ge.sum((0, 1))}
        dh = ge @ self.p["o"].T
        size = hf.shape[2]
        self.back(x, "f", kf, dh[:, :, :size], grad)
        self.back(x, "b", kb, dh[:, :, size:], grad)
        return float((z - gold).mean() / length), grad


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))


def labelled(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A line of invented words with labelled spans, at times in spelling that the base patterns don't know."""
    pick = lambda *v: v[int(rng.integers(len(v)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    syllable = lambda: pick(*"bdfglmnrst") + pick(*"aeiou") + pick("", "n", "r", "s")
    word = lambda: "".join(syllable() for _ in range(int(rng.integers(1, 4))))

    def number() -> str:
        d = [int(c) for c in pick("4", "51", "37") + digits(12)] + [0, 0]
        d = d[: int(rng.integers(13, 17))]
        d[-1] = 0
        d[-1] = next(k for k in range(10) if luhn("".join(map(str, [*d[:-1], k]))))
        s = "".join(map(str, d))
        sep = pick("", " ", "-", ".", "/")
        return sep.join(s[k : k + 4] for k in range(0, len(s), 4))

    def item() -> tuple[int, str]:
        kind = int(rng.integers(4))
        if kind == 0:
            at, dot = pick(("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."))
            return 0, word() + pick("", "." + digits(2), "_" + word()) + at + word() + pick("", digits(1)) + dot + pick("com", "org", "net", "example" + dot + "com")
        if kind == 1:
            return 1, pick(".", ".", "[.]", "(.)", " . ").join(str(int(v)) for v in rng.integers(1, 256, 4))
        if kind == 2:
            return 2, number()
        return 3, pick("+1 ({a}) {b}-{c}", "({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "00{a} {b} {c}", "+{a} {b}{c}").format(a=digits(3), b=digits(3), c=digits(4))

    other = lambda: pick(digits(4), digits(1) + "." + digits(1), digits(2) + "%", "$" + digits(3), "v" + digits(1) + "." + digits(1) + "." + digits(1), '"' + "".join(rng.choice(list("0123456789abcdef"), 30)) + '"', digits(1) + ".", "at " + word(), digits(2) + ":" + digits(2), digits(4) + "-" + digits(2) + "-" + digits(2))
    text, spans = "", []
    while len(text) < WINDOW + 32:
        what = rng.random()
        if what < 0.22:
            kind, s = item()
            spans.append((kind, len(text), len(text) + len(s)))
        else:
            s = other() if what < 0.4 else word() + pick("", "", "", ",", ".")
        text += s + pick(" ", " ", " ", "\n", ", ")
    return text, spans


@cache
def trained(hidden: int = 16, steps: int = 420, batch: int = 32, seed: int = 5) -> Net:
    """The network after so many Adam steps over lines of the rule; the same in every process."""
    rng = np.random.default_rng(seed)
    net = Net.new(hidden, rng)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        x, y = np.zeros((batch, WINDOW), np.int64), np.zeros((batch, WINDOW), np.int64)
        for r in range(batch):
            text, spans = labelled(rng)
            tags = np.zeros(len(text), np.int64)
            for kind, a, b in spans:
                tags[a], tags[a + 1 : b] = 1 + 2 * kind, 2 + 2 * kind
            a = int(rng.integers(0, len(text) - WINDOW + 1))
            x[r], y[r] = classes(text)[a : a + WINDOW], tags[a : a + WINDOW]
        _, grad = net.loss(x, y)
        rate = 0.02 * min(1.0, step / 20) * (0.1 if step > 0.8 * steps else 1)
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return net


# ---------------------------------------------------------------- decoding

TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?at\s?[\])}>]|\sat\s+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]|\s*[\[({<]\s?dot\s?[\])}>]|\s+dot\s))", re.I)
#: A longer region ends at the next line or mark, which no span holds, so what is decoded at once has a bound in any text with lines or marks.
REGION, CUT = 1 << 16, re.compile(r"\n|(?<=[,;:!?]) ")
ALLOWED = np.zeros((TAGS, TAGS))
for _k in range(len(KINDS)):
    ALLOWED[:, 2 + 2 * _k] = -1e9
    ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0
START = np.array([0 if t == 0 or t % 2 else -1e9 for t in range(TAGS)])


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within a margin of a trigger, merged."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    if not any(b - a > REGION for a, b in out):
        return out
    cut: list[tuple[int, int]] = []
    for a, b in out:
        while b - a > REGION and (m := CUT.search(text, a + REGION, b)):
            cut.append((a, m.end()))
            a = m.end()
        cut.append((a, b))
    return cut


def region_scores(net: Net, xs: list[np.ndarray]) -> list[np.ndarray]:
    """Scores of each region's characters, each from the window in which it stands most central."""
    rows, places = [], []
    for k, x in enumerate(xs):
        for a in range(0, max(1, len(x) - WINDOW + STRIDE), STRIDE):
            w = np.full(WINDOW, 63, np.int64)
            part = x[a : a + WINDOW]
            w[: len(part)] = part
            rows.append(w)
            places.append((k, a))
    out = [np.zeros((len(x), TAGS)) for x in xs]
    best = [np.full(len(x), -1) for x in xs]
    central = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW))
    for a in range(0, len(rows), 512):
        s = net.scores(np.array(rows[a : a + 512]))
        for (k, b), e in zip(places[a : a + 512], s, strict=True):
            n = min(WINDOW, len(xs[k]) - b)
            rank = central[:n].copy()
            if b == 0:
                rank[: WINDOW // 2] = WINDOW  # nothing lies before
            if b + n == len(xs[k]):
                rank[n // 2 :] = np.maximum(rank[n // 2 :], WINDOW // 2)
            take = rank > best[k][b : b + n]
            out[k][b : b + n][take] = e[:n][take]
            best[k][b : b + n][take] = rank[take]
    return out


def viterbi(net: Net, scores: list[np.ndarray]) -> list[np.ndarray]:
    """The best tags of each region under the transitions, regions of like length together."""
    t = net.p["t"] + ALLOWED
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    order = sorted(range(len(scores)), key=lambda k: len(scores[k]))
    a = 0
    while a < len(order):
        b = a + 1  # as many as have 2^18 characters together, each counted as long as the longest
        while b < len(order) and (b + 1 - a) * len(scores[order[b]]) <= 1 << 18:
            b += 1
        group, a = order[a:b], b
        size = np.array([len(scores[k]) for k in group])
        length = int(size.max())
        e = np.zeros((len(group), length, TAGS))
        for r, k in enumerate(group):
            e[r, : size[r]] = scores[k]
        v = e[:, 0] + START
        back = np.zeros((length, len(group), TAGS), np.int8)
        keep = np.eye(TAGS) * 0 + np.where(np.eye(TAGS) > 0, 0, -1e9)
        for p in range(1, length):
            live = (p < size)[:, None, None]
            step = v[:, :, None] + np.where(live, t, keep)
            back[p] = step.argmax(1)
            v = step.max(1) + e[:, p]
        tag = v.argmax(1)
        path = np.zeros((len(group), length), np.int64)
        for p in range(length - 1, -1, -1):
            path[:, p] = tag
            tag = back[p, np.arange(len(group)), tag]
        for r, k in enumerate(group):
            out[k] = path[r, : size[r]]
    return out


#: A name and a host of parts; after a plain "at" parts are joined by a dot without space, a bracketed or a plain "dot".
SPELT = re.compile(r"[A-Za-z0-9._%+-]+(?:\s*(?:@|[\[({<]\s?at\s?[\])}>])\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[({<]\s?dot\s?[\])}>]|\sdot\s)\s*[A-Za-z0-9-]+)+|\s+at\s+[A-Za-z0-9-]+(?:(?:\.|\s*[\[({<]\s?dot\s?[\])}>]\s*|\s+dot\s+)[A-Za-z0-9-]+)+)", re.I)


def passes(kind: int, s: str) -> bool:
    """Whether an added span of a kind is one."""
    d = "".join(DIGIT.findall(s))
    if kind == 0:
        return bool(SPELT.fullmatch(s))
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and len(set(re.findall(r"[^0-9]+", s))) == 1 and "." in s
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch(r"[0-9]{3,6}(?:([ ./-])[0-9]{2,6})(?:\1[0-9]{1,6})*|[0-9]+", s))
    return 9 <= len(d) <= 15 and bool(re.fullmatch(r"\(?[0-9]{2,5}\)?[ .-]{1,2}[0-9]{2,5}[ .-][0-9]{3,8}", s))


def find(values: list[str], net: Net) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and the added ones."""
    base = [base_spans(v) for v in values]
    places, xs = [], []
    for k, v in enumerate(values):
        for a, b in regions(v):
            places.append((k, a))
            xs.append(classes(v[a:b]))
    added: list[list[tuple[int, int, int]]] = [[] for _ in values]
    for c, d in pieces(np.array([len(x) for x in xs], np.int64), 1 << 18):
        for (k, a), tags in zip(places[c:d], viterbi(net, region_scores(net, xs[c:d])), strict=True):
            at = 0
            while at < len(tags):
                if tags[at] % 2:
                    kind, end = int(tags[at]) // 2, at + 1
                    while end < len(tags) and tags[end] == 2 + 2 * kind:
                        end += 1
                    s, e = a + at, a + end
                    if passes(kind, values[k][s:e]) and not any(x < e and s < y for _, x, y in base[k]):
                        added[k].append((kind, s, e))
                    at = end
                else:
                    at += 1
    return list(zip(base, added, strict=True))


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans (all), n_added."""
    arrow_limits(docs.sparkSession)
    net = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (base, new) in zip(b.column(0).to_pylist(), find([v or "" for v in b.column(1).to_pylist()], net), strict=True):
                n = [sum(k == x for k, _, _ in base) for x in range(4)]
                rows.append((i, *n, hashlib.sha256(told(base).encode()).hexdigest(), told(base + new), len(new)))
            cols = zip(*rows, strict=True) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span as its kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join(out) + text[at:]


def masked(docs: DataFrame) -> DataFrame:
    """docs with the texts masked, all else as it was; null stays null."""
    arrow_limits(docs.sparkSession)
    net = trained()
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(place).to_pylist()
            new = [None if v is None else mask(v, base + more) for v, (base, more) in zip(values, find([v or "" for v in values], net), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == place else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
