"""Language identification by error-correcting output codes over hashed character n-grams.

Every learned language gets a codeword; each bit has a binary classifier, the log odds of the n-gram distributions of
the languages whose bit is 1 against those whose bit is 0.  The histograms behind them are summed over all training
rows in the cluster; only (languages x buckets) sums come to the driver.  A text's codeword of margins is decoded to
the language with the least weighted logistic loss; a small gap to the second flags the text as ambiguous.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no training row every text is
``und``; with one language all others are that one with score 1; equal texts get equal results; languages that
nothing tells apart tie: the least name is taken and flagged ambiguous; nulls in lang don't teach; a text of any length is
counted whole, in stretches; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, doc_hash, texts

DIMS = 4096


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # of the bits, mean 1
    odds: np.ndarray  # bits x buckets
    evidence: float = 40.0  # n-grams after which more text doesn't sharpen a margin
    ambiguous: float = 0.10


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """Exhaustive codes up to 7 languages, else the best of some random ones by their least distance."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        bits = 2 ** (n - 1) - 1
        return np.array([[1 if c == 0 or not (b + 1) >> (c - 1) & 1 else -1 for b in range(bits)] for c in range(n)], float)
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, 15 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - (code @ code.T))[~np.eye(n, dtype=bool)].min() / 2
        if apart > most:
            best, most = code, apart
    return best


def histogram(text: str) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of lower-cased letters; other characters count as a space, runs of it as one."""
    low = text.lower().encode("utf-32-le", "surrogatepass")
    total = np.zeros(DIMS, np.int64)
    step = 4 << 20  # bytes; pieces overlap by two characters, so no n-gram is lost or counted twice
    prior = np.empty(0, np.uint32)
    for a in range(0, len(low), step):
        c = np.frombuffer(low, np.uint32, min(step, len(low) - a) // 4, a)
        letter = (c >= 97) & (c <= 122) | (c >= 0xC0)
        c = np.where(letter, c, 32).astype(np.uint32)
        whole = np.concatenate((prior, c))
        keep = np.ones(len(whole), bool)
        keep[1:] = (whole[1:] != 32) | (whole[:-1] != 32)
        whole = whole[keep]
        k = min(2, int(keep[: len(prior)].sum())) if len(prior) else 0
        x = whole.astype(np.uint64)
        one = x * np.uint64(0x9E3779B97F4A7C15)
        parts = [one[k:]]
        if len(x) > 1:
            two = one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[1:]
            parts.append(two[max(0, k - 1) :])
        if len(x) > 2:
            three = two[:-1] * np.uint64(0x165667B19E3779F9) + one[2:]
            parts.append(three[max(0, k - 2) :])
        for p in parts:
            total += np.bincount((p >> np.uint64(48)).astype(np.int64) & (DIMS - 1), minlength=DIMS)
        prior = whole[-2:]
    return total


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(train: DataFrame) -> Model:
    """train: text, lang. All rows that have both teach."""
    arrow_limits(train.sparkSession)
    rows = train.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = histogram(text)
                sums[lang] = sums[lang] + h if lang in sums else h
        for lang, h in sums.items():
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(h[at], pa.int64())], names=["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in sums})
    place = {x: k for k, x in enumerate(languages)}
    h = np.zeros((len(languages), DIMS))
    for r in sums:
        h[place[r["lang"]], r["bucket"]] = r["n"]
    return model_of(languages, h)


def model_of(languages: list[str], histograms: np.ndarray) -> Model:
    codes = codebook(len(languages))
    p = (histograms + 0.5) / (histograms + 0.5).sum(1, keepdims=True) if len(languages) else histograms
    odds, power = [], []
    for b in range(codes.shape[1]):
        one, zero = p[codes[:, b] > 0].mean(0), p[codes[:, b] < 0].mean(0)
        w = np.log(one / zero)
        odds.append(w)
        power.append(((one - zero) * w).sum())  # how far apart the bit's sides are
    power = np.array(power)
    return Model(languages, codes, power / power.mean() if power.sum() > 0 else np.ones(len(power)), np.array(odds) if odds else np.zeros((0, DIMS)))


def decode(m: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, score and whether it is ambiguous."""
    if not m.languages or text is None or not has_letter(text):
        return "und", 0.0, True
    if len(m.languages) == 1:
        return m.languages[0], 1.0, False
    h = histogram(text)
    n = max(1, h.sum())
    margin = (m.odds @ h) * (min(1.0, m.evidence / n))
    loss = (m.weights * np.logaddexp(0, -m.codes * margin)).mean(1)
    order = np.argsort(loss, kind="stable")
    e = np.exp(-(loss - loss[order[0]]) * 2)
    gap = loss[order[1]] - loss[order[0]]
    return m.languages[order[0]], float(e[order[0]] / e.sum()), bool(gap < m.ambiguous)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [decode(model, t) for t in b.column(1).to_pylist()]
            a, s, q = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a, pa.string()), pa.array(s, pa.float64()), pa.array(q, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows of which crc32(doc_id) mod 4 isn't 2 and predicts all: doc_id, held_out, lang_pred, score, ambiguous."""
    held = F.pmod(doc_hash(), F.lit(4)) == 2
    model = fit(docs.where(~held))
    out = predict(docs, model)
    return out.select("doc_id", (F.pmod(doc_hash(), F.lit(4)) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
