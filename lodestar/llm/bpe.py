"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts up to ``chunk`` characters are encoded where they lie.  A longer text is cut into overlapping chunks that are
dealt over the cluster: each is split into pre-tokens on its own, neighbours are stitched at the first place inside
their overlap where both have a boundary after something other than white space (the pattern never looks back, so from
a common boundary on both splits are the same, and it looks ahead only from white space), and the pieces between those places are encoded apart.  Where an overlap holds no common boundary the
piece runs on to the next chunk that has one, so every piece is a whole number of pre-tokens of the text.
Decoding concatenates the raw bytes of the ids.

Defined results: null counts as the empty text, which has no ids; equal rows give equal results, each row its own;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, texts

CHUNK, OVERLAP = 1 << 15, 1 << 10


@cache
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file; each Python worker loads it once."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, enc: tiktoken.Encoding) -> list[int]:
    return enc.encode_ordinary(text)


def decode(ids: list[int], enc: tiktoken.Encoding) -> bytes:
    return enc.decode_bytes(ids)


#: The encoder counts these as marks, the regular expressions here as white space: looked at as another mark.
SEPARATORS = {c: "\x01" for c in range(0x1C, 0x20)}


def boundaries(text: str, pattern: regex.Pattern, last: bool) -> list[int]:
    """Starts of the pre-tokens of a chunk that its end can't have changed."""
    spans = [m.start() for m in pattern.finditer(text.translate(SEPARATORS))]
    return spans if last else spans[:-2]


def cuttable(text: str, at: int) -> bool:
    """Whether a text may end here: white space splits by what follows it, so it must not be what the piece ends with."""
    return at > 0 and not text[at - 1].isspace()


def cut_points(text: str, pattern: str, chunk: int, overlap: int) -> list[int]:
    """Where a text is cut: the chunks' stitching done in one place (small texts, tests)."""
    compiled = regex.compile(pattern)
    starts = list(range(0, max(1, len(text)), chunk))
    edges = []
    for k, s in enumerate(starts):
        e = min(len(text), s + chunk + overlap)
        edges.append({s + x for x in boundaries(text[s:e], compiled, e == len(text))})
    points, truth = [0], edges[0]
    for s, own in zip(starts[1:], edges[1:], strict=True):
        common = [x for x in truth & own if s <= x < s + overlap and cuttable(text, x)]
        if common:
            points.append(min(common))
            truth = own
        else:
            break  # the rest is one piece
    return points


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids array<int> of every document. ranks_path must be readable on every node."""
    pieces = _pieces(docs, pattern, chunk, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            out = [enc.encode_ordinary(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("start"), pa.array(out, pa.list_(pa.int32()))], names=["row", "doc_id", "start", "ids"])

    schema = "row long, doc_id long, start long, ids array<int>"
    whole = pieces["short"].mapInArrow(run, schema).select("doc_id", "ids")
    parts = pieces["long"].mapInArrow(run, schema)
    joined = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("p"))
    return whole.unionByName(joined.select("doc_id", F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids")))


def _pieces(docs: DataFrame, pattern: str, chunk: int, overlap: int) -> dict[str, DataFrame]:
    """Short texts as they are, and the stitched pieces of long ones, spread over the cluster."""
    arrow_limits(docs.sparkSession)
    d = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    long = F.octet_length("text") > chunk
    short = d.where(~long).select(F.lit(0).cast("long").alias("row"), "doc_id", F.lit(0).cast("long").alias("start"), "text")
    # A row number of its own keeps repeated rows apart; the scan gives it anew, the same, to a task that runs again.
    rows = d.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def chop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                starts = list(range(0, len(t), chunk))
                for a in range(0, len(starts), 64):
                    some = starts[a : a + 64]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([i] * n, pa.int64()), pa.array(range(a, a + n), pa.int32()), pa.array(some, pa.int64()), pa.array([t[s : s + chunk + overlap] for s in some], pa.string()), pa.array([s + chunk + overlap >= len(t) for s in some], pa.bool_())], names=["row", "doc_id", "k", "start", "text", "last"])

    chunk_ddl = "row long, doc_id long, k int, start long, text string, last boolean"
    rows = rows.mapInArrow(chop, chunk_ddl).repartition("row", "k")
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pat = regex.compile(pattern)
        for b in batches:
            head, tail = [], []
            for s, t, last in zip(b.column("start").to_pylist(), b.column("text").to_pylist(), b.column("last").to_pylist(), strict=True):
                own = boundaries(t, pat, last)
                head.append([s + x for x in own if x < overlap])
                tail.append([s + x for x in own if x >= chunk and cuttable(t, x)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=[*b.schema.names, "head", "tail"])

    done = rows.mapInArrow(split, chunk_ddl + ", head array<long>, tail array<long>")
    return {"short": short, "long": _stitch(done, chunk).repartition("row", "start")}


def _stitch(done: DataFrame, chunk: int) -> DataFrame:
    """Pieces between common boundaries: (row, doc_id, start, text)."""
    w = Window.partitionBy("row").orderBy("k")
    cut = F.array_min(F.array_intersect("head", F.lag("tail").over(w)))
    # The first chunk starts the text.  A chunk without a common boundary joins the piece before it, and so do all after it,
    # for their splits are not known to be true.
    p = done.withColumn("cut", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(cut))
    p = p.withColumn("broken", F.max(F.col("cut").isNull()).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("cut", F.when(~F.col("broken"), F.col("cut"))).withColumn("next", F.lead("cut").over(w))
    p = p.withColumn("ends", F.lead("k").over(w).isNull())
    # own: this chunk's characters from its cut up to the next chunk's cut, or to its own end if that one has none.
    begin = F.coalesce(F.col("cut"), F.col("start"))
    stop = F.when(F.col("ends"), F.col("start") + F.length("text")).otherwise(F.coalesce(F.col("next"), F.col("start") + chunk))
    p = p.withColumn("own", F.substring("text", (begin - F.col("start") + 1).cast("int"), (stop - begin).cast("int")))
    p = p.withColumn("piece", F.last("cut", ignorenulls=True).over(w))
    whole = p.where(~F.col("broken") & (F.col("ends") | F.col("next").isNotNull())).select("row", "doc_id", F.col("cut").alias("start"), F.col("own").alias("text"))
    mended = p.where(F.col("broken") | (~F.col("ends") & F.col("next").isNull())).groupBy("row", "doc_id", "piece").agg(F.array_sort(F.collect_list(F.struct("k", "own"))).alias("o"))
    mended = mended.select("row", "doc_id", F.col("piece").alias("start"), F.array_join(F.transform("o", lambda x: x["own"]), "").alias("text"))
    return whole.unionByName(mended)


def digests(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, decoded and digested.

    A long text's pieces come back as (ids as text, decoded bytes) and are joined in order, one row a document.
    """
    pieces = _pieces(docs, pattern, chunk, overlap)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            n, a, d = [], [], []
            for t in b.column("text").to_pylist():
                ids = enc.encode_ordinary(t)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            n, a, d = [], [], []
            for t in b.column("text").to_pylist():
                ids = enc.encode_ordinary(t)
                n.append(len(ids))
                a.append(" ".join(map(str, ids)))
                d.append(enc.decode_bytes(ids))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("start"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.binary())], names=["row", "doc_id", "start", "n", "a", "d"])

    out = pieces["short"].mapInArrow(short, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    parts = pieces["long"].mapInArrow(part, "row long, doc_id long, start long, n long, a string, d binary")
    one = parts.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "n", "a", "d"))).alias("p"))
    size = F.aggregate("p", F.lit(0).cast("long"), lambda s, p: s + p["n"])
    bytes_hex = F.array_join(F.transform("p", lambda p: F.hex(p["d"])), "")
    one = one.select("doc_id", size.alias("n_tokens"), F.sha2(F.array_join(F.transform("p", lambda p: p["a"]), " "), 256).alias("ids_sha256"), F.sha2(F.unhex(bytes_hex), 256).alias("decoded_sha256"))
    return out.unionByName(one)
