"""The pipeline against the operators' brute-force versions."""

import hashlib

import corpus_pipeline
import public_tokenizers
from lodestar.llm import bpe, decontaminate, pii, quality

from . import cases


def test_pipeline(spark, small, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    import zstandard

    packer, bands = zstandard.ZstdCompressor(level=3), quality.Bands()
    kept = [(i, t) for i, t in docs if not cases.quality(t)[-1] and quality.in_bands(len(t.encode()), *quality.ratios(t.encode(), bands, packer), bands)]
    kept = [d for d, (_, c) in zip(kept, cases.jaccard(kept), strict=True) if d[0] == c]
    index = decontaminate.Index(items, decontaminate.Settings())
    kept = [(i, t) for i, t in kept if not list(index.leaks([t.encode()]))]
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = set()
    for i, t in kept:
        (base, added), = pii.find([t], pii.trained())
        ids = enc.encode_ordinary(pii.mask(t, base + added))
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want and 0 < len(got) < len(docs)


def test_stages_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_stages_on_cases(spark, small):
    docs = spark.createDataFrame(cases.rows(), cases.DDL)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).collect()
        stage(spark, docs.limit(0), small).collect()
