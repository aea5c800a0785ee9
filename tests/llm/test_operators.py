"""The operators against brute force, on small documents with nulls, empties, ties, repeated rows and a long text."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestar.llm import bpe, decontaminate, jaccard, language, pii, pitman_yor, quality, suffix_dedup, token_counts, urls

from . import cases

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    """The cases, with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(cases.rows(), cases.DDL).repartition(3)
    return d.withColumns({c: F.lit("x") for c in ("key", "th", "n", "node", "row", "k", "block", "z", "score", "kind")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.DDL)


PLAIN = [(r[0], r[1]) for r in cases.rows()]


def compare(result, expected, names):
    """As multisets of rows by id."""
    got = sorted(((r["doc_id"], *(r[n] for n in names)) for r in result), key=repr)
    want = sorted(((i, *e) for (i, _), e in zip(PLAIN, expected, strict=True)), key=repr)
    assert got == want


def test_quality(docs, empty):
    got = quality.quality(docs).collect()
    compare(got, [cases.quality(t) for _, t in PLAIN], ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[1] and not kept[5] and not kept[11] and not kept[8]
    assert quality.quality(empty).count() == 0
    assert sorted(r["doc_id"] or 0 for r in quality.kept(docs).collect()) == sorted(r["doc_id"] or 0 for r in got if r["kept"])


def test_bands_reject_repetition_and_noise():
    bands = quality.Bands()
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice(["ba", "ne", "to", "ri", "ul", "en"]) for _ in range(rng.randint(1, 4))) for _ in range(800)).encode()
    noise = base64.b85encode(rng.randbytes(4000))
    again = b"the same words come again and again " * 100
    verdict = lambda t: quality.in_bands(len(t), *quality.ratios(t, bands, packer), bands)
    assert verdict(prose) and not verdict(noise + rng.randbytes(4000)) and not verdict(again)


def test_jaccard(docs, empty):
    compare(jaccard.join(docs).collect(), cases.jaccard(PLAIN), ["n_shingles", "component_id"])
    assert jaccard.join(empty).count() == 0


def test_jaccard_chains_and_groups(spark):
    """Chains of near copies whose ends aren't near, a large group, heavy shared lines."""
    rng = random.Random(4)
    line = "this line stands in every document of the whole table here"
    made, i = [], 0
    for g in range(12):
        w = [f"g{g}v{k}" for k in range(60)]
        for _ in range(rng.randint(1, 25)):
            w = list(w)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            made.append((i, line + " " + " ".join(w)))
            i += 1
    rng.shuffle(made)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(made, "doc_id long, text string"), heavy=16).collect()}
    assert [got[i] for i, _ in made] == cases.jaccard(made)
    kept = jaccard.one_of_each(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c in got.values()})


def test_suffix_dedup(docs, empty):
    compare(suffix_dedup.digests(docs).collect(), cases.repeats(PLAIN), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert suffix_dedup.digests(empty).count() == 0


def test_suffix_dedup_random(spark):
    rng = random.Random(2)
    pieces = ["".join(rng.choice("ab c") for _ in range(rng.randint(20, 120))) for _ in range(12)]
    made = [(i // 2 * 2 if i % 9 == 0 else i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(spark.createDataFrame(made, "doc_id long, text string")).collect())
    assert got == sorted((i, *e) for (i, _), e in zip(made, cases.repeats(made), strict=True))
    for r in suffix_dedup.kept_texts(spark.createDataFrame(made, "doc_id long, text string")).collect():
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def test_family_merges_geometrically():
    f = suffix_dedup.Family(50)
    for k in range(64):
        f.add(np.unique(np.array([f"{k:05d}{j:045d}".encode() for j in range(100)], "S50")))
    assert len(f.levels) <= 7 and sum(map(len, f.levels)) == 6400
    assert f.scan(np.array([f"{3:05d}{7:045d}".encode(), b"z" * 50], "S50")).tolist() == [True, False]


def tiktokens(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK, bpe.OVERLAP), (2000, 100), (300, 40)])
def test_bpe(docs, empty, chunk, overlap):
    expected = []
    for _, t in PLAIN:
        ids = tiktokens(t or "")
        expected.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    compare(bpe.digests(docs, RANKS, public_tokenizers.PATTERN, chunk, overlap).collect(), expected, ["n_tokens", "ids_sha256", "decoded_sha256"])
    assert bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_ids(docs):
    got = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, 500, 50).collect()
    compare(got, [(tiktokens(t or ""),) for _, t in PLAIN], ["ids"])


def test_bpe_cut_points():
    rng = random.Random(6)
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "1", "'s", "!?", "é", "   \n ", "\x1c", " \x1f"]) for _ in range(400))
        points = bpe.cut_points(text, public_tokenizers.PATTERN, 64, 20)
        ids = [x for a, b in zip(points, [*points[1:], len(text)], strict=True) for x in bpe.encode(text[a:b], enc)]
        assert ids == enc.encode_ordinary(text) and bpe.decode(ids, enc) == text.encode()


def test_urls(spark):
    made = [
        (0, "http://a.example.com/en/7/x"),
        (1, "http://a.example.com/en/8"),
        (2, "HTTPS://WWW.Example.NET/de/8?x=/de/"),
        (3, "https://x.org/es"),
        (4, None),
        (5, "no scheme here"),
        (6, "http://cheap-pills.example.org/a"),
        (7, "http://library.example.org/de/4"),
        (8, "http://host?x"),
        (9, "://"),
        (10, "http://notexample.com/en/7"),
        (11, "http://ÄB.org/es/ü#t"),
        (12, "http://h.fr/" + "a/" * 20000),
    ]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(made, "page_id long, url string")).collect()}
    seen = {k: (r["host"], r["path"], r["rule"]) for k, r in got.items() if k < 12}
    assert seen == {
        0: ("a.example.com", "/en/7/x", "example.com/en/7"),
        1: ("a.example.com", "/en/8", "com/en/"),
        2: ("www.example.net", "/de/8", "example.net/de/8"),
        3: ("x.org", "/es", None),
        4: ("", "", None),
        5: ("", "", None),
        6: ("cheap-pills.example.org", "/a", None),
        7: ("library.example.org", "/de/4", None),
        8: ("host", "", None),
        9: ("", "", None),
        10: ("notexample.com", "/en/7", "com/en/"),
        11: ("Äb.org", "/es/ü", "org/es/"),
    }
    assert [got[k]["verdict"] for k in (0, 1, 2, 6, 7, 11)] == ["allow", "block", "block", "block", "allow", "block"]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_path_without_host(spark):
    """A url without host is judged by its path; only one without both is left to the bias."""
    made = [(1, "file:///casino/poker/x"), (2, "file:///museum/library/x"), (3, None), (4, "no scheme")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(made, "page_id long, url string")).collect()}
    assert got[1]["host"] == "" and got[1]["path"] == "/casino/poker/x" and got[1]["score"] > got[2]["score"]
    assert got[3]["score"] == got[4]["score"] and got[3]["path"] == got[4]["path"] == ""


def test_url_model_generalises(spark):
    made = [(k, f"http://{h}.test.com/p/{k}", y) for k, (h, y) in enumerate([("super-casino", 1), ("mega-pills", 1), ("pokerbets", 1), ("city-museum", 0), ("weather-journal", 0), ("school-library", 0)])]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(made, "page_id long, url string, y int")).collect()}
    assert sum((got[k] == "block") == bool(y) for k, _, y in made) >= 5


def test_pii(docs, empty):
    got = pii.detect(docs).collect()
    expected = []
    for _, t in PLAIN:
        spans = cases.pii(t)
        n = [sum(k == x for k, _, _ in spans) for x in pii.KINDS]
        expected.append((*n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    compare(got, expected, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"])
    assert all(set(",".join(f"{k}:{a}:{b}" for k, a, b in cases.pii(t)).split(",")) <= set(r["spans"].split(",")) | {""} for (i, t) in PLAIN for r in got if r["doc_id"] == i)
    assert pii.detect(empty).count() == 0
    texts = [r["text"] for r in pii.masked(docs).where("doc_id = 14").collect()]
    assert len(texts) == 2 and all("[EMAIL] or [PHONE], card [CARD], host [IP]" in t for t in texts)


def test_pii_base_random():
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice(["1", "23", "4111111111111111", "a", "b.c", "@", ".", "-", " ", "+", "(", "x@y.z", "255", "é"]) for _ in range(rng.randint(0, 14)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == cases.pii(t), t


def test_pii_network():
    net = pii.trained()
    (base, added), = pii.find(["write to jo.doe [at] mail [dot] com or call (555) 123-4567 about 4111.1111.1111.1111 from 10[.]0[.]0[.]1, thanks"], net)
    assert not base and [k for k, _, _ in added] == [0, 3, 2, 1]
    rng = np.random.default_rng(321)
    hit = total = wrong = 0
    for _ in range(60):
        text, spans = pii.labelled(rng)
        tags = pii.viterbi(net, pii.region_scores(net, [pii.classes(text)]))[0]
        begins = {(int(tags[k]) // 2, k) for k in range(len(tags)) if tags[k] % 2}
        hit += len(begins & {(k, a) for k, a, _ in spans})
        wrong += len(begins - {(k, a) for k, a, _ in spans})
        total += len(spans)
    assert hit >= 0.9 * total and wrong <= 0.1 * total


def test_pii_gradient():
    rng = np.random.default_rng(1)
    net = pii.Net.new(3, rng)
    x, y = rng.integers(0, pii.CLASSES, (2, 7)), rng.integers(0, pii.TAGS, (2, 7))
    _, grad = net.loss(x, y)
    for k, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-5
        up = net.loss(x, y)[0]
        net.p[k][at] = old - 1e-5
        down = net.loss(x, y)[0]
        net.p[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_token_counts(docs, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [(len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 1024) for _, x in PLAIN]
    compare(token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), 5000).collect(), expected, ["n_bytes", "n_tokens", "over_limit"])
    assert token_counts.token_counts(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_split_is_safe():
    t = token_counts.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    for _ in range(80):
        x = "".join(rng.choice(["ab", " ", "  c", " d", ".", "1", "<|endoftext|>", "\n", "é", "'s", " the"]) for _ in range(300))
        parts = token_counts.split_safely(x, 40)
        assert "".join(parts) == x
        assert sum(len(t.encode(p, add_special_tokens=False)) for p in parts) == len(t.encode(x, add_special_tokens=False))


def _edit(rng, s, k):
    s = list(s)
    for _ in range(k):
        p = rng.randrange(len(s))
        what = rng.randrange(3)
        if what == 0:
            s[p] = rng.choice("abcdefgh ")
        elif what == 1:
            s.insert(p, rng.choice("abcdefgh"))
        else:
            del s[p]
    return "".join(s)


def _items(rng, n):
    return [" ".join("".join(rng.choice("aeioubcdfgstlmn") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 60))) for _ in range(n)]


def test_edits_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12))).encode()
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20))).encode()
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontaminate.edits(a, b)[0] == min(row)


@pytest.mark.parametrize(("share", "recall"), [(0.0, 1.0), (0.04, 0.97), (0.08, 0.9)])
def test_decontamination_recall(share, recall):
    rng = random.Random(9)
    items = _items(rng, 60)
    index = decontaminate.Index([(k, t.encode()) for k, t in enumerate(items)], decontaminate.Settings())
    filler = _items(rng, 60)
    hit = 0
    for k, t in enumerate(items):
        doc = f"{filler[k]} {_edit(rng, t, int(share * len(t)))} {filler[-k]}"
        found = [i for _, i, _, _ in index.leaks([filler[k].encode(), doc.encode()])]
        hit += k in found
    assert hit >= recall * len(items)
    assert not list(index.leaks([f.encode() for f in filler]))


def test_decontamination_finds_copies_of_every_length():
    rng = random.Random(21)
    items = [(n, "".join(rng.choice("aeioubcdfgstlmn") for _ in range(n)).encode()) for n in range(11, 121)]
    index = decontaminate.Index(items, decontaminate.Settings())
    found = {(k, i, n) for k, i, n, _ in index.leaks([b"some words before " + t + b" and some after" for _, t in items])}
    assert found == {(k, i, 0) for k, (i, _) in enumerate(items)}


def test_decontamination_does_not_depend_on_the_batch():
    rng = random.Random(22)
    items = [t.encode() for t in _items(rng, 40)]
    index = decontaminate.Index(list(enumerate(items)), decontaminate.Settings())
    for lost in (1, 2, 4):
        for k, t in enumerate(items):
            for text in (t[lost:], t[:-lost]):  # the item begins and ends the document
                alone = list(index.leaks([text]))
                assert [i for _, i, _, _ in alone] == [k]
                assert [(i, *rest) for n, i, *rest in index.leaks([b"a text before", text, b"a text after"]) if n == 1] == [(i, *rest) for _, i, *rest in alone]


@pytest.mark.parametrize("size", [230, 390, 1000])
@pytest.mark.parametrize("part", ["begin", "middle", "end"])
def test_decontamination_recall_of_crowded_edits(size, part):
    rng = random.Random(size)
    items = [" ".join(_items(rng, 30))[: size - 1] + "x" for _ in range(10)]
    index = decontaminate.Index([(k, t.encode()) for k, t in enumerate(items)], decontaminate.Settings())
    most = decontaminate.allowed(size, index.s)
    a = {"begin": 0, "middle": size // 2 - most, "end": size - 2 * most}[part]
    for k, t in enumerate(items):
        changed = list(t)
        for p in rng.sample(range(a, a + 2 * most), most):
            changed[p] = rng.choice(["p", "pq", ""])
        doc = f"{_items(rng, 1)[0]} {''.join(changed)} {_items(rng, 1)[0]}".encode()
        within = decontaminate.edits(t.encode(), decontaminate.normal(doc))[0] <= most
        assert [i for _, i, _, _ in index.leaks([b"before", doc])] == [k] * within


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(0, "  W10 w11 W12\n w13 w14 w15 w16 w17"), (1, None), (2, ""), (3, "tiny"), (None, "special strings inside texts"), (4, "not in any of these documents at all")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(i, 0) for i in (1, 2, 3, 4, 14, None)} | {(17, None)}
    left = sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect())
    assert left == sorted(i for i, _ in PLAIN if i not in (1, 2, 3, 4, 14, 17, None))
    assert decontaminate.leaks(empty, items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    blocks = decontaminate.Settings(item_bytes=64)  # more than one pass
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items, blocks).collect()} == got
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items, blocks).collect()) == left


def test_language(spark, small, docs, empty):
    d = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: r for r in language.identify(d).collect()}
    truth = {r["doc_id"]: r["lang"] for r in d.collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.9
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs).collect()}
    assert odd[5] == odd[6] == odd[7] == ("und", 0.0) and odd[1][0] in ("en", "fr")
    assert language.identify(empty).count() == 0


def test_language_histogram_pieces():
    text = "Ein kurzer Satz, und noch einer. " * 5
    whole = language.histogram(text)
    assert whole.sum() > 0
    codes = language.codebook(12)
    apart = min((codes[a] != codes[b]).sum() for a in range(12) for b in range(a))
    assert codes.shape[0] == 12 and apart >= codes.shape[1] // 4
    assert language.codebook(4).shape == (4, 7)


def test_lm(docs, empty, spark, small):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    got = pitman_yor.score(docs).collect()
    key = lambda r: (str(r[0]), r[1])
    mine = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["held_out"]) for r in got), key=key)
    want = sorted(((i, *e) for (i, _), e in zip(PLAIN, cases.base_score(PLAIN, held), strict=True)), key=key)
    assert len(mine) == len(want)
    for a, b in zip(mine, want, strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * max(1, abs(b[4])) and a[5] < 0 and a[6] == held(a[0])
    assert pitman_yor.score(empty).count() == 0
    d = spark.read.parquet(f"{small}/documents.parquet")
    rows = pitman_yor.score(d).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_lm_is_a_distribution(spark):
    """The probabilities of all texts of known words and one unknown add up to one, told from those of up to two words."""
    taught = [i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 7 != 2]
    made = list(zip(taught, ["a b a c", "a a b", "c a", "b", "", "a b"], strict=False))
    words = ["a", "b", "c", "unknown"]
    texts = ["", *words, *(f"{x} {y}" for x in words for y in words)]
    held = [i for i in range(100, 1999) if zlib.crc32(str(i).encode()) % 7 == 2]
    made += zip(held, texts, strict=False)
    got = {r["doc_id"]: 10 ** r["score"] for r in pitman_yor.score(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    p = dict(zip(texts, (got[i] for i in held[: len(texts)]), strict=True))
    one = np.array([p[x] for x in words])
    # A text's probability is the product of its steps; each word's step is weighed by the word's chance to end there.
    step = np.array([[p[f"{x} {y}"] / p[x] for y in words] for x in words])
    assert all(0 < v < 1 for v in p.values())
    assert abs(p[""] + one @ np.linalg.solve(np.eye(4) - step, np.ones(4)) - 1) < 1e-4


def test_seating_mean():
    """Table numbers follow the Chinese-restaurant expectation."""
    rng = np.random.default_rng(0)
    d, theta, p, c = 0.5, 1.0, 0.3, 40
    n = 4000
    slow = []
    for _ in range(n):
        t = 1
        for k in range(1, c):
            new = (theta + d * t) * p
            t += rng.random() < new / (new + k - d * t)
        slow.append(t)
    fast = pitman_yor.seat(np.full(n, c), np.ones(n), np.ones(n), np.full(n, p), d, theta, rng)
    assert abs(np.mean(slow) - fast.mean()) < 0.25
    assert fast.min() >= 1 and fast.max() <= c
    assert (pitman_yor.seat(np.array([0, 1]), np.array([0.0, 1.0]), np.array([1.0, 1.0]), np.array([0.5, 0.5]), d, theta, rng) == [0, 1]).all()


@pytest.mark.parametrize("edges_a_task", [1 << 19, 20])
def test_components(spark, monkeypatch, edges_a_task):
    """Chains, stars and rings, in one partition and across several."""
    from lodestar.llm import components as c

    monkeypatch.setattr(c, "EDGES", edges_a_task)
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(10, 40)] + [(k, (k + 1) % 20 + 200) for k in range(200, 220)] + [(9, 9)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    rng.shuffle(edges)
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in c.components(spark.createDataFrame(edges, "x long, y long").repartition(5)).collect()}
    assert got == {v: find(v) for v in parent if got.get(v) is not None or find(v) != v}
    assert set(got) == {v for e in edges for v in e}


def test_jaccard_bounds_are_safe():
    """No pair of sizes within a range asks for fewer shared lists than the bound of the range."""
    from fractions import Fraction
    from math import ceil

    p, q = 3, 4
    t = Fraction(p, q)
    exact = lambda a, b: (a + b) * p / (p + q) - max(ceil(t * a), ceil(t * b)) + 1
    for n in range(1, 160):
        sizes = range(ceil(t * n), n * q // p + 1)
        for low in sizes:
            for high in (h for h in sizes if h >= low):
                bound = min((n + low) * p / (p + q) - ceil(t * n), (n + high) * p / (p + q) - (high * p + q - 1) / q) + 1
                assert bound <= min(exact(n, m) for m in range(low, high + 1)) + 1e-9


@pytest.mark.parametrize("size", [600, 900, 1500, 3000, 6000, 10000, 30000])
def test_bands_by_length(spark, small, size):
    """From 3,000 bytes on random letters and text half of one sentence go; good documents stay at every length."""
    import zstandard

    packer, bands, rng = zstandard.ZstdCompressor(level=3), quality.Bands(), random.Random(size)
    good = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()}
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL").collect() if r["doc_id"] in good and not cases.quality(r["text"])[-1]]
    verdict = lambda t: quality.in_bands(len(t), *quality.ratios(t, bands, packer), bands)
    assert texts and all(verdict(t.encode()) for t in texts)
    letters = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(size // 9)).encode()
    words = sorted({w for t in texts for w in t.split()})
    prose = " ".join(rng.choice(words) for _ in range(size))[: size // 2].encode()
    again = b" ".join(prose.split()[:12]) + b" "
    half = prose + b" " + again * (size // 2 // len(again))
    assert size < 3000 or not verdict(half) and not verdict(letters)


def test_pii_long_numbers():
    net = pii.trained()
    (base, _), = pii.find(["0" * 5000 + ".0.0.1 and 1.2.3." + "9" * 5000], net)
    assert [(k, b - a) for k, a, b in base] == [(1, 5006)]
    table = "\n".join(f"row {k}, 4111 1111 1111 1111; 10.0.{k % 256}.7" for k in range(6000))
    (base, _), *rest = pii.find([table, *["call 555 12"] * 255], net)
    assert sum(k == 2 for k, _, _ in base) == 6000 and sum(k == 1 for k, _, _ in base) == 6000
    assert all(b - a <= pii.REGION + 200 for a, b in pii.regions(table))


def test_pii_reads_what_it_may_accept():
    for s in ("jo.doe at\tmail.example.com", "jo.doe  at  mail.example.com", "jo.doe at mail dot com", "jo ( at ) mail ( dot ) com", "jo\nat\nmail dot com"):
        assert pii.passes(0, s) and pii.regions("x" * 99 + " " + s), s
    assert not pii.passes(0, "meet at home. Then") and not pii.regions("meet at home. Then")


def test_greatest_id_is_not_null(spark):
    """2^63-1 is an id; null ids with different texts stay apart."""
    last = 2**63 - 1
    made = [(1, "a b c " * 30), (last, "a b c " * 30), (None, "a b c " * 30), (None, "x y z"), (last, "other words")]
    d = spark.createDataFrame(made, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digests(d).collect()), key=repr)
    assert got == sorted([(1, 180, 0), (last, 180, 180), (None, 180, 180), (None, 5, 0), (last, 11, 0)], key=repr)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in pitman_yor.score(d).collect()), key=repr)
    assert got == sorted([(1, 91), (last, 91), (None, 91), (None, 4), (last, 3)], key=repr)


def test_token_split_beyond_ascii():
    t = token_counts.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    for _ in range(80):
        x = "".join(rng.choice(["été", " ", "中文", "。", "，", " д", "²", "'s", "ß ä", "́", " 1", "\n"]) for _ in range(300))
        parts = token_counts.split_safely(x, 40)
        assert "".join(parts) == x and len(parts) > 3
        assert sum(len(t.encode(p, add_special_tokens=False)) for p in parts) == len(t.encode(x, add_special_tokens=False))
    assert [len("".join(c).encode()) <= 40 or len(c) == 1 for c in token_counts.balanced(["é" * 15] * 5, 40)] == [True] * 5


def test_urls_repeated_rows_and_clashing_columns(spark):
    names = ("host", "path", "rule", "verdict", "score", "_grams", "weights")
    made = [(1, "http://a.com/en/1"), (1, "http://a.com/en/1"), (2, "http://a.com/en/1"), (None, "http://b.fr/x"), (None, None)]
    plain = spark.createDataFrame(made, "page_id long, url string")
    rows = sorted(map(tuple, urls.judge(plain).collect()), key=repr)
    assert sorted(map(tuple, urls.judge(plain.selectExpr("*", *(f"'x' AS {c}" for c in names))).collect()), key=repr) == rows
    assert len(rows) == 5 and len({r[1:] for r in rows if r[0]}) == 1


def test_language_ties():
    """Languages with the same histogram can't be told apart: the least name, flagged, with a share of the score."""
    h = language.histogram("some words that both have")
    name, score, ambiguous = language.decode(language.model_of(["aa", "bb"], np.stack((h, h)).astype(float)), "some words")
    assert (name, ambiguous) == ("aa", True) and score == pytest.approx(0.5)
