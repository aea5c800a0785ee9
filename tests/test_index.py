"""A small repository from source tree to search, and its stream of changes."""

import os

import pytest
from pyspark.sql import functions as F

from lodestar.operators import embedding, incremental, symbols
from lodestar.plans.facade import Index
from lodestar.sources import pyrepo
from lodestar.streaming.changes import Snapshots, apply_batch, debounced_stream, follow

FILES = {
    "pkg/__init__.py": "from .a import load as read\n",
    "pkg/a.py": '"""Loading of tables."""\nfrom pkg._private import check\n\ndef load(path):\n    """Load a table from a path."""\n    check(path)\n    return Table(path)\n\nclass Table:\n    """A table of rows."""\n    def __init__(self, path):\n        self.path = path\n    def rows(self):\n        return scan(self.path)\n\ndef scan(path):\n    return []\n',
    "pkg/_private.py": "def check(path):\n    return bool(path)\n",
    "pkg/sub/b.py": "from pkg import read\n\ndef report(path):\n    t = read(path)\n    return t\n",
    "tests/test_a.py": "from pkg.a import load\n\ndef test_load():\n    load('x')\n",
    "build/gen.py": "def gen(): pass\n",
    "myenv/pyvenv.cfg": "",
    "myenv/lib.py": "def lib(): pass\n",
    "gen_x.py": "def ignored(): pass\n",
    "bad.py": "def broken(:\n    pass\n\ndef fine():\n    pass\n",
    ".gitignore": "gen_*.py\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "latin.py").write_bytes(b"x = '\xff'\n")
    return str(root)


@pytest.fixture(scope="module")
def index(spark, tree, tmp_path_factory):
    return Index(spark, str(tmp_path_factory.mktemp("index"))).build(tree)


def test_source(spark, tree):
    pyrepo.register(spark)
    rows = spark.read.format("pyrepo").load(tree).collect()
    assert sorted(r["path"] for r in rows) == ["bad.py", "latin.py", "pkg/__init__.py", "pkg/_private.py", "pkg/a.py", "pkg/sub/b.py", "tests/test_a.py"]
    assert [r["path"] for r in rows if r["error"]] == ["latin.py"]
    many = spark.read.format("pyrepo").option("partitionBytes", 10).option("strict", "false").load(tree)
    assert many.rdd.getNumPartitions() > 3 and many.where("error IS NOT NULL").count() == 0


def test_calls(index):
    got = {r["id"]: r["calls"] for r in index.functions().collect()}
    assert got["pkg.a.load"] == ["pkg._private.check", "pkg.a.Table.__init__"]
    assert got["pkg.a.Table.rows"] == ["pkg.a.scan"]
    assert got["pkg.sub.b.report"] == ["pkg.a.load"]
    assert got["tests.test_a.test_load"] == ["pkg.a.load"]


def test_search_and_views(index):
    text = index.search_tree("load table from path")
    assert "pkg.a.load" in text and "test_load" not in text
    assert "pkg.a.load" in index.search_tree("load table from path", full=True)
    assert [r["id"] for r in index.expand("pkg.a.load").collect()] == ["pkg._private.check", "pkg.a.Table.__init__"]
    assert [r["id"] for r in index.lookup(["Table.rows"]).collect()] == ["pkg.a.Table.rows"]
    assert index.lookup([], "SUB/").count() == 1
    assert [r["id"] for r in index.lookup_classes(["pkg.a.Table"]).collect()] == ["pkg.a.Table"]
    r = index.stats().first()
    assert r["functions"] == r["embedded"] == 8 and r["coverage"] == 100.0
    assert "pkg/a.py" in index.overview()
    index.log("search", {"q": "x"}, 3, 0.5)
    assert index.spark.read.json(f"{index.root}/query_log").count() == 1


def test_exports(spark):
    files = spark.createDataFrame([("p/__init__.py", "from .x import (a as b,  # why\n    c)\nfrom .y import d\nfrom ..z import e\n"), ("__init__.py", "from .w import g"), ("p/x.py", "from .y import q")], "path string, content string")
    got = {(r["export_key"], r["real_path"]) for r in symbols.package_exports(files).collect()}
    assert got == {("p.b", "p.x.a"), ("p.c", "p.x.c"), ("p.d", "p.y.d"), ("g", "w.g")}


def test_relative_modules(spark):
    for text, module, want in ((".u", "a.b.m", "a.b.u"), ("..u", "a.b.m", "a.u"), ("..", "a.b.m", "a"), ("....u", "a.m", None)):
        assert spark.range(1).select(symbols.relative_module(F.lit(text), F.lit(module)).alias("v")).first()["v"] == want


def test_embedding_in_halves():
    def small(texts):
        if len(texts) > 2:
            raise embedding.TooLarge
        return [[len(t)] for t in texts]

    assert embedding.in_halves(small, ["a", "bb", "ccc", "dddd", "e"]) == [[1], [2], [3], [4], [1]]
    with pytest.raises(embedding.TooLarge):
        embedding.in_halves(lambda t: (_ for _ in ()).throw(embedding.TooLarge()), ["a"])


def test_rate_limit():
    now = [0.0]
    limit = embedding.RateLimit(per_minute=60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(121):
        limit.wait()
    assert now[0] >= 119.9


def test_row_diff(spark):
    ddl = "id string, code string, docstring string"
    old = spark.createDataFrame([("a", "x", "d"), ("b", "x", "d"), ("c", "x", "d"), ("e", "x", None)], ddl)
    new = spark.createDataFrame([("a", "y", "d"), ("b", "x", "e"), ("d", "x", "d"), ("e", "x", None)], ddl)
    assert {r["id"]: r["change"] for r in incremental.row_diff(old, new).collect()} == {"a": "changed", "b": "refreshed", "c": "deleted", "d": "inserted", "e": "same"}


def test_stream_follows_the_tree(spark, tmp_path):
    root, check = tmp_path / "r", str(tmp_path / "check")
    root.mkdir()
    (root / "a.py").write_text("def one(): pass\n")
    (root / "b.py").write_text("def two(): pass\n")
    snaps = Snapshots(spark, str(tmp_path / "snaps"))

    def step():
        q = follow(spark, str(root), snaps, check)
        q.processAllAvailable()
        q.stop()
        return sorted(f["name"] for r in snaps.read().collect() for f in r["functions"])

    assert step() == ["one", "two"]
    (root / "a.py").write_text("def one(): pass\ndef three(): pass\n")
    os.utime(root / "a.py", (1, 1))
    assert step() == ["one", "three", "two"]
    (root / "b.py").unlink()
    assert step() == ["one", "three"]
    version = snaps.current()["version"]
    assert step() == ["one", "three"] and snaps.current()["version"] == version


def test_index_follows_the_tree(spark, tmp_path):
    """A change of one file reaches search, calls into it from other files, and vectors; the rest isn't embedded again."""
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("def load(path):\n    return path\n")
    (root / "b.py").write_text("from a import load\n\ndef use():\n    load(1)\n")
    asked = str(tmp_path / "asked")

    class Told(embedding.HashEmbedder):
        def __call__(self, texts):
            with open(asked, "a") as f:
                f.write("x" * len(texts))
            return super().__call__(texts)

    def told():
        n = os.path.getsize(asked) if os.path.exists(asked) else 0
        open(asked, "w").close()
        return n

    index = Index(spark, str(tmp_path / "index"), Told()).build(str(root))
    calls = lambda: {r["id"]: r["calls"] for r in index.functions().collect()}
    assert calls() == {"a.load": [], "b.use": ["a.load"]} and told() == 2

    def step():
        q = index.watch(str(root), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()

    step()
    assert told() == 0 and index.tables.current()["version"] == 0
    (root / "a.py").write_text("def load(path):\n    return path\n\ndef sort_numbers(values):\n    return load(values)\n")
    step()
    assert calls() == {"a.load": [], "a.sort_numbers": ["a.load"], "b.use": ["a.load"]} and told() == 1
    assert "a.sort_numbers" in index.search_tree("sort numbers")
    # What happened while nobody watched is caught up with by the hashes on record.
    (root / "b.py").unlink()
    (root / "c.py").write_text("def other(): pass\n")
    index.build(str(root))
    assert set(calls()) == {"a.load", "a.sort_numbers", "c.other"} == {r["id"] for r in index.table("vectors").collect()}
    version = index.tables.current()["version"]
    assert index.build(str(root)).tables.current()["version"] == version
    assert not os.path.exists(str(tmp_path / "index" / "tables" / "v0-0"))


def test_last_row_of_a_path_counts(spark, tmp_path):
    snaps = Snapshots(spark, str(tmp_path / "snaps"))
    ddl = "path string, content string, hash string, error string"
    put = lambda *rows: spark.createDataFrame(list(rows), ddl).coalesce(1)
    found = lambda: sorted((r["path"], f["name"]) for r in snaps.read().collect() for f in r["functions"])
    assert apply_batch(snaps, put(("a.py", "def one(): pass", "1", None), ("a.py", "def two(): pass", "2", None), ("b.py", "def b(): pass", "3", None)), 0) == 2
    assert found() == [("a.py", "two"), ("b.py", "b")]
    assert apply_batch(snaps, put(("b.py", None, None, "deleted"), ("b.py", "def c(): pass", "4", None), ("a.py", "def x(): pass", "5", None), ("a.py", None, None, "deleted")), 1) == 2
    assert found() == [("b.py", "c")]
    assert apply_batch(snaps, put(("b.py", None, None, "not UTF-8")), 2) == 0
    assert found() == [("b.py", "c")]


def test_debounced_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ddl = "repository string, path string, change string, ts timestamp"
    rows = [("r", "a", "changed", "2024-01-01 00:00:00"), ("r", "a", "deleted", "2024-01-01 00:00:01"), ("r", "a", "changed", "2024-01-01 00:01:00"), ("r", "z", "changed", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "repository string, path string, change string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = debounced_stream(spark.readStream.schema(ddl).parquet(src), "2500 milliseconds")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", out).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["change"] for r in spark.table("bursts").where("path = 'a'").collect()) == ["changed", "deleted"]
