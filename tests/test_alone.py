"""Files resolved as if each were alone, with the rest in buckets: against the whole program in one task, and against SQL."""

import gc
from textwrap import dedent

import duckdb
import pytest

from lodestar.operators import resolve
from lodestar.operators.parse import parse
from lodestar.plans import catalogue

#: Queries of which each file tells all that its calls need.
QUERIES = [
    "q59_linear_order",
    "q57_variables",
    "q44_resolve",
    "q55_super",
]


@pytest.mark.parametrize("name", QUERIES)
def test_no_function_is_left(spark, small, monkeypatch, name):
    """Each file is parsed and resolved in one task, and no function goes through the buckets."""
    calls = []
    monkeypatch.setattr(resolve, "_in_buckets", lambda *a: calls.append(a))
    got = sorted(tuple(r) for r in catalogue.QUERIES[name](spark, small).select("id", "calls").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{small}/part.parquet'")
    assert not calls and got == sorted(con.execute(f"SELECT id, calls FROM ({catalogue.ORACLES[name]})").fetchall())


FILES = {
    "a/one.py": """
        from a.two import helper as h, Far
        from outside import gone
        class Base:
            def __init__(self): pass
            def go(self): self.step()
            def step(self): pass
        class Child(Base):
            def go(self): super().go()
            def step(self): gone.thing(); only_three()
        @h
        def run(x):
            h(x)
            Far().walk()
            x.only_three()
            Child().go()
            local()
        def local(): pass
    """,
    "a/two.py": """
        def deco(f): pass
        def helper(x):
            def inner(): inner()
            inner()
        class Far:
            def walk(self) -> Near: pass
        class Near:
            def close(self): pass
        @deco
        def made():
            for n in Far().walk(): n.close()
            v = Far()
            v.walk()
    """,
    "b/three.py": """
        class Child:
            def step(self): self.only_three()
            def only_three(self): pass
        def free(): Child().step()
        def quiet(): pass
        def quiet(): free()
    """,
    "b/same.py": "class Twin:\n    def go(self): pass\ndef apart(): unique_name()\ndef unique_name(): pass\n",
    "b/same/Twin.py": "def go(): pass\ndef stop(): go()\n",
    "b/plain.py": "import a.one\ndef sole(): lone()\ndef lone(): pass\n",
    "b/broken.py": "def fine(): lone_too()\ndef lone_too(): pass\ndef bad(:\n",
    "b/empty.py": "x = 1\n",
}


@pytest.mark.parametrize("one_task", [1, 3, 1000])
def test_files_that_share_symbols(spark, one_task):
    files = {p: dedent(t) for p, t in FILES.items()}
    rows = [parse(p, t) for p, t in files.items()]
    fs = sorted((f for r in rows for f in r["functions"]), key=lambda f: (f["file_path"], f["id"]))
    cs = sorted((c for r in rows for c in r["classes"]), key=lambda c: (c["file_path"], c["id"]))
    known = [{"file_path": "a/one.py", "alias": "h", "target": "a.two.helper"}, {"file_path": "a/one.py", "alias": "Far", "target": "a.two.Far"}]
    done = resolve.Program(fs, cs, known, {}).all_calls()
    want, seen = [], set()
    for k, f in enumerate(fs):
        if (f["file_path"], f["id"]) not in seen:
            want.append((f["file_path"], f["id"], done[k]))
        seen.add((f["file_path"], f["id"]))
    table = spark.createDataFrame([(p, t) for p, t in files.items()] + [("b/none.py", None)], "path string, content string").repartition(3)
    got = [(r["file_path"], r["id"], r["calls"]) for r in resolve.calls_of_files(table, one_task=one_task).collect()]
    assert sorted(got) == sorted(want)


def test_a_file_given_twice(spark):
    """Rows of one path count as one file; the first function of an id has the row."""
    table = spark.createDataFrame([("m.py", "def f(): g()\ndef g(): pass\n"), ("m.py", "def f(): h()\ndef h(): pass\n")], "path string, content string").coalesce(1)
    got = {r["id"]: r["calls"] for r in resolve.calls_of_files(table).collect()}
    assert got == {"m.f": ["m.g"], "m.g": [], "m.h": []}


def test_marks():
    r = parse("m.py", "class A:\n    def f(self): self.g()\n    def g(self): pass\ndef k(x): x.elsewhere()\n")
    done = resolve.alone("m.py", r["functions"], r["classes"], r["imports"])
    assert set(dict(done["calls"])["m.A.f"]) == {"m.A.g"} and not done["left"]
    assert {"bmm.A", "bmm", "bnA", "dnk", "rnelsewhere"} <= set(done["marks"])


def test_only_users_of_imports_are_left(spark, small, monkeypatch):
    """q58_imported_calls: of each four functions only the one that calls through imports goes through the buckets."""
    whole, left = resolve._in_buckets, []

    def counted(functions, *more):
        left.append((functions.where("todo").count(), functions.count()))
        return whole(functions, *more)

    monkeypatch.setattr(resolve, "_in_buckets", counted)
    got = sorted(tuple(r) for r in catalogue.q58_imported_calls(spark, small).select("id", "calls").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{small}/part.parquet'")
    assert got == sorted(con.execute(f"SELECT id, calls FROM ({catalogue.ORACLES['q58_imported_calls']})").fetchall())
    assert left == [(len(got) // 4, len(got))]


LOOPS = {
    "c/loops.py": "def each():\n    for x in unknown():\n        x.go()\n    for y in made():\n        y.only_far()\n    z = a().b()\n    z.go()\n",
    "c/far.py": "class Far:\n    def only_far(self): pass\ndef plain(v):\n    for w in v: w.only_far()\n",
}


def test_variables_of_no_known_class():
    """Items of a call without an annotated result are of no class: neither a file alone nor a bucket asks for one."""
    rows = [parse(p, t) for p, t in LOOPS.items()]
    done = resolve.alone("c/loops.py", rows[0]["functions"], [], [])
    assert dict(done["calls"]) == {"c.loops.each": []} and not done["left"]
    part = resolve.Part(rows[0]["functions"], [], {})
    assert part.tried(rows[0]["functions"][0]) is None and all(key is not None for _, key in part.missing)


def test_loops_in_buckets(spark):
    rows = [parse(p, t) for p, t in LOOPS.items()]
    fs = [f for r in rows for f in r["functions"]]
    done = resolve.Program(fs, [c for r in rows for c in r["classes"]], [], {}).all_calls()
    table = spark.createDataFrame(list(LOOPS.items()), "path string, content string")
    got = {r["id"]: r["calls"] for r in resolve.calls_of_files(table, one_task=1).collect()}
    assert got == {f["id"]: done[k] for k, f in enumerate(fs)}


def test_facts_of_a_file_go_at_once():
    """Thousands of files pass through a task: what one was resolved by doesn't wait for the search for cycles."""
    r = parse("m.py", "class A:\n    def f(self): self.g()\n    def g(self): pass\n")
    gc.collect()
    gc.disable()
    try:
        resolve.alone("m.py", r["functions"], r["classes"], r["imports"])
        assert not any(isinstance(o, resolve.Alone) for o in gc.get_objects())
    finally:
        gc.enable()


def test_super_without_search_for_cycles(monkeypatch):
    """A file with a parent's method and its override is resolved while the collector rests."""
    seen, whole = [], resolve.Alone.of_super
    monkeypatch.setattr(resolve.Alone, "of_super", lambda *a: seen.append(gc.isenabled()) or whole(*a))
    r = parse("m.py", "class A:\n    def go(self): self.it()\n    def it(self): pass\nclass B(A):\n    def go(self): super().go()\n    def it(self): pass\n")
    done = resolve.alone("m.py", r["functions"], r["classes"], r["imports"])
    assert dict(done["calls"])["m.B.go"] == ["m.A.go", "m.B.it"] and seen == [False] and gc.isenabled()
