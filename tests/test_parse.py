"""The parser on every form of call, import, parameter and variable that it knows."""

import ast
import gc
from collections import Counter
from textwrap import dedent

import pytest

from lodestar.operators import parse as parsing
from lodestar.operators.parse import parse


def functions(source, path="pkg/mod.py"):
    return {f["name"]: f for f in parse(path, dedent(source))["functions"]}


def calls(body, head="def f(self, p):"):
    return functions(head + "\n" + "\n".join("    " + line for line in dedent(body).strip().split("\n")))["f"]["calls"]


def test_function_row():
    f = functions('''
        @outer(1)
        @inner
        def load(a, b: int, c=1, d: str = "x", *args, e, **kw) -> List[int]:
            """Doc of load.

            More."""
            return a
    ''')["load"]
    assert f["id"] == "pkg.mod.load" and f["decorators"] == ["outer(1)", "inner"] and f["return_type"] == "List[int]"
    assert (f["start_line"], f["end_line"]) == (4, 8)
    assert f["docstring"].startswith('"""Doc of load.') and f["docstring"].endswith('"""') and f["code"].startswith("def load(")
    assert [(p["name"], p["type"], p["value"]) for p in f["parameters"]] == [("a", None, None), ("b", "int", None), ("c", None, "1"), ("d", "str", '"x"'), (None, None, None), ("e", None, None), (None, None, None)]


def test_scopes():
    f = functions("""
        class A:
            class B:
                def m(self):
                    def inner():
                        pass
        async def top():
            pass
    """)
    assert f["m"]["class_name"] == "A" and f["m"]["nested"] is None
    assert f["inner"]["id"] == "pkg.mod.A.m.inner" and f["inner"]["nested"] == "m"
    assert f["top"]["id"] == "pkg.mod.top" and f["top"]["code"].startswith("async def")


def test_classes():
    c = parse("pkg/mod.py", 'class A(Base[int], m.Other, metaclass=M):\n    """Doc."""\n')["classes"][0]
    assert c["id"] == "pkg.mod.A" and c["superclasses"] == ["Base[int]", "m.Other", "metaclass=M"] and c["docstring"] == '"""Doc."""'


@pytest.mark.parametrize(
    ("source", "path", "expected"),
    [
        ("import a.b", "x.py", []),
        ("import a.b as c", "x.py", [("c", "a.b")]),
        ("from a import b, c as d", "x.py", [("b", "a.b"), ("d", "a.c")]),
        ("from .u import f", "p/q/m.py", [("f", "p.q.u.f")]),
        ("from ..u import f as g", "p/q/m.py", [("g", "p.u.f")]),
        ("from . import f", "p/q/m.py", [("f", "p.q.f")]),
        ("from ..... import f", "p/m.py", []),
        ("from a import *", "x.py", []),
        ("def f():\n    from a import b", "x.py", [("b", "a.b")]),
    ],
)
def test_imports(source, path, expected):
    assert [(i["alias"], i["target"]) for i in parse(path, source)["imports"]] == expected


def test_module_docs():
    assert parse("a.py", '# c\n"""Mod doc. """\nx = 1')["docstring"] == "Mod doc."
    assert parse("a.py", "x = 1\n'no'")["docstring"] is None


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("g(h(1))", ["h", "g"]),
        ("obj.a().b().c()", ["obj.a", "obj.b", "obj.c"]),
        ("super().__init__()", ["super", "super().__init__"]),
        ("len(items_list)", ["len", "items_list.__len__", "items_list"]),
        ("self.encoder(p)", ["self.encoder", "self.encoder.forward"]),
        ("self.get_it(p)", ["self.get_it"]),
        ("x = Model()\nx(p)", ["Model", "x", "x.forward"]),
        ("map(worker, p)", ["map", "worker"]),
        ("Thread(target=worker, name=worker)", ["Thread", "worker"]),
        ("run(p, data, q)", ["run"]),
        ("run(obj.method)", ["run", "obj.method"]),
        ("h = self.method", ["self.method"]),
        ("self.x = 1\nif self.y == 2:\n    del self.z\nprint(f'{self.w}')\nself.v[0]\nself.u += 1", ["print"]),
        ("def inner():\n    hidden()\nshown()", ["shown"]),
        ("[g(i) for i in h()]", ["g", "h"]),
        ("lambda: g()", ["g"]),
        ("f'{g()}'", ["g"]),
        ("@deco(1)\ndef inner():\n    pass", ["deco"]),
        ("return a() if b() else c()", ["a", "b", "c"]),
        ("await g()", ["g"]),
    ],
)
def test_calls(body, expected):
    head = "async def f(self, p):" if "await" in body else "def f(self, p):"
    assert calls(body, head) == expected


def test_variables():
    f = functions("""
        def f():
            a = A()
            b = m.B(1)
            c = C if x else m.D
            d = E().make()
            with F() as g, h.I() as j:
                pass
            for k in a: pass
            for l in n.o(): pass
            q = [r for r in a]
            a = Z()
    """)["f"]
    assert f["var_types"] == {"a": ["Z"], "b": ["m.B"], "c": ["@ref:C", "@ref:m.D"], "g": ["F"], "j": ["h.I"]}
    assert f["var_sources"] == {"d": "E.make", "k": "@iter:a", "l": "@iter_call:n.o", "r": "@iter:a"}


def test_broken_file():
    r = parse("a.py", "def good():\n    x()\n\ndef bad(:\n    y()\n\nclass C:\n    def m(self):\n        z()\n")
    assert r["error"] and {f["name"] for f in r["functions"]} == {"good", "m"}
    assert {f["name"]: f["start_line"] for f in r["functions"]}["m"] == 8
    assert parse("a.py", "")["functions"] == []


def test_a_body_is_walked_once(monkeypatch):
    """Variables, calls and references come from one walk; definitions don't go into expressions."""
    asked, whole = [], parsing.children
    monkeypatch.setattr(parsing, "children", lambda node: asked.append(node) or whole(node))
    f = functions("def f(self, p):\n    v = [g(x + 1) for x in p]\n    if v and p:\n        return self.done, -p[0]\n")["f"]
    assert f["calls"] == ["g", "self.done"] and not f["var_types"]
    assert any(isinstance(n, ast.BinOp) for n in asked) and max(Counter(map(id, asked)).values()) == 1


def test_no_search_for_cycles_meanwhile(monkeypatch):
    """The collector rests while a file is parsed, and not after it, whatever the file is."""
    seen, whole = [], parsing._definitions
    monkeypatch.setattr(parsing, "_definitions", lambda *a: seen.append(gc.isenabled()) or whole(*a))
    assert gc.isenabled()
    parse("m.py", "def f():\n    g()\n")
    parse("m.py", "def f():\n    g()\n\ndef bad(:\n")
    with pytest.raises(TypeError):
        parse("m.py", None)
    assert seen and not any(seen) and gc.isenabled()


def test_a_parsed_body_leaves_no_cycle():
    """Trees go as soon as their file is done: a body's walk doesn't keep them."""
    gc.collect()
    parse("m.py", "class A:\n    def f(self):\n        for x in self.g(1): x.h(self.k)\n")
    assert not any(isinstance(o, ast.Module) for o in gc.get_objects())
