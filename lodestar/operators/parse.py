"""Python source texts to rows of functions, classes and imports.

One pass of the standard parser a file, inside Arrow-fed tasks.  A file that does not parse as a whole is parsed by its
top-level blocks, and what still fails is reported in its ``error``.
"""

from __future__ import annotations

import ast
import gc
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FUNCTION = "struct<id:string,name:string,file_path:string,class_name:string,nested:string,code:string,docstring:string,start_line:int,end_line:int,parameters:array<struct<name:string,type:string,value:string>>,decorators:array<string>,return_type:string,calls:array<string>,var_types:map<string,array<string>>,var_sources:map<string,string>>"
CLASS = "struct<id:string,name:string,file_path:string,code:string,docstring:string,start_line:int,end_line:int,decorators:array<string>,superclasses:array<string>>"
IMPORT = "struct<file_path:string,alias:string,target:string>"
SCHEMA = f"path string, functions array<{FUNCTION}>, classes array<{CLASS}>, imports array<{IMPORT}>, docstring string, error string"

# Built-in functions and the methods they call; names that are hardly functions when passed; keywords that
# take callbacks; starts and names of attributes that are methods, not modules to call.
DUNDERS = {n: f"__{n}__" for n in ("len", "str", "repr", "int", "float", "bool", "bytes", "hash", "iter", "next", "reversed", "abs", "round", "complex", "format")}
PLAIN_NAMES = frozenset("self cls args kwargs data items result value values key keys item x y z i j k n m a b c d e f None True False str int float list dict set tuple bytes bool type object path file name msg message text string config options settings params".split())
CALLBACK_KEYWORDS = frozenset("key target func function callback handler processor factory side_effect default default_factory".split())
METHOD_STARTS = tuple("get_ set_ is_ has_ can_ should_ validate_ process_ handle_ create_ build_ init_ load_ save_ update_ compute_ calculate_ run_ do_ make_ add_ remove_ delete_ check_ parse_ to_ from_ as_ with_ _".split())
METHOD_NAMES = frozenset("forward backward train eval parameters state_dict load_state_dict zero_grad step call apply register reset clear close".split())

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
MAX_DEPTH = 10


@lru_cache(maxsize=1024)
def module_id(path: str) -> str:
    return path.replace("/", ".").replace(".py", "")


def uncollected(f: Callable) -> Callable:
    """f, in which the search for cycles rests: a syntax tree has many nodes and none."""

    @wraps(f)
    def run(*args):  # noqa: ANN002, ANN202
        was = gc.isenabled()
        gc.disable()
        try:
            return f(*args)
        finally:
            if was:
                gc.enable()

    return run


class Text:
    """Source text by node: lines as bytes, since column offsets count bytes."""

    def __init__(self, source: str) -> None:
        self.lines = source.encode().split(b"\n")

    def of(self, node: ast.AST) -> str:
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return self.lines[a][node.col_offset : node.end_col_offset].decode()
        rows = [self.lines[a][node.col_offset :], *self.lines[a + 1 : b], self.lines[b][: node.end_col_offset]]
        return b"\n".join(rows).decode()


# Nodes that say nothing by themselves and hold no others; fields that hold only such nodes or no nodes.
LEAVES = frozenset({ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.alias, *(c for kind in (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop) for c in kind.__subclasses__())})
PLAIN_FIELDS = frozenset("ctx op ops id attr arg name names module level asname type_comment kind conversion is_async simple".split())
# Fields that hold statements, or else what holds them.
BLOCK_FIELDS = frozenset("body handlers orelse finalbody cases".split())
# Nodes that say something of variables.
BINDERS = frozenset({ast.Assign, ast.AnnAssign, ast.With, ast.AsyncWith, ast.For, ast.AsyncFor, ast.comprehension})
_fields: dict[type, tuple[str, ...]] = {}
_blocks: dict[type, tuple[str, ...]] = {}


def children(node: ast.AST) -> list[ast.AST]:
    """Child nodes in the order of fields, without LEAVES."""
    kind = type(node)
    if kind not in _fields:
        _fields[kind] = tuple(f for f in node._fields if f not in PLAIN_FIELDS)
    out = []
    for f in _fields[kind]:
        v = getattr(node, f, None)
        if isinstance(v, list):
            out += [x for x in v if isinstance(x, ast.AST) and type(x) not in LEAVES]
        elif isinstance(v, ast.AST) and type(v) not in LEAVES:
            out.append(v)
    return out


def blocks(node: ast.AST) -> list[ast.AST]:
    """Statements right under a node that isn't an expression, and its handlers and cases, in the order of fields."""
    kind = type(node)
    if kind not in _blocks:
        _blocks[kind] = tuple(f for f in node._fields if f in BLOCK_FIELDS)
    return [x for f in _blocks[kind] for x in getattr(node, f)]


def given(call: ast.Call) -> list[ast.AST]:
    """A call's arguments in the order in which they are written."""
    out = [*call.args, *call.keywords]
    return out if len(out) < 2 else sorted(out, key=lambda a: (a.lineno, a.col_offset))


#: Children in the order in which they are written, LEAVES at will, where that isn't the order of fields; of nested functions only the decorators.
IN_SOURCE_ORDER = {
    ast.Attribute: lambda n: (n.value,),
    ast.Expr: lambda n: (n.value,),
    ast.Call: lambda n: [n.func, *given(n)],
    **dict.fromkeys(DEFS, lambda n: n.decorator_list),
    ast.IfExp: lambda n: (n.body, n.test, n.orelse),
    ast.Dict: lambda n: [x for pair in zip(n.keys, n.values, strict=True) for x in pair if x is not None],
    ast.ClassDef: lambda n: [*n.decorator_list, *n.bases, *n.keywords, *n.body],
}


class Body:
    """What a function's body says about calls and variables."""

    def __init__(self, function: ast.AST, text: Text, params: set[str]) -> None:
        self.text, self.params = text, params
        self.types: dict[str, list[str]] = {}
        self.sources: dict[str, str] = {}
        self.calls: list[str] = []
        # Calls go by all variables, references by all calls.
        self.binders: list[ast.AST] = []
        self.made: list[ast.Call] = []
        self.selves: list[tuple[ast.Attribute, ast.AST, bool]] = []
        for s in function.body:
            if type(s) not in LEAVES:
                self.walk(s, function, False)
        for b in self.binders:
            self.variables(b)
        for c in self.made:
            self.called(c)
        seen = set(self.calls)
        for node, parent, deleted in self.selves:
            ref = f"self.{node.attr}"
            if ref not in seen and not deleted and self.refers(node, parent):
                seen.add(ref)
                self.calls.append(ref)

    def walk(self, node: ast.AST, parent: ast.AST, deleted: bool) -> None:
        """What says something of variables, then each call after its arguments, and what is named on self."""
        kind = type(node)
        if kind in BINDERS:
            self.binders.append(node)
        elif kind is ast.Attribute and type(node.value) is ast.Name:
            if node.value.id == "self":
                self.selves.append((node, parent, deleted))
            return
        for child in IN_SOURCE_ORDER.get(kind, children)(node):
            if type(child) not in LEAVES:
                self.walk(child, node, deleted or kind is ast.Delete)
        if kind is ast.Call:
            self.made.append(node)

    # -- calls

    def called(self, node: ast.Call) -> None:
        target = self.target(node)
        if target:
            self.calls.append(target)
            if self.calls_forward(target):
                self.calls.append(f"{target}.forward")
        if isinstance(node.func, ast.Name) and node.func.id in DUNDERS and node.args and isinstance(node.args[0], (ast.Name, ast.Attribute)):
            self.calls.append(f"{self.text.of(node.args[0])}.{DUNDERS[node.func.id]}")
        for arg in given(node):
            ref = self.passed(arg)
            if ref:
                self.calls.append(ref)

    def target(self, call: ast.Call) -> str:
        """The dotted name called; a call on a call's result keeps the first name and the last."""
        f = call.func
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Call):
            base = self.target(f.value).split(".")[0]
            if base and not base.startswith("super(") and base not in ("super", "cls", "type"):
                return f"{base}.{f.attr}"
        return self.text.of(f)

    def calls_forward(self, target: str) -> bool:
        """Whether a call runs a module's forward: of an attribute that isn't named like a method, or of an instance."""
        parts = target.split(".")
        if len(parts) == 2 and parts[0] == "self":
            return not parts[1].startswith(METHOD_STARTS) and parts[1] not in METHOD_NAMES
        return len(parts) == 1 and target in self.types and not any(t.startswith("@ref:") for t in self.types[target])

    def passed(self, arg: ast.AST) -> str | None:
        """A function passed as an argument."""
        if isinstance(arg, ast.Attribute):
            return self.text.of(arg)
        if isinstance(arg, ast.Name):
            name = arg.id
            return None if name in self.types or name in self.params or name in PLAIN_NAMES or len(name) == 1 and name.islower() else name
        if isinstance(arg, ast.keyword) and arg.arg in CALLBACK_KEYWORDS and isinstance(arg.value, (ast.Name, ast.Attribute)):
            name = self.text.of(arg.value)
            return None if name in self.types or name in self.params else name
        return None

    @staticmethod
    def refers(node: ast.Attribute, p: ast.AST) -> bool:
        """Whether self.method is neither called nor read as data by what stands around it."""
        if isinstance(p, ast.Call) and p.func is node or isinstance(p, (ast.Attribute, ast.Compare, ast.FormattedValue)):
            return False
        if isinstance(p, ast.Assign) and any(t is node for t in p.targets) or isinstance(p, (ast.AugAssign, ast.AnnAssign)) and p.target is node:
            return False
        return not (isinstance(p, ast.Subscript) and p.value is node)

    # -- variables

    def variables(self, node: ast.AST) -> None:
        """Types and sources of the variables that a node binds; the last one said counts."""
        if isinstance(node, (ast.Assign, ast.AnnAssign)):
            left = node.targets[-1] if isinstance(node, ast.Assign) else node.target
            if isinstance(left, ast.Name) and node.value is not None:
                self.assigned(left.id, node.value)
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                if isinstance(item.optional_vars, ast.Name) and isinstance(item.context_expr, ast.Call) and isinstance(item.context_expr.func, (ast.Name, ast.Attribute)):
                    self.types[item.optional_vars.id] = [self.text.of(item.context_expr.func)]
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.comprehension)) and isinstance(node.target, ast.Name):
            if isinstance(node.iter, ast.Name):
                self.sources[node.target.id] = f"@iter:{node.iter.id}"
            elif isinstance(node.iter, ast.Call):
                self.sources[node.target.id] = f"@iter_call:{self.text.of(node.iter.func)}"

    def assigned(self, name: str, value: ast.AST) -> None:
        if isinstance(value, ast.IfExp):
            refs = [f"@ref:{self.text.of(v)}" for v in (value.body, value.orelse) if isinstance(v, (ast.Name, ast.Attribute))]
            if refs:
                self.types[name] = refs
        elif isinstance(value, ast.Call):
            f = value.func
            if isinstance(f, ast.Name) or isinstance(f, ast.Attribute) and not isinstance(f.value, ast.Call):
                self.types[name] = [self.text.of(f)]
            elif isinstance(f, ast.Attribute) and isinstance(f.value.func, ast.Name):
                self.sources[name] = f"{f.value.func.id}.{f.attr}"


def parameters(args: ast.arguments, text: Text) -> list[dict]:
    """Name, type and value of each parameter; stars and bare separators give a row without name, unless typed."""
    out = []
    plain = [*args.posonlyargs, *args.args]
    if not (plain or args.vararg or args.kwonlyargs or args.kwarg):
        return out
    values = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    row = lambda a, v: {"name": a.arg, "type": text.of(a.annotation) if a.annotation else None, "value": text.of(v) if v is not None else None}
    nameless = {"name": None, "type": None, "value": None}
    star = lambda a, s: {"name": s + a.arg, "type": text.of(a.annotation), "value": None} if a.annotation else nameless
    for k, (a, v) in enumerate(zip(plain, values, strict=True)):
        out.append(row(a, v))
        if args.posonlyargs and k == len(args.posonlyargs) - 1:
            out.append(nameless)
    if args.vararg:
        out.append(star(args.vararg, "*"))
    elif args.kwonlyargs:
        out.append(nameless)
    out += [row(a, v) for a, v in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    if args.kwarg:
        out.append(star(args.kwarg, "**"))
    return out


def leading_string(body: list[ast.stmt], text: Text) -> str | None:
    first = body[0] if body else None
    if isinstance(first, ast.Expr) and (isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) or isinstance(first.value, ast.JoinedStr)):
        return text.of(first.value)
    return None


def unquoted(raw: str | None) -> str | None:
    """A module's doc without its quotes."""
    for q in ('"""', "'''", '"', "'"):
        if raw and raw.startswith(q) and raw.endswith(q) and len(raw) >= 2 * len(q):
            return raw[len(q) : -len(q)].strip()
    return raw


def scope(above: list[ast.AST], decorated: bool) -> tuple[str | None, str | None]:
    """(outermost class, nearest function) around a definition, at most MAX_DEPTH levels of the syntax tree up."""
    cls = nested = None
    depth = int(decorated)
    for node in reversed(above):
        depth += 1  # the block
        if depth >= MAX_DEPTH:
            break
        if isinstance(node, ast.ClassDef):
            cls = node.name
        elif isinstance(node, DEFS) and nested is None:
            nested = node.name
        depth += 1 + bool(getattr(node, "decorator_list", None))
        if depth >= MAX_DEPTH:
            break
    return cls, nested


def imported(node: ast.AST, path: str) -> Iterator[tuple[str, str]]:
    """(alias, dotted target) of an import statement; relative ones made absolute; plain imports bind nothing new."""
    if isinstance(node, ast.Import):
        for a in node.names:
            if a.asname:
                yield a.asname, a.name
    elif isinstance(node, ast.ImportFrom):
        lead = node.module or ""
        if node.level:
            parts = module_id(path).split(".")
            if node.level > len(parts):
                return
            lead = ".".join([*parts[: -node.level], *([node.module] if node.module else [])])
        for a in node.names:
            if a.name != "*" and lead:
                yield a.asname or a.name, f"{lead}.{a.name}"


def blocks_of(source: str) -> Iterator[tuple[int, str]]:
    """(first line from 0, text) of top-level blocks: a block begins at an unindented line that doesn't carry on the one before."""
    begin, lines = 0, source.split("\n")
    for k, line in enumerate(lines):
        carries = re.match(r"(else|elif|except|finally)\b|[)\]}#]", line) or k and lines[k - 1].startswith("@")
        if k and line and not line[0].isspace() and not carries:
            yield begin, "\n".join(lines[begin:k])
            begin = k
    yield begin, "\n".join(lines[begin:])


@uncollected
def parse(path: str, source: str) -> dict:
    """One row of SCHEMA."""
    out = {"path": path, "functions": [], "classes": [], "imports": {}, "docstring": None, "error": None}
    try:
        trees = [(0, source, ast.parse(source))]
    except (SyntaxError, ValueError, RecursionError) as e:
        out["error"] = f"{type(e).__name__}: {e}"
        trees = []
        for at, part in blocks_of(source):
            try:
                trees.append((at, part, ast.parse(part)))
            except (SyntaxError, ValueError, RecursionError):
                continue
    for at, part, tree in trees:
        text = Text(part)
        if at == 0:
            out["docstring"] = unquoted(leading_string(tree.body, text))
        _definitions(tree, [], path, text, at, out)
    out["imports"] = [{"file_path": path, "alias": a, "target": t} for a, t in out["imports"].items()]
    return out


def _definitions(root: ast.AST, above: list[ast.AST], path: str, text: Text, line: int, out: dict) -> None:
    # Expressions define and import nothing.
    stack = [(n, above) for n in reversed(blocks(root))]
    while stack:
        node, up = stack.pop()
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            out["imports"].update(imported(node, path))
        elif isinstance(node, (*DEFS, ast.ClassDef)):
            decorators = [text.of(d) for d in node.decorator_list]
            facts = {"name": node.name, "file_path": path, "code": text.of(node), "docstring": leading_string(node.body, text), "start_line": line + node.lineno, "end_line": line + node.end_lineno, "decorators": decorators}
            if isinstance(node, ast.ClassDef):
                bases = sorted([*node.bases, *node.keywords], key=lambda b: (b.lineno, b.col_offset))
                out["classes"].append({"id": f"{module_id(path)}.{node.name}", **facts, "superclasses": [text.of(b) for b in bases]})
            else:
                cls, nested = scope(up, bool(decorators))
                params = parameters(node.args, text)
                body = Body(node, text, {p["name"] for p in params if p["name"]})
                ident = ".".join(x for x in (module_id(path), cls, nested, node.name) if x)
                out["functions"].append({"id": ident, **facts, "class_name": cls, "nested": nested, "parameters": params, "return_type": text.of(node.returns) if node.returns else None, "calls": body.calls, "var_types": body.types, "var_sources": body.sources})
        if below := blocks(node):
            over = [*up, node] if isinstance(node, ast.stmt) else up
            stack += [(c, over) for c in reversed(below)]


def parsed(files: DataFrame) -> DataFrame:
    """One row of SCHEMA for each of files(path, content); files without content come back with an error alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse(p, c) if c is not None else {"path": p, "functions": [], "classes": [], "imports": [], "docstring": None, "error": "no content"} for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "functions", "classes", "imports", "docstring", "error"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def bare_functions_of(rows: DataFrame) -> DataFrame:
    """Function rows alone."""
    return rows.select(F.explode("functions").alias("f")).select("f.*")


def functions_of(rows: DataFrame) -> DataFrame:
    """Function rows, with the docs of their class (by bare name, the last file's) and module."""
    f = rows.select(F.explode("functions").alias("f"), F.col("docstring").alias("module_docstring")).select("f.*", "module_docstring")
    c = classes_of(rows).groupBy(F.col("name").alias("class_name")).agg(F.max_by("docstring", F.struct("file_path", "start_line")).alias("class_docstring"))
    return f.join(c, "class_name", "left")


def classes_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("classes").alias("c")).select("c.*")


def imports_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("imports").alias("i")).select("i.*")


def known_imports(imports: DataFrame, sub_paths: DataFrame) -> DataFrame:
    """file_path, alias, target of imports whose target, or else its parent, is a module of the tree; the module's full name is put in."""
    parent = F.regexp_replace("target", r"\.?[^.]*$", "")
    last = F.element_at(F.split("target", r"\."), -1)
    whole = sub_paths.select(F.col("sub_path").alias("target"), F.col("module").alias("m1"))
    upper = sub_paths.select(F.col("sub_path").alias("_parent"), F.col("module").alias("m2"))
    x = imports.where("alias <> target").withColumn("_parent", parent).withColumn("_last", last).join(whole, "target", "left").join(upper, "_parent", "left")
    return x.select("file_path", "alias", F.coalesce("m1", F.concat_ws(".", F.when(F.col("m2").isNotNull(), F.col("m2")), F.when(F.col("m2").isNotNull(), F.col("_last")))).alias("target")).where("target <> ''")
