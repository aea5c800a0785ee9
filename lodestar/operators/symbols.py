"""Symbol tables: module paths, re-exports, ancestors, unique names and decorators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Decorators that lead to no function of the program, and method names too common to tell a class by.
BUILTIN_DECORATORS = ("staticmethod", "classmethod", "property", "abstractmethod", "dataclass", "contextmanager", "lru_cache", "cached_property")
COMMON_METHODS = (
    "append", "extend", "insert", "remove", "pop", "clear", "index", "count", "sort", "reverse", "copy", "get", "set", "keys", "values", "items", "update", "format", "split", "join", "strip", "replace",
    "find", "startswith", "endswith", "lower", "upper", "encode", "decode", "read", "write", "close", "open", "flush", "seek", "tell",
    "__init__", "__call__", "__str__", "__repr__", "__len__", "__iter__", "__next__", "__getitem__", "__setitem__", "__delitem__", "__contains__",
)


def sub_paths(modules: DataFrame) -> DataFrame:
    """sub_path, module: every dotted stretch of a module(module), told to the module; package files first, then the greatest name."""
    m = modules.select("module").distinct().withColumn("p", F.split("module", r"\."))
    ij = F.flatten(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.transform(F.sequence(i, F.size("p")), lambda j: F.array_join(F.slice("p", i, j - i + 1), "."))))
    x = m.select(F.explode(ij).alias("sub_path"), "module")
    best = F.max_by("module", F.struct(F.col("module").endswith("__init__"), "module"))
    return x.groupBy("sub_path").agg(best.alias("module"))


def relative_module(text: Column, module: Column) -> Column:
    """The absolute module of ``.name``: n dots drop n segments of the importing file's module; null above the root."""
    dots = F.length(F.regexp_extract(text, r"^\.*", 0))
    name = F.substring(text, dots + 1, F.length(text))
    parts = F.split(module, r"\.")
    up = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0)))
    return F.when(dots <= F.size(parts), F.concat_ws(".", F.when(F.size(up) > 0, F.array_join(up, ".")), F.when(name != "", name)))


EXPORT_LINE = r"from\s+\.(\w+)\s+import\s+\(?([^()]+?)\)?\s*(?:\n|$)"


def package_exports(files: DataFrame) -> DataFrame:
    """export_key, real_path of re-exports in files(path, content) named __init__.py: ``from .x import a as b`` makes pkg.b lead to pkg.x.a."""
    f = files.where(F.col("path").rlike(r"(^|/)__init__\.py$"))
    package = F.regexp_replace(F.regexp_replace("path", r"/?__init__\.py$", ""), "/", ".")
    clean = F.regexp_replace("content", r"#[^\n]*", "")
    # An import list in brackets goes over lines: fold it into one first.
    folded = F.regexp_replace(clean, r",\s*\n\s*", ", ")
    folded = F.regexp_replace(folded, r"\(\s*\n\s*", "(")
    hits = F.zip_with(F.regexp_extract_all(folded, F.lit(EXPORT_LINE), F.lit(1)), F.regexp_extract_all(folded, F.lit(EXPORT_LINE), F.lit(2)), lambda m, n: F.struct(m.alias("m"), n.alias("n")))
    x = f.select(package.alias("package"), F.explode(hits).alias("h")).select("package", "h.m", F.explode(F.split("h.n", ",")).alias("item"))
    words = F.split(F.trim("item"), r"\s+as\s+")
    x = x.select("package", "m", F.trim(words[0]).alias("name"), F.trim(F.element_at(words, -1)).alias("alias"))
    x = x.where(F.col("name").rlike(r"^[A-Za-z_]\w*$") & F.col("alias").rlike(r"^[A-Za-z_]\w*$"))
    return x.select(F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), "alias").alias("export_key"), F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), "m", "name").alias("real_path")).distinct()


def through_exports(paths: DataFrame, exports: DataFrame, key: str = "id") -> DataFrame:
    """key, target of paths(key, path): the longest export that begins the path (two segments at least) is replaced by what it stands for."""
    norm = F.replace(F.replace("path", F.lit(".__init__."), F.lit(".")), F.lit(".__init__"), F.lit(""))
    p = paths.select(key, "path", norm.alias("norm"), F.split(norm, r"\.").alias("p"))
    tries = p.select(key, "norm", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("p"), F.lit(2))), lambda n: F.array_join(F.slice("p", F.lit(1), n), "."))).alias("export_key"))
    found = tries.join(exports, "export_key").groupBy(key).agg(F.max_by(F.concat("real_path", F.substring("norm", F.length("export_key") + 1, F.length("norm"))), F.length("export_key")).alias("target"))
    return p.join(found, key, "left").select(key, F.coalesce("target", "path").alias("target"))


def methods_in_mro(mro: DataFrame, owned: DataFrame) -> DataFrame:
    """class, method, ancestor: of mro(class, pos, ancestor) the first ancestor that owns(class, method) each method."""
    o = owned.select(F.col("class").alias("ancestor"), "method")
    return mro.join(o, "ancestor").groupBy("class", "method").agg(F.min_by("ancestor", "pos").alias("ancestor"))


def unique_names(functions: DataFrame) -> DataFrame:
    """name, id of functions(id, name) whose name only one has and that isn't too common."""
    return functions.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where((F.col("n") == 1) & ~F.col("name").isin(*COMMON_METHODS)).select("name", "id")


def decorator_edges(functions: DataFrame) -> DataFrame:
    """id, caller, callee of functions(id, decorators): each decorator calls the next inner one, the innermost the function."""
    d = functions.select("id", F.posexplode("decorators").alias("i", "text"))
    name = F.trim(F.substring_index(F.regexp_replace("text", "^@", ""), "(", 1))
    d = d.select("id", "i", name.alias("caller")).where(~F.element_at(F.split("caller", r"\."), -1).isin(*BUILTIN_DECORATORS))
    return d.select("id", "caller", F.coalesce(F.lead("caller").over(Window.partitionBy("id").orderBy("i")), F.col("id").cast("string")).alias("callee"))
