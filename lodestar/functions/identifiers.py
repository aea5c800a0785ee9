"""Identifiers, paths and search texts as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of test code, by path and by id; the two id patterns differ in one branch.
TEST_PATH = r"(?i)(^|/)tests?/|(^|/)test_[^/]+/|/test_[^/]*\.py$|_test\.py$|(^|/)conftest\.py$"
TEST_ID_SEARCH = r"(?i)^test_|\.test_|\.Test[A-Z]"
TEST_ID_GRAPH = r"(?i)^test\.|\.test_|\.Test[A-Z]|^test_"


def is_test(path: Column, ident: Column, graph: bool = False) -> Column:
    """Whether a function is test code, as search (default) or as the graph sees it."""
    return path.rlike(TEST_PATH) | ident.rlike(TEST_ID_GRAPH if graph else TEST_ID_SEARCH)


def words_of(name: Column) -> Column:
    """Words of an identifier: cut at underscores, between letters and digits and at camel case; case stays."""
    s = F.regexp_replace(name, "([a-zA-Z])([0-9])", "$1 $2")
    s = F.regexp_replace(s, "([0-9])([a-zA-Z])", "$1 $2")
    s = F.regexp_replace(F.translate(s, "_", " "), "([A-Z]+)", " $1")
    s = F.regexp_replace(s, "([A-Z][a-z]+)", " $1")
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def spaced(name: Column) -> Column:
    return F.array_join(words_of(name), " ")


def corpus_tokens(text: Column) -> Column:
    """Lower case, cut at white space, punctuation kept."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def query_tokens(query: Column) -> Column:
    """Distinct lower-case tokens of a query in order: of each word its joined form, if it has underscores, then its parts."""
    raw = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    parts = F.transform(raw, lambda w: F.concat(F.when(F.contains(w, F.lit("_")), F.array(F.translate(w, "_", ""))).otherwise(F.array().cast("array<string>")), words_of(w)))
    return F.array_distinct(F.transform(F.flatten(parts), F.lower))


def module_of(path: Column) -> Column:
    """Dotted module id of a path: every .py goes, slashes become dots."""
    return F.replace(F.replace(path, F.lit("/"), F.lit(".")), F.lit(".py"), F.lit(""))


def function_id(path: Column, cls: Column, nested: Column, name: Column) -> Column:
    return F.concat_ws(".", module_of(path), cls, nested, name)


def _unquoted(doc: Column) -> Column:
    return F.replace(F.replace(F.trim(doc), F.lit('"""'), F.lit("")), F.lit("'''"), F.lit(""))


def search_text(name: Column, cls: Column, path: Column, parameters: Column, returns: Column, doc: Column, class_doc: Column, module_doc: Column) -> Column:
    """Keywords (name and class twice, path, parameters, return type once), a line break, then the docs.

    parameters: array of structs with name and type; every argument but name and path may be null.
    """
    twice = lambda c: F.concat(F.array_repeat(F.translate(c, "_", ""), 2), words_of(c), words_of(c))
    some = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    parts = F.filter(F.split(F.replace(path, F.lit(".py"), F.lit("")), "/"), lambda p: p != "")
    params = F.flatten(F.transform(parameters, lambda p: F.concat(some(words_of(p["name"])), some(words_of(p["type"])))))
    words = F.concat(twice(name), some(F.when(cls != "", twice(cls))), parts, some(params), some(words_of(returns)))
    docs = F.concat_ws(" ", *(F.when(d != "", _unquoted(d)) for d in (class_doc, doc, module_doc)))
    return F.concat(F.array_join(words, " "), F.lit("\n"), docs)


def embed_text(path: Column, cls: Column, code: Column, class_doc: Column, module_doc: Column) -> Column:
    """A function as Python text for an embedder: path and module doc, an empty line, then the code, inside its class if it has one."""
    quoted = lambda d, pad="": F.when(d != "", F.concat(F.lit(pad + '"""'), d, F.lit('"""')))
    inside = F.array_join(F.transform(F.split(code, "\n"), lambda l: F.when(F.trim(l) == "", F.lit("")).otherwise(F.concat(F.lit("    "), l))), "\n")
    body = F.when(cls != "", F.concat_ws("\n", F.concat(F.lit("class "), cls, F.lit(":")), quoted(class_doc, "    "), inside)).otherwise(code)
    return F.concat_ws("\n", F.concat(F.lit("# "), path), quoted(module_doc), F.lit(""), body)


def rerank_text(name: Column, cls: Column, path: Column, parameters: Column, returns: Column, code: Column, doc: Column, class_doc: Column, module_doc: Column) -> Column:
    """A function for a reranker: path, docs, signature in plain words, and the first doc line or, without doc, the code."""
    quoted = lambda d, pad="": F.when(d != "", F.concat(F.lit(pad + '"""'), d, F.lit('"""')))
    one = lambda p: F.concat(F.coalesce(spaced(p["name"]), F.lit("")), F.coalesce(F.concat(F.lit(": "), spaced(p["type"])), F.lit("")))
    params = F.array_join(F.filter(F.transform(F.coalesce(parameters, F.array().cast("array<struct<name:string,type:string,value:string>>")), one), lambda s: s != ""), ", ")
    head = F.concat(F.lit("def "), spaced(name), F.lit("("), params, F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), spaced(returns)), F.lit("")), F.lit(":"))
    last = F.when(doc != "", F.concat(F.lit('    """'), F.trim(F.split(F.trim(doc), "\n")[0]), F.lit('"""'))).otherwise(code)
    shown = F.when(cls != "", F.concat(F.lit("class "), spaced(cls), F.lit(":")))
    return F.concat_ws("\n", F.concat(F.lit("# "), path), quoted(module_doc), shown, F.when(cls != "", quoted(class_doc, "    ")), head, last)


def lookup_parts(name: Column) -> Column:
    """(name, class): the last two dotted parts."""
    p = F.split(F.trim(name), r"\.")
    return F.struct(F.element_at(p, -1).alias("name"), F.when(F.size(p) > 1, F.try_element_at(p, F.lit(-2))).alias("class"))


def superclass_name(text: Column) -> Column:
    return F.trim(F.substring_index(text, "[", 1))


# Types that name no class of a program, and wrappers that hold more than one.
PRIMITIVES = ("int", "str", "float", "bool", "bytes", "None", "Any", "object")
SKIPPED_WRAPPERS = ("Dict", "Mapping", "MutableMapping", "DefaultDict", "OrderedDict", "Tuple", "Set", "FrozenSet")


def top_level_parts(inner: str) -> list[str]:
    """Cut at the commas outside all brackets."""
    parts, depth, last = [], 0, 0
    for at, c in enumerate(inner):
        depth += (c == "[") - (c == "]")
        if c == "," and depth == 0:
            parts.append(inner[last:at].strip())
            last = at + 1
    return [*parts, inner[last:].strip()] if inner[last:] else parts


def inner_class(annotation: str | None) -> str | None:
    """The one class that a type annotation is about, unwrapped from its generics; None if it is about none or several."""
    text = (annotation or "").strip()
    while True:
        if "[" not in text:
            return text if text[:1].isupper() and text not in PRIMITIVES else None
        wrapper, _, rest = text.partition("[")
        wrapper = wrapper.strip()
        if not rest.endswith("]") or wrapper in SKIPPED_WRAPPERS:
            return None
        parts = top_level_parts(rest[:-1].strip())
        if wrapper == "Generator" and parts or len(parts) == 1:
            text = parts[0]
        elif wrapper in ("Union", "Optional") and len(parts) == 2 and "None" in parts:
            text = parts[1] if parts[0] == "None" else parts[0]
        else:
            return None


def _inner_classes(annotations: pd.Series) -> pd.Series:
    return annotations.map(inner_class, na_action="ignore")


def inner_class_of(annotation: Column) -> Column:
    """inner_class as a column. Brackets nest to any depth, which expressions can't follow: an Arrow function."""
    return F.pandas_udf(_inner_classes, "string")(annotation)
