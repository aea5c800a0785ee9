"""Lookups, expansion and trees of results: the edge where a query's few rows become text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import lookup_parts
from . import graph


def lookup(functions: DataFrame, wanted: Sequence[str], path: str | None = None, limit: int = 50) -> DataFrame:
    """functions(name, class, path, file_path, start_line) by name, class.name, or part of their path; case plays no part in paths."""
    spark = functions.sparkSession
    found = F.lit(False)
    rows = spark.range(1).select(*(lookup_parts(F.lit(w)).alias(f"w{k}") for k, w in enumerate(wanted))).first() if wanted else ()
    for r in rows:
        found = found | ((F.col("name") == r["name"]) & (F.lit(True) if r["class"] is None else (F.col("class") == r["class"])))
    if path:
        found = found | F.contains(F.lower("path"), F.lit(path.lower()))
    return functions.where(found).orderBy("file_path", "start_line").limit(limit)


def callees(function, nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """What one function calls, in call order: pos, the node's columns, deeper (whether it calls anything)."""
    own = calls.where(F.col("src") == F.lit(function)).select("pos", F.col("dst").alias("id"))
    ids = own.select("id").distinct()
    deep = calls.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("deeper", F.lit(True))
    return own.join(nodes, "id").join(deep, "id", "left").withColumn("deeper", F.coalesce("deeper", F.lit(False))).orderBy("pos")


def stats(functions: DataFrame, embedded: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: functions, embedded, with_calls, coverage in percent (null without functions)."""
    e = embedded.select("id").distinct().withColumn("e", F.lit(True))
    c = calls.select(F.col("src").alias("id")).distinct().withColumn("c", F.lit(True))
    n = functions.select("id").join(e, "id", "left").join(c, "id", "left").agg(F.count(F.lit(1)).alias("functions"), F.count("e").alias("embedded"), F.count("c").alias("with_calls"))
    return n.withColumn("coverage", F.when(F.col("functions") > 0, F.round(100.0 * F.col("embedded") / F.col("functions"), 1)))


def roots(results: DataFrame, calls: DataFrame) -> DataFrame:
    """id, similarity, root: results that none of them calls, best first; if all are called, the best alone."""
    free = results.join(calls.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "similarity")
    best = results.orderBy(F.desc("similarity"), "id").limit(1).select("id", "similarity")
    out = free if free.limit(1).count() else best
    return out.withColumn("root", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))


def shallow_tree(results: DataFrame, calls: DataFrame) -> DataFrame:
    """root, pos, id, depth: roots and their direct callees, each placed once, under the first root."""
    top = roots(results, calls)
    kids = top.select(F.col("id").alias("src"), "root").join(calls, "src").join(top.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("root", "pos")).alias("at"))
    return top.select("root", F.lit(0).alias("pos"), "id", F.lit(0).alias("depth")).unionByName(kids.select("at.root", "at.pos", "id", F.lit(1).alias("depth")))


def label(ident, path: str, line: int, more: int) -> str:
    return f"{ident}  [{path}:{line}]" + (f"  (+{more} more)" if more else "")


def shallow_text(results: DataFrame, calls: DataFrame) -> str:
    """The shallow tree as text. results(id, similarity, path, line) are a query's hits."""
    rows = _placed(results, calls, shallow_tree(results, calls))
    return "\n".join(("    " if r["depth"] else "") + label(r["id"], r["path"], r["line"], 0 if not r["depth"] else r["descendants"]) for r in rows)


def _placed(results: DataFrame, calls: DataFrame, tree: DataFrame) -> list:
    more = graph.descendants(results, calls)
    return tree.join(results.select("id", "path", "line"), "id").join(more, "id").orderBy("root", "depth", "pos", "id").collect()


def full_text(results: DataFrame, calls: DataFrame) -> str:
    """The whole call tree with box-drawing lines, each node once. A query's hits: a hundred rows or so."""
    facts = {r["id"]: r for r in results.select("id", "path", "line").collect()}
    kids: dict = {}
    for r in calls.groupBy("src", "dst").agg(F.min("pos").alias("pos")).orderBy("src", "pos").collect():
        kids.setdefault(r["src"], []).append(r["dst"])
    lines: list[str] = []
    seen: set = set()
    for root in roots(results, calls).orderBy("root").collect():
        stack = [(root["id"], "", "")]
        while stack:
            node, lead, below = stack.pop()
            if node in seen or node not in facts:
                continue
            seen.add(node)
            lines.append(lead + label(node, facts[node]["path"], facts[node]["line"], 0))
            open_kids = [k for k in kids.get(node, ()) if k not in seen and k in facts]
            for n, k in reversed(list(enumerate(open_kids))):
                last = n == len(open_kids) - 1
                stack.append((k, below + ("└── " if last else "├── "), below + ("    " if last else "│   ")))
    return "\n".join(lines)
