"""python -m lodestar setup|watch|search|search-tree|expand|lookup|overview|stats INDEX ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.facade import Index


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    p.add_argument("command", choices=["setup", "watch", "search", "search-tree", "expand", "lookup", "overview", "stats"])
    p.add_argument("index", help="folder of the index tables")
    p.add_argument("words", nargs="*", help="repository, query, id or names")
    p.add_argument("--path", help="part of a path, for lookup")
    p.add_argument("--tests", action="store_true", help="search test code, too")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    index, words = Index(spark, a.index), " ".join(a.words)
    if a.command == "setup":
        index.build(a.words[0]).stats().show(truncate=False)
    elif a.command == "watch":
        index.build(a.words[0]).watch(a.words[0], f"{index.root}/watch").awaitTermination()
    elif a.command in ("search", "search-tree"):
        print(index.search_tree(words, a.command == "search-tree", not a.tests))
    elif a.command == "expand":
        index.expand(words).show(50, truncate=False)
    elif a.command == "lookup":
        index.lookup(a.words, a.path).select("id", "file_path", "start_line").show(50, truncate=False)
    elif a.command == "overview":
        print(index.overview())
    else:
        index.stats().show(truncate=False)


if __name__ == "__main__":
    main()
