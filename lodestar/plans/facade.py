"""What a user calls: index a tree, then overview, search, expand, lookup and stats over its tables."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as names
from ..operators import embedding, graph, incremental, parse, render, resolve, symbols
from ..operators.lineage import cut
from ..sources import pyrepo
from ..streaming.changes import Snapshots, apply_batch, follow
from .search import Settings, search


class Index:
    """The tables of one repository in a folder: its parsed files, and functions, classes and vectors derived from them.

    Both are snapshots behind a pointer: a search reads one whole version while the next is written.
    """

    def __init__(self, spark: SparkSession, root: str, embedder=embedding.HashEmbedder(), limit: embedding.RateLimit | None = None) -> None:
        self.spark, self.root, self.embedder, self.limit = spark, root.rstrip("/"), embedder, limit
        self.sources, self.tables = Snapshots(spark, f"{self.root}/sources"), Snapshots(spark, f"{self.root}/tables")

    def table(self, name: str) -> DataFrame:
        """functions, classes or vectors of the newest version."""
        return self.spark.read.parquet(f"{self.tables.current()['path']}/{name}")

    def build(self, repository: str) -> Index:
        """Brings the index to the state of the tree: from nothing, or by what differs from the hashes on record."""
        pyrepo.register(self.spark)
        found = cut(self.spark.read.format("pyrepo").load(repository))
        changes = found
        if (known := self.sources.read()) is not None:
            differ = incremental.diff(known.select("path", "hash"), found.select("path", "hash")).where("change <> 'same'")
            null = F.lit(None).cast("string")
            gone = differ.where("change = 'deleted'").select("path", null.alias("content"), null.alias("hash"), F.lit("deleted").alias("error"))
            changes = found.join(differ.where("change <> 'deleted'"), "path", "left_semi").unionByName(gone)
        self.apply(changes, 0, uuid.uuid4().hex)
        return self

    def watch(self, repository: str, checkpoint: str, interval: str = "3 seconds", once: bool = False):
        """Starts the stream that keeps the index at the state of the tree; once: what has changed by now, then stop."""
        return follow(self.spark, repository, self.sources, checkpoint, interval, once, lambda df, batch: self.apply(df, batch, checkpoint))

    def apply(self, changes: DataFrame, batch: int, stream: str) -> None:
        """Parses a micro-batch of changed files and derives the tables anew; one that comes again resumes where it failed."""
        apply_batch(self.sources, changes, batch, stream)
        now, done = self.sources.current(), self.tables.current()
        if now and (not done or (done["batch"], done["stream"]) != (now["batch"], now["stream"])):
            self._derive(now["batch"], now["stream"])

    def _derive(self, batch: int, stream: str) -> None:
        """Resolves, describes and embeds the parsed files: calls may lead to any file, so all are resolved; only texts that are new are embedded."""
        rows = self.sources.read()
        sub = symbols.sub_paths(rows.select(names.module_of(F.col("path")).alias("module")))
        functions, classes = parse.functions_of(rows), parse.classes_of(rows)
        imports = parse.known_imports(parse.imports_of(rows), sub)
        done = resolve.resolved(functions, classes, imports, symbols.package_exports(rows.select("path", "content")))
        c = {k: F.col(k) for k in ("name", "class_name", "file_path", "parameters", "return_type", "docstring", "class_docstring", "module_docstring", "code")}
        done = done.withColumn("text", names.search_text(c["name"], c["class_name"], c["file_path"], c["parameters"], c["return_type"], c["docstring"], c["class_docstring"], c["module_docstring"]))
        done = done.withColumn("document", names.rerank_text(c["name"], c["class_name"], c["file_path"], c["parameters"], c["return_type"], c["code"], c["docstring"], c["class_docstring"], c["module_docstring"]))
        done = done.withColumn("embed_text", names.embed_text(c["file_path"], c["class_name"], c["code"], c["class_docstring"], c["module_docstring"]))
        path = self.tables.begin(batch)
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
        write(done, "functions")
        write(classes, "classes")
        wanted = self.spark.read.parquet(f"{path}/functions").select("id", F.col("embed_text").alias("text")).dropDuplicates(["id"]).withColumn("text_hash", F.sha2("text", 256))
        hashes = wanted.select("id", "text_hash")
        old = self.table("vectors").join(hashes, ["id", "text_hash"], "left_semi").select("id", "embedding", "text_hash") if self.tables.current() else None
        new = wanted if old is None else wanted.join(old, ["id", "text_hash"], "left_anti")
        made = embedding.embedded(new, self.embedder, limit=self.limit).join(hashes, "id")
        write(made if old is None else made.unionByName(old), "vectors")
        self.tables.finish(path, batch, stream)

    def functions(self) -> DataFrame:
        """One row an id (the last in file and line order): duplicates of an id are overloads and properties."""
        f = self.table("functions")
        last = f.groupBy("id").agg(F.max(F.struct("file_path", "start_line")).alias("l")).select("id", F.col("l.file_path").alias("file_path"), F.col("l.start_line").alias("start_line"))
        return f.join(last, ["id", "file_path", "start_line"]).dropDuplicates(["id"])

    def calls(self) -> DataFrame:
        return graph.calls_of(self.functions().select("id", "calls"))

    def nodes(self) -> DataFrame:
        return self.functions().select("id", F.col("file_path").alias("file"), F.col("class_name").alias("class"), names.is_test(F.col("file_path"), F.col("id"), True).alias("test"), F.col("file_path").alias("path"), F.col("start_line").alias("line"))

    def search(self, query: str, exclude_tests: bool = True, s: Settings | None = None) -> DataFrame:
        f = self.functions()
        rows = f.select("id", "text", "document", F.col("file_path").alias("file"), F.col("class_name").alias("class"), names.is_test(F.col("file_path"), F.col("id")).alias("test"))
        vector = [float(x) for x in self.embedder([query])[0]]
        return search(rows, self.table("vectors").dropDuplicates(["id"]), self.calls(), query, vector, s=s or Settings(exclude_tests=exclude_tests))

    def search_tree(self, query: str, full: bool = False, exclude_tests: bool = True) -> str:
        """The result as a tree; the result is kept for expand()."""
        found = self.search(query, exclude_tests).groupBy("id").agg(F.max("similarity").alias("similarity"), F.min("is_bridge").alias("is_bridge"))
        self.spark.createDataFrame(found.collect(), found.schema).coalesce(1).write.mode("overwrite").json(f"{self.root}/last_result")
        results = self.last_result().join(self.nodes().select("id", "path", "line"), "id")
        calls = graph.within(results, self.calls())
        return (render.full_text if full else render.shallow_text)(results, calls)

    def last_result(self) -> DataFrame:
        """The last search's rows; none before the first."""
        schema = "id string, similarity double, is_bridge boolean"
        if not self._exists(f"{self.root}/last_result"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/last_result")

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def expand(self, function: str, inside_result: bool = False) -> DataFrame:
        """Callees of one function, in call order; of the last result only, if asked."""
        calls = self.calls()
        return render.callees(function, self.nodes(), graph.within(self.last_result(), calls) if inside_result else calls)

    def lookup(self, wanted: list[str], path: str | None = None, limit: int = 50) -> DataFrame:
        f = self.functions()
        return render.lookup(f.select(*f.columns, F.col("class_name").alias("class"), F.col("file_path").alias("path")), wanted, path, limit).drop("class", "path")

    def lookup_classes(self, wanted: list[str], limit: int = 20) -> DataFrame:
        last = [w.strip().split(".")[-1] for w in wanted]
        return self.table("classes").where(F.col("name").isin(last)).orderBy("file_path", "start_line").limit(limit)

    def stats(self) -> DataFrame:
        return render.stats(self.functions().select("id"), self.table("vectors"), self.calls())

    def overview(self) -> str:
        """Communities of the graph, each under its commonest file, with entry points; by file where there are none.

        Kept beside the tables it was told from, until the next version of them.
        """
        where = f"{self.tables.current()['path']}/overview"
        if not self._exists(where):
            self.spark.createDataFrame([(self._overview(),)], "text string").coalesce(1).write.mode("overwrite").parquet(where)
        return self.spark.read.parquet(where).first()["text"]

    def _overview(self) -> str:
        nodes = self.nodes().where(~F.col("test"))
        calls = graph.known_calls(self.calls(), nodes)
        labels = graph.communities(graph.weighted_edges(calls, nodes))
        named = graph.dominant_files(labels, nodes)
        by_file = labels.join(named, "community").select("id", F.col("file").alias("community"))
        if not by_file.limit(1).count():
            top = graph.modules(nodes)
            by_file = nodes.join(top.select("file"), "file").select("id", F.col("file").alias("community"))
        docs = self.table("functions").groupBy(F.col("file_path").alias("community")).agg(F.first("module_docstring", ignorenulls=True).alias("doc"))
        n = by_file.groupBy("community").agg(F.count(F.lit(1)).alias("n")).join(docs, "community", "left")
        entries = graph.module_entries(by_file, nodes, calls).join(self.functions().select("id", "name", "class_name"), "id")
        shown = entries.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(".", "class_name", "name").alias("label")))), lambda e: e["label"]).alias("labels"))
        lines = []
        for r in n.join(shown, "community", "left").orderBy(F.desc("n"), "community").collect():
            doc = (r["doc"] or "").strip().split("\n")[0]
            lines.append(f"{r['community']} ({r['n']} functions)" + (f": {doc}" if doc else ""))
            lines += [f"  - {x}" for x in r["labels"] or ()]
        return "\n".join(lines)

    def log(self, tool: str, params: dict, results: int, seconds: float) -> None:
        """Appends a line to the query log."""
        row = [(time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), tool, json.dumps(params), results, float(seconds))]
        self.spark.createDataFrame(row, "at string, tool string, params string, results long, seconds double").coalesce(1).write.mode("append").json(f"{self.root}/query_log")


