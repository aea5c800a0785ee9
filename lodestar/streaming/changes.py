"""Keeping the index current from a stream of changes.

Every micro-batch is applied as a difference against the last snapshot and written as a new one; a pointer file names
the snapshot that readers use, so they never wait for a writer and never see half a batch.  Batches carry their number,
and one that comes again after a failure changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental
from ..operators.parse import parsed


class Snapshots:
    """Versioned tables under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> dict | None:
        """What the newest pointer says: version, batch, path; None before the first."""
        where = self._path(f"{self.root}/pointers")
        if not self._fs.exists(where):
            return None
        names = sorted((s.getPath().getName() for s in self._fs.listStatus(where)), key=lambda n: int(n.split(".")[0]) if n.split(".")[0].isdigit() else -1)
        if not names or not names[-1].split(".")[0].isdigit():
            return None
        return json.loads(self.spark.read.text(f"{self.root}/pointers/{names[-1]}", wholetext=True).first()[0])

    def read(self) -> DataFrame | None:
        now = self.current()
        return self.spark.read.parquet(now["path"]) if now else None

    def write(self, df: DataFrame, batch: int, stream: str = "") -> None:
        """One table as the next snapshot."""
        path = self.begin(batch)
        df.write.mode("overwrite").parquet(path)
        self.finish(path, batch, stream)

    def begin(self, batch: int) -> str:
        """The folder of the next snapshot; nobody reads it before finish()."""
        now = self.current()
        return f"{self.root}/v{now['version'] + 1 if now else 0}-{batch}"

    def finish(self, path: str, batch: int, stream: str = "") -> None:
        """Points readers at a folder that is written, and removes the one before the last: a reader has one version's time."""
        now = self.current()
        version = (now["version"] + 1) if now else 0
        text = json.dumps({"version": version, "batch": batch, "stream": stream, "path": path, "before": now["path"] if now else None})
        # Written aside, then renamed: a pointer is there as a whole or not at all.
        aside, final = self._path(f"{self.root}/_aside-{version}-{batch}"), self._path(f"{self.root}/pointers/{version}.json")
        self._fs.mkdirs(self._path(f"{self.root}/pointers"))
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.rename(aside, final)
        if now and now.get("before") and now["before"] not in (path, now["path"]):
            self._fs.delete(self._path(now["before"]), True)


def apply_batch(snapshots: Snapshots, changes: DataFrame, batch: int, stream: str = "") -> int:
    """Applies files(path, content, hash, error) of a micro-batch; gives how many paths changed.

    The last row of a path counts, by partition and place in it. A file that cannot be read keeps its old rows; one whose
    hash is known is skipped. Batches are numbered within their stream. Of package files the content is kept, since their
    re-exports are read from it.
    """
    now = snapshots.current()
    if now and now.get("stream", "") == stream and now["batch"] >= batch:
        return 0
    old = snapshots.read()
    said = changes.where("error IS NULL OR error = 'deleted'").withColumn("_at", F.monotonically_increasing_id())
    last = said.groupBy("path").agg(F.max_by(F.struct("content", "hash", "error"), "_at").alias("r")).select("path", "r.*").persist()
    gone = last.where("error = 'deleted'").select("path")
    new = last.where("error IS NULL")
    if old is not None:
        new = new.join(old.select("path", "hash").distinct(), ["path", "hash"], "left_anti")
    package = F.when(F.col("path").rlike(r"(^|/)__init__\.py$"), F.col("content")).alias("content")
    rows = parsed(new).join(new.select("path", "hash", package), "path")
    n = new.count() + gone.count()
    if old is None:
        out = rows
    else:
        out = incremental.apply_changes(old, rows.select(*old.columns), new.select("path").unionByName(gone))
    if n or old is None:
        snapshots.write(out, batch, stream)
    last.unpersist()
    return n


def follow(spark: SparkSession, repository: str, snapshots: Snapshots, checkpoint: str, interval: str = "1 second", once: bool = False, apply: Callable[[DataFrame, int], object] | None = None):
    """Starts the stream of a repository's changes into snapshots (or into apply); once: what has changed by now, then stop.

    All changes between two triggers are one micro-batch: a burst shorter than the interval is applied once or twice.
    """
    from ..sources import pyrepo

    pyrepo.register(spark)
    each = apply or (lambda df, batch: apply_batch(snapshots, df, batch))
    stream = spark.readStream.format("pyrepo").load(repository)
    writer = stream.writeStream.foreachBatch(lambda df, batch: each(df, batch) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def debounced_stream(events: DataFrame, gap: str, late: str = "10 seconds") -> DataFrame:
    """Streaming bursts of events(repository, path, change, ts): the last change of a path once no event came for a gap.

    A session is told when the watermark passes it.
    """
    e = events.withWatermark("ts", late)
    return e.groupBy("repository", "path", F.session_window("ts", gap)).agg(F.max_by("change", "ts").alias("change"), F.max("ts").alias("ts"))
