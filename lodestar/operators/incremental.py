"""Differences of snapshots, change events and their effect on the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hashed(files: DataFrame) -> DataFrame:
    """path, hash of files(path, content)."""
    return files.select("path", F.sha2("content", 256).alias("hash"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, deleted, changed, same) between (path, hash) snapshots: one full outer equi-join."""
    o, n = old.select("path", F.col("hash").alias("h0"), F.lit(True).alias("o")), new.select("path", F.col("hash").alias("h1"), F.lit(True).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(~F.col("h0").eqNullSafe(F.col("h1")), "changed").otherwise("same")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def row_diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """key, change of function rows: inserted, deleted, changed (code), refreshed (anything else), same.

    Whole rows are compared, so lines and docs are refreshed even where the code stayed.
    """
    rest = [c for c in old.columns if c not in (key, "code")]
    side = lambda df, s: df.select(key, F.sha2(F.coalesce("code", F.lit("")), 256).alias(f"code_{s}"), F.sha2(F.to_json(F.struct(*rest)), 256).alias(f"rest_{s}"), F.lit(True).alias(s))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    change = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "deleted").when(F.col("code_o") != F.col("code_n"), "changed").when(F.col("rest_o") != F.col("rest_n"), "refreshed").otherwise("same")
    return both.select(key, change.alias("change"))


def debounced(events: DataFrame, gap: str) -> DataFrame:
    """started, path, change of events(ts, path, change): per burst (no gap that long inside) the last change of each path.

    Bursts are over all paths, as a flush is; they are found by hours with a look at their neighbours, so no task holds all
    events: an event starts a burst if none lies less than a gap before it, and belongs to the last start at or before it.
    """
    step = F.expr(f"INTERVAL {gap}")
    e = events.select("ts", "path", "change")
    hour = F.window("ts", "1 hour").getField("start")
    e = e.withColumn("hour", hour)
    # The last event before each hour, from hourly maxima: one row an hour.
    hours = e.groupBy("hour").agg(F.max("ts").alias("last"))
    w = Window.orderBy("hour")
    hours = hours.select("hour", F.lag("last").over(w).alias("before"))
    inner = Window.partitionBy("hour").orderBy("ts")
    e = e.join(hours, "hour").withColumn("prev", F.coalesce(F.lag("ts").over(inner), "before"))
    e = e.withColumn("start", F.when(F.col("prev").isNull() | (F.col("ts") >= F.col("prev") + step), F.col("ts")))
    carried = e.groupBy("hour").agg(F.max("start").alias("s")).select("hour", F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    e = e.join(carried, "hour").withColumn("started", F.coalesce(F.max("start").over(inner.rowsBetween(Window.unboundedPreceding, 0)), "carry"))
    return e.groupBy("started", "path").agg(F.max_by("change", "ts").alias("change"))


def without_calls_to(calls: DataFrame, gone: DataFrame) -> DataFrame:
    """calls less those to gone(id)."""
    return calls.join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "pos", "dst")


def catch_up(known: DataFrame, found: DataFrame) -> DataFrame:
    """path, change of files that differ from the hashes on record; with no record at all nothing is to be done but to record."""
    return diff(known, found).where("change <> 'same'") if known.limit(1).count() else diff(known, found).limit(0)


def apply_changes(functions: DataFrame, changed: DataFrame, changes: DataFrame) -> DataFrame:
    """functions(path, ...) with the rows of every changed or deleted path replaced by those parsed anew."""
    touched = changes.select("path").distinct()
    return functions.join(touched, "path", "left_anti").unionByName(changed)
