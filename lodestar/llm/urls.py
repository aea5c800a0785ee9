"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame and SQL expressions, the training too: the small labelled table becomes one row of feature
arrays and stochastic gradient steps are folded over it by ``aggregate``; the weights (``dims`` doubles) then are a
literal of the scoring expression.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule, and is judged by the model on
its n-grams, of which it has none, so by the bias; long urls take time in proportion to their length; equal urls get
equal results, repeated rows one each; a score equal to the threshold blocks; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the query, (host/path, verdict).
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)

#: Words of hosts and paths for the labelled table, unwanted and wanted.
UNWANTED = ("spam", "spam-farm", "cheap-pills", "pills", "free-bets", "bets", "casino", "adult", "adult-x", "xxx", "porn", "ads", "ads-track", "tracker", "win-cash", "payday-loan", "replica-watch", "viagra", "poker", "slots", "click-bait", "malware", "warez", "torrent-hub")
WANTED = ("news", "docs", "library", "university", "museum", "weather", "garden", "history", "science", "recipes", "travel", "music", "city", "school", "journal", "forum", "health", "sports", "market", "theatre", "archive", "maps", "wiki", "press", "reading", "nation", "thread", "another", "station", "motion")


@dataclass(frozen=True)
class Model:
    """dims: hashed n-gram buckets; sizes: n-gram lengths; threshold: block from this probability on."""

    dims: int = 1024
    sizes: tuple[int, ...] = (3, 4, 5)
    epochs: int = 12
    rate: float = 0.5
    threshold: float = 0.5


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, y. Built from the words by one rule, as many of either label as words."""
    shapes = ("http://www.{w}.example.com/en/1", "https://{w}.example.net/a", "http://blog.{w}.org/de/20", "https://m.{w}-site.com/fr/3.html")
    rows = [f"('{s.format(w=w)}', {y}D)" for y, words in ((1, UNWANTED), (0, WANTED)) for w in words for s in shapes]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(url, y)")


def host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    found = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]], what: int) -> Column:
    """The longest rule that fits (what=0), or its verdict (what=1); null if none does. For short lists: one test a rule."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tested first, being outermost
        h, _, p = rule[0].partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        found = F.when(fits, F.lit(rule[what])).otherwise(found)
    return found


def grams(chars: Column, sizes: Sequence[int], dims: int) -> Column:
    """Bucket numbers (from 1) of the n-grams of an array of characters."""
    def of(n: int) -> Column:
        whole = F.transform(chars, lambda c, i: F.concat(c, *(F.get(chars, i + k) for k in range(1, n))))
        return F.transform(F.filter(whole, lambda g: g.isNotNull()), lambda g: (F.pmod(F.xxhash64(g), F.lit(dims)) + 1).cast("int"))

    return F.concat(*(of(n) for n in sizes))


def _features(df: DataFrame, model: Model) -> DataFrame:
    """Adds grams; every digit counts as 0. The host's ends are marked."""
    text = F.translate(F.concat(F.lit("^"), F.col("host"), F.lit("$"), F.col("path")), "123456789", "000000000")
    chars = F.when((F.col("host") == "") & (F.col("path") == ""), F.array().cast("array<string>")).otherwise(F.filter(F.split(text, ""), lambda c: c != ""))
    return df.withColumn("_chars", chars).withColumn("_grams", grams(F.col("_chars"), model.sizes, model.dims)).drop("_chars")


def train(spark: SparkSession, model: Model = Model(), table: DataFrame | None = None) -> list[float]:
    """Weights: the bias, then one for each bucket; an unset table is the labelled one above."""
    t = (labelled(spark) if table is None else table).select("url", F.col("y").cast("double").alias("y"))
    t = _features(t.select("y", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), model)
    d = model.dims
    counted = F.expr(
        f"""map_from_entries(transform(array_distinct(_grams), g -> struct(g, size(filter(_grams, x -> x = g)) / sqrt(size(_grams)))))"""
    )
    x = F.expr(f"transform(sequence(0, {d}), i -> CASE WHEN i = 0 THEN 1D ELSE coalesce(_m[i], 0D) END)")
    rows = t.withColumn("_m", counted).select(F.xxhash64("url").alias("o"), "url", "y", x.alias("x"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("o", "url", "y", "x"))).alias("data"))
    step = f"""aggregate(sequence(1, {model.epochs}), array_repeat(0D, {d + 1}), (w, e) -> aggregate(data, w, (v, r) ->
        element_at(transform(array({model.rate}D * (r.y - 1D / (1D + exp(-aggregate(zip_with(v, r.x, (c, q) -> c * q), 0D, (s, z) -> s + z))))),
            g -> zip_with(v, r.x, (a, b) -> a + g * b)), 1)))"""
    return [float(v) for v in one.select(F.expr(step).alias("w")).first()["w"]]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, model: Model = Model(), weights: list[float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability of block)."""
    weights = weights or train(pages.sparkSession, model)
    w = F.expr(f"array({', '.join(repr(v) + 'D' for v in weights[1:])})")
    url = F.col("url").cast("string")
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    p = _features(p, model)
    total = F.aggregate(F.col("_grams"), F.lit(0.0), lambda s, g: s + F.element_at(w, g))
    z = F.lit(weights[0]) + total / F.sqrt(F.greatest(F.size("_grams"), F.lit(1)))
    p = p.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, 0))
    verdict = F.coalesce(rule_of(F.col("host"), F.col("path"), rules, 1), F.when(F.col("score") >= model.threshold, "block").otherwise("allow"))
    return p.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
