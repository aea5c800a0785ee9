"""The call graph as DataFrames, and what is asked of it.

nodes(id, file, class, ...), calls(src, pos, dst): each call with its place in the caller, repeated calls included.
Loops run over frontiers, cut their lineage each round and end when nothing is new; what they carry is as large as
their result.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import edge_weight
from .lineage import cut


def known_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls between nodes; dangling ones drop out."""
    ids = nodes.select("id")
    return calls.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "pos", "dst")


def calls_of(functions: DataFrame) -> DataFrame:
    """functions(id, calls array<string>) to calls."""
    return functions.select(F.col("id").alias("src"), F.posexplode("calls").alias("pos", "dst"))


def in_degrees(calls: DataFrame) -> DataFrame:
    """id, in_degree: call occurrences, repeats counted."""
    return calls.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def weighted_edges(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, weight: one row a pair of caller and callee."""
    degree = in_degrees(calls)
    one = calls.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    place = nodes.select("id", "file", "class")
    a = place.select(F.col("id").alias("src"), F.col("file").alias("f1"), F.col("class").alias("c1"))
    b = place.join(degree, "id").select(F.col("id").alias("dst"), F.col("file").alias("f2"), F.col("class").alias("c2"), "in_degree")
    same_class = F.col("c1").eqNullSafe(F.col("c2")) & F.col("c1").isNotNull()
    return one.join(b, "dst").join(a, "src").select("src", "dst", "pos", edge_weight(F.col("in_degree"), F.col("f1") == F.col("f2"), same_class).alias("weight"))


def callers(calls: DataFrame) -> DataFrame:
    """id, n_callers, callers: distinct callers of each callee, in order; hubs are long, so it is meant for chosen ids."""
    return calls.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n_callers"), F.array_sort(F.collect_set("src")).alias("callers"))


def expand(seeds: DataFrame, calls: DataFrame, nodes: DataFrame, is_test=None) -> DataFrame:
    """Neighbours of seeds(id): hop 1 both ways, hop 2 from those of hop 1 in a seed's file: id, hop.

    Test code (a column of nodes) never enters.
    """
    good = nodes.where(~is_test) if is_test is not None else nodes
    around = calls.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(calls.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    hop1 = around.join(seeds.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
    hop1 = cut(hop1.join(seeds, "id", "left_anti").join(good.select("id", "file"), "id"))
    files = nodes.join(seeds, "id", "left_semi").select("file").distinct()
    close = hop1.join(files, "file", "left_semi").select(F.col("id").alias("a"))
    hop2 = around.join(close, "a", "left_semi").select(F.col("b").alias("id")).distinct()
    hop2 = hop2.join(seeds, "id", "left_anti").join(hop1, "id", "left_anti").join(good.select("id"), "id", "left_semi")
    return hop1.select("id", F.lit(1).alias("hop")).unionByName(hop2.select("id", F.lit(2).alias("hop")))


def reachable(starts: DataFrame, calls: DataFrame) -> DataFrame:
    """start, id: everything each start(id) reaches, itself included."""
    edges = calls.select(F.col("src").alias("id"), "dst").distinct()
    found = cut(starts.select(F.col("id").alias("start"), "id").distinct())
    frontier = found
    while frontier.limit(1).count():
        step = frontier.join(edges, "id").select("start", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(found, ["start", "id"], "left_anti"))
        found = cut(found.unionByName(frontier))
    return found


def descendants(ids: DataFrame, calls: DataFrame) -> DataFrame:
    """id, descendants: how many others each of ids reaches; one on a cycle counts itself."""
    edges = calls.select(F.col("src").alias("id"), "dst").distinct()
    first = ids.select("id").join(edges, "id").select(F.col("id").alias("start"), F.col("dst").alias("id")).distinct()
    found = cut(first)
    frontier = found
    while frontier.limit(1).count():
        step = frontier.join(edges, "id").select("start", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(found, ["start", "id"], "left_anti"))
        found = cut(found.unionByName(frontier))
    n = found.groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("descendants"))
    return ids.select("id").join(n, "id", "left").select("id", F.coalesce("descendants", F.lit(0)).alias("descendants"))


def entry_points(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """id, out_degree of the nodes that nothing calls."""
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("out_degree"))
    return nodes.select("id").join(calls.select(F.col("dst").alias("id")), "id", "left_anti").join(out, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def within(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls among results(id) only."""
    ids = results.select("id")
    return calls.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "pos", "dst")


def preorder(entries: DataFrame, calls: DataFrame) -> DataFrame:
    """entry, pos, id: depth-first pre-order from each entry in call order, of an acyclic graph.

    A node is first met on the least path of call places that leads to it, so the order is that of the least paths,
    which settle by relaxation.
    """
    edges = calls.groupBy("src", "dst").agg(F.min("pos").cast("long").alias("pos")).select(F.col("src").alias("id"), "dst", "pos")
    best = cut(entries.select(F.col("id").alias("entry"), "id", F.array().cast("array<bigint>").alias("path")))
    changed = best
    while changed.limit(1).count():
        step = changed.join(edges, "id").select("entry", F.col("dst").alias("id"), F.concat("path", F.array("pos")).alias("path"))
        step = step.groupBy("entry", "id").agg(F.min("path").alias("new"))
        merged = best.join(step, ["entry", "id"], "full_outer")
        changed = cut(merged.where(F.col("new").isNotNull() & (F.col("path").isNull() | (F.col("new") < F.col("path")))).select("entry", "id", F.col("new").alias("path")))
        best = cut(merged.select("entry", "id", F.coalesce(F.least("path", "new"), "path", "new").alias("path")))
    w = Window.partitionBy("entry").orderBy("path", "id")
    return best.select("entry", (F.row_number().over(w) - 1).alias("pos"), "id")


def _depth_first(start, graph: dict, allowed: set) -> list:
    """Pre-order without recursion."""
    order, seen, stack = [], set(), [start]
    while stack:
        node = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        order.append(node)
        stack.extend(c for c in reversed(graph.get(node, ())) if c in allowed and c not in seen)
    return order


def _chains(group: pd.DataFrame) -> list[list]:
    """Chains of one connected group of results: one for each node nobody calls, then of what cycles leave over."""
    score = {r.id: (bool(r.is_bridge), -float(r.similarity), r.id) for r in group.itertuples()}
    graph = {r.id: list(dict.fromkeys(c for c in r.callees if c in score)) for r in group.itertuples()}
    called = {c for cs in graph.values() for c in cs}
    out, covered = [], set()
    for entry in sorted((i for i in score if i not in called), key=score.get):
        chain = _depth_first(entry, graph, set(score))
        out.append(chain)
        covered |= set(chain)
    while rest := set(score) - covered:
        chain = _depth_first(min(rest, key=score.get), graph, rest)
        out.append(chain)
        covered |= set(chain)
    return out


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node of the links (src, dst) of all batches, with the least node that they lead to either way."""
    up: dict = {}

    def top(i):
        while up.setdefault(i, i) != i:
            up[i] = i = up[up[i]]
        return i

    for links in batches:
        for a, b in zip(links["src"].tolist(), links["dst"].tolist(), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    if up:
        yield pd.DataFrame({"id": list(up), "group": [top(i) for i in up]})


def groups_of(results: DataFrame, calls: DataFrame) -> DataFrame:
    """id, group: connected groups of results by calls among them, named by their least id.

    Up to one task's size the links are followed in one task, as they are for a query's hits; more of them in rounds of joins.
    """
    links = cut(within(results, calls).select("src", "dst").distinct())
    if links.count() <= ONE_TASK_PAIRS:
        kind = results.schema["id"].dataType.simpleString()
        found = cut(links.coalesce(1).mapInPandas(_linked, f"id {kind}, group {kind}"))
        return results.select("id").join(found, "id", "left").select("id", F.coalesce("group", "id").alias("group"))
    both = links.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(links.select(F.col("dst").alias("x"), F.col("src").alias("y"))).distinct()
    labels = cut(results.select("id", F.col("id").alias("group")))
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), F.col("group").alias("g")), "y").groupBy(F.col("x").alias("id")).agg(F.min("g").alias("g"))
        low = labels.join(near, "id", "left").select("id", F.col("group").alias("old"), F.least("group", F.coalesce("g", "group")).alias("group"))
        jump = labels.select(F.col("id").alias("group"), F.col("group").alias("further"))
        new = cut(low.join(jump, "group", "left").select("id", "old", F.least("group", F.coalesce("further", "group")).alias("group")))
        labels = new.select("id", "group")
        if not new.where(F.col("group") != F.col("old")).limit(1).count():
            return labels


def chains(results: DataFrame, calls: DataFrame) -> DataFrame:
    """chain (its first node), pos, id of results(id, similarity, is_bridge): execution order, cycles and all.

    Connected groups of results are ordered apart from each other, each in one task: results are a query's hits, so a
    group is small.
    """
    kind = results.schema["id"].dataType.simpleString()
    listed = within(results, calls).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("c")).select(F.col("src").alias("id"), F.transform("c", lambda c: c["dst"]).alias("callees"))
    rows = results.select("id", "similarity", "is_bridge").join(listed, "id", "left").withColumn("callees", F.coalesce("callees", F.array().cast(f"array<{kind}>"))).join(groups_of(results, calls), "id")

    def order(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(c[0], p, i) for c in _chains(group) for p, i in enumerate(c)], columns=["chain", "pos", "id"])

    return rows.groupBy("group").applyInPandas(order, f"chain {kind}, pos int, id {kind}")


def chain_scores(chain_rows: DataFrame, calls: DataFrame, mu: float = 1.0, penalty: float = 0.3) -> DataFrame:
    """chain, n, score: similarities, plus the mean product of similarities over the calls inside, less a charge for length.

    chain_rows(chain, id, similarity).
    """
    rows = chain_rows.select("chain", "id", "similarity")
    own = rows.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.sum("similarity").alias("total"))
    a = rows.select("chain", F.col("id").alias("src"), F.col("similarity").alias("s1"))
    b = rows.select("chain", F.col("id").alias("dst"), F.col("similarity").alias("s2"))
    links = a.join(calls, "src").join(b, ["chain", "dst"]).groupBy("chain").agg(F.avg(F.col("s1") * F.col("s2")).alias("links"))
    score = F.col("total") + mu * F.coalesce("links", F.lit(0.0)) - penalty * (F.col("n") - 1)
    return own.join(links, "chain", "left").select("chain", "n", score.alias("score"))


def prune(chain_rows: DataFrame, calls: DataFrame, threshold: float = 0.3) -> DataFrame:
    """chain_rows(chain, id, similarity) less the low leaves, again and again; chains of one node stay as they are.

    A leaf calls nothing in its chain; one that calls itself is none.
    """
    size = Window.partitionBy("chain")
    rows = cut(chain_rows.select("chain", "id", "similarity", (F.count(F.lit(1)).over(size) == 1).alias("single")))
    while True:
        inside = rows.select("chain", F.col("id").alias("src")).join(calls.select("src", "dst").distinct(), "src").join(rows.select("chain", F.col("id").alias("dst")), ["chain", "dst"]).select("chain", F.col("src").alias("id")).distinct().withColumn("inner", F.lit(True))
        low = rows.join(inside, ["chain", "id"], "left").where(F.col("inner").isNull() & ~F.col("single") & (F.col("similarity") < threshold)).select("chain", "id")
        low = cut(low)
        if not low.limit(1).count():
            return rows.drop("single")
        rows = cut(rows.join(low, ["chain", "id"], "left_anti"))


def overlaps(chain_rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """a, b, shared, ratio of chains (two nodes or more) that share at least that part of the shorter one: an equi-join on nodes."""
    rows = chain_rows.select("chain", "id").distinct()
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("chain"))).where("n > 1")
    a, b = rows.select(F.col("chain").alias("a"), "id", F.col("n").alias("n1")), rows.select(F.col("chain").alias("b"), "id", F.col("n").alias("n2"))
    pairs = a.join(b, "id").where("a < b").groupBy("a", "b", "n1", "n2").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.withColumn("ratio", F.col("shared") / F.least("n1", "n2")).where(F.col("ratio") >= threshold).select("a", "b", "shared", "ratio")


def merge_groups(chain_rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """chain, group: overlapping chains, followed transitively, under their least chain."""
    names = chain_rows.select(F.col("chain").alias("id")).distinct()
    links = overlaps(chain_rows, threshold).select(F.col("a").alias("src"), F.lit(0).alias("pos"), F.col("b").alias("dst"))
    return groups_of(names, links).select(F.col("id").alias("chain"), "group")


def cores(chain_rows: DataFrame, groups: DataFrame) -> DataFrame:
    """group, id of the nodes that two chains or more of a group share."""
    return chain_rows.select("chain", "id").join(groups, "chain").groupBy("group", "id").agg(F.count_distinct("chain").alias("n")).where("n >= 2").select("group", "id")


def merge(chain_rows: DataFrame, calls: DataFrame, threshold: float = 0.6) -> DataFrame:
    """chain_rows(chain, pos, id, similarity, is_bridge) with overlapping chains replaced by their core where it scores no less than the best of them.

    A core starts at the node that fewest core nodes call, real hits before bridges, best first; the rest follows depth first.
    """
    kind = chain_rows.schema["id"].dataType.simpleString()
    groups = cut(merge_groups(chain_rows, threshold))
    many = groups.join(groups.groupBy("group").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("group"), "group", "left_semi")
    core = cores(chain_rows, many)
    facts = chain_rows.groupBy("id").agg(F.max("similarity").alias("similarity"), F.min("is_bridge").alias("is_bridge"))
    core = cut(core.join(facts, "id"))
    inner = core.select("group", F.col("id").alias("src")).join(calls, "src").join(core.select("group", F.col("id").alias("dst")), ["group", "dst"])
    listed = inner.groupBy("group", F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("c")).select("group", "id", F.transform("c", lambda c: c["dst"]).alias("callees"))
    rows = core.join(listed, ["group", "id"], "left").withColumn("callees", F.coalesce("callees", F.array().cast(f"array<{kind}>")))

    def order(g: pd.DataFrame) -> pd.DataFrame:
        score = {r.id: (bool(r.is_bridge), -float(r.similarity), r.id) for r in g.itertuples()}
        graph = {r.id: list(dict.fromkeys(r.callees)) for r in g.itertuples()}
        called = {c for i, cs in graph.items() for c in cs if c != i}
        chain = _depth_first(min(score, key=lambda i: (i in called, *score[i])), graph, set(score))
        chain += sorted(set(score) - set(chain), key=score.get)
        return pd.DataFrame({"chain": g["group"].iloc[0], "pos": range(len(chain)), "id": chain})

    ordered = rows.groupBy("group").applyInPandas(order, f"chain {kind}, pos int, id {kind}").join(facts, "id")
    best = chain_scores(chain_rows, calls).join(many, "chain").groupBy("group").agg(F.max("score").alias("best"))
    taken = chain_scores(ordered, calls).join(best, F.col("chain") == F.col("group")).where(F.col("score") >= F.col("best")).select("group")
    taken = cut(taken)
    replaced = many.join(taken, "group", "left_semi").select("chain")
    columns = ["chain", "pos", "id", "similarity", "is_bridge"]
    kept = chain_rows.join(replaced, "chain", "left_anti").select(*columns)
    return kept.unionByName(ordered.join(taken.withColumnRenamed("group", "chain"), "chain", "left_semi").select(*columns))


def bridges(chain_rows: DataFrame, edges: DataFrame, cutoff: float = 5.0) -> DataFrame:
    """id of the inner nodes of the cheapest paths, at most cutoff long, from a chain's boundary to another chain.

    chain_rows(chain, id), edges(src, dst, weight). A boundary node calls nothing, or is called by nothing, inside its chain.
    Each round relaxes one more edge and keeps the best path to a node, the least one of equal cost; with weights from
    0.847 a cutoff of 5 is done after five rounds.
    """
    home = chain_rows.groupBy("id").agg(F.max("chain").alias("chain"))
    rows = chain_rows.select("chain", "id").distinct()
    inside = rows.select("chain", F.col("id").alias("src")).join(edges, "src").join(rows.select("chain", F.col("id").alias("dst")), ["chain", "dst"]).where("src <> dst").select("chain", "src", "dst")
    calls_in = inside.select("chain", F.col("src").alias("id")).distinct().withColumn("o", F.lit(True))
    called_in = inside.select("chain", F.col("dst").alias("id")).distinct().withColumn("i", F.lit(True))
    edge = rows.join(calls_in, ["chain", "id"], "left").join(called_in, ["chain", "id"], "left").where("o IS NULL OR i IS NULL").select("id").distinct()
    step = edges.select(F.col("src").alias("id"), "dst", "weight")
    best = cut(edge.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"), F.array("id").alias("path")))
    changed = best
    while changed.limit(1).count():
        new = changed.join(step, "id").select("source", F.col("dst").alias("id"), (F.col("dist") + F.col("weight")).alias("dist"), F.concat("path", F.array("dst")).alias("path")).where(F.col("dist") <= cutoff)
        new = new.groupBy("source", "id").agg(F.min(F.struct("dist", "path")).alias("new"))
        both = best.select("source", "id", F.struct("dist", "path").alias("old")).join(new, ["source", "id"], "full_outer")
        changed = cut(both.where("new IS NOT NULL AND (old IS NULL OR new < old)").select("source", "id", "new.dist", "new.path"))
        best = cut(both.select("source", "id", F.coalesce(F.least("old", "new"), "old", "new").alias("b")).select("source", "id", "b.dist", "b.path"))
    ends = best.join(home, "id").withColumnRenamed("chain", "to").join(home.select(F.col("id").alias("source"), F.col("chain").alias("from")), "source").where("`to` <> `from`")
    return ends.where(F.size("path") > 2).select(F.explode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("id")).distinct().join(home.select("id"), "id", "left_anti")


def modules(nodes: DataFrame, k: int = 30) -> DataFrame:
    """file, functions, rank: the files with most functions."""
    n = nodes.groupBy("file").agg(F.count(F.lit(1)).alias("functions")).orderBy(F.desc("functions"), "file").limit(k)
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("functions"), "file")))


def dominant_files(labels: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """community, file, members of labels(id, community): the commonest file, by name on ties; small communities go."""
    n = labels.join(nodes.select("id", "file"), "id").groupBy("community", "file").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("community").agg(F.sum("n").alias("members"), F.min_by("file", F.struct(-F.col("n"), "file")).alias("file"))
    return best.where(F.col("members") >= least).select("community", "file", "members")


def module_entries(labels: DataFrame, nodes: DataFrame, calls: DataFrame, k: int = 5) -> DataFrame:
    """community, rank, id, out_degree: entry points inside each community, widest first."""
    own = calls.join(labels.select(F.col("id").alias("src"), F.col("community").alias("c1")), "src").join(labels.select(F.col("id").alias("dst"), F.col("community").alias("c2")), "dst").where("c1 = c2").select("src", "dst").distinct()
    out = own.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    free = labels.join(own.select(F.col("dst").alias("id")), "id", "left_anti").join(out, "id", "left").withColumn("out_degree", F.coalesce("out_degree", F.lit(0)))
    w = Window.partitionBy("community").orderBy(F.desc("out_degree"), "id")
    return free.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("community", "rank", "id", "out_degree")


#: Fixed value: pairs of neighbours up to which a graph is finished in one task (some 100 MB there).
ONE_TASK_PAIRS = 1_000_000
#: Fixed value: one in so many nodes must merge in the blocks, or the level is moved in rounds.
BLOCKS_MERGE = 50


def communities(edges: DataFrame, one_task: int = ONE_TASK_PAIRS) -> DataFrame:
    """id, community by greedy modularity: local moving and aggregation until modularity stops growing; a community's name is its least id.

    A graph over ``one_task`` pairs is aggregated level by level: in blocks of neighbouring ids of about so many pairs, each moved in a task
    of its own, and where these merge next to nothing, in blocks by hash that hear of each other's moves. Once it is that small, one task does the rest.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))
    pairs = cut(both.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    member = pairs.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id"))
    while True:
        n = pairs.count()
        small = n <= one_task
        done = None if small else _in_blocks(pairs, -(-n // max(one_task, 1)))
        if done is not None:
            labels = done.where("k = 0").select(F.col("a").alias("id"), F.col("b").alias("community"))
            merged = labels.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") != F.col("community")).alias("moved")).first()
            done = done if merged["moved"] * BLOCKS_MERGE >= merged["n"] else None
        if done is None:
            labels = _in_one_task(pairs) if small else _local_moves(pairs, -(-n // max(one_task, 1)))
        level = labels.select(F.col("id").alias("community"), F.col("community").alias("new"))
        member = cut(member.join(level, "community").select("id", F.col("new").alias("community")))
        if small or not labels.where("id <> community").limit(1).count():
            break
        a, b = (labels.select(F.col("id").alias(x), F.col("community").alias(f"{x}2")) for x in "ab")
        if done is not None:
            outer = done.where("k = 2").join(b, "b").select("a", F.col("b2").alias("b"), "weight")
            pairs = cut(done.where("k = 1").select("a", "b", "weight").unionByName(outer).groupBy("a", "b").agg(F.sum("weight").alias("weight")))
            continue
        pairs = cut(pairs.join(a, "a").join(b, "b").groupBy(F.col("a2").alias("a"), F.col("b2").alias("b")).agg(F.sum("weight").alias("weight")))
    least = member.groupBy("community").agg(F.min("id").alias("least"))
    return member.join(least, "community").select("id", F.col("least").alias("community"))


def _in_blocks(pairs: DataFrame, blocks: int) -> DataFrame:
    """Ranges of ids, each moved in one task. k = 0: a node (a) and its community (b); k = 1: pairs of communities; k = 2: of a community (a) and a node of another block (b).

    A task has all pairs of its nodes, so gains are those of the whole graph; a node with most of its weight outside its block stays alone.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    total = pairs.agg(F.sum("weight").alias("t")).first()["t"] or 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        e = pd.concat(parts, ignore_index=True).sort_values(["a", "b"], ignore_index=True)
        nodes, a = np.unique(e["a"].to_numpy(), return_inverse=True)
        b = pd.Index(nodes).get_indexer(e["b"])
        label = np.array(moved_in_block(a, b, e["weight"].to_numpy(), len(nodes), total))
        yield pd.DataFrame({"k": 0, "a": nodes, "b": nodes[label], "weight": 0.0})
        inner = b >= 0
        ends = e["b"].to_numpy().copy()
        ends[inner] = nodes[label[b[inner]]]
        out = pd.DataFrame({"k": np.where(inner, 1, 2), "a": nodes[label[a]], "b": ends, "weight": e["weight"]})
        yield out.groupby(["k", "a", "b"], as_index=False)["weight"].sum()

    return cut(pairs.repartitionByRange(blocks, "a").mapInPandas(run, f"k int, a {kind}, b {kind}, weight double"))


def moved_in_block(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int, total: float) -> list[int]:
    """The label of each of n nodes, by local moving until none gains; a label is its least node.

    Pairs are sorted by a; b is -1 outside the block. Nodes around a moved one are looked at again.
    """
    inner = (b >= 0) & (a != b)
    degree = np.bincount(a, weight, n)
    free = (np.bincount(a, np.where(inner, weight, 0.0), n) >= np.bincount(a, np.where(b < 0, weight, 0.0), n)).tolist()
    start = np.searchsorted(a[inner], np.arange(n + 1)).tolist()
    ends, weights = b[inner].tolist(), weight[inner].tolist()
    mass, degree = degree.tolist(), degree.tolist()
    label, waits = list(range(n)), [True] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        waits[i] = False
        if not free[i]:
            continue
        own, d = label[i], degree[i]
        share = d / total
        mass[own] -= d
        near = {own: 0.0}
        around = ends[start[i] : start[i + 1]]
        for j, w in zip(around, weights[start[i] : start[i + 1]], strict=True):
            c = label[j]
            near[c] = near.get(c, 0.0) + w
        # A move must gain more than sums are rounded by, or it might never end.
        best, top = own, near[own] - mass[own] * share + 1e-9 * d
        for c, w in near.items():
            gain = w - mass[c] * share
            if gain > top or gain == top and c < best and best != own:
                best, top = c, gain
        mass[best] += d
        if best != own:
            label[i] = best
            for j in around:
                if not waits[j] and label[j] != best:
                    waits[j] = True
                    queue.append(j)
    least: dict[int, int] = {}
    for i, c in enumerate(label):
        least.setdefault(c, i)
    return [least[c] for c in label]


#: What two rounds must add to modularity for a third, how often a round looks at a node, and in how many shares nodes are looked at.
LEAST_GROWTH, LOOKS, SHARES = 1e-4, 2, 4


def _local_moves(pairs: DataFrame, blocks: int = 1) -> DataFrame:
    """id, community: nodes move, in alternate halves by hash, to the community around them that raises modularity most, ties to the least.

    Pairs are packed once, in blocks by the hash of a. A round brings to a block the community of each node in it, with its mass and size,
    and moves a half of the block's nodes; what others did meanwhile is seen in the next round. Ends when neither half has raised modularity;
    the labels with the highest count, since nodes that move at once may lower it.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    total = pairs.agg(F.sum("weight").alias("t")).first()["t"] or 1.0
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    # Pairs stand both ways round, so sums by b are those by a.
    labels = pairs.groupBy(F.col("b").alias("id")).agg(F.sum("weight").alias("degree"), F.collect_set(place("a")).alias("blocks"))
    labels = cut(labels.select("id", F.col("id").alias("community"), "degree", F.array_union("blocks", F.array(place("id"))).alias("blocks"), F.lit(0.0).alias("q")))

    def pack(e: pd.DataFrame) -> pd.DataFrame:
        ids = pd.Index(np.unique(np.concatenate([e["a"].to_numpy(), e["b"].to_numpy()])))
        x, y = ids.get_indexer(e["a"]).astype(np.int32), ids.get_indexer(e["b"]).astype(np.int32)
        order = np.lexsort((y, x))
        return pd.DataFrame({"block": e["block"].iloc[:1], "x": [x[order].tobytes()], "y": [y[order].tobytes()], "w": [e["weight"].to_numpy()[order].tobytes()]})

    packed = cut(pairs.withColumn("block", place("a")).groupBy("block").applyInPandas(pack, "block int, x binary, y binary, w binary"))

    def run(block: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        # What is sent to a block are the nodes that its pairs count, in the order of their ids.
        sent = sent.sort_values("id", ignore_index=True)
        x, y, w = (np.frombuffer(block[c].iloc[0], t) for c, t in (("x", np.int32), ("y", np.int32), ("w", np.float64)))
        names, first, label = np.unique(sent["community"].to_numpy(), return_index=True, return_inverse=True)
        mass, size, degree, own = (sent[c].to_numpy() for c in ("mass", "size", "degree", "own"))
        q = w[label[x] == label[y]].sum() / total - (degree * mass)[own].sum() / total**2
        free = sent["free"].to_numpy()[x] & (x != y)
        label = moved_at_once(x[free], y[free], w[free], label, mass[first], size[first], degree, total)
        out = pd.DataFrame({"id": sent["id"], "community": names[label], "degree": degree, "blocks": sent["blocks"], "q": 0.0})[own]
        out.iloc[0, 4] = q
        return out

    best, known = labels, []
    while True:
        facts = labels.groupBy("community").agg(F.sum("degree").alias("mass"), F.count(F.lit(1)).alias("size"))
        sent = labels.join(facts, "community").withColumn("block", F.explode("blocks")).withColumn("own", F.col("block") == place("id"))
        free = F.col("own") & (F.pmod(F.hash("id"), F.lit(2)) == len(known) % 2)
        sent = sent.select("block", "id", "community", "mass", "size", "degree", "own", free.alias("free"), F.when(F.col("own"), F.col("blocks")).alias("blocks"))
        new = cut(packed.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(run, f"id {kind}, community {kind}, degree double, blocks array<int>, q double"))
        q = new.agg(F.sum("q").alias("q")).first()["q"] or 0.0  # of the labels that went in
        best, known = (labels if q >= max(known, default=q) else best), [*known, q]
        if len(known) > 2 and max(known) < max(known[:-2]) + LEAST_GROWTH:
            return best.select("id", "community")
        labels = new


def moved_at_once(x: np.ndarray, y: np.ndarray, weight: np.ndarray, label: np.ndarray, mass: np.ndarray, size: np.ndarray, degree: np.ndarray, total: float) -> np.ndarray:
    """label after each node of x has been looked at LOOKS times, in shares whose nodes move at once; pairs are sorted by x, none is of one node.

    label counts communities in the order of their names; mass and size are theirs, degree is a node's.
    """
    label, mass, size, n = label.astype(np.int64), mass.astype(float), size.astype(np.int64), len(mass)
    shares = [(x[r].astype(np.int64), y[r], weight[r]) for r in (np.flatnonzero(x % SHARES == k) for k in range(SHARES))]
    for a, b, w in shares * LOOKS:
        if not len(a):
            continue
        key = a * n + label[b]
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        node, c = np.divmod(key[starts], n)
        near = np.add.reduceat(w[order], starts)
        here = c == label[node]
        gain = near - mass[c] * degree[node] / total
        begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        i = node[begin]
        now = label[i]
        stay = (degree[i] - mass[now]) * degree[i] / total
        stay[np.searchsorted(i, node[here])] += near[here]
        gain[here] = -np.inf
        top = np.maximum.reduceat(gain, begin)
        first = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[begin, len(node)])))
        to = c[first[np.r_[True, node[first][1:] != node[first][:-1]]]]
        # A move must gain more than sums are rounded by; of two nodes that are each alone, only one goes to the other.
        go = (top > stay + 1e-9 * degree[i]) & ((size[now] > 1) | (size[to] > 1) | (to < now))
        i, now, to = i[go], now[go], to[go]
        for change, by in ((mass, degree[i]), (size, 1)):
            np.subtract.at(change, now, by)
            np.add.at(change, to, by)
        label[i] = to
    return label


def _in_one_task(pairs: DataFrame) -> DataFrame:
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            e = pd.concat(parts).sort_values(["a", "b"])
            found = best_modularity(list(zip(e["a"], e["b"], e["weight"], strict=True)))
            yield pd.DataFrame(sorted(found.items()), columns=["id", "community"])

    # Every pair stands in pairs twice, a node's own weight doubled: halves make them whole again.
    once = pairs.where("a <= b").select("a", "b", F.when(F.col("a") == F.col("b"), F.col("weight") / 2).otherwise(F.col("weight")).alias("weight"))
    return cut(once.coalesce(1).mapInPandas(run, f"id {kind}, community {kind}"))


def best_modularity(edges: list[tuple]) -> dict:
    """Local moving and aggregation until modularity stops growing; deterministic, communities named by their least node."""
    weight: dict = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        weight[a][b] += w
        weight[b][a] += w
    member = {i: i for i in weight}
    graph = {i: dict(n) for i, n in weight.items()}
    total = sum(sum(n.values()) for n in graph.values())
    while total:
        label = {i: i for i in graph}
        degree = {i: sum(n.values()) for i, n in graph.items()}
        mass = dict(degree)
        moved = again = True
        first = False
        while again:
            again = False
            for i in sorted(graph):
                near: dict = defaultdict(float)
                for j, w in graph[i].items():
                    if j != i:
                        near[label[j]] += w
                mass[label[i]] -= degree[i]
                gain = lambda c: near[c] - mass[c] * degree[i] / total  # noqa: B023, E731
                best = max([label[i], *sorted(near)], key=lambda c: (gain(c) + (1e-12 if c == label[i] else 0)))
                mass[best] += degree[i]
                if best != label[i]:
                    label[i], again, first = best, True, True
        moved = first
        member = {i: label[c] for i, c in member.items()}
        if not moved:
            break
        merged: dict = defaultdict(lambda: defaultdict(float))
        for i, n in graph.items():
            for j, w in n.items():
                merged[label[i]][label[j]] += w
        graph = {i: dict(n) for i, n in merged.items()}
    least: dict = {}
    for i, c in member.items():
        least[c] = min(i, least.get(c, i))
    return {i: least[c] for i, c in member.items()}


def modularity(labels: DataFrame, edges: DataFrame) -> float:
    """Of labels(id, community) on the undirected weighted edges."""
    e = edges.join(labels.select(F.col("id").alias("src"), F.col("community").alias("c1")), "src").join(labels.select(F.col("id").alias("dst"), F.col("community").alias("c2")), "dst")
    m = e.agg(F.sum("weight").alias("m")).first()["m"] or 0.0
    if not m:
        return 0.0
    ends = e.select(F.col("c1").alias("c"), "weight").unionByName(e.select(F.col("c2").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    inner = e.where("c1 = c2").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()["w"]
    return inner / m - ends.agg(F.sum(F.pow(F.col("d") / (2 * m), 2)).alias("s")).first()["s"]


def topological(chain_rows: DataFrame, calls: DataFrame) -> DataFrame:
    """chain_rows(chain, pos, id, similarity, is_bridge) with each chain callers first; ties by earliest call place, bridges late, similarity; cycles last.

    Chains of one or two nodes keep their order.
    """
    kind = chain_rows.schema["id"].dataType.simpleString()
    inner = chain_rows.select("chain", F.col("id").alias("src")).join(calls, "src").join(chain_rows.select("chain", F.col("id").alias("dst")), ["chain", "dst"]).where("src <> dst")
    listed = inner.groupBy("chain", F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("c")).select("chain", "id", F.transform("c", lambda c: c["dst"]).alias("callees"))
    rows = chain_rows.join(listed, ["chain", "id"], "left").withColumn("callees", F.coalesce("callees", F.array().cast(f"array<{kind}>")))

    def order(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        ids = list(g["id"])
        if len(ids) > 2:
            ids = kahn({r.id: list(dict.fromkeys(r.callees)) for r in g.itertuples()}, {r.id: (bool(r.is_bridge), -float(r.similarity), r.id) for r in g.itertuples()})
        return pd.DataFrame({"chain": g["chain"].iloc[0], "pos": range(len(ids)), "id": ids})

    return rows.groupBy("chain").applyInPandas(order, f"chain {chain_rows.schema['chain'].dataType.simpleString()}, pos int, id {kind}")


def kahn(graph: dict, score: dict) -> list:
    """Callers before callees; among the ready, the one called earliest by what is already out."""
    waiting = defaultdict(int)
    for cs in graph.values():
        for c in cs:
            waiting[c] += 1
    called: dict = {}
    ready = {i for i in graph if not waiting[i]}
    out: list = []
    while ready:
        node = min(ready, key=lambda i: (called.get(i, (float("inf"), 0)), *score[i]))
        ready.remove(node)
        out.append(node)
        for k, c in enumerate(graph[node]):
            called[c] = min(called.get(c, (float("inf"), 0)), (len(out), k))
            waiting[c] -= 1
            if not waiting[c]:
                ready.add(c)
    done = set(out)
    return out + sorted((i for i in graph if i not in done), key=score.get)


def chain_stats(results: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: functions, entry_points, internal_calls, bridges of results(id, is_bridge)."""
    inner = within(results, calls).select("src", "dst").distinct()
    called = inner.where("src <> dst").select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(1))
    row = results.join(called, "id", "left").agg(F.count(F.lit(1)).alias("functions"), F.count_if(F.col("called").isNull()).alias("entry_points"), F.count_if("is_bridge").alias("bridges"))
    # One row beside one row.
    return row.join(inner.agg(F.count(F.lit(1)).alias("internal_calls")), F.lit(True)).select("functions", "entry_points", "internal_calls", "bridges")
