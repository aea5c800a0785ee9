"""Graph operators on small graphs, and the relational order against the sequential one on random ones."""

import random

import numpy as np
import pytest

from lodestar.operators import graph

NODES = "id string, file string, class string, similarity double, is_bridge boolean"


def edges(spark, text):
    """'a>b c' to calls: a calls b, then c."""
    rows = []
    for line in text.split(";"):
        if ">" in line:
            src, dst = line.strip().split(">")
            rows += [(src, k, d) for k, d in enumerate(dst.split())]
    return spark.createDataFrame(rows, "src string, pos int, dst string")


def results(spark, ids, scores=None, bridges=""):
    scores = scores or {}
    return spark.createDataFrame([(i, "f", None, float(scores.get(i, 0.5)), i in bridges.split()) for i in ids.split()], NODES)


def as_chains(df):
    out = {}
    for r in df.orderBy("chain", "pos").collect():
        out.setdefault(r["chain"], []).append(r["id"])
    return out


@pytest.mark.parametrize(
    ("ids", "text", "chains"),
    [
        ("a b c", "a>b;b>c", {"a": ["a", "b", "c"]}),
        ("a b x y", "a>x y;b>x", {"a": ["a", "x", "y"], "b": ["b", "x"]}),
        ("a c", "a>b;b>c", {"a": ["a"], "c": ["c"]}),
        ("a b c d", "a>b c;b>d;c>d", {"a": ["a", "b", "d", "c"]}),
        ("a", "a>a", {"a": ["a"]}),
        ("a b", "a>b;b>a", {"a": ["a", "b"]}),
        ("a b c", "a>b;b>c;c>b", {"a": ["a", "b", "c"]}),
        ("a b", "", {"a": ["a"], "b": ["b"]}),
    ],
)
def test_chains(spark, ids, text, chains):
    assert as_chains(graph.chains(results(spark, ids), edges(spark, text))) == chains


def test_preorder_on_random_graphs(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = 14
        calls = [(a, k, b) for a in range(n) for k, b in enumerate(rng.sample(range(a + 1, n), min(n - a - 1, rng.randint(0, 3))))]
        df = spark.createDataFrame(calls, "src long, pos int, dst long")
        rows = spark.createDataFrame([(i, 0.5, False) for i in range(n)], "id long, similarity double, is_bridge boolean")
        got = {}
        for r in graph.preorder(graph.entry_points(rows, df), df).orderBy("entry", "pos").collect():
            got.setdefault(r["entry"], []).append(r["id"])
        want = {}
        for r in graph.chains(rows, df).orderBy("chain", "pos").collect():
            want.setdefault(r["chain"], []).append(r["id"])
        assert got == want


def test_groups_of_hits_are_found_at_once(spark, monkeypatch):
    """A long chain of hits takes no rounds of joins, and these, for more links than a task's, name the same groups."""
    rows = results(spark, " ".join(f"n{i:02}" for i in range(40)) + " z")
    calls = edges(spark, ";".join(f"n{i + 1:02}>n{i:02}" for i in range(39) if i != 20) + ";z>z gone")
    stored = []
    monkeypatch.setattr(graph, "cut", lambda table, cut=graph.cut: stored.append(table.columns) or cut(table))
    got = {r["id"]: r["group"] for r in graph.groups_of(rows, calls).collect()}
    assert got == {f"n{i:02}": "n00" if i <= 20 else "n21" for i in range(40)} | {"z": "z"}
    assert len(stored) == 2
    monkeypatch.setattr(graph, "ONE_TASK_PAIRS", 0)
    assert {r["id"]: r["group"] for r in graph.groups_of(rows, calls).collect()} == got


def test_weights_and_degrees(spark):
    nodes = spark.createDataFrame([("a", "f", "C", 0.5, False), ("b", "f", "C", 0.5, False), ("c", "f", None, 0.5, False), ("d", "g", None, 0.5, False)], NODES)
    calls = graph.known_calls(edges(spark, "a>b c d gone;b>c c"), nodes)
    got = {(r["src"], r["dst"]): round(r["weight"], 4) for r in graph.weighted_edges(calls, nodes).collect()}
    assert got == {("a", "b"): round(1.6931 * 0.5, 4), ("a", "c"): round(2.3863 * 0.7, 4), ("b", "c"): round(2.3863 * 0.7, 4), ("a", "d"): 1.6931}
    assert {r["id"]: r["in_degree"] for r in graph.in_degrees(calls).collect()} == {"b": 1, "c": 3, "d": 1}


def test_bridges(spark):
    nodes = spark.createDataFrame([(i, i, None, 0.5, False) for i in "abcde"], NODES)
    make = lambda rows: spark.createDataFrame(rows, "src string, dst string, weight double")
    chains = spark.createDataFrame([("x", "a"), ("y", "c")], "chain string, id string")
    ids = lambda e, cutoff=5.0, c=chains: sorted(r["id"] for r in graph.bridges(c, make(e), cutoff).collect())
    assert ids([("a", "b", 1.0), ("b", "c", 1.0)]) == ["b"]
    assert ids([("a", "b", 4.0), ("b", "c", 4.0)], 3.0) == []
    assert ids([("a", "b", 1.0), ("b", "c", 1.0), ("a", "d", 2.0), ("d", "c", 2.0)]) == ["b"]
    assert ids([("a", "b", 1.0), ("b", "c", 1.0)], c=spark.createDataFrame([("x", "a"), ("x", "c")], "chain string, id string")) == []
    assert nodes.count() == 5


def test_prune(spark):
    rows = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.1), ("a", "c", 0.1), ("d", "d", 0.1), ("e", "e", 0.1), ("e", "f", 0.1), ("g", "g", 0.9), ("g", "h", 0.1)], "chain string, id string, similarity double")
    left = sorted((r["chain"], r["id"]) for r in graph.prune(rows, edges(spark, "a>b;b>c;e>f;g>h;h>h"), 0.3).collect())
    assert left == [("a", "a"), ("d", "d"), ("g", "g"), ("g", "h")]


def test_merge(spark):
    chains = [("a", ["a", "s", "t", "u"]), ("b", ["b", "s", "t", "u"]), ("z", ["z"])]
    score = {"a": 0.1, "b": 0.1, "s": 0.9, "t": 0.9, "u": 0.9, "z": 0.5}
    rows = spark.createDataFrame([(c, k, i, score[i], False) for c, ids in chains for k, i in enumerate(ids)], "chain string, pos int, id string, similarity double, is_bridge boolean")
    calls = edges(spark, "a>s;b>s;s>t;t>u")
    got = as_chains(graph.merge(rows, calls, 0.6))
    assert sorted(got.values()) == [["s", "t", "u"], ["z"]]
    low = rows.replace(0.9, 0.05, ["similarity"]).replace(0.1, 0.95, ["similarity"])
    assert sorted(as_chains(graph.merge(low, calls, 0.6)).values()) == [["a", "s", "t", "u"], ["b", "s", "t", "u"], ["z"]]


def test_expand(spark):
    nodes = spark.createDataFrame([(i, "f" if i in "abc" else "g", None, 0.5, i == "t") for i in "abcdet"], NODES)
    got = {r["id"]: r["hop"] for r in graph.expand(nodes.where("id = 'a'").select("id"), edges(spark, "a>b t;b>c;d>a;e>d"), nodes, nodes["is_bridge"]).collect()}
    assert got == {"b": 1, "d": 1, "c": 2}


def test_descendants_and_stats(spark):
    rows, calls = results(spark, "a b c d", bridges="d"), edges(spark, "a>b c;b>c;c>b")
    assert {r["id"]: r["descendants"] for r in graph.descendants(rows, calls).collect()} == {"a": 2, "b": 2, "c": 2, "d": 0}
    r = graph.chain_stats(rows, calls).first()
    assert (r["functions"], r["entry_points"], r["internal_calls"], r["bridges"]) == (4, 2, 4, 1)


def test_communities(spark):
    e = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "xy" for i in range(5) for j in range(i)] + [("x0", "y0", 1.0)]
    df = spark.createDataFrame(e, "src string, dst string, weight double")
    for labels in (graph.communities(df), graph.communities(df, one_task=0)):
        got = {r["id"]: r["community"] for r in labels.collect()}
        assert len({got[f"x{i}"] for i in range(5)}) == 1 and len({got[f"y{i}"] for i in range(5)}) == 1 and got["x1"] != got["y1"]
        assert graph.modularity(labels, df) > 0.4


def test_communities_run_to_their_end(spark):
    """Rings of cliques: both ways reach the cliques, however many rounds that takes."""
    e = [(10 * g + i, 10 * g + j, 1.0) for g in range(12) for i in range(5) for j in range(i)] + [(10 * g, 10 * ((g + 1) % 12) + 1, 0.5) for g in range(12)]
    df = spark.createDataFrame(e, "src long, dst long, weight double")
    for labels in (graph.communities(df), graph.communities(df, one_task=0)):
        got = {r["id"]: r["community"] for r in labels.collect()}
        assert all(got[10 * g + i] == got[10 * g] for g in range(12) for i in range(5))
        assert all(got[c] == c for c in got.values())
        assert graph.modularity(labels, df) > 0.7


def test_communities_in_blocks(spark, monkeypatch):
    """Graphs over one task's size are merged in blocks first; joins over the whole graph are for what these can't merge."""
    e = [(10 * g + i, 10 * g + j, 1.0) for g in range(60) for i in range(5) for j in range(i)] + [(10 * g, 10 * ((g + 1) % 60) + 1, 0.5) for g in range(60)]
    df = spark.createDataFrame(e, "src long, dst long, weight double")
    want = graph.modularity(graph.communities(df), df)
    monkeypatch.setattr(graph, "_local_moves", None)
    labels = graph.communities(df, one_task=250)
    got = {r["id"]: r["community"] for r in labels.collect()}
    assert len(got) == 300 and all(got[10 * g + i] == got[10 * g] for g in range(60) for i in range(5))
    assert abs(graph.modularity(labels, df) - want) < 0.02
    text = df.select(df.src.cast("string"), df.dst.cast("string"), "weight")
    assert graph.modularity(graph.communities(text, one_task=250), text) > want - 0.05


def test_communities_of_a_graph_without_blocks(spark, monkeypatch):
    """A random graph, of which no block of ids merges: pairs are packed once, a round stores labels alone, and few rounds do what one task does."""
    rng = random.Random(5)
    e = [(a, b, 1.0) for a in range(300) for b in rng.sample(range(300), 8) if a != b]
    df = spark.createDataFrame(e, "src long, dst long, weight double").cache()
    want = graph.modularity(graph.communities(df), df)
    stored = []
    monkeypatch.setattr(graph, "cut", lambda table, cut=graph.cut: stored.append(table.columns) or cut(table))
    labels = graph.communities(df, one_task=2000)
    got = {r["id"]: r["community"] for r in labels.collect()}
    assert len(got) == 300 and all(got[c] == c <= i for i, c in got.items())
    assert graph.modularity(labels, df) > want - 0.03
    rounds = sum("q" in c for c in stored)
    assert rounds > 2 and len(stored) < 2 * rounds


def test_moves_at_once():
    """Two triangles and a link: whatever moves at once, masses and sizes stay those of the labels."""
    ends = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]
    x, y = np.array(sorted(ends + [(b, a) for a, b in ends])).T
    degree = np.bincount(x).astype(float)
    label = np.arange(6)
    for _ in range(4):
        mass, size = np.bincount(label, degree, 6), np.bincount(label, minlength=6)
        label = graph.moved_at_once(x, y, np.ones(len(x)), label, mass, size, degree, degree.sum())
    assert len(set(label[:3])) == len(set(label[3:])) == 1 and label[0] != label[3]


def test_topological(spark):
    rows = spark.createDataFrame([("c", k, i, 0.5, False) for k, i in enumerate("dbca")], "chain string, pos int, id string, similarity double, is_bridge boolean")
    got = as_chains(graph.topological(rows, edges(spark, "a>c b;b>d;c>d")))
    assert got == {"c": ["a", "c", "b", "d"]}
