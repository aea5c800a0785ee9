"""What the steps of a search carry in their plans."""

from lodestar.operators import graph, retrieval
from lodestar.plans import catalogue


def test_steps_get_stored_calls(spark, small, monkeypatch):
    """From the hits on, calls come as a stored table: no step plans the joins and windows of the whole call graph again."""
    plans = []
    for name in ("chains", "prune", "merge", "chain_scores"):

        def noted(rows, calls, *rest, step=getattr(graph, name)):
            plans.append(calls._jdf.queryExecution().analyzed().toString())
            return step(rows, calls, *rest)

        monkeypatch.setattr(graph, name, noted)
    assert catalogue.QUERIES["q41_search"](spark, small).columns == ["chain", "rank", "pos", "id", "similarity", "is_bridge"]
    assert len(plans) >= 4 and not any("Join" in p or "Window" in p for p in plans)


def test_scores_read_the_querys_own_tokens(spark):
    """Scores are counted in stored tokens of the query alone: their plan no longer scans the corpus, once for each use of a term."""
    corpus = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta gamma"), (3, "delta epsilon"), (4, "zeta eta"), (5, "theta iota")], "id long, text string")
    index = retrieval.bm25_index(corpus)
    scored = retrieval.bm25(index, "alpha beta")
    assert not set(scored.inputFiles()) & set(index.tokens.inputFiles())
    assert [r["id"] for r in scored.orderBy("score", ascending=False).collect()] == [1, 2]
