"""Louvain levels in one task are those of the rounds of jobs."""

import random

import pytest

from linkweave.operators import community as CM
from linkweave.operators import graph as G


@pytest.mark.parametrize("after", [0, 1])
def test_small_levels_in_one_task_are_the_same(spark, monkeypatch, after):
    r = random.Random(after)
    # Groups of groups, so that there are several levels; repeated edges, loops and a lone page.
    pairs = [(f"p{r.randrange(g, g + w):03}", f"p{r.randrange(g, g + w):03}") for g in range(0, 120, 10) for w in [10] * 25 + [20] * 6 + [60] * 2]
    edges = spark.createDataFrame(pairs + pairs[:20], "src string, dst string")
    nodes = G.graph_nodes(edges).unionByName(spark.createDataFrame([("alone",)], "title string"))
    tasks, rounds = [], []
    one, level = CM._in_one_task, CM._one_level
    monkeypatch.setattr(CM, "_in_one_task", lambda *a: tasks.append(a) or one(*a))
    monkeypatch.setattr(CM, "_one_level", lambda *a: rounds.append(a) or level(*a))
    if after:  # only the contracted graphs are small enough
        monkeypatch.setattr(CM, "ONE_TASK_EDGES", 300)
    got, value = CM.louvain(edges, nodes)
    got = sorted(map(tuple, got.collect()))
    assert (len(tasks), len(rounds)) == (1, after)  # some jobs for each round of each level before
    monkeypatch.setattr(CM, "ONE_TASK_EDGES", -1)
    want, same = CM.louvain(edges, nodes)
    assert sorted(map(tuple, want.collect())) == got and same == value and len(rounds) > after + 1
    assert ("alone", "alone", 1) in got and len({c for _, c, _ in got}) < 30
