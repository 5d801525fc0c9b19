"""Whole-graph iterative jobs: redirect resolution (R1), PageRank (K1), components (K2).

Each iteration is a join + aggregation keyed by node, checkpointed reliably so
lineage stays one iteration deep; only convergence counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.operators.traverse import KeyedEdges, _ckpt, _ckpt_obs, encode_graph, symmetrize
from linkweave.sources import schemas as S

REDIRECT_MAX_DEPTH = 10


def redirect_ends(pages: DataFrame) -> DataFrame:
    """Where every redirect page ends, by pointer doubling: ``(title, final_title, hops, cyclic)``.

    A pointer spans one redirect at first and twice as many after each round (a
    page takes its target's pointer), so chains of n redirects need log2(n)
    joins on the title.  A page that has not ended after as many rounds as the
    number of redirect pages has bits runs into a cycle: ``cyclic``, no end.
    ``hops`` counts the redirects followed (null if cyclic).  A redirect without
    a target ends at once with a null title.
    """
    first = pages.where(F.col("fetch_status") == S.STATUS_REDIRECT).select("title", F.col("redirect_to").alias("to"))
    first = first.groupBy("title").agg(F.min("to").alias("to"))  # repeated rows are one page
    known = first.select(F.col("title").alias("t"), F.lit(True).alias("goes_on"))
    state = first.join(known, first["to"] == known["t"], "left").select("title", "to", F.lit(1).cast("long").alias("hops"), F.coalesce("goes_on", F.lit(False)).alias("open"))
    state, m = _ckpt_obs(state, n=F.count(F.lit(1)), left=F.count_if("open"))
    for _ in range(max(int(m["n"] or 0), 1).bit_length()):
        if not m["left"]:
            break
        step = state.select(F.col("title").alias("t"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("open").alias("open2"))
        moving = state.where("open").join(step, F.col("to") == F.col("t")).select("title", F.col("to2").alias("to"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("open2").alias("open"))
        state, m = _ckpt_obs(state.where("NOT open").unionByName(moving), left=F.count_if("open"))
    return state.select("title", F.when(~F.col("open"), F.col("to")).alias("final_title"), F.when(~F.col("open"), F.col("hops")).alias("hops"), F.col("open").alias("cyclic"))


def resolve_redirects(pages: DataFrame, max_depth: int = REDIRECT_MAX_DEPTH) -> DataFrame:
    """Final target of every redirect page within ``max_depth`` further redirects.

    Output ``(title, final_title, depth, resolved)``; ``depth`` counts the
    redirects after the first.  ``resolved`` is false for chains that are longer
    (their depth is the bound) and for cycles; :func:`redirect_ends` tells these
    two apart.
    """
    ends = redirect_ends(pages)
    within = ~F.col("cyclic") & (F.col("hops") <= max_depth + 1)
    return ends.select(
        "title", F.when(within, F.col("final_title")).alias("final_title"),
        F.when(within, F.col("hops") - 1).otherwise(max_depth).cast("int").alias("depth"), within.alias("resolved"),
    )


def pagerank(
    edges: DataFrame,
    nodes: DataFrame,
    iterations: int = 20,
    damping: float = 0.85,
    top: int | None = 100,
    decimals: int = 9,
) -> DataFrame:
    """K1: PageRank with dangling mass spread uniformly; fixed iterations.

    Runs on ``long`` ids.  Weighted edges are kept hash-partitioned by source,
    hubs salted (:class:`KeyedEdges`), so each iteration shuffles only ranks and
    partial sums: contributions and the old rank rows meet in one aggregation.
    The dangling mass of the next iteration is observed while the ranks are
    checkpointed, so only that number reaches the driver.  Returns
    ``(title, score, rank)`` for the ``top`` nodes (all, without ranks, when
    None), ranked by rounded score then title.
    """
    ids, e = encode_graph(edges.select("src", "dst").distinct(), nodes)
    n_nodes = max(ids.count(), 1)
    outdeg = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    keyed = KeyedEdges(_ckpt(e.join(outdeg, "src").select("src", "dst", (1.0 / F.col("deg")).alias("w"))), "src", ("w",), fixed=True)
    idle = F.sum(F.when(~F.col("has_out"), F.col("pr")))
    ranks, m = _ckpt_obs(
        ids.join(outdeg, F.col("id") == F.col("src"), "left").select(
            F.col("id").alias("node"), F.col("src").isNotNull().alias("has_out"), F.lit(1.0 / n_nodes).alias("pr")
        ),
        idle=idle,
    )
    for _ in range(iterations):
        spread = (1.0 - damping) / n_nodes + damping * float(m["idle"] or 0.0) / n_nodes
        given = keyed.expand(ranks.select("node", "pr")).select(
            F.col("dst").alias("node"), F.lit(False).alias("has_out"), (F.col("pr") * F.col("w")).alias("c")
        )
        ranks, m = _ckpt_obs(
            given.unionByName(ranks.select("node", "has_out", F.lit(0.0).alias("c")))
            .groupBy("node")
            .agg(F.max("has_out").alias("has_out"), (F.lit(spread) + F.lit(damping) * F.sum("c")).alias("pr")),
            idle=idle,
        )
    keyed.unpersist()
    scored = ranks.join(ids, F.col("node") == F.col("id")).select("title", F.round("pr", decimals).alias("score"))
    if top is None:
        return scored
    first = scored.orderBy(F.col("score").desc(), "title").limit(top)  # at most ``top`` rows are ranked
    return first.select(
        "title", "score", F.row_number().over(Window.orderBy(F.col("score").desc(), "title")).cast("int").alias("rank")
    )


def communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """K2 (re-aimed): weakly connected components; community id = smallest title in it.

    Each round does min-label propagation over undirected edges followed by a
    pointer jump (a node takes its label's label), so chains converge in a
    logarithmic number of rounds instead of one round per hop.  Labels are
    always titles of the same component and only decrease, so the fixed point
    is the component minimum.  The jump joins on the label, a skewed key when
    a component is large; AQE's skew-join splits it.
    """
    und = _ckpt(symmetrize(edges))
    labels = _ckpt(nodes.select("title", F.col("title").alias("label")))
    while True:  # labels only decrease, so a round without a change comes
        cand = (
            und.join(labels.withColumnRenamed("title", "src"), "src")
            .groupBy(F.col("dst").alias("title"))
            .agg(F.min("label").alias("nl"))
        )
        prop = labels.join(cand, "title", "left").select(
            "title", F.least("label", F.coalesce("nl", F.col("label"))).alias("label"), F.col("label").alias("old")
        )
        jumped = prop.join(
            prop.select(F.col("title").alias("label"), F.col("label").alias("ll")), "label", "left"
        ).select("title", F.least("label", F.coalesce("ll", F.col("label"))).alias("label"), "old")
        new = _ckpt(jumped.withColumn("_chg", F.col("label") < F.col("old")).drop("old"))
        changed = new.where("_chg").count()
        labels = new.select("title", "label")
        if changed == 0:
            break
    return labels.select("title", F.col("label").alias("community"))
