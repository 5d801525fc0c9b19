"""Traversals over an edge table, answering a whole *table* of questions per run.

All queries advance together, one graph level per iteration (level-synchronous
BFS).  Each iteration is a join of the frontier with the edges on the node key,
a min-aggregation per (query, node) and an anti-join against what that query
has already visited -- all shuffles keyed by (query, node), so a hub node or a
large query is spread over many tasks.  Only a frontier row count returns to
the driver per level; lineage is cut with reliable ``checkpoint()`` into the
session's checkpoint folder, so a lost executor recomputes at most one level.

Tie-break rule (fixed so results are deterministic): among shortest paths the
lexicographically smallest title array is returned.  Keeping ``min(path)`` per
(query, node) at every level is enough to produce it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from linkweave.operators import bitsearch as BS
from linkweave.operators.topk import top_k_per_group
from linkweave.session import checkpoint_dir, sweep

# Visited frames are re-materialised as one checkpoint every this many levels
# so the anti-join plan does not grow with the number of levels.
_VISITED_COMPACT_EVERY = 8
# Level bound of an unlimited search: it ends when the frontier is empty, as
# every level visits a new node and a graph has fewer nodes than this.
_UNLIMITED_LEVELS = 1 << 62
# Size check of the path search: a graph of at most so many edges and nodes (4 bytes
# each) is broadcast, if more than a few questions share it.
_SENT_EDGES = 12_000_000
_SENT_NODES = 4_000_000
_FEW_QUESTIONS = 128
# So many questions of a bidirectional search are on their way at a time.
_SLICE_QUESTIONS = 200_000
# So many numbers reach the questions of a neighbourhood level at a time.
_SLICE_NUMBERS = 400_000_000
_ID_BITS = 40  # rank inside the range partition; see encode_graph


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _ckpt(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _ckpt_obs(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """Reliable checkpoint that also returns aggregate metrics of the same pass."""
    checkpoint_dir(df.sparkSession)
    obs = Observation()
    out = df.observe(obs, *[m.alias(k) for k, m in metrics.items()]).checkpoint(eager=True)
    return out, obs.get


class KeyedEdges:
    """Edge table materialised once per traversal, hash-partitioned on (``key``, salt).

    The edges are first written as a reliable checkpoint (lineage cut), then
    kept partitioned in memory/disk on top of it, so each level shuffles only
    the frontier.  A lost cached block is rebuilt from the checkpoint files
    with one shuffle.

    Skew: a node is *hot* when it holds more than ``1/n`` of all edges (``n``
    = shuffle partitions), so at most ``n`` nodes are hot -- a proven bound
    that makes the hot set safe to broadcast.  A hot node's edges get a salt
    (hash of the other endpoint) with one value per ``1/n`` of all edges that
    the node holds, and frontier rows at it are replicated once per salt, so a
    hub with a third of all edges is expanded by ``n/3`` tasks and the salts of
    all hot nodes are at most ``2n``.  Other nodes use salt 0.
    """

    def __init__(self, edges: DataFrame, key: str = "src", extra: tuple[str, ...] = (), fixed: bool = False, also: tuple[str, ...] = ()):
        """``extra``: further edge columns to keep; ``fixed``: ``edges`` is a checkpoint already;
        ``also``: edge columns that a frontier row must equal too, under the name without its first letter."""
        n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        other = "dst" if key == "src" else "src"
        extra = (*extra, *also)
        self.also = also
        base = edges.select("src", "dst", *extra)
        if fixed:
            rows = base.count()
        else:
            base, m = _ckpt_obs(base, n=F.count(F.lit(1)))
            rows = int(m["n"] or 0)
        threshold = max(rows // n, 1)
        self.key = key
        self.hot, hm = _ckpt_obs(
            base.groupBy(key)
            .agg(F.count(F.lit(1)).alias("_deg"))
            .where(F.col("_deg") > threshold)
            .select(F.col(key).alias("_hot"), F.ceil(F.col("_deg") / F.lit(threshold)).cast("int").alias("_salts")),
            n=F.count(F.lit(1)),
        )  # at most n rows
        self.salted = int(hm["n"] or 0) > 0
        if not self.salted:
            # No hub: plain partitioning on the key, plain join per level.
            self.df = base.repartition(n, key, *also).persist(StorageLevel.MEMORY_AND_DISK)
            self.df.count()
            return
        salted = base.join(F.broadcast(self.hot), base[key] == F.col("_hot"), "left").select(
            "src",
            "dst",
            *extra,
            F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(other), F.col("_salts")))
            .otherwise(F.lit(0))
            .cast("int")
            .alias("_es"),
        )
        self.df = salted.repartition(n, key, *also, "_es").persist(StorageLevel.MEMORY_AND_DISK)
        self.df.count()

    def expand(self, frontier: DataFrame, node_col: str = "node", hashed: bool = False) -> DataFrame:
        """Frontier rows joined with the edges whose ``key`` is the row's node; ``hashed``: without a sort of all edges."""
        if not self.salted:
            frontier = frontier.hint("shuffle_hash") if hashed else frontier
            return frontier.join(self.df, self._meets(frontier, node_col)).drop(*self.also)
        salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(
            F.array(F.lit(0))
        )
        f = (
            frontier.join(F.broadcast(self.hot), frontier[node_col] == F.col("_hot"), "left")
            .withColumn("_fs", F.explode(salts))
            .drop("_hot", "_salts")
        )
        f = f.hint("shuffle_hash") if hashed else f
        return f.join(self.df, self._meets(f, node_col) & (f["_fs"] == self.df["_es"])).drop("_fs", "_es", *self.also)

    def _meets(self, frontier: DataFrame, node_col: str):
        cond = frontier[node_col] == self.df[self.key]
        for c in self.also:
            cond = cond & (frontier[c[1:]] == self.df[c])
        return cond

    def unpersist(self) -> None:
        self.df.unpersist()


def _nodes_of(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.col("src").alias("node"))
        .unionByName(edges.select(F.col("dst").alias("node")))
        .distinct()
    )


def symmetrize(edges: DataFrame) -> DataFrame:
    """Undirected view: both directions of every edge, distinct."""
    return (
        edges.select("src", "dst")
        .unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        .distinct()
    )


def _classify(queries: DataFrame, nodes: DataFrame | None, edges: DataFrame, default_depth: int):
    """Attach node-existence flags; returns (classified queries, node table)."""
    nodes = _nodes_of(edges) if nodes is None else nodes.select(F.col("title").alias("node"))
    q = queries.select(
        "query_id",
        "from",
        "to",
        F.coalesce(F.col("max_depth"), F.lit(default_depth)).cast("int").alias("max_depth"),
    )
    q = (
        q.join(nodes.select(F.col("node").alias("from"), F.lit(True).alias("from_ok")), "from", "left")
        .join(nodes.select(F.col("node").alias("to"), F.lit(True).alias("to_ok")), "to", "left")
        .select(
            "query_id",
            "from",
            "to",
            "max_depth",
            (F.coalesce("from_ok", F.lit(False)) & F.coalesce("to_ok", F.lit(False))).alias("ok"),
        )
    )
    return q


def _trivial(q: DataFrame) -> DataFrame:
    """Results that need no search: missing end, same node, zero limit."""
    same = F.col("ok") & (F.col("from") == F.col("to"))
    return q.where(~F.col("ok") | (F.col("from") == F.col("to")) | (F.col("max_depth") == 0)).select(
        "query_id",
        "from",
        "to",
        same.alias("found"),
        F.when(same, F.array(F.col("from"))).alias("path"),
        F.when(same, F.lit(0)).alias("hops"),
        F.when(same, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("explored"),
    )


def _active(q: DataFrame) -> DataFrame:
    return q.where(_is_active())


def _is_active():
    return F.col("ok") & (F.col("from") != F.col("to")) & (F.col("max_depth") != 0)


def _classified(queries, nodes, edges, default_depth) -> tuple[DataFrame, int, int]:
    """Checkpointed classified queries, number of active ones, level bound."""
    q, m = _ckpt_obs(
        _classify(queries, nodes, edges, default_depth),
        n=F.count_if(_is_active()),
        hi=F.max(F.when(_is_active(), F.col("max_depth"))),
        lo=F.min(F.when(_is_active(), F.col("max_depth"))),
    )
    n = int(m["n"] or 0)
    if n == 0:
        return q, 0, 0
    bound = _UNLIMITED_LEVELS if m["lo"] is not None and m["lo"] < 0 else int(m["hi"])
    return q, n, bound


def _assemble(q: DataFrame, found: list[DataFrame], explored: list[DataFrame]) -> DataFrame:
    spark = q.sparkSession
    found_df = (
        union_all(found)
        if found
        else spark.createDataFrame([], "query_id long, path array<string>, hops int")
    )
    expl_df = union_all(explored) if explored else spark.createDataFrame([], "query_id long, n long")
    expl_df = expl_df.groupBy("query_id").agg(F.sum("n").alias("explored"))
    searched = (
        _active(q)
        .select("query_id", "from", "to")
        .join(found_df, "query_id", "left")
        .join(expl_df, "query_id", "left")
        .select(
            "query_id",
            "from",
            "to",
            F.col("path").isNotNull().alias("found"),
            "path",
            F.col("hops").cast("int").alias("hops"),
            F.coalesce("explored", F.lit(0)).cast("long").alias("explored"),
        )
    )
    return _trivial(q).unionByName(searched)


def encode_graph(edges: DataFrame, nodes: DataFrame | None = None, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """``long`` ids in title order: ``(ids(title, id), edges(src, dst) as ids)``; ``once``: repeated edges count once.

    Ids follow title order, so the minimum of id arrays is the minimum of the
    title arrays they stand for; paths, joins and shuffles then carry 8-byte
    keys instead of strings.  Ids come from a range-partitioned sort: the
    partition index fills the high bits and the rank inside the partition the
    low bits (no one-task window, no global numbering pass).
    """
    titles = _nodes_of(edges).select(F.col("node").alias("title")) if nodes is None else nodes.select("title")
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = titles.distinct().repartitionByRange(n, "title").withColumn("_pid", F.spark_partition_id())
    # Range partitions are ordered, so (partition index, rank inside it) is an
    # order-preserving id without any global numbering pass.
    ids = _ckpt(
        ranged.select(
            "title",
            (F.col("_pid").cast("long") * F.lit(1 << _ID_BITS)
             + F.row_number().over(Window.partitionBy("_pid").orderBy("title"))).alias("id"),
        )
    )
    enc = (
        edges.select("src", "dst")
        .join(ids.select(F.col("title").alias("src"), F.col("id").alias("s")), "src")
        .join(ids.select(F.col("title").alias("dst"), F.col("id").alias("d")), "dst")
        .select(F.col("s").alias("src"), F.col("d").alias("dst"))
    )
    enc = _ckpt(enc.distinct() if once else enc)
    sweep(edges.sparkSession)
    return ids, enc


def _numbering(nodes: DataFrame):
    """(number of the first node of every range partition and the end, column -> number column) for ids of :func:`encode_graph`.

    A node's number is its place in title order: an int, while there are not too many nodes.
    """
    nth = (1 << _ID_BITS) - 1
    pid = F.shiftright("title", _ID_BITS).cast("int").alias("pid")
    parts = nodes.groupBy(pid).agg(F.max(F.col("title").bitwiseAND(F.lit(nth))).alias("n")).collect()  # a row per partition
    first = np.zeros(max((r.pid for r in parts), default=-1) + 2, np.int64)
    for r in parts:
        first[r.pid + 1] = r.n
    first = np.cumsum(first)
    before = F.array(*[F.lit(int(x) - 1).cast("long") for x in first])
    kind = "int" if first[-1] < 1 << 31 else "long"

    def number(c: str):
        return (F.get(before, F.shiftright(c, _ID_BITS).cast("int")) + F.col(c).bitwiseAND(F.lit(nth))).cast(kind)

    return first, number


def _encoded_queries(queries: DataFrame, ids: DataFrame) -> DataFrame:
    """Queries with ``from``/``to`` replaced by ids (NULL when the title is no node)."""
    return (
        queries.select("query_id", "from", "to", "max_depth")
        .join(ids.select(F.col("title").alias("from"), F.col("id").alias("_f")), "from", "left")
        .join(ids.select(F.col("title").alias("to"), F.col("id").alias("_t")), "to", "left")
        .select("query_id", F.col("_f").alias("from"), F.col("_t").alias("to"), "max_depth")
    )


def _decode(result: DataFrame, queries: DataFrame, ids: DataFrame) -> DataFrame:
    """Map id paths back to titles; restore the requested ``from``/``to`` text.

    The regrouping is per found query and holds one row per path element, so
    each group is bounded by the path length.
    """
    titles = queries.select("query_id", F.col("from").alias("_from"), F.col("to").alias("_to"))
    elems = result.where(F.col("path").isNotNull()).select(
        "query_id", F.posexplode("path").alias("pos", "id")
    )
    paths = (
        elems.join(ids, "id")
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "title"))).alias("_p"))
        .select("query_id", F.transform("_p", lambda x: x["title"]).alias("_path"))
    )
    rest = [c for c in result.columns if c not in ("query_id", "from", "to", "found", "path")]
    return (
        result.join(titles, "query_id")
        .join(paths, "query_id", "left")
        .select(
            "query_id",
            F.col("_from").alias("from"),
            F.col("_to").alias("to"),
            "found",
            F.col("_path").alias("path"),
            *rest,
        )
    )


def shortest_paths(
    edges: DataFrame,
    queries: DataFrame,
    nodes: DataFrame | None = None,
    default_depth: int = -1,
    encode: bool = True,
) -> DataFrame:
    """P1/P2/P4 on a title graph; ``encode`` runs the search on dense long ids."""
    if not encode:
        return _bfs_paths(edges, queries, nodes, default_depth)
    ids, enc = encode_graph(edges, nodes)
    q = queries.select("query_id", "from", "to", "max_depth")
    res = _bfs_paths(enc, _encoded_queries(q, ids), ids.select(F.col("id").alias("title")), default_depth, fixed=True, encoded=True)
    return _decode(res, q, ids)


def shortest_paths_bidirectional(
    edges: DataFrame,
    queries: DataFrame,
    nodes: DataFrame | None = None,
    default_depth: int = -1,
    encode: bool = True,
) -> DataFrame:
    """P3 on a title graph; ``encode`` runs the search on dense long ids."""
    if not encode:
        return _bidi_paths(edges, queries, nodes, default_depth)
    ids, enc = encode_graph(edges, nodes, once=True)
    q = queries.select("query_id", "from", "to", "max_depth")
    res = _bidi_paths(enc, _encoded_queries(q, ids), ids.select(F.col("id").alias("title")), default_depth, fixed=True)
    return _decode(res, q, ids)


def _slots(active: DataFrame) -> DataFrame:
    """(query_id, to, max_depth, word, bit, mask): a bit of a 64-bit word for every question, words filled in order.

    Numbered inside range partitions, as in :func:`encode_graph`.
    """
    n = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = active.groupBy("query_id").agg(F.max("to").alias("to"), F.max("max_depth").alias("max_depth"))
    ranged = one.repartitionByRange(n, "query_id").withColumn("_pid", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("_pid").orderBy("query_id")) - 1
    return _ckpt(
        ranged.withColumn("_n", nth)
        .select("query_id", "to", "max_depth", (F.col("_pid").cast("long") * F.lit(1 << 40) + F.floor(F.col("_n") / 64)).alias("word"), F.pmod("_n", F.lit(64)).alias("bit"))
        .withColumn("mask", F.expr("shiftleft(1L, bit)"))
    )


def _cells(frames: list[DataFrame], *keys: str) -> DataFrame:
    """One cell per key over all frames."""
    none = F.lit(0).cast("long")  # keeps Spark from carrying a checkpoint's column constraints through a bare union
    merged = union_all([f.select(*keys, (F.col("bits").bitwiseOR(none)).alias("bits")) for f in frames])
    return merged.groupBy(*keys).agg(F.bit_or("bits").alias("bits"))


def _bit_counts(cells: list[DataFrame], slots: DataFrame) -> DataFrame:
    """(query_id, n): number of cells in which a question's bit is set, a row per question and frame."""
    sums = [F.sum(F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(1))) for i in range(64)]
    per = union_all([c.groupBy("word").agg(F.array(*sums).alias("counts")) for c in cells])
    return slots.join(per, "word").select("query_id", F.element_at("counts", F.col("bit") + 1).alias("n"))


def _bfs_paths(
    edges: DataFrame,
    queries: DataFrame,
    nodes: DataFrame | None = None,
    default_depth: int = -1,
    fixed: bool = False,
    encoded: bool = False,
) -> DataFrame:
    """Directed BFS for a table ``(query_id, from, to, max_depth)``.

    ``max_depth`` < 0 means unlimited; a path is found iff its length is
    ``<= max_depth``.  ``explored`` counts the nodes expanded, whole levels.

    With ``encoded`` (ids of :func:`encode_graph`) a graph that is small enough is
    sent to the workers, which search whole blocks of questions on it
    (:mod:`linkweave.operators.bitsearch`).  Else the graph stays distributed:

    64 questions share a row: a level is a table of cells ``(node, word, bits)``
    with a bit for every question of the word that reaches the node there first,
    so where questions see the same nodes the cells are far fewer than the
    (question, node) pairs.  No cell carries a path.  Before a level is expanded
    the in-edges of the targets tell which questions end behind it, so the last
    and largest level is never made.  Paths are then read backwards along the
    levels, with the smallest rest of the path per (question, node).
    """
    q, n_active, bound = _classified(queries, nodes, edges.select("src", "dst"), default_depth)
    if n_active == 0:
        return _assemble(q, [], [])
    if encoded and n_active > _FEW_QUESTIONS:
        sent = _sent_graph(edges, nodes)
        if sent is not None:
            found = _block_searches(_active(q), n_active, *sent)
            return _assemble(q, [found.where("path IS NOT NULL").drop("n")], [found.select("query_id", "n")])
    keyed = KeyedEdges(edges, "src", fixed=fixed)
    into = KeyedEdges(edges, "dst", fixed=fixed)
    slots = _slots(_active(q))
    still = slots.withColumn("hops", F.lit(None).cast("int"))
    # Cells from which a step reaches a target.
    gates = _ckpt(
        into.expand(slots.groupBy("word", F.col("to").alias("node")).agg(F.bit_or("mask").alias("wanted")))
        .select(F.col("src").alias("node"), "word", F.col("dst").alias("to"), "wanted")
        .distinct()
    )
    starts = _active(q).select("query_id", F.col("from").alias("node"))
    frontier = _ckpt(starts.join(slots, "query_id").groupBy("node", "word").agg(F.bit_or("mask").alias("bits")))
    levels, visited = [frontier], [frontier]
    # A question that is there more than once starts from as many rows.
    explored = [starts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))]
    uncounted: list[DataFrame] = []
    found: list[DataFrame] = []
    level = 0
    while level < bound:
        level += 1
        hits = (
            frontier.join(gates, ["node", "word"])
            .groupBy("word", "to")
            .agg(F.bit_or(F.col("bits").bitwiseAND(F.col("wanted"))).alias("got"))
        )
        hit = F.coalesce(F.col("got").bitwiseAND(F.col("mask")) != 0, F.lit(False))
        goes = (F.col("max_depth") < 0) | (F.col("max_depth") > level)
        step, m = _ckpt_obs(
            still.join(hits, ["word", "to"], "left")
            .withColumns({"hit": hit, "hops": F.lit(level)})
            .where(F.col("hit") | goes)
            .select(*still.columns, "hit"),
            hits=F.count_if("hit"),
            open=F.count_if(~F.col("hit")),
        )
        found.append(step.where("hit").drop("hit") if int(m["hits"] or 0) else None)
        still = step.where("NOT hit").drop("hit")
        if not int(m["open"] or 0):
            break
        # One row per 64 questions that go on.
        alive = still.groupBy("word").agg(F.bit_or("mask").alias("alive"))
        grow = frontier.join(F.broadcast(alive), "word").withColumn("bits", F.col("bits").bitwiseAND(F.col("alive")))
        none = F.lit(0).cast("long")
        reached = keyed.expand(grow.where("bits <> 0").drop("alive")).select(F.col("dst").alias("node"), "word", F.col("bits").alias("new"), none.alias("old"))
        been = union_all(visited).select("node", "word", none.alias("new"), F.col("bits").alias("old"))
        frontier, m = _ckpt_obs(
            reached.unionByName(been)
            .groupBy("node", "word")
            .agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
            .select("node", "word", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("bits"))
            .where("bits <> 0"),
            n=F.count(F.lit(1)),
        )
        if not int(m["n"] or 0):
            break
        sweep(edges.sparkSession)
        levels.append(frontier)
        visited.append(frontier)
        uncounted.append(frontier)
        if len(visited) >= _VISITED_COMPACT_EVERY:
            visited = [_ckpt(_cells(visited, "node", "word"))]
            explored.append(_ckpt(_bit_counts(uncounted, slots)))
            uncounted = []
    if uncounted:
        explored.append(_bit_counts(uncounted, slots))
    paths = _paths_back(into, levels, found)
    keyed.unpersist()
    into.unpersist()
    return _assemble(q, paths, explored)


def _sent_graph(edges: DataFrame, nodes: DataFrame) -> tuple[BS.InEdges, np.ndarray] | None:
    """(in-edges, first of :func:`_numbering`), or None if the graph is too large to be sent."""
    first, number = _numbering(nodes)
    if first[-1] > _SENT_NODES or edges.count() > _SENT_EDGES:
        return None
    pairs = edges.select(number("src").alias("src"), number("dst").alias("dst")).toArrow()
    return BS.InEdges.of(pairs["src"].to_numpy(), pairs["dst"].to_numpy(), int(first[-1])), first


def _block_searches(active: DataFrame, n_active: int, graph: BS.InEdges, first: np.ndarray) -> DataFrame:
    """(query_id, path, hops, n): smallest shortest path, if any, and number of nodes visited, of every question."""
    sc = active.sparkSession.sparkContext
    parts = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = 64 * BS.row_words(len(graph.node), -(-n_active // parts))
    sent = sc.broadcast((graph, first))
    # A question that is there more than once starts from as many rows.
    asked = (
        active.where(F.col("query_id").isNotNull())
        .groupBy("query_id")
        .agg(F.max("to").alias("to"), F.max("max_depth").alias("max_depth"), F.collect_list("from").alias("starts"))
        .repartition(parts, "query_id")
    )

    def answers(batch: pd.DataFrame) -> pd.DataFrame:
        g, first = sent.value

        def numbers(ids):
            return first[ids >> _ID_BITS] + (ids & ((1 << _ID_BITS) - 1)) - 1

        def ids(path):
            at = np.asarray(path, np.int64)
            pid = np.searchsorted(first, at, side="right") - 1
            return (pid << _ID_BITS) + at - first[pid] + 1

        starts = [numbers(np.asarray(s, np.int64)) for s in batch["starts"]]
        got = BS.search(g, starts, numbers(batch["to"].to_numpy(np.int64)), batch["max_depth"].to_numpy(np.int64))
        return pd.DataFrame(
            {
                "query_id": batch["query_id"],
                "path": [None if p is None else ids(p) for p, _ in got],
                "hops": pd.array([None if p is None else len(p) - 1 for p, _ in got], dtype="Int32"),
                "n": [n + len(s) for (_, n), s in zip(got, starts, strict=True)],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            for at in range(0, len(batch), size):
                kept.append(batch.iloc[at : at + size])
                if sum(map(len, kept)) >= size:
                    rows = pd.concat(kept, ignore_index=True)
                    yield answers(rows[:size])
                    kept = [rows[size:]]
        if kept and sum(map(len, kept)):
            yield answers(pd.concat(kept, ignore_index=True))

    out = _ckpt(asked.mapInPandas(run, "query_id long, path array<long>, hops int, n long"))
    sent.destroy()
    return out


def _paths_back(into: KeyedEdges, levels: list[DataFrame], found: list[DataFrame | None]) -> list[DataFrame]:
    """Smallest path of every question that was found, as a list of frames ``(query_id, path, hops)``.

    ``found[i]`` are the questions that end one step behind ``levels[i]``.  From
    the last level to the first, a row is a node on a shortest path with the
    smallest rest of the path; rests at one level of a question are equally long,
    so the smallest rest behind the smallest of them makes the smallest path.
    """
    ends = [i for i, f in enumerate(found) if f is not None]
    if not ends:
        return []
    rest = None
    for i in range(ends[-1], -1, -1):
        if found[i] is not None:
            begun = found[i].select("query_id", "word", "mask", F.col("to").alias("node"), F.array("to").alias("path"), "hops")
            rest = begun if rest is None else rest.unionByName(begun)
        behind = (
            into.expand(rest)
            .groupBy("query_id", "word", "mask", "hops", F.col("src").alias("node"))
            .agg(F.min("path").alias("path"))
        )
        rest = _ckpt(
            behind.join(levels[i], ["node", "word"])
            .where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
            .select("query_id", "word", "mask", "node", F.concat(F.array("node"), "path").alias("path"), "hops")
        )
    return [rest.groupBy("query_id").agg(F.min("path").alias("path"), F.max("hops").alias("hops"))]


def _bidi_paths(
    edges: DataFrame,
    queries: DataFrame,
    nodes: DataFrame | None = None,
    default_depth: int = -1,
    fixed: bool = False,
) -> DataFrame:
    """Bidirectional BFS, one side per query per step (the smaller frontier; tie -> forward).

    Forward steps follow out-edges, backward steps in-edges.  The first step that
    reaches a node of the other side ends the query; ``max_depth`` bounds the
    number of steps (= path length).

    A row is ``(slot, node, lvl)``: question, node and level of its side, counted
    1, 2, .. forward and -1, -2, .. backward; none carries a path.  Each step first
    looks where it meets the other frontier (an older level would have been met
    before) and only then keeps the new nodes, and those only of questions that go
    on: the last and largest level of a question is never made.  Which questions
    go on travels as a row per 64 questions.  Paths are read back from the nodes
    of the meetings, the smallest one as in :func:`shortest_paths`.
    """
    q, n_active, bound = _classified(queries, nodes, edges.select("src", "dst"), default_depth)
    if n_active == 0:
        return _assemble(q, [], [])
    # One table for both directions, so a step is one join: forward rows meet
    # out-edges, backward rows the same edges turned round.
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(False).alias("_fwd"))
    moves = edges.select("src", "dst", F.lit(True).alias("_fwd")).unionByName(turned)
    keyed = KeyedEdges(moves, "src", fixed=fixed, also=("_fwd",))
    start = _active(q).where(F.col("query_id").isNotNull())
    slots = _slots(start).select("query_id", (F.shiftleft("word", 6) + F.col("bit")).alias("slot"))
    start = _ckpt(start.join(slots, "query_id").select("slot", "query_id", "from", "to", "max_depth"))
    paths, explored = [], []
    # The edges serve all; what is as large as the questions is there for a slice at a time.
    slices = -(-start.count() // _SLICE_QUESTIONS)
    mine = F.pmod(F.xxhash64(F.shiftright("slot", 6)), F.lit(max(slices, 1)))
    for i in range(slices):
        some_paths, some_explored = _bidi_slice(keyed, start.where(mine == i) if slices > 1 else start, bound)
        paths += some_paths
        explored += some_explored
        sweep(edges.sparkSession)
    keyed.unpersist()
    if paths:
        paths = [union_all(paths).join(slots, "slot").select("query_id", "path", (F.size("path") - 1).alias("hops"))]
    return _assemble(q, paths, explored)


def _bidi_slice(keyed: KeyedEdges, start: DataFrame, bound: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Frames (slot, path) and (query_id, n: nodes expanded) for some of the questions of :func:`_bidi_paths`."""
    asked = start.select("slot", "query_id", "max_depth")
    frontier = _ckpt(
        start.select("slot", F.col("from").alias("node"), F.lit(1).alias("lvl")).unionByName(
            start.select("slot", F.col("to").alias("node"), F.lit(-1).alias("lvl"))
        )
    )
    word, mask = F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    fwd = F.col("lvl") > 0
    visited = [frontier]
    found: list[DataFrame] = []
    explored: list[DataFrame] = []
    far_f = far_b = -1
    step_no = 0
    while step_no < bound:
        sizes = frontier.groupBy("slot").agg(F.count_if(fwd).alias("nf"), F.count_if(~fwd).alias("nb"))
        # A question that is there more than once counts as often.
        turn, m = _ckpt_obs(
            sizes.where((F.col("nf") > 0) & (F.col("nb") > 0))
            .join(asked, "slot")
            .where((F.col("max_depth") < 0) | (F.col("max_depth") > step_no))
            .select("slot", "query_id", "max_depth", (F.col("nf") <= F.col("nb")).alias("fwd"), F.least("nf", "nb").alias("n")),
            n=F.count(F.lit(1)),
        )
        if not int(m["n"] or 0):
            break
        step_no += 1
        explored.append(turn.select("query_id", "n"))
        goes = (F.col("max_depth") < 0) | (F.col("max_depth") > step_no)
        words = turn.groupBy(word).agg(
            *[F.bit_or(F.when(on, mask).otherwise(F.lit(0).cast("long"))).alias(c) for c, on in (("ahead", F.col("fwd")), ("back", ~F.col("fwd")), ("more", goes))]
        )
        met, m = _ckpt_obs(_meetings(keyed, _of_words(frontier, words)), n=F.count(F.lit(1)), f=F.max("f"), b=F.max("b"))
        if int(m["n"] or 0):
            found.append(met)
            far_f, far_b = max(far_f, int(m["f"])), max(far_b, int(m["b"]))
            ends = met.groupBy(word).agg(F.bit_or(mask).alias("ends"))
            words = words.join(ends, "word", "left").withColumn(
                "more", F.col("more").bitwiseAND(F.bitwise_not(F.coalesce("ends", F.lit(0).cast("long"))))
            ).drop("ends")
        if step_no >= bound:
            break
        # Next frontier: the side just expanded is replaced by its new nodes,
        # the other side carries over; finished and stuck queries drop out.
        words = _ckpt(words.where("more <> 0"))
        going = _of_words(frontier, words).where("more")
        old = _of_words(union_all(visited), words).where(F.col("more") & F.col("steps")).select("slot", "node", F.lit(None).cast("int").alias("lvl"), F.lit(True).alias("old"))
        frontier, m = _ckpt_obs(
            _reached(keyed, going)
            .withColumn("old", F.lit(False))
            .unionByName(old)
            .groupBy("slot", "node")
            .agg(F.max("lvl").alias("lvl"), F.max("old").alias("old"))
            .where(~F.col("old"))
            .select("slot", "node", "lvl")
            .unionByName(going.where(~F.col("steps")).select("slot", "node", "lvl")),
            n=F.count(F.lit(1)),
        )
        sweep(start.sparkSession)
        if not int(m["n"] or 0):
            break
        visited.append(frontier)
        if len(visited) >= _VISITED_COMPACT_EVERY:
            visited = [_ckpt(union_all(visited).distinct())]
    paths = [_ckpt(_meeting_paths(keyed, union_all(visited), union_all(found), far_f, far_b))] if found else []
    return paths, [_ckpt(union_all(explored).groupBy("query_id").agg(F.sum("n").alias("n")))] if explored else []


def _of_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of the questions in ``words`` with ``steps``: its side is expanded now, ``more``: the question may go on."""
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    side = F.when(F.col("lvl") > 0, F.col("ahead")).otherwise(F.col("back"))
    return (
        rows.withColumn("word", F.shiftright("slot", 6))
        .join(F.broadcast(words), "word")  # one row per 64 questions
        .where(F.col("ahead").bitwiseOR(F.col("back")).bitwiseAND(bit) != 0)
        .select("slot", "node", "lvl", (side.bitwiseAND(bit) != 0).alias("steps"), (F.col("more").bitwiseAND(bit) != 0).alias("more"))
    )


def _reached(keyed: KeyedEdges, rows: DataFrame) -> DataFrame:
    """(slot, node, lvl): ends of the steps from the rows whose side is expanded."""
    grow = rows.where("steps").select("slot", "node", "lvl", (F.col("lvl") > 0).alias("fwd"))
    onward = F.col("lvl") + F.when(F.col("fwd"), F.lit(1)).otherwise(F.lit(-1))
    return keyed.expand(grow, hashed=True).select("slot", F.col("dst").alias("node"), onward.alias("lvl"))


def _meetings(keyed: KeyedEdges, rows: DataFrame) -> DataFrame:
    """(slot, node, f, b): nodes where the expanded side reaches the other one; ``f``, ``b``: levels before and behind it."""
    none = F.lit(None).cast("int")
    other = rows.where(~F.col("steps")).select("slot", "node", none.alias("lvl"), F.col("lvl").alias("to"))
    # Reached rows have a level one further than the other side's, so both count from the node.
    ahead, back = F.greatest("lvl", "to"), -F.least("lvl", "to")
    return (
        _reached(keyed, rows)
        .withColumn("to", none)
        .unionByName(other)
        .groupBy("slot", "node")
        .agg(F.max("lvl").alias("lvl"), F.max("to").alias("to"))
        .where(F.col("lvl").isNotNull() & F.col("to").isNotNull())
        .select("slot", "node", (ahead - 1).alias("f"), (back - 1).alias("b"))
    )


def _meeting_paths(keyed: KeyedEdges, visited: DataFrame, met: DataFrame, far_f: int, far_b: int) -> DataFrame:
    """(slot, path): the smallest path of every question with a meeting.

    Behind a meeting the smallest rest goes to the smallest next node of each
    level.  Before it a row is a node on a shortest path with the smallest rest;
    rests at one level of a question are equally long, so the smallest rest
    behind the smallest node makes the smallest path.
    """

    def walk(rest: DataFrame, lvl: int) -> DataFrame:
        level = visited.where(F.col("lvl") == lvl).select("slot", F.col("node").alias("dst")).distinct()
        return keyed.expand(rest.withColumn("fwd", F.lit(lvl < 0))).drop("node").join(level, ["slot", "dst"])

    def begun(rows: DataFrame, at: str, k: int, rest: DataFrame | None) -> DataFrame:
        new = rows.where(F.col(at) == k)
        return new if rest is None else rest.unionByName(new)

    rows = met.select("slot", "node", F.col("node").alias("head"), F.array("node").alias("path"), "f", "b")
    rest = None
    for k in range(far_b, 0, -1):
        near = walk(begun(rows, "b", k, rest), -k)
        near = near.groupBy("slot", "head").agg(F.min("dst").alias("node"), F.max("path").alias("path"), F.max("f").alias("f"))
        rest = near.select("slot", "node", "head", F.concat("path", F.array("node")).alias("path"), "f", F.lit(k - 1).alias("b"))
        if k % _VISITED_COMPACT_EVERY == 0:
            rest = _ckpt(rest)
    rows = _ckpt(begun(rows, "b", 0, rest).select("slot", F.col("head").alias("node"), "path", "f"))
    rest = None
    for k in range(far_f, 0, -1):
        near = walk(begun(rows, "f", k, rest), k).groupBy("slot", F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        rest = near.select("slot", "node", F.concat(F.array("node"), "path").alias("path"), F.lit(k - 1).alias("f"))
        if k % _VISITED_COMPACT_EVERY == 0:
            rest = _ckpt(rest)
    return begun(rows, "f", 0, rest).groupBy("slot").agg(F.min("path").alias("path"))


def reachable(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int,
    cap: int | None = None,
) -> DataFrame:
    """Min hop count of every node reachable from each seed within its depth.

    ``seeds(query_id, title[, depth])`` -> ``(query_id, title, hops)`` including the seed
    at hop 0; a ``depth`` column overrides ``max_depth`` per question.  With ``cap`` (or a
    ``max_nodes`` column, which overrides it) a question is expanded no further once it has
    that many nodes after a whole level: by (hops, title) order, deeper nodes can't be among
    its first ``cap``.  Same level loop as :func:`shortest_paths`, without paths.
    """
    keyed = KeyedEdges(edges, "src")
    depth = F.coalesce(F.col("depth"), F.lit(max_depth)) if "depth" in seeds.columns else F.lit(max_depth)
    most = F.coalesce(F.col("max_nodes"), F.lit(cap)) if "max_nodes" in seeds.columns else F.lit(cap)
    frontier, m = _ckpt_obs(
        seeds.select(
            "query_id", F.col("title").alias("node"), depth.cast("int").alias("_d"), most.cast("long").alias("_cap")
        ).distinct(),
        n=F.count_if(F.col("_d") > 0),
        last=F.max("_d"),
        caps=F.count("_cap"),
    )
    capped = int(m["caps"] or 0) > 0
    last = int(m["last"] or 0)
    levels = [frontier.select("query_id", "node", F.lit(0).alias("hops"))]
    visited = [frontier.select("query_id", "node")]
    level = 0
    n = int(m["n"] or 0)
    while n > 0 and level < last:
        level += 1
        seen = union_all(visited)
        grow = frontier.where(F.col("_d") >= level)
        if capped and level > 1:
            full = (
                seen.groupBy("query_id")
                .agg(F.count(F.lit(1)).alias("_n"))
                .join(grow.select("query_id", "_cap").distinct(), "query_id")
                .where(F.col("_n") >= F.col("_cap"))
                .select("query_id")
            )
            grow = grow.join(full, "query_id", "left_anti")
        frontier, m = _ckpt_obs(
            keyed.expand(grow)
            .groupBy("query_id", F.col("dst").alias("node"))
            .agg(F.max("_d").alias("_d"), F.max("_cap").alias("_cap"))
            .join(seen, ["query_id", "node"], "left_anti"),
            n=F.count_if(F.col("_d") > level),
        )
        levels.append(frontier.select("query_id", "node", F.lit(level).alias("hops")))
        visited.append(frontier.select("query_id", "node"))
        if len(visited) >= _VISITED_COMPACT_EVERY:
            visited = [_ckpt(union_all(visited))]
        n = int(m["n"] or 0)
    keyed.unpersist()
    out = union_all(levels)
    return out.select("query_id", F.col("node").alias("title"), F.col("hops").cast("int").alias("hops"))


#: Stands for a missing title among ids: before all others, and never expanded.
_NO_ID = -1


def _capped_reach(edges: DataFrame, own: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, title, hops, _d): the first ``_cap`` nodes by (hops, title) of every question in ``own``.

    ``own`` has one row per question, with its seeds, depth and cap, and so have
    the levels here: a question holds at most ``_cap`` numbers, in title order
    level by level, and how many it had after each level.  Of a node's out-edges
    only the least ``cap`` (the largest cap asked) can count: if there are more,
    they fill the question by themselves, and a full question grows no further.
    So a node is one list of bounded length, and a level sends lists of 4-byte
    numbers to the question instead of a row per pair.  The questions of a level
    go in slices of some ``_SLICE_NUMBERS`` numbers sent, so that what a level
    shuffles at a time doesn't grow with the questions.  ``titles``: of all nodes.
    """
    spark = edges.sparkSession
    m = own.agg(F.max("_cap").alias("cap"), F.max("_d").alias("last")).first()
    cap, last = int(m["cap"] or 0), int(m["last"] or 0)
    ids, _ = encode_graph(edges.limit(0), titles.withColumnRenamed("node", "title"))
    first, number = _numbering(ids.select(F.col("id").alias("title")))
    ids = ids.select("title", number("id").alias("id"))
    kind = dict(ids.dtypes)["id"]
    no_id = F.lit(_NO_ID).cast(kind)
    pairs = (
        edges.select("src", "dst")
        .join(ids.select(F.col("title").alias("src"), F.col("id").alias("_s")), "src")
        .join(ids.select(F.col("title").alias("dst"), F.col("id").alias("_t")), "dst", "left")
        .select(F.col("_s").alias("at"), F.coalesce("_t", no_id).alias("to"))
        .distinct()
    )
    lists = top_k_per_group(pairs, ["at"], [F.col("to")], max(cap, 1), salt_cols=["to"])
    lists, m = _ckpt_obs(lists.groupBy("at").agg(F.collect_list("to").alias("to")), n=F.count(F.lit(1)), to=F.sum(F.size("to")))
    longest = -(-int(m["to"] or 0) // max(int(m["n"] or 0), 1))
    sweep(spark)
    no_rows = F.array().cast(f"array<{kind}>")
    seeds = own.select("query_id", "_d", "_cap", F.explode("_seeds").alias("title")).join(ids, "title")
    held = seeds.groupBy("query_id", "_d", "_cap").agg(F.sort_array(F.collect_list("id")).alias("all"))
    held = held.select("query_id", "_d", "_cap", F.slice("all", 1, F.col("_cap")).alias("kept"))
    held = _ckpt(held.withColumn("ends", F.array(F.size("kept"))))

    def grown(held: DataFrame, level: int) -> DataFrame:
        near = (
            held.where(grows(level))
            .select(F.col("query_id").alias("_q"), F.explode(new).alias("at"))
            .join(lists, "at")
            .groupBy("_q")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("to")))).alias("near"))
        )
        been = F.filter("kept", lambda x: x != no_id)
        room = F.greatest(F.col("_cap") - F.size("kept"), F.lit(0))
        met = held.join(near, F.col("query_id").eqNullSafe(F.col("_q")), "left").select(
            "query_id", "_d", "_cap", "ends", "kept", F.slice(F.array_except(F.coalesce("near", no_rows), been), 1, room).alias("met")
        )
        kept = F.concat("kept", "met")
        return _ckpt(met.select("query_id", "_d", "_cap", kept.alias("kept"), F.concat("ends", F.array(F.size(kept))).alias("ends")))

    # What the last level added; a missing title is never expanded.
    begun = F.coalesce(F.get("ends", F.size("ends") - 2), F.lit(0))
    new = F.filter(F.slice("kept", begun + 1, F.size("kept") - begun), lambda x: x != no_id)

    def grows(level: int):
        return (F.col("_d") >= level) & (F.size("kept") < F.col("_cap")) & (F.size(new) > 0)

    for level in range(1, last + 1):
        sent = held.where(grows(level)).agg(F.sum(F.size(new)).alias("n")).first()["n"]
        if not sent:
            break
        slices = -(-int(sent) * longest // _SLICE_NUMBERS)
        mine = F.pmod(F.xxhash64("query_id"), F.lit(slices))
        parts = []
        for i in range(slices):
            parts.append(grown(held.where(mine == i) if slices > 1 else held, level))
            sweep(spark)
        held = union_all(parts)
    hops = F.size(F.filter("ends", lambda x: x <= F.col("_pos")))
    flat = held.select("query_id", "_d", "ends", F.posexplode("kept").alias("_pos", "id")).select("query_id", "_d", hops.alias("hops"), "id")
    return flat.join(ids.hint("shuffle_hash"), "id", "left").select("query_id", "title", F.col("hops").cast("int").alias("hops"), "_d")


def neighborhood(
    edges: DataFrame,
    centres: DataFrame,
    depth: int = 2,
    max_nodes: int = 1000,
    nodes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Out-edge neighbourhood of each centre ``(query_id, title[, depth][, max_nodes])``.

    Nodes: min hop per node, capped at ``max_nodes`` by (hops, title).  Edges:
    every out-edge of a kept node with hops < depth whose target is kept.
    Centres that are not nodes of the graph give no rows.  ``depth`` and
    ``max_nodes`` columns override the arguments per centre.
    """
    node_tbl = _ckpt(_nodes_of(edges)) if nodes is None else nodes.select(F.col("title").alias("node"))
    limits = [c for c in ("depth", "max_nodes") if c in centres.columns]
    centres = centres.select("query_id", "title", *limits).join(
        node_tbl.select(F.col("node").alias("title")), "title", "left_semi"
    )
    own = centres.groupBy("query_id").agg(
        F.collect_set("title").alias("_seeds"),
        F.coalesce(F.max("depth") if "depth" in limits else F.lit(None), F.lit(depth)).cast("int").alias("_d"),
        F.coalesce(F.max("max_nodes") if "max_nodes" in limits else F.lit(None), F.lit(max_nodes)).cast("int").alias("_cap"),
    )
    # Not fixed here: it is one join away from the lists of the questions, which are far smaller.
    kept = _capped_reach(edges, own, node_tbl if nodes is None else _nodes_of(edges).unionByName(node_tbl).distinct())
    inner = kept.where(F.col("hops") < F.col("_d")).select("query_id", F.col("title").alias("src"))
    sub_edges = (
        inner.join(edges.select("src", "dst"), "src")
        .join(kept.select("query_id", F.col("title").alias("dst")), ["query_id", "dst"], "left_semi")
        .select("query_id", F.col("src").alias("source"), F.col("dst").alias("target"))
    )
    return kept.drop("_d"), sub_edges


def neighborhood_direction(
    edges: DataFrame,
    centres: DataFrame,
    direction: str = "outgoing",
    depth: int = 2,
    max_nodes: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """N1 over outgoing, incoming or both directions."""
    if direction == "outgoing":
        e = edges.select("src", "dst")
    elif direction == "incoming":
        e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    elif direction == "both":
        e = symmetrize(edges)
    else:
        raise ValueError(f"direction must be outgoing, incoming or both, not {direction!r}")
    return neighborhood(e, centres, depth, max_nodes)


def connections_undirected(
    edges: DataFrame,
    centres: DataFrame,
    depth: int = 2,
    limit: int = 100,
    include_start: bool = False,
) -> DataFrame:
    """Distinct titles within 1..depth hops ignoring direction, first ``limit`` by title."""
    reach = reachable(symmetrize(edges), centres.select("query_id", "title"), depth)
    if not include_start:
        reach = reach.where(F.col("hops") > 0)
    return top_k_per_group(
        reach.select("query_id", "title"), ["query_id"], [F.col("title")], limit, salt_cols=["title"]
    )


def subgraph_counts(sub_nodes: DataFrame, sub_edges: DataFrame) -> DataFrame:
    """Node and edge count per neighbourhood query."""
    n = sub_nodes.groupBy("query_id").agg(F.count(F.lit(1)).alias("node_count"))
    e = sub_edges.groupBy("query_id").agg(F.count(F.lit(1)).alias("edge_count"))
    return n.join(e, "query_id", "left").select(
        "query_id", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count")
    )


def shortest_paths_undirected(edges: DataFrame, queries: DataFrame, default_depth: int = 6) -> DataFrame:
    """P5: shortest path ignoring direction, length >= 1 (from = to gives no path)."""
    res = shortest_paths(symmetrize(edges), queries, default_depth=default_depth)
    same = F.col("from") == F.col("to")
    return res.select(
        "query_id",
        "from",
        "to",
        F.when(same, F.lit(False)).otherwise(F.col("found")).alias("found"),
        F.when(same, F.lit(None)).otherwise(F.col("path")).alias("path"),
        F.when(same, F.lit(None)).otherwise(F.col("hops")).cast("int").alias("hops"),
    )
