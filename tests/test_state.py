"""Projection, maintenance, validation, ingest and similarity cases."""

import datetime as dt

from pyspark.sql import functions as F

from linkweave.functions import text as X
from linkweave.operators import graph as G
from linkweave.operators import ingest as IN
from linkweave.operators import maintain as M
from linkweave.operators import rank as RK
from linkweave.operators import similarity as SIM
from linkweave.operators import stats as ST
from linkweave.operators import validate as V
from linkweave.sources import schemas as S

T0 = dt.datetime(2024, 1, 1)


def pages_df(spark, rows):
    full = [
        (i, t, h, st, rd, T0 if st not in ("pending",) else None, T0, T0)
        for i, t, h, st, rd in rows
    ]
    return spark.createDataFrame(full, S.PAGES)


def links_df(spark, rows):
    return spark.createDataFrame([(s, t, T0) for s, t in rows], S.LINKS)


def test_projection_cases(spark):
    p = pages_df(spark, [(1, "A", "h", "success", None), (2, "B", "h", "success", None), (3, "C", "h", "success", None)])
    lk = links_df(spark, [(1, "B"), (1, "C"), (2, "C")])
    nodes, edges = G.project(p, lk)
    assert nodes.count() == 3 and edges.count() == 3
    deg = {r["title"]: r["in_degree"] for r in G.degrees(edges, nodes).collect()}
    assert deg["C"] == 2
    p2 = pages_df(spark, [(1, "A", "h", "success", None), (2, "B", None, "pending", None)])
    n2, e2 = G.project(p2, links_df(spark, [(1, "B"), (2, "A")]))
    assert n2.count() == 2 and e2.count() == 1


def test_maintenance_cases(spark):
    p = pages_df(spark, [(1, "Existing", None, "pending", None)])
    out = M.ensure_pages(p, spark.createDataFrame([("Existing",), ("New1",), ("New2",)], "title string"), T0)
    assert out.count() == 3 and sorted(r["id"] for r in out.collect()) == [1, 2, 3]
    lk = links_df(spark, [])
    added = M.add_links(lk, spark.createDataFrame([(1, "T"), (1, "T"), (1, "x" * 513)], "source_id long, target_title string"), T0)
    assert added.count() == 1
    assert M.delete_links(added, spark.createDataFrame([(1,)], "source_id long")).count() == 0
    upd = spark.createDataFrame(
        [("Existing", "redirect", "", "Target", T0), ("Existing", "success", "abc", "", T0 + dt.timedelta(1))],
        "title string, fetch_status string, content_hash string, redirect_to string, updated_at timestamp_ntz",
    )
    r = M.update_status(p, upd).collect()[0]
    assert r["fetch_status"] == "success" and r["content_hash"] == "abc" and r["redirect_to"] is None
    pages2, links2 = M.delete_pages(
        pages_df(spark, [(1, "A", None, "success", None)]), links_df(spark, [(1, "B")]),
        spark.createDataFrame([("A",)], "title string"),
    )
    assert pages2.count() == 0 and links2.count() == 0


def test_validation_and_stats(spark):
    bad = spark.createDataFrame(
        [(1, "A", None, "bogus", None, None, T0, T0), (2, "B", None, "redirect", None, T0, T0, T0),
         (3, "C", None, "success", None, None, T0, T0)],
        S.PAGES,
    )
    rules = sorted(r["rule"] for r in V.constraint_violations(bad, links_df(spark, [])).collect())
    assert rules == ["fetched_at_required", "fetched_at_required", "redirect_target", "status_domain"]
    p = pages_df(spark, [(1, "A", "h", "success", None), (2, "B", "h", "success", None), (3, "C", None, "pending", None),
                         (4, "D", None, "redirect", "A"), (5, "E", None, "error", None)])
    s = ST.page_stats(p, links_df(spark, [(1, "B"), (1, "C"), (2, "C")])).collect()[0]
    assert (s["total_pages"], s["success_pages"], s["pending_pages"], s["redirect_pages"], s["error_pages"],
            s["total_links"]) == (5, 2, 1, 1, 1, 3)
    v = {r["title"]: r["valid"] for r in V.valid_title(spark.createDataFrame([("ok",), ("a[b",), ("",)], "title string")).collect()}
    assert v == {"ok": True, "a[b": False, "": False}


def test_link_extraction_rules(spark):
    html = (
        '<div id="mw-content-text"><a href="/wiki/Test">x</a><a href="/wiki/Test">x</a>'
        '<a href="/wiki/Test#section">x</a><a href="/wiki/Talk:Foo">t</a><a href="/wiki/Category:Bar">c</a>'
        '<a href="/wiki/Mercury_(planet)">m</a><a href="/wiki/Mercury_(disambiguation)">d</a>'
        '<a href="/wiki/Schr%C3%B6dinger%27s_cat">s</a><a href="/wiki/C++">c</a><a href="/wiki/100%_x">p</a>'
        '<a href="https://example.com">e</a><a href="//example.com">p</a></div>'
        '<div id="footer"><a href="/wiki/Footer_Link">f</a></div>'
    )
    pages = spark.createDataFrame([(1, "u", html)], S.HTML_PAGES)
    expect = {"Test", "Mercury (planet)", "Schrödinger's cat", "C++", "100%_x"}
    scoped = {r["target_title"] for r in IN.extract_links(pages, scoped=True).collect()}
    assert scoped == expect
    unscoped = {r["target_title"] for r in IN.extract_links(pages).collect()}
    assert unscoped == expect | {"Footer Link"}


def test_url_functions(spark):
    df = spark.createDataFrame(
        [("Albert Einstein",), ("Schrödinger's cat",), ("C++",)], "title string"
    ).select(X.title_to_url("title").alias("u"))
    assert [r["u"] for r in df.collect()] == [
        "https://en.wikipedia.org/wiki/Albert_Einstein",
        "https://en.wikipedia.org/wiki/Schr%C3%B6dinger%27s_cat",
        "https://en.wikipedia.org/wiki/C++",
    ]
    red = spark.createDataFrame(
        [
            ("https://en.wikipedia.org/wiki/Einstein", "https://en.wikipedia.org/wiki/Albert_Einstein"),
            ("https://en.wikipedia.org/wiki/Albert_Einstein", "https://en.wikipedia.org/wiki/Albert_Einstein"),
            ("https://en.wikipedia.org/wiki/Schr%C3%B6dinger", "https://en.wikipedia.org/wiki/Erwin_Schr%C3%B6dinger"),
        ],
        "o string, f string",
    ).select(X.redirect_target("o", "f").alias("r"))
    assert [r["r"] for r in red.collect()] == ["Albert Einstein", "", "Erwin Schrödinger"]
    h = spark.createDataFrame([("hello world",)], "t string").select(X.content_hash("t").alias("h")).first()["h"]
    assert len(h) == 32


def test_classify_fetches(spark):
    pages = pages_df(spark, [(1, "Same", None, "pending", None)]).withColumn("content_hash", F.md5(F.lit("<p/>")))
    res = spark.createDataFrame(
        [("Err", 500, None, None, "boom"), ("Gone", 404, None, None, None),
         ("Moved", 200, "https://en.wikipedia.org/wiki/Other_Page", "<p/>", None),
         ("Same", 200, "https://en.wikipedia.org/wiki/Same", "<p/>", None),
         ("Fresh", 200, "https://en.wikipedia.org/wiki/Fresh", "<a/>", None)],
        S.FETCH_RESULTS,
    )
    got = {r["title"]: (r["outcome"], r["fetched"], r["skipped"], r["redirect_to"])
           for r in IN.classify_fetches(res, pages).collect()}
    assert got["Err"] == ("error", False, False, None)
    assert got["Gone"] == ("not_found", False, True, None)
    assert got["Moved"] == ("redirect", False, True, "Other Page")
    assert got["Same"] == ("success", False, True, None)
    assert got["Fresh"] == ("success", True, False, None)


def test_cosine_and_topk_paths_agree(spark):
    vec = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.6, 0.8]), (6, [0.0, 0.0])],
        "vec_id long, embedding array<float>",
    )
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 6)], "left_id long, right_id long")
    s = {r["right_id"]: r["score"] for r in SIM.cosine_pairs(pairs, vec).collect()}
    assert s == {2: 1.0, 3: 0.0, 4: -1.0, 6: 0.0}
    q = vec.select(F.col("vec_id").alias("query_id"), "embedding")
    a = sorted(tuple(r) for r in SIM.similar_topk(q, vec, 3, exclude_self=True).collect())
    b = sorted(tuple(r) for r in SIM.similar_topk(q, vec, 3, exclude_self=True, broadcast_max=0, blocks=3).collect())
    assert a == b and len(a) == 18


def test_redirects_and_components(spark):
    p = pages_df(spark, [(1, "A", None, "redirect", "B"), (2, "B", None, "redirect", "C"), (3, "C", "h", "success", None),
                         (4, "X", None, "redirect", "Y"), (5, "Y", None, "redirect", "X")])
    r = {row["title"]: (row["final_title"], row["depth"], row["resolved"]) for row in RK.resolve_redirects(p).collect()}
    assert r["A"] == ("C", 1, True) and r["B"] == ("C", 0, True)
    assert r["X"][2] is False and r["Y"][2] is False
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e")], "src string, dst string")
    n = G.graph_nodes(e)
    comp = {row["title"]: row["community"] for row in RK.communities(e, n).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_similar_approx_scores_are_exact(spark):
    from conftest import SMOKE_DIR

    vec = spark.read.parquet(f"{SMOKE_DIR}/embeddings.parquet").select("vec_id", "embedding")
    approx = SIM.similar_approx(vec, k=10)
    pairs = approx.select(F.col("query_id").alias("left_id"), F.col("vec_id").alias("right_id"), F.col("score").alias("a"))
    checked = SIM.cosine_pairs(pairs.select("left_id", "right_id"), vec).join(pairs, ["left_id", "right_id"])
    assert checked.where(F.abs(F.col("score") - F.col("a")) > 1e-6).count() == 0
    exact = SIM.similar_topk(vec.select(F.col("vec_id").alias("query_id"), "embedding"), vec, 10, exclude_self=True)
    hit = exact.join(approx.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    assert hit / exact.count() >= 0.9  # near-random 64-d vectors: a hard case for any index
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0]), (4, [2.0]), (5, None)], "vec_id long, embedding array<float>")
    near = {(r["query_id"], r["vec_id"]) for r in SIM.similar_approx(odd, k=3).collect()}
    assert near >= {(1, 2), (2, 1), (3, 4), (4, 3)} and not any(5 in p for p in near)


def test_crawl_rounds_full_layer_and_fifo_batches(spark):
    from linkweave.operators import crawl as CR

    corpus = spark.createDataFrame(
        [("S", "success", None, "h", ["A", "B"]), ("A", "redirect", "C", None, None),
         ("B", "success", None, "h", ["S", "D"]), ("C", "error", None, None, None)],
        "title string, outcome string, redirect_to string, content_hash string, links array<string>",
    )
    seeds = spark.createDataFrame([("S",)], "title string")
    state, log = CR.crawl(corpus, seeds, max_rounds=3)
    got = {r["title"]: (r["fetch_status"], r["depth"]) for r in state.collect()}
    # round 1: S fetched; round 2: A (redirect -> C queued), B (links S, D); round 3: C error, D absent -> not_found
    assert got == {"S": ("success", 0), "A": ("redirect", 1), "B": ("success", 1),
                   "C": ("error", 2), "D": ("not_found", 2)}
    stats = ST.crawl_stats(log).first()
    assert (stats["pages_fetched"], stats["pages_skipped"], stats["links_found"], stats["errors"]) == (2, 2, 4, 1)
    # FIFO batches of one page per round: after 2 rounds only S and A are done
    st2, _ = CR.crawl(corpus, seeds, max_rounds=2, batch_size=1)
    got2 = {r["title"]: r["fetch_status"] for r in st2.collect()}
    assert got2["S"] == "success" and got2["A"] == "redirect" and got2["B"] == "pending"
