"""Independent DuckDB SQL for every query of :mod:`linkweave.plans.catalog`.

The driver registers the raw tables (``customer``, ``orders``, ``pages`` ...)
as views; the CTEs below re-derive the fixture tables in plain SQL so the
oracle shares no code with the Spark side.  Traversals use DuckDB's keyed
recursive CTEs (``USING KEY`` + ``recurring.<cte>``) which give a visited set
across iterations -- something Spark's recursive CTE cannot express.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Fixture CTEs (name -> body).  ``cte(...)`` assembles the needed ones in order.
# --------------------------------------------------------------------------

_CTES: dict[str, str] = {}

_CTES["fx_pages"] = """
  SELECT c.c_custkey AS id, c.c_name AS title,
         CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN md5(c.c_name) END AS content_hash,
         CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'success' WHEN 'BUILDING' THEN 'pending'
              WHEN 'AUTOMOBILE' THEN 'redirect' WHEN 'FURNITURE' THEN 'not_found'
              WHEN 'MACHINERY' THEN 'error' END AS fetch_status,
         CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN t.c_name END AS redirect_to,
         CASE WHEN c.c_mktsegment <> 'BUILDING' THEN o.updated_at END AS fetched_at,
         o.created_at, o.updated_at
  FROM customer c
  LEFT JOIN customer t ON t.c_custkey = (c.c_custkey * 7 + 3) % (SELECT count(*) FROM customer)
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at
             FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey"""

_CTES["fx_links"] = """
  SELECT s.o_custkey AS source_id, c.c_name AS target_title, min(s.o_orderdate) AS created_at
  FROM (SELECT o_custkey, o_orderdate,
               lead(o_custkey) OVER (PARTITION BY o_orderpriority, o_orderstatus
                                     ORDER BY o_orderdate, o_orderkey) AS next_cust
        FROM orders) s
  JOIN customer c ON c.c_custkey = s.next_cust
  WHERE s.next_cust IS NOT NULL AND s.next_cust <> s.o_custkey
  GROUP BY s.o_custkey, s.next_cust, c.c_name"""

_CTES["fx_edges"] = """
  SELECT p.title AS src, l.target_title AS dst
  FROM fx_links l JOIN fx_pages p ON p.id = l.source_id
  WHERE p.fetch_status = 'success'"""

_CTES["fx_isolated"] = """
  SELECT p.title FROM fx_pages p
  WHERE p.fetch_status = 'success'
    AND NOT EXISTS (SELECT 1 FROM fx_links l WHERE l.source_id = p.id)"""

_CTES["fx_nodes"] = """
  SELECT src AS title FROM fx_edges UNION SELECT dst FROM fx_edges
  UNION SELECT title FROM fx_isolated"""

_CTES["fx_path_queries"] = """
  SELECT p.id AS query_id, p.title AS "from", n.title AS "to", 6 AS max_depth
  FROM fx_pages p JOIN fx_pages n ON n.id = p.id + 1
  WHERE p.fetch_status = 'success'"""

_CTES["fx_centres"] = """
  SELECT id AS query_id, title FROM fx_pages WHERE fetch_status = 'success'"""

_CTES["fx_undirected"] = """
  SELECT src, dst FROM fx_edges UNION SELECT dst, src FROM fx_edges"""

_CTES["fx_reversed"] = """
  SELECT dst AS src, src AS dst FROM fx_edges"""

_CTES["fx_all"] = """
  SELECT p.title AS src, l.target_title AS dst
  FROM fx_links l JOIN fx_pages p ON p.id = l.source_id"""

_CTES["fx_updates"] = """
  SELECT e.event_id, c.c_name AS title, e.user_id AS page_id,
         CASE e.event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'success'
              WHEN 'click' THEN 'redirect' WHEN 'purchase' THEN 'not_found'
              WHEN 'error' THEN 'error' END AS fetch_status,
         CASE WHEN e.event_type = 'view' THEN md5(e.props) END AS content_hash,
         CASE WHEN e.event_type = 'click' THEN t.c_name END AS redirect_to,
         e.ts AS updated_at
  FROM events e JOIN customer c ON c.c_custkey = e.user_id
  LEFT JOIN customer t ON t.c_custkey = (e.user_id * 7 + 3) % (SELECT count(*) FROM customer)"""

_CTES["fx_sparse"] = """
  SELECT DISTINCT a.c_name AS src, b.c_name AS dst
  FROM (SELECT o_custkey, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS next_cust FROM orders) o
  JOIN customer a ON a.c_custkey = o.o_custkey
  JOIN customer b ON b.c_custkey = o.next_cust
  WHERE o.next_cust <> o.o_custkey"""

_CTES["fx_parts"] = """
  SELECT DISTINCT 'Part#' || CAST(l_partkey AS VARCHAR) AS src, 'Part#' || CAST(n AS VARCHAR) AS dst
  FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey
                 ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) s
  WHERE n IS NOT NULL AND n <> l_partkey"""

_CTES["fx_part_centres"] = """
  SELECT p_partkey AS query_id, 'Part#' || CAST(p_partkey AS VARCHAR) AS title FROM part"""

_DEPS = {
    "fx_pages": [],
    "fx_links": [],
    "fx_edges": ["fx_pages", "fx_links"],
    "fx_isolated": ["fx_pages", "fx_links"],
    "fx_nodes": ["fx_edges", "fx_isolated"],
    "fx_path_queries": ["fx_pages"],
    "fx_centres": ["fx_pages"],
    "fx_undirected": ["fx_edges"],
    "fx_reversed": ["fx_edges"],
    "fx_all": ["fx_pages", "fx_links"],
    "fx_updates": [],
    "fx_sparse": [],
    "fx_parts": [],
    "fx_part_centres": [],
}


def cte(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH RECURSIVE`` prefix defining ``names`` (and dependencies) then ``extra``."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({_CTES[n]}\n)" for n in order]
    parts += [f"{n} AS ({body}\n)" for n, body in (extra or [])]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# --------------------------------------------------------------------------
# Traversal SQL
# --------------------------------------------------------------------------


#: Levels the SQL of an unlimited search is unrolled for; were the last one not
#: empty, the SQL would return no row at all, which the comparison reports.
UNLIMITED_LEVELS = 32


def bfs_paths_sql(
    edges: str, queries: str, base: tuple[str, ...], default_depth: int = -1, levels: int = UNLIMITED_LEVELS
) -> str:
    """Directed BFS with the smallest shortest path, one CTE per level, on ids in title order."""
    pieces: list[tuple[str, str]] = [
        ("nd", f"SELECT src AS title FROM {edges} UNION SELECT dst FROM {edges}"),
        ("nid", "SELECT title, row_number() OVER (ORDER BY title) AS id FROM nd"),
        ("ie", f"SELECT s.id AS src, d.id AS dst FROM {edges} e JOIN nid s ON s.title = e.src JOIN nid d ON d.title = e.dst"),
        (
            "q",
            f"""SELECT z.query_id, z."from", z."to", coalesce(z.max_depth, {default_depth}) AS max_depth,
                 f.id AS f, t.id AS t, f.id IS NOT NULL AND t.id IS NOT NULL AS ok
          FROM {queries} z LEFT JOIN nid f ON f.title = z."from" LEFT JOIN nid t ON t.title = z."to" """,
        ),
        ("act", """SELECT * FROM q WHERE ok AND f <> t AND max_depth <> 0"""),
        ("lv0", "SELECT query_id, f AS node, [f] AS path, t, max_depth, 0 AS lvl FROM act"),
    ]
    for k in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT query_id, node FROM lv{j}" for j in range(k))
        pieces.append(
            (
                f"lv{k}",
                f"""SELECT x.query_id, e.dst AS node, min(list_append(x.path, e.dst)) AS path,
               any_value(x.t) AS t, any_value(x.max_depth) AS max_depth, {k} AS lvl
          FROM lv{k - 1} x JOIN ie e ON e.src = x.node
          WHERE (x.max_depth < 0 OR x.max_depth >= {k})
            AND x.query_id NOT IN (SELECT query_id FROM lv{k - 1} WHERE node = t)
            AND NOT EXISTS (SELECT 1 FROM ({seen}) v WHERE v.query_id = x.query_id AND v.node = e.dst)
          GROUP BY x.query_id, e.dst""",
            )
        )
    pieces.append(("bfs", " UNION ALL ".join(f"SELECT * FROM lv{k}" for k in range(levels + 1))))
    sql = cte(*base, extra=pieces)
    for name in ["nid", "ie", "act", *(f"lv{k}" for k in range(levels + 1))]:
        sql = sql.replace(f"\n{name} AS (", f"\n{name} AS MATERIALIZED (", 1)
    return sql + _paths_tail(levels)


def _paths_tail(levels: int) -> str:
    return f"""
, hit AS (SELECT query_id, path, lvl AS hops FROM bfs WHERE node = t)
, named AS (SELECT u.query_id, list(n.title ORDER BY u.pos) AS path
            FROM (SELECT query_id, unnest(path) AS id, generate_subscripts(path, 1) AS pos FROM hit) u
            JOIN nid n ON n.id = u.id GROUP BY u.query_id)
, expl AS (SELECT b.query_id, count(*) FILTER (WHERE h.hops IS NULL OR b.lvl < h.hops) AS explored
           FROM bfs b LEFT JOIN hit h ON h.query_id = b.query_id
           WHERE b.max_depth < 0 OR b.lvl < b.max_depth
           GROUP BY b.query_id)
SELECT a.query_id, a."from", a."to", h.path IS NOT NULL AS found, n.path, CAST(h.hops AS INTEGER) AS hops,
       CAST(coalesce(x.explored, 0) AS BIGINT) AS explored
FROM act a LEFT JOIN hit h USING (query_id) LEFT JOIN named n USING (query_id) LEFT JOIN expl x USING (query_id)
WHERE NOT EXISTS (SELECT 1 FROM lv{levels} l WHERE l.max_depth < 0)
UNION ALL
SELECT query_id, "from", "to", ok AND f = t AS found,
       CASE WHEN ok AND f = t THEN ["from"] END AS path,
       CASE WHEN ok AND f = t THEN 0 END AS hops,
       CAST(CASE WHEN ok AND f = t THEN 1 ELSE 0 END AS BIGINT) AS explored
FROM q WHERE NOT ok OR f = t OR max_depth = 0
"""


def reach_sql(edges: str, seeds: str, depth: int) -> str:
    """CTE body pieces: ``reach(query_id, title, hops)`` by keyed recursion (min hop)."""
    return f"""reach(query_id, title, hops) USING KEY (query_id, title) AS (
  SELECT DISTINCT query_id, title, 0 FROM {seeds}
  UNION
  SELECT f.query_id, e.dst, min(f.hops + 1)
  FROM reach f JOIN {edges} e ON e.src = f.title
  WHERE f.hops < {depth}
    AND NOT EXISTS (SELECT 1 FROM recurring.reach v WHERE v.query_id = f.query_id AND v.title = e.dst)
  GROUP BY f.query_id, e.dst
)"""


def bidi_sql(edges: str, queries: str, base: tuple[str, ...], steps: int, default_depth: int = -1) -> str:
    """Bidirectional search unrolled for ``steps`` steps (the query's max depth bound)."""
    pieces: list[tuple[str, str]] = [
        ("nd", f"SELECT src AS title FROM {edges} UNION SELECT dst FROM {edges}"),
        (
            "q",
            f"""SELECT query_id, "from", "to", coalesce(max_depth, {default_depth}) AS max_depth,
                 "from" IN (SELECT title FROM nd) AND "to" IN (SELECT title FROM nd) AS ok
          FROM {queries}""",
        ),
        ("act", """SELECT * FROM q WHERE ok AND "from" <> "to" AND max_depth <> 0"""),
        (
            "fr0",
            """SELECT query_id, 'F' AS dir, "from" AS node, ["from"] AS path FROM act
          UNION ALL SELECT query_id, 'B', "to", ["to"] FROM act""",
        ),
        ("vis0", "SELECT * FROM fr0"),
    ]
    for s in range(steps):
        fr, vis = f"fr{s}", f"vis{s}"
        pieces += [
            (
                f"pk{s}",
                f"""SELECT z.query_id, CASE WHEN nf <= nb THEN 'F' ELSE 'B' END AS dir, least(nf, nb) AS n
              FROM (SELECT query_id, count(*) FILTER (WHERE dir = 'F') AS nf,
                           count(*) FILTER (WHERE dir = 'B') AS nb FROM {fr} GROUP BY query_id) z
              JOIN act a ON a.query_id = z.query_id
              WHERE nf > 0 AND nb > 0 AND (a.max_depth < 0 OR a.max_depth > {s})""",
            ),
            (
                f"nw{s}",
                f"""SELECT query_id, dir, node, min(path) AS path FROM (
                SELECT f.query_id, f.dir, e.dst AS node, list_append(f.path, e.dst) AS path
                FROM {fr} f JOIN pk{s} p ON p.query_id = f.query_id AND p.dir = f.dir
                JOIN {edges} e ON e.src = f.node WHERE f.dir = 'F'
                UNION ALL
                SELECT f.query_id, f.dir, e.src, list_prepend(e.src, f.path)
                FROM {fr} f JOIN pk{s} p ON p.query_id = f.query_id AND p.dir = f.dir
                JOIN {edges} e ON e.dst = f.node WHERE f.dir = 'B') c
              WHERE NOT EXISTS (SELECT 1 FROM {vis} v WHERE v.query_id = c.query_id AND v.dir = c.dir
                                AND v.node = c.node)
              GROUP BY query_id, dir, node""",
            ),
            (
                f"mt{s}",
                f"""SELECT n.query_id, min(CASE WHEN n.dir = 'F' THEN list_concat(n.path, v.path[2:])
                                           ELSE list_concat(v.path, n.path[2:]) END) AS path
              FROM nw{s} n JOIN {vis} v ON v.query_id = n.query_id AND v.node = n.node AND v.dir <> n.dir
              GROUP BY n.query_id""",
            ),
            (f"vis{s + 1}", f"SELECT * FROM {vis} UNION ALL SELECT * FROM nw{s}"),
            (
                f"fr{s + 1}",
                f"""SELECT * FROM (
                SELECT f.* FROM {fr} f
                WHERE f.query_id IN (SELECT query_id FROM pk{s})
                  AND NOT EXISTS (SELECT 1 FROM pk{s} p WHERE p.query_id = f.query_id AND p.dir = f.dir)
                UNION ALL SELECT * FROM nw{s}) x
              WHERE x.query_id NOT IN (SELECT query_id FROM mt{s})""",
            ),
        ]
    found = " UNION ALL ".join(f"SELECT query_id, path FROM mt{s}" for s in range(steps)) or (
        "SELECT NULL::BIGINT AS query_id, NULL::VARCHAR[] AS path WHERE false"
    )
    expl = " UNION ALL ".join(f"SELECT query_id, n FROM pk{s}" for s in range(steps)) or (
        "SELECT NULL::BIGINT AS query_id, 0::BIGINT AS n WHERE false"
    )
    pieces += [("found_all", found), ("expl_all", expl)]
    tail = """
SELECT a.query_id, a."from", a."to", h.path IS NOT NULL AS found, h.path,
       CAST(len(h.path) - 1 AS INTEGER) AS hops,
       CAST(coalesce((SELECT sum(n) FROM expl_all x WHERE x.query_id = a.query_id), 0) AS BIGINT) AS explored
FROM act a LEFT JOIN found_all h USING (query_id)
UNION ALL
SELECT query_id, "from", "to", ok AND "from" = "to" AS found,
       CASE WHEN ok AND "from" = "to" THEN ["from"] END AS path,
       CASE WHEN ok AND "from" = "to" THEN 0 END AS hops,
       CAST(CASE WHEN ok AND "from" = "to" THEN 1 ELSE 0 END AS BIGINT) AS explored
FROM q WHERE NOT ok OR "from" = "to" OR max_depth = 0
"""
    return cte(*base, extra=pieces) + tail
