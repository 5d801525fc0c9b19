"""DuckDB SQL of operators 11 to 13, written from their contracts."""

from __future__ import annotations

from linkweave.llm import lm_scoring
from linkweave.llm.common import LOWER, UPPER

_ONES = 4294967295
#: Fixed value: the reversed polynomial of CRC-32.
_POLYNOMIAL = 3988292384


def crc32(text: str) -> str:
    """CRC-32 of an ASCII string expression: a fold over its bytes, eight shifts each."""
    shift = f"CASE WHEN a % 2 = 1 THEN xor(a // 2, {_POLYNOMIAL}) ELSE a // 2 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, nil: {shift})"
    points = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([{_ONES}::BIGINT], {points}), lambda c, b: {byte}), {_ONES})"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def _lm_sql() -> str:
    order, k = lm_scoring.ORDER, float(lm_scoring.PRIOR)
    gram = [f"[{', '.join(f'w{j}' for j in range(n - 1, -1, -1))}]" for n in range(1, order + 1)]
    lags = ", ".join(f"lag(w, {j}) OVER p AS w{j}" if j else "w AS w0" for j in range(order))
    counts = "\n".join(f", c{n} AS (SELECT {gram[n - 1]} AS g, count(*) AS c FROM g WHERE NOT held_out AND w{n - 1} IS NOT NULL GROUP BY 1)" for n in range(1, order + 1))
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.g = {gram[n - 1]}" for n in range(1, order + 1))
    # The context of an n-gram ends at the token before.
    joins += "".join(f" LEFT JOIN c{n} h{n} ON h{n}.g = [{', '.join(f'w{j}' for j in range(n, 0, -1))}]" for n in range(1, order))
    probability = "(coalesce(c1.c, 0) + 1)::DOUBLE / (t.n + t.v + 1)"
    for n in range(2, order + 1):
        # An empty place before the text, or an unseen context, leaves the shorter context's probability.
        probability = f"(coalesce(c{n}.c, 0) + {k!r} * ({probability})) / (coalesce(h{n - 1}.c, 0) + {k!r})"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({crc32("doc_id::VARCHAR")} % {lm_scoring.FOLDS} = {lm_scoring.HELD_OUT}, true) AS held_out,
  list_append(regexp_extract_all({lowered("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+'), ' ') AS ws FROM documents),
x AS (SELECT r, doc_id, held_out, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, doc_id, held_out, {lags} FROM x WINDOW p AS (PARTITION BY r ORDER BY i))
{counts}
, t AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c1)
SELECT any_value(doc_id) AS doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c1.c) AS n_known, any_value(t.n)::BIGINT AS train_tokens,
  sum(log10((coalesce(c1.c, 0) + 1)::DOUBLE / (t.n + t.v + 1))) AS base_score, sum(log10({probability})) AS score
FROM g CROSS JOIN t {joins} GROUP BY r"""


def _merkle_sql(levels: int = 6, fan: int = 16) -> str:
    """Six levels: up to 16 million leaves a source and as many sources."""

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars"))) + f" || {field(text)})"

    def grow(name: str, first: str) -> str:
        """name0..name<levels>: (k, i, h, n) per level; name<l>r: the runs of a level."""
        out = [f"{name}0 AS ({first})"]
        for at in range(levels):
            out.append(f"{name}{at}r AS (SELECT k, i // {fan} AS i, list(h ORDER BY i) AS run, any_value(n) AS n FROM {name}{at} GROUP BY ALL)".replace("GROUP BY ALL", f"GROUP BY k, i // {fan}"))
            # A level of one node is the top and stays as it is.
            out.append(f"{name}{at + 1} AS (SELECT k, i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h, (n + {fan - 1}) // {fan} AS n FROM {name}{at}r)")
        return ",\n".join(out)

    tampered = f"coalesce({crc32('doc_id::VARCHAR')} % 5 = 0, false)"
    steps, joins, fold, proof = [], [], "coalesce(x.forged, x.leaf)", []
    for name, index, key in (("s", "x.i", "x.k"), ("t", "x.k", "0")):
        for at in range(levels):
            alias, place = f"{name}{at}j", f"({index} // {fan**at})"
            joins.append(f"JOIN {name}{at}r {alias} ON {alias}.k = {key} AND {alias}.i = {place} // {fan}")
            steps.append((alias, f"{place} % {fan}"))
    selects, previous = [], fold
    for j, (alias, own) in enumerate(steps):
        others = f"array_to_string(list_filter({alias}.run, lambda d, q: q <> {own} + 1), '')"
        proof.append(f"CASE WHEN {alias}.n = 1 THEN '' ELSE {others} END")
        value = f"CASE WHEN {alias}.n = 1 THEN f{j} ELSE sha256(array_to_string(list_transform({alias}.run, lambda d, q: CASE WHEN q = {own} + 1 THEN f{j} ELSE d END), '')) END"
        selects.append((f"f{j}", previous))
        previous = value
    # Each fold step names the one before: nested queries, innermost first.
    runs = ", ".join(f"{alias}.run AS {alias}_run, {alias}.n AS {alias}_n" for alias, _ in steps)
    inner = f"SELECT x.*, {runs}, {' || '.join(proof)} AS siblings, {fold} AS f0 FROM x {' '.join(joins)}"
    for j, (alias, own) in enumerate(steps):
        own = own.replace("x.", "")
        inner = (
            f"SELECT *, CASE WHEN {alias}_n = 1 THEN f{j} ELSE sha256(array_to_string(list_transform({alias}_run, "
            f"lambda d, q: CASE WHEN q = {own} + 1 THEN f{j} ELSE d END), '')) END AS f{j + 1} FROM ({inner})"
        )
    return f"""WITH raw AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {tampered} THEN {leaf(lowered("text"))} END AS forged FROM documents),
x AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY source) AS n FROM raw),
{grow("s", "SELECT k, i, leaf AS h, n FROM x")},
{grow("t", f"SELECT 0 AS k, k AS i, h, (SELECT count(*) FROM s{levels}) AS n FROM s{levels}")}
SELECT doc_id, leaf, s{levels}.h AS subroot, t{levels}.h AS root, sha256(siblings) AS proof_sha256, f{len(steps)} AS folded_root, f{len(steps)} = t{levels}.h AS verified
FROM ({inner}) z JOIN s{levels} ON s{levels}.k = z.k CROSS JOIN t{levels}"""


def _repair_sql() -> str:
    """The costs and the least audits go backwards over a conversation's rows, with all four states in one row."""
    end = "0 AS c0, '' AS a0, '' AS r0, 10 AS c1, 'II' AS a1, chr(10) || 'user:' || chr(10) || 'assistant:' AS r1, 5 AS c2, 'I' AS a2, chr(10) || 'assistant:' AS r2, 0 AS c3, '' AS a3, '' AS r3"
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    after, role = (2, 2, 3, 2), ("user", "user", "assistant", "user")

    def option(cost: str, letter: str, to: int, text: str, when: str) -> str:
        return f"CASE WHEN {when} THEN {{'c': {cost} + b.c{to}, 'a': '{letter}' || b.a{to}, 'r': {text} || b.r{to}}} END"

    own = []
    for q in range(4):
        keep = [option("x.extra", "K", to, "chr(10) || x.role || ':' || x.text", f"x.must = 0 AND x.initial = '{c}'") for (at, c), to in moves.items() if at == q]
        tries = [option("2", "D", q, "''", "true"), *keep, option("1 + x.extra", "R", after[q], f"chr(10) || '{role[q]}:' || x.text", "x.must = 0")]
        own.append(f"list_min(list_filter([{', '.join(tries)}], lambda o: o IS NOT NULL)) AS d{q}")

    def inserted(q: int) -> str:
        a, b = after[q], after[after[q]]
        one = f"{{'c': d{a}.c + 5, 'a': 'I' || d{a}.a, 'r': chr(10) || '{role[q]}:' || d{a}.r}}"
        two = f"{{'c': d{b}.c + 10, 'a': 'II' || d{b}.a, 'r': chr(10) || '{role[q]}:' || chr(10) || '{role[a]}:' || d{b}.r}}"
        return f"list_min([d{q}, {one}, {two}]) AS e{q}"

    columns = ", ".join(f"e{q}.c AS c{q}, e{q}.a AS a{q}, e{q}.r AS r{q}" for q in range(4))
    names = ", ".join(f"c{q}, a{q}, r{q}" for q in range(4))
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE h AS (SELECT coalesce('c' || conv_id::VARCHAR, 'null') AS ck, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(key)} % 20 AS what FROM conversations),
damaged AS (SELECT ck, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
  CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE what <> 0),
placed AS (SELECT *, row_number() OVER c AS i, lag(left(role, 1)) OVER c AS before, rtrim(text, {blanks}) AS bare,
  row_number() OVER (PARTITION BY ck, role, text ORDER BY turn NULLS FIRST, role, text, copy) AS nth
  FROM damaged WINDOW c AS (PARTITION BY ck ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT ck, i, turn, role, text, before, left(role, 1) AS initial, bare = '' AS blank, bare <> '' AND nth > 1 AS duplicate,
  bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM placed),
x AS (SELECT *, (blank OR duplicate)::INT AS must, CASE WHEN truncated THEN 5 ELSE 0 END AS extra FROM f),
faults AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
  count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM x GROUP BY ck),
walk AS (SELECT ck, n + 1 AS i, {end} FROM faults
  UNION ALL SELECT ck, i, {columns} FROM (SELECT ck, i, {", ".join(map(inserted, range(4)))} FROM (
    SELECT x.ck, x.i, {", ".join(own)} FROM walk b JOIN x ON x.ck = b.ck AND x.i = b.i - 1) y) z)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(c0, 0)::BIGINT AS cost, coalesce(a0, '') AS audit, sha256(coalesce(substr(r0, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN faults ON faults.ck = coalesce('c' || k.conv_id::VARCHAR, 'null')
LEFT JOIN (SELECT ck, {names} FROM walk WHERE i = 1) w USING (ck)"""


LM_SQL, MERKLE_SQL, REPAIR_SQL = _lm_sql(), _merkle_sql(), _repair_sql()
