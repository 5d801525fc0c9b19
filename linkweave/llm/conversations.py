"""Conversation structure repair by a square-root checkpointed DP (operator 13).

A conversation is repaired to the role pattern ``(s?(ua)+)?`` by the cheapest
edits: Keep, Rerole, Delete, Insert.  Four states say what may come next (start,
after a system row, after a user row, after an assistant row); a state-cost
vector holds the cheapest completion from each.  Vectors are computed backwards
and stored at checkpoints only; walking forward, the vectors of one block are
computed again from the checkpoint behind it and the ASCII-least tight edit is
emitted.

Checkpoints stand at two levels.  Rows are numbered inside their conversation
and cut into segments of ``SEGMENT`` rows.  The vectors at segment ends come
from the segments' (min, +) matrices by doubling: a conversation of m segments
takes log2(m) joins on (conversation, segment), so one that holds a third of all
rows is as parallel as any.  Inside a segment of n rows checkpoints are about
sqrt(n) rows apart.  The walk streams a conversation's rows in order with one
segment's edits in memory; the digest of a repaired conversation is sequential
by definition and needs one task per conversation, in constant memory but for
the audit string, which is a result cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import fixed, shuffle_partitions
from linkweave.operators.ranking import dense_rank_table

SEGMENT = 1024
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States 0 start, 1 after system, 2 after user, 3 after assistant; role initials that each allows.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)  # state after the one user or assistant row that may follow
ROLE = ("user", "user", "assistant", "user")  # that row's role
ENDS = (0, 2 * INSERT, INSERT, 0)  # completion cost after the last row, by inserts alone
_FAR = 1 << 40


# ---- one row
def _row_costs(code: str, after) -> list[int]:
    """State-cost vector before a row, given the one after it; inserts before the row included.

    Codes: b blank, d duplicate, else the role initial (x: another), upper case if truncated.
    """
    if code in "bd":
        return [DELETE + c for c in after]
    extra, initial = (TRUNCATED, code.lower()) if code.isupper() else (0, code)
    direct = []
    for q in range(4):
        best = min(DELETE + after[q], extra + REROLE + after[NEXT[q]])
        if initial in MOVES[q]:
            best = min(best, extra + after[MOVES[q][initial]])
        direct.append(best)
    return [min(direct[q], INSERT + direct[NEXT[q]], 2 * INSERT + direct[NEXT[NEXT[q]]]) for q in range(4)]


def segment_matrix(codes: str) -> list[int]:
    """(min, +) matrix of a segment, row-major: cheapest way from a state before it to a state after it."""
    columns = []
    for target in range(4):
        costs = [0 if q == target else _FAR for q in range(4)]
        for code in reversed(codes):
            costs = _row_costs(code, costs)
        columns.append([min(c, _FAR) for c in costs])
    return [columns[j][i] for i in range(4) for j in range(4)]


class SegmentPlan:
    """Edits of one segment: backward vectors at checkpoints, blocks recomputed while walking forward."""

    def __init__(self, codes: str, after):
        self.codes, self.step = codes, max(1, int(len(codes) ** 0.5))
        # checkpoints[k]: the vector before row min((k + 1) * step, n)
        blocks = -(-len(codes) // self.step)
        self.checkpoints = [None] * blocks
        costs = list(after)
        for k in range(blocks - 1, -1, -1):
            self.checkpoints[k] = costs
            for code in reversed(codes[k * self.step : (k + 1) * self.step]):
                costs = _row_costs(code, costs)
        self.before = costs

    def walk(self, state: int) -> Iterator[tuple[str, int]]:
        """(edits, state) per row: the row's inserts and its own edit, and the state after it."""
        for k, costs in enumerate(self.checkpoints):
            block = self.codes[k * self.step : (k + 1) * self.step]
            vectors = [list(costs)]
            for code in reversed(block):
                vectors.append(_row_costs(code, vectors[-1]))
            vectors.reverse()
            for code, here, after in zip(block, vectors, vectors[1:], strict=False):
                edits, done = "", False
                while not done:
                    edit, state, done = _least_edit(code, state, here, after)
                    edits += edit
                yield edits, state


def _least_edit(code: str, q: int, here, after) -> tuple[str, int, bool]:
    """(letter, next state, whether the row is consumed): the ASCII-least edit that the cheapest cost allows."""
    if here[q] == DELETE + after[q]:
        return "D", q, True
    if here[q] == INSERT + here[NEXT[q]]:
        return "I", NEXT[q], False
    extra, initial = (TRUNCATED, code.lower()) if code.isupper() else (0, code)
    to = MOVES[q].get(initial)
    if to is not None and here[q] == extra + after[to]:
        return "K", to, True
    return "R", NEXT[q], True


# ---- damage and faults, as columns
def _or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(ck, turn, role, text, copy) after the damage that crc32(``conv_id:turn``) mod 20 does to each row.

    ``ck`` names the conversation, a null conv_id too.  Nulls count as one space.
    """
    what = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(_or_space("text"), "[.!?]", "")).otherwise(_or_space("text"))
    copies = F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = rows.where(what != 0)
    return kept.select(_conversation().alias("ck"), F.col("turn").cast("long").alias("turn"), F.when(what == 4, "user").otherwise(_or_space("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _conversation() -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (ck, turn, role, text, copy) plus pos and n: place in the conversation by turn, null first, and its length.

    Rows of one turn stand by role, then text.
    """
    keyed = rows.withColumns({"head": F.substring("text", 1, 64), "sha": F.sha2(F.col("text").cast("binary"), 256)})
    return dense_rank_table(keyed, ["turn", "role", "head", "sha", "copy"], within=["ck"], name="pos", size="n")


def coded(rows: DataFrame) -> DataFrame:
    """(ck, pos, n, code) of numbered rows: each row's first fault, blank, duplicate, truncated, or its role initial."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    initial = F.when(F.substring(bare, -1, 1).isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    slim = rows.select("ck", "pos", "n", "role", "sha", F.when(bare == "", "b").otherwise(initial).alias("code"))
    # The first of equal rows, found by a combinable minimum; joined by place, a key without repeats.
    first = slim.groupBy("ck", "role", "sha").agg(F.min("pos").alias("pos")).select("ck", "pos", F.lit(True).alias("first"))
    code = F.when((F.col("code") == "b") | F.col("first"), F.col("code")).otherwise("d")
    return slim.join(first, ["ck", "pos"], "left").select("ck", "pos", "n", code.alias("code"))


def _times(a: str, b: str) -> Column:
    """(min, +) product of two 4 x 4 matrices in array columns."""
    return F.array(*[F.least(F.lit(_FAR), *[F.col(a)[4 * i + k] + F.col(b)[4 * k + j] for k in range(4)]) for i in range(4) for j in range(4)])


def segments(codes: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(ck, seg, codes, after): the codes of every segment and the state-cost vector at its end."""
    spark_rows = codes.withColumn("seg", F.floor(F.col("pos") / size))
    grouped = spark_rows.groupBy("ck", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("rows"), F.max("n").alias("n"))  # at most `size` rows
    own = grouped.select("ck", "seg", F.array_join(F.col("rows.code"), "").alias("codes"), F.ceil(F.col("n") / size).alias("n_seg"))
    own = fixed(own)
    ends = F.array(*[F.lit(c).cast("long") for c in ENDS])
    single = own.where("n_seg = 1").select("ck", "seg", "codes", ends.alias("after"))
    longest = own.agg(F.max("n_seg")).first()[0] or 1
    if longest == 1:
        return single

    @F.pandas_udf("array<long>")
    def matrix(part: pd.Series) -> pd.Series:
        return part.map(segment_matrix)

    many = own.where("n_seg > 1")
    to_end, step = fixed(many.select("ck", "seg", matrix("codes").alias("m"))), 1
    while step < longest:  # after this round a matrix spans 2 * step segments
        later = to_end.select("ck", (F.col("seg") - step).alias("seg"), F.col("m").alias("m2"))
        joined = to_end.join(later, ["ck", "seg"], "left")
        to_end, step = fixed(joined.select("ck", "seg", F.when(F.col("m2").isNull(), F.col("m")).otherwise(_times("m", "m2")).alias("m"))), 2 * step
    behind = to_end.select("ck", (F.col("seg") - 1).alias("seg"), F.array(*[F.least(*[F.col("m")[4 * i + j] + ENDS[j] for j in range(4)]) for i in range(4)]).alias("v"))
    return single.unionByName(many.join(behind, ["ck", "seg"], "left").select("ck", "seg", "codes", F.coalesce("v", ends).alias("after")))


# ---- the walk
_OUT = pa.schema(
    [("ck", pa.string()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class _Walk:
    """A conversation that streams by: running counts, the repair's state and digest."""

    def __init__(self, ck: str):
        self.ck, self.state, self.cost, self.audit, self.sha, self.rows_out = ck, 0, None, [], hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = self.plan = self.low = self.high = None
        self.turns = 0

    def segment(self, codes: str, after) -> None:
        plan = SegmentPlan(codes, after)
        if self.cost is None:
            self.cost = plan.before[0]
        self.plan = zip(codes, plan.walk(self.state), strict=True)

    def _emit(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.rows_out else ''}{role}:{text}".encode("utf-8", "replace"))
        self.rows_out += 1

    def row(self, turn: int | None, role: str, text: str) -> None:
        code, (edits, state) = next(self.plan)
        self.blank += code == "b"
        self.duplicate += code == "d"
        self.truncated += code.isupper()
        pair = role[:1]
        self.illegal += self.before is not None and self.before + pair not in ("su", "ua", "au")
        self.before = pair
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        for edit in edits:
            if edit in "IR":
                self._emit(ROLE[self.state], text if edit == "R" else "")
                self.state = NEXT[self.state]
            elif edit == "K":
                self._emit(role, text)
        self.audit.append(edits)
        self.state = state

    def result(self) -> tuple:
        while ENDS[self.state]:
            self._emit(ROLE[self.state], "")
            self.state = NEXT[self.state]
            self.audit.append("I")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.ck, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost or 0, "".join(self.audit), self.sha.hexdigest()


def _walk(batches) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (ck, seg, kind, pos): a segment's codes and end vector, then its rows."""
    out, now = [], None

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    for batch in batches:
        for ck, kind, turn, role, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or ck != now.ck:
                if now is not None:
                    out.append(now.result())
                now = _Walk(ck)
            if kind == 0:
                now.segment(text, after)
            else:
                now.row(turn, role, text)
        if len(out) > 4096:
            yield batch_of(out)
            out = []
    if now is not None:
        out.append(now.result())
    if out:
        yield batch_of(out)


def repair(rows: DataFrame, size: int = SEGMENT, damage: bool = True) -> DataFrame:
    """One row per conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    With ``damage`` the rows are first damaged by :func:`damaged`.  Null roles
    and texts count as one space, a null conv_id is a conversation, null turns
    come first; rows of one turn stand by role, then text.  Repeated rows are
    duplicates.  A conversation without rows after the damage has zeros, an
    empty audit and the digest of the empty string.  An empty table gives an
    empty result.
    """
    slim = rows.select("conv_id", "turn", "role", "text")
    if damage:
        given = damaged(slim)
    else:
        given = slim.select(_conversation().alias("ck"), F.col("turn").cast("long").alias("turn"), _or_space("role").alias("role"), _or_space("text").alias("text"), F.lit(0).alias("copy"))
    placed = fixed(numbered(given))
    heads = segments(coded(placed), size)
    parts = shuffle_partitions(rows.sparkSession)
    no = F.lit(None)
    first = heads.select("ck", "seg", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("pos"), no.cast("long").alias("turn"), no.cast("string").alias("role"), F.col("codes").alias("text"), "after")
    rest = placed.select("ck", F.floor(F.col("pos") / size).alias("seg"), F.lit(1).alias("kind"), "pos", "turn", "role", "text", no.cast("array<long>").alias("after"))
    dealt = first.unionByName(rest).repartition(parts, "ck").sortWithinPartitions("ck", "seg", "kind", "pos")
    found = dealt.select("ck", "kind", "turn", "role", "text", "after").mapInArrow(
        _walk, "ck string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )
    known = slim.select("conv_id", _conversation().alias("ck")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return known.join(found, "ck", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_EMPTY_SHA)).alias("repaired_sha256"))
