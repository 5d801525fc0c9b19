"""Toxicity scores by Levenshtein automata intersected with a lexicon trie (operator 1).

The lexicon is learned from labelled documents: words, and word stems (prefixes),
that are many times likelier in toxic documents.  All entries form one trie; the
Levenshtein automaton runs over it as a lazily determinised machine whose states
are sets of (trie node, edits used), so one left-to-right pass over a word finds
every entry within its edit limit and most words leave the machine after a few
letters.  Each hit gets a context-window score that tells quotation (quotation
marks around it, a reporting word before it) from abuse (further hits and second
persons nearby).  A logistic regression over a document's hits gives the score.

Fitting uses a bounded sample of labelled rows (``MAX_PER_CLASS``).  Scoring is
one pass over whole texts in Arrow batches; per worker it keeps the machine and
a bounded cache of words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import fixed, held_out, small, text_of, uniform

MAX_PER_CLASS = 4000  # labelled documents per class in the fitting sample
MAX_ENTRIES = 2000  # lexicon size
MIN_DOCS, MIN_ODDS = 4, 8.0
STEM_LENGTHS = range(4, 9)
WINDOW = 8  # words on either side of a hit
CACHE_WORDS = 400_000  # some 50 MB per worker
MAX_STATES = 50_000

#: Words that introduce a quotation, and second persons.
REPORTING = frozenset("said says called calls word words quote quoted quotes term slur insult disait dit mot appelle sagte sagt wort nannte dijo dice palabra llama".split())
SECOND_PERSON = frozenset("you your youre yours yourself tu vous toi du dich dir ihr usted ustedes".split())
_QUOTES = "\"“”«»„‟`"
_WORD = re.compile(r"[^\W_]+")


def edit_limit(entry: str, stem: bool) -> int:
    """Edits allowed for an entry: none for stems and short words, two for long ones."""
    return 0 if stem or len(entry) < 5 else 1 if len(entry) < 9 else 2


class LexiconMachine:
    """Levenshtein automata of all entries, run over their trie and determinised on demand."""

    def __init__(self, entries: list[tuple[str, bool, bool]]):
        """entries: (letters, is_stem, fuzzy)."""
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (entry, edit limit) of whole words
        self.stems: list[list[int]] = [[]]
        self.most = [0]  # edit limit of any entry below the node
        for e, (letters, stem, fuzzy) in enumerate(entries):
            limit, node = edit_limit(letters, stem) if fuzzy else 0, 0
            self.most[0] = max(self.most[0], limit)
            for c in letters:
                nxt = self.kids[node].get(c)
                if nxt is None:
                    nxt = self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append([])
                    self.stems.append([])
                    self.most.append(0)
                node = nxt
                self.most[node] = max(self.most[node], limit)
            if stem:
                self.stems[node].append(e)
            else:
                self.ends[node].append((e, limit))
        self.start = self._close({0: 0})
        self.moves: dict = {}
        self.finals: dict = {}

    def _close(self, nodes: dict[int, int]) -> frozenset:
        """Add the nodes reached by leaving out entry letters; keep the fewest edits per node."""
        todo = list(nodes.items())
        while todo:
            n, e = todo.pop()
            if nodes.get(n, 99) < e:
                continue
            for kid in self.kids[n].values():
                if e + 1 <= self.most[kid] and e + 1 < nodes.get(kid, 99):
                    nodes[kid] = e + 1
                    todo.append((kid, e + 1))
        return frozenset(nodes.items())

    def _step(self, state: frozenset, c: str) -> tuple[frozenset, tuple[int, ...]]:
        nodes: dict[int, int] = {}

        def add(n: int, e: int) -> None:
            if e <= self.most[n] and e < nodes.get(n, 99):
                nodes[n] = e

        for n, e in state:
            if c in self.kids[n]:
                add(self.kids[n][c], e)
            if e < self.most[n]:
                add(n, e + 1)  # an extra letter in the word
                for kid in self.kids[n].values():
                    add(kid, e + 1)  # another letter in the word
        stems = tuple(x for n, e in nodes.items() if e == 0 for x in self.stems[n])
        return self._close(nodes), stems

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(entry, edits) of every lexicon entry that the word is within the limit of."""
        if len(self.moves) > MAX_STATES:
            self.moves.clear()
            self.finals.clear()
        state, found = self.start, []
        for c in word:
            key = (state, c)
            nxt = self.moves.get(key)
            if nxt is None:
                nxt = self.moves[key] = self._step(state, c)
            state, stems = nxt
            if stems:
                found.extend((s, 0) for s in stems)
            if not state:
                return tuple(found)
        last = self.finals.get(state)
        if last is None:
            last = self.finals[state] = tuple((x, e) for n, e in state for x, limit in self.ends[n] if e <= limit)
        return tuple(found) + last


class _Words(dict):
    """White-space-delimited piece -> hits of the words in it (empty for most)."""

    def __init__(self, machine: LexiconMachine):
        self.machine = machine

    def __missing__(self, piece: str):
        hits = tuple(h for w in _WORD.findall(piece.lower()) for h in self.machine.match(w))
        if len(self) < CACHE_WORDS and len(piece) < 64:
            self[piece] = hits
        return hits


@dataclass
class Hit:
    entry: int
    edits: int
    quoted: bool
    window: float


@dataclass
class ToxicityModel:
    entries: list[tuple[str, bool]] = field(default_factory=list)  # (letters, is_stem)
    odds: list[float] = field(default_factory=list)  # log odds per entry
    fuzzy: list[bool] = field(default_factory=list)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    coef: np.ndarray | None = None  # intercept first

    def words(self) -> _Words:
        fuzzy = self.fuzzy or [True] * len(self.entries)
        return _Words(LexiconMachine([(*e, f) for e, f in zip(self.entries, fuzzy, strict=True)]))

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.coef is None:
            return np.zeros(len(rows))
        z = self.coef[0] + ((rows - self.mean) / self.scale) @ self.coef[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def find_hits(text: str, words: _Words) -> tuple[int, list[Hit]]:
    """Number of white-space-delimited words, and the hits with their context-window scores."""
    pieces = text.split()
    at = [i for i, p in enumerate(pieces) if words[p]]
    out = []
    for i in at:
        near = pieces[max(0, i - WINDOW) : i + WINDOW + 1]
        here = min(i, WINDOW)
        before, after = near[: here + 1], near[here:]
        marks = any(q in p for p in before for q in _QUOTES) and any(q in p for p in after for q in _QUOTES)
        told = any(p.lower().strip(".,:;!?\"'“”«»„") in REPORTING for p in near[max(0, here - 4) : here])
        others = sum(1 for p in near if words[p]) - 1
        you = sum(1 for p in near if p.lower().strip(".,:;!?\"'") in SECOND_PERSON)
        quoted = marks or told
        window = (1.0 + others + 0.5 * you) * (0.25 if quoted else 1.0)
        out.extend(Hit(e, k, quoted, window) for e, k in words[pieces[i]])
    return len(pieces), out


def features(n_words: int, hits: list[Hit], odds) -> list[float]:
    abuse = [h for h in hits if not h.quoted]
    exact = [h for h in abuse if h.edits == 0]
    return [
        math.log1p(len(exact)),
        math.log1p(len(abuse) - len(exact)),
        math.log1p(len(hits) - len(abuse)),
        max((odds[h.entry] for h in exact), default=0.0),
        float(len({h.entry for h in exact})),
        math.log1p(max((h.window for h in exact), default=0.0)),
        math.log1p(100 * len(abuse) / max(n_words, 20)),
    ]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression; intercept first, not penalised."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    pen = np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen + 1e-9)
        step = np.linalg.solve(h, x.T @ (y - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def choose_entries(stats: list[tuple[str, bool, int, int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """(letters, is_stem, log odds) from (letters, is_stem, toxic docs, clean docs, distinct words).

    A stem is taken when at least three words share it and it reaches more toxic
    documents than its best single word; shorter stems first, longer stems and
    words below a taken stem are left out.
    """

    def odds(t: int, c: int) -> float:
        return math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))

    good = [(w, s, t, odds(t, c), k) for w, s, t, c, k in stats if t >= MIN_DOCS and odds(t, c) >= math.log(MIN_ODDS)]
    best_word: dict[str, int] = {}
    for w, s, t, _, _ in good:
        if not s:
            for n in STEM_LENGTHS:
                best_word[w[:n]] = max(best_word.get(w[:n], 0), t)
    taken: dict[str, float] = {}
    for w, _, t, o, k in sorted((g for g in good if g[1]), key=lambda g: (len(g[0]), g[0])):
        if k >= 3 and t > 1.3 * best_word.get(w, 0) and not any(w[:n] in taken for n in STEM_LENGTHS if n < len(w)):
            taken[w] = o
    out = [(w, True, o, t) for w, s, t, o, _ in good if s and w in taken]
    out += [(w, False, o, t) for w, s, t, o, _ in good if not s and not any(w[:n] in taken for n in STEM_LENGTHS)]
    out.sort(key=lambda e: (-e[3], e[0], e[1]))
    return [(w, s, o) for w, s, o, _ in out[:MAX_ENTRIES]]


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> ToxicityModel:
    """Fit on at most about ``max_per_class`` labelled, non-held-out documents of each class.

    Two thirds of the sample give the lexicon, one third the edit tolerance of
    each entry and the weights.  Without both classes the model scores 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two classes
    if not counts.get(0) or not counts.get(1):
        return ToxicityModel()
    rate = F.when(F.col("toxic") == 1, max_per_class / counts[1]).otherwise(max_per_class / counts[0])
    chosen = fixed(known.where(uniform("doc_id") < rate))
    n = chosen.count()
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sample = text.join(small(chosen, n, 4 * max_per_class), "doc_id")
    # One text per id, however many rows repeat it: bounded by max_per_class documents.
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(3)))
    sample = fixed(sample)
    lex = sample.where("fold < 2")
    words = lex.select("text", "toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w")).where(F.length("w") >= 3)
    # A text counts once, however often it was copied into the sample.
    words = words.select(F.xxhash64("text").alias("t"), "toxic", "w").distinct()
    sized = {r["toxic"]: r["n"] for r in lex.groupBy("toxic").agg(F.countDistinct("text").alias("n")).collect()}
    stems = words.select("t", "toxic", "w", F.explode(F.array(*[F.lit(k) for k in STEM_LENGTHS])).alias("k")).where(F.length("w") >= F.col("k"))
    stems = stems.select("t", "toxic", "w", F.expr("left(w, k)").alias("e"))

    def count(x: DataFrame, key: str, stem: bool) -> DataFrame:
        per = x.groupBy(key).agg(F.countDistinct(F.when(F.col("toxic") == 1, F.col("t"))).alias("pos"), F.countDistinct(F.when(F.col("toxic") == 0, F.col("t"))).alias("neg"), F.countDistinct("w").alias("k"))
        ratio = ((F.col("pos") + 0.5) / (sized.get(1, 0) + 1)) / ((F.col("neg") + 0.5) / (sized.get(0, 0) + 1))
        per = per.where((F.col("pos") >= MIN_DOCS) & (ratio >= MIN_ODDS))
        return per.select(F.col(key).alias("entry"), F.lit(stem).alias("stem"), "pos", "neg", "k").orderBy(F.desc("pos"), "entry").limit(4 * MAX_ENTRIES)

    stats = count(words, "w", False).unionByName(count(stems, "e", True)).collect()  # at most 8 * MAX_ENTRIES rows
    entries = choose_entries([tuple(r) for r in stats], sized.get(1, 0), sized.get(0, 0))
    model = ToxicityModel([(w, s) for w, s, _ in entries], [o for *_, o in entries])

    rest = sample.where("fold = 2").select("text", "toxic").distinct()
    rows = rest.select(_hits_udf(model)("text").alias("h"), "toxic").collect()  # bounded by the sample
    found = [(r["h"]["n"], [Hit(*x) for x in zip(r["h"]["entry"], r["h"]["edits"], r["h"]["quoted"], r["h"]["window"], strict=True)], r["toxic"]) for r in rows]
    y = np.array([t for *_, t in found], float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel()
    # Edits stay allowed for an entry only where its misspelt hits are mostly in toxic documents.
    pos, neg = np.zeros(len(entries)), np.zeros(len(entries))
    for _, hits, toxic in found:
        for e in {h.entry for h in hits if h.edits}:
            (pos if toxic else neg)[e] += 1
    model.fuzzy = [bool(p + 0.5 >= 4 * q) if p + q else True for p, q in zip(pos, neg, strict=True)]
    x = np.array([features(n, [h for h in hits if not h.edits or model.fuzzy[h.entry]], model.odds) for n, hits, _ in found])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    model.coef = _logistic((x - model.mean) / model.scale, y)
    return model


def _hits_udf(model: ToxicityModel):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("n int, entry array<int>, edits array<int>, quoted array<boolean>, window array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = model.words()
        for part in parts:
            got = [find_hits(t, words) for t in part]
            yield pd.DataFrame(
                {
                    "n": [n for n, _ in got],
                    "entry": [[h.entry for h in hs] for _, hs in got],
                    "edits": [[h.edits for h in hs] for _, hs in got],
                    "quoted": [[h.quoted for h in hs] for _, hs in got],
                    "window": [[h.window for h in hs] for _, hs in got],
                }
            )

    return run


def scorer(model: ToxicityModel):
    """Column function text -> struct<score, n_hits, n_quoted, terms> over whole texts."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("score double, n_hits int, n_quoted int, terms string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = model.words()
        clean = float(model.score(np.array([features(1000, [], model.odds)]))[0])
        for part in parts:
            scores, hits_n, quoted_n, terms = [], [], [], []
            for text in part:
                n, hits = find_hits(text, words)
                scores.append(float(model.score(np.array([features(n, hits, model.odds)]))[0]) if hits else clean)
                hits_n.append(len(hits))
                quoted_n.append(sum(h.quoted for h in hits))
                terms.append(",".join(sorted({model.entries[h.entry][0] + ("*" if model.entries[h.entry][1] else "") for h in hits})))
            yield pd.DataFrame({"score": scores, "n_hits": hits_n, "n_quoted": quoted_n, "terms": terms})

    return run


def toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_hits, n_quoted, terms.

    Null and empty texts have no hits and get the score of a text without hits.
    Repeated rows are scored alike; an empty table gives an empty result.
    """
    model = train(docs, labels) if model is None else model
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(model)(text_of()).alias("r"))
    return rows.select(
        "doc_id", held_out().alias("held_out"), "r.score", (F.col("r.score") >= 0.5).cast("int").alias("predicted"), "r.n_hits", "r.n_quoted", "r.terms"
    )
