"""License scan by an exact set-similarity join with license templates (operator 7).

A passage of a text matches a template when it holds at least ``THRESHOLD`` of
the template's distinct tokens and all its marking tokens (the words that tell
it from its siblings) within as many words as the template has plus a foreign
one for each that may be missing, and no word that names a sibling stands in it
or that near to it.
Line breaks don't matter.  The join is exact: tokens are ordered by their
frequency over the whole corpus, rarest first, and three filters discard
stretches of text before any passage is looked for:

* prefix: a block with overlap t of n template tokens must hold one of the
  template's first n - t + 1 tokens;
* length: a block of fewer than t distinct template-vocabulary tokens can't;
* position: with the block's own tokens in the same order, a first shared token
  at place p of the template and q of the block's m tokens leaves an overlap of
  at most min(n - p, m - q).

Templates are a parameter (a few hundred short notices), so their vocabulary
bounds everything that is sent to the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import LOWER, UPPER, lower_ascii, text_of

THRESHOLD = 0.8
#: Phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public license notices: label (never a base label), text, marking tokens, tokens of siblings.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache 2", ""),
    ("mit-notice", "released under the mit license", "mit", ""),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission granted", ""),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3", "gnu general", "lesser affero library"),
    ("gpl-redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute gnu", "lesser affero library"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary", ""),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc", "nd sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by", "nc nd sa"),
    ("cc-by", "this work is licensed under a creative commons attribution license", "commons attribution", "noncommercial noderivatives sharealike"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla", ""),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", ""),
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(UPPER, LOWER)


def token_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Number of lines of the corpus with each template token; as many rows as the templates have tokens."""
    vocab = sorted({w for _, t, *_ in templates for w in t.split()})
    lines = docs.select(F.explode(F.split(lower_ascii(text_of()), "\n")).alias("line"))
    words = lines.select(F.explode(F.array_distinct(F.split("line", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("w")).where(F.col("w").isin(vocab))
    found = {r["w"]: r["count"] for r in words.groupBy("w").count().collect()}
    return {w: found.get(w, 0) for w in vocab}


class Template:
    """One template: tokens in global frequency order, how many a passage needs, and in how many words."""

    def __init__(self, label: str, text: str, marks: str, siblings: str, frequency: dict[str, int], threshold: float):
        words = text.split()
        self.label, self.marks, self.siblings = label, frozenset(marks.split()), frozenset(siblings.split())
        self.tokens = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
        self.whole = frozenset(self.tokens)
        self.need = max(1, math.ceil(threshold * len(self.tokens) - 1e-9))
        self.slack = len(words) - self.need  # foreign words that may stand in a passage
        self.width = len(words) + self.slack
        self.prefix = self.tokens[: len(self.tokens) - self.need + 1]

    def passages(self, words: list[str]) -> tuple[int, list[tuple[int, int]]]:
        """Most distinct tokens of a matching passage (0: none), and the shortest passage per end."""
        held: dict[str, int] = {}  # token -> its last place, in the order of the places
        named = {p for i, w in enumerate(words) if w in self.siblings for p in range(i - self.slack, i + self.slack + 1)}
        best, spans = 0, []
        for i, w in enumerate(words):
            if i in named:  # a sibling is named here, or so near that it is part of the notice
                held.clear()
            elif w in self.whole:
                held.pop(w, None)
                held[w] = i
                for old in [x for x, at in held.items() if at <= i - self.width]:
                    del held[old]
                if len(held) >= self.need and self.marks <= held.keys():
                    best = max(best, len(held))
                    spans.append((min([list(held.values())[-self.need], *(held[m] for m in self.marks)]), i))
        return best, spans


class TemplateIndex:
    """Templates indexed by their prefix tokens in global frequency order, rarest first."""

    def __init__(self, templates, frequency: dict[str, int], threshold: float = THRESHOLD):
        self.frequency = frequency
        self.templates = [Template(*t, frequency, threshold) for t in templates]
        self.by_token: dict[str, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            for place, w in enumerate(t.prefix):
                self.by_token.setdefault(w, []).append((k, place))
        self.vocab = frozenset(w for t in self.templates for w in t.tokens)
        self.prefix = frozenset(self.by_token)
        # A passage and the words around it that could name a sibling.
        self.reach = max((t.width + t.slack for t in self.templates), default=1) - 1

    def candidates(self, block: set[str]) -> list[int]:
        """Templates that a block of these tokens may contain: none that it contains is missing."""
        own = sorted(block & self.vocab, key=lambda w: (self.frequency.get(w, 0), w))
        first: dict[int, tuple[int, int]] = {}  # both orders are the same, so the first shared token is first in either
        for q, w in enumerate(own):
            for k, p in self.by_token.get(w, ()):
                first.setdefault(k, (p, q))
        out = []
        for k, (p, q) in first.items():
            t = self.templates[k]
            if len(own) >= t.need and min(len(t.tokens) - p, len(own) - q) >= t.need:
                out.append(k)
        return out

    def search(self, words: list[str]) -> tuple[dict[str, float], int]:
        """(label -> best containment over all passages, number of disjoint matching passages)."""
        best: dict[str, float] = {}
        found: list[tuple[int, int]] = []
        for low, high in self._stretches(words):
            part = words[low:high]
            for k in self.candidates(set(part)):
                t = self.templates[k]
                both, spans = t.passages(part)
                if both:
                    best[t.label] = max(best.get(t.label, 0.0), both / len(t.tokens))
                    found += [(low + end, low + start) for start, end in spans]
        n, free = 0, 0
        for end, start in sorted(found):  # the earliest end first: as many disjoint passages as there can be
            if start >= free:
                n, free = n + 1, end + 1
        return best, n

    def _stretches(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Word ranges that hold every passage with a prefix token; each such passage lies in one of them."""
        prefix, reach, start, last = self.prefix, self.reach, None, 0
        for i, w in enumerate(words):
            if w in prefix:
                if start is None:
                    start = i
                elif i - last > reach:
                    yield max(0, start - reach), last + reach + 1
                    start = i
                last = i
        if start is not None:
            yield max(0, start - reach), last + reach + 1


def _spots(words: list[str], phrase: list[str]) -> list[int]:
    """Places where the phrase's words stand consecutively."""
    n, out, at = len(phrase), [], -1
    while True:
        try:
            at = words.index(phrase[-1], at + 1)
        except ValueError:
            return out
        if at >= n - 1 and words[at - n + 1 : at + 1] == phrase:
            out.append(at - n + 1)


def _scan(index: TemplateIndex, phrases: dict[str, str]):
    from pyspark.sql.functions import pandas_udf

    split = [(p.split(), label) for p, label in phrases.items()]

    @pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part:
                text = text.translate(_LOWER)
                words = _WORD.findall(text)
                spots, base = [], set()
                for phrase, label in split:
                    if phrase[0] in text and (found := _spots(words, phrase)):
                        spots += found
                        base.add(label)
                labels, best, n_blocks = set(base), 1.0 if base else 0.0, 0
                if not index.prefix.isdisjoint(words):
                    got, n_blocks = index.search(words)
                    labels |= set(got)
                    best = max(best, *got.values()) if got else best
                out.append((len(words), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best, n_blocks))
            frame = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return run


def scan(docs: DataFrame, templates=TEMPLATES, phrases=None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    Base: places where a phrase's words stand consecutively.  ``labels`` adds
    the templates that a passage contains, under labels of their own; ``score``
    is 1 with a base phrase, else the best containment (0 without a match);
    ``n_blocks`` counts the matching passages that do not overlap.  Null text counts as empty: no words, empty labels, null places.
    Repeated rows are scanned alike; an empty table gives an empty result.
    """
    index = TemplateIndex(templates, token_frequencies(docs, templates), threshold)
    udf = _scan(index, PHRASES if phrases is None else phrases)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), udf(text_of()).alias("r")).select("doc_id", "r.*")
