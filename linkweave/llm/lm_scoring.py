"""Language-model scoring by a weighted backoff automaton (operator 11).

Model: n-grams of up to ``ORDER`` tokens with Dirichlet-smoothed probabilities

    P(w | h) = (c(hw) + K * P(w | h')) / (c(h) + K),    P(w) = (c(w) + 1) / (N + V + 1)

where h' is h without its first token.  It is a backoff model as it stands: an
n-gram seen in training is an arc of the state h, and an unseen one costs
K / (c(h) + K), the weight of the failure arc from h to h'.  States are the
contexts seen in training; a traversal carries one state from left to right,
follows failure arcs until an arc fits, and adds up log10 weights.

The model grows with the corpus and is never held in one place:

1. texts become blocks of at most ``BLOCK_TOKENS`` tokens (a longer text is cut
   and each piece brings the ``ORDER - 1`` tokens before it), written once;
2. every block sends each of its distinct n-grams once, as 64-bit hashes with
   the block's training counts, to the owner of the hash range;
3. owners add up the counts and answer every block in the order it asked;
4. a block builds from the answers the part of the automaton that its texts can
   reach and walks it, thousands of segments in step, each warmed up by the
   tokens before it, so that the state is the one a single walk would carry.

A word that is a third of all tokens is one entry per block.  Owners hold one
hash range (about ``OWNER_ENTRIES`` entries) at a time, blocks one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import blocks, bounded_batches, fixed, shuffle_partitions, text_of

ORDER = 2
PRIOR = 64.0  # K: pseudo-counts that a context gives to the shorter one
FOLDS, HELD_OUT = 7, 2
BLOCK_TOKENS = 1 << 20
OWNER_ENTRIES = 1 << 20
SEGMENT = 256  # tokens of a text that are walked in one step sequence
LOOK_SMALL = 32  # entries that a block sends to one owner range, at least on average

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = np.uint64(0x9AE16A3B2F90404F)  # the end token, which no word is
_PIECE = np.dtype([("uid", "<i8"), ("doc", "<i8"), ("null", "?"), ("train", "?"), ("whole", "?"), ("pre", "<i4"), ("n", "<i4")])
_SCHEMA = "block long, kind int, part int, a binary, b binary, c binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, offsets per text): words with A-Z lower-cased, then one end token per text.

    A word's hash sums a mixed value of every (place, byte), so equal words have
    equal hashes and different ones collide with the odds of 64 random bits.
    """
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.r_[0, edges]
    starts, ends = edges[0::2], edges[1::2]
    words = np.zeros(0, np.uint64)
    if len(starts):
        length = ends - starts
        first = np.r_[0, np.cumsum(length)[:-1]]
        place = np.arange(length.sum()) - np.repeat(first, length)
        value = _mix((place.astype(np.uint64) << np.uint64(8)) + data[inside] + np.uint64(1 << 60))
        words = _mix(np.add.reduceat(value, first) + length.astype(np.uint64))
    begin = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    bounds = np.searchsorted(starts, begin)
    out = np.insert(words, bounds[1:], _END)
    return out, bounds + np.arange(len(bounds))


def _cut(text: bytes, limit: int = 1 << 22) -> Iterator[bytes]:
    """Parts of a very long text, cut before a space, so that its tokens are hashed in bounded memory."""
    at = 0
    while len(text) - at > limit:
        ends = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, limit, at + 1)])
        if not len(ends):  # a longer token than that: take it whole
            ends = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, len(text) - at - 1, at + 1)])[:1]
            if not len(ends):
                break
        yield text[at : at + 1 + int(ends[-1])]
        at += 1 + int(ends[-1])
    yield text[at:]


def _hashes_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    for group in blocks(texts, map(len, texts), 1 << 21):
        if len(group) == 1:
            parts = [token_hashes([p])[0][:-1] for p in _cut(group[0])]
            yield np.concatenate([*parts, [_END]]).astype(np.uint64)
        else:
            words, offs = token_hashes(group)
            for i in range(len(group)):
                yield words[offs[i] : offs[i + 1]]


def _pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed: leading zero bytes cost next to nothing."""
    wide = np.ascontiguousarray(values).astype("<u8")
    planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T)
    return np.uint32(len(wide)).tobytes() + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(wide) else b"")


def _unpack(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data[4:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _to_blocks(order: int, size: int):
    """Rows (doc_id, train, text) -> one record per block: its pieces, local token ids and vocabulary."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        base, made, row = TaskContext.get().partitionId(), 0, 0
        pieces, held, total = [], [], 0

        def record():
            nonlocal made, total
            vocab, ids = np.unique(np.concatenate(held), return_inverse=True)
            # Frequent words get small ids, which compress well.
            by_count = np.argsort(-np.bincount(ids), kind="stable")
            rank = np.empty(len(vocab), np.int64)
            rank[by_count] = np.arange(len(vocab))
            out = ((base << 30) + made, 0, 0, np.array(pieces, _PIECE).tobytes(), _pack(rank[ids]), vocab[by_count].tobytes())
            made, total = made + 1, 0
            pieces.clear()
            held.clear()
            return _rows([out], _ARROW)

        for batch in batches:
            docs, train = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            for doc, learns, tokens in zip(docs, train, _hashes_of(texts), strict=True):
                at, uid, row = 0, (base << 40) + row, row + 1
                while at < len(tokens):
                    pre = min(at, order - 1)
                    n = min(len(tokens) - at, size - total)
                    pieces.append((uid, doc or 0, doc is None, learns, n == len(tokens), pre, n))
                    held.append(tokens[at - pre : at + n])
                    at, total = at + n, total + n
                    if total >= size:
                        yield record()
        if pieces:
            yield record()

    return run


class _Block:
    """A block's pieces and, per order, the place of every position's n-gram in the sorted distinct n-grams."""

    def __init__(self, a: bytes, b: bytes, c: bytes, order: int):
        self.pieces = np.frombuffer(a, _PIECE)
        self.ids = _unpack(b).astype(np.int32)
        vocab = np.frombuffer(c, np.uint64)
        self.n_words = len(vocab)
        length = self.pieces["pre"] + self.pieces["n"]
        self.start = np.r_[0, np.cumsum(length)]
        # Tokens of the same text before each one, as far as the piece goes.
        place = np.arange(len(self.ids), dtype=np.int32) - np.repeat(self.start[:-1].astype(np.int32), length)
        self.own = place >= np.repeat(self.pieces["pre"], length)
        self.learns = self.own & np.repeat(self.pieces["train"], length)
        words = vocab[self.ids]
        gram, self.grams, self.at, self.where = words, [], [], []
        for k in range(1, order + 1):
            if k > 1:
                gram = np.r_[np.uint64(0), _mix(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + np.uint64(k))]
            fits = np.flatnonzero(place >= k - 1).astype(np.int32)
            order_of = np.argsort(gram[fits])
            names = gram[fits[order_of]]
            new = np.r_[True, names[1:] != names[:-1]] if len(names) else np.zeros(0, bool)
            at = np.full(len(gram), -1, np.int32)
            at[fits[order_of]] = np.cumsum(new, dtype=np.int32) - 1
            self.grams.append(names[new])
            self.at.append(at)  # position -> place among the names
            self.where.append(fits[order_of[new]])  # name -> one position


def _ask(order: int, buckets: int):
    """Block records -> (block, order, hash range, distinct n-gram hashes as gaps, training counts)."""
    cuts = [(b << 64) // buckets for b in range(1, buckets)]
    cuts = np.array(cuts, np.uint64)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, _, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own = _Block(a, b, c, order)
                for k in range(order):
                    names, rows = own.grams[k], []
                    counts = np.bincount(own.at[k][own.learns & (own.at[k] >= 0)], minlength=len(names))
                    ends = np.r_[0, np.searchsorted(names, cuts), len(names)]
                    for part in np.flatnonzero(ends[1:] > ends[:-1]):
                        low, high = ends[part], ends[part + 1]
                        rows.append((block, k + 1, int(part), _pack(np.diff(names[low:high], prepend=np.uint64(0))), _pack(counts[low:high]), None))
                    for at in range(0, len(rows), 512):
                        yield _rows(rows[at : at + 512], _ARROW)

    return run


_ANSWER = pa.schema([*_ARROW, ("distinct_n", pa.int64()), ("total_n", pa.int64())])


def _answer():
    """Rows sorted by (order, range): summed counts for every block in its own order, and one row of totals per range."""

    def settle(key, asked) -> Iterator[pa.RecordBatch]:
        names = np.concatenate([np.cumsum(_unpack(a), dtype=np.uint64) for _, a, _ in asked])
        counts = np.concatenate([_unpack(b) for _, _, b in asked])
        distinct, inverse = np.unique(names, return_inverse=True)
        total = np.zeros(len(distinct), np.uint64)
        np.add.at(total, inverse, counts)
        rows, at = [(-1, *key, None, None, None, int((total > 0).sum()), int(total.sum()))], 0
        for block, a, _ in asked:
            n = int(np.frombuffer(a, "<u4", 1)[0])
            rows.append((block, *key, _pack(total[inverse[at : at + n]]), None, None, None, None))
            at += n
            if len(rows) >= 512:
                yield _rows(rows, _ANSWER)
                rows = []
        if rows:
            yield _rows(rows, _ANSWER)

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, asked = None, []
        for batch in batches:
            for block, kind, part, a, b in zip(*(x.to_pylist() for x in batch.columns[:5]), strict=True):
                if (kind, part) != now:
                    if asked:
                        yield from settle(now, asked)
                    now, asked = (kind, part), []
                asked.append((block, a, b))
        if asked:
            yield from settle(now, asked)

    return run


class Automaton:
    """The part of the weighted backoff automaton that a block can reach.

    State 0 is the empty context, from which every word has an arc; the others
    are seen contexts of up to ``order - 1`` tokens.  Arcs are kept sorted by
    (state, word); ``fail`` and ``fail_weight`` hold each state's failure arc.
    """

    def __init__(self, block: _Block, totals: list[np.ndarray], n: int, v: int, prior: float):
        order = len(totals)
        counts = [t.astype(np.float64) for t in totals]
        prob = [(counts[0] + 1) / (n + v + 1)]
        state, size = [], 1  # per order: name -> state, 0 if the context was not seen
        for k in range(order - 1):
            seen = counts[k] > 0
            state.append(np.where(seen, size + np.cumsum(seen, dtype=np.int32) - 1, 0).astype(np.int32))
            size += int(seen.sum())
        state.append(np.zeros(len(counts[-1]), np.int32))
        self.fail, self.fail_weight = np.zeros(size, np.int32), np.zeros(size)
        # The state after an n-gram: its own, or that of its longest seen suffix.
        after, keys, weights, targets = [state[0]], [], [], []
        for k in range(1, order):
            where = block.where[k]
            suffix, context = block.at[k - 1][where], block.at[k - 1][where - 1]
            prob.append((counts[k] + prior * prob[k - 1][suffix]) / (counts[k - 1][context] + prior))
            after.append(np.where(state[k] > 0, state[k], after[k - 1][suffix]))
            arc = counts[k] > 0
            keys.append(state[k - 1][context[arc]].astype(np.int64) * block.n_words + block.ids[where[arc]])
            weights.append(np.log10(prob[k][arc]))
            targets.append(after[k][arc])
            own = state[k] > 0
            self.fail[state[k][own]] = after[k - 1][suffix[own]]
        for k in range(order - 1):
            own = state[k] > 0
            self.fail_weight[state[k][own]] = np.log10(prior / (counts[k][own] + prior))
        keys = np.concatenate([np.zeros(0, np.int64), *keys])
        by_key = np.argsort(keys, kind="stable")
        self.keys = np.r_[keys[by_key], np.iinfo(np.int64).max]
        self.weights = np.r_[np.concatenate([np.zeros(0), *weights])[by_key], 0.0]
        self.targets = np.r_[np.concatenate([np.zeros(0, np.int32), *targets])[by_key], np.int32(0)]
        self.n_words = block.n_words
        self.root_weight, self.root_target = np.full(block.n_words, -np.log10(n + v + 1)), np.zeros(block.n_words, np.int32)
        words = block.ids[block.where[0]]
        self.root_weight[words], self.root_target[words] = np.log10(prob[0]), state[0]
        self.known = np.zeros(block.n_words, bool)
        self.known[words] = counts[0] > 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 weight) of many walks at once; failure arcs are followed until an arc fits."""
        weight, out = np.zeros(len(word)), state.copy()
        todo = np.flatnonzero(state > 0)
        while len(todo):
            key = out[todo].astype(np.int64) * self.n_words + word[todo]
            at = np.searchsorted(self.keys, key)
            hit = self.keys[at] == key
            done, at = todo[hit], at[hit]
            weight[done] += self.weights[at]
            out[done] = -1 - self.targets[at]  # negative: arrived
            todo = todo[~hit]
            weight[todo] += self.fail_weight[out[todo]]
            out[todo] = self.fail[out[todo]]
            todo = todo[out[todo] > 0]
        rest = np.flatnonzero(out == 0)
        weight[rest] += self.root_weight[word[rest]]
        arrived = out < 0
        out[rest] = self.root_target[word[rest]]
        out[arrived] = -1 - out[arrived]
        return out, weight

    def walk(self, block: _Block, segment: int, order: int) -> np.ndarray:
        """log10 probability of every piece's own tokens, by segments that walk in step."""
        pieces = block.pieces
        count = -(-pieces["n"] // segment)
        owner = np.repeat(np.arange(len(pieces)), count)
        nth = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
        begin = block.start[:-1][owner] + pieces["pre"][owner] + nth * segment
        own = np.minimum(segment, pieces["n"][owner] - nth * segment)
        warm = np.minimum(order - 1, begin - block.start[:-1][owner])  # tokens that only bring the state up
        begin, length = begin - warm, own + warm
        by_length = np.argsort(-length, kind="stable")
        owner, begin, warm, length = owner[by_length], begin[by_length], warm[by_length], length[by_length]
        state, total = np.zeros(len(owner), np.int32), np.zeros(len(owner))
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        for t, n in enumerate(active):
            state[:n], weight = self.step(state[:n], block.ids[begin[:n] + t])
            total[:n] += np.where(warm[:n] <= t, weight, 0.0)
        return np.bincount(owner, total, minlength=len(pieces))


_RESULT = pa.schema([("uid", pa.int64()), ("whole", pa.bool_()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(order: int, n: int, v: int, prior: float, segment: int):
    """Rows sorted by (block, kind, part): the block's record, then its answers; one result row per piece."""

    def settle(record, answers) -> pa.RecordBatch:
        block = _Block(*record, order)
        totals = [np.concatenate([np.zeros(0, np.uint64), *(_unpack(a) for kind, a in answers if kind == k + 1)]) for k in range(order)]
        auto = Automaton(block, totals, n, v, prior)
        piece = np.repeat(np.arange(len(block.pieces)), block.pieces["pre"] + block.pieces["n"])[block.own]
        ids = block.ids[block.own]
        base = np.bincount(piece, auto.root_weight[ids], minlength=len(block.pieces))
        known = np.bincount(piece, auto.known[ids], minlength=len(block.pieces)).astype(np.int64)
        p, total = block.pieces, auto.walk(block, segment, order)
        docs = pa.array(p["doc"].copy(), pa.int64(), mask=p["null"].copy())
        cols = [p["uid"].copy(), p["whole"].copy(), docs, ~p["train"], p["n"].astype(np.int64), known, base, total]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=_RESULT)

    def run(batches) -> Iterator[pa.RecordBatch]:
        record, answers = None, []
        for batch in batches:
            for _, kind, _, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == 0:
                    if record:
                        yield settle(record, answers)
                    record, answers = (a, b, c), []
                else:
                    answers.append((kind, a))
        if record:
            yield settle(record, answers)

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 7 = 2; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def score(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, block_tokens: int = BLOCK_TOKENS, owner_entries: int = OWNER_ENTRIES, segment: int = SEGMENT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (runs without ASCII white space, A-Z lower-cased) and
    one end token; ``n_known`` counts those seen in training.  ``base_score`` is
    the add-one unigram log10 probability, ``score`` the automaton's.  Training
    documents are those that are not held out; a null doc_id is held out.  Null
    text counts as empty (its end token is scored).  Repeated rows are scored
    alike and each counts in training.  Without training documents every
    probability is 1.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out()).alias("train"), text_of().alias("text"))
    records = fixed(given.mapInArrow(_to_blocks(order, block_tokens), _SCHEMA))
    n_blocks, in_bytes = records.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("b") + F.octet_length("c")), F.lit(0))).first()
    parts = shuffle_partitions(spark)
    # About two bytes a token: enough to size the hash ranges.
    tokens = in_bytes // 2
    buckets = max(parts, -(-tokens // owner_entries))
    buckets = max(1, min(buckets, max(parts, tokens // max(1, n_blocks) // LOOK_SMALL)))
    asked = records.mapInArrow(_ask(order, buckets), _SCHEMA).repartition(parts, "kind", "part").sortWithinPartitions("kind", "part", "block")
    answers = fixed(asked.mapInArrow(_answer(), f"{_SCHEMA}, distinct_n long, total_n long"))
    v, n = answers.where("block < 0 AND kind = 1").agg(F.coalesce(F.sum("distinct_n"), F.lit(0)), F.coalesce(F.sum("total_n"), F.lit(0))).first()
    cols = ["block", "kind", "part", "a", "b", "c"]
    dealt = records.unionByName(answers.where("block >= 0").select(*cols)).repartition(parts, "block").sortWithinPartitions("block", "kind", "part")
    found = dealt.select(*cols).mapInArrow(_score(order, n, v, prior, segment), "uid long, whole boolean, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    found = fixed(found)
    cut = found.where("NOT whole").groupBy("uid", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    keep = ["doc_id", "held_out", "n_tokens", "n_known"]
    both = found.where("whole").select(*keep, "base_score", "score").unionByName(cut.select(*keep, "base_score", "score"))
    return both.select(*keep, F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
