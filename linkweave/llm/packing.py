"""Harmonic packing of tokenised documents into fixed-length sequences (operator 6).

Lengths are partitioned into reciprocal-capacity classes: class k holds pieces
of length in (C/(k+1), C/k], and each of its bins takes exactly k pieces.  A
document is cut into full sequences and a remainder; a remainder whose class
would leave more than ``tolerance`` tokens of a bin empty is cut at the largest
reciprocal C // (k+1), its tail again, so that bins end nearly full.

Cutting depends on the document alone, so it happens where the token ids are;
only (doc_id, start, length, crc) leave the tokenising task.  Bins follow from
a piece's dense rank in its class: bin = rank // k, place = rank % k.  The
ranks come from a range sort with per-partition offsets, so workers fill their
bins independently and one bin per class stays incomplete in the whole corpus,
not one per worker.  Pieces of those incomplete bins (fewer than k per class,
a constant) are packed by first fit on decreasing lengths.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import bounded_batches, fixed, text_of
from linkweave.operators.ranking import dense_rank_table

CAPACITY = 1024
TOLERANCE = 24
END_ID = 0
SPECIAL = "<|endoftext|>"
CACHE_WORDS = 600_000  # cached space-delimited pieces per worker, some 120 MB

#: The tokenizer's file of ranks: the same vocabulary as its JSON file.
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL_ID = 50256


def tokenizer_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _OddSpace(Exception):
    """White space next to a space: the text can't be cut there."""


class _Pieces(dict):
    """Piece (without its leading space) -> id bytes; fills itself up to CACHE_WORDS pieces."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace():
            raise _OddSpace
        ids = array("I", self.encode(" " + piece)).tobytes()
        if len(self) < CACHE_WORDS and len(piece) < 64:
            self[piece] = ids
        return ids


class CachedBpe:
    """Byte-level BPE ids as little-endian uint32 bytes, cached by space-delimited piece.

    A space before a non-space character always starts a new pre-token, so a
    text can be encoded piece by piece at such spaces and equal pieces share one
    encoding.  Texts with other white space after a space, or with the special
    token's string, are encoded whole.
    """

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {SPECIAL: SPECIAL_ID} if SPECIAL_ID not in ranks.values() else {}
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.known = _Pieces(self.bpe.encode_ordinary)

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return self.bpe.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        first, *rest = text.split(" ")
        try:
            return array("I", self.bpe.encode_ordinary(first)).tobytes() + b"".join(map(self.known.__getitem__, rest))
        except _OddSpace:
            return array("I", self.bpe.encode_ordinary(text)).tobytes()


def cut_lengths(n: int, capacity: int = CAPACITY, tolerance: int = TOLERANCE) -> list[int]:
    """Lengths of the consecutive pieces of a document of ``n`` ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest > tolerance:
            piece = capacity // (k + 1)
        else:
            piece = rest
        out.append(piece)
        rest -= piece
    return out


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cutter(ranks_path: str | None, capacity: int, tolerance: int):
    names = [c.split()[0] for c in _PIECE.split(", ")]
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe = CachedBpe(ranks_path or tokenizer_path())  # the worker's own path
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = bpe.encode(texts[i].as_py()) + end
                n, at = len(ids) // 4, 0
                for m in cut_lengths(n, capacity, tolerance):
                    for col, x in zip(out, (doc, at, m, zlib.crc32(ids[4 * at : 4 * (at + m)]), n), strict=True):
                        col.append(x)
                    at += m
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return run


def pieces(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY, tolerance: int = TOLERANCE) -> DataFrame:
    """Cut pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_cutter(ranks_path, capacity, tolerance), _PIECE)


def _first_fit(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """First fit on decreasing lengths; at most a constant number of pieces (see ``pack``)."""
        rows = rows.sort_values(["length", "doc_id", "start", "spare"], ascending=[False, True, True, True]).reset_index(drop=True)
        room: list[int] = []
        bins, offsets = [], []
        for n in rows["length"]:
            b = next((i for i, r in enumerate(room) if r >= n), len(room))
            if b == len(room):
                room.append(capacity)
            bins.append(b)
            offsets.append(capacity - room[b])
            room[b] -= n
        return rows.assign(bin=bins, offset=offsets)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "offset"]]

    return run


def pack(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY, tolerance: int = TOLERANCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's ids and one END_ID; null text counts as
    empty (one id).  Null ids and repeated rows are packed like any other row.
    An empty table gives an empty result.
    """
    cut = pieces(docs, ranks_path, capacity, tolerance).withColumn("k", F.floor(F.lit(capacity) / F.col("length")).cast("long"))
    cut = cut.withColumn("spare", F.xxhash64("doc_id", "start", "ids_crc32"))
    # Fixed before the range sort, whose sampling would tokenise everything a second time.
    # Equal lengths stand together inside a class; the hash tells pieces of one length apart.
    ranked = dense_rank_table(fixed(cut), ["length", "spare"], ["k"], "nth")
    ranked = fixed(ranked)
    per_class = ranked.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` classes
    full_bins, base = {}, 0
    for k, n in sorted((r["k"], r["n"]) for r in per_class):
        full_bins[k] = (base, n // k)
        base += n // k
    spec = docs.sparkSession.createDataFrame([(k, b, m) for k, (b, m) in full_bins.items()], "ck long, base long, full long")
    placed = ranked.join(F.broadcast(spec), F.col("k") == F.col("ck"))  # at most ``capacity`` rows
    bin_no = F.floor(F.col("nth") / F.col("k")).cast("long")
    placed = fixed(placed.withColumn("bin", bin_no))
    whole = placed.where(F.col("bin") < F.col("full"))
    # Offsets inside a bin: a running sum over its k pieces; bins are groups of at most ``capacity`` rows.
    from pyspark.sql import Window

    inside = Window.partitionBy("k", "bin").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("bin")).alias("sequence_id"), "offset"
    )
    # Fewer than k pieces of each class are left: a constant number, whatever the corpus.
    left = placed.where(F.col("bin") >= F.col("full")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "spare")
    fitted = left.groupBy(F.lit(0).alias("g")).applyInPandas(_first_fit(capacity), f"{_PIECE}, bin long, offset long")
    rest = fitted.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(base) + F.col("bin")).alias("sequence_id"), "offset")
    return whole.unionByName(rest)
