"""Language identification by a bidirectional gated recurrent network over bytes (operator 4).

The network reads UTF-8 bytes in both directions, labels every position with a
distribution over languages, and a document's probability is the mean over its
positions.  It is trained in numpy by backpropagation through time on a bounded
sample of windows (``MAX_DOCS`` documents, balanced over languages).

Prediction runs inside Arrow batches: texts are cut into windows of ``WINDOW``
bytes, every byte of every text is in exactly one window, and thousands of
windows step through the network together.  Memory per task is one block of
windows, whatever the length of a text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import blocks, bounded_batches, fixed, held_out, small, text_of, uniform

HIDDEN = 8
WINDOW = 128
BLOCK = 2048  # windows that step together
MAX_DOCS = 1600  # labelled documents in the training sample, over all languages
SLICES, SLICE_CHARS = 2, 90
STEPS, BATCH, TRAIN_LEN, RATE = 260, 128, 64, 0.02
UNDETERMINED = "und"
_MAYBE = re.compile(r"[^\W\d_]")  # letters, and numbers such as ² or Ⅳ


def _lettered(text: str) -> bool:
    """Whether a character of the text has a letter category of Unicode (L*)."""
    return any(unicodedata.category(m.group())[0] == "L" for m in _MAYBE.finditer(text))


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


class ByteGRU:
    """Two gated recurrent layers (forward, backward) over byte embeddings, softmax per position.

    Feature-major arrays: a state is (hidden, batch).  Update and reset gates
    are sigmoids written as (1 + tanh(x / 2)) / 2.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        p = {}
        for d in "fb":
            p[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)  # input weights plus bias, one row per byte
            p[f"U{d}"] = rng.normal(0, 0.3, (2 * hidden, hidden)).astype(np.float32)
            p[f"C{d}"] = rng.normal(0, 0.3, (hidden, hidden)).astype(np.float32)
            p[f"W{d}"] = rng.normal(0, 0.3, (len(labels), hidden)).astype(np.float32)
        p["o"] = np.zeros((len(labels), 1), np.float32)
        self.p = p

    # ---- training
    def _run(self, d: str, x: np.ndarray, order: range):
        """States and gate values per step; x: (length, batch) bytes."""
        h, p, keep = self.h, self.p, []
        s = np.zeros((h, x.shape[1]), np.float32)
        for t in order:
            e = p[f"E{d}"][x[t]].T
            g = 0.5 * np.tanh(0.5 * (e[: 2 * h] + p[f"U{d}"] @ s)) + 0.5
            z, r = g[:h], g[h:]
            c = np.tanh(e[2 * h :] + p[f"C{d}"] @ (r * s))
            new = s + z * (c - s)
            keep.append((t, s, z, r, c, new))
            s = new
        return keep

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray):
        """Mean cross-entropy over unmasked positions and its gradient by backpropagation through time."""
        p, h, n_labels = self.p, self.h, len(self.labels)
        length, batch = x.shape
        runs = {"f": self._run("f", x, range(length)), "b": self._run("b", x, range(length - 1, -1, -1))}
        states = {d: np.empty((length, h, batch), np.float32) for d in "fb"}
        for d, keep in runs.items():
            for t, *_, new in keep:
                states[d][t] = new
        logits = np.einsum("kh,thb->tkb", p["Wf"], states["f"]) + np.einsum("kh,thb->tkb", p["Wb"], states["b"]) + p["o"]
        logits -= logits.max(1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(1, keepdims=True)
        hot = (np.arange(n_labels)[:, None] == y).astype(np.float32)
        total = max(float(mask.sum()), 1.0)
        loss = -float((np.log((q * hot).sum(1) + 1e-9) * mask).sum()) / total
        dl = (q - hot) * mask[:, None, :] / total
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["o"] = dl.sum((0, 2))[:, None].astype(np.float32)
        for d, keep in runs.items():
            grad[f"W{d}"] = np.einsum("tkb,thb->kh", dl, states[d])
            ds_out = np.einsum("kh,tkb->thb", p[f"W{d}"], dl)
            ds = np.zeros((h, batch), np.float32)
            for t, s, z, r, c, _ in reversed(keep):
                ds = ds + ds_out[t]
                dz = ds * (c - s) * z * (1 - z)
                dc = ds * z * (1 - c * c)
                drs = p[f"C{d}"].T @ dc
                dr = drs * s * r * (1 - r)
                dg = np.concatenate([dz, dr])
                grad[f"U{d}"] += dg @ s.T
                grad[f"C{d}"] += dc @ (r * s).T
                np.add.at(grad[f"E{d}"], x[t], np.concatenate([dg, dc]).T)
                ds = ds * (1 - z) + drs * r + p[f"U{d}"].T @ dg
        return loss, grad

    def fit(self, texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 11) -> ByteGRU:
        """Adam on random windows of the sample; windows are drawn by label in turn."""
        rng = np.random.default_rng(seed)
        by = {k: [t for t, lab in zip(texts, labels, strict=True) if lab == k and t] for k in self.labels}
        names = [k for k in self.labels if by[k]]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, steps + 1 if len(names) > 1 else 1):
            x = np.zeros((TRAIN_LEN, BATCH), np.uint8)
            y = np.zeros(BATCH, np.int64)
            for j in range(BATCH):
                k = names[j % len(names)]
                t = by[k][rng.integers(len(by[k]))]
                at = rng.integers(max(1, len(t) - TRAIN_LEN // 2))
                part = t[at : at + TRAIN_LEN]
                x[: len(part), j] = np.frombuffer(part, np.uint8)
                y[j] = self.labels.index(k)
            _, grad = self.loss_and_gradients(x, np.broadcast_to(y, x.shape)[:, None, :], (x != 0).astype(np.float32))
            rate = RATE * (1.0 if step < 0.7 * steps else 0.2)
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    # ---- prediction
    def position_sums(self, x: np.ndarray) -> np.ndarray:
        """(labels, windows): label probabilities summed over the non-zero positions; x: (length, windows) bytes."""
        p, h, k = self.p, self.h, len(self.labels)
        length, n = x.shape
        logits = np.empty((length, k, n), np.float32)
        rows, g = np.empty((n, 3 * h), np.float32), np.empty((3 * h, n), np.float32)
        a, c = np.empty((2 * h, n), np.float32), np.empty((h, n), np.float32)
        out = np.empty((k, n), np.float32)
        for d, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            emb = p[f"E{d}"].copy()
            emb[:, : 2 * h] *= 0.5
            u, cw, w = p[f"U{d}"] * np.float32(0.5), p[f"C{d}"], p[f"W{d}"]
            s = np.zeros((h, n), np.float32)
            for t in order:
                np.take(emb, x[t], axis=0, out=rows, mode="clip")
                g[:] = rows.T
                np.matmul(u, s, out=a)
                a += g[: 2 * h]
                np.tanh(a, out=a)
                a *= 0.5
                a += 0.5
                z, r = a[:h], a[h:]
                r *= s
                np.matmul(cw, r, out=c)
                c += g[2 * h :]
                np.tanh(c, out=c)
                c -= s
                c *= z
                s += c
                if d == "f":
                    np.matmul(w, s, out=logits[t])
                else:
                    np.matmul(w, s, out=out)
                    logits[t] += out
        total = np.zeros((k, n), np.float32)
        for t in range(length):
            q = logits[t]
            q += p["o"]
            q -= q.max(0)
            np.exp(q, out=q)
            q /= q.sum(0)
            q *= x[t] != 0
            total += q
        return total

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Label and pooled probability per text; ``und`` with 0.0 if the text has no letter."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.labels:
            return names, scores
        todo = [i for i, t in enumerate(texts) if _lettered(t)]
        pooled = {i: np.zeros(len(self.labels)) for i in todo}
        raw = ((i, texts[i].encode("utf-8", "replace")) for i in todo)
        windows = ((i, b[at : at + WINDOW]) for i, b in raw for at in range(0, len(b), WINDOW))
        for block in _chunks(windows, BLOCK):
            x = np.frombuffer(b"".join(b.ljust(WINDOW, b"\0") for _, b in block), np.uint8).reshape(len(block), WINDOW)
            sums = self.position_sums(np.ascontiguousarray(x.T))
            owner = np.array([i for i, _ in block])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            for i, total in zip(owner[starts], np.add.reduceat(sums, starts, axis=1).T, strict=True):
                pooled[i] += total
        for i in todo:
            q = pooled[i] / max(pooled[i].sum(), 1e-9)
            best = int(q.argmax())
            names[i], scores[i] = self.labels[best], float(min(max(q[best], 0.0), 1.0))
        return names, scores


def _chunks(items, n: int) -> Iterator[list]:
    out = []
    for item in items:
        out.append(item)
        if len(out) == n:
            yield out
            out = []
    if out:
        yield out


def train(docs: DataFrame, max_docs: int = MAX_DOCS, steps: int = STEPS) -> ByteGRU:
    """Fit on at most about ``max_docs`` documents with a language and a non-held-out id.

    Each language gives an equal share, drawn by a hash of the text; a document
    gives ``SLICES`` slices of ``SLICE_CHARS`` characters, so that what reaches
    the driver is bounded by the parameters.
    """
    bounded_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    known = known.where(F.col("lang").isNotNull() & ~held_out())
    # Copies don't count: the draw below is by text, so the rate is over distinct texts.
    counts = fixed(known.select("lang", F.xxhash64("text").alias("t")).distinct().groupBy("lang").count())
    n = counts.count()
    if n == 0:
        return ByteGRU([])
    share = max(1, max_docs // n)
    rates = counts.select(F.col("lang").alias("l"), F.least(F.lit(share) / F.col("count"), F.lit(1.0)).alias("rate"))
    sample = known.join(small(rates, n, 10_000), F.col("lang") == F.col("l")).where(uniform("text") < F.col("rate"))
    spots = [F.substring("text", (uniform("text", F.lit(i)) * F.greatest(F.length("text") - SLICE_CHARS, F.lit(0))).cast("int") + 1, F.lit(SLICE_CHARS)) for i in range(SLICES)]
    picked = sample.select("lang", F.explode(F.array(*spots)).alias("part")).distinct().orderBy("lang", "part").limit(4 * max_docs * SLICES).collect()  # bounded by max_docs
    labels = sorted({r["lang"] for r in picked})
    parts = [r["part"].encode("utf-8", "replace") for r in picked]
    return ByteGRU(labels).fit(parts, [r["lang"] for r in picked], steps)


def predictor(model: ByteGRU):
    """Column function text -> struct<lang string, score double> that carries the model."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("lang string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part.fillna("").tolist()
            names, scores = [], []
            for block in blocks(texts, map(len, texts), 4 << 20):
                a, b = model.predict(block)
                names += a
                scores += b
            yield pd.DataFrame({"lang": names, "score": scores})

    return run


def identify(docs: DataFrame, model: ByteGRU | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null or letterless text: ``und`` with score 0.  Without labelled rows every
    document is ``und``.  Repeated rows are predicted alike; an empty table
    gives an empty result.
    """
    model = train(docs) if model is None else model
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predictor(model)(text_of()).alias("p"))
    return found.select("doc_id", held_out().alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
