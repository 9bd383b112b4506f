"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams (with word ends) and of
itself; its vector is the mean of their embeddings, a text's vector the mean of
its words' vectors, and a linear softmax decides. Embeddings and softmax are
trained jointly in numpy on a bounded sample of labelled rows, so a misspelled
word still shares most n-gram vectors with the word it was.

Because the softmax is linear, a text's logit is the mean of one number per
word. The logit of the text's most toxic passage (WINDOW words) is computed as
well, and a two-input logistic link, fitted on the same sample, turns both into
the score; a few insults in a long text are so not averaged away.

Defined cases: null or word-less texts get the score of the bias alone; ids
missing from the labels do not train; null labels are ignored; conflicting or
repeated labels each count as a row; if the sample lacks a class, every text
gets that sample's share of toxic rows (0 without rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, LOWER, held_out, text_blocks, word_hashes, words

#: Bound on the labelled rows per class that training reads, and on the bytes of all their texts.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 16 << 20
BUCKETS = 1 << 17
DIM = 4
NGRAMS = (3, 4, 5)
WINDOW = 20
THRESHOLD = 0.7
STEPS = 80
RATES = (3.0, 1.0, 0.3)

#: Word bytes: letters, digits and all non-ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_SPREAD = np.array([pow(0x9E3779B97F4A7C15 | 1, k, 1 << 64) for k in range(16)], np.uint64)


def subwords(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word index, bucket) pairs: the n-grams of <word> by n, then the word itself."""
    if not len(starts):
        return
    lengths = ends - starts
    # One padded copy: every word between two bytes that no word has.
    total = int(lengths.sum()) + 2 * len(starts)
    begin = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])
    word = np.repeat(np.arange(len(starts)), lengths + 2)
    inner = np.arange(total) - begin[word]
    source = np.clip(starts[word] + inner - 1, 0, len(low) - 1)
    padded = low[source].astype(np.uint64)
    padded[inner == 0] = 1
    padded[inner == lengths[word] + 1] = 2
    left = lengths[word] + 2 - inner  # bytes from here to the word's end
    for n in NGRAMS:
        if total < n:
            continue
        h = np.full(total - n + 1, n, np.uint64)
        for k in range(n):
            h += padded[k : total - n + 1 + k] * _SPREAD[k + 1]
        at = np.flatnonzero(left[: total - n + 1] >= n)
        yield word[at], _bucket(h[at], buckets)
    sums = np.zeros(total + 1, np.uint64)
    weights = _SPREAD[1] * (inner.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    np.cumsum((padded + np.uint64(7)) * (padded * np.uint64(0xD1342543DE82EF95) + weights) * weights, out=sums[1:])
    yield np.arange(len(starts)), _bucket(sums[begin + lengths + 2] - sums[begin], buckets)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes; start, end, row and hash of each word. A word said again at once counts once."""
    low = LOWER[data]
    starts, ends, rows = words(low, offs, _WORD)
    hashes = word_hashes(low, starts, ends)
    new = np.ones(len(starts), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return low, starts[new], ends[new], rows[new], hashes[new]


class Model:
    """Word logits by subword bucket, and the link from a text's logits to its score."""

    def __init__(self, logits: np.ndarray, bias: float, link: tuple[float, float, float] | None, prior: float, window: int = WINDOW):
        self.logits, self.bias, self.link, self.prior, self.window = logits, bias, link, prior, window

    def word_logits(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.zeros(len(at))
        count = np.zeros(len(at))
        for word, bucket in subwords(low, starts[at], ends[at], len(self.logits)):
            total += np.bincount(word, weights=self.logits[bucket], minlength=len(at))
            count += np.bincount(word, minlength=len(at))
        return (total / np.maximum(count, 1))[back]

    def features(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Per row: mean word logit, and the largest mean over WINDOW words (shorter texts: padded with zeros)."""
        n = len(offs) - 1
        out = np.zeros((n, 2))
        low, starts, ends, rows, hashes = _tokens(data, offs)
        if not len(starts):
            return out
        z = self.word_logits(low, starts, ends, hashes)
        count = np.bincount(rows, minlength=n)
        out[:, 0] = np.bincount(rows, weights=z, minlength=n) / np.maximum(count, 1)
        last = np.cumsum(count)
        total = np.concatenate([[0.0], np.cumsum(z)])
        ahead = np.minimum(np.arange(len(z)) + self.window, last[rows])
        sums = (total[ahead] - total[np.arange(len(z))]) / self.window
        here = np.flatnonzero(count)
        out[here, 1] = np.maximum.reduceat(sums, last[here] - count[here])
        return out

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.link is None:
            return np.full(len(offs) - 1, self.prior)
        a, b, c = self.link
        f = self.features(data, offs)
        return 1 / (1 + np.exp(-np.clip(a * f[:, 0] + b * f[:, 1] + c, -500, 500)))


def _blocks(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes."""
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def train(texts: list[bytes], toxic: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, steps: int = STEPS, share: float | None = None, seed: int = 7) -> Model:
    """Joint full-batch training (Adam) of embeddings and softmax, then of the link.

    share: of toxic rows among all labelled rows, where the sample has another.
    """
    y = np.asarray(toxic, np.float64)
    prior = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1), 0.0, None, prior)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    # Word hashes need eight bytes a byte, so the sample is hashed in blocks.
    parts = []
    for lo, hi in _blocks(offs):
        _, s, e, r, h = _tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        parts.append(((s + offs[lo]).astype(np.int32), (e + offs[lo]).astype(np.int32), (r + lo).astype(np.int32), h))
    starts, ends, rows, hashes = (np.concatenate([x[i] for x in parts]) for i in range(4))
    del parts
    low = LOWER[data]
    # Distinct words, and how often each stands in each text; words of a single text teach nothing.
    _, at, ids = np.unique(hashes, return_index=True, return_inverse=True)
    length = np.maximum(np.bincount(rows, minlength=len(y)), 1)
    del hashes
    cell, tf = np.unique(rows.astype(np.int64) * len(at) + ids, return_counts=True)
    doc, term = (cell // len(at)).astype(np.int32), (cell % len(at)).astype(np.int32)
    del cell, ids, rows
    shared = np.bincount(term, minlength=len(at)) > 1
    keep = shared[term]
    doc, tf, term = doc[keep], tf[keep], (np.cumsum(shared) - 1).astype(np.int32)[term[keep]]
    at = at[shared]
    starts, ends = starts[at].astype(np.int64), ends[at].astype(np.int64)
    pairs = [(w.astype(np.int32), b.astype(np.int32)) for w, b in subwords(low, starts, ends, buckets)]
    if not pairs:
        return Model(np.zeros(1), 0.0, None, prior if share is None else share)
    word, bucket = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    del pairs, starts, ends, low
    used, bucket = np.unique(bucket, return_inverse=True)
    bucket = bucket.astype(np.int32)
    vocabulary = at
    weight = (1 / np.bincount(word, minlength=len(vocabulary)))[word].astype(np.float32)
    part = (tf / length[doc]).astype(np.float32)
    # A fifth of the sample is kept from the embeddings, for the link.
    apart = np.arange(len(y)) % 5 == 4
    if not (0 < y[apart].sum() < apart.sum() and 0 < y[~apart].sum() < (~apart).sum()):
        apart[:] = False
    mine = ~apart
    balance = np.where(mine, np.where(y == 1, 0.5 / y[mine].sum(), 0.5 / (1 - y[mine]).sum()), 0).astype(np.float32)

    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (dim, len(used))).astype(np.float32)
    w = rng.normal(0, 0.5, dim).astype(np.float32)
    bias = np.zeros(1, np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, w, bias)]
    gather = lambda i, v, n: np.bincount(i, weights=v, minlength=n).astype(np.float32)
    for step in range(1, steps + 1):
        vectors = [gather(word, e[k][bucket] * weight, len(vocabulary)) for k in range(dim)]
        hidden = np.stack([gather(doc, v[term] * part, len(y)) for v in vectors])
        p = 1 / (1 + np.exp(-np.clip(w @ hidden + bias, -30, 30)))  # the softmax of two classes
        g = (p - y).astype(np.float32) * balance
        back = gather(term, g[doc] * part, len(vocabulary))
        back = gather(bucket, back[word] * weight, len(used))
        grads = (np.outer(w, back) + 1e-7 * e, hidden @ g + 1e-5 * w, np.array([g.sum()], np.float32))
        for value, grad, (m, v), rate in zip((e, w, bias), grads, state, RATES, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    logits = np.zeros(buckets)
    logits[used] = w @ e
    model = Model(logits, float(bias[0]), (1.0, 0.0, float(bias[0])), prior)
    fit = apart if apart.any() else ~apart
    seen = np.concatenate([model.features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in _blocks(offs)])[fit]
    a, b, _ = _link(seen, y[fit])
    c = _tuned(seen @ np.array([a, b]), y[fit], prior if share is None else share)
    model.link = (a, b, c)
    return model


def _link(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Logistic regression on two features by Newton steps with a small ridge."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    b = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = a.T * (p * (1 - p) + 1e-9) @ a + np.diag([1e-2, 1e-2, 1e-3])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([1e-2, 1e-2, 1e-3]) * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0] / scale[0]), float(b[1] / scale[1]), float(b[2])


def _tuned(logit: np.ndarray, y: np.ndarray, share: float) -> float:
    """The bias that puts THRESHOLD where F1 is best at the given share of toxic rows."""
    order = np.argsort(-logit, kind="stable")
    pos, z = y[order], logit[order]
    hits = np.cumsum(pos) / pos.sum() * share
    false = np.cumsum(1 - pos) / (1 - pos).sum() * (1 - share)
    i = int(np.argmax(2 * hits / (hits + false + share)))
    cut = (z[i] + z[min(i + 1, len(z) - 1)]) / 2
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains on labelled rows whose crc32(id) mod 3 is not 1: at most sample_rows of each class, by hash, and sample_bytes of text.

    The ids are chosen from the labels alone (a top-k by hash), then looked up
    in the documents; only this bounded sample reaches the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.filter(~held_out(3, 1, "id"))
    share = known.agg(F.avg("y")).first()[0]
    order = F.xxhash64("id", F.lit(11))
    # Twice the bound, as some labels may have no document.
    chosen = [known.filter(F.col("y") == k).orderBy(order, "id").limit(2 * sample_rows) for k in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("body")).filter("body is not null")
    # The ids are at most 4 * sample_rows rows of two numbers: a proven bound for the broadcast.
    found = texts.join(F.broadcast(ids), "id").select("id", "y", F.xxhash64("body").alias("h"), F.octet_length("body").alias("size"), "body")
    # First which rows, without their texts, as each task sends its own best; then the texts of those.
    sizes = found.select("id", "y", "h", "size")
    light = [r for k in (0, 1) for r in sizes.filter(F.col("y") == k).orderBy(order, "h").limit(sample_rows).collect()]
    picked, total = {}, 0
    for r in sorted(set(light), key=lambda r: (r["id"] * 2654435761 % (1 << 32), r["id"], r["h"], r["y"])):
        if total + r["size"] <= sample_bytes:
            total += r["size"]
            picked[r["id"], r["h"], r["y"]] = b""
    if picked:
        keys = docs.sparkSession.createDataFrame(list({(i, h) for i, h, _ in picked}), "id long, h long")
        for r in texts.withColumn("h", F.xxhash64("body")).join(F.broadcast(keys), ["id", "h"]).select("id", "h", "body").toLocalIterator():
            for k in (0, 1):
                if (r["id"], r["h"], k) in picked:
                    picked[r["id"], r["h"], k] = r["body"].encode()
    sample = [(body, y) for (_, _, y), body in picked.items()]
    return train([t for t, _ in sample], np.array([y for _, y in sample]), share=share)


def _scorer(model: Model, threshold: float, keep_clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_blocks(batches, "__text"):
            score = model.scores(data, offs)
            if keep_clean:
                yield batch.filter(pa.array(score < threshold))
                continue
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    df = docs.select("doc_id", held_out(3, 1).alias("held_out"), F.col("text").cast("string").alias("__text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(_scorer(model, threshold, False), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold; all columns come back."""
    names = docs.columns
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields)
    out = inner.mapInArrow(_scorer(model, threshold, True), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
