"""Toxicity by subword bags: the mean of learned n-gram embeddings under a linear softmax.

Every word between boundary marks gives its character n-grams of 3 to 6 bytes and itself; each
falls into a hash bucket with an embedding. The mean over all of a text goes into a two-class
linear softmax. Embeddings and classifier are trained jointly in numpy on a bounded, balanced
sample of labelled rows, so misspelt words share vectors with the words they look like.

After training a bucket's share of the margin is one number (embedding times the difference of the
class weights), which is what scoring sums up. Null and empty texts have no features; their margin
is the bias. Without labels of both classes every score is 0. Labels that are null, not 0 or 1 or
without document are ignored, and of repeated labels the lowest counts. Of rows that share a labelled
doc_id one is learned from. Long texts are scored whole, in one numpy run of some tens of bytes a byte.
Repeated rows get equal scores, each its own row; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxstats.llm.text import Rolling, runs, utf8, word_bounds

#: Labelled rows of each class that training sees at most.
SAMPLE_PER_CLASS = 1500
BITS, DIM = 17, 8
GRAMS = (3, 4, 5, 6)


@dataclass
class ToxicityModel:
    """Embeddings [buckets, dim], class weights [dim, 2] and class biases [2]."""

    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    shift: float = 0.0

    def margins(self) -> np.ndarray:
        return (self.embedding @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def features(text: pa.Array):
    """(bucket, row) arrays of each family of features of lower-cased texts."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(text, "")))
    inner = np.zeros(256, bool)
    inner[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    starts, ends, rows = word_bounds(data, offsets, ~inner[data])
    n_rows = len(offsets) - 1
    if not len(starts):
        return n_rows, []
    # Words side by side with one mark between them, and one at either end of the array.
    length = ends - starts
    place = np.concatenate([[0], np.cumsum(length + 1)])
    stream = np.full(place[-1] + 1, 0x20, np.uint8)
    inside = np.ones(len(stream), bool)
    inside[place] = False
    source = np.zeros(len(data) + 1, np.int64)
    source[starts] += 1
    source[ends] -= 1
    stream[inside] = data[np.cumsum(source[:-1]).astype(bool)]
    owner = np.repeat(rows, length + 1)
    code = stream.astype(np.uint32) + np.uint32(1)
    shift = np.uint32(32 - BITS)
    value, valid, out = code, np.ones(len(code), bool), []
    for n in range(2, max(GRAMS) + 1):
        if n > len(code):
            break
        value = value[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
        valid = valid[: len(value)]
        if n > 2:
            valid = valid & inside[n - 2 : n - 2 + len(value)]
        if n in GRAMS:
            at = np.flatnonzero(valid)
            out.append((((value[at] ^ (value[at] >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> shift, owner[np.minimum(at, len(owner) - 1)]))
    words = Rolling(data).spans(starts, ends)
    out.append(((words >> np.uint64(64 - BITS)).astype(np.uint32), rows))
    return n_rows, out


def _train(index: np.ndarray, value: np.ndarray, begin: np.ndarray, y: np.ndarray, epochs=12, size=48, rate=0.3, scale=20.0, seed=3):
    """Joint training of embeddings and softmax with AdaGrad on fixed batches in shuffled order."""
    rng = np.random.default_rng(seed)
    n = len(y)
    embedding = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weights = rng.uniform(-0.5, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = [np.full(x.shape, 1e-6, np.float32) for x in (embedding, weights, bias)]
    order = rng.permutation(n)
    batches = [np.sort(order[i : i + size]) for i in range(0, n, size)]
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            docs = batches[b]
            at = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
            row = np.repeat(np.arange(len(docs)), begin[docs + 1] - begin[docs])
            if not len(at):
                continue
            used, inverse = np.unique(index[at], return_inverse=True)
            share = value[at]
            part = embedding[used]
            mean = np.stack([np.bincount(row, share * part[inverse, d], len(docs)) for d in range(DIM)], 1).astype(np.float32) * scale
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            slope = p
            slope[np.arange(len(docs)), y[docs]] -= 1
            slope /= len(docs)
            back = (slope @ weights.T) * scale
            grads = [
                np.stack([np.bincount(inverse, share * back[row, d], len(used)) for d in range(DIM)], 1).astype(np.float32),
                mean.T @ slope, slope.sum(axis=0),
            ]
            squares[0][used] += grads[0] ** 2
            embedding[used] = part - rate * grads[0] / np.sqrt(squares[0][used])
            for x, g, s in ((weights, grads[1], squares[1]), (bias, grads[2], squares[2])):
                s += g * g
                x -= 0.3 * rate * g / np.sqrt(s)
    return embedding * np.float32(scale), weights, bias


def bags(text: pa.Array) -> pa.Array:
    """The distinct buckets of each text and their shares, packed."""
    n, parts = features(text)
    keys = np.concatenate([(r << BITS) | b for b, r in parts]) if parts else np.zeros(0, np.int64)
    keys, count = np.unique(keys, return_counts=True)
    row = keys >> BITS
    packed = np.empty(len(keys), [("f", "<i4"), ("v", "<f4")])
    packed["f"] = keys & ((1 << BITS) - 1)
    packed["v"] = count / np.maximum(np.bincount(row, weights=count, minlength=n), 1)[row]
    cut = np.searchsorted(row, np.arange(n + 1))
    return pa.array([packed[cut[i] : cut[i + 1]].tobytes() for i in range(n)], pa.binary())


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, per_class: int = SAMPLE_PER_CLASS, seed: int = 7) -> ToxicityModel | None:
    """Train on at most ``per_class`` labelled rows of each class among those that ``allowed`` (a
    condition on doc_id) lets through. Only the text of a row is a feature."""
    clean = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("_y"))
    if allowed is not None:
        clean = clean.filter(allowed)
    chosen = None
    for y in (0, 1):
        part = clean.filter(F.col("_y") == y).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def work(batches):
        for whole in batches:
            for batch in runs(whole):
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").cast(pa.int64()), "y": batch.column("_y").cast(pa.int32()), "bag": bags(batch.column("text"))}
                )

    rows = sample.select("doc_id", "_y", "text").mapInArrow(work, "doc_id long, y int, bag binary").toArrow().sort_by("doc_id")
    y = rows.column("y").to_numpy().astype(np.int64)
    share = [clean.filter(F.col("_y") == v).count() for v in (0, 1)] if len(y) else [0, 0]
    if len(set(y)) < 2:
        return None
    body, offsets = utf8(rows.column("bag"))
    packed = np.frombuffer(body, [("f", "<i4"), ("v", "<f4")])
    index, value = packed["f"].copy(), packed["v"].copy()
    del rows, body, packed
    model = ToxicityModel(*_train(index, value, offsets // 8, y))
    # The sample is balanced; half of the logarithm of the true odds is given back.
    model.shift = 0.5 * math.log((share[1] / (y == 1).sum()) / (share[0] / (y == 0).sum()))
    return model


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id, text -> doc_id, score (probability of class 1). Other columns are not read."""
    table = model.margins() if model else None
    bias = float(model.bias[1] - model.bias[0] + model.shift) if model else 0.0

    def work(batches):
        for whole in batches:
            for batch in runs(whole):
                if table is None:
                    p = np.zeros(batch.num_rows)
                else:
                    n, parts = features(batch.column("text"))
                    total, count = np.zeros(n), np.zeros(n)
                    for bucket, row in parts:
                        total += np.bincount(row, weights=table[bucket], minlength=n)
                        count += np.bincount(row, minlength=n)
                    p = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -50, 50)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(p)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double")
